import random

from docloom.llm import scan_repair as sr

WORDS = "the officer must implement a reviewable declaration under section before council of temporary determination and modern cross-border documents were returned".split()
SCHEMA = "stable_id string, page_num int, text string, extracted_at timestamp, kind string"


def corpus():
    """Clean pages that make the lexicon, a page an attachment."""
    return [(f"clean{i}", 1, "\n".join(" ".join(WORDS[(i + j) % 7 :]) + "." for j in range(12)), None, "x") for i in range(12)]


def run(spark, rows):
    df = spark.createDataFrame(corpus() + rows, SCHEMA)
    lines = {(r.stable_id, r.page_num, r.line_no, r.kind) for r in sr.scan_lines(df).collect() if r.stable_id[:5] != "clean"}
    text = {(r.stable_id, r.page_num): r.repaired for r in sr.scan_pages(df).collect()}
    return lines, text


def test_kinds_and_text(spark):
    header = "REVIEW OF THE BORDER CROSSING"
    pages = [
        f"{header}\n\nthe 0fficer must irnplement a review-\nable declaration before the cross-\nborder council.\n\nthe deter-\n- 7 -",
        "REVIEW  OF THE B0RDER CROSSING\nmination must implement a modern declaration\nunder temporary docurnents.\n- 8 -",
        f"{header}\r\nthe council must implement 2014 a declaration.\r\n- 9 -",
        f"{header}\n2019\nthe officer must implement a declaration.\n- 10 -",
    ]
    lines, text = run(spark, [("a", i, t, None, "x") for i, t in enumerate(pages, 1)] + [("a", 1, pages[0], None, "y")])
    assert lines == {
        ("a", 1, 1, "running"), ("a", 1, 3, "misread"), ("a", 1, 3, "hyphen"), ("a", 1, 7, "hyphen"), ("a", 1, 8, "page_number"),
        ("a", 2, 1, "running"), ("a", 2, 3, "misread"), ("a", 2, 4, "page_number"), ("a", 3, 1, "running"), ("a", 3, 3, "page_number"), ("a", 4, 1, "running"), ("a", 4, 4, "page_number"),
    }
    assert text["a", 1] == "the officer must implement a reviewable declaration before the cross-border council.\n\nthe determination"
    assert text["a", 2] == "must implement a modern declaration under temporary documents."


def test_edge_cases(spark):
    long = " ".join(WORDS * 3000)
    rows = [("n", 1, None, None, "x"), ("e", 1, "", None, "x"), ("b", 1, " \n\t\n", None, "x"), (None, 1, "the officer", None, "x"), ("p", None, "the officer", None, "x"), ("z", 0, "the 0fficer", None, "x"), ("l", 1, long, None, "x"), ("two", 1, "HEADER LINE\n1", None, "x"), ("two", 2, "HEADER LINE\n2", None, "x")]
    lines, text = run(spark, rows)
    assert lines == {("z", 0, 1, "misread")}
    assert text["z", 0] == "the officer" and text["l", 1] == long and text["e", 1] == "" and ("n", 1) not in text


def test_empty(spark):
    assert sr.scan_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_strokes_agree_for_every_confusion():
    for word in ("modern", "hid", "window", "unique", "different", "yellow"):
        for plain, seen in (("m", "rn"), ("h", "li"), ("d", "cl"), ("w", "vv"), ("n", "ri"), ("u", "ii"), ("o", "0"), ("e", "c"), ("i", "1"), ("l", "|"), ("t", "f"), ("g", "q")):
            if plain in word:
                assert sr.strokes(word) == sr.strokes(word.replace(plain, seen, 1))
    assert sr.confusions("modern", "rnodcrn") == [("m", "rn"), ("e", "c")]


def test_page_values():
    assert [sr.page_value(x) for x in ("[12]", "- 3 -", "Page | 7", "p. l9", "Page 4 of 9", "xiv", "2019.", "12 cases", "17")] == [(12, True), (3, True), (7, True), (19, True), (4, True), (14, True), None, None, (17, False)]


def test_words_of_roman_letters_are_words():
    assert sr.is_word("civil") and sr.is_word("Vivid") and not sr.is_word("xiv") and not sr.is_word("542(a)(3)") and not sr.is_word("R.C.F")


def test_headings_stand_alone():
    lex = sr.Lexicon(36, {"the": 9, "officer": 9, "scope": 9, "ends": 9}, {}, {}, {}, (sr.np.empty(0, sr.np.int64), sr.np.empty(0, sr.np.int32)), {})
    assert sr.repair("The officer ends.\nScope\nThe officer\nends.", {}, lex, None, None)[1] == "The officer ends.\n\nScope\n\nThe officer ends."


def sentences(r, words, n):
    return "\n".join(" ".join(r.choice(words) for _ in range(9)) + "." for _ in range(n))


def test_the_channel_and_the_company_decide(spark):
    """Rates are learnt from the corpus; a word with company of its own stays one beside a frequent look-alike; a lost letter is a misreading too."""
    r = random.Random(7)
    words = "returned modern burning harbor permit learning warning concern external internal attorney hearing journal corner eastern western pattern".split()
    lost = lambda w, i: w[:i] + w[i + 1 :]
    noisy = lambda w: w.replace("rn", "m", 1) if r.random() < 0.02 else lost(w, r.randrange(len(w))) if r.random() < 0.01 and len(w) > 5 else w
    texts = [" \n".join(" ".join(noisy(r.choice(words)) for _ in range(9)) + " end." for _ in range(40)) for _ in range(60)]
    texts += ["\n".join(f"the cable modem of {r.choice(words)} works" for _ in range(12))] * 5 + ["the tarn lies behind the cable", "the permit of the warming"]
    pages = [(f"s{i}", 1, t, None, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(pages, SCHEMA)
    found = {(x.stable_id, x.line_no) for x in sr.scan_lines(df).where("kind = 'misread'").collect()}
    wrong, missed = 0, 0
    known = {*words, *"the cable modem of works tarn lies behind end permit".split()}
    for sid, _, text, _, _ in pages:
        for no, line in enumerate(text.split("\n"), 1):
            bad = any(w.strip(".") not in known for w in line.split()) or "modem" in line and "cable" not in line
            wrong += (sid, no) in found and not bad
            if (sid, no) in found and not bad:
                print("wrong", sid, no, line)
            missed += bad and (sid, no) not in found
    assert wrong == 0
    assert missed <= 0.02 * 2400
    assert not any(s == f"s{i}" for i in range(60, 66) for s, _ in found)  # modem and tarn are words


def test_beyond_the_bound_the_result_is_the_same(spark, monkeypatch):
    r = random.Random(5)
    noise = [("m", "rn"), ("h", "li"), ("e", "c"), ("o", "0"), ("d", "cl")]
    rows = []
    for a in range(6):
        for page in range(1, 8):
            text = sentences(r, WORDS, 14).replace("declaration under", "decla-\nration under").replace("modern", "mod-\nern" if page % 2 else "modern")
            for x, y in noise:
                text = "".join(y if c == x and r.random() < 0.01 else c for c in text)
            rows.append((f"a{a}", page, f"REVIEW OF THE BORDER\n{text} - and the deter-\n- {page} -", None, "x"))
    df = spark.createDataFrame(corpus() + rows, SCHEMA)
    plain = lambda: sorted((x.stable_id, x.page_num, str(sorted(map(tuple, x.lines))), x.repaired) for x in sr.scan_pages(df).collect())
    want = plain()
    monkeypatch.setattr(sr, "LEXICON_ROWS", 0)
    monkeypatch.setattr(sr, "SHARE", 10)
    assert plain() == want and sum("misread" in x[2] for x in want) > 20


def test_headers_of_a_chapter_and_of_large_attachments(spark):
    """A header on some pages nearby is one, in a chapter of a long attachment and across the edges of blocks; three lines deep too."""
    r = random.Random(3)
    pages = [(1 + i, ("THE THIRD CHAPTER\n" if 240 <= i < 270 else "") + sentences(r, WORDS, 5) + f"\nOffice of Reviews\nVolume Two\n{i + 1}") for i in range(600)]
    got = {(x.page_num, x.line_no, x.kind) for x in sr.scan_lines(spark.createDataFrame([("a", p, t, None, "x") for p, t in pages], SCHEMA)).collect() if x.kind != "misread"}
    want = set()
    for p, t in pages:
        lines = t.split("\n")
        want |= {(p, len(lines), "page_number"), (p, len(lines) - 1, "running"), (p, len(lines) - 2, "running")} | ({(p, 1, "running")} if 241 <= p < 271 else set())
    assert got == want


def test_words_broken_over_blank_pages(spark):
    rows = [("b", 1, "the officer must implement a decla-", None, "x"), ("b", 2, " ", None, "x"), ("b", 3, "", None, "x"), ("b", 4, None, None, "x"), ("b", 5, "ration under section.", None, "x")]
    lines, text = run(spark, rows)
    assert ("b", 1, 1, "hyphen") in lines and text["b", 1] == "the officer must implement a declaration" and text["b", 5] == "under section."
