import random

from docloom.llm import splitting


def check(text, pieces, limit, overlap):
    """Pieces in order; the text again without the overlaps."""
    out = pieces[0]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        n = max(n for n in range(overlap + 1) if piece.startswith(before[len(before) - n :]) and text.startswith(out + piece[n:]))
        out += piece[n:]
    assert out == text
    assert all(0 < len(p) <= limit for p in pieces)


def made(seed):
    r = random.Random(seed)
    out = []
    for _ in range(r.randint(30, 900)):
        out.append("".join(r.choice("abcdéñ漢🗂") for _ in range(r.randint(1, 12))) + r.choice([" ", " ", " ", ". ", ", ", "\n\n", "\f", " \f\n", "! ", "\r\n"]))
    return "".join(out)


def pieces(spark, rows, **options):
    df = spark.createDataFrame(rows, "chunk_id string, text string, page_start int, page_end int, piece_no int")
    out = {}
    for r in splitting.split_texts(df, "chunk_id", "text", "page_start", "page_end", **options).orderBy("piece_no").collect():
        out.setdefault(r.id, []).append(r)
    return out


def test_round_trip_in_small_ranges(spark):
    texts = {f"t{i}": made(i) for i in range(25)}
    got = pieces(spark, [(k, t, 1, 1 + t.count("\f"), 0) for k, t in texts.items()], limit=200, overlap=30, range_size=97)
    for k, t in texts.items():
        t = t.strip(splitting.BLANKS)
        if len(t) > 200:
            check(t, [r.text for r in got[k]], 200, 30)
            assert [r.piece_no for r in got[k]] == list(range(1, len(got[k]) + 1))
            assert got[k][-1].page_end == 1 + t.count("\f") + (len(texts[k]) - len(texts[k].lstrip(splitting.BLANKS)) and texts[k][: len(texts[k]) - len(texts[k].lstrip(splitting.BLANKS))].count("\f"))


def test_ranges_do_not_change_the_pieces(spark):
    rows = [(f"t{i}", made(i), None, None, 0) for i in range(8)]
    a, b = (pieces(spark, rows, limit=150, overlap=20, range_size=s) for s in (64, 10**6))
    assert {k: [r.text for r in v] for k, v in a.items()} == {k: [r.text for r in v] for k, v in b.items()}


def test_natural_ends_and_pages(spark):
    sentence = "word " * 30 + "end. "
    text = sentence * 6 + "\f" + sentence * 6
    got = pieces(spark, [("a", text, 4, 5, 0), ("a", text, 4, 5, 0), ("b", sentence * 12, 7, 9, 0)], limit=1000, overlap=100)
    assert all(r.text.rstrip().endswith("end.") for r in got["a"] + got["b"])
    assert got["a"][0].page_start == 4 and got["a"][-1].page_end == 5 and {r.page_start for r in got["a"]} == {4, 5}
    assert {(r.page_start, r.page_end) for r in got["b"]} == {(7, 9)}


def test_edge_cases(spark):
    rows = [("n", None, 1, 1, 0), ("e", "", 1, 1, 0), ("w", " \f\n" * 3000, 1, 1, 0), ("s", "x" * 2000 + "\n", 1, 1, 0), ("l", "x" * 5000, None, None, 0), (None, "y " * 3000, 1, 1, 0)]
    got = pieces(spark, rows)
    assert list(got) == ["l"]
    assert [len(r.text) for r in got["l"]] == [2000, 2000, 1400]
    assert pieces(spark, []) == {}


def test_files_by_byte_ranges(spark, tmp_path):
    text = made(3) * 3
    (tmp_path / "a.txt").write_bytes(text.encode())
    got = splitting.pieces_of(splitting.file_ranges(spark, [str(tmp_path / "a.txt")], size=301), limit=300, overlap=40).orderBy("piece_no").collect()
    check(text, [r.text for r in got], 300, 40)


def test_long_blanks_at_the_edges_of_ranges(spark, tmp_path):
    r = random.Random(9)
    blank = lambda: "".join(r.choice(" \n\t\r\f") if r.random() < 0.1 else " " for _ in range(r.choice([1, 1, 1, 2, 90, 150, 400])))
    rows = [(f"t{i}", "".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) + r.choice(["", ".", ",", '.")', "A.", " 7."]) + blank() for _ in range(1500)), None, None, 0) for i in range(4)]
    found = [pieces(spark, rows, limit=500, overlap=60, range_size=s) for s in (300, 4096, 65_536)]
    plain = [{k: [x.text for x in v] for k, v in f.items()} for f in found]
    assert plain[0] == plain[1] == plain[2] and len(plain[0]) == 4
    text = rows[0][1]
    (tmp_path / "a.txt").write_bytes(text.encode())
    got = [[x.text for x in splitting.pieces_of(splitting.file_ranges(spark, [str(tmp_path / "a.txt")], size=s), limit=500, overlap=60).orderBy("piece_no").collect()] for s in (301, 10**6)]
    assert got[0] == got[1]


def test_the_last_word_end_is_taken():
    for limit, first in ((2000, 1998), (307, 306)):
        text = "ab " * 3000
        assert splitting.choose(splitting.boundaries("", text, ""), len(text), limit, 20)[0] == (0, first)


def test_a_stream_of_ranges_is_held_for_one_limit_only():
    r = random.Random(2)
    text = "".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) + r.choice([" ", ". ", "\n\n"]) for _ in range(40_000))
    cuts, rows, most = splitting.Cuts(2000, 200), [], 0
    for no, at in enumerate(range(0, len(text), 1000)):
        ends = splitting.boundaries(text[max(0, at - 64) : at], text[at : at + 1000], text[at + 1000 : at + 1064])
        rows += cuts.add(no, ends, len(text[at : at + 1000]), splitting.np.empty(0, splitting.np.int64))
        most = max(most, sum(map(len, cuts.ends)) + len(cuts.ranges))
    rows += cuts.finish()
    whole = splitting.choose(splitting.boundaries("", text, ""), len(text), 2000, 200)
    assert len({x[0] for x in rows}) == len(whole) and most < 3000
    assert sum(x[4] - x[3] for x in rows) == sum(b - a for a, b in whole)
