import random

from docloom.llm import reading_level as rl

EASY = "dog cat sun run hat big red top milk road tree play book".split()
HARD = "jurisdictional extraterritoriality reauthorization proportionality interlocutory certiorari adjudication promulgation".split()


def text(r, band):
    out = []
    for _ in range(12):
        share, n = {1: (0, 4), 2: (0.02, 8), 3: (0.08, 14), 4: (0.25, 18), 5: (0.5, 26)}[band]
        out.append("The " + " ".join(r.choice(["of", "to", "and", "is", "the"]) if r.random() < 0.4 else r.choice(HARD if r.random() < share * 1.7 else EASY) for _ in range(n)) + ".")
    return " ".join(out)


def test_bands_are_learnt(spark):
    r = random.Random(2)
    docs = [(i, text(r, 1 + i % 5), "fr" if i % 3 else None) for i in range(500)]
    labels = [(i, f"r{j}", max(1, min(5, 1 + i % 5 + (r.random() < 0.1)))) for i in range(0, 500, 2) for j in range(2)] + [(4, "x", None)]
    docs += [(900, None, "en"), (901, "", "en"), (902, "🗂 123", "en"), (903, "Los perros de la casa y el gato que no es un perro. " * 5, "en"), (904, " ".join(text(r, 5) for _ in range(150)), "en"), (4, docs[4][1], "en")]
    got = {}
    for x in rl.reading_levels(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, rater string, band int")).collect():
        got.setdefault(x.doc_id, []).append(x)
    held_out = [i for i in range(1, 500, 2)]
    right = sum(got[i][0].band == 1 + i % 5 for i in held_out)
    assert right >= 0.85 * len(held_out)
    assert all(abs(got[i][0].band - (1 + i % 5)) <= 1 for i in held_out)
    assert len(got[4]) == 2 and got[4][0].band == got[4][1].band
    assert [got[i][0].band for i in (900, 901, 902, 903)] == [None] * 4 and got[904][0].band == 5


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, rater string, band int")
    docs = spark.createDataFrame([(1, "The dog is in the sun.")], "doc_id long, text string")
    assert [x.band for x in rl.reading_levels(docs, none).collect()] == [None]
    assert rl.reading_levels(docs.limit(0), none).count() == 0


def test_markup_and_abbreviations():
    words, length = rl.words_and_length("<p>The R.C.F. 12 of t​he of&#64257;ce.</p> Next one!")
    assert words[:2] == ["the", "r"] and "office" in words and "the" in words[3:]
