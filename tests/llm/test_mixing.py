import os
import random

import pytest

from docloom.llm import mixing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer.DEFAULT), reason="no vocabulary here")
DOCS = "doc_id long, text string, lang string, source string, document_type string, s int, n_tokens int"
TARGETS = "source string, weight double, max_repeats int"


def docs(n):
    r = random.Random(1)
    out = []
    for i in range(n):
        source = r.choices(["news", " News", "laws", "notes", None, "other"], [5, 1, 3, 0.2, 0.3, 1])[0]
        out.append((i, " word" * r.randint(1, 60), r.choice(["en", "EN", "fr", None]), source, r.choice(["memo", "rule", None]), 0, 0))
    return out


def test_shares_caps_and_report(spark):
    rows = docs(3000)
    targets = [("news", 2.0, 1), ("LAWS ", 1.0, 3), ("notes", 2.0, 4), ("absent", 1.0, 2), (None, 5.0, 1), ("zero", 0.0, 1), ("news", 9.0, 9)]
    taken, report = mixing.mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    total = sum(len(r[1]) // 5 for r in rows)
    by = {r.source: r for r in report.collect()}
    assert set(by) == {"news", "laws", "notes", "absent"}
    for name, weight in (("news", 2), ("laws", 1)):
        assert abs(by[name].reached_tokens - total / 2 * weight / 6) <= 60 and not by[name].short
    assert by["notes"].short and by["notes"].reached_tokens == 4 * by["notes"].available_tokens
    assert by["absent"].short and by["absent"].reached_tokens == 0
    most = {"news": 1, "laws": 3, "notes": 4}
    got = taken.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(1 <= r.copies <= most[r.source] for r in got)
    again, _ = mixing.mix(spark.createDataFrame(rows[::-1], DOCS), spark.createDataFrame(targets, TARGETS))
    assert {(r.doc_id, r.copies) for r in again.collect()} == {(r.doc_id, r.copies) for r in got}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    taken, report = mixing.mix(none, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert taken.count() == 0 and [r.reached_tokens for r in report.collect()] == [0]
    taken, report = mixing.mix(spark.createDataFrame(docs(20), DOCS), spark.createDataFrame([], TARGETS))
    assert taken.count() == 0 and report.count() == 0
