import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docloom.llm import tokenizer as tk

pytestmark = pytest.mark.skipif(not os.path.exists(tk.DEFAULT), reason="no vocabulary here")


@pytest.fixture(scope="module")
def both():
    import tiktoken

    ranks = tk.load()
    return tk.Encoder(ranks), tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(text=st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab 'st\n\t  ")), max_size=200))
def test_same_ids_as_the_public_library(both, text):
    own, public = both
    assert own.encode(text) == public.encode_ordinary(text)


def test_long_parts(both):
    own, public = both
    for text in ("a" * 20_000, "ab" * 9_999, " " * 5_000, "漢字" * 3_000, "🗂" * 2_000, "x" + "\n" * 3_000, "<|endoftext|>"):
        assert own.encode(text) == public.encode_ordinary(text)


def test_rows(spark, both):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> Hello"), (3, "again"), (None, "a b"), (5, "word " * 50_000)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    got = sorted(((r.id, list(r.ids)) for r in tk.encode(df, "id", "text").collect()), key=lambda x: (x[0] is None, x))
    want = sorted(((i, both[1].encode_ordinary(t) if t else []) for i, t in rows), key=lambda x: (x[0] is None, x))
    assert got == want
    counted = sorted((r.n_tokens for r in tk.count_tokens(df, ["id"], "text").collect()))
    assert counted == sorted(len(x[1]) for x in want)
    assert tk.encode(df.limit(0), "id", "text").count() == 0
