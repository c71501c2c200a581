import html
import random
import re
from datetime import date  # noqa: F401
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions import text as tx
from docloom.functions import values as v
from docloom.functions import vectors as vec


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], T.StructType([T.StructField(k, T.StringType()) for k in values])) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_broken_words_and_white_space(spark):
    norm = lambda t: one(spark, tx.normalize_text("t"), t=t)
    assert norm("immi-\ngration") == "immigration" and norm("é-\nb") == "éb"
    assert norm("a-\r\nb") == "a- b" and norm(None) == "" and norm("  a\t b\n") == "a b"
    tokens = lambda t: one(spark, tx.filter_tokens(tx.tokenize("t")), t=t)
    assert tokens("The Immi-\ngration café, not I 9 42!") == ["immigration", "caf", "not", "42"]
    assert tokens("") == [] and tokens(None) == []


def test_clean_text(spark):
    text = "Line one wrapped\nline continues\n\n\nNew para here\nstill para\x07"
    assert one(spark, tx.clean_text("t"), t=text) == "Line one wrapped line continuesNew para here still para"
    assert one(spark, tx.clean_text("t", True), t=text) == "Line one wrapped line continues\n\nNew para here still para"
    assert one(spark, tx.clean_text("t"), t="x Federal Register / Vol. 9, No 1 / Rules and Regulations y") == "x y"


def test_units(spark):
    assert one(spark, tx.split_units("t"), t="One. Two? Three\n\nFour!  Five") == ["One.", "Two?", "Three", "Four!", "Five"]
    parts = one(spark, tx.split_oversized("t", 100, 50), t="A" * 260)
    assert [len(p) for p in parts] == [50, 50, 50, 50, 50, 10]
    assert one(spark, tx.split_oversized("t", 10, 5), t="aaa, bbb; cccccccccccc\n\ndd") == ["aaa,", "bbb;", "ccccc", "ccccc", "cc", "dd"]
    assert one(spark, tx.summary_paragraphs("t"), t=" a \n\n\n\n b") == ["a\n\nb"]
    assert one(spark, tx.summary_paragraphs("t"), t="a\n\n" + "b" * 1501) == ["a", "b" * 1501]
    assert one(spark, tx.summary_paragraphs("t"), t=None) == []


def test_html(spark):
    html = "<p>A &lt;b&gt; <br/>c</p><ul><li>x</li><li>y</li></ul><script>z</script>"
    assert one(spark, tx.html_to_text("t"), t=html) == "A \nc\n\n- x\n- y\n\nz".replace("A \n", "A\n")
    assert one(spark, tx.html_to_text("t"), t="caf&eacute; &amp;lt; it&#8217;s &#x41;&copy;") == "café &lt; it’s A©"


def plain_html(s):
    """The rule read step by step."""
    s = html.unescape((s or "").strip())
    for rule, by in ((r"<\s*br\s*/?\s*>", "\n"), (r"</\s*(p|div)\s*>", "\n\n"), (r"<\s*(p|div|ul|ol)(\s+[^>]*)?\s*>", ""), (r"<\s*li(\s+[^>]*)?\s*>", "- "), (r"</\s*(li|ul|ol)\s*>", "\n"), ("<[^>]+>", ""), ("\r\n?", "\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n")):
        s = re.sub(rule, by, s, flags=re.I)
    return s.strip()


def test_html_equals_the_rule(spark):
    r = random.Random(4)
    parts = ["<p>", "</p>", "<P class='x'>", "<br>", "< BR / >", "<br/>", "</br>", "<pre>", "</ div >", "<div >", "<li>", "</li>", "<ul>", "</ol>", "<link>", "<a href='y'>", "</a>", "< p>", "a", "b c", " ", "  ", "\t", "\n", "\r\n", "\r", "&lt;p&gt;", "&amp;", "&nbsp;", "&#233;", "&bogus;", "<", ">", "1 < 2", "<!-- x -->"]
    texts = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(1500)] + [(9999, None)]
    got = spark.createDataFrame(texts, "i int, t string").select("i", tx.html_to_text("t").alias("x")).collect()
    wrong = [(texts[x.i][1], x.x) for x in got if x.i < 1500 and x.x != plain_html(texts[x.i][1])]
    assert not wrong, wrong[:3]


def test_short_forms(spark):
    assert one(spark, tx.shorten("t", 5), t="ab  cdefg") == "ab c…" and one(spark, tx.shorten("t", 5), t="abcde") == "abcde"
    assert one(spark, tx.slug("t"), t=" A b/c -- D! ") == "a-bc-d" and one(spark, tx.slug("t"), t="§") == "untitled"
    assert one(spark, tx.query_slug("t"), t="Asylum: policy?") == "asylum_policy" and one(spark, tx.query_slug("t"), t=None) == "query"
    assert len(one(spark, tx.truncate_error("t"), t="x" * 900)) == 800


@pytest.mark.parametrize(("given", "want"), [(None, 0), ("2025", 0), ("2025-08-21", 20250821), ("2025-13-45", 20251345), ("abcd-ef-gh", 0), (" 2025/08/21T1 ", 20250821)])
def test_date_to_int(spark, given, want):
    assert one(spark, v.date_to_int("t"), t=given) == want


def test_hashes(spark):
    assert [one(spark, v.stable_shard("t"), t=t) for t in ("except", "pell", "impoundment")] == [43, 43, 43]
    assert one(spark, v.blake2b_64(F.col("t")), t="x") == __import__("hashlib").blake2b(b"x", digest_size=8).hexdigest()
    assert one(spark, v.short_hash("t"), t="a") == "86f7e437fa"


def test_sanitize(spark):
    for given, want in ((" NAN ", None), ("\nNaN\t", None), ("", ""), (" ", " "), ("banana", "banana"), ("none", "none"), ("NaNd", "NaNd")):
        assert one(spark, v.clean_null("t"), t=given) == want
    kind = T.StructType([T.StructField("a", T.ArrayType(T.DoubleType())), T.StructField("d", T.DecimalType(5, 2)), T.StructField("s", T.StructType([T.StructField("t", T.StringType())]))])
    df = spark.createDataFrame([(([1.0, float("nan")], Decimal("1.25"), ("nan",)),)], T.StructType([T.StructField("r", kind)]))
    got = df.select(v.sanitize(F.col("r"), kind).alias("r")).first().r
    assert got.a == [1.0, None] and got.d == 1.25 and got.s.t is None
    with pytest.raises(Exception, match="infinite"):
        spark.createDataFrame([(float("inf"),)], "x double").select(v.sanitize(F.col("x"), T.DoubleType())).collect()


def test_json(spark):
    assert one(spark, v.json_array("t"), t='["a","b"]') == ["a", "b"] and one(spark, v.json_array("t"), t=None) == [] and one(spark, v.json_array("t"), t="") == []
    raw = '[{"type":"related_policy","value":12},{"type":"x","value":3}]'
    assert one(spark, v.related_ids("t"), t=raw) == [12] and one(spark, v.related_ids("t", False), t=raw) == [12, 3]


def test_paths(spark):
    assert one(spark, v.s3_bucket("t"), t="s3://b/k/x.pdf") == "b" and one(spark, v.s3_key("t"), t="s3://b/k/x.pdf") == "k/x.pdf" and one(spark, v.s3_key("t"), t="file") is None
    assert one(spark, v.is_pdf_path("t"), t="A.PDF") and not one(spark, v.is_pdf_path("t"), t=None)
    name = one(spark, v.attachment_name(F.lit("New Policy"), F.lit(7), F.lit("The title"), F.col("t")), t="media/a.pdf")
    assert name.startswith("new-policy__7__the-title__") and name.endswith(".pdf")


def test_nested_policy(spark):
    row = [(1, None, "slug-1", "2020-01-01", None, None, ([("", "dos"), ("DHS", "dhs")], []))]
    kind = "page_ptr_id long, title string, slug string, announced_date string, effective_date string, administration string, filters struct<agencies:array<struct<agency:string,agency_slug:string>>,subject_matter:array<struct<title:string,slug:string>>>"
    flat = spark.createDataFrame(row, kind).select(v.flatten_policy(F.struct("*")).alias("m")).first().m
    assert (flat.iptp_id, flat.title, flat.agencies_affected, flat.subject_matter) == ("1", "slug-1", ["dos", "DHS"], None)


def test_skip(spark):
    rows = [(None, 5), (5, 5), (4, 5), (1, None), (0, None)]
    df = spark.createDataFrame(rows, "size long, want long")
    assert [r.x for r in df.select(v.skip_download(F.col("size"), F.col("want"), True).alias("x")).collect()] == [False, True, False, True, False]
    assert not any(r.x for r in df.select(v.skip_download(F.col("size"), F.col("want"), False).alias("x")).collect())


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "a array<float>, b array<float>, t array<array<float>>, m array<int>")
    r = df.select(vec.norm(F.col("a")).alias("n"), vec.l2_normalize(F.col("a")).alias("u"), vec.similarity(F.col("a"), F.col("b"), "ip").alias("ip"), vec.similarity(F.col("a"), F.col("b"), "l2").alias("l2"), vec.mean_pool(F.col("t"), F.col("m")).alias("p"), vec.first_pool(F.col("t")).alias("f")).first()
    assert (r.n, r.u, r.ip, r.l2, r.p, r.f) == (5.0, [0.6, 0.8], 3.0, -20.0, [2.0, 3.0], [1.0, 2.0])
