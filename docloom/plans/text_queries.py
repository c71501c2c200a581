"""Queries of the text, date, hash and JSON functions and of chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import values as v
from docloom.operators import bm25, chunking, evaluation, ranking, relational
from docloom.plans.registry import Registry, table

registry = Registry()
add = registry.add

STOP = "[" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + "]"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '(\w)-\n(\w)', '\1\2', 'g'), '[\s\x0b\x1c-\x1f\x85\xa0\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))"


def tokens_sql(c: str) -> str:
    return f"regexp_extract_all(lower({norm_sql(c)}), '[a-z0-9]+')"


def kept_sql(c: str) -> str:
    return f"list_filter({tokens_sql(c)}, lambda t: length(t) >= 2 and not list_contains({STOP}, t))"


DOC_TERMS = f"toks as (select doc_id, {kept_sql('text')} as k from documents), post as (select term, doc_id, len(k) as dl, count(*) as tf from (select doc_id, k, unnest(k) as term from toks where len(k) > 0 and len(list_distinct(k)) <= 50000) group by all)"
SPACE = r"[ \t\r\n\f]"
ONCE = "(select * exclude (rn) from (select *, row_number() over (partition by chunk_id order by ingested_at) as rn from chunk_records where chunk_id is not null) where rn = 1)"


def chunks_once(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_records with each id once, the first that was loaded."""
    return ranking.first_rows(table(spark, sf, "chunk_records").where("chunk_id is not null"), ["chunk_id"], ["ingested_at"])


@add(f"select doc_id, len({tokens_sql('text')})::bigint as n_tokens, len({kept_sql('text')})::bigint as n_kept from documents")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tx.tokenize("text")
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(tx.filter_tokens(tokens)).cast("long").alias("n_kept"))


@add(f"select doc_id, {norm_sql('text')} as text from documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.normalize_text("text").alias("text"))


@add(f"with {DOC_TERMS} select doc_id, term, tf::int as tf from post")
def term_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.postings_of(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "term", "tf")


@add(f"with {DOC_TERMS}, n as (select count(distinct doc_id) as n from post) select term, count(*) as df, round(ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)), 9) as idf from post, n group by term, n")
def df_idf(spark: SparkSession, sf: str) -> DataFrame:
    index = bm25.build_index(table(spark, sf, "documents"), "doc_id", "text")
    return index.terms.select("term", "df", F.round("idf", 9).alias("idf"))


@add(f"with {DOC_TERMS} select doc_id, sum(tf)::bigint as dl from post group by doc_id")
def doc_len(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.document_terms(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", F.col("dl").cast("long").alias("dl"))


@add(f"with {DOC_TERMS}, d as (select doc_id, any_value(dl) as dl from post group by doc_id) select count(*) as n_docs, sum(dl)::bigint as total_len, round(avg(dl), 6) as avgdl, (select count(distinct term) from post) as n_terms from d")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    terms = bm25.postings_of(docs, "doc_id", "text").select("term").distinct().agg(F.count("*").alias("n_terms"))
    return bm25.corpus_stats(docs, "doc_id", "text").withColumn("avgdl", F.round("avgdl", 6)).join(terms)


@add(f"with {DOC_TERMS} select term, count(*) as df, string_agg(doc_id || ':' || tf, ' ' order by doc_id) as postings from post group by term")
def postings_list(spark: SparkSession, sf: str) -> DataFrame:
    lists = bm25.posting_lists(bm25.postings_of(table(spark, sf, "documents"), "doc_id", "text"))
    return lists.select("term", "df", F.array_join(F.transform("postings", lambda p: F.concat_ws(":", p["doc_id"], p["tf"])), " ").alias("postings"))


@add(f"with {DOC_TERMS} select distinct term, ((('0x' || left(md5(term), 8))::bigint) % 128)::int as shard from post")
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.postings_of(table(spark, sf, "documents"), "doc_id", "text").select("term").distinct().select("term", v.stable_shard("term").alias("shard"))


@add(f"select chunk_id, row_number() over (order by chunk_id) - 1 as doc_id from {ONCE} where len({kept_sql('text')}) > 0")
def dense_doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    kept = chunks_once(spark, sf).where(F.size(tx.filter_tokens(tx.tokenize("text"))) > 0)
    return bm25.dense_ids(kept.select("chunk_id"), ["chunk_id"])


CLEAN = r"replace(replace(coalesce(text, ''), chr(13), chr(10)), chr(9), ' ')"
for _p, _r in (
    (r"([0-9A-Za-z_\p{L}\p{N}])-\n([0-9A-Za-z_\p{L}\p{N}])", r"\1\2"), (" +", " "), (r"\n{3,}", r"\n\n"), (r"\n\n", "\x01"), (r"\n", " "), ("\x01", r"\n\n"),
    (r"(?i)\bFederal Register\s*/\s*Vol\.\s*\d+.*?Rules and Regulations\b", ""), (r"(?i)\bVerDate\b.*?\bJkt\b|\bE:\\FR\\FM\\b", ""), ("[ ]+", " "), (r"[\x00-\x1f\x7f-\x{9f}]", ""), (r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""),
):
    CLEAN = f"regexp_replace({CLEAN}, '{_p}', '{_r}', 'g')".replace(r"'\n\n')", "chr(10) || chr(10))").replace(r"'\n\n', 'g')", "chr(10) || chr(10), 'g')")


@add(f"select stable_id, page_num, extracted_at, {CLEAN} as clean from page_records")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "page_records").select("stable_id", "page_num", "extracted_at", tx.clean_text("text").alias("clean"))


@add("select chunk_id, ingested_at, " + " or ".join(f"contains(lower(coalesce(text, '')), '{p}')" for p in tx.BOILERPLATE) + " as boilerplate from chunk_records")
def boilerplate_flag(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_records").select("chunk_id", "ingested_at", tx.is_boilerplate(F.coalesce("text", F.lit(""))).alias("boilerplate"))


# the markup of the documents has paragraphs, marks in angle brackets and no entities
HTML = "coalesce(text, '')"
for _p, _r in ((r"(?i)<\s*br\s*/?\s*>", "chr(10)"), (r"(?i)</\s*(p|div)\s*>", "chr(10) || chr(10)"), (r"(?i)<\s*li(\s+[^>]*)?\s*>", "'- '"), (r"(?i)</\s*(li|ul|ol)\s*>", "chr(10)"), ("<[^>]+>", "''"), (r"\r\n?", "chr(10)"), (r"[ \t]+\n", "chr(10)"), (r"\n[ \t]+", "chr(10)"), (r"[ \t]{2,}", "' '"), (r"\n{3,}", "chr(10) || chr(10)")):
    HTML = f"regexp_replace({HTML}, '{_p}', {_r}, 'g')"


@add(rf"select doc_id, regexp_replace({HTML}, '^[\s\p{{Z}}\x0b\x85]+|[\s\p{{Z}}\x0b\x85]+$', '', 'g') as plain from documents")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.html_to_text("text").alias("plain"))


def _shorten_sql(c: str, n: int) -> str:
    flat = rf"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}\x0b\x85]+', ' ', 'g'))"
    return f"case when length({flat}) <= {n} then {flat} else left({flat}, {n - 1}) || '…' end"


@add(f"select chunk_id, ingested_at, {_shorten_sql('text', 220)} as snippet, {_shorten_sql('text', 75)} as excerpt from chunk_records")
def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_records").select("chunk_id", "ingested_at", tx.shorten("text", 220).alias("snippet"), tx.shorten("text", 75).alias("excerpt"))


@add("select doc_id, announced_date, case when length(trim(announced_date)) >= 10 then coalesce(try_cast(substr(trim(announced_date), 1, 4) as int) * 10000 + try_cast(substr(trim(announced_date), 6, 2) as int) * 100 + try_cast(substr(trim(announced_date), 9, 2) as int), 0) else 0 end::int as day from documents")
def date_int(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "announced_date", v.date_to_int("announced_date").alias("day"))


def _slug_sql(c: str, n: int) -> str:
    out = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '\s+', '-', 'g'), '[^a-z0-9_-]+', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"left(case when {out} = '' then 'untitled' else {out} end, {n})"


@add(f"select page_ptr_id, title, {_slug_sql('title', 80)} as slug, page_ptr_id || '__' || {_slug_sql('title', 80)} as folder, left(sha1(title), 10) as hash from policies")
def slug_and_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "policies").select("page_ptr_id", "title", tx.slug("title").alias("slug"), v.folder_name(F.col("page_ptr_id"), F.col("title")).alias("folder"), v.short_hash("title").alias("hash"))


@add("select query_id, left(case when s = '' then 'query' else s end, 80) as slug from (select query_id, regexp_replace(regexp_replace(lower(coalesce(query, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as s from search_queries)")
def query_slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_queries").select("query_id", tx.query_slug("query").alias("slug"))


@add("select chunk_id, ingested_at, case source_type when 'policy_title' then 'title' when 'policy_summary' then 'summary' else 'pdf' end as label from chunk_records")
def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_records").select("chunk_id", "ingested_at", tx.source_label("source_type").alias("label"))


@add(f"select chunk_id, i::int as i, w as piece from (select chunk_id, unnest(list_filter(list_transform(range(0, length(text), 800), lambda i: regexp_replace(substr(text, i + 1, 800), '^[\\s\\p{{Z}}\\x0b\\x85]+|[\\s\\p{{Z}}\\x0b\\x85]+$', '', 'g')), lambda w: w <> '')) as w, generate_subscripts(list_filter(list_transform(range(0, length(text), 800), lambda i: regexp_replace(substr(text, i + 1, 800), '^[\\s\\p{{Z}}\\x0b\\x85]+|[\\s\\p{{Z}}\\x0b\\x85]+$', '', 'g')), lambda w: w <> ''), 1) - 1 as i from {ONCE} where text is not null)")
def hard_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_once(spark, sf).where("text is not null").select("chunk_id", F.posexplode(tx.windows_of(F.col("text"), 800)).alias("i", "piece"))


_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}\x0b\x85]+|[\s\p{{Z}}\x0b\x85]+$', '', 'g')"
_CLEAN_KEPT = CLEAN.replace(r"[\x00-\x1f\x7f-\x{9f}]", r"[\x00-\x09\x0b-\x1f\x7f-\x{9f}]")


def _pieces_sql(of: str, parts: str, then: str) -> str:
    """``then`` over the trimmed parts, without empty ones, of each text of a list."""
    return f"flatten(list_transform({of}, lambda u: list_transform(list_filter(list_transform({parts}, lambda x: {_STRIP.format('x')}), lambda x: x <> ''), lambda x: {then})))"


_SENTENCES = _pieces_sql(_pieces_sql(f"[{_CLEAN_KEPT}]", "string_split(u, chr(10) || chr(10))", "x"), r"string_split(regexp_replace(u, '([.?!])[ \t]+', '\1' || chr(1), 'g'), chr(1))", "x")
_CLAUSES = _pieces_sql(_SENTENCES, r"case when length(u) <= 2000 then [u] else string_split(regexp_replace(u, '([;:,)])[\s\p{Z}\x0b\x85]+', '\1' || chr(1), 'g'), chr(1)) end", "x")
_UNITS = _pieces_sql(_CLAUSES, "case when length(u) <= 2000 then [u] else list_transform(range(0, length(u), 800), lambda i: substr(u, i + 1, 800)) end", "x")


@add(f"select stable_id, page_num, extracted_at, (i - 1)::int as i, units[i] as unit from (select *, unnest(range(1, len(units) + 1)) as i from (select stable_id, page_num, extracted_at, {_UNITS} as units from page_records))")
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    units = F.flatten(F.transform(tx.split_units(tx.clean_text("text", preserve_paragraphs=True)), lambda u: tx.split_oversized(u)))
    return table(spark, sf, "page_records").select("stable_id", "page_num", "extracted_at", F.posexplode(units).alias("i", "unit"))


@add(f"select doc_id, (i - 1)::int as i, units[i] as unit from (select *, unnest(range(1, len(units) + 1)) as i from (select doc_id, {_UNITS.replace('2000', '120').replace('800', '50')} as units from documents))")
def oversized_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units of documents with so small a limit that clauses and fixed windows are needed."""
    units = F.flatten(F.transform(tx.split_units(tx.clean_text("text", preserve_paragraphs=True)), lambda u: tx.split_oversized(u, 120, 50)))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(units).alias("i", "unit"))


PARTS = r"list_filter(list_transform(string_split(coalesce(description_text, ''), chr(10) || chr(10)), lambda p: regexp_replace(p, '^[\s\p{Z}\x0b\x85]+|[\s\p{Z}\x0b\x85]+$', '', 'g')), lambda p: p <> '')"


@add(f"select page_ptr_id, unnest(case when len({PARTS}) = 0 then []::varchar[] when len(list_filter({PARTS}, lambda p: length(p) > 1500)) > 0 then {PARTS} else [array_to_string({PARTS}, chr(10) || chr(10))] end) as part from policies")
def summary_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "policies").select("page_ptr_id", F.explode(tx.summary_paragraphs("description_text")).alias("part"))


_N = r"length(regexp_replace(coalesce(text, ''), '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g'))"


@add(f"select stable_id, count(*) as pages, sum({_N})::bigint as total_chars, floor(median({_N}))::bigint as median_chars, round(avg(case when {_N} < 30 then 1.0 else 0.0 end), 6) as short_share from page_records group by stable_id")
def page_stats(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.page_stats(table(spark, sf, "page_records")).withColumn("short_share", F.round("short_share", 6))


@add(f"select stable_id, avg(case when {_N} < 30 then 1.0 else 0.0 end) >= 0.8 as scanned from page_records group by stable_id")
def scanned_flag(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.scanned(table(spark, sf, "page_records"))


_SET = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'))"
PAIRS = f"(select page_ptr_id, policydocument_id, chunk_id as id, next_id, round(case when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / len(a) end, 6) as overlap from (select page_ptr_id, policydocument_id, chunk_id, lead(chunk_id) over w as next_id, {_SET.format('text')} as a, lead({_SET.format('text')}) over w as b from {ONCE} where source_type = 'pdf_page' window w as (partition by page_ptr_id, policydocument_id order by page_start, page_end, chunk_id)) where next_id is not null)"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.overlaps(chunks_once(spark, sf).where("source_type = 'pdf_page'"), ["page_ptr_id", "policydocument_id"], ["page_start", "page_end", "chunk_id"])


@add(f"select * from {PAIRS}")
def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@add(
    f"with p as {PAIRS}, s as (select list(overlap order by overlap) as v, count(*) as pairs, round(avg(overlap), 6) as mean, round(median(overlap), 6) as median, round(avg(case when overlap >= 0.1 then 1.0 else 0.0 end), 6) as share from p) select pairs, mean, median, share, "
    + ", ".join(f"v[round_even({p} * (pairs - 1) / 100.0, 0)::bigint + 1] as p{p}" for p in (10, 25, 75, 90))
    + " from s"
)
def overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.overlap_summary(_pairs(spark, sf))


@add(f"with p as {PAIRS} select *, 'least' as \"end\" from (select * from p order by overlap, id limit 10) union all select *, 'most' from (select * from p order by overlap desc, id limit 10)")
def overlap_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.extreme_pairs(_pairs(spark, sf))


@add("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@add("select query_id, doc_id, loaded_at, case when isnan(score) then null else score end as score, case when lower(trim(announced_date)) = 'nan' then null else announced_date end as announced_date from search_results")
def sanitize_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "search_results").select("query_id", "doc_id", "loaded_at", v.clean_null("score", "double").alias("score"), v.clean_null("announced_date").alias("announced_date"))


_DESCRIBED = "(select page_ptr_id, min(description_text) as description from policies group by page_ptr_id)"


@add(f"select doc_id, round(case when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / len(a) end, 6) as of_policy, round(case when len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(b) end, 6) as of_document from (select doc_id, {_SET.format('description')} as a, {_SET.format('text')} as b from documents join {_DESCRIBED} using (page_ptr_id))")
def word_containment(spark: SparkSession, sf: str) -> DataFrame:
    """How much of its policy's description a document has, and the other way round."""
    described = table(spark, sf, "policies").groupBy("page_ptr_id").agg(F.min("description_text").alias("description"))
    sets = table(spark, sf, "documents").join(described, "page_ptr_id").select("doc_id", tx.word_set("description").alias("a"), tx.word_set("text").alias("b"))
    return sets.select("doc_id", F.round(tx.containment(F.col("a"), F.col("b")), 6).alias("of_policy"), F.round(tx.containment(F.col("b"), F.col("a")), 6).alias("of_document"))


@add(
    """select page_ptr_id, page_ptr_id::varchar as iptp_id, coalesce(nullif(title, ''), slug) as title, announced_date, effective_date, administration,
    case when len(list_filter(agencies_affected, lambda x: x <> '')) > 0 then list_filter(agencies_affected, lambda x: x <> '') end as agencies_affected,
    case when len(list_filter(subject_matter, lambda x: x <> '')) > 0 then list_filter(subject_matter, lambda x: x <> '') end as subject_matter,
    list_sort(list_distinct(subject_matter)) as subjects, current_status.title as status, current_status is not null and (current_status.title is not null or current_status.slug is not null) as has_status from policies"""
)
def policy_meta(spark: SparkSession, sf: str) -> DataFrame:
    """The flat metadata of nested policy records, their status and sorted subjects."""
    named = lambda c, a, b: F.transform(c, lambda x: F.struct(x.alias(a), F.lit(None).cast("string").alias(b)))
    filters = F.struct(named("agencies_affected", "agency", "agency_slug").alias("agencies"), named("subject_matter", "title", "slug").alias("subject_matter"))
    nested = table(spark, sf, "policies").withColumn("filters", filters)
    record = F.struct("page_ptr_id", "title", "slug", "announced_date", "effective_date", "administration", "filters")
    status = v.status_struct(F.col("current_status.title"), F.col("current_status.slug"))
    rows = nested.select("page_ptr_id", v.sorted_set("subject_matter").alias("subjects"), status.alias("s"), record.alias("r"))
    return rows.select("page_ptr_id", "subjects", F.col("s.title").alias("status"), F.col("s").isNotNull().alias("has_status"), v.flatten_policy(F.col("r")).alias("m")).select("*", "m.*").drop("m")


@add("select chunk_id, ingested_at, meta_flat.iptp_id as iptp_id, meta_flat.title as title, meta_flat.announced_date as original_date_announced, meta_flat.agencies_affected as agencies_affected from chunk_records")
def minimal_meta(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "chunk_records")
    kept = v.minimal_meta(F.col("meta_flat"), df.schema["meta_flat"].dataType, ["iptp_id", "title", "original_date_announced", "agencies_affected"], {"original_date_announced": "announced_date"})
    return df.select("chunk_id", "ingested_at", kept.alias("m")).select("chunk_id", "ingested_at", "m.*")


@add("select type, count(*) as \"rows\" from (select case when page_ptr_id is null or policydocument_id is null or text is null then 'SKIP_BAD_RECORD' when page_num is null then 'SKIP_BAD_PAGE_NUM' when page_num < 1 then 'SKIP_NONPOSITIVE_PAGE_NUM' end as type from page_records) where type is not null group by type")
def page_audit(spark: SparkSession, sf: str) -> DataFrame:
    return relational.audit_counts(relational.valid_pages(table(spark, sf, "page_records"))[1])


@add(r"select type, count(*) as ""rows"" from (select case when chunk_id is null then 'SKIP_MISSING_CHUNK_ID' when regexp_replace(coalesce(text, ''), '[ \t\r\n\f]+', '', 'g') = '' then 'SKIP_EMPTY_TEXT' end as type from chunk_records) where type is not null group by type".replace('""', '"'))
def chunk_audit(spark: SparkSession, sf: str) -> DataFrame:
    return relational.audit_counts(relational.valid_chunks(table(spark, sf, "chunk_records"))[1])


def _clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    good = relational.valid_pages(table(spark, sf, "page_records"))[0]
    return ranking.first_rows(good, ["stable_id", "page_num"], ["extracted_at"])


@add()
def pdf_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.pdf_chunks(_clean_pages(spark, sf))


@add("select page_ptr_id::varchar || '_ttl_h' as id, page_ptr_id::varchar as page_ptr_id, 'policy_title' as source_type, regexp_replace(title, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g') as text, 16 as digits from policies where trim(title) <> ''")
def title_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every policy row with a title; SQL has no BLAKE2b, so of an id's digest it sees the length only."""
    digest = F.regexp_extract("chunk_id", "_h([0-9a-f]+)$", 1)
    return chunking.title_chunks(table(spark, sf, "policies")).select(F.regexp_replace("chunk_id", "_h[0-9a-f]+$", "_h").alias("id"), "page_ptr_id", "source_type", "text", F.length(digest).alias("digits"))


@add()
def all_chunks(spark: SparkSession, sf: str) -> DataFrame:
    policies = ranking.first_rows(table(spark, sf, "policies"), ["page_ptr_id"], ["slug"])
    files = _clean_pages(spark, sf).select("page_ptr_id", "policydocument_id", "document_type", "file_title")
    files = ranking.first_rows(files, ["page_ptr_id", "policydocument_id"], ["document_type", "file_title"])
    return chunking.with_meta(chunking.all_chunks(policies, _clean_pages(spark, sf)), policies, files)


@add("select page_ptr_id, policydocument_id, count(*) as pages from page_records group by all having count(*) > 50")
def large_attachments(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.large_attachments(table(spark, sf, "page_records"), 50)
