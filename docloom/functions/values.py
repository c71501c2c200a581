"""Dates, hashes, JSON and nested records as column expressions."""

from __future__ import annotations

import hashlib
import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import slug


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_to_int(c: Column | str) -> Column:
    """yyyymmdd by position, 0 where that can't be read; neither separators nor the calendar are checked."""
    d = F.btrim(_column(c))
    part = lambda i, n: F.substring(d, i, n).try_cast("int")
    return F.coalesce(F.when(F.length(d) >= 10, part(1, 4) * 10000 + part(6, 2) * 100 + part(9, 2)), F.lit(0))


def short_hash(c: Column | str, n: int = 10) -> Column:
    return F.substring(F.sha1(_column(c)), 1, n)


def stable_shard(c: Column | str, shards: int = 128) -> Column:
    """The first four bytes of the md5, big-endian, modulo the number of shards."""
    return (F.conv(F.substring(F.md5(_column(c)), 1, 8), 16, 10).cast("long") % shards).cast("int")


@F.pandas_udf(T.StringType())
def blake2b_64(payload: pd.Series) -> pd.Series:
    """BLAKE2b with eight bytes, in hex; Spark has no built-in."""
    return payload.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())


def chunk_hash(kind: str, page_ptr_id: Column, document_id: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    flat = F.btrim(F.regexp_replace(text, "[ \t]+", " "))
    return blake2b_64(F.concat_ws("|", F.lit(kind), page_ptr_id, F.coalesce(document_id, F.lit("")), page_start.cast("string"), page_end.cast("string"), flat))


def summary_hash(kind: str, page_ptr_id: Column, paragraph: Column, text: Column) -> Column:
    flat = F.btrim(F.regexp_replace(text, "[ \t]+", " "))
    return blake2b_64(F.concat_ws("|", F.lit(kind), page_ptr_id, paragraph.cast("string"), flat))


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """All entities of HTML."""
    return text.map(lambda x: None if x is None else html.unescape(x))


def folder_name(page_ptr_id: Column, title: Column) -> Column:
    return F.concat(page_ptr_id.cast("string"), F.lit("__"), slug(title, 80))


def attachment_name(document_type: Column, document_id: Column, title: Column, key: Column) -> Column:
    """``{type}__{id}__{title}__{hash}{extension}``."""
    extension = F.regexp_extract(key, r"(\.[^./]+)$", 1)
    return F.concat(F.concat_ws("__", slug(document_type, 40), document_id.cast("string"), slug(title, 80), short_hash(key)), extension)


def is_pdf_path(c: Column | str) -> Column:
    return F.coalesce(F.lower(_column(c)).like("%.pdf"), F.lit(False))


def s3_bucket(uri: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_column(uri), r"^s3://([^/]+)/?(.*)$", 1), F.lit(""))


def s3_key(uri: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_column(uri), r"^s3://([^/]+)/?(.*)$", 2), F.lit(""))


def clean_null(c: Column | str, kind: str = "string") -> Column:
    """Null for the string "nan" in any case and with outer spaces, and for NaN; the empty string stays."""
    v = _column(c)
    if kind in ("double", "float"):
        return F.when(~F.isnan(v), v)
    return F.when(F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")) != "nan", v)


def sanitize(c: Column, kind: T.DataType) -> Column:
    """The same for a column of any type, down to the fields of nested ones; decimals become doubles.

    An infinite number fails the query: JSON has none.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        infinite = F.abs(c) == F.lit(float("inf"))
        return F.when(~F.isnan(c) & infinite, F.raise_error("infinite number").cast(kind)).when(~F.isnan(c), c)
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, T.StringType):
        return clean_null(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sanitize(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: sanitize(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(sanitize(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def sorted_set(c: Column | str) -> Column:
    return F.array_sort(F.array_distinct(_column(c)))


def json_array(c: Column | str, element: str = "string") -> Column:
    """A JSON array, or the empty array for null, empty and unreadable text."""
    return F.coalesce(F.from_json(F.nullif(F.btrim(_column(c)), F.lit("")), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def related_ids(c: Column | str, strict: bool = True) -> Column:
    """Ids of the blocks of type related_policy; leniently any number after "value"."""
    if not strict:
        return F.transform(F.regexp_extract_all(_column(c), F.lit(r'"value"\s*:\s*(\d+)'), F.lit(1)), lambda x: x.try_cast("long"))
    blocks = json_array(c, "struct<type:string,value:string>")
    found = F.transform(F.filter(blocks, lambda b: b["type"] == "related_policy"), lambda b: b["value"].try_cast("long"))
    return F.filter(found, lambda x: x.isNotNull())


def status_struct(title: Column, slug_of: Column) -> Column:
    """Null if neither part is known."""
    return F.when(title.isNotNull() | slug_of.isNotNull(), F.struct(title.alias("title"), slug_of.alias("slug")))


def labels(items: Column, first: str, second: str) -> Column:
    """First non-empty of two fields of each struct; null instead of an empty list."""
    named = F.filter(F.transform(items, lambda x: F.coalesce(F.nullif(x[first], F.lit("")), F.nullif(x[second], F.lit("")))), lambda x: x.isNotNull())
    return F.when(F.size(named) > 0, named)


def flatten_policy(policy: Column) -> Column:
    """The flat metadata of a nested policy record."""
    text = lambda c: c.cast("string")
    return F.struct(
        text(policy["page_ptr_id"]).alias("iptp_id"),
        F.coalesce(F.nullif(policy["title"], F.lit("")), policy["slug"]).alias("title"),
        text(policy["announced_date"]).alias("announced_date"),
        text(policy["effective_date"]).alias("effective_date"),
        text(policy["administration"]).alias("administration"),
        labels(policy["filters"]["agencies"], "agency", "agency_slug").alias("agencies_affected"),
        labels(policy["filters"]["subject_matter"], "title", "slug").alias("subject_matter"),
    )


def minimal_meta(meta: Column, kind: T.StructType, keep: list[str], renamed: dict[str, str] | None = None) -> Column:
    """Whitelisted fields of a struct; nested values as JSON text. ``renamed``: whitelist name to field name."""
    fields = {f.name: f.dataType for f in kind.fields}
    out = []
    for name in keep:
        field = (renamed or {}).get(name, name)
        if field in fields:
            nested = isinstance(fields[field], (T.StructType, T.MapType))
            out.append((F.to_json(meta[field]) if nested else meta[field]).alias(name))
    return F.struct(*out)


def skip_download(local_size: Column, expected_size: Column, skip_existing: bool) -> Column:
    """Whether a file is there already: of the expected size, or not empty where that is unknown."""
    if not skip_existing:
        return F.lit(False)
    return F.when(local_size.isNull(), False).when(expected_size.isNull(), local_size > 0).otherwise(local_size == expected_size)
