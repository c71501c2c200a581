"""Assembly of nested records from relational tables, resume and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.ranking import first_rows


def enrich(df: DataFrame, *dimensions: tuple[DataFrame, str | Column]) -> DataFrame:
    """Chained left joins. Small sides are broadcast by their size as the optimizer sees it, never by a hint."""
    for dimension, on in dimensions:
        df = df.join(dimension, on, "left")
    return df


def nest(children: DataFrame, key: str, order: list[str], fields: list[str], name: str) -> DataFrame:
    """key and an array of structs of the child rows in order, nulls last."""
    place = [F.struct(F.col(o).isNull(), F.col(o)).alias(f"_o{i}") for i, o in enumerate(order)]
    item = F.struct(*place, F.struct(*fields).alias("_item"))
    return children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_item"]).alias(name))


def nest_distinct(children: DataFrame, key: str, order: list[str], fields: list[str], name: str, by: list[str]) -> DataFrame:
    """The same with one row for each ``by``, the first in order."""
    nulls_last = [F.col(o).asc_nulls_last() for o in order]
    return nest(first_rows(children, [key, *by], nulls_last), key, order, fields, name)


def attach(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> DataFrame:
    """Parents with the nested lists of their children; no children give an empty list."""
    for nested, name in children:
        empty = F.array().cast(nested.schema[name].dataType)
        parents = parents.join(nested, key, "left").withColumn(name, F.coalesce(name, empty))
    return parents


def resolve_ids(df: DataFrame, key: str, ids: str, lookup: DataFrame, lookup_key: str, fields: list[str], name: str) -> DataFrame:
    """Each id of an array with the fields of its row; an id without one keeps its number."""
    pairs = df.select(F.col(key).alias("_k"), F.posexplode(ids).alias("_pos", "_id"))
    found = pairs.join(lookup.select(F.col(lookup_key).alias("_id"), *fields), "_id", "left")
    item = F.struct(F.col("_pos"), F.struct(F.col("_id").alias("id"), *fields).alias("x"))
    lists = found.groupBy("_k").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias(name))
    return df.join(lists.withColumnRenamed("_k", key), key, "left")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't done: how a run is resumed."""
    return df.join(done.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def reject(df: DataFrame, key: str, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and an audit (type, key) of the others with the first rule that each breaks.

    A rule is a name and the condition that makes a row bad; null is not bad.
    """
    kind = F.coalesce(*(F.when(bad, F.lit(name)) for name, bad in rules))
    marked = df.withColumn("_type", kind)
    return marked.where("_type is null").drop("_type"), marked.where("_type is not null").select(F.col("_type").alias("type"), F.col(key).cast("string").alias("key"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("type").agg(F.count("*").alias("rows"))


#: Page records need ids and a positive page number.
def valid_pages(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    page = F.col("page_num").cast("string").try_cast("int")
    return reject(
        df,
        "stable_id",
        [
            ("SKIP_BAD_RECORD", F.col("page_ptr_id").isNull() | F.col("policydocument_id").isNull() | F.col("text").isNull()),
            ("SKIP_BAD_PAGE_NUM", page.isNull()),
            ("SKIP_NONPOSITIVE_PAGE_NUM", page < 1),
        ],
    )


def valid_chunks(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f")) == ""
    return reject(df, "chunk_id", [("SKIP_MISSING_CHUNK_ID", F.col("chunk_id").isNull()), ("SKIP_EMPTY_TEXT", blank)])


def table_tags(df: DataFrame, table: str = "table", columns: str = "columns") -> DataFrame:
    """``tags`` of each row of (table, array of columns), told from the schema alone.

    A column x_id is a reference to a table x. A table of references to two tables or more and nothing else joins them ("joins:a,b");
    others with references "refer to" them, tables with a name and no reference are dimensions, and tables
    with a path or file column hold files. Tables that others refer to (by their last name part) are tagged "referenced".
    """
    have = F.array_distinct(F.transform(F.coalesce(columns, F.array().cast("array<string>")), F.lower))
    named = df.withColumn("_have", have).withColumn("_short", F.element_at(F.split(F.lower(table), r"[._]"), -1))
    refs = F.array_sort(F.transform(F.filter("_have", lambda c: F.rlike(c, F.lit(r".+_id$"))), lambda c: F.regexp_replace(c, "_id$", "")))
    named = named.withColumn("_refs", refs)
    wanted = named.select(F.explode("_refs").alias("_r")).select(F.regexp_replace("_r", "^.*_", "").alias("_short")).distinct().withColumn("_hit", F.lit(True))
    own = F.filter("_have", lambda c: (c != "id") & ~F.rlike(c, F.lit(r".+_id$")))
    rules = [
        F.when((F.size("_refs") > 1) & (F.size(own) == 0), F.concat(F.lit("joins:"), F.array_join("_refs", ","))),
        F.when((F.size("_refs") > 0) & ~((F.size("_refs") > 1) & (F.size(own) == 0)), F.concat(F.lit("refers to:"), F.array_join("_refs", ","))),
        F.when((F.size("_refs") == 0) & F.exists("_have", lambda c: c.isin("name", "title", "label", "slug")), F.lit("dimension")),
        F.when(F.exists("_have", lambda c: F.rlike(c, F.lit(r"(^|_)(file|path|key)$"))), F.lit("files")),
        F.when(F.coalesce("_hit", F.lit(False)), F.lit("referenced")),
    ]
    return named.join(wanted, "_short", "left").withColumn("tags", F.filter(F.array(*rules), lambda x: x.isNotNull())).drop("_have", "_short", "_refs", "_hit")


def matching_tables(df: DataFrame, pattern: str, include: str | None = None, table: str = "table") -> DataFrame:
    """Tables whose name matches a pattern, in any case, and contains ``include``."""
    out = df.where(F.rlike(F.lower(table), F.lit(pattern.lower())))
    return out.where(F.contains(F.lower(table), F.lit(include.lower()))) if include else out


def commentary(kind: Column | str) -> Column:
    """Whether a document's type says that it is commentary."""
    return F.coalesce(F.lower(F.trim(kind)) == "commentary", F.lit(False))


def pdf_manifest(df: DataFrame, path: str = "dest_relpath", kind: str | None = None) -> DataFrame:
    """Manifest rows of PDF files, without commentary where the column of the type is given."""
    from docloom.functions.values import is_pdf_path

    out = df.where(is_pdf_path(path))
    return out.where(~commentary(F.col(kind))) if kind else out


def probe(df: DataFrame, lists: list[str], **conditions: Column) -> DataFrame:
    """One row: the longest list of each array column, and the number of rows that meet each condition."""
    longest = [F.coalesce(F.max(F.size(c)), F.lit(0)).cast("long").alias(f"longest_{c}") for c in lists]
    return df.agg(F.count("*").alias("rows"), *longest, *(F.count_if(c).alias(name) for name, c in conditions.items()))


def distinct_values(df: DataFrame, column: str, n: int = 50) -> DataFrame:
    """The first n different values of a column, in order."""
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(n)
