"""Top N rows of every group by partition lower bounds.

Every partition finds its local N best of each group; the N-th of them is a lower bound for the group,
since N rows at least as good exist. The largest bound of a group over all partitions is joined to
the group's rows, rows below it are filtered, and only the survivors are shuffled and ranked.

The bounds are aggregated first, so their number is known: up to BOUNDS they are sent to all tasks and rows are filtered before any of them is shuffled;
beyond, groups are so many that most have few rows, and the join by group is the one shuffle that the ranking uses too.
At most N rows per group and partition go on from the first step, so a group with a third of all rows costs no more than any other.

Defined results: rows whose first order column is null or NaN aren't ranked; in the other order columns null and
NaN come last, for either direction; null group keys form groups of their own; rows equal in group and order
columns count once (of their carried columns the smallest values, nulls last, are kept); an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.session import materialise

#: Rows that a task holds before it prunes them.
HELD = 200_000
#: Groups with a bound up to which the bounds are broadcast (some tens of bytes each).
BOUNDS = 500_000


def _best(table: pa.Table, groups: int, keys: list[tuple[str, str]], n: int) -> pa.Table:
    """The n best distinct rows of each group; the column nth marks the last of n. ``keys`` begin with the groups."""
    if not table.num_rows:
        return table.append_column("nth", pa.array([], pa.bool_()))
    table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end")).combine_chunks()

    def differs(cols: list[str]) -> np.ndarray:
        """True where a row isn't equal to the one before; nulls equal nulls."""
        out = np.zeros(table.num_rows, bool)
        out[0] = True
        for c in cols:
            x = table.column(c).combine_chunks()
            unequal = pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), False).to_numpy(zero_copy_only=False)
            gone = pc.is_null(x).to_numpy(zero_copy_only=False)
            out[1:] |= unequal | (gone[1:] != gone[:-1])
        return out

    group, new = differs([f"k{i}" for i in range(groups)]), differs([c for c, _ in keys if c[0] != "c"])
    count = np.cumsum(new)
    first = np.maximum.accumulate(np.where(group, count, 0))
    place = count - first + 1
    kept = new & (place <= n)
    return table.filter(pa.array(kept)).append_column("nth", pa.array(place[kept] == n))


def top_n(df: DataFrame, group_by: list[str], order_by: list[tuple[str, str]], n: int, carry: list[str] | None = None) -> DataFrame:
    """The n best rows of each group: group, order and carried columns and ``place`` from 1.

    order_by: numeric columns with "asc" or "desc"; the last should make rows of a group distinct.
    carry: further columns of sortable types.
    """
    carry = carry or []
    kinds = dict(df.dtypes)

    def plain(c: str):
        return F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)

    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(group_by)] + [(plain(c) + F.lit(0).cast(kinds[c])).alias(f"o{i}") for i, (c, _) in enumerate(order_by)] + [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    rows = df.select(named).where("o0 is not null")
    sort = [(f"k{i}", "ascending") for i in range(len(group_by))] + [(f"o{i}", f"{how}ending") for i, (_, how) in enumerate(order_by)] + [(f"c{i}", "ascending") for i in range(len(carry))]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            count += batch.num_rows
            if count >= HELD:
                best = _best(pa.concat_tables(held), len(group_by), sort, n)
                if best.num_rows > HELD // 2:  # many groups: what is held can't be pruned further
                    yield from best.to_batches()
                    held, count = [], 0
                else:
                    held, count = [best.drop_columns(["nth"])], best.num_rows
        if held:
            yield from _best(pa.concat_tables(held), len(group_by), sort, n).to_batches()

    schema = T.StructType([*rows.schema.fields, T.StructField("nth", T.BooleanType())])
    survivors = materialise(rows.mapInArrow(local, schema), "local_best")

    # larger is better in every field of the bound, and null is the least
    def ascending(c: str, how: str):
        if how == "desc":
            return F.col(c)
        return -F.col(c) if rows.schema[c].dataType.typeName() in ("double", "float") else F.bitwise_not(F.col(c).cast("long"))

    key = F.struct(*(ascending(f"o{i}", how).alias(f"b{i}") for i, (_, how) in enumerate(order_by)))
    groups = [f"k{i}" for i in range(len(group_by))]
    good = _above(survivors.withColumn("key", key), groups)
    order = [F.col(f"o{i}").desc_nulls_last() if how == "desc" else F.col(f"o{i}").asc_nulls_last() for i, (_, how) in enumerate(order_by)]
    place = F.dense_rank().over(Window.partitionBy(*groups).orderBy(*order))
    ranked = good.select(*rows.columns, place.alias("place")).where(F.col("place") <= n)
    # rows that are equal but for what they carry came from several partitions
    copies = [F.col(f"c{i}").asc_nulls_last() for i in range(len(carry))] or [F.col("place")]
    once = ranked.withColumn("copy", F.row_number().over(Window.partitionBy(*groups, "place").orderBy(*copies))).where("copy = 1")
    return once.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(group_by)), *(F.col(f"o{i}").alias(c) for i, (c, _) in enumerate(order_by)), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)), "place")


def _above(survivors: DataFrame, groups: list[str]) -> DataFrame:
    """Rows that aren't below the largest bound of their group; groups without a bound keep all."""
    bounds = survivors.where("nth").groupBy(*(F.col(c).alias(f"b_{c}") for c in groups)).agg(F.max("key").alias("bound"))
    bounds = materialise(bounds, "bounds")
    same = F.lit(True)
    for c in groups:
        same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
    few = bounds.count() <= BOUNDS
    joined = survivors.join(F.broadcast(bounds) if few else bounds, same, "left")
    return joined.where("bound is null or key >= bound").select(survivors.columns)
