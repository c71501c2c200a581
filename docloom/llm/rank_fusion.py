"""One ranking from several scores of different scale and shape.

Each score becomes its empirical percentile within the group (ties get the average of their ranks), the percentile goes
through the inverse normal distribution, and the weighted mean of these normal scores gives the order.
Only ranks matter, so neither a score's range nor an extreme value can outweigh the others.

Groups of up to ``BIG`` items are ranked by windows over one shuffle by group, a sort a score. In larger groups (one may hold a third of all items) rows are counted
by value first, so ties are one row, and values are cut at approximate quantiles into buckets that are ranked apart and shifted by the
bucket totals. The quantiles only balance the buckets; the ranks of both ways are exact and equal.

Defined results: null and NaN scores share the lowest ranks of their score, so a missing score is no advantage;
an item repeated within a group counts once, with the largest of each score; rows with a null group or item take
no part; equal means share a place; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

BIG = 100_000
CUTS = 128
#: Coefficients of P. J. Acklam's rational approximation of the inverse normal distribution (relative error below 1.2e-9).
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution at p in (0, 1)."""

    def poly(coefficients: tuple[float, ...], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    r = q * q
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = poly(C, tail) / poly(D, tail)
    return F.when(F.abs(q) <= 0.47575, q * poly(A, r) / poly(B, r)).when(q < 0, outer).otherwise(-outer)


def by_size(df: DataFrame, group: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of groups of up to BIG rows, and those of the larger ones, or None where there are none."""
    large = materialise(df.groupBy(group).agg(F.count("*").alias("rows")).where(F.col("rows") > BIG).select(group), "large")
    if large.isEmpty():
        return df, None
    return df.join(large, group, "left_anti"), df.join(large, group, "left_semi")


def average_ranks(df: DataFrame, group_by: list[str], value: str) -> DataFrame:
    """group columns, value, rank (average over ties, from 1), ties and n, one row a distinct non-null value."""
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*group_by, value).agg(F.count("*").alias("ties")), "values")
    sizes = counts.groupBy(*group_by).agg(F.sum("ties").alias("n"), F.count("*").alias("different"))
    large = sizes.where(F.col("different") > BIG).select(*group_by)
    cuts = counts.join(large, group_by, "left_semi").groupBy(*group_by).agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 2000).alias("cuts"))
    placed = counts.join(sizes.select(*group_by, "n"), group_by).join(cuts, group_by, "left").withColumn("bucket", F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col(value))), F.lit(0))).drop("cuts")
    inner = Window.partitionBy(*group_by, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = placed.groupBy(*group_by, "bucket").agg(F.sum("ties").alias("total"))
    shifts = totals.withColumn("shift", F.sum("total").over(Window.partitionBy(*group_by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("total")).drop("total")
    ranked = placed.withColumn("upto", F.sum("ties").over(inner)).join(shifts, [*group_by, "bucket"])
    return ranked.select(*group_by, value, (F.col("shift") + F.col("upto") - (F.col("ties") - 1) / 2).alias("rank"), "ties", "n")


def fused_scores(df: DataFrame, group_by: str, item: str, scores: dict[str, float]) -> DataFrame:
    """One row an item of a group: group, item and fused, the weighted mean of normal scores.

    scores: weight of each score column; larger scores are better.
    """
    clean = [F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(scores)]
    items = df.select(F.col(group_by).alias("g"), F.col(item).alias("i"), *scores).where("g is not null and i is not null").groupBy("g", "i").agg(*clean)
    items = materialise(items, "items")
    small, large = by_size(items, "g")
    n, total = F.count("*").over(Window.partitionBy("g")), float(sum(scores.values()))
    fused, ranked = F.lit(0.0), small.withColumn("n", n)
    for k, weight in enumerate(scores.values()):
        w = Window.partitionBy("g").orderBy(F.col(f"s{k}").asc_nulls_first())
        # the average over ties is the mean of the first and the last of their ranks
        ranked = ranked.withColumn(f"p{k}", ((F.rank().over(w) + F.round(F.cume_dist().over(w) * F.col("n"))) / 2 - 0.5) / F.col("n"))
        fused = fused + F.lit(float(weight)) * inverse_normal(F.col(f"p{k}"))
    out = ranked.select(F.col("g").alias(group_by), F.col("i").alias(item), F.round(fused / total, 9).alias("fused"))
    return out if large is None else out.unionByName(_fused_large(large, scores).select(F.col("g").alias(group_by), F.col("i").alias(item), "fused"))


def _fused_large(items: DataFrame, scores: dict[str, float]) -> DataFrame:
    long = items.select("g", "i", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"s{k}").alias("v")) for k in range(len(scores))))).alias("x")).select("g", "i", "x.kind", "x.v")
    totals = long.groupBy("g", "kind").agg(F.count("*").alias("total"), F.count_if(F.col("v").isNull()).alias("missing"))
    ranks = average_ranks(long, ["g", "kind"], "v").select("g", "kind", "v", "rank")
    weights = F.element_at(F.array(*(F.lit(float(w)) for w in scores.values())), F.col("kind") + 1)
    # missing values need no join with the ranks: a hot null is never a join key
    known = long.where("v is not null").join(ranks, ["g", "kind", "v"]).select("g", "i", "kind", "rank")
    every = known.unionByName(long.where("v is null").select("g", "i", "kind", F.lit(None).cast("double").alias("rank"))).join(totals, ["g", "kind"])
    percentile = (F.coalesce(F.col("rank") + F.col("missing"), (F.col("missing") + 1) / 2) - 0.5) / F.col("total")
    return every.groupBy("g", "i").agg(F.round(F.sum(weights * inverse_normal(percentile)) / float(sum(scores.values())), 9).alias("fused"))


def fuse(df: DataFrame, group_by: str, item: str, scores: dict[str, float]) -> DataFrame:
    """fused_scores with place, 1 being the best; equal means share a place."""
    fused = materialise(fused_scores(df, group_by, item, scores), "fused").select(F.col(group_by).alias("g"), F.col(item).alias("i"), "fused")
    small, large = by_size(fused, "g")
    out = small.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("fused"))).cast("long"))
    if large is not None:
        places = average_ranks(large.select("g", (-F.col("fused")).alias("minus")), ["g"], "minus").select("g", (-F.col("minus")).alias("fused"), (F.col("rank") - (F.col("ties") - 1) / 2).cast("long").alias("place"))
        out = out.unionByName(large.join(places, ["g", "fused"]).select(*out.columns))
    return out.select(F.col("g").alias(group_by), F.col("i").alias(item), "fused", "place")


def best(df: DataFrame, group_by: str, item: str, scores: dict[str, float]) -> DataFrame:
    """The first item of every group; of equal ones the smallest."""
    return fused_scores(df, group_by, item, scores).groupBy(group_by).agg(F.min_by(item, F.struct((-F.col("fused")).alias("minus"), F.col(item))).alias(item))
