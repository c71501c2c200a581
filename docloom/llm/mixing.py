"""Mixing sources to target weights.

Tokens are raked by iterative proportional fitting: the table of tokens by source, language and topic is scaled in turn
to the marginals of the sources (the targets), of the languages and of the topics (as the listed sources have
them), no cell above its source's repetitions, and to the sources last. A cell's ratio of wanted to
available tokens is the expected number of copies of each of its documents: the whole part is taken for certain, the
fraction is an inclusion probability p. Documents are drawn by sequential Poisson sampling, in the order of u / p with u a
hash of the id, until the source's tokens are met, so a source misses its target by less than one document.

The table is aggregated before it reaches the driver: its cells are the combinations of source, language code and topic that occur, however rare,
and their number doesn't grow with the documents. The cut in the order u / p is found from a histogram and then within one of its bins.

Defined results: sources are compared without case and outer spaces; null and unlisted sources, null and empty texts take
no part in the mixture, but their tokens count in the total; target rows with a null or repeated source (beyond the first),
or without a positive weight, are ignored; max_repeats null counts as 1; a source that can't meet its
target gives all it has and is reported as short, the other sources keep their targets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.tokenizer import DEFAULT, count_tokens
from docloom.session import materialise

BINS = 4096


def rake(available: np.ndarray, cell_source: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray, repeats: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Wanted tokens of each cell. goal and repeats: by source; margins: (category of each cell, target shares) of the others."""
    top = available * repeats[cell_source]
    wanted = available.astype(float)

    def to_sources(x: np.ndarray) -> np.ndarray:
        for _ in range(50):  # what capped cells leave goes to the other cells of the source
            free = x < top * (1 - 1e-12)
            fixed = np.bincount(cell_source, np.where(free, 0, x), len(goal))
            loose = np.bincount(cell_source, np.where(free, x, 0), len(goal))
            factor = np.divide(np.maximum(goal - fixed, 0), loose, out=np.ones_like(loose), where=loose > 0)
            y = np.where(free, np.minimum(x * factor[cell_source], top), x)
            if np.allclose(y, x, rtol=1e-12, atol=0):
                break
            x = y
        return x

    for _ in range(rounds):
        before = wanted
        wanted = to_sources(wanted)
        for category, share in margins:
            now = np.bincount(category, wanted, len(share))
            factor = np.divide(share * wanted.sum(), now, out=np.ones_like(now), where=now > 0)
            wanted = np.minimum(wanted * factor[category], top)
        if np.allclose(wanted, before, rtol=1e-9):
            break
    return to_sources(wanted)


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str = "document_type", share: float = 0.5, vocabulary: str = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, n_tokens, copies of at least 1) and its report, one row a target source.

    targets: source, weight, max_repeats. share: tokens of the mixture as a part of all documents' tokens.
    """
    spark = docs.sparkSession
    tidy = lambda c: F.lower(F.trim(c))
    goals = targets.select(tidy(F.col("source")).alias("source"), F.col("weight").cast("double"), F.coalesce(F.col("max_repeats").cast("double"), F.lit(1.0)).alias("repeats")).where("source is not null and weight > 0 and not isnan(weight)").toPandas().drop_duplicates("source").sort_values("source", ignore_index=True)
    columns = docs.select(F.col(id_col).alias("id"), tidy(F.col(source_col)).alias("source"), F.coalesce(F.regexp_extract(tidy(F.col(lang_col)), "^([a-z]{2,3})([-_].*)?$", 1), F.lit("")).alias("lang"), F.coalesce(tidy(F.col(topic_col).cast("string")), F.lit("")).alias("topic"), F.col(text_col).alias("text"))
    counted = materialise(count_tokens(columns, ["id", "source", "lang", "topic"], "text", vocabulary), "counted")
    total = counted.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    names = spark.createDataFrame(goals[["source"]].reset_index().rename(columns={"index": "s"}), "s int, source string") if len(goals) else spark.createDataFrame([], "s int, source string")
    listed = counted.where("n_tokens > 0").join(F.broadcast(names), "source")  # the targets are a small fixed table
    placed = listed.select("id", "s", "source", "n_tokens", F.col("lang").alias("l"), F.col("topic").alias("t"))
    cells = placed.groupBy("s", "l", "t").agg(F.sum("n_tokens").alias("tokens")).toPandas().sort_values(["s", "l", "t"], ignore_index=True)

    weights = goals["weight"].to_numpy(float)
    repeats = np.maximum(goals["repeats"].to_numpy(float), 0)
    source = cells["s"].to_numpy(int)
    tokens = cells["tokens"].to_numpy(float)
    have = np.bincount(source, tokens, len(goals))
    target = weights / weights.sum() * total * share if len(goals) else weights
    goal = np.minimum(target, have * repeats)
    margins = []
    for c in ("l", "t"):
        category = pd.factorize(cells[c])[0]
        by = np.bincount(category, tokens) if len(cells) else np.zeros(0)
        margins.append((category, by / max(tokens.sum(), 1)))
    wanted = rake(tokens, source, margins, goal, repeats) if len(cells) else tokens
    ratio = wanted / tokens
    base = np.floor(ratio + 1e-9)
    cells["base"], cells["p"] = base, np.maximum(ratio - base, 0)
    rest = goal - np.bincount(source, base * tokens, len(goals))

    plan = spark.createDataFrame(cells[["s", "l", "t", "base", "p"]], "s int, l string, t string, base double, p double")
    u = (F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.lit(2**40)) + 0.5) / float(2**40)
    drawn = placed.join(F.broadcast(plan), ["s", "l", "t"]).withColumn("x", F.when(F.col("p") > 1e-9, u / F.col("p")))
    drawn = materialise(drawn.select("id", "s", "source", "n_tokens", "base", "x"), "drawn")
    # bins of the order u / p, finer around 1, where the cut is expected; monotone in x
    bin_of = F.floor(BINS * F.col("x") / (1 + F.col("x"))).cast("int")
    histogram = drawn.where("x is not null").groupBy("s", bin_of.alias("bin")).agg(F.sum("n_tokens").alias("t")).toPandas().sort_values(["s", "bin"])
    cut = []
    for s in range(len(goals)):
        h = histogram[histogram["s"] == s]
        upto = h["t"].cumsum().to_numpy()
        i = int(np.searchsorted(upto, rest[s], "right"))
        cut.append((s, int(h["bin"].iloc[i]) if i < len(h) else BINS + 1, float(rest[s] - (upto[i - 1] if i else 0))))
    cuts = spark.createDataFrame(cut, "s int, cut int, left double")
    choice = drawn.withColumn("bin", bin_of).join(F.broadcast(cuts), "s")
    order = Window.partitionBy("s").orderBy("x", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = choice.where("bin = cut").withColumn("upto", F.sum("n_tokens").over(order)).withColumn("more", (F.col("upto") - F.col("n_tokens") / 2 <= F.col("left")).cast("double"))
    rest_of = choice.where("bin is null or bin <> cut").withColumn("more", F.when(F.col("bin") < F.col("cut"), 1.0).otherwise(0.0))
    taken = rest_of.unionByName(edge.drop("upto")).select("id", "s", "source", "n_tokens", (F.col("base") + F.col("more")).cast("int").alias("copies")).where("copies > 0")
    taken = materialise(taken, "mixture")
    reached = taken.groupBy("s").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    goals_df = spark.createDataFrame([(i, r.source, float(weights[i] / weights.sum()), int(have[i]), float(target[i]), bool(target[i] > have[i] * repeats[i])) for i, r in enumerate(goals.itertuples())], "s int, source string, target_share double, available_tokens long, target_tokens double, short boolean")
    report = goals_df.join(reached, "s", "left").na.fill(0).withColumn("reached_share", F.col("reached_tokens") / F.lit(float(total * share) or 1.0)).withColumn("mixture_share", F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy()), F.lit(0)))
    return taken.select(F.col("id").alias(id_col), "source", "n_tokens", "copies"), report.drop("s")
