"""Reading level of texts by a familiar-word formula.

Two figures make the level: the share of words outside a list of familiar words, and the average sentence length.
The list comes from document frequencies: first among labelled plain documents (a bounded sample of labels), which gives a
provisional level; then among all documents of a provisional level up to PLAIN, the whole corpus being read.
Words in at least FAMILIAR of those documents are familiar. The bands' borders are logistic fits on the labelled sample.

The list has at most (mean number of different words in a document) / FAMILIAR words, whatever the corpus.
Language is told from function words, not from any column.

Defined results: null, empty and wordless texts and texts that aren't English have a null band; labels of null band are ignored and
several raters' labels give their median; repeated documents are scored each; no labels at all give null bands.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.session import materialise

PLAIN, FAMILIAR = 3.25, 0.02
HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*(?:\s+(?!\d)|$)|[。！？]")
#: Frequent function words of the languages met, fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as with was by this are from at which or an be not has have its were their his they but".split(),
    "es": "el la los las de del y en que un una por con para su se al lo como más pero sus es son fue este esta no".split(),
    "fr": "le la les de des du et en que un une pour par sur dans est sont au aux ce cette il elle qui ne pas plus avec".split(),
    "de": "der die das und in den von zu mit ist im für auf des ein eine nicht als auch dem werden sich".split(),
    "pt": "o a os as de do da dos das e em que um uma por com para não se ao mais como foi".split(),
    "it": "il lo la gli le di del della e in che un una per con non si al più come sono".split(),
}
LANGUAGES = {lang: frozenset(words) for lang, words in FUNCTION_WORDS.items()}


def words_and_length(text: str | None) -> tuple[list[str], float]:
    """Lower-case words, and words a sentence."""
    if not text:
        return [], 0.0
    if "<" in text or "&" in text:
        text = html.unescape(TAG.sub(" ", text))
    text = unicodedata.normalize("NFKC", HIDDEN.sub("", text))
    words = WORD.findall(text.lower())
    if not words:
        return [], 0.0
    sentences = sum(1 for s in SENTENCE.split(text) if WORD.search(s))
    return words, len(words) / max(1, sentences)


def is_english(words: list[str]) -> bool:
    if not words:
        return False
    count = Counter(words)
    share = {lang: sum(count[w] for w in listed) for lang, listed in LANGUAGES.items()}
    return share["en"] >= 0.06 * len(words) and share["en"] >= max(n for lang, n in share.items() if lang != "en")


def features(share: float, length: float) -> list[float]:
    return [1.0, share, np.log(max(length, 1.0)), share * np.log(max(length, 1.0))]


def fit_borders(x: np.ndarray, band: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each border b of 2 to 5, coefficients of the log odds that a text is of band b or above."""
    out = []
    for b in (2, 3, 4, 5):
        y, w = (band >= b).astype(float), np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
            w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
        out.append(w)
    return np.array(out)


def level(x: list[float], borders: np.ndarray) -> float:
    """1 to 5: one and the chances of being above each border."""
    return float(1 + (1 / (1 + np.exp(-np.clip(borders @ np.array(x), -30, 30)))).sum())


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> pd.DataFrame:
    """Texts and median bands of at most ``sample`` labelled documents, chosen by a hash of the id."""
    medians = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.percentile(F.col(label_col).cast("double"), F.lit(0.5)).alias("band"), F.count("*").alias("raters"))
    chosen = medians.orderBy(F.xxhash64("id"), "id").limit(sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, band, raters in zip(pdf["id"], pdf["text"], pdf["band"], pdf["raters"], strict=True):
                words, length = words_and_length(text)
                if is_english(words):
                    count = Counter(words)
                    rows.append((key, list(count), list(count.values()), length, band, raters))
            yield pd.DataFrame(rows, columns=["id", "words", "counts", "length", "band", "raters"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # at most ``sample`` rows
    return texts.mapInPandas(run, f"id {kind}, words array<string>, counts array<int>, length double, band double, raters long").toPandas()


def _share(words: list, counts: list, listed: set[str]) -> float:
    total = sum(counts)
    return 1 - sum(n for w, n in zip(words, counts, strict=True) if w in listed) / total


def reading_levels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "band", sample: int = 4000) -> DataFrame:
    """id, english, unfamiliar (share), sentence_length, level (1.0 to 5.0) and band (1 to 5) of every row.

    sample: the largest number of labelled documents that the list's start and the borders are fitted on.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = _labelled(docs, labels, id_col, text_col, label_col, sample)

    def fitted(listed: set[str]) -> np.ndarray | None:
        if not len(known):
            return None
        x = np.array([features(_share(w, c, listed), n) for w, c, n in zip(known["words"], known["counts"], known["length"], strict=True)])
        return fit_borders(x, known["band"].to_numpy(), np.sqrt(known["raters"].to_numpy(float)))

    plain = known[known["band"] <= 3]
    seen = Counter(w for words in plain["words"] for w in words)
    first = {w for w, n in seen.items() if n >= FAMILIAR * len(plain)}
    start = spark.sparkContext.broadcast((first, fitted(first)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, borders = start.value
        count: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words, length = words_and_length(text)
                if borders is not None and is_english(words):
                    share = sum(w not in listed for w in words) / len(words)
                    if level(features(share, length), borders) <= PLAIN:
                        count.update(set(words))
                        count[""] += 1  # documents
            if len(count) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count)), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
                count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    counts = materialise(rows.select("text").mapInArrow(frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    n = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    listed = {r.word for r in counts.where((F.col("n") >= max(1.0, FAMILIAR * n)) & (F.col("word") != "")).select("word").collect()}
    final = spark.sparkContext.broadcast((listed, fitted(listed)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        familiar, borders = final.value
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(1).to_pylist():
                words, length = words_and_length(text)
                english = is_english(words)
                share = sum(w not in familiar for w in words) / len(words) if words else None
                value = level(features(share, length), borders) if english and borders is not None else None
                out.append((english, share, length if words else None, value))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.bool_()), *(pa.array(c, pa.float64()) for c in cols[1:])], names=["id", "english", "unfamiliar", "sentence_length", "level"])

    scored = rows.mapInArrow(score, f"id {kind}, english boolean, unfamiliar double, sentence_length double, level double")
    return scored.select(F.col("id").alias(id_col), "english", "unfamiliar", "sentence_length", "level", F.floor(F.col("level") + 0.5).cast("int").alias("band"))
