"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern. Within a part, a segment tree over the ranks of adjacent pairs
has at its root the leftmost pair of lowest rank; that pair is merged, the three leaves around it are updated in
logarithmic time, and so on until no pair has a rank. A part of n bytes takes O(n log n), however long it is.
Parts repeat a lot (they follow Zipf's law), so each task remembers those it has met.

The vocabulary is read once on the driver from the path given and broadcast (under 1 MB, it doesn't grow).

Defined results: null and empty texts give an empty list; strings that look like special tokens are ordinary
text; every row is kept, repeated rows and null ids too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern of the 50k vocabularies, a fixed value of theirs.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts and bytes that a task remembers before it begins anew.
REMEMBERED, LONG = 400_000, 256


def load(path: str = DEFAULT) -> dict[bytes, int]:
    """Rank (which is the id) of every token."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def encode_part(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one part of a text."""
    whole = ranks.get(part)
    if whole is not None:
        return [whole]
    n = len(part)
    tokens: list[bytes] = [part[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    leaves = 1
    while leaves < n - 1:
        leaves *= 2
    none = 1 << 62
    get = ranks.get

    def entry(i: int) -> int:
        """Rank and place of the pair that begins at i, as one number; ``none`` if it can't be merged."""
        j = after[i]
        if j >= n:
            return none
        rank = get(tokens[i] + tokens[j])
        return none if rank is None else rank * n + i

    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        tree[leaves + i] = entry(i)
    for i in range(leaves - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def update(i: int, value: int) -> None:
        i += leaves
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least

    while tree[1] != none:
        i = tree[1] % n
        j = after[i]
        tokens[i] += tokens[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if j < n - 1:
            update(j, none)
        update(i, entry(i))
        if before[i] >= 0:
            update(before[i], entry(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[tokens[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts and remembers their parts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        known = self.known
        for part in self.split(text):
            ids = known.get(part)
            if ids is None:
                ids = encode_part(part.encode(), self.ranks)
                if len(part) <= LONG:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[part] = ids
            out += ids
        return out


def encode(df: DataFrame, id_col: str, text_col: str, path: str = DEFAULT, pattern: str = PATTERN) -> DataFrame:
    """The id column and ``ids`` of each row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            flat, ends, first = [], [0], 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                flat.append(np.array(encoder.encode(text), np.int32))
                ends.append(ends[-1] + len(flat[-1]))
                if ends[-1] >= 4_000_000 or i == batch.num_rows - 1:  # offsets and batches stay small
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i + 1 - first), ids], names=["id", "ids"])
                    flat, ends, first = [], [0], i + 1

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def count_tokens(df: DataFrame, keep: list[str], text_col: str, path: str = DEFAULT, pattern: str = PATTERN, name: str = "n_tokens") -> DataFrame:
    """The columns ``keep`` and the number of tokens of each row's whole text."""
    shared = df.sparkSession.sparkContext.broadcast(load(path))
    kinds = [f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in batches:
            n = [len(encoder.encode(t)) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "n"])

    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, ", ".join([*kinds, "n long"]))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("n").alias(name))
