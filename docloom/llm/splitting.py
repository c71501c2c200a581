"""Splitting oversized texts at natural boundaries, by ranges.

A text, or a file too large to load, is cut into ranges. Workers detect the boundaries in their range; a halo
on either side shows them what a boundary at the range's edge looks like: it reaches over the whole run of white space and closing signs
there, however long, and HALO characters beyond. The boundary tables of a text, two bytes a boundary, are then streamed in the order of the ranges: their lengths are
summed up, the cuts are chosen as the boundaries come by, and a task holds those within one limit only, neither a text nor its table.
The pieces are emitted by offset from the ranges that each touches. No worker needs the whole text.

A piece ends at the last paragraph end in the second half of what the limit allows, else at the last sentence
end there, clause end, word end, else at such ends in the first half, else (one endless word) at the limit. Every further
piece begins with up to ``overlap`` last characters of the piece before, from the first word start among them.
Pieces are exact slices: without the overlaps they give the trimmed text again.

Defined results: null ids and null, empty or blank texts give no pieces; texts within the limit give none
(they need no splitting) unless ``all_texts``; an id loaded twice counts once, with its largest text; null
pages stay null; pages come from form feeds, and where a text of several pages has none, every piece has the whole range.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import materialise

RANGE, HALO = 65_536, 64
BLANKS = " \t\r\n\f"
#: Ends of paragraphs, sentences, clauses and words, each with the white space behind it.
ENDS = [
    re.compile(r"(?:\n[ \t\r]*\n|\f)\s*|\n\s*\f\s*"),
    re.compile(r"(?<!\b[A-Z])[.?!。！？][\"'”’)\]]*(?:\s+(?![\d\s])|(?<=[。！？]))"),
    re.compile(r"[;:,)\]—–]\s+|\n\s*"),
    re.compile(r"\s+"),
]


#: What a boundary's signs and white space are made of.
LOOSE = re.compile(r"[\s\"'”’)\]]")


def boundaries(left: str, core: str, right: str) -> list[np.ndarray]:
    """Places in ``core`` (1 to its length) after which a paragraph, sentence, clause or word ends."""
    text, base = left + core + right, len(left)
    out = []
    for rx in ENDS:
        at = np.fromiter((m.end() - base for m in rx.finditer(text)), np.int64)
        out.append(at[(at > 0) & (at <= len(core))])
    return out


class Cuts:
    """Chooses the pieces of one text while its ranges come by; holds the boundaries of one piece's reach."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.length = self.start = self.done = self.no = 0
        self.ends: list[np.ndarray] = [np.empty(0, np.int64)] * len(ENDS)
        self.breaks, self.passed = np.empty(0, np.int64), 0
        self.ranges: list[tuple[int, int, int, int]] = []  # ordinal, number, offset, length of those not yet left behind

    def add(self, range_no: int, ends: list[np.ndarray], length: int, breaks: np.ndarray) -> list[tuple]:
        """Parts of the pieces that are certain now."""
        self.ranges.append((self.ranges[-1][0] + 1 if self.ranges else 0, range_no, self.length, length))
        self.ends = [np.concatenate([a, b + self.length]) for a, b in zip(self.ends, ends, strict=True)]
        self.breaks = np.concatenate([self.breaks, breaks + self.length])
        self.length += length
        return self._pieces()

    def _pieces(self) -> list[tuple]:
        out: list[tuple] = []
        while self.length - self.start > self.limit:
            start, limit = self.start, self.limit
            half = max(self.done, start + limit // 2)
            cut = self._last(half, start + limit) or self._last(self.done, half) or start + limit
            out += self._piece(start, cut)
            begin = cut - self.overlap
            firsts = [int(at[i]) for at in self.ends if (i := int(np.searchsorted(at, begin))) < len(at) and at[i] < cut]
            self.start, self.done = max(min(firsts, default=begin), start + 1), cut
        low = self.start - 1
        self.ends = [at[np.searchsorted(at, low) :] for at in self.ends]
        while len(self.ranges) > 1 and self.ranges[0][2] + self.ranges[0][3] <= self.start:
            self.ranges.pop(0)
        return out

    def finish(self) -> list[tuple]:
        return self._piece(self.start, self.length)

    def _last(self, low: int, high: int) -> int | None:
        """The last end of the best kind in (low, high]."""
        for at in self.ends:
            i = int(np.searchsorted(at, high, "right")) - 1
            if i >= 0 and at[i] > low:
                return int(at[i])
        return None

    def _piece(self, start: int, end: int) -> list[tuple]:
        """piece_no, part, range_no, low, high, breaks before the piece."""
        self.no += 1
        gone = int(np.searchsorted(self.breaks, start))
        self.breaks, self.passed = self.breaks[gone:], self.passed + gone
        return [(self.no, part, no, max(0, start - offset), min(length, end - offset), self.passed) for part, no, offset, length in self.ranges if offset < end and offset + length > start]


def choose(ends: list[np.ndarray], length: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of every piece of a text of ``length`` with boundaries ``ends``."""
    cuts = Cuts(limit, overlap)
    return [(low, high) for _, _, _, low, high, _ in [*cuts.add(0, ends, length, np.empty(0, np.int64)), *cuts.finish()]]


def _halo_left(text: str, at: int) -> int:
    """Where the halo before ``at`` begins."""
    while at > 0 and LOOSE.match(text[at - 1]):
        at -= 1
    return max(0, at - HALO)


def text_ranges(df: DataFrame, id_col: str, text_col: str, size: int = RANGE) -> DataFrame:
    """id, range_no, left, core, right of each text in ``df``; slices without copying more than a range."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, len(text), size)
                for s in range(0, len(starts), 64):
                    part = starts[s : s + 64]
                    cols = [[key] * len(part), [x // size for x in part], [text[_halo_left(text, x) : x] for x in part], [text[x : x + size] for x in part], [text[x + size : x + size + HALO] for x in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names=["id", "range_no", "left", "core", "right"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, "id string, range_no int, left string, core string, right string")


def file_ranges(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """The same for UTF-8 files that all workers reach: each task reads its byte ranges and halos only."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            for path in pdf["id"]:
                where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                total = where.get_file_info(name).size
                yield pd.DataFrame({"id": path, "range_no": np.arange(-(-total // size), dtype=np.int32)})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def aligned(raw: bytes, at: int) -> int:
            while at < len(raw) and raw[at] & 0xC0 == 0x80:
                at += 1
            return at

        text = lambda x: x.decode("utf-8", "replace").replace("\x00", "�")
        for pdf in batches:
            for path, no in zip(pdf["id"], pdf["range_no"], strict=True):
                where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with where.open_input_file(name) as f:
                    back = 4 * HALO
                    while True:
                        begin = max(0, no * size - back)
                        raw = f.read_at(size * (no + 1) + 4 * HALO - begin, begin)
                        low = aligned(raw, no * size - begin)
                        left = text(raw[aligned(raw, 0) if begin else 0 : low])
                        at = _halo_left(left, len(left))
                        if at > 0 or begin == 0:
                            break
                        back *= 4
                high = aligned(raw, min(len(raw), (no + 1) * size - begin))
                yield pd.DataFrame({"id": [path], "range_no": [no], "left": [left[at:]], "core": [text(raw[low:high])], "right": [text(raw[high:])[:HALO]]})

    files = spark.createDataFrame([(p,) for p in paths], "id string")
    ranges = files.mapInPandas(plan, "id string, range_no int")
    return ranges.repartition("id", "range_no").mapInPandas(read, "id string, range_no int, left string, core string, right string")


def pieces_of(ranges: DataFrame, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """id, piece_no (from 1), text, breaks_before: the form feeds before the piece's first character."""
    if overlap >= limit // 2:
        raise ValueError("the overlap must be below half the limit")
    ranges = materialise(ranges, "ranges")

    names = ["p", "s", "c", "w"]

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [] for n in [*names, "length", "breaks"]}
            for left, core, right in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                kind = np.uint16 if len(core) <= 65_536 else np.uint32
                for n, at in zip(names, boundaries(left, core, right), strict=True):
                    out[n].append((at - 1).astype(kind).tobytes())
                out["length"].append(len(core))
                out["breaks"].append(np.array([m.start() for m in re.finditer("\f", core)], kind).tobytes())
            arrays = [pa.array(out[n], pa.binary()) for n in names] + [pa.array(out["length"], pa.int64()), pa.array(out["breaks"], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["id", "range_no", *names, "length", "breaks"])

    tasks = max(int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")), ranges.sparkSession.sparkContext.defaultParallelism)
    found = ranges.repartition(tasks, "id", "range_no").mapInArrow(detect, "id string, range_no int, p binary, s binary, c binary, w binary, length long, breaks binary")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cuts, rows = None, None, []
        columns = ["id", "piece_no", "part", "range_no", "low", "high", "breaks_before"]
        types = [pa.string()] + [pa.int32()] * 6

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(columns)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=columns)

        for batch in batches:
            for i in range(batch.num_rows):
                key, no, *blobs, length, breaks = (batch.column(c)[i].as_py() for c in range(8))
                if key != last:
                    if cuts is not None:
                        rows += [(last, *r) for r in cuts.finish()]
                    last, cuts = key, Cuts(limit, overlap)
                kind = np.uint16 if length <= 65_536 else np.uint32
                read = lambda x, kind=kind: np.frombuffer(x, kind).astype(np.int64)
                rows += [(key, *r) for r in cuts.add(no, [read(x) + 1 for x in blobs], length, read(breaks))]
                if len(rows) > 20_000:
                    yield batch_of()
                    rows = []
        if cuts is not None:
            rows += [(last, *r) for r in cuts.finish()]
        yield batch_of()

    cuts = found.repartition(tasks, "id").sortWithinPartitions("id", "range_no").mapInArrow(stitch, "id string, piece_no int, part int, range_no int, low int, high int, breaks_before int")
    parts = cuts.join(ranges.select("id", "range_no", "core"), ["id", "range_no"]).select("id", "piece_no", "breaks_before", "part", F.expr("substring(core, low + 1, high - low)").alias("t"))
    whole = parts.groupBy("id", "piece_no", "breaks_before").agg(F.array_sort(F.collect_list(F.struct("part", "t"))).alias("x"))
    return whole.select("id", "piece_no", F.array_join(F.transform("x", lambda x: x["t"]), "").alias("text"), "breaks_before")


def split_texts(df: DataFrame, id_col: str, text_col: str, page_start: str | None = None, page_end: str | None = None, limit: int = 2000, overlap: int = 200, all_texts: bool = False, range_size: int = RANGE) -> DataFrame:
    """id, piece_no, text, page_start, page_end of the pieces of each text above ``limit`` characters (code points).

    Blanks at both ends of a text (spaces, tabs, line breaks, form feeds) don't count and are left off.
    """
    page = lambda c: F.col(c).cast("int") if c else F.lit(None).cast("int")
    raw = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("raw"), page(page_start).alias("first"), page(page_end).alias("last"))
    sized = raw.withColumn("text", F.btrim("raw", F.lit(BLANKS))).where(f"id is not null and length(text) > {0 if all_texts else limit}")
    once = sized.groupBy("id").agg(F.max(F.struct("text", "raw", "first", "last")).alias("r")).select("id", "r.*")
    once = materialise(once, "oversized")
    pieces = pieces_of(text_ranges(once, "id", "text", range_size), limit, overlap)
    feeds = lambda c: F.length(c) - F.length(F.translate(c, "\f", ""))
    leading = F.length(F.regexp_extract("raw", "^[ \\t\\r\\n\\f]*", 0))
    pages = once.select("id", "first", "last", (feeds(F.col("raw")) > 0).alias("marked"), feeds(F.substring("raw", F.lit(1), leading)).alias("lead"))
    start = F.col("first") + F.col("lead") + F.col("breaks_before") + feeds(F.regexp_extract("text", "^\\s*", 0))
    end = F.col("first") + F.col("lead") + F.col("breaks_before") + feeds(F.regexp_replace("text", "[ \\t\\r\\n\\f]+$", ""))
    within = lambda x: F.when(F.col("last").isNull(), x).otherwise(F.least(x, F.col("last")))
    return pieces.join(pages, "id").select("id", "piece_no", "text", F.when(F.col("marked"), within(start)).otherwise(F.col("first")).alias("page_start"), F.when(F.col("marked"), within(end)).otherwise(F.coalesce("last", "first")).alias("page_end"))
