"""Pages, titles and summaries to chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import BOILERPLATE, clean_text, split_oversized, split_units, summary_paragraphs
from docloom.functions.values import summary_hash

CHUNK = "chunk_id string, source_type string, page_ptr_id string, policydocument_id string, page_start int, page_end int, text string, source_path string"


@dataclass(frozen=True)
class ChunkConfig:
    target_chars: int = 1500
    min_chars: int = 300
    relaxed_min_chars: int = 150
    max_unit_chars: int = 2000
    hard_split_chars: int = 800
    overlap: bool = True
    overlap_units: int = 2
    overlap_min_units: int = 1
    overlap_max_frac: float = 0.2
    preserve_paragraphs: bool = False


def page_units(pages: DataFrame, config: ChunkConfig) -> DataFrame:
    """Ids, page_num, source_path and the units of each page's cleaned text; all in the JVM."""
    units = F.flatten(F.transform(split_units("clean"), lambda u: split_oversized(u, config.max_unit_chars, config.hard_split_chars)))
    cleaned = pages.select(F.col("page_ptr_id").cast("string").alias("page_ptr_id"), F.col("policydocument_id").cast("string").alias("policydocument_id"), F.col("page_num").cast("int").alias("page_num"), F.col("source_path").cast("string").alias("source_path"), clean_text("text", config.preserve_paragraphs).alias("clean"))
    return cleaned.withColumn("units", units).drop("clean")


def mixed_paths(pages: DataFrame) -> DataFrame:
    """Attachments whose pages name more than one source."""
    path = F.nullif(F.col("source_path"), F.lit(""))
    ids = (F.col("page_ptr_id").cast("string").alias("page_ptr_id"), F.col("policydocument_id").cast("string").alias("policydocument_id"))
    return pages.groupBy(*ids).agg(F.min(path).alias("a"), F.max(path).alias("b")).where("a <> b").select("page_ptr_id", "policydocument_id")


class Fold:
    """Collects the units of one attachment into chunks; holds no more than one chunk's units."""

    def __init__(self, config: ChunkConfig, least: int):
        self.config, self.least = config, least
        self.units: list[tuple[str, int]] = []
        self.size = 0

    def _chunk(self) -> tuple[str, int, int] | None:
        text = " ".join(u for u, _ in self.units).strip()
        low = text.lower()
        if not self.units or len(text) < self.least or any(p in low for p in BOILERPLATE):
            return None
        pages = [p for _, p in self.units]
        return text, min(pages), max(pages)

    def add(self, unit: str, page: int) -> tuple[str, int, int] | None:
        """The chunk that the unit completes, if any. A chunk that isn't fit goes on growing."""
        c = self.config
        self.units.append((unit, page))
        self.size += len(unit) + 1
        chunk = self._chunk() if self.size >= c.target_chars else None
        if chunk:
            kept: list[tuple[str, int]] = []
            used = 0
            for u, p in reversed(self.units if c.overlap else []):
                full = len(kept) >= max(c.overlap_units, c.overlap_min_units)
                if full or (kept and used + len(u) > int(c.target_chars * c.overlap_max_frac)):
                    break
                kept.insert(0, (u, p))
                used += len(u)
            self.units, self.size = kept, sum(len(u) + 1 for u, _ in kept)
        return chunk

    def end(self) -> tuple[str, int, int] | None:
        return self._chunk()


def chunk_id(entry: str, document: str, start: int, end: int, text: str) -> str:
    flat = re.sub("[ \t]+", " ", text).strip()
    digest = hashlib.blake2b(f"pdf|{entry}|{document or ''}|{start}|{end}|{flat}".encode(), digest_size=8).hexdigest()
    return f"{entry}_pdf_{document}_p{start:04d}-p{end:04d}_h{digest}"


def pdf_chunks(pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:  # noqa: B008
    """Chunks of every attachment's pages.

    Pages are sorted within their partition and folded one by one: a task holds one chunk's units, not an attachment.
    Attachments with mixed sources give none; one without a chunk is folded again with the relaxed minimum, at the same time.
    """
    rejected = mixed_paths(pages)
    rows = page_units(pages, config).join(rejected, ["page_ptr_id", "policydocument_id"], "left_anti")
    placed = rows.repartition("page_ptr_id", "policydocument_id").sortWithinPartitions("page_ptr_id", "policydocument_id", "page_num")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key: tuple | None = None
        strict = relaxed = None
        waiting: list = []  # relaxed chunks, until the strict fold has one
        path, emitted, out = "", False, []

        def row(c: tuple[str, int, int]) -> tuple:
            return (chunk_id(key[0], key[1], c[1], c[2], c[0]), "pdf_page", key[0], key[1], c[1], c[2], c[0], path)

        def close() -> None:
            if key is None:
                return
            last = strict.end()
            if last:
                out.append(row(last))
            elif not emitted:
                last = relaxed.end() if relaxed else None
                out.extend(row(c) for c in [*waiting, *([last] if last else [])])

        for pdf in batches:
            for entry, document, page, source, units in zip(pdf["page_ptr_id"], pdf["policydocument_id"], pdf["page_num"], pdf["source_path"], pdf["units"], strict=True):
                if (entry, document) != key:
                    close()
                    key, path, emitted, waiting = (entry, document), source, False, []
                    strict, relaxed = Fold(config, config.min_chars), Fold(config, min(config.min_chars, config.relaxed_min_chars))
                for unit in units:
                    chunk = strict.add(unit, int(page))
                    if chunk:
                        out.append(row(chunk))
                        emitted, relaxed, waiting = True, None, []
                    elif relaxed:
                        small = relaxed.add(unit, int(page))
                        if small:
                            waiting.append(small)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return placed.mapInPandas(run, CHUNK)


def title_chunks(policies: DataFrame) -> DataFrame:
    """One chunk for each policy with a title."""
    title = F.btrim(F.col("title"), F.lit(" \t\r\n\f"))
    rows = policies.select(F.col("page_ptr_id").cast("string").alias("page_ptr_id"), title.alias("text")).where("text <> ''")
    return _policy_chunks(rows, F.concat("page_ptr_id", F.lit("_ttl_h"), summary_hash("ttl", F.col("page_ptr_id"), F.lit(0), F.col("text"))), "policy_title")


def summary_chunks(policies: DataFrame, text_col: str = "description_text") -> DataFrame:
    """One chunk for each summary, or one for each paragraph where one is long."""
    rows = policies.select(F.col("page_ptr_id").cast("string").alias("page_ptr_id"), summary_paragraphs(text_col).alias("parts"))
    parts = rows.select("page_ptr_id", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "text"))
    digest = summary_hash("sum", F.col("page_ptr_id"), F.col("i"), F.col("text"))
    # a text is split if one of its paragraphs is long: then it has several parts, or its only part is long itself
    split = (F.col("n") > 1) | ((F.length("text") > 1500) & ~F.contains("text", F.lit("\n\n")))
    name = F.when(split, F.concat("page_ptr_id", F.format_string("_sum_par%04d_h", "i"), digest)).otherwise(F.concat("page_ptr_id", F.lit("_sum_h"), digest))
    return _policy_chunks(parts, name, "policy_summary")


def _policy_chunks(rows: DataFrame, name, kind: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(name.alias("chunk_id"), F.lit(kind).alias("source_type"), "page_ptr_id", none.alias("policydocument_id"), F.lit(0).alias("page_start"), F.lit(0).alias("page_end"), "text", none.alias("source_path"))


def with_meta(chunks: DataFrame, policies: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """Chunks with the metadata of their policy and attachment; what isn't known stays null, the chunk stays."""
    flat = policies.select(
        F.col("page_ptr_id").cast("string").alias("page_ptr_id"),
        F.struct(F.col("page_ptr_id").cast("string").alias("iptp_id"), "title", "announced_date", "effective_date", "administration", "agencies_affected", "subject_matter").alias("policy"),
    )
    out = chunks.join(flat, "page_ptr_id", "left")
    if attachments is not None:
        file = attachments.select(F.col("page_ptr_id").cast("string").alias("page_ptr_id"), F.col("policydocument_id").cast("string").alias("policydocument_id"), F.struct(F.col("policydocument_id").cast("long").alias("policydocument_id"), "document_type", "file_title").alias("attachment"))
        out = out.join(file, ["page_ptr_id", "policydocument_id"], "left")
        stub = F.when(F.col("policydocument_id").isNotNull(), F.struct(F.col("policydocument_id").try_cast("long").alias("policydocument_id"), F.lit(None).cast("string").alias("document_type"), F.lit(None).cast("string").alias("file_title")))
        out = out.withColumn("attachment", F.coalesce("attachment", stub))
    return out


def all_chunks(policies: DataFrame, pages: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:  # noqa: B008
    """Title, summary and PDF chunks. Titles and summaries come from the policies, so policies without pages have them."""
    return title_chunks(policies).unionByName(summary_chunks(policies)).unionByName(pdf_chunks(pages, config))


def large_attachments(pages: DataFrame, threshold: int = 300) -> DataFrame:
    return pages.groupBy("page_ptr_id", "policydocument_id").agg(F.count("*").alias("pages")).where(F.col("pages") > threshold)


def page_stats(pages: DataFrame, key: str = "stable_id", short: int = 30) -> DataFrame:
    """pages, total_chars, median_chars (rounded down) and the share of pages under ``short`` characters of each attachment."""
    n = F.length(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n\f")))
    return pages.select(key, n.alias("n")).groupBy(key).agg(F.count("*").alias("pages"), F.sum("n").alias("total_chars"), F.floor(F.percentile("n", F.lit(0.5))).cast("long").alias("median_chars"), F.avg((F.col("n") < short).cast("double")).alias("short_share"))


def scanned(pages: DataFrame, key: str = "stable_id", share: float = 0.8) -> DataFrame:
    """Attachments with the flag whether they look scanned: ``share`` of the pages or more are nearly empty."""
    return page_stats(pages, key).select(key, (F.col("short_share") >= share).alias("scanned"))
