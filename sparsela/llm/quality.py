"""Quality rules: word and line counts, and compression bands by Zstandard."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHasher, bound_batches, map_rows, mix64, staged, table_if_there, values_of, white_space, words_of

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size / size. document: (bytes from, low, high), in
    ascending order; a shorter text than the first has no limit. Of the chunks of
    ``chunk`` bytes (a rest below that is no chunk) at most ``bad_share`` may lie
    outside (low, high) of ``chunk_limits``. These wide limits serve where there are
    no labelled rows; ``calibrated`` fits them to a corpus."""

    document: tuple[tuple[int, float, float], ...] = (
        (64, 0.20, 1.20),
        (256, 0.40, 0.90),
        (512, 0.38, 0.85),
        (1024, 0.35, 0.80),
        (2048, 0.33, 0.76),
        (4096, 0.31, 0.72),
        (16384, 0.28, 0.70),
        (65536, 0.24, 0.70),
    )
    chunk: int = 1024
    chunk_limits: tuple[float, float] = (0.22, 0.84)
    bad_share: float = 0.5
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        found = [x for x in self.document if size >= x[0]]
        return found[-1][1:] if found else (0.0, float("inf"))


@dataclass(frozen=True)
class Calibration:
    """All labelled good rows are measured, each by its size, ratio and all its chunks.
    reject: the share of these that may lie beyond each limit; margin: what the limits lie
    further out. Steps of half an octave in length; one with fewer than least_rows rows keeps
    the given limits."""

    reject: float = 0.002
    margin: float = 0.004
    least_rows: int = 40


#: Ratios are counted to so many places, those of the limits, so that what is counted is bounded.
PLACES = 6


class Features:
    """Counts of one whole text, all on its bytes."""

    def __init__(self) -> None:
        self.hasher, self.space = SpanHasher(), white_space()
        self.symbol = np.zeros(256, dtype=bool)
        self.symbol[list(SYMBOLS)] = True

    def of(self, raw_bytes: bytes) -> tuple[int, int, int, int, int]:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
        raw = np.frombuffer(raw_bytes, dtype=np.uint8)
        start, end = words_of(raw, self.space)
        n = len(start)
        symbols = int(self.symbol[raw].sum())
        if n == 0:
            return 0, 0, symbols, 0, 0
        chars = int(((raw & 0xC0) != 0x80).sum() - self.space[raw].sum())
        prefix = self.hasher.prefix(raw)
        breaks = np.flatnonzero(raw == 10)
        lines = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
        with_word = np.searchsorted(start, lines[1]) > np.searchsorted(start, lines[0])
        hashes = self.hasher.spans(prefix, lines[0][with_word], lines[1][with_word])
        dup_lines = len(hashes) - len(np.unique(hashes))
        repeats = 0
        if n > 3:
            words = self.hasher.spans(prefix, start, end)
            windows = mix64(mix64(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:])
            _, back, count = np.unique(windows, return_inverse=True, return_counts=True)
            often = np.flatnonzero(count[back] > 1)
            marked = np.zeros(n, dtype=bool)
            for j in range(3):
                marked[often + j] = True
            repeats = int(marked.sum())
        return n, chars, symbols, dup_lines, repeats


class Judge:
    """Measures and verdict of one whole text."""

    def __init__(self, bands: Bands, min_words: int, max_repeat: int) -> None:
        import zstandard

        self.bands, self.min_words, self.max_repeat = bands, min_words, max_repeat
        self.features = Features()
        self.compressor = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(self.compressor.compress(raw)) / len(raw)

    def chunk_ratio(self, raw: bytes, k: int) -> float:
        return self.ratio(raw[k * self.bands.chunk : (k + 1) * self.bands.chunk])

    def base(self, raw: bytes) -> tuple[tuple[int, int, int, int, int], bool]:
        """The five counts, and whether they fail the base rules."""
        counts = self.features.of(raw)
        return counts, counts[0] < self.min_words or 100 * counts[4] > self.max_repeat * counts[0]

    def of(self, text: str | None) -> tuple:
        """The five counts, ratio, chunks, chunks outside, base_failed, kept."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        counts, failed = self.base(raw)
        ratio = self.ratio(raw) if raw else None
        low, high = self.bands.limits(len(raw))
        within = ratio is None or low <= ratio <= high
        low, high = self.bands.chunk_limits
        chunks = len(raw) // self.bands.chunk
        bad = sum(not low <= self.chunk_ratio(raw, k) <= high for k in range(chunks))
        return (*counts, ratio, chunks, bad, failed, not failed and within and bad <= self.bands.bad_share * chunks)


def edges_of(bands: Bands) -> list[int]:
    """Where the steps in length begin."""
    return sorted({x[0] for x in bands.document} | {round(2 ** (k / 2)) for k in range(12, 2 * 40)})


def quantile_of(ordered: Iterator[tuple[float, int]], n: int, share: float) -> float:
    """The linearly interpolated quantile of n values given by (value, count) in order."""
    place = share * (n - 1)
    low = int(place)
    seen, first = 0, None
    for value, count in ordered:
        seen += count
        if first is None and seen > low:
            first = value
        if seen > min(low + 1, n - 1):
            return first + (place - low) * (value - first)
    raise ValueError("fewer values than said")


def fitted_on_counts(documents: dict[int, tuple[int, float, float]], chunks: tuple[int, float, float] | None, bands: Bands, how: Calibration) -> Bands:
    """Limits from (rows, low quantile, high quantile) by step in length, and of the chunks."""

    def between(found: tuple[int, float, float]) -> tuple[float, float]:
        return round(found[1] - how.margin, PLACES), round(found[2] + how.margin, PLACES)

    table = []
    for low in edges_of(bands):
        own = documents.get(low)
        limits = between(own) if own and own[0] >= how.least_rows else bands.limits(low)
        if not table or table[-1][1:] != limits:
            table.append((low, *limits))
    return replace(bands, document=tuple(table), chunk_limits=between(chunks) if chunks and chunks[0] >= how.least_rows else bands.chunk_limits)


def fitted(rows: list[tuple[int, float, list[float]]], bands: Bands, how: Calibration) -> Bands:
    """Limits from (bytes, ratio, chunk ratios) of good texts."""
    edges = np.array(edges_of(bands))
    by_step: dict[int, list[float]] = {}
    for size, ratio, _ in rows:
        if size >= edges[0]:
            by_step.setdefault(int(edges[np.searchsorted(edges, size, side="right") - 1]), []).append(ratio)

    def summary(values: list[float]) -> tuple[int, float, float]:
        return len(values), *(float(np.quantile(values, q)) for q in (how.reject, 1 - how.reject))

    pieces = [c for r in rows for c in r[2]]
    return fitted_on_counts({k: summary(v) for k, v in by_step.items()}, summary(pieces) if pieces else None, bands, how)


def calibrated(
    docs: DataFrame, good_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), how: Calibration = Calibration(), min_words: int = 50, max_repeat: int = 50
) -> Bands:
    """Bands whose limits hold for good texts: ``good_ids`` names rows of docs that are
    known to be good (column id_col). All of these are measured whole, where the texts
    lie: tasks count ratios by step in length (chunks are one more step), to the places that
    the limits have, and the counts around the wanted quantiles alone come to the driver. Rows
    that fail the base rules don't count. Without such rows the given bands come back."""
    key = F.col(id_col).cast("long")
    ids = good_ids.select(key.alias("_id")).filter("_id is not null").distinct()
    edges = np.array(edges_of(bands))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands, min_words, max_repeat)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if doc is not None and raw and not judge.base(raw)[1]:
                    pieces = [round(judge.chunk_ratio(raw, k) * bands.chunk) for k in range(len(raw) // bands.chunk)]
                    rows.append((doc, len(raw), judge.ratio(raw), pieces))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int32())], strict=True)], ["_id", "size", "ratio", "pieces"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[int, float], int] = {}
            for size, ratio, pieces in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                steps = [(-1, x / bands.chunk) for x in pieces]
                if size >= edges[0]:
                    steps.append((int(edges[np.searchsorted(edges, size, side="right") - 1]), ratio))
                for step, value in steps:
                    found[step, round(value, PLACES)] = found.get((step, round(value, PLACES)), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.float64()), pa.array(list(found.values()), pa.int64())], [*"abc"])

    # measures meet the ids, so that no text is shuffled and no table of ids broadcast
    bound_batches(docs.sparkSession)
    measures = docs.select(key, F.col(text_col).cast("string")).mapInArrow(measured, "_id long, size long, ratio double, pieces array<int>")
    own = measures.join(ids, "_id", "left_semi").select("size", "ratio", "pieces")
    counted = staged(own.mapInArrow(counts, "step long, ratio double, n long").groupBy("step", "ratio").agg(F.sum("n").alias("n")), "calibration")
    totals = {r["step"]: r["n"] for r in counted.groupBy("step").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return bands
    # of each step the values by thousandths first, then those of the thousandths that hold a wanted rank
    coarse = counted.groupBy("step", F.floor(F.col("ratio") * 1000).alias("bin")).agg(F.sum("n").alias("n")).collect()
    wanted, before = [], {}
    for step, n in totals.items():
        ranks = {k for q in (how.reject, 1 - how.reject) for k in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))}
        seen = 0
        for r in sorted((r for r in coarse if r["step"] == step), key=lambda r: r["bin"]):
            if any(seen <= k < seen + r["n"] for k in ranks):
                wanted.append((step, r["bin"]))
            else:
                before.setdefault(step, []).append((r["bin"] / 1000, r["n"]))
            seen += r["n"]
    bins = docs.sparkSession.createDataFrame(wanted, "step long, bin long")
    near = counted.withColumn("bin", F.floor(F.col("ratio") * 1000)).join(F.broadcast(bins), ["step", "bin"], "left_semi").collect()
    summaries = {}
    for step, n in totals.items():
        ordered = sorted(before.get(step, []) + [(r["ratio"], r["n"]) for r in near if r["step"] == step])
        summaries[step] = n, *(quantile_of(iter(ordered), n, q) for q in (how.reject, 1 - how.reject))
    return fitted_on_counts({k: v for k, v in summaries.items() if k >= 0}, summaries.get(-1), bands, how)


def _measure(bands: Bands, min_words: int, max_repeat: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands, min_words, max_repeat)
        kinds = [*[pa.int64()] * 6, pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        for batch in batches:
            rows = [(doc, *judge.of(text)) for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 11
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*"abcdefghijk"])

    return run


def corpus_bands(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Bands:
    """Bands calibrated on the rows of docs that the table ``labels`` calls good; the
    wide ones where there is no such table."""
    labels = table_if_there(spark, sf_dir, "labels")
    return Bands() if labels is None else calibrated(docs, labels.filter("quality = 1"))


def good_documents(docs: DataFrame, text_col: str = "text", bands: Bands = Bands(), min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The rows that quality_rules keeps, with all their columns: judged where they
    lie, so that no row is shuffled. Nulls, empty and very long texts, repeats, ties and
    an empty table are as in quality_rules; a null id is no reason to go."""

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(bands, min_words, max_repeat)
        for batch in batches:
            yield batch.filter(pa.array([judge.of(t)[-1] for t in values_of(batch.column(at))], pa.bool_()))

    bound_batches(docs.sparkSession)
    return map_rows(docs, run, list(docs.schema))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, zstd_ratio, n_chunks, n_bad_chunks, base_failed, kept.

    Words are runs of characters outside [\\x20\\x09-\\x0D]. base_failed: fewer
    than min_words words, or more than max_repeat percent of the words in 3-word
    windows that the text has twice or more. Else the compression bands decide:
    the whole text's ratio within the limits of its length, and at most half of
    its chunks outside theirs. Repetition compresses too well; encoded or random
    bytes too little; short texts compress badly, so their limits are wider.
    ``calibrated`` fits the bands to a corpus.

    Null is the empty text: no words, base_failed, ratio null. Lines and windows
    are compared by 64-bit hashes. Rows are independent of each other, so repeated rows
    and ids get the same values and there is no shuffle; a ratio at a limit is within.
    A text of any length is measured whole. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _measure(bands, min_words, max_repeat),
        f"{id_col} long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean",
    )
