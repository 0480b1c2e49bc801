"""Best-fit packing of token pieces into sequences, by large-item matching."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, staged, values_of
from .encoding import byte_bpe, default_vocabulary


class Run:
    """``n`` bins filled alike: for each item its length, first rank and offset."""

    __slots__ = ("gap", "items", "n")

    def __init__(self, n: int, gap: int, items: list[tuple[int, int, int]]) -> None:
        self.n, self.gap, self.items = n, gap, items

    def split(self, k: int) -> Run:
        """Takes the first k bins off into a run of their own."""
        head = Run(k, self.gap, self.items)
        self.items = [(length, rank + k, at) for length, rank, at in self.items]
        self.n -= k
        return head

    def put(self, length: int, rank: int, capacity: int) -> None:
        self.items = [*self.items, (length, rank, capacity - self.gap)]
        self.gap -= length


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Bins for counts[length] items of each length from 1 to capacity.

    Items above a third of the capacity share a bin in pairs at most: from the
    largest down, each takes the largest partner that still fits. The others, from
    the largest down, go to the smallest gap that holds them, into a new bin if
    none does. Works on runs of equal bins: its time depends on the number of
    lengths, not of items, and it gives at most a few runs per length.
    """
    left = {k: v for k, v in counts.items() if v}
    if left and not 1 <= min(left) <= max(left) <= capacity:
        raise ValueError("an item's length must be between 1 and the capacity")
    rank = dict.fromkeys(left, 0)

    def take(length: int, n: int) -> int:
        first = rank[length]
        rank[length] += n
        left[length] -= n
        return first

    large = sorted(k for k in left if 3 * k > capacity)
    runs: dict[int, list[Run]] = {}
    gaps: list[int] = []

    def keep(run: Run) -> None:
        if run.gap not in runs:
            runs[run.gap] = []
            bisect.insort(gaps, run.gap)
        runs[run.gap].append(run)

    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect.bisect_right(large, min(a, capacity - a)) - 1
        while i >= 0 and (left[large[i]] == 0 or (large[i] == a and left[a] < 2)):
            i -= 1
        if i < 0:
            n = left[a]
            run = Run(n, capacity, [])
            run.put(a, take(a, n), capacity)
        else:
            b = large[i]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            run = Run(n, capacity, [])
            run.put(a, take(a, n), capacity)
            run.put(b, take(b, n), capacity)
        keep(run)
    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[s]:
            i = bisect.bisect_left(gaps, s)
            if i == len(gaps):
                each = capacity // s
                keep(Run(max(1, left[s] // each), capacity, []))
                i = len(gaps) - 1
            g = gaps[i]
            run = runs[g].pop()
            if not runs[g]:
                del runs[g]
                gaps.pop(i)
            each = min(g // s, left[s])
            n = min(run.n, left[s] // each)
            if n < run.n:
                head = run.split(n)
                keep(run)
                run = head
            for _ in range(each):
                run.put(s, take(s, n), capacity)
            keep(run)
    return [r for g in gaps for r in runs[g]]


def _pieces(vocabulary: str, capacity: int, end: int, stored: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = byte_bpe(vocabulary)
        seen: dict[int, int] = {}
        mark = np.array([end], dtype="<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                flat = np.concatenate((encoder.one(text), mark))
                first = len(flat) % capacity or capacity
                edges = [0, *range(first, len(flat) + 1, capacity)]
                for piece, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    nth = seen.get(y - x, 0)
                    seen[y - x] = nth + 1
                    raw = flat[x:y].tobytes()
                    rows.append((doc, piece, x, y - x, zlib.crc32(raw), part, nth, flat[x:y].astype(stored).tobytes() if stored else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*"abcdefgh"])

    return run


def _placer(keys: np.ndarray, sequences: np.ndarray, offsets: np.ndarray, stored: str | None) -> Callable:
    shift = 48

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, (length << shift) + rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << shift) - 1))
            rest = [batch.column(j) for j in range(2, batch.num_columns)]
            if stored:
                rest[-1] = pa.array([np.frombuffer(x, dtype=stored).astype("<u4").tobytes() for x in values_of(rest[-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([*rest, batch.column(0), pa.array(sequence), pa.array(offsets[at])], [str(j) for j in range(len(rest) + 3)])

    return run


def best_fit_pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end: int = 0,
    vocabulary: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with_ids the little-endian 32-bit ids themselves.

    A document is its byte-level BPE ids (special tokens' strings are these tokens) and
    the id ``end``; null and empty text is one piece of one id. Only documents above the
    capacity, however long, are cut: into pieces of the capacity but for the first. Rows
    that repeat are packed each for itself; null ids are carried along. An empty table
    gives no rows. Other columns are ignored, whatever their names.

    The texts are encoded once and the pieces written to shared storage, each with
    its task and its number among that task's pieces of equal length. The number
    of pieces of each length (at most ``capacity`` numbers) determines the whole
    packing, which ``plan`` makes on the driver as runs of equal bins: as good as
    packing all pieces together, and of bounded size. Prefix sums over the tasks
    turn a piece's number into its rank among all pieces of its length; the rank
    finds the run, the sequence and the offset. Nothing is sorted or collected by
    document, and the hot length (the capacity itself) needs no single task.
    """
    bound_batches(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    # on their way the ids take two bytes, where the vocabulary allows it
    stored = ("<u2" if max(end + 1, byte_bpe(vocabulary).size) <= 1 << 16 else "<u4") if with_ids else None
    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _pieces(vocabulary, capacity, end, stored),
        "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids binary",
    )
    pieces = staged(pieces if with_ids else pieces.drop("ids"), "pieces")
    by_task = staged(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, sequence = [], 0
    for run in plan(counts, capacity):
        slots += [((length << 48) + first, sequence, at) for length, first, at in run.items]
        sequence += run.n
    slots.sort()
    keys, sequences, offsets = (np.array([s[j] for s in slots], dtype=np.int64) for j in range(3))
    rest = ["doc_id", "piece", "start", "ids_crc32", *(["ids"] if with_ids else [])]
    # merged, whatever its size: the prefix sums grow with the tasks
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).select("length", (F.col("base") + F.col("nth")).alias("rank"), *rest)
    placed = ranked.mapInArrow(
        _placer(keys, sequences, offsets, stored),
        "doc_id long, piece int, start long, ids_crc32 long, " + ("ids binary, " if with_ids else "") + "length long, sequence_id long, offset long",
    )
    return placed.select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
