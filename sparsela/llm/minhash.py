"""MinHash near-dedup: universal hash minima, banding, verification, components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PRUNE_TEXTS, SpanHasher, bound_batches, discard, mix64, settings, shingle_set, staged, values_of, white_space
from .components import connected_components

SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash a*x+b mod 2**64 over the values."""
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(values), 512):
        block = a[:, None] * values[None, k : k + 512]
        block += b[:, None]
        np.minimum(out, block.min(axis=1), out=out)
    return out


def _set_key(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _sketcher(k: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        n = bands * rows
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        hasher, space = SpanHasher(fold=True), white_space()
        for batch in batches:
            sizes, keys, band_keys, sketches = [], [], [], []
            for text in values_of(batch.column(1)):
                values = shingle_set(text, k, hasher, space)
                sizes.append(len(values))
                if len(values) == 0:
                    keys.append(None)
                    band_keys.append([])
                    sketches.append(None)
                    continue
                keys.append(_set_key(values))
                low = _minima(values, a, b)
                folded = salt.copy()
                for j in range(rows):
                    folded = mix64(folded * np.uint64(0x9E3779B97F4A7C15) + low[j::rows])
                band_keys.append(folded.view(np.int64))
                sketches.append((mix64(low) >> np.uint64(56)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    return run


def _sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, space = SpanHasher(fold=True), white_space()
        for batch in batches:
            keys, sets = [], []
            for text in values_of(batch.column(1)):
                values = shingle_set(text, k, hasher, space)
                keys.append(_set_key(values))
                sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "set_key", "members"])

    return run


def spanning_pairs(ids: np.ndarray, sketches: np.ndarray, cut: float, sure: float, best: int) -> list[tuple[int, int]]:
    """Proposed links of one block, linear in its size.

    Grows a maximum spanning tree over the estimated similarities (Prim). A member
    joins by its closest partner in the tree; unless that one is surely similar,
    its next ones at or above the cut come along, ``best`` in all. For exact
    similarities such a tree has the same components as all links together.
    """
    n = len(ids)
    if n == 2:
        return [(int(ids[0]), int(ids[1]))] if (sketches[0] == sketches[1]).mean() >= cut else []
    out: list[tuple[int, int]] = []
    near = np.full((best, n), -1.0, dtype=np.float32)
    who = np.zeros((best, n), dtype=np.int64)
    left = np.ones(n, dtype=bool)
    width = sketches.shape[1]
    for _ in range(n):
        top = int(np.argmax(np.where(left, near[0], -2.0)))
        for slot in range(best):
            if near[slot, top] < cut or (slot and near[0, top] >= sure):
                break
            out.append((int(ids[top]), int(ids[who[slot, top]])))
        left[top] = False
        rest = np.flatnonzero(left)
        like = (sketches[rest] == sketches[top]).sum(axis=1, dtype=np.int32).astype(np.float32) / width
        whom = np.full(len(rest), top, dtype=np.int64)
        for slot in range(best):
            old, old_who = near[slot, rest], who[slot, rest]
            take = like > old
            near[slot, rest], who[slot, rest] = np.where(take, like, old), np.where(take, whom, old_who)
            like, whom = np.where(take, old, like), np.where(take, old_who, whom)
            if not (like >= 0).any():
                break
    return out


def _batch_of_pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], ["a", "b"])


def _pairs_of_blocks(cut: float, sure: float, best: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        sketches: list[bytes] = []
        last = None

        def close() -> pa.RecordBatch:
            found = []
            if len(ids) > 1:
                found = spanning_pairs(np.array(ids, dtype=np.int64), np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(ids), -1), cut, sure, best)
            ids.clear()
            sketches.clear()
            return _batch_of_pairs(found)

        for batch in batches:
            for bucket, block, i, sketch in zip(*(batch.column(j).to_pylist() for j in range(3)), values_of(batch.column(3)), strict=True):
                if (bucket, block) != last:
                    yield close()
                    last = (bucket, block)
                ids.append(i)
                sketches.append(sketch)
        yield close()

    return run


def _verifier(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for pair in zip(*(values_of(batch.column(j)) for j in range(4)), strict=True):
                x, y = (np.frombuffer(v, dtype=np.uint64) for v in pair[2:])
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                shared = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                if 100 * shared >= percent * (len(x) + len(y) - shared) and shared:
                    keep.append(pair[:2])
            yield _batch_of_pairs(keep)

    return run


def linking_pairs(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members (id, root, set) of two blocks, by their full sets.

    Every pair of different roots is compared; of the links found those come back
    that join two components not yet joined here, which has the same components.
    """
    names = {r: k for k, r in enumerate(dict.fromkeys(m[1] for m in (*left, *right)))}
    comp = np.arange(len(names))
    at = np.array([names[m[1]] for m in right])
    sizes = np.array([len(m[2]) for m in right])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    values, flat = np.unique(np.concatenate([m[2] for m in right]), return_inverse=True)
    mark = np.zeros(len(values), dtype=np.int32)
    out: list[tuple[int, int]] = []
    for i, root, own in left:
        n = len(own)
        if not ((comp[at] != comp[names[root]]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))).any():
            continue
        where = np.minimum(np.searchsorted(values, own), len(values) - 1)
        where = where[values[where] == own]
        mark[where] = 1
        shared = np.add.reduceat(mark[flat], starts)
        mark[where] = 0
        linked = 100 * shared >= percent * (n + sizes - shared)
        for j in np.flatnonzero(linked & (comp[at] != comp[names[root]])).tolist():
            if comp[at[j]] != comp[names[root]]:
                out.append((max(i, right[j][0]), min(i, right[j][0])))
                comp[comp == comp[at[j]]] = comp[names[root]]
    return out


def _links_of_tasks(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        last = None

        def close() -> pa.RecordBatch:
            found = linking_pairs(*sides, percent) if all(sides) else []
            for side in sides:
                side.clear()
            return _batch_of_pairs(found)

        for batch in batches:
            for group, p, q, left, right, i, root, values in zip(*(batch.column(j).to_pylist() for j in range(7)), values_of(batch.column(7)), strict=True):
                if (group, p, q) != last:
                    yield close()
                    last = (group, p, q)
                member = (i, root, np.frombuffer(values, dtype=np.uint64))
                if left:
                    sides[0].append(member)
                if right:
                    sides[1].append(member)
        yield close()

    return run


def _compared(tasks: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Links within tasks(grp, p, q, left, right, doc_id, root), by full sets."""
    with settings(sets.sparkSession, PRUNE_TEXTS):
        return staged(
            tasks.join(sets, "doc_id").select("grp", "p", "q", "left", "right", "doc_id", "root", "members")
            .repartition("grp", "p", "q").sortWithinPartitions("grp", "p", "q")
            .mapInArrow(_links_of_tasks(percent), "a long, b long").distinct(),
            label,
        )


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    at = members.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return at.withColumn("root", F.coalesce("root", "doc_id"))


def _blocks_of(rows: DataFrame, key: str, block: int, weight: int) -> DataFrame:
    """rows with the number of blocks of their key (n_blocks), each of about
    ``block`` rows and ``weight`` shingles at most, and their own (at)."""
    n = rows.groupBy(key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n_shingles") / weight)).cast("long").alias("n_blocks"))
    return rows.join(n, key).withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(1)), "n_blocks"))


def _unlinked(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members outside the largest component (main) of their bucket."""
    at = _rooted(members, roots)
    counts = at.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    # written first, so that the join below is one that Spark can split at a hot bucket
    main = staged(
        counts.groupBy("bucket").agg(F.max(F.struct("c", F.bitwise_not("root").alias("r"))).alias("top"), F.count(F.lit(1)).alias("k"))
        .filter("k > 1").select("bucket", F.bitwise_not("top.r").alias("main")),
        "minhash-mains",
    )
    return at.join(main, "bucket")


def _with_main(open_: DataFrame, block: int, weight: int) -> DataFrame:
    """Tasks in which every member outside the main component of a bucket meets all
    members that the main component has in such buckets. A component is met once,
    whatever the number of buckets it is in."""
    outside = _blocks_of(open_.filter("root <> main").select("main", "doc_id", "root", "n_shingles").distinct(), "main", block, weight)
    inside = _blocks_of(open_.filter("root = main").select("main", "doc_id", "root", "n_shingles").distinct(), "main", block, weight)
    n_left = outside.select("main", F.col("n_blocks").alias("n")).distinct()
    n_right = inside.select("main", F.col("n_blocks").alias("n")).distinct()

    def every(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    left = outside.join(n_right, "main").select(F.col("main").alias("grp"), F.col("at").alias("p"), every("n").alias("q"), F.lit(True).alias("left"), F.lit(False).alias("right"), "doc_id", "root")
    right = inside.join(n_left, "main").select(F.col("main").alias("grp"), every("n").alias("p"), F.col("at").alias("q"), F.lit(False).alias("left"), F.lit(True).alias("right"), "doc_id", "root")
    return left.unionByName(right)


def _among_outside(outside: DataFrame, roots: DataFrame, block: int, weight: int) -> DataFrame:
    """Tasks in which the members outside the main component of a bucket meet each
    other, where these are still of several components. Buckets with the same
    members are one."""
    at = _rooted(outside.select("bucket", "doc_id", "n_shingles"), roots)
    several = (
        at.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("print"))
        .filter("lo < hi").groupBy("n", "print", "lo", "hi").agg(F.min("bucket").alias("bucket")).select("bucket")
    )
    rows = _blocks_of(at.join(several, "bucket"), "bucket", block, weight)
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    return other.select(
        F.col("bucket").alias("grp"), F.least("at", "other").alias("p"), F.greatest("at", "other").alias("q"),
        (F.col("at") <= F.col("other")).alias("left"), (F.col("at") >= F.col("other")).alias("right"), "doc_id", "root",
    )


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links."""
    if links.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 30,
    rows: int = 5,
    first_bands: int = 8,
    block: int = 512,
    pivots: int = 32,
    block_shingles: int = 1 << 20,
) -> DataFrame:
    """One row per input row: id, n_shingles, class_id, component_id, kept.

    Words are runs of bytes other than [\\x20\\x09-\\x0D], A-Z lower-cased; a
    document's set is its distinct shingles of ``shingle_words`` words. Two
    documents are linked when 100*|A & B| >= percent*|A | B|; component_id is the
    smallest id reachable by links, class_id the smallest id with an equal set.

    1. Each text is read once: set size, a 128-bit digest of the set, bands*rows
       universal hash minima folded into band keys, and a one-byte sketch of each
       minimum. The table is written to shared storage.
    2. Documents with equal sets collapse to their smallest id.
    3. Band keys with two different sets or more are buckets. Buckets with the
       same members are one. The full sets of the documents in buckets are written
       once, from a second reading of their texts.
    4. Proposals: in the buckets of the ``first_bands`` first bands a maximum spanning
       tree over sketch similarities proposes pairs, a few for each member. A
       bucket larger than ``block`` is split by hash into blocks which all see the
       same ``pivots`` members. The full sets confirm, and components are found by
       alternating large-star and small-star. This is linear in the members and
       only saves work: what it leaves out is found next.
    5. The rest is exact. In every bucket, of whatever band, that still has several
       components, each member outside the largest one meets all members of the
       largest, and then all others outside that are not yet in its component. They
       meet in tasks of two blocks (``block`` members and ``block_shingles`` shingles
       each, about), which compare full sets and give back only links that join two
       components. So any linked pair that shares a bucket is in one component, with
       no bound on partners, sketches or bucket size. The cost is the members
       outside times the members: small where proposals have done their work, and
       quadratic for a crowd of look-alikes below the limit.

    With 150 minima in 30 bands, a pair at exactly the limit shares no bucket in
    one case of 150,000, at five points above it in one of 40 million.

    Null or empty text and text of white space alone has the empty set, and is
    linked with nothing. A very long text is read whole. A row with a null id is its
    own component (null) and is kept. Rows that repeat an id with the same text get
    the same values; an id with several texts is one node with the links of all. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bound_batches(spark)
    sketch = staged(whole.mapInArrow(_sketcher(shingle_words, bands, rows), SKETCH), "minhash")
    known = sketch.filter("set_key is not null and doc_id is not null")
    digest = F.xxhash64("set_key")
    classes = staged(known.groupBy("set_key").agg(F.min("doc_id").alias("class_id")).withColumn("print", digest), "minhash-classes")
    # All bands of all documents pass two shuffles, as three numbers a row; keys,
    # sketches and sets join those that share a bucket.
    buckets = staged(
        known.select(digest.alias("print"), F.explode("bands").alias("bucket"))
        .groupBy("bucket").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo < hi").select("bucket"),
        "minhash-buckets",
    )
    with settings(spark, PRUNE_TEXTS):
        found = staged(
            known.select(digest.alias("print"), F.posexplode("bands").alias("band", "bucket"))
            .join(buckets, "bucket")
            .groupBy("bucket", "print").agg(F.min("band").alias("band"))
            .join(classes.select("print", F.col("class_id").alias("doc_id")), "print")
            .select("bucket", "band", "doc_id"),
            "minhash-found",
        )
        distinct = staged(
            found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.bit_xor(F.xxhash64("doc_id")).alias("print"), F.min("band").alias("band"))
            .filter("n > 1")
            .groupBy("n", "least", "print").agg(F.min(F.struct("band", "bucket")).alias("first"))
            .select("first.bucket", "first.band", "n"),
            "minhash-distinct",
        )
        placed = staged(found.drop("band").join(distinct, "bucket"), "minhash-placed")
        chosen = placed.select("doc_id").distinct()
        heads = staged(classes.select("set_key", F.col("class_id").alias("doc_id")).join(chosen, "doc_id", "left_semi"), "minhash-heads")
        sets = staged(
            whole.join(heads.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, set_key binary, members binary")
            .join(heads, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]).select("doc_id", "members"),
            "minhash-sets", compression="none",
        )
        sketches = known.select("doc_id", "set_key", "n_shingles", "sketch").join(heads, ["doc_id", "set_key"], "left_semi").dropDuplicates(["doc_id", "set_key"]).drop("set_key")
        members = staged(placed.join(sketches, "doc_id"), "minhash-members")
        thin = staged(sketch.select("doc_id", "n_shingles", "set_key"), "minhash-thin")

    parts = F.ceil(F.col("n") / F.lit(block)).cast("long")
    pivot = F.pmod(F.xxhash64("bucket", "doc_id"), F.col("n")) < pivots
    blocks = members.filter(F.col("band") < first_bands).select(
        "bucket",
        F.explode(
            F.when((parts > 1) & pivot, F.sequence(F.lit(0).cast("long"), parts - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("doc_id", "bucket"), parts)))
        ).alias("block"),
        "doc_id", "sketch",
    )
    with settings(spark, PRUNE_TEXTS):
        pairs = staged(
            blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "doc_id")
            .mapInArrow(_pairs_of_blocks(percent / 100 - 0.11, percent / 100 + 0.12, 2), "a long, b long").distinct(),
            "minhash-pairs",
        )
        first = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("set_a"))
        second = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("set_b"))
        links = staged(
            pairs.join(first, "a").join(second, "b").select("a", "b", "set_a", "set_b").mapInArrow(_verifier(percent), "a long, b long").distinct(),
            "minhash-links",
        )
    roots = connected_components(links)
    open_ = staged(_unlinked(members.select("bucket", "doc_id", "n_shingles"), roots), "minhash-open")
    if not open_.isEmpty():
        more = _compared(_with_main(open_, block, block_shingles), sets, percent, "minhash-main")
        roots = _joined(roots, more)
        more = _compared(_among_outside(open_.filter("root <> main"), roots, block, block_shingles), sets, percent, "minhash-outside")
        roots = _joined(roots, more)
    discard(sketch, buckets, found, distinct, placed, heads, sets, members, pairs, links, open_)
    out = (
        thin.join(classes, "set_key", "left")
        .join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    )
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("root", "class_id", "doc_id"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
