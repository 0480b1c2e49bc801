"""Exact and near dedup, and the pipeline, against all pairs."""

import random

import numpy as np
import public_tokenizers
import pytest
from brute import ascii_lower, components, quality
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparsela.llm.components import connected_components
from sparsela.llm.exact_dedup import deduplicated, exact_dedup
from sparsela.llm.minhash import linking_pairs, near_duplicates, spanning_pairs
from sparsela.llm.quality import Judge, corpus_bands
from sparsela.llm.queries import QUERIES


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("weak", [False, True])
def test_exact(spark, weak):
    texts = ["A b", "a B", None, "", "É", "é", "x" * 100_000, "x" * 100_000, "same", "same", "same", "other"]
    rows = list(enumerate(texts))
    content_hash = (lambda c: F.lit("one hash")) if weak else F.md5
    got = {r["doc_id"]: r for r in exact_dedup(docs_of(spark, rows), keep="max", content_hash=content_hash).collect()}
    norm = {i: ascii_lower(t or "") for i, t in rows}
    for i, n in norm.items():
        same = [j for j in norm if norm[j] == n]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(same), len(same), i == max(same))


def test_exact_edges(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (None, "only")]
    got = sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs_of(spark, rows)).collect()), key=str)
    assert got == [(0, 1, 3, False), (0, None, 1, False), (1, 1, 3, True), (1, 1, 3, True)]
    assert exact_dedup(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
    clash = docs_of(spark, [(1, "a"), (2, "A")]).selectExpr("*", "9 as keep_id", "true as kept", "'q' as _h", "3 as _kept_id", "4 as _id", "5 as _row", "6 as _sha")
    assert [r["doc_id"] for r in deduplicated(clash).collect()] == [1]
    assert deduplicated(clash).columns == clash.columns


def test_deduplicated_tells_rows_apart_by_id_and_text(spark):
    rows = [(1, "a"), (2, "a"), (None, "unique"), (2, "b"), (1, "c"), (3, "r"), (3, "r"), (None, "n"), (None, "n"), (9, ""), (10, None)]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in deduplicated(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "a"), (0, "unique"), (2, "b"), (1, "c"), (3, "r"), (0, "n"), (9, "")], key=str)
    assert deduplicated(docs_of(spark, rows).limit(0)).count() == 0


def test_exact_is_native(spark):
    plan = exact_dedup(docs_of(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [3, 40, 1 << 20])
def test_components_in_one_task_or_in_rounds(spark, few):
    """Beyond ``few`` edges rounds take over, and a task gives its stars back in parts."""
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 250, (170, 2))] + [(5000 - k, 5001 - k) for k in range(60)] + [(7, 7), (None, 3)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            parent[max(top(a), top(b))] = min(top(a), top(b))
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    assert {r["node"]: r["root"] for r in connected_components(frame, few=few).collect()} == {x: top(x) for x in parent}


def test_components_take_few_steps(spark):
    """The driver keeps what it knows of every stage, so a small graph takes three jobs."""
    frame = spark.createDataFrame([(k, k + 1) for k in range(500)], "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    connected_components(frame)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 4


def test_near_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = components([tuple(r) for r in docs], 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_minhash"](spark, sf_dir).collect()}
    assert got == want


def planted(rng):
    """Groups around a centre, chains, copies, odd texts."""
    words = [f"w{i}" for i in range(3000)]
    rows, k = [], 0
    for size in (2, 5, 40, 150):
        base = rng.choices(words, k=150)
        for _ in range(size):
            t = list(base)
            for at in rng.sample(range(150), rng.randint(0, 8)):
                t[at] = rng.choice(words)
            rows.append((k, " ".join(t)))
            k += 1
    chain = rng.choices(words, k=120)
    for _ in range(25):
        for at in rng.sample(range(120), 3):
            chain[at] = rng.choice(words)
        rows.append((k, " ".join(chain).upper()))
        k += 1
    for t in [None, "", "  ", "a", "A", "a b", "one two three"] * 2:
        rows.append((k, t))
        k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shingle", "block"), [(2, 1024), (5, 1024), (2, 64)])
def test_near_planted(spark, shingle, block):
    rows = planted(random.Random(shingle))
    want = components(rows, shingle)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(docs_of(spark, rows), shingle_words=shingle, block=block, pivots=16).collect()}
    assert got == want


def test_near_edges(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 2, True)}
    assert near_duplicates(docs_of(spark, rows).limit(0)).count() == 0
    clash = docs_of(spark, [(1, "a b"), (2, "A B")]).selectExpr("*", "1 as bucket", "2 as class_id", "3 as kept", "4 as members", "5 as root")
    assert {r["component_id"] for r in near_duplicates(clash).collect()} == {1}


def test_spanning_pairs_are_linear():
    rng = np.random.default_rng(0)
    sketches = np.tile(rng.integers(0, 255, 150, dtype=np.uint8), (200, 1))
    ids = np.arange(200)
    assert len(spanning_pairs(ids, sketches, 0.7, 0.92, 3)) == 199
    assert spanning_pairs(ids, rng.integers(0, 255, (200, 150), dtype=np.uint8), 0.7, 0.92, 3) == []


def test_linking_pairs_join_components_only():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 1, 2, 40, 41, 300)]
    members = [(i, i, x) for i, x in enumerate(sets)]
    found = linking_pairs(members, members, 80)
    assert len(found) == 3 and {frozenset(p) for p in found} <= {frozenset(p) for p in ((0, 1), (0, 2), (1, 2), (3, 4))}
    assert linking_pairs([(0, 7, sets[0])], [(1, 7, sets[1])], 80) == []


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bands = corpus_bands(spark, docs, sf_dir)
    judge = Judge(bands, 50, 50)
    kept = {i: t for i, t in rows.items() if judge.of(t)[-1]}
    assert all((q := quality(t))[0] >= 50 and 100 * q[4] <= 50 * q[0] for t in kept.values())
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf_dir))
    ids = [{r["doc_id"] for r in f.select("doc_id").collect()} for f in frames]
    assert ids[1] == kept.keys()
    least = {}
    for i in sorted(ids[1]):
        least.setdefault(ascii_lower(rows[i]), i)
    assert ids[2] == set(least.values())
    near = components([(i, rows[i]) for i in ids[2]], 5)
    assert ids[3] == {i for i, (_, c) in near.items() if c == i}
    assert ids[4] == ids[3] == ids[5]
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert "@" not in "".join(r["text"] for r in frames[4].collect())
    texts = {r["doc_id"]: r["text"] for r in frames[4].collect()}
    pieces = {}
    for r in sorted(frames[5].collect(), key=lambda r: r["piece"]):
        pieces[r["doc_id"]] = pieces.get(r["doc_id"], b"") + bytes(r["ids"])
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, raw in pieces.items():
        assert np.frombuffer(raw, dtype="<u4").tolist() == [*t.encode(texts[i], add_special_tokens=False).ids, 0]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    prose = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120_000))
    rows = [(1, None), (2, ""), (3, prose), (3, prose), (None, prose + " more"), (None, None), (4, long), (5, prose.upper()), (6, prose + " end")]
    odd = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, _row string, `kept.x` int")
    docs = odd
    want = [[3, 3, None, 4, 5, 6], [None, 3, 4, 6], [None, 3, 4], [None, 3, 4]]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
        assert sorted((r["doc_id"] for r in docs.collect()), key=str) == sorted(ids, key=str), name
    last = corpus_pipeline.packed(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == {None, 3, 4} and max(r["piece"] for r in last) > 100
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0


def numbered(prefix, n):
    return [f"{prefix}{k}" for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_near_partner_among_many_lookalikes(spark, seed):
    # 300 texts at 0.783 to each other; one pair among them at 0.801
    common = numbered(f"s{seed}c", 394)
    rows = [(i, " ".join(common + numbered(f"s{seed}d{i}w", 54))) for i in range(300)]
    rows.append((300, " ".join(common + numbered(f"s{seed}d150w", 5) + numbered(f"s{seed}d300w", 49))))
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs_of(spark, rows)).collect()}
    assert got == {i: i for i in range(300)} | {300: 150}


@pytest.mark.parametrize("k", [1041, 2633, 4052])
def test_near_pair_whose_sketches_disagree(spark, k):
    # similarity 0.804, several shared bands, but only 102 of 150 minima are equal
    rng = random.Random(k)
    common = [f"w{rng.randrange(10**9)}" for _ in range(94)]
    rows = [(1, " ".join(common + [f"x{k}i{i}" for i in range(11)])), (2, " ".join(common + [f"y{k}i{i}" for i in range(11)]))]
    assert {r["component_id"] for r in near_duplicates(docs_of(spark, rows)).collect()} == {1}


def test_pipeline_keeps_documents_without_id(spark, sf_dir):
    import corpus_pipeline

    rows = docs_of(spark, [(None, "only"), (None, "twice"), (None, "twice"), (None, "a"), (1, "a")])
    exact = corpus_pipeline.exact(spark, rows, sf_dir)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact.collect()) == [(0, "only"), (0, "twice"), (1, "a")]
    assert corpus_pipeline.near(spark, exact, sf_dir).count() == 3
