"""Tokens: counting, pieces, packing, archives."""

import hashlib
import base64
import random
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparsela.llm.blobs import read_blobs, write_blobs
from sparsela.llm.encoding import ByteBpe, default_vocabulary
from sparsela.llm.packing import best_fit_pack, plan
from sparsela.llm.queries import QUERIES
from sparsela.llm.sentencepieces import UnigramModel, default_model, read_pieces, sentencepiece_decode, sentencepiece_encode
from sparsela.llm.token_counts import count_document_tokens, token_counts, write_token_files
from sparsela.llm.warc import frame_end, parse_record, read_archive, read_warc, record, write_warc

HARD = [None, "", " ", "  a  b ", "\n\n x\ty ", "a b", "ends ", "tab\t \tx", "x <|endoftext|> y", "é漢字🙂 ok", "a" * 5000, "1 2  3", "don't  stop\x1c x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def literal():
    """Strings of special tokens are ordinary text, as in token files."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_encoding_is_the_tokenizers(tokenizer, literal, spark, sf_dir):
    texts = HARD + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rng = random.Random(2)
    texts += ["".join(rng.choices("ab \n\t'1!. é", k=60)) for _ in range(2000)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "漢<|endoftext|>"]
    for library, mine in ((tokenizer, ByteBpe(default_vocabulary())), (literal, ByteBpe(default_vocabulary(), literal=True))):
        want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert all(a.tolist() == b.ids for a, b in zip(mine.encode(texts), want, strict=True))
    assert ByteBpe(default_vocabulary()).one("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_token_counts(spark, sf_dir, literal):
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op1_token_counts"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r[0]: len(x.ids) for r, x in zip(rows, literal.encode_batch([r[1] for r in rows], add_special_tokens=False), strict=True)}


def test_token_counts_edges(spark, literal):
    long = "some words " * 200_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x <|endoftext|> y"), (3, "x <|endoftext|> y"), (4, long), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as name", "2 as stream", "3 as n_tokens", "4 as content")
    got = sorted(((r["doc_id"] or 0, r["n_tokens"]) for r in count_document_tokens(docs).collect()))
    assert got == sorted((i or 0, len(literal.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert count_document_tokens(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("file_tokens", "block"), [(7, 3), (1000, 5), (64, 64), (10, 1000)])
def test_boundaries_are_stitched(spark, tmp_path, tokenizer, file_tokens, block):
    texts = [None, "one two three", "", "", "a b c d e f g h i j", "x"]
    write_token_files(docs_of(spark, texts).coalesce(1), f"{tmp_path}/t", file_tokens=file_tokens)
    rows = token_counts(spark, f"{tmp_path}/t", block_tokens=block).orderBy("doc_no").collect()
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["n_tokens"] for r in rows] == sizes and all(r["terminated"] for r in rows)
    assert [r["start"] for r in rows] == [sum(sizes[:i]) + i for i in range(len(sizes))]
    assert [r["doc_no"] for r in rows] == list(range(len(sizes)))


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_documents_cross_files_and_the_last_may_be_open(spark, tmp_path, block):
    ids = [5, 50256, 6, 7, 8, 9, 10, 50256, 50256, 11, 12]
    raw = [np.array(x, dtype="<u4").tobytes()[:-1] for x in (ids[:3], ids[3:4], ids[4:7], ids[7:9], ids[9:])]
    files = spark.createDataFrame([(bytearray(x),) for x in raw], "content binary").coalesce(1)
    write_blobs(files, "content", "\0", f"{tmp_path}/t")
    rows = token_counts(spark, f"{tmp_path}/t", block_tokens=block, dtype="<u4").orderBy("doc_no").collect()
    assert [(r["start"], r["n_tokens"], r["terminated"]) for r in rows] == [(0, 1, True), (2, 5, True), (8, 0, True), (9, 2, False)]


def test_blobs_round_trip(spark, tmp_path):
    raw = bytes(range(256)) * 3
    write_blobs(spark.createDataFrame([(bytearray(raw),)], "content binary"), "content", "\n", f"{tmp_path}/b")
    assert [bytes(r["content"]) for r in read_blobs(spark, f"{tmp_path}/b").collect()] == [raw + b"\n"]


def varint(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def message(number, kind, value):
    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else varint(value) if kind == 0 else value)


@pytest.fixture(scope="module")
def unigram():
    """The same pieces and scores as a unigram model of the public library."""
    pieces = read_pieces(default_model())
    raw = b"".join(message(1, 2, message(1, 2, p.encode()) + message(2, 5, struct.pack("<f", s)) + message(3, 0, k)) for p, s, k in pieces)
    raw += message(2, 2, message(3, 0, 1) + message(35, 0, 1) + message(40, 0, 0) + message(41, 0, 1) + message(42, 0, 2) + message(43, 0, (1 << 64) - 1))
    raw += message(3, 2, message(1, 2, b"identity") + message(3, 0, 1) + message(4, 0, 0) + message(5, 0, 1))
    model = UnigramModel(pieces)
    model.start()
    return model, sentencepiece.SentencePieceProcessor(model_proto=raw), np.array([s for _, s, _ in pieces])


def test_viterbi_against_the_library(unigram, spark, sf_dir):
    mine, theirs, scores = unigram
    texts = [t for t in HARD if t] + [r[0] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    words = sorted({w for t in texts for w in t.split()})
    same = 0
    for w, a, b in zip(words, mine.encode(words), theirs.encode(words), strict=True):
        assert abs(scores[a].sum() - scores[b].sum()) < 1e-3, w
        same += a.tolist() == b
    assert same >= 0.99 * len(words)
    for t, a in zip(texts, mine.encode(texts), strict=True):
        assert mine.decode(a) == t == theirs.decode(a.tolist())


def test_long_words_take_the_same_path(unigram):
    mine, _, _ = unigram
    word = "inter" * 18
    raw = ("▁" + word).encode()
    assert len(raw) <= 96 and mine._one(raw) == mine._many([raw])[0]
    assert mine.decode(mine.encode(["ab" * 60_000])[0]) == "ab" * 60_000


def test_sentencepiece_frames(spark, sf_dir):
    rows = sentencepiece_encode(docs_of(spark, HARD), with_ids=True)
    got = sentencepiece_decode(rows.select("doc_id", "ids")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [t or "" for t in HARD]
    assert all(r["round_trip"] for r in QUERIES["op2_sentencepiece"](spark, sf_dir).collect())
    assert sentencepiece_encode(docs_of(spark, []).limit(0)).count() == 0


def test_sentencepiece_keeps_other_columns(spark):
    docs = docs_of(spark, ["a b", None, "a b"]).selectExpr("*", "1 as n_pieces", "2 as ids", "3 as _ids")
    rows = sentencepiece_encode(docs, with_ids=True)
    clash = rows.selectExpr("doc_id", "ids", "7 as _ids", "'t' as text", "8 as `a.b`")
    clash = clash.unionByName(clash.filter("doc_id = 0").withColumn("ids", F.lit(None).cast("binary")))
    got = sentencepiece_decode(clash).collect()
    assert sorted(str(r["text"]) for r in got) == ["", "None", "a b", "a b"]
    assert all(r["_ids"] == 7 and r["a.b"] == 8 for r in got)


def test_word_cache_is_bounded_by_bytes(unigram):
    mine, _, _ = unigram
    mine.start()
    for k in range(30):
        mine.encode([" ".join(f"w{k}x{j}" for j in range(100)), "y" * 5000])
        assert all(len(p.encode()) <= 96 for p in mine.known)
    old, mine.MOST = mine.MOST, 1000
    mine.encode(["some new words " * 3])
    mine.encode(["other"])
    assert len(mine.known) < 10
    mine.MOST = old


def test_packing_is_gapless_and_whole(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = QUERIES["op8_best_fit_packing"](spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length >= 1
            at += length
        assert at <= 2048
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at) and (length == 2048 or k == 0)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= 1.02 * -(-total // 2048) + 2


def test_plan_against_item_by_item():
    rng = random.Random(3)
    for capacity in (10, 30, 100):
        for _ in range(60):
            counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 200)))
            bins, left = [], Counter(counts)
            for a in sorted((x for x in counts if 3 * x > capacity), reverse=True):
                while left[a]:
                    left[a] -= 1
                    fit = [b for b in left if left[b] and b <= capacity - a and 3 * b > capacity and b <= a]
                    if fit:
                        left[max(fit)] -= 1
                    bins.append(capacity - a - (max(fit) if fit else 0))
            for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
                for _ in range(counts[s]):
                    fit = [g for g in bins if g >= s]
                    if fit:
                        bins.remove(min(fit))
                        bins.append(min(fit) - s)
                    else:
                        bins.append(capacity - s)
            runs = plan(dict(counts), capacity)
            assert sum(r.n for r in runs) == len(bins)
            placed = Counter()
            for r in runs:
                assert sum(x[0] for x in r.items) + r.gap == capacity and r.gap >= 0
                for length, first, _ in r.items:
                    for k in range(first, first + r.n):
                        placed[length, k] += 1
            assert placed == Counter({(x, k): 1 for x, n in counts.items() for k in range(n)})
    assert plan({}, 10) == []


def test_packing_edges(spark):
    rows = best_fit_pack(docs_of(spark, [None, "", "a b"]).withColumnRenamed("doc_id", "doc_id"), with_ids=True).collect()
    assert sorted(r["length"] for r in rows) == [1, 1, 3] and len({r["sequence_id"] for r in rows}) == 1
    assert best_fit_pack(docs_of(spark, []).limit(0)).count() == 0


def test_packing_of_special_strings_long_texts_repeats_and_clashes(spark, tokenizer):
    long = "many words here " * 30_000
    rows = [(1, "a <|endoftext|> b"), (1, "a <|endoftext|> b"), (2, long), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "3 as part", "4 as ids")
    got = best_fit_pack(docs, with_ids=True).collect()
    assert sorted(r["length"] for r in got if r["doc_id"] == 1) == [5, 5] and sum(r["doc_id"] is None for r in got) == 1
    raw = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == 2), key=lambda r: r["piece"]))
    assert np.frombuffer(raw, dtype="<u4").tolist() == [*tokenizer.encode(long, add_special_tokens=False).ids, 0]


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_warc_query(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    rows = QUERIES["op3_warc"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        payload = pages[r["page_id"]]
        own = first[payload] == r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(payload), b32(payload), "response" if own else "revisit", None if own else first[payload])
        assert r["valid"], r["problem"]


def test_warc_edges(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (5, "u\r\nX: y", "b\r\n\r\nc"), (3, "u", "same"), (4, "v", "same"), (None, "w", "same"), (4, "v", "same")], "page_id long, url string, html string")
    write_warc(pages, f"{tmp_path}/w")
    rows = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read_warc(spark, f"{tmp_path}/w").collect()}
    assert rows == {(1, "response", None, 0), (2, "revisit", 1, 0), (5, "response", None, 6), (3, "response", None, 4), (4, "revisit", 3, 4), (None, "revisit", 3, 4)}
    write_warc(pages, f"{tmp_path}/v", min_payload=1)
    assert {r["record_type"] for r in read_warc(spark, f"{tmp_path}/v").filter("payload_bytes = 0").collect()} == {"response"}
    write_warc(pages.limit(0), f"{tmp_path}/e")
    assert read_warc(spark, f"{tmp_path}/e").count() == 0
    long = spark.createDataFrame([(1, "u", "x" * 5_000_000), (2, "u", "y")], "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as size", "4 as id")
    write_warc(long, f"{tmp_path}/l")
    assert {r["payload_bytes"]: r["valid"] for r in read_warc(spark, f"{tmp_path}/l").collect()} == {5_000_000: True, 1: True}


def test_archives_have_dictionaries_and_frames(spark, tmp_path, sf_dir):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").coalesce(1)
    write_warc(pages, f"{tmp_path}/w", archive_bytes=150_000)
    blobs = [bytes(r["content"]) for r in read_blobs(spark, f"{tmp_path}/w").collect()]
    assert len(blobs) > 1 and any(b[:4] == bytes.fromhex("5d2a4d18") for b in blobs)
    for b in blobs:
        at = 0
        while at < len(b):
            at = frame_end(b, at)
        assert at == len(b)
        records = [raw for _, v, raw in read_archive(b) if v["problem"] is None]
        assert records and all(raw.startswith(b"WARC/1.1\r\n") for raw in records)


def test_broken_archives_are_told():
    good = record(7, "http://x", b"payload", None, "1970-01-01T00:00:00Z")
    assert parse_record(good)["problem"] is None
    assert parse_record(good.replace(b"payload\r\n", b"payloaX\r\n"))["problem"] == "block digest"
    assert parse_record(good[:-1])["problem"] == "length"
    assert parse_record(good.replace(b"WARC-Date", b"X-Date"))["problem"] == "without warc-date"
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(good)
    assert [v["problem"] for _, v, _ in read_archive(frame + frame[:-3])] == [None, "frame: cut off"]
    stream = zstandard.ZstdCompressor().compressobj()
    unsized = stream.compress(good) + stream.flush()
    assert zstandard.frame_content_size(unsized) < 0 and [v["problem"] for _, v, _ in read_archive(unsized + frame)] == [None, None]
    assert "frame" in list(read_archive(b"junkjunk"))[0][1]["problem"]
