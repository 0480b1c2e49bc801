"""Token counts by a separator scan over flat token files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs
from .common import bound_batches, shared_path, staged, values_of
from .encoding import byte_bpe, default_vocabulary

END_OF_DOCUMENT = 50256


#: The writer's format: two bytes an id, the higher first.
IDS = ">u2"


#: A document's id in the files that name a token file's documents.
NAME = np.dtype([("known", "u1"), ("id", "<i8")])


def _flat(vocabulary: str, end: int, file_tokens: int, named: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe(vocabulary, True)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0
        mark = np.array([end], dtype="<u4")

        def file() -> pa.RecordBatch:
            # the last byte, of the last separator, is left to the sink
            rows = [np.concatenate(held).astype(IDS).tobytes()[:-1]]
            if named:
                rows.append(np.array([(x is not None, x or 0) for x in names], dtype=NAME).tobytes())
            held.clear()
            names.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["content"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                ids = encoder.one(text)
                held += [ids, mark]
                names.append(doc)
                size += len(ids) + 1
                if size >= file_tokens:
                    yield file()
                    size = 0
        if held:
            yield file()

    return run


def write_token_files(
    docs: DataFrame, path: str, text_col: str = "text", vocabulary: str | None = None, end: int = END_OF_DOCUMENT, file_tokens: int = 1 << 21, id_col: str | None = None
) -> None:
    """Writes flat files of 16-bit ids (the vocabulary's all fit), each document's
    followed by ``end``; a file is closed behind the document with which it reaches
    file_tokens. Null text is empty: its separator alone is written; the separator's
    string in a text is ordinary text. A document of any length stays in one file. The
    low byte of ``end`` must be ASCII, as the sink adds it. With id_col every token file
    is followed by one that names its documents, so that token files have even numbers."""
    if end >= 1 << 16 or end & 0xFF >= 0x80:
        raise ValueError("end must fit 16 bits, its low byte 7")
    names = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    flat = docs.select(names.alias("name"), F.col(text_col).cast("string")).mapInArrow(_flat(vocabulary or default_vocabulary(), end, file_tokens, bool(id_col)), "content binary")
    bound_batches(docs.sparkSession)
    write_blobs(flat, "content", chr(end & 0xFF), path)


def _scan_blocks(end: int, block_tokens: int, dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["stream", "file_no", "block_no", "n_tokens", "ends"]
        for batch in batches:
            for stream, number, content in zip(*(values_of(batch.column(j)) for j in range(3)), strict=True):
                if len(content) % np.dtype(dtype).itemsize:
                    raise ValueError(f"file {number} of {stream} is not a whole number of ids")
                ids = np.frombuffer(content, dtype=dtype)
                for k, at in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[at : at + block_tokens]
                    ends = np.flatnonzero(part == end)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stream]), pa.array([number], pa.int64()), pa.array([k], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                        names,
                    )

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for stream, first, in_file, before, open_, ends, tail, last, names in zip(*(batch.column(j).to_pylist() for j in range(8)), values_of(batch.column(8)), strict=True):
            stop = np.asarray(ends, dtype=np.int64)
            closed = len(stop)
            if last and tail:
                stop = np.append(stop, (stop[-1] + 1 if closed else 0) + tail)
            n = len(stop)
            if not n:
                continue
            start = np.concatenate(([-open_ if closed else 0], stop[:-1] + 1))
            if last and tail and not closed:
                start, stop = np.array([-open_]), np.array([tail])
            if names is None:
                docs = pa.nulls(n, pa.int64())
            else:
                own = np.frombuffer(names, dtype=NAME, count=len(names) // NAME.itemsize)[in_file : in_file + n]
                docs = pa.array(np.ascontiguousarray(own["id"]), pa.int64(), mask=own["known"] == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([stream] * n), pa.array(first + np.arange(n)), docs, pa.array(before + start), pa.array(stop - start), pa.array(np.arange(n) < closed)],
                ["stream", "doc_no", "doc_id", "start", "n_tokens", "terminated"],
            )


def token_counts(spark: SparkSession, path: str, end: int = END_OF_DOCUMENT, block_tokens: int = 1 << 18, dtype: str = IDS, named: bool = False) -> DataFrame:
    """One row per document of the flat token files under path: stream, doc_no
    (in the stream, from 0), doc_id (null unless ``named``: files written with
    id_col), start (tokens of the stream before it), n_tokens (its separator not
    counted), terminated (false for a last document without one).

    Files of one stream (the writer's task, ``part-NNNNN``) follow each other by
    their number (``-cNNN`` before the suffix). Each file is searched in blocks, independently: a
    block gives its length and the places of its separators. A prefix scan over
    the blocks' summaries, in two levels (the blocks of a stream, in order), gives
    each block the tokens and separators before it and the tokens since the last
    separator; with these it places its documents by itself. Two separators in
    a row are an empty document. A file must fit into one row (2 GB); the writer
    bounds its files far below, but for a longer single document. dtype is NumPy's
    name of an id's format. Empty files, and a folder without any, give no row.
    """
    bound_batches(spark)
    name = F.element_at(F.split("path", "/"), -1)
    files = read_blobs(spark, path).select(
        F.regexp_extract(name, r"^(part-\d+)", 1).alias("stream"), F.regexp_extract(name, r"-c(\d+)\.[^-]*$", 1).cast("long").alias("file_no"), "content"
    )
    tokens = files.filter(F.col("file_no") % 2 == 0) if named else files
    blocks = staged(tokens.mapInArrow(_scan_blocks(end, block_tokens, dtype), "stream string, file_no long, block_no long, n_tokens long, ends array<long>"), "token-blocks")
    blocks = blocks.withColumn("n_ends", F.size("ends").cast("long")).withColumn(
        "tail", F.when(F.col("n_ends") > 0, F.col("n_tokens") - 1 - F.element_at("ends", -1)).otherwise(F.col("n_tokens"))
    )
    # The scan itself runs over the summaries; the places stay out of its sort.
    order = Window.partitionBy("stream").orderBy("file_no", "block_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("stream", "file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    scanned = (
        blocks.select("stream", "file_no", "block_no", "n_tokens", "n_ends", "tail")
        .withColumn("first_doc", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
        .withColumn("in_file", F.coalesce(F.sum("n_ends").over(in_file), F.lit(0)))
        .withColumn("tokens_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .withColumn("last_end", F.max(F.when(F.col("n_ends") > 0, F.col("tokens_before") + F.col("n_tokens") - F.col("tail"))).over(before))
        .withColumn("open", F.col("tokens_before") - F.coalesce("last_end", F.lit(0)))
        .withColumn("last", F.lead("n_tokens").over(order).isNull())
    )
    placed = blocks.select("stream", "file_no", "block_no", "ends", "tail").join(
        scanned.drop("n_tokens", "n_ends", "tail", "last_end"), ["stream", "file_no", "block_no"]
    )
    if named:
        names = files.filter(F.col("file_no") % 2 == 1).select("stream", (F.col("file_no") - 1).alias("file_no"), F.col("content").alias("names"))
        placed = placed.join(names, ["stream", "file_no"], "left")
    else:
        placed = placed.withColumn("names", F.lit(None).cast("binary"))
    return placed.select("stream", "first_doc", "in_file", "tokens_before", "open", "ends", "tail", "last", "names").mapInArrow(
        _lengths, "stream string, doc_no long, doc_id long, start long, n_tokens long, terminated boolean"
    )


def count_document_tokens(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Writes docs as flat token files to shared storage and counts by scanning them:
    one row per input row, with its id (null ids stay null).

    Null and empty texts are documents of no token. Repeated rows are documents of
    their own. A text of any length up to 2 GB of ids is counted whole. An empty table
    gives no row. Other columns are ignored, whatever their names.
    """
    path = shared_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, text_col, vocabulary, id_col=id_col)
    return token_counts(docs.sparkSession, path, named=True)
