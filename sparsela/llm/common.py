"""What the operators share: tables, shared storage, hashing of whole texts."""

from __future__ import annotations

import contextlib
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows with texts come to Python in batches bounded by their bytes, not by rows alone.
BATCH_BYTES = 4 << 20
TEXT_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}

#: Lets Catalyst build its Bloom filter for joins of whole texts (or sets) with a
#: short list of ids, whatever the size of the scan, so that rows without a partner
#: are dropped before the shuffle. Nothing is broadcast: one plan for all sizes.
PRUNE_TEXTS = TEXT_BATCHES | {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1b",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256m",
}

#: Writers hold a row group in memory for each task.
ROW_GROUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_if_there(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return table(spark, sf_dir, name) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits for Arrow batches and Parquet row groups to those
    above, where they are larger. An operator that returns a lazy frame needs them when
    the caller runs it, so they stay; other settings are held for a step only."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("parquet.block.size", ROW_GROUP_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share (spark.checkpoint.dir).

    Only where it is unset on a local master (as in tests) a local folder is made;
    on a cluster that would lose rows, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sparsela-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Writes df once to shared storage and reads it back: cuts the lineage and
    survives the loss of executors. ``discard`` removes it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", compression).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes what ``staged`` wrote, once nothing reads it any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Holds session settings while an eager step is planned and run."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def map_rows(df: DataFrame, run: Callable, fields: list[StructField]) -> DataFrame:
    """mapInArrow over whole rows of any column names: the batches' columns go by their
    place, and the result's are ``fields``."""
    numbered = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    schema = StructType([StructField(f"c{k}", f.dataType, True) for k, f in enumerate(fields)])

    def named(batches: Iterator) -> Iterator:
        for batch in run(batches):
            yield batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])

    return numbered.mapInArrow(named, schema).toDF(*[f.name for f in fields])


class Shipped:
    """A bounded object, broadcast once with its class by value, since workers need
    not have this package."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.handle = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def load(self) -> object:
        return pickle.loads(self.handle.value)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the JVM's fast path."""
    upper, lower = (bytes(range(x, x + 26)).decode() for x in (65, 97))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, lower))


_MIX1 = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _S33)
    x = x * _MIX1
    x = x ^ (x >> _S33)
    x = x * _MIX2
    return x ^ (x >> _S33)


def values_of(column) -> Iterator:
    """An Arrow column's values one by one, so that a batch is never held twice."""
    return (v.as_py() for v in column)


def white_space() -> np.ndarray:
    """For each byte, whether it is one of [\\x20\\x09-\\x0D]."""
    out = np.zeros(256, dtype=bool)
    out[[32, *range(9, 14)]] = True
    return out


class SpanHasher:
    """64-bit hashes of any spans of a byte string, from one prefix sum.

    A byte stands for a random 64-bit number; a span's hash is the polynomial of
    its bytes modulo 2**64, scaled to start at power 0, mixed with its length.
    ``fold`` gives A-Z the numbers of a-z.
    """

    def __init__(self, fold: bool = False, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.codes[65:91] = self.codes[97:123]
        self.base = int(rng.integers(0, 1 << 61)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.ones(n, dtype=np.uint64)
            done = 1
            while done < n:
                step = min(done, n - done)
                out[done : done + step] = out[:step] * np.uint64(pow(b, done, 1 << 64))
                done += step
            return out

        self.up, self.down = powers(self.base), powers(self.inverse)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        if len(raw) + 1 > len(self.up):
            self._grow(max(len(raw) + 1, 2 * len(self.up)))
        out = np.empty(len(raw) + 1, dtype=np.uint64)
        out[0] = 0
        np.cumsum(self.codes[raw] * self.up[: len(raw)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.down[start]
        return mix64(h + (end - start).astype(np.uint64) * _MIX2)


def words_of(raw: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no white space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space[raw], [True]))))
    return edge[::2], edge[1::2]


def shingle_set(text: str | None, k: int, hasher: SpanHasher, space: np.ndarray) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles.

    With fewer than k words the whole sequence is one shingle; without words
    the set is empty.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    start, end = words_of(raw, space)
    n = len(start)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    words = hasher.spans(hasher.prefix(raw), start, end)
    width = min(k, n)
    out = words[: n - width + 1].copy()
    for j in range(1, width):
        out = mix64(out * _MIX1 + words[j : n - width + 1 + j])
    if width < k:
        out = mix64(out + np.uint64(width))
    return np.unique(out)
