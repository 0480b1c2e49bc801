"""Language identification: averaged hashed subword embeddings, linear softmax."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shipped, bound_batches, values_of

UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    """The model's size, its training, and the bound of its sample: sample_rows
    labelled rows (or one of each language, where there are more languages) of at most
    sample_chars characters each reach the driver. More languages than max_languages
    raise."""

    buckets: int = 1 << 16
    dim: int = 16
    orders: tuple[int, ...] = (1, 2, 3, 4)
    sample_rows: int = 4000
    sample_chars: int = 20_000
    max_languages: int = 10_000
    windows: int = 4
    epochs: int = 4
    rate: float = 0.5
    batch: int = 64
    reject_share: float = 0.01
    seed: int = 3


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


class Subwords:
    """Hashed n-grams of code points of the lower-cased text, in which every run of
    characters that are no letters is one space."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.letter = letters()

    def points(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        is_letter = self.letter[raw]
        if not is_letter.any():
            return np.empty(0, dtype=np.uint32)
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        out = np.where(is_letter, raw, np.uint32(32))[keep]
        return np.concatenate((np.array([32], np.uint32), out, np.array([32], np.uint32)))

    def buckets(self, points: np.ndarray) -> np.ndarray:
        mask, parts = np.uint32(self.settings.buckets - 1), []
        h = np.zeros(len(points), dtype=np.uint32)
        for n in range(1, max(self.settings.orders) + 1):
            if len(points) < n:
                break
            h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(16777619)
            if n in self.settings.orders:
                x = (h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                parts.append((x ^ (x >> np.uint32(15))) & mask)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def tables(self) -> np.ndarray:
        """Each bucket's share of the logits: averaging embeddings and then the
        linear layer is the same as averaging these."""
        return (self.embeddings @ self.weights).astype(np.float32)

    def logits(self, buckets: np.ndarray, tables: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.languages))
        for k in range(0, len(buckets), 1 << 16):
            total += tables[buckets[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return total / len(buckets) + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = np.asarray(logits) / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Model | None:
    """Fits by stochastic gradient descent on random windows of the (text, language)
    rows, then a temperature and a rejection limit on rows set apart. None without
    a text that has letters."""
    rng = np.random.default_rng(settings.seed)
    subwords = Subwords(settings)
    known = [(p, lang) for t, lang in rows if len(p := subwords.points(t))]
    if not known:
        return None
    languages = sorted({lang for _, lang in known})
    number = {lang: k for k, lang in enumerate(languages)}
    order = rng.permutation(len(known))
    often = np.bincount([number[lang] for _, lang in known])
    tenth = order[: len(order) // 10] if len(known) >= 50 else order[:0]
    apart = np.array([i for i in tenth if often[number[known[i][1]]] >= 10], dtype=int)
    order = np.concatenate((apart, np.setdiff1d(order, apart)))

    def windows(which: np.ndarray) -> list[tuple[np.ndarray, int]]:
        out = []
        for i in which:
            points, lang = known[i]
            for _ in range(settings.windows):
                n = int(rng.integers(20, 200))
                at = int(rng.integers(0, max(1, len(points) - n)))
                out.append((subwords.buckets(points[at : at + n]), number[lang]))
        return out

    examples = windows(order[len(apart) :])
    n_classes = len(languages)
    model = Model(settings, languages, rng.normal(0, 0.1, (settings.buckets, settings.dim)).astype(np.float32), np.zeros((settings.dim, n_classes), np.float32), np.zeros(n_classes, np.float32))
    count = np.bincount([y for _, y in examples], minlength=n_classes).clip(1)
    balance = (len(examples) / (n_classes * count)).astype(np.float32)
    steps, done = settings.epochs * -(-len(examples) // settings.batch), 0
    for _ in range(settings.epochs):
        shuffled = rng.permutation(len(examples))
        for k in range(0, len(shuffled), settings.batch):
            some = [examples[i] for i in shuffled[k : k + settings.batch]]
            rate = np.float32(settings.rate * (1 - done / steps))
            done += 1
            sizes = np.array([len(x) for x, _ in some])
            flat = np.concatenate([x for x, _ in some])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            hidden = np.add.reduceat(model.embeddings[flat], starts, axis=0) / sizes[:, None]
            y = np.array([c for _, c in some])
            z = hidden @ model.weights + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p *= balance[y][:, None].clip(0.2, 5)
            back = (p @ model.weights.T).astype(np.float32)
            model.weights -= rate * (hidden.T @ p / len(y)).astype(np.float32)
            model.bias -= rate * p.mean(axis=0).astype(np.float32)
            which, inverse = np.unique(flat, return_inverse=True)
            share = np.repeat(back / sizes[:, None], sizes, axis=0)
            grad = np.stack([np.bincount(inverse, weights=share[:, d], minlength=len(which)) for d in range(settings.dim)], axis=1)
            model.embeddings[which] -= rate * grad.astype(np.float32)
    if len(apart):
        tables = model.tables()
        held = windows(apart)
        z = np.array([model.logits(x, tables) for x, _ in held])
        y = np.array([c for _, c in held])

        def loss(t: float) -> float:
            s = z / t
            return float(-(s[np.arange(len(y)), y] - s.max(axis=1) - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = model.probabilities(z)
        right = p.argmax(axis=1) == y
        if right.any():
            model.reject_below = float(np.quantile(p.max(axis=1)[right], settings.reject_share))
    return model


def labelled_sample(docs: DataFrame, settings: Settings, text_col: str, label_col: str, key: Column) -> list[tuple[str, str]]:
    """At most sample_rows labelled rows, evenly over the languages and one of each at
    least, chosen by a hash of ``key``. Of a text above sample_chars a piece of that
    length is taken, from a place that the hash gives. Only counts and the sample come
    to the driver: somewhat more rows than it are drawn, and each language's first by
    the hash are taken."""
    rows = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"), key.alias("key"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(settings.max_languages + 1).collect()
    if not counts:
        return []
    if len(counts) > settings.max_languages:
        raise ValueError(f"more than {settings.max_languages} languages")
    each = max(1, settings.sample_rows // len(counts))
    drawn = each + 4 * each**0.5 + 8
    share = docs.sparkSession.createDataFrame([(r["label"], min(1.0, drawn / r["n"])) for r in counts], "label string, share double")
    order = F.xxhash64("key", F.lit(settings.seed))
    start = F.pmod(order, F.greatest(F.char_length("text") - settings.sample_chars + 1, F.lit(1))).cast("int") + 1
    some = rows.withColumn("order", order).join(F.broadcast(share), "label").filter(F.pmod("order", F.lit(1 << 40)) < F.col("share") * (1 << 40))
    some = some.select(F.substring("text", start, F.lit(settings.sample_chars)).alias("text"), "label", "order")
    nth = F.row_number().over(Window.partitionBy("label").orderBy("order", "text"))
    taken = some.withColumn("nth", nth).filter(F.col("nth") <= each).orderBy("order", "text", "label").collect()
    return [(r["text"], r["label"]) for r in taken]


def _predict(handle: Shipped, with_model: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.load() if with_model else None
        if model is not None:
            subwords, tables = Subwords(model.settings), model.tables()
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in values_of(batch.column(1)):
                points = subwords.points(text) if text and model is not None else ()
                if not len(points):
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                p = model.probabilities(model.logits(subwords.buckets(points), tables))
                best = int(p.argmax())
                langs.append(model.languages[best])
                scores.append(float(p[best]))
                rejected.append(bool(p[best] < model.reject_below))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [*"abcde"]
            )

    return run


def held_out(id_col: Column) -> Column:
    """Every third document by the CRC-32 of its id in decimal."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", flag: Column | None = None) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score (calibrated probability),
    rejected (score below the limit). Without letters, or without a model, it is
    ``und`` with score 0, rejected. Null and empty texts have no letters; a letter is
    a character of a letter category of Unicode, on whatever plane. Whole texts of any
    length; rows are independent, so repeats get the same values: no shuffle. Of equally
    probable languages the first by name wins. Other columns are ignored."""
    bound_batches(docs.sparkSession)
    handle = Shipped(docs.sparkSession, model)
    rows = docs.select(F.col(id_col).cast("long").alias("a"), F.col(text_col).cast("string"), (F.lit(False) if flag is None else flag).alias("c"))
    return rows.mapInArrow(_predict(handle, model is not None), f"{id_col} long, held_out boolean, lang_pred string, score double, rejected boolean")


def train_and_identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Learns from labelled rows that are not held out and predicts for all rows.

    The label and id are never inputs of a prediction; the id only deals the
    rows out. Repeated rows count as often as they are drawn; null ids are not
    held out. Every language of the learned rows is learned, however rare. An empty
    table gives no rows, an unlabelled one ``und`` throughout.
    """
    flag = held_out(F.col(id_col))
    rows = labelled_sample(docs.filter(~flag), settings, text_col, label_col, F.col(id_col))
    return identify(docs, train(rows, settings), id_col, text_col, flag)
