"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .common import Shipped, bound_batches, map_rows, values_of

MARKER = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Below the least score of a piece, for a character that no piece has.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            c = raw[at]
            at += 1
            out |= (c & 127) << shift
            shift += 7
            if c < 128:
                return out

    while at < len(raw):
        key = varint()
        number, kind = key >> 3, key & 7
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, raw[at : at + size]
        at += size


def read_pieces(path: str, scores: str = "zipf") -> list[tuple[str, float, int]]:
    """(piece, log score, type) by id.

    A model of merges has ranks in place of log scores. With scores="zipf" the
    piece of rank r gets the log of 1/(r+2), the pieces the model sets by hand
    (runs of white space) the last ranks; "model" takes the scores as they are.
    """
    out = []
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    if scores == "zipf":
        order = sorted((i for i, p in enumerate(out) if p[2] in (NORMAL, USER)), key=lambda i: (-out[i][1], i))
        for rank, i in enumerate(order):
            out[i] = (out[i][0], float(np.float32(-np.log(rank + 2))), NORMAL)
    return out


class DoubleArray:
    """Byte trie in two arrays: from state s, byte c leads to t = base[s] + c + 1
    if check[t] == s. value[t] is the id that ends at t, or -1."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, i in keys.items():
            node = 0
            for c in key:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = i
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        taken = bytearray(size)
        taken[0] = 1
        todo, low, far = [(0, 0)], 1, 1
        while todo:
            node, state = todo.pop()
            value[state] = ends[node]
            if not children[node]:
                continue
            codes = sorted(children[node])
            while taken[low]:
                low += 1
            # A lone child takes the first free place. Siblings are sought among
            # the last thousand places only, which keeps the search linear.
            at = max(low if len(codes) == 1 else max(low, far - 1000), codes[0] + 1)
            shift = [c - codes[0] for c in codes]
            while True:
                if at + 600 > size:
                    for x, blank in ((base, 0), (check, -1), (value, -1)):
                        x.extend([blank] * size)
                    taken.extend(bytes(size))
                    size *= 2
                if not any(taken[at + d] for d in shift):
                    break
                at = taken.index(0, at + 1)
            base[state] = at - codes[0] - 1
            far = max(far, at + shift[-1])
            for c in codes:
                t = at - codes[0] + c
                taken[t] = 1
                check[t] = state
                todo.append((children[node][c], t))
        used = far + 512
        self.base, self.check, self.value = (np.array((x + [blank] * 512)[:used], dtype=np.int32) for x, blank in ((base, 0), (check, -1), (value, -1)))
        self.depth = max(map(len, keys), default=0)


class UnigramModel:
    """Arrays of a piece model, and its encoder and decoder."""

    #: Bytes of a part up to which it is decoded in step with others and kept; bytes of
    #: the parts kept at once.
    LONG, MOST = 96, 16 << 20

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        normal = {p.encode(): i for i, (p, _, kind) in reversed(list(enumerate(pieces))) if kind in (NORMAL, USER) and p}
        self.trie = DoubleArray(normal)
        self.scores = np.array([s for _, s, _ in pieces], dtype=np.float32)
        least = min((pieces[i][1] for i in normal.values()), default=0.0)
        self.unknown_score = np.float32(least - UNKNOWN_PENALTY)
        self.byte_ids = [-1] * 256
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        surface = []
        for i, (p, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
                surface.append(bytes([int(p[3:-1], 16)]))
            elif kind in (CONTROL,):
                surface.append(b"")
            elif kind == UNKNOWN:
                surface.append(b" \xe2\x81\x87 ")
            else:
                surface.append(p.replace(MARKER, " ").encode())
        self.surface = surface
        self.fallback = min(self.byte_ids) >= 0
        #: No piece has a marker behind another character: then white space
        #: starts a new lattice, and words are encoded independently.
        self.by_word = not any(MARKER in p.lstrip(MARKER) for p, _, kind in pieces if kind in (NORMAL, USER))

    # -- Viterbi -----------------------------------------------------------

    def _one(self, raw: bytes) -> list[int]:
        base, check, value = self.lists
        n = len(raw)
        best = [None] * (n + 1)
        best[0] = np.float32(0)
        came = [(0, -1)] * (n + 1)
        scores, unknown = self.scores, self.unknown_score
        for i in range(n):
            if best[i] is None:
                continue
            width = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
            state, single, here = 0, False, best[i]
            for j in range(i, n):
                t = base[state] + raw[j] + 1
                if check[t] != state:
                    break
                state = t
                v = value[state]
                if v >= 0:
                    single |= j + 1 - i == width
                    score = here + scores[v]
                    if best[j + 1] is None or score > best[j + 1]:
                        best[j + 1], came[j + 1] = score, (i, v)
            if not single and i + width <= n:
                score = here + unknown
                if best[i + width] is None or score > best[i + width]:
                    best[i + width], came[i + width] = score, (i, -1)
        return self._back(raw, came)

    def _back(self, raw: bytes, came: list[tuple[int, int]]) -> list[int]:
        out: list[int] = []
        j = len(raw)
        while j > 0:
            i, v = came[j]
            if v >= 0:
                out.append(v)
            elif self.fallback:
                out += [self.byte_ids[c] for c in reversed(raw[i:j])]
            else:
                out.append(self.unknown_id)
            j = i
        return out[::-1]

    def _many(self, words: list[bytes]) -> list[list[int]]:
        """One lattice per word, all words in step. words: at most LONG bytes each."""
        n, most = len(words), max(map(len, words))
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), dtype=np.uint8).reshape(n, most).astype(np.int32)
        best = np.full((most + 1, n), -np.inf, dtype=np.float32)
        best[0] = 0
        from_ = np.zeros((most + 1, n), dtype=np.int32)
        piece = np.full((most + 1, n), -1, dtype=np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(most):
            lanes = np.flatnonzero((sizes > i) & (best[i] > -np.inf))
            if not len(lanes):
                continue
            lead = raw[lanes, i]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(n, dtype=bool)
            who, state = lanes, np.zeros(len(lanes), dtype=np.int32)
            wide = np.zeros(n, dtype=np.int64)
            wide[lanes] = width
            for j in range(i, most):
                t = base[state] + raw[who, j] + 1
                ok = (check[t] == state) & (sizes[who] > j)
                who, state = who[ok], t[ok]
                if not len(who):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    w, v = who[hit], v[hit]
                    single[w[wide[w] == j + 1 - i]] = True
                    score = best[i, w] + self.scores[v]
                    better = score > best[j + 1, w]
                    w, v = w[better], v[better]
                    best[j + 1, w], from_[j + 1, w], piece[j + 1, w] = score[better], i, v
            lone = lanes[~single[lanes]]
            if len(lone):
                to = i + wide[lone]
                score = best[i, lone] + self.unknown_score
                better = score > best[to, lone]
                lone, to = lone[better], to[better]
                best[to, lone], from_[to, lone], piece[to, lone] = score[better], i, -1
        came_i, came_v = from_.T.tolist(), piece.T.tolist()
        return [self._back(w, list(zip(came_i[k], came_v[k], strict=True))) for k, w in enumerate(words)]

    # -- texts -------------------------------------------------------------

    def start(self) -> None:
        """Once per task, before use."""
        self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value))
        self.known: dict[str, bytes] = {}
        self.size = 0

    def cut(self, text: str) -> list[str]:
        """The text behind its leading marker, in parts with a lattice of their own."""
        if not text:
            return []
        if not self.by_word:
            return [" " + text]
        out, run = [], ""
        for x in (" " + text.replace(MARKER, " ")).split(" ")[1:]:
            run += " "
            if x:
                out.append(run + x)
                run = ""
        return [*out, run] if run else out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [self.cut(t) if t else [] for t in texts]
        if self.size > self.MOST:
            self.known.clear()
            self.size = 0
        known, long = self.known, {}
        bins: dict[int, list[str]] = {}
        raws = {}
        for p in {p for ps in parts for p in ps}.difference(known):
            raw = p.replace(" ", MARKER).encode("utf-8", "replace")
            if len(raw) > self.LONG:
                long[p] = np.array(self._one(raw), dtype="<u4").tobytes()
            else:
                raws[p] = raw
                self.size += len(raw)
                bins.setdefault(-(-len(raw) // 8), []).append(p)
        for group in bins.values():
            for k in range(0, len(group), 8192):
                some = group[k : k + 8192]
                for p, ids in zip(some, self._many([raws[p] for p in some]), strict=True):
                    known[p] = np.array(ids, dtype="<u4").tobytes()
        return [np.frombuffer(b"".join([known[p] if p in known else long[p] for p in ps]), dtype="<u4") for ps in parts]

    def decode(self, ids: np.ndarray) -> str:
        surface = self.surface
        out = b"".join([surface[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


#: Characters of the texts that are encoded together, about.
GROUP = 1 << 21


def _encoder(handle: Shipped, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.load()
        model.start()
        to_bytes = np.zeros(len(model.surface), dtype=bool)
        to_bytes[[i for i in model.byte_ids if i >= 0]] = True
        def done(docs: list, texts: list) -> pa.RecordBatch:
            rows = []
            for doc, text, ids in zip(docs, texts, model.encode(texts), strict=True):
                raw = ids.tobytes()
                back = model.decode(ids)
                rows.append((doc, len(ids), int(to_bytes[ids].sum()), zlib.crc32(raw), zlib.crc32(back.encode("utf-8", "replace")), back == (text or "").replace(MARKER, " "), raw if with_ids else None, back if with_ids else None))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.binary(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*"abcdefgh"])

        for batch in batches:
            docs, texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                docs.append(doc)
                texts.append(text)
                size += len(text or "")
                if size >= GROUP:
                    yield done(docs, texts)
                    docs, texts, size = [], [], 0
            if docs:
                yield done(docs, texts)

    return run


def sentencepiece_encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, scores: str = "zipf", with_ids: bool = False
) -> DataFrame:
    """One row per input row: id, n_pieces, n_byte_pieces, ids_crc32, text_crc32
    (of the decoded text), round_trip; with_ids adds ids (little-endian 32 bit) and
    decoded.

    White space is the marker, one leads the text, nothing else is normalised. The
    pieces maximise the sum of log scores; of equal sums the one whose last
    piece starts first wins. A character without a piece costs the least score
    less 10 and becomes its bytes. Distinct words of a batch are decoded together,
    a lattice step for all of them at once; a word of any length has one lattice. A
    marker in the source decodes to a space, which round_trip allows for. Null and empty
    texts have no pieces. Rows are independent: repeats get the same values, null ids
    are carried along, an empty table gives no rows, other columns are ignored. The
    model's tables are of the vocabulary's size and are broadcast.
    """
    bound_batches(docs.sparkSession)
    model = UnigramModel(read_pieces(model_path or default_model(), scores))
    handle = Shipped(docs.sparkSession, model)
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _encoder(handle, with_ids),
        f"{id_col} long, n_pieces long, n_byte_pieces long, ids_crc32 long, text_crc32 long, round_trip boolean, ids binary, decoded string",
    )
    return out if with_ids else out.drop("ids", "decoded")


def sentencepiece_decode(df: DataFrame, ids_col: str = "ids", model_path: str | None = None, into: str = "text") -> DataFrame:
    """df with a column ``into`` more (or anew): the text of its ids column.
    Null ids give null, empty ones the empty text. Ids outside the vocabulary raise.
    All other columns stay, whatever their names; an empty table stays empty."""
    bound_batches(df.sparkSession)
    handle = Shipped(df.sparkSession, UnigramModel(read_pieces(model_path or default_model())))
    rest = [c for c in df.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle.load()
        for batch in batches:
            texts = [None if x is None else model.decode(np.frombuffer(x, dtype="<u4")) for x in values_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    rows = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids_col}`"))
    return map_rows(rows, run, [*(f for f in df.schema if f.name != into), StructField(into, StringType())])
