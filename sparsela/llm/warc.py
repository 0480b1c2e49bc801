"""WARC archives in Zstandard: a dictionary in front, one frame per record."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs
from .common import bound_batches, shared_path, values_of

# Fixed values of the formats (RFC 8878, the WARC standard and its Zstandard appendix).
FRAME, DICTIONARY_FRAME, PAD_FRAME, SKIPPABLE = 0xFD2FB528, 0x184D2A5D, 0x184D2A50, 0x184D2A5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string, at long, valid boolean, problem string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record with the payload behind its HTTP head, or for a revisit
    the head alone. Both state the full payload's digest and length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable(magic: int, content: bytes) -> bytes:
    return magic.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


class ArchiveWriter:
    """Collects records as frames. The dictionary is trained on the first records,
    ``sample_bytes`` at most; with too few to train on the archive has none."""

    def __init__(self, level: int = 3, dictionary_bytes: int = 16 << 10, sample_bytes: int = 1 << 20) -> None:
        self.level, self.dictionary_bytes, self.sample_bytes = level, dictionary_bytes, sample_bytes
        self.waiting: list[bytes] = []
        self.frames: list[bytes] = []
        self.size = self.waiting_size = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, raw: bytes) -> None:
        if self.compressor is None:
            self.waiting.append(raw)
            self.waiting_size += len(raw)
            if self.waiting_size >= self.sample_bytes:
                self._begin()
        else:
            self._frame(raw)

    def _begin(self) -> None:
        found = None
        if len(self.waiting) >= 16 and self.waiting_size >= 8 * self.dictionary_bytes:
            samples = [x[: 16 << 10] for x in self.waiting]
            try:
                found = zstandard.train_dictionary(self.dictionary_bytes, samples, k=256, d=8)
            except zstandard.ZstdError:
                found = None  # all samples alike: nothing to learn
        if found:
            self.frames.append(skippable(DICTIONARY_FRAME, zstandard.ZstdCompressor(level=self.level).compress(found.as_bytes())))
            self.size += len(self.frames[0])
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=found, write_checksum=True)
        for x in self.waiting:
            self._frame(x)
        self.waiting, self.waiting_size = [], 0

    def _frame(self, raw: bytes) -> None:
        self.frames.append(self.compressor.compress(raw))
        self.size += len(self.frames[-1])

    def finish(self) -> bytes | None:
        """The archive but for its last byte, a line feed that ends a padding frame."""
        if self.compressor is None and self.waiting:
            self._begin()
        if not self.frames:
            return None
        return b"".join([*self.frames, skippable(PAD_FRAME, b"\n")[:-1]])


def _archives(archive_bytes: int, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh() -> ArchiveWriter:
            return ArchiveWriter(sample_bytes=min(1 << 20, archive_bytes))

        writer = fresh()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x] if (x := writer.finish()) else [], pa.binary())], ["content"])

        for batch in batches:
            for page_id, url, html, first in zip(*(values_of(batch.column(j)) for j in range(4)), strict=True):
                refers = first if first is not None and first != page_id else None
                writer.add(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers, date))
                if writer.size >= archive_bytes:
                    yield done()
                    writer = fresh()
        yield done()

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_payload: int = 0,
    archive_bytes: int = 16 << 20,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Writes a record per row into archives under path.

    Of records with equal payloads of min_payload bytes or more the smallest id is the
    response, the others revisit it. Payloads are equal when their SHA-1 and length are,
    as the standard's identical-payload-digest profile has it; bytes are not compared.
    Null html is the empty payload, a null url the empty one; a row with a null id
    revisits its payload's smallest id where there is one. Rows that repeat an id with
    the same payload are all responses. An html of any length is one record. An empty
    table gives no archive; other columns are ignored, whatever their names. The hot
    payload is aggregated before the shuffle and its rows, with one partner each, can be
    split among tasks.
    """
    bound_batches(pages.sparkSession)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).alias("size")
    )
    first = rows.groupBy("digest", "size").agg(F.min("id").alias("first"))
    marked = rows.join(first, ["digest", "size"], "left")
    chosen = F.when(F.col("size") >= min_payload, F.col("first"))
    write_blobs(marked.select("id", "url", "html", chosen.alias("first")).mapInArrow(_archives(archive_bytes, date), "content binary"), "content", "\n", path)


def frame_end(buf: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from its headers alone."""
    magic = int.from_bytes(buf[at : at + 4], "little")
    if magic >> 4 == SKIPPABLE:
        return at + 8 + int.from_bytes(buf[at + 4 : at + 8], "little")
    if magic != FRAME:
        raise ValueError(f"no frame at {at}")
    flags = buf[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(buf[at : at + 3], "little")
        if at + 3 > len(buf) or head >> 1 & 3 == 3:
            raise ValueError("broken block")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(buf):
        raise ValueError("cut off")
    return at


def parse_record(raw: bytes) -> dict:
    """The record's values; ``problem`` says what is wrong with it, if anything is."""
    out = {"page_id": None, "payload_bytes": None, "payload_digest": None, "record_type": None, "refers_to": None, "target_uri": None, "problem": None}
    cut = raw.find(b"\r\n\r\n")
    if cut < 0 or not raw.startswith(b"WARC/1."):
        return out | {"problem": "no WARC head"}
    head = {}
    for line in raw[:cut].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return out | {"problem": "broken header line"}
        head[name.strip().lower()] = value.strip()
    missing = [x for x in ("warc-type", "warc-record-id", "warc-date", "content-length") if x not in head]
    if missing:
        return out | {"problem": f"without {missing[0]}"}
    block = raw[cut + 4 : -4]
    if not head["content-length"].isdigit() or len(block) != int(head["content-length"]) or raw[-4:] != b"\r\n\r\n":
        return out | {"problem": "length"}

    def page(name: str) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(name, ""))
        return int(found[1]) if found else None

    kind = head["warc-type"]
    out |= {"page_id": page("warc-record-id"), "record_type": kind, "refers_to": page("warc-refers-to"), "target_uri": head.get("warc-target-uri")}
    stated = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-block-digest", "").removeprefix("sha1:") not in ("", sha1_base32(block)):
        return out | {"problem": "block digest"}
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    if not gap or not length:
        return out | {"problem": "no HTTP head"}
    out |= {"payload_bytes": int(length[1]), "payload_digest": stated}
    if kind == "response" and (len(payload) != int(length[1]) or stated != sha1_base32(payload)):
        return out | {"problem": "payload"}
    if kind == "revisit" and (payload or out["refers_to"] is None):
        return out | {"problem": "revisit"}
    return out


def read_archive(buf: bytes) -> Iterator[tuple[int, dict, bytes | None]]:
    """(place, values, record) of each frame of one archive; records of any length. A
    frame that can't be read gives its problem; behind a broken one nothing more is read."""
    at, dictionary = 0, None
    if int.from_bytes(buf[:4], "little") == DICTIONARY_FRAME:
        at = frame_end(buf, 0)
        raw = buf[8:at]
        if int.from_bytes(raw[:4], "little") == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(buf):
        try:
            end = frame_end(buf, at)
            frame = buf[at:end]
            if int.from_bytes(frame[:4], "little") >> 4 == SKIPPABLE:
                raw = None
            elif zstandard.frame_content_size(frame) >= 0:
                raw = decompressor.decompress(frame)
            else:  # the header need not state the length
                raw = decompressor.decompressobj().decompress(frame)
        except (ValueError, IndexError, zstandard.ZstdError) as e:
            yield at, parse_record(b"") | {"problem": f"frame: {e}"}, None
            return
        if raw is not None:
            yield at, parse_record(raw), raw
        at = end


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    for batch in batches:
        for path, content in zip(*(values_of(batch.column(j)) for j in range(2)), strict=True):
            rows = [
                (v["page_id"], v["payload_bytes"], v["payload_digest"], v["record_type"], v["refers_to"], v["target_uri"], path.rsplit("/", 1)[-1], at, v["problem"] is None, v["problem"])
                for at, v, _ in read_archive(content)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [str(j) for j in range(10)])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the archives under path: page_id, payload_bytes,
    payload_digest, record_type, refers_to, target_uri, archive, at (the frame's
    place), valid, problem. A revisit's payload values are those it states of
    the full payload; the reader checks all it can: frames and their checksums,
    headers, lengths, block and payload digests. A folder without archives gives none."""
    bound_batches(spark)
    return read_blobs(spark, path).select("path", "content").mapInArrow(_records, RESULT)


def warc_round_trip(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Writes pages to archives on shared storage and reads them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, min_payload=min_payload)
    return read_warc(pages.sparkSession, path)
