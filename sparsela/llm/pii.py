"""Personal data: base patterns, and deobfuscation that keeps source places."""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, map_rows, values_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Look-behinds and possessive runs only spare the
# engine starts inside a run of digits, where no leftmost match can begin.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters that look like an ASCII one, by that one. Those whose
# compatibility decomposition is ASCII need no entry.
LOOKALIKES = {
    "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "m": "м",
    "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ",
    "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "@": "＠﹫", ".": "․。｡‧", "-": "‐‑‒–−", "+": "＋﹢", " ": "   ",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

#: A spelled digit that is a word of its own or touches digits.
SPELLED = re.compile(rf"(?i)(?<![^\W\d_])(?:{'|'.join(DIGIT_WORDS)})(?![^\W\d_])")
#: What may stand between two digits of one number: white space and hyphens, which go
#: where both are spelled, or a dot, which stays.
BETWEEN = re.compile(r"(?i)[ \-]*+(?:\.| dot )?+")
#: Marked words; white space around the marks goes with them.
MARKED = re.compile(r"(?i)[\(\[\{<]\s*+(?:(at|@)|dot|punkt|point|punto|\.)\s*+[\)\]\}>]")
#: Bare words need the whole shape of an address: a name, at or @, labels, one of the
#: two signs at least a word.
AT_SIGN = re.compile("(?i) at |@")
DOT_WORD = re.compile("(?i) dot ")
LABELS = re.compile(r"(?i)[A-Za-z0-9-]++(?:(?:\.| dot )[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"(?i)(?<![0-9])[0-9]++(?:(?:\.| dot )[0-9]++){3}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches of local part, @ and domain, found from each @ on, so
    that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind), by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in _parts(m[0]))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


def _parts(address: str) -> list[str]:
    """The four numbers, cut to a length that int() takes in any case."""
    return [x.lstrip("0")[:4] or "0" for x in address.split(".")]


class Deobfuscator:
    """A chain of transducers from text to normalised text with source places."""

    def __init__(self) -> None:
        self.map = {ord(c): ascii_ for ascii_, cs in LOOKALIKES.items() for c in cs} | {ord(c): "" for c in INVISIBLE}
        self.odd = re.compile(r"[^\x00-ſ‘-‟…€]|[ ­]")

    def character(self, c: str) -> str:
        """What stands for one character: ASCII where it disguises ASCII, else itself."""
        if (known := self.map.get(ord(c))) is not None:
            return known
        if (digit := unicodedata.decimal(c, None)) is not None:
            return str(digit)
        plain = unicodedata.normalize("NFKC", c)
        return plain if len(plain) == 1 and plain.isascii() else c

    def rewrite(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The normalised text, and the replaced source places in order."""
        edits: list[tuple[int, int, str]] = []
        for m in self.odd.finditer(text):
            new = self.character(m[0])
            if new != m[0]:
                edits.append((m.start(), m.end(), new))
        text, edits = self.apply(text, edits, [])
        for step in (self.spelled, self.marked, self.bare):
            text, edits = self.apply(text, step(text), edits)
        return text, edits

    @staticmethod
    def spelled(text: str) -> list[tuple[int, int, str]]:
        """Spelled digits next to other digits, spelled or not, by their digits; white
        space and hyphens between two spelled ones go."""
        out: list[tuple[int, int, str]] = []
        hits = list(SPELLED.finditer(text))
        for k, m in enumerate(hits):
            start, end = m.span()
            gap = BETWEEN.match(text, end).end()
            joins = k + 1 < len(hits) and hits[k + 1].start() == gap
            follows = k > 0 and BETWEEN.match(text, hits[k - 1].end()).end() == start
            near = joins or follows or text[gap : gap + 1].isdigit()
            if not near:
                at = start
                while at > 0 and text[at - 1] in " -":
                    at -= 1
                    if start - at > 8:
                        break
                near = at > 0 and (text[at - 1].isdigit() or (text[at - 1] == "." and text[max(0, at - 2)].isdigit()))
            if near:
                out.append((start, end, DIGIT_WORDS[m[0].lower()]))
                if joins and gap > end and not text[end:gap].strip(" -"):
                    out.append((end, gap, ""))
        return out

    @staticmethod
    def marked(text: str) -> list[tuple[int, int, str]]:
        """(at), [dot] and the like, by the sign."""
        out = []
        done = 0
        for m in MARKED.finditer(text):
            a, b = m.span()
            while a > done and text[a - 1].isspace():
                a -= 1
            while b < len(text) and text[b].isspace():
                b += 1
            out.append((a, b, "@" if m[1] else "."))
            done = b
        return out

    @staticmethod
    def bare(text: str) -> list[tuple[int, int, str]]:
        """name at host dot domain, name@host dot domain, 10 dot 0 dot 0 dot 1. Found from
        each sign on: a scan back ends at the sign before, one ahead at the next."""
        if not DOT_WORD.search(text):
            return []
        out = []
        for m in NUMBERS.finditer(text):
            out += [(*d.span(), ".") for d in DOT_WORD.finditer(text, *m.span())]
        done = 0
        for sign in AT_SIGN.finditer(text):
            start = sign.start()
            while start > done:
                if text[start - 1] in LOCAL:
                    start -= 1
                elif start - done >= 5 and start < sign.start() and text[start - 5 : start].lower() == " dot ":
                    start -= 5
                else:
                    break
            domain = LABELS.match(text, sign.end()) if start < sign.start() else None
            if domain is None:
                continue
            words = list(DOT_WORD.finditer(text, *domain.span()))
            name = list(DOT_WORD.finditer(text, start, sign.start()))
            if words or (name and sign[0] == "@"):
                out += [(*d.span(), ".") for d in (*name, *words)]
                if sign[0] != "@":
                    out.append((*sign.span(), "@"))
                done = domain.end()
        return sorted(set(out))

    @staticmethod
    def apply(text: str, new: list[tuple[int, int, str]], old: list[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int, str]]]:
        """Rewrites text by ``new`` and composes them with ``old``, which made it."""
        if not new:
            return text, old
        places = Places(old)
        parts, at = [], 0
        for s, e, r in new:
            parts += [text[at:s], r]
            at = e
        parts.append(text[at:])
        mapped = [(places.source(s, e), r) for s, e, r in new]
        spans = [x for x, _ in mapped]
        kept = [(s, e, r) for s, e, r in old if not any(a <= s and e <= b for a, b in spans[max(0, bisect.bisect_right(spans, (s, 1 << 60)) - 1) :][:1])]
        return "".join(parts), sorted([*kept, *((a, b, r) for (a, b), r in mapped)])


class Places:
    """From places in the normalised text back to the source, by its edits."""

    def __init__(self, edits: list[tuple[int, int, str]]) -> None:
        self.edits = edits
        self.starts, shift = [], 0
        for s, e, r in edits:
            self.starts.append(s + shift)
            shift += len(r) - (e - s)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self._one(start, False), self._one(end - 1, True) if end > start else self._one(start, False)

    def _one(self, at: int, last: bool) -> int:
        k = bisect.bisect_right(self.starts, at) - 1
        while k >= 0 and not self.edits[k][2] and not last and self.starts[k] == at:
            k -= 1
            if k < 0 or self.starts[k] != at:
                break
        if k < 0:
            return at + last
        s, e, r = self.edits[k]
        into = at - self.starts[k]
        if into < len(r):
            return e if last else s
        return e + into - len(r) + last

    def touched(self, start: int, end: int) -> bool:
        """Whether a rewritten source place lies inside this source span."""
        k = bisect.bisect_left(self.edits, (start, -1, ""))
        return k < len(self.edits) and self.edits[k][0] < end


def find_spans(text: str, deobfuscator: Deobfuscator) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, added spans)."""
    base = base_spans(text)
    plain, edits = deobfuscator.rewrite(text)
    added: list[tuple[int, int, int]] = []
    if edits:
        places = Places(edits)
        taken = {k: [x for x in base if x[2] == k] for k in range(len(KINDS))}
        for s, e, kind in base_spans(plain):
            a, b = places.source(s, e)
            if not places.touched(a, b):
                continue
            k = bisect.bisect_left(taken[kind], (b, -1, -1))
            if k and taken[kind][k - 1][1] > a:
                continue
            added.append((a, b, kind))
    return base, added


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span as [KIND]; of spans that overlap the first one's
    kind stands for all."""
    out, at = [], 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _detect(with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deobfuscator = Deobfuscator()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                base, added = find_spans(text or "", deobfuscator)
                counts = [sum(x[2] == k for x in base) for k in range(len(KINDS))]
                clean = redacted(text, base + added) if with_text and text is not None else None
                rows.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added), len(base) + len(added), clean))
            kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 10
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*"abcdefghij"])

    return run


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone and base_sha256
    of the base spans; spans, all of them (kind:start:end in code points of the
    source, comma-joined); n_added; n_spans; with_text adds redacted_text.

    Base spans are the leftmost matches of each kind that pass its check. Then
    the text is rewritten by transducers that keep their edits: characters that
    look like ASCII, invisible ones, spelled digits, marked and bare at/dot. What
    the base patterns find in the normalised text is mapped back, and added where
    it covers a rewritten place and no base span of its kind.

    Null and empty texts have no spans; the redacted null stays null. Rows are
    independent, so repeats get the same values and there is no shuffle; an empty table
    gives no rows. Scans are linear in a text's length, and whole. Spans that start
    together come in the order of the kinds. Other columns are ignored, whatever their
    names.
    """
    bound_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _detect(with_text),
        f"{id_col} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long, redacted_text string",
    )
    return out if with_text else out.drop("redacted_text")


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, rows, columns and order of columns unchanged, with personal data replaced
    in the text by its kind ([EMAIL]; of spans that overlap the first one's kind) and its
    length adjusted where it changed. Nulls stay null; ids don't matter."""

    t = docs.columns.index(text_col)
    n = docs.columns.index(length_col) if length_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deobfuscator = Deobfuscator()
        for batch in batches:
            new: list[str | None] = []
            sizes = batch.column(n).to_pylist() if n >= 0 else []
            for k, text in enumerate(values_of(batch.column(t))):
                spans = [] if text is None else sum(find_spans(text, deobfuscator), [])
                new.append(redacted(text, spans) if spans else text)
                if spans and n >= 0:
                    sizes[k] = len(new[-1])
            columns = list(batch.columns)
            columns[t] = pa.array(new, pa.string())
            if n >= 0:
                columns[n] = pa.array(sizes, batch.column(n).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    bound_batches(docs.sparkSession)
    return map_rows(docs, run, list(docs.schema))
