"""Licence scans by sentence rules."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, values_of

# Known licence sentences by identifier, in normalised form (see
# ``normalised``). <*> stands for up to twelve words, for names and years.
SENTENCES = {
    "ApacheNotice": "licensed under the apache license version 2.0",
    "ApacheNoticeThe": "licensed under the apache license version 2.0 the license",
    "ApacheNoUse": "you may not use this file except in compliance with the license",
    "ApacheObtain": "you may obtain a copy of the license at",
    "ApacheObtainUrl": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitNotice": "released under the mit license",
    "MitLicensed": "licensed under the mit license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNoticeKept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MitLiability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BsdNames": "neither the name of <*> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BsdNotice": "licensed under the bsd license",
    "IscGrant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "Gpl3Work": "this work is licensed under the gnu general public license version 3",
    "Gpl2Work": "this work is licensed under the gnu general public license version 2",
    "Gpl3Terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "Gpl2Terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "GplHope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplSee": "see the gnu general public license for more details",
    "LgplTerms": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version <*> of the license or at your option any later version",
    "AgplWork": "this work is licensed under the gnu affero general public license version 3",
    "MplTerms": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "CcByNc": "licensed under cc by-nc 4.0",
    "CcBy": "licensed under cc by 4.0",
    "CcBySa": "licensed under cc by-sa 4.0",
    "CcByNcWork": "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
    "CcByWork": "this work is licensed under a creative commons attribution 4.0 international license",
    "CcZero": "licensed under cc0 1.0",
    "Unlicense": "this is free and unencumbered software released into the public domain",
    "ApacheTitle": "apache license version 2.0 january 2004",
    "ApacheTerms": "terms and conditions for use reproduction and distribution",
    "ApacheCopyright": "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non-exclusive no-charge royalty-free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    "Gpl3Title": "gnu general public license version 3 29 june 2007",
    "Gpl3Free": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "Gpl2Title": "gnu general public license version 2 june 1991",
    "Gpl2Freedom": "the licenses for most software are designed to take away your freedom to share and change it",
    "Lgpl3Title": "gnu lesser general public license version 3 29 june 2007",
    "Lgpl21Title": "gnu lesser general public license version 2.1 february 1999",
    "Agpl3Title": "gnu affero general public license version 3 19 november 2007",
    "Agpl3Terms": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "MplTitle": "mozilla public license version 2.0",
    "ZlibAsIs": "this software is provided as-is without any express or implied warranty",
    "ZlibGrant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "BoostGrant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "EclipseText": "the accompanying program is provided under the terms of this eclipse public license",
    "CcZeroDeed": "the person who associated a work with this deed has dedicated the work to the public domain",
}

# What licences are called in notices such as "released under the MIT
# License", in normalised form. The longest name that fits counts.
NAMES = {
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache license v2.0", "apache 2.0 license", "apache 2.0", "apache-2.0", "apache license"),
    "MIT": ("mit license", "mit licence", "mit"),
    "BSD-3-Clause": ("bsd 3-clause license", "bsd 3-clause", "bsd-3-clause", "3-clause bsd license", "new bsd license"),
    "BSD-2-Clause": ("bsd 2-clause license", "bsd 2-clause", "bsd-2-clause", "2-clause bsd license", "simplified bsd license"),
    "BSD": ("bsd license", "bsd"),
    "ISC": ("isc license",),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3", "gnu general public license v3.0", "gnu gpl version 3", "gnu gpl v3", "gplv3", "gpl v3", "gpl-3.0"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2", "gnu general public license v2.0", "gnu gpl version 2", "gnu gpl v2", "gplv2", "gpl v2", "gpl-2.0"),
    "GPL": ("gnu general public license", "gnu gpl", "gpl"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lgpl v3", "lgplv3", "lgpl-3.0"),
    "LGPL-2.1": ("gnu lesser general public license version 2.1", "gnu lgpl v2.1", "lgplv2.1", "lgpl-2.1"),
    "LGPL": ("gnu lesser general public license", "lgpl"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license", "agplv3", "agpl-3.0"),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license 2.0", "mpl 2.0", "mpl-2.0"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license 2.0", "epl-2.0"),
    "BSL-1.0": ("boost software license version 1.0", "boost software license"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "CC0-1.0": ("cc0 1.0", "cc0-1.0", "cc0", "creative commons zero"),
    "CC-BY-4.0": ("cc by 4.0", "cc-by 4.0", "cc-by-4.0", "creative commons attribution 4.0 international license", "creative commons attribution 4.0"),
    "CC-BY-SA-4.0": ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0 international license"),
    "CC-BY-NC-4.0": ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by-nc-sa 4.0", "cc-by-nc-sa-4.0"),
    "CC-BY-ND-4.0": ("cc by-nd 4.0", "cc-by-nd-4.0"),
}
NOTICE_VERBS = frozenset("licensed licenced released distributed available published provided shared covered".split())
NOTICE_FILL = frozenset("the a an terms conditions and of this".split())

# Licence rules in order. A rule is a sequence of sentence
# identifiers; a trailing ? marks one that may be missing.
RULES = (
    ("BSD-3-Clause", "BsdGrant BsdSource BsdBinary BsdNames BsdAsIs?"),
    ("BSD-2-Clause", "BsdGrant BsdSource BsdBinary BsdAsIs?"),
    ("MIT", "MitNotice? MitGrant MitNoticeKept MitAsIs? MitLiability?"),
    ("ISC", "IscGrant MitAsIs?"),
    ("Apache-2.0", "ApacheNoticeThe ApacheNoUse ApacheObtain? ApacheObtainUrl? ApacheAsIs? ApacheSee?"),
    ("GPL-3.0-or-later", "Gpl3Terms GplHope? GplSee?"),
    ("GPL-2.0-or-later", "Gpl2Terms GplHope? GplSee?"),
    ("AGPL-3.0-or-later", "Agpl3Terms GplHope?"),
    ("LGPL", "LgplTerms"),
    ("MPL-2.0", "MplTerms"),
    ("Zlib", "ZlibAsIs ZlibGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("EPL-2.0", "EclipseText"),
    ("Apache-2.0", "ApacheTitle ApacheTerms? ApacheCopyright?"),
    ("GPL-3.0", "Gpl3Title Gpl3Free?"),
    ("GPL-2.0", "Gpl2Title Gpl2Freedom?"),
    ("LGPL-3.0", "Lgpl3Title"),
    ("LGPL-2.1", "Lgpl21Title"),
    ("AGPL-3.0", "Agpl3Title"),
    ("CC0-1.0", "CcZeroDeed"),
    ("Apache-2.0", "ApacheNotice"),
    ("Apache-2.0", "ApacheNoticeThe"),
    ("MIT", "MitNotice"),
    ("MIT", "MitLicensed"),
    ("BSD", "BsdNotice"),
    ("GPL-3.0", "Gpl3Work"),
    ("GPL-2.0", "Gpl2Work"),
    ("AGPL-3.0", "AgplWork"),
    ("CC-BY-NC-4.0", "CcByNc"),
    ("CC-BY-NC-4.0", "CcByNcWork"),
    ("CC-BY-SA-4.0", "CcBySa"),
    ("CC-BY-4.0", "CcBy"),
    ("CC-BY-4.0", "CcByWork"),
    ("CC0-1.0", "CcZero"),
    ("Unlicense", "Unlicense"),
    ("MPL-2.0", "MplTitle"),
)

#: Every known sentence, name and tag has one of these; a text with none has no match.
ANCHORS = ("licens", "licenc", "permission", "redistribut", "warrant", "copyright", "public domain", "software", "gpl", "spdx", "cc0", "cc by", "cc-by", "creative", "apache", "under mit", "under the mit", "bsd", "epl-", "mpl", "mozilla", "terms")

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
SPDX = re.compile(r"(?i)spdx-license-identifier[ \t]*:[ \t]*([^\n\r]*)")
SPDX_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
#: Up to so many words stand for <*>.
OPEN = 12


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of the sentences: lines, cut behind one of .!?:; before white space."""
    out, start = [], 0
    for m in re.finditer(r"(?<=[.!?:;])\s+|\n+", text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def normalised(sentence: str) -> str:
    """Lower case; words of letters, digits and inner . or -, one space between."""
    return " ".join(WORD.findall(sentence.lower()))


class Recogniser:
    """Finds known sentences, notices and tags in a text's normalised words, wherever
    they begin and however its lines break, and matches their identifiers with rules."""

    def __init__(self, known: dict[str, str], rules: tuple[tuple[str, str], ...], max_gap: int, names: dict[str, tuple[str, ...]]) -> None:
        self.known: dict[tuple[str, ...], list[tuple[tuple[str, ...], str]]] = {}
        for name, s in known.items():
            words = tuple(s.split())
            if words[0] == "<*>":
                raise ValueError(f"{name} begins with <*>")
            self.known.setdefault(words[: 1 if "<*>" in words[:2] else 2], []).append((words, name))
        for same in self.known.values():
            same.sort(key=lambda x: (-len(x[0]), x[1]))
        self.names: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for licence, forms in names.items():
            for form in forms:
                words = tuple(form.split())
                self.names.setdefault(words[0], []).append((words, licence))
        for same in self.names.values():
            same.sort(key=lambda x: (-len(x[0]), x[1]))
        every = [(licence, sequence.split()) for licence, sequence in rules] + [(licence, [f"Notice:{licence}"]) for licence in names]
        self.rules = [(licence, [(x.rstrip("?"), x.endswith("?")) for x in sequence]) for licence, sequence in every]
        self.max_gap = max_gap
        forms = [s for s in known.values()] + ["under " + f for fs in names.values() for f in fs]
        self.reach = max(len(s.split()) + OPEN * s.count("<*>") for s in forms) + 16
        if lone := [s for s in forms if not any(a in s for a in ANCHORS)]:
            raise ValueError(f"without an anchor: {lone}")

    @staticmethod
    def _fits(words: list[str], at: int, form: tuple[str, ...]) -> int | None:
        """Where the form that begins at ``at`` ends, or None."""
        for k, x in enumerate(form):
            if x == "<*>":
                ends = (Recogniser._fits(words, at + n, form[k + 1 :]) for n in range(1, OPEN + 1))
                return next((e for e in ends if e is not None), None)
            if at >= len(words) or words[at] != x:
                return None
            at += 1
        return at

    def at(self, words: list[str], i: int) -> tuple[int, str] | None:
        """(end, identifier) of the known sentence that begins at word i, the longest form
        first, or of a notice."""
        for form, name in (*self.known.get(tuple(words[i : i + 2]), ()), *self.known.get((words[i],), ())):
            if (end := self._fits(words, i, form)) is not None:
                return end, name
        if words[i] in NOTICE_VERBS and words[i + 1 : i + 2] == ["under"]:
            j = i + 2
            while j < min(len(words), i + 8) and words[j] in NOTICE_FILL:
                j += 1
            for form, licence in self.names.get(words[j], ()) if j < len(words) else ():
                if (end := self._fits(words, j, form)) is not None:
                    return end, f"Notice:{licence}"
        return None

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str]]]:
        """The number of sentences, and (first, last, identifier) of the known ones by
        the sentence numbers of their first and last word. The words pass in pieces."""
        places = [s for s, _ in sentences(text)]
        found: list[tuple[int, int, int, str]] = []
        words: list[str] = []
        starts: list[int] = []
        source = WORD.finditer(text)
        free = 0
        done = False
        while not done or words:
            before = len(words)
            for m in itertools.islice(source, 1 << 16):
                words.append(m[0].lower())
                starts.append(m.start())
            done = len(words) - before < 1 << 16
            i, stop = free, len(words) if done else len(words) - self.reach
            while i < stop:
                if hit := self.at(words, i):
                    end, name = hit
                    found.append((starts[i], starts[end - 1], 0, name))
                    i = end
                else:
                    i += 1
            free = max(0, i - stop)
            del words[:stop], starts[:stop]
        for m in SPDX.finditer(text):
            found += [(m.start(), m.start(), k + 1, f"Spdx:{x}") for k, x in enumerate(x for x in SPDX_ID.findall(m[1]) if x.upper() not in ("AND", "OR", "WITH"))]
        numbered = [(bisect.bisect_right(places, a) - 1, bisect.bisect_right(places, b) - 1, name) for a, b, _, name in sorted(found)]
        return len(places), numbered

    def match(self, found: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
        """(licence, first sentence, last) by the rules in their order; a sentence
        serves one rule at most. Between two of a rule's sentences at most
        ``max_gap`` unknown ones may stand. Tags name their licence themselves."""
        used_up = [False] * len(found)
        out = [(name[5:], a, b) for a, b, name in found if name.startswith("Spdx:")]
        by_name: dict[str, list[int]] = {}
        for k, (_, _, name) in enumerate(found):
            by_name.setdefault(name, []).append(k)
        for licence, sequence in self.rules:
            lead = [k for k, (_, optional) in enumerate(sequence) if not optional][0]
            begins = sorted({i for name, _ in sequence[: lead + 1] for i in by_name.get(name, ())})
            for i in begins:
                used: list[int] = []
                at = i
                for name, optional in sequence:
                    if at < len(found) and not used_up[at] and found[at][2] == name and (not used or found[at][0] - found[used[-1]][1] - 1 <= self.max_gap):
                        used.append(at)
                        at += 1
                    elif not optional:
                        used = []
                        break
                if used:
                    for j in used:
                        used_up[j] = True
                    out.append((licence, found[used[0]][0], found[used[-1]][1]))
        return sorted(out, key=lambda x: (x[1], x[2]))


def _scan(recogniser: Recogniser) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), values_of(batch.column(1)), strict=True):
                text = text or ""
                low = text.lower()
                if any(a in low for a in ANCHORS):
                    n, found = recogniser.scan(text)
                    matches = recogniser.match(found)
                else:
                    n, found, matches = len(sentences(text)), [], []
                rows.append((doc, n, ",".join(x for _, _, x in found), ",".join(dict.fromkeys(x for x, _, _ in matches)), ",".join(f"{x}:{i}:{j}" for x, i, j in matches)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*"abcde"])

    return run


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None,
    rules: tuple[tuple[str, str], ...] | None = None, max_gap: int = 2, names: dict[str, tuple[str, ...]] | None = None,
) -> DataFrame:
    """One row per input row: id, n_sentences, sentence_ids (in order), licenses
    (distinct, in order), matches (licence:first:last sentence numbers).

    Sentences are lines, cut behind a sign that ends one. The known sentences are
    looked for in the text's normalised words, so it does not matter how lines break,
    what marks a comment, or what stands before and after in the same sentence. Of
    sentences that begin at the same word the longest counts; the next is sought behind
    it. Notices (``released under the ... License``) and SPDX tags have identifiers of
    their own. Then the identifiers are matched with the rules, in the rules' order.

    Null and empty texts have no sentences and empty strings. Texts of any length are
    scanned whole, in pieces of words. Rows are independent, so repeats get the same
    values and there is no shuffle; an empty table gives no rows; other columns are
    ignored, whatever their names. Texts without an anchor word only have their sentences
    counted, since every known sentence has one. The tables are of fixed size.
    """
    bound_batches(docs.sparkSession)
    recogniser = Recogniser(known or SENTENCES, rules or RULES, max_gap, NAMES if names is None else names)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        _scan(recogniser), f"{id_col} long, n_sentences long, sentence_ids string, licenses string, matches string"
    )
