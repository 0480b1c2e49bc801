"""Operators that work row by row: quality, personal data, licences, language."""

import hashlib
import random
from collections import Counter

import pytest
from brute import base_spans, quality

from pyspark.sql import functions as F

from sparsela.llm.langid import Settings, Subwords, identify, labelled_sample, train, train_and_identify
from sparsela.llm.licenses import NAMES, RULES, SENTENCES, WORD, Recogniser, license_scan, normalised, sentences
from sparsela.llm.pii import Deobfuscator, find_spans, personal_data, redact, redacted, written
from sparsela.llm.quality import Bands, Calibration, Judge, calibrated, corpus_bands, fitted, quality_rules
from sparsela.llm.queries import QUERIES

ODD = [None, "", " \n\t ", "x", "a b", "é" * 50, "a b c a b c", "w " * 5000, "# * $ <>|&%", "line\nline\n\nline\n line", "🙂 one two\n🙂 one two"]


def frame(spark, texts, more=""):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + more)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_quality_counts(spark, sf_dir, texts):
    got = {r["doc_id"]: tuple(r)[1:6] for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect()}
    assert got == {i: quality(t) for i, t in texts}
    odd = {r["doc_id"]: tuple(r)[1:6] for r in quality_rules(frame(spark, ODD)).collect()}
    assert odd == {i: quality(t) for i, t in enumerate(ODD)}


def test_quality_bands(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(4000)]
    prose = " ".join(rng.choices(words, k=600))
    noise = " ".join("".join(chr(rng.randrange(33, 0x2000)) for _ in range(9)) for _ in range(300))
    block = " ".join(rng.choices(words, k=90))
    copied = block + "\n" + " ".join(rng.choices(words, k=120))
    flat = " ".join(("ab" * 30) + str(i) for i in range(400))
    got = [r["kept"] for r in quality_rules(frame(spark, [prose, noise, copied, flat])).orderBy("doc_id").collect()]
    assert got == [True, False, True, False]
    assert Bands().document == tuple(sorted(Bands().document))


def test_quality_verdict_against_brute_force(spark, sf_dir, texts):
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bands = corpus_bands(spark, docs, sf_dir)
    assert bands != Bands()
    zip_ = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, sf_dir).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        n, _, _, _, repeat = quality(t)
        failed = n < 50 or 100 * repeat > 50 * n
        low, high = bands.limits(len(raw))
        parts = [raw[k : k + 1024] for k in range(0, len(raw) - 1023, 1024)]
        bad = [not bands.chunk_limits[0] <= len(zip_.compress(x)) / 1024 <= bands.chunk_limits[1] for x in parts]
        good = not raw or low <= len(zip_.compress(raw)) / len(raw) <= high
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed and good and sum(bad) <= len(bad) / 2)


def test_calibration_tells_junk_from_prose(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_quality_rules"](spark, d).collect() if not r["base_failed"]]
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1]
    junk = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.99 * len(good) and sum(junk) <= 0.8 * len(junk)
    assert calibrated(docs, docs.filter("false")) == Bands()
    assert fitted([], Bands(), Calibration()).chunk_limits == Bands().chunk_limits
    assert fitted([(1000, 0.5, [0.6])] * 50, Bands(), Calibration()).limits(1000) == (0.496, 0.504)


def test_row_operators_on_repeats_nulls_long_texts_and_clashes(spark):
    long = "word " * 300_000
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, long), (3, None)]
    names = "1 as kept", "2 as n_words", "3 as base_failed", "4 as spans", "5 as licenses", "6 as lang_pred", "'en' as lang"
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *names)
    for run in (quality_rules, personal_data, license_scan, train_and_identify):
        got = sorted((tuple(r) for r in run(docs).collect()), key=str)
        assert len(got) == 5 and sum(r[0] is None for r in got) == 1
        same = [r[1:] for r in got if r[0] == 1]
        assert same[0] == same[1]
        assert run(docs.limit(0)).count() == 0
    assert redact(docs).columns == docs.columns


def test_quality_empty_table_and_extra_columns(spark):
    assert quality_rules(frame(spark, []).limit(0)).count() == 0
    clash = frame(spark, ["a b"]).selectExpr("*", "1 as kept", "2 as n_words", "3 as base_failed")
    assert quality_rules(clash).columns[-1] == "kept"


def test_base_spans(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op9_pii"](spark, sf_dir).collect()}
    for i, t in texts:
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x.startswith(k) for x in want) for k in ("email", "ip", "card", "phone")]


def test_base_spans_on_hard_texts():
    rng = random.Random(5)
    dob = Deobfuscator()
    for _ in range(3000):
        t = "".join(rng.choices("0123456789.@+ -()ab%é", k=rng.randint(0, 60)))
        assert written(find_spans(t, dob)[0]) == ",".join(base_spans(t)), t
    long = "1" * 200_000 + "a" * 200_000 + "." * 1000 + " " * 200_000 + "( " * 20_000 + "one " * 3 + " at dot " * 5_000
    assert find_spans(long, dob) == ([], [])


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("mail john (at) example (dot) com now", "email", "john (at) example (dot) com"),
        ("mail john.roe [AT] mail.example [dot] org", "email", "john.roe [AT] mail.example [dot] org"),
        ("write to jane at example dot com please", "email", "jane at example dot com"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("call +1 five five five one two three four five six seven", "phone", "+1 five five five one two three four five six seven"),
        ("host １９２.168.0.1 up", "ip", "１９２.168.0.1"),
        ("number five five five six six +1 five five five six six five five five two", "phone", "+1 five five five six six five five five two"),
        ("card four one one one 1111 1111 1111 1111.", None, None),
        ("pay 4111 1111 1111 111one now", "card", "4111 1111 1111 111one"),
        ("host 192 dot 168 dot 0 dot 1 up", "ip", "192 dot 168 dot 0 dot 1"),
        ("ip one nine two.one six eight.zero.one ok", "ip", "one nine two.one six eight.zero.one"),
        ("mail john@example dot com", "email", "john@example dot com"),
        ("mail john (at) example dot com", "email", "john (at) example dot com"),
        ("jane dot roe at mail dot example dot org!", "email", "jane dot roe at mail dot example dot org"),
        ("pay 4111​1111​1111​1111 now", "card", "4111​1111​1111​1111"),
    ],
)
def test_deobfuscation(text, kind, piece):
    base, added = find_spans(text, Deobfuscator())
    if kind is None:
        return
    assert [(text[s:e]) for s, e, k in added] == [piece]
    assert written(added).startswith(kind)


def test_deobfuscation_is_linear():
    import time

    dob = Deobfuscator()
    for make in (lambda n: "a dot " * n + "x at ", lambda n: "x at " * n, lambda n: "a@" * n + " dot ", lambda n: "one " * n, lambda n: ("one" + " " * 9) * n, lambda n: "1 dot " * n):
        began = time.perf_counter()
        find_spans(make(60_000), dob)
        assert time.perf_counter() - began < 10


def test_clean_text_has_no_added_spans(texts):
    dob = Deobfuscator()
    assert all(not find_spans(t, dob)[1] for _, t in texts)
    assert find_spans("we met at noon. dot com firms at large", dob) == ([], [])


def test_redaction(spark):
    docs = frame(spark, ["to a@b.cd and +1 (212) 555-0100", None, "clean"])
    rows = redact(docs).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["to [EMAIL] and [PHONE]", None, "clean"]
    assert [r["n_chars"] for r in rows] == [22, 0, 5]
    assert redact(docs).columns == docs.columns
    assert redacted("abcdef", [(1, 4, 0), (2, 5, 1)]) == "a[EMAIL]f"
    assert [r["spans"] for r in personal_data(frame(spark, ODD)).collect()] == [""] * len(ODD)


def test_license_rules(spark):
    mit = "\n".join(["MIT License", "", SENTENCES["MitGrant"].capitalize() + ":", "", SENTENCES["MitNoticeKept"] + ".", "", SENTENCES["MitAsIs"].upper() + "."])
    bsd3 = ". ".join(SENTENCES[x].replace("<*>", "ACME Inc") for x in ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")) + "."
    bsd2 = ". ".join(SENTENCES[x] for x in ("BsdGrant", "BsdSource", "BsdBinary")) + "."
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    lines = "Prose.\nLicensed under the Apache License, Version 2.0.\nMore prose. Released under the MIT License.\nLicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3."
    clean = "A license to thrill. Permission was refused; no warranty."
    got = [r["licenses"] for r in license_scan(frame(spark, [mit, bsd3, bsd2, gpl, lines, clean, None, ""])).orderBy("doc_id").collect()]
    assert got == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-or-later", "Apache-2.0,MIT,CC-BY-NC-4.0,GPL-3.0", "", "", ""]


def test_license_query_against_plain_search(spark, sf_dir, texts):
    plain = {"Licensed under the Apache License, Version 2.0.": "ApacheNotice", "Released under the MIT License.": "MitNotice", "Licensed under CC BY-NC 4.0.": "CcByNc", "This work is licensed under the GNU General Public License, version 3.": "Gpl3Work"}
    got = {r["doc_id"]: r["sentence_ids"] for r in QUERIES["op5_license_scan"](spark, sf_dir).collect()}
    for i, t in texts:
        want = [plain[x.strip()] for x in t.split("\n") if x.strip() in plain]
        assert [x for x in got[i].split(",") if x] == want
    assert Recogniser(SENTENCES, RULES, 2, NAMES).match([]) == []


def test_licenses_inside_sentences_and_over_lines(spark):
    import textwrap

    mit = " ".join([SENTENCES["MitGrant"].capitalize() + ":", SENTENCES["MitNoticeKept"] + ".", SENTENCES["MitAsIs"].upper() + "."])
    cases = [
        ("\n".join(textwrap.wrap(mit, 30)), "MIT"),
        ("\n".join(" * " + x for x in textwrap.wrap(mit, 40)), "MIT"),
        ("This file is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("// SPDX-License-Identifier: (GPL-2.0-only OR MIT)\nint x;", "GPL-2.0-only,MIT"),
        ("This work is released under the MIT License.", "MIT"),
        ("word " * 70_000 + "distributed under the terms of the GNU GPL v3", "GPL-3.0"),
        ("The spdx tag of a licence.", ""),
        (None, ""),
    ]
    got = [r["licenses"] for r in license_scan(frame(spark, [t for t, _ in cases])).orderBy("doc_id").collect()]
    assert got == [x for _, x in cases]


def test_license_rules_against_brute_force():
    # sentences and rules of one-letter words, in random order, against a search of all ways
    known = {"A": "license a", "B": "license b", "C": "license c", "O": "license <*> end"}
    rules = (("one", "A B C?"), ("two", "A? B"), ("three", "C"))
    r = Recogniser(known, rules, 1, {})
    rng = random.Random(8)
    for _ in range(400):
        picks = [rng.choice(["A", "B", "C", "x", "x", "O"]) for _ in range(rng.randint(0, 9))]
        text = "\n".join({"x": "other words", "O": "license q r end"}.get(p, f"some License {p}!") for p in picks)
        n, found = r.scan(text)
        want = [(i, i, p) for i, p in enumerate(picks) if p != "x"]
        assert (n, found) == (len(picks), want)
        free, out = set(range(len(want))), []
        for licence, sequence in rules:
            parts = [(p.rstrip("?"), p.endswith("?")) for p in sequence.split()]
            for i in range(len(want)):
                at, used = i, []
                for name, optional in parts:
                    if at in free and want[at][2] == name and (not used or want[at][0] - want[used[-1]][0] <= 2):
                        used.append(at)
                        at += 1
                    elif not optional:
                        used = None
                        break
                if used:
                    free -= set(used)
                    out.append((licence, want[used[0]][0], want[used[-1]][0]))
        assert r.match(found) == sorted(out, key=lambda x: (x[1], x[2]))


def test_known_sentences_are_normalised():
    for s in SENTENCES.values():
        assert normalised(s.replace("<*>", "x")) == s.replace("<*>", "x")
    assert sentences("a. b\n\nc") == [(0, 2), (3, 4), (6, 7)] and WORD.findall("a-b c.d.") == ["a-b", "c.d"]


def test_language_held_out(spark, sf_dir):
    got = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = frame(spark, [None, "", "123 !!", "the house", "x" * 100_000])
    got = train_and_identify(docs).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    rows = [("the cat and the dog sat there " * 3, "en"), ("der hund und die katze sind hier " * 3, "de")] * 40
    model = train(rows, Settings(epochs=3))
    got = identify(frame(spark, ["and the cat", "und der hund", "42"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["en", "de", "und"]
    assert len(Subwords(Settings()).points("42")) == 0 and train([("1", "en")]) is None
    for text in ("\U0001f600\U0001f600", "\U0001d7d9\U0001d7da", "\U00010107"):
        assert len(Subwords(Settings()).points(text)) == 0
    assert len(Subwords(Settings()).points("\U00010400 \U00020000")) == 5


def plain_prediction(model, text):
    """The model's answer from its layers, n-gram by n-gram."""
    import math

    points = []
    for c in (text or "").lower():
        if c.isalpha():
            points.append(ord(c))
        elif points and points[-1] != 32:
            points.append(32)
    points = [32, *points, *([32] if not points or points[-1] != 32 else []), *([32] if points and points[-1] == 32 else [])] if any(c.isalpha() for c in (text or "").lower()) else []
    if not points:
        return "und", 0.0
    total, n_grams = [0.0] * len(model.languages), 0
    for n in model.settings.orders:
        for at in range(len(points) - n + 1):
            h = 0
            for p in points[at : at + n]:
                h = ((h ^ p) * 16777619) & 0xFFFFFFFF
            x = ((h ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) * 0x85EBCA6B) & 0xFFFFFFFF
            b = (x ^ (x >> 15)) & (model.settings.buckets - 1)
            n_grams += 1
            for k in range(len(total)):
                total[k] += float(model.embeddings[b] @ model.weights[:, k])
    z = [(t / n_grams + float(model.bias[k])) / model.temperature for k, t in enumerate(total)]
    e = [math.exp(x - max(z)) for x in z]
    best = max(range(len(e)), key=lambda k: e[k])
    return model.languages[best], e[best] / sum(e)


def test_language_predictions_against_brute_force(spark):
    rows = [("the cat and the dog sat there " * 3, "en"), ("der hund und die katze sind hier " * 3, "de"), ("le chat et le chien sont ici " * 3, "fr")] * 30
    model = train(rows, Settings(epochs=2))
    cases = ["the cat", "  der Hund, 42 und!", "le chat", None, "", "42", "a", "x" * 300, "Katze\u00e9 \U00010400"]
    got = identify(frame(spark, cases), model).orderBy("doc_id").collect()
    for r, t in zip(got, cases, strict=True):
        lang, score = plain_prediction(model, t)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-4


def test_rare_languages_are_learned(spark):
    rows = [(i, "the cat and the dog sat there again", "en") for i in range(300)] + [(1000 + i, "zq wxy qqz zzw xwq yzq", "zz") for i in range(3)]
    rows += [(2000, "long " * 9000, "ll")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = labelled_sample(docs, Settings(), "text", "lang", F.col("doc_id"))
    assert Counter(lang for _, lang in sample) == {"en": 300, "zz": 3, "ll": 1} and max(len(t) for t, _ in sample) == 20_000
    assert train(sample, Settings(epochs=1)).languages == ["en", "ll", "zz"]
    assert len(labelled_sample(docs, Settings(sample_rows=30), "text", "lang", F.col("doc_id"))) == 14
    with pytest.raises(ValueError, match="languages"):
        labelled_sample(docs, Settings(max_languages=2), "text", "lang", F.col("doc_id"))
