"""Limits come from all labelled rows."""

from __future__ import annotations

import random

from sparsela.llm.quality import Bands, Calibration, Judge, calibrated, fitted


def test_calibration_measures_every_row_and_chunk(spark):
    """Of a text 64 chunks were measured, and 20,000 rows at most, before."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words[: rng.randrange(60, 400)]) for _ in range(rng.randrange(60, 700))) for _ in range(300)]
    texts.append(" ".join(rng.choice(words) if k // 4000 != 7 else str(rng.random()) for k in range(60_000)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    judge, rows = Judge(Bands(), 50, 50), []
    for t in texts:
        raw = t.encode()
        if not judge.base(raw)[1]:
            rows.append((len(raw), judge.ratio(raw), [judge.chunk_ratio(raw, k) for k in range(len(raw) // 1024)]))
    got, want = calibrated(docs, docs, how=Calibration(reject=0.01)), fitted(rows, Bands(), Calibration(reject=0.01))
    assert max(len(r[2]) for r in rows) > 64 and [x[0] for x in got.document] == [x[0] for x in want.document]
    pairs = [*zip(got.document, want.document, strict=True), (got.chunk_limits, want.chunk_limits)]
    assert all(abs(a - b) < 2e-6 for x, y in pairs for a, b in zip(x, y, strict=True))
    assert not hasattr(Calibration(), "sample_rows")
