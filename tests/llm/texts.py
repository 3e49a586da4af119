"""Inputs the tests of this folder share."""

from __future__ import annotations

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
EDGE_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "A b a B a b a b",
    "same line\nsame line\n\n  \nsame line",
    "élan Ünï    x\x1cy ÀÉ the",
    LONG,
    "tie tie tie",
    "tie tie tie",
]


def make_docs(spark, texts, sources=None, ids=None):
    rows = [
        ((ids[i] if ids else i), t, "en", (sources[i % len(sources)] if sources else "src0"), len(t or ""))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, COLUMNS)
