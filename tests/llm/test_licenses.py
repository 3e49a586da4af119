from __future__ import annotations

import re

from texts import make_docs
from pulsegrid.llm import licenses as L

TEXTS = [
    "x MIT license, mit-LICENSE; MIT\nlicense mit licenses permit license",
    "the gnu general  public license and CC-BY cc by-nc, Apache License",
    "Licensed under CC BY-NC 4.0.",
    "filler " * 30 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this program" + " filler" * 40,
    "Redistribution and use in source and binary forms",
    "mit license " * 3,
    "émit license mit licenseé",
]


def windows(words):
    return [words[i : i + L.BLOCK] for i in range(0, max(len(words), 1), L.STRIDE)]


def brute(text):
    words = re.findall(L.LETTER + "+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [
        (i, label)
        for phrase, label in L.PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    base = sorted(labels)
    for label, notice in L.TEMPLATES.items():
        own = set(L.split_words(notice))
        share = max(len(own & set(w)) / len(own) for w in windows(words))
        if share >= L.THRESHOLD:
            labels.add(label)
            score = max(score, share)
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted(labels)), score


def test_scan_equals_brute_force(spark, edge_docs, sample_docs, clashing):
    docs = clashing(make_docs(spark, TEXTS).unionByName(edge_docs).unionByName(sample_docs))
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, brute(r["text"])) for r in docs.collect()), key=str)
    rows = L.scan(docs).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, tuple(r[n] for n in names)) for r in rows), key=str)
    assert found == texts
    assert any("mit-permission" in r["labels"] for r in rows) and any("cc-by-nc-4.0" in r["labels"] for r in rows)


def test_prefixes_follow_the_global_order(spark):
    docs = make_docs(spark, ["the the the under under license"])
    template = L.order_templates(docs, {"x": "under the license rarely"}, 0.5)[0]
    assert template.words == ("rarely", "license", "under", "the")
    assert template.need == 2 and template.prefix == ("rarely", "license", "under")


def test_empty_table_and_long_notice(no_docs, edge_docs):
    assert L.scan(no_docs).count() == 0
    try:
        L.scan(edge_docs, notices={"long": "w " * 40})
    except ValueError:
        return
    raise AssertionError("a notice longer than a stride must be refused")


def test_only_latin_capitals_are_lowered(spark):
    """The Kelvin sign and the dotted capital I are letters of their own and not k and i."""
    from pyspark.sql import functions as F

    texts = ["MIT License", "MİT License", "KEEP THE KÉÈP", "ÉTÉ GNU General Public License"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(L.words_column(F.col("text"))).collect()]
    assert found[0] == ["mit", "license"] and found[1] == ["mİt", "license"]
    assert found[2][0] == "Keep" and found[3][1:] == ["gnu", "general", "public", "license"]
