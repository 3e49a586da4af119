from __future__ import annotations

import re
from collections import Counter

from pulsegrid.llm.quality import RULES, STOP_WORDS, Rule, compile_rules, keep_good, verdicts

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(f"[^{SPACE}]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    stop = {form for w in STOP_WORDS for form in (w, w.capitalize())}
    n = len(words)
    ratio = lambda a, b: a / b if b else 0.0
    chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = n < 50 or 100 * len(covered) > 50 * n
    values = {
        "mean_word_chars": ratio(chars, n),
        "symbol_ratio": ratio(symbols, n),
        "stop_word_ratio": ratio(sum(w in stop for w in words), n),
        "dup_line_ratio": ratio(len(lines) - len(set(lines)), len(lines)),
    }
    good = all((r.least is None or values[r.measure] >= r.least) and (r.most is None or values[r.measure] <= r.most) for r in RULES)
    return n, chars, symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and good


def test_measures_and_verdict_equal_brute_force(edge_docs, sample_docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    for docs in (edge_docs, sample_docs):
        rows = verdicts(docs).select("text", *names).collect()
        assert len(rows) == docs.count()
        for row in rows:
            assert tuple(row[n] for n in names) == brute(row["text"])


def test_keep_good_returns_the_rows_as_they_came(edge_docs, sample_docs, clashing, no_docs):
    docs = clashing(sample_docs.unionByName(edge_docs))
    kept = keep_good(docs)
    assert kept.schema == docs.schema
    expected = sorted(str(r) for r in docs.collect() if brute(r["text"])[-1])
    assert sorted(map(str, kept.collect())) == expected and expected
    assert keep_good(no_docs).count() == 0


def test_rules_are_bounds_of_a_table(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "m double")
    assert [r[0] for r in df.where(compile_rules((Rule("m", 2.0, 2.5),))).collect()] == [2.0]
    assert df.where(compile_rules(())).count() == 3


def test_measures_replace_columns_of_their_name(edge_docs, clashing):
    df = verdicts(clashing(edge_docs))
    assert df.columns.count("n_words") == 1
    assert dict(df.dtypes)["n_words"] == "bigint" and dict(df.dtypes)["_row"] == "string"
