from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pulsegrid.llm import runs as R
from texts import LONG, make_docs


def brute(words, least=1, exponent=2):
    """All runs of two periods or more: for each period the longest stretches of agreeing words."""
    found = {}
    for period in range(1, len(words) // 2 + 1):
        at = 0
        while at + period < len(words):
            end = at
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end - at >= period:
                found.setdefault((at, end + period - at), period)  # the smallest period comes first
            at = max(end, at + 1) if end == at else end + 1
    kept = [(s, n, p) for (s, n), p in found.items() if n >= max(least, exponent * p)]
    return sorted(kept, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60) | st.lists(st.integers(0, 1), max_size=60))
def test_all_runs_are_found(words):
    assert sorted(R.runs_of(np.array(words, dtype=np.int64)), key=lambda r: (r[0], r[2])) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=12), st.integers(1, 9)), max_size=6))
def test_long_runs_are_found_in_stretches(parts):
    words = [w for part, times in parts for w in part * times]
    assert R.find_runs(words) == brute(words, 24, 3)
    assert R.find_runs(words, 12, 3) == brute(words, 12, 3)


@pytest.mark.parametrize("words", [[0] * 3000, [0, 1] * 1500, [0] * 700 + [1] + [0] * 700, list(range(40)) * 30])
def test_regular_texts(words):
    assert R.find_runs(words) == brute(words, 24, 3)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert R.find_runs(b) == brute(b, 24, 3)
    assert sorted(R.runs_of(np.array(b, dtype=np.int64)), key=lambda r: (r[0], r[2])) == brute(b)


def test_every_run_lies_in_a_stretch():
    rng = random.Random(5)
    for _ in range(200):
        words = []
        while len(words) < 300:
            part = [rng.randrange(6) for _ in range(rng.randint(1, 20))]
            words += part * rng.choice([1, 1, 2, 3, 5])
        spans = R.stretches(np.array(words, dtype=np.int64))
        assert all(any(a <= s and s + n <= b for a, b in spans) for s, n, _ in brute(words, 24, 3))


def test_accesses_stay_few():
    """Segments met per word grow like a logarithm, not with the depth of the tree."""
    words = np.array([0] * 20_000, dtype=np.int64)
    automaton = R.SuffixAutomaton(words.tolist())
    paths = R.PathColours(automaton.link)
    met = sum(1 for end, node in enumerate(automaton.prefixes, 1) for _ in paths.access(node, end))
    assert met < 3 * len(words)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words, 24, 3)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, kept)]
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def rows_of(df):
    return sorted(((str(r[0]), *r[1:]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, sf_dir, sample_docs):
    found = rows_of(R.op12_periodic_runs(spark, sf_dir))
    rows = [r for r in sample_docs.collect() if len(WORD.findall(r["text"] or "")) < 3000]
    wanted = {str(r["doc_id"]): expected(r["doc_id"], r["text"]) for r in rows}
    assert {r[0]: r[1:] for r in found if r[0] in wanted} == wanted
    assert len(found) == sample_docs.count() and sum(r[1] for r in found) > 5


def test_edge_texts(spark, edge_docs, clashing):
    found = R.detect_runs(clashing(edge_docs)).collect()
    assert len(found) == edge_docs.count()
    long = next(r for r in found if len(r["collapsed"]) > 3000)
    assert [tuple(r) for r in long["runs"]] == [(0, 60_000, 977)]
    assert long["collapsed"] == " ".join(LONG.split(" ")[:977])
    assert all(r["runs"] == [] for r in found if r is not long)


def test_planted_text(spark):
    texts = ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 4, "", None, "one", "x\x0by\x1cz  w"] * 12
    docs = make_docs(spark, texts)
    found = docs.select("doc_id", R.planted_text(docs["doc_id"], docs["text"]).alias("t")).collect()
    for (doc_id, text), source in zip(sorted((r["doc_id"], r["t"]) for r in found), texts):
        assert WORD.findall(text or "") == planted(doc_id, source)


def test_no_rows(spark, no_docs):
    assert R.detect_runs(no_docs).collect() == []
