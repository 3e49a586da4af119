from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import repeats as R
from texts import LONG, make_docs


def brute(rows, threshold):
    """{position: (spans, kept)} of rows (id, text) by looking up every window in order."""
    seen, found = set(), {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        body = (rows[i][1] or "").encode()
        gone = bytearray(len(body))
        for at in range(len(body) - threshold + 1):
            window = body[at : at + threshold]
            if window in seen:
                gone[at : at + threshold] = b"\1" * threshold
            seen.add(window)
        spans, at = [], 0
        while at < len(body):
            end = at
            while end < len(body) and gone[end] == gone[at]:
                end += 1
            if gone[at]:
                spans.append((at, end))
            at = end
        found[i] = (spans, bytes(b for b, g in zip(body, gone) if not g))
    return [found[i] for i in range(len(rows))]


def check(spark, rows, **options):
    docs = make_docs(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    found = R.cut_repeats(docs, **options).collect()
    ours = sorted((str(r["doc_id"]), r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in found)
    expected = brute(rows, options.get("threshold", R.THRESHOLD))
    theirs = sorted((str(i), len((t or "").encode()), spans, kept) for (i, t), (spans, kept) in zip(rows, expected))
    assert ours == theirs


def planted(seed, count, width, alphabet="abcdefgh \n", passages=6):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [make(rng.randint(width // 2, 3 * width)) for _ in range(passages)]
    texts = []
    for _ in range(count):
        parts = [make(rng.randint(0, 2 * width))]
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(shared)
            if rng.random() < 0.5:  # a near copy
                at = rng.randrange(len(passage))
                passage = passage[:at] + make(rng.randint(0, 2)) + passage[at + rng.randint(0, 2) :]
            parts += [passage, make(rng.randint(0, width))]
        texts.append("".join(parts))
    return texts + texts[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_repeated_window_is_cut(spark, seed):
    check(spark, list(enumerate(planted(seed, 60, 100))))


def test_small_windows_over_a_small_alphabet(spark):
    check(spark, list(enumerate(planted(3, 80, 20, "ab"))), threshold=24, gram=8, block=4)


def test_batches_and_slices_do_not_matter(spark, monkeypatch):
    """A batch holds a few documents, and long texts are read in slices."""
    monkeypatch.setattr(R, "_BATCH", 300)
    texts = planted(4, 40, 100)
    body = "".join(texts[:12])
    rows = list(enumerate([*texts, body, body[50:], "é" * 400, "ab" * 700]))
    found = []
    for doc, text in rows:
        data = text.encode()
        starts = [
            w for rows_ in R.first_units(R.np.array([doc]), [data], 100, 40) for lo, hi in zip(rows_[3], rows_[4]) for w in range(lo, hi + 1)
        ]
        assert sorted(starts) == list(range(max(len(data) - 99, 0)))  # each window once
        found += starts
    check(spark, rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=120), min_size=1, max_size=6))
def test_equal_windows_share_anchor_and_distance(texts):
    seen = {}
    bodies = [t.encode() for t in texts]
    for digit, _, docs, lo, hi, anchor in R.first_units(R.np.arange(len(bodies)), bodies, 24, 8):
        for d, doc, a, b, at in zip(digit.tolist(), docs.tolist(), lo.tolist(), hi.tolist(), anchor.tolist()):
            for start in range(a, b + 1):
                window = bodies[doc][start : start + 24]
                assert seen.setdefault(window, (d, at - start)) == (d, at - start)


def test_order_is_by_id_and_missing_ids_come_last(spark):
    passage = "x".join(str(i) for i in range(60))
    check(spark, [(None, passage), (7, "tail " + passage), (-3, passage + " head"), (5, None), (6, ""), (8, "short")])


def test_repeated_rows_and_edge_texts(spark, edge_docs, clashing):
    docs = edge_docs.unionByName(edge_docs.where(F.col("text") == LONG))
    found = R.cut_repeats(clashing(docs)).collect()
    assert len(found) == docs.count()
    whole = [r for r in found if r["n_bytes"] == len(LONG.encode())]
    assert len(whole) == 2 and sorted(len(r["kept"]) > 0 for r in whole) == [False, True]  # a repeated row goes
    assert all(bytes(r["kept"]) == b"" and r["spans"] == [] for r in found if r["n_bytes"] == 0)


def test_no_rows(spark, no_docs):
    assert R.cut_repeats(no_docs).collect() == []


def test_query_equals_brute_force(spark, sf_dir, sample_docs):
    rows = sample_docs.orderBy("doc_id").select("doc_id", "text").collect()
    expected = {}
    for (doc_id, text), (spans, kept) in zip(rows, brute([tuple(r) for r in rows], 100)):
        n = len((text or "").encode())
        expected[doc_id] = (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    found = {r[0]: tuple(r[1:]) for r in R.op13_repeat_removal(spark, sf_dir).collect()}
    assert found == expected
    assert any(r[1] for r in found.values())


def test_a_large_class_meets_in_few_rows():
    """However many rows of a batch share a class or digit, at most two of them go to the digit's meeting."""
    n = 5000
    digit = R.np.zeros(n, dtype=R.np.int64)
    classes = R.np.arange(n) % 700
    place = R.np.arange(n)
    routed = R._routed((digit, classes, place, place, place, place))
    flags = routed["place"] & 7
    assert (routed["meet"] == 0).sum() == 2
    assert (flags == 1).sum() == n - 700 and (flags == 2).sum() == 698
    assert routed.loc[flags == 1, "meet"].nunique() == n - 700


def test_units_travel_as_one_number():
    lo, back, run = R.np.array([0, 5, 1 << 31]), R.np.array([0, 60, 1023]), R.np.array([1023, 0, 7])
    found = R.unpacked(R.packed(lo, lo + run, lo + back, R.np.array([7, 0, 1])))
    assert [f.tolist() for f in found] == [lo.tolist(), (lo + run).tolist(), (lo + back).tolist()]
