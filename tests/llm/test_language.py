from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from pulsegrid.llm import language as L
from pulsegrid.llm import mixer as M
from texts import make_docs


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def check(docs, **options):
    rows = docs.select("doc_id", "text").collect()
    counts = Counter()
    for r in rows:
        if not is_held(r["doc_id"]):
            counts.update(tokens_of(r["text"]))
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        tokens = tokens_of(r["text"])
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        expected.append((str(r["doc_id"]), is_held(r["doc_id"]), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    found = L.score_texts(docs, **options).collect()
    names = ["held_out", "n_tokens", "n_known", "train_tokens"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in names), round(r["base_score"], 6)) for r in found) == sorted(expected)
    assert all(r["score"] < 0 and r["bits_per_byte"] > 0 for r in found)
    return found


def test_counts_and_base_equal_brute_force(edge_docs, sample_docs, clashing):
    check(clashing(edge_docs.unionByName(sample_docs)))


def test_a_block_boundary_changes_no_count(edge_docs):
    check(edge_docs.where("length(text) < 100 OR text IS NULL"), block_tokens=7)
    check(edge_docs, block_tokens=5000)


def test_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = L.score_texts(docs).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_scores_prefer_text_of_the_kind_learned(spark):
    rng = np.random.default_rng(0)
    line = "the quick brown fox jumps over the lazy dog and runs away".split()
    texts = [" ".join(line[k:] + line[:k]) for k in rng.integers(0, len(line), 300)]
    held = [i for i in range(1000, 2000) if is_held(i)][:3]
    ids = [i for i in range(1000) if not is_held(i)][:300]
    shuffled = " ".join(rng.permutation(line))
    docs = make_docs(spark, [*texts, " ".join(line), shuffled, "zyx wvu tsr qpo nml kji hgf edc ba zz yy xx"], ids=ids + held)
    score = {r["doc_id"]: r["score"] for r in L.score_texts(docs).collect()}
    assert score[held[0]] > score[held[1]] > score[held[2]]


def test_empty_and_unlearned_tables(spark, no_docs):
    assert L.score_texts(no_docs).count() == 0
    held = next(i for i in range(100) if is_held(i))
    row = L.score_texts(make_docs(spark, ["some words"], ids=[held])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["score"] < 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=2, max_size=40))
def test_code_is_complete_and_no_longer_than_entropy_plus_one(counts):
    code = M.huffman(np.array(counts))
    assert abs(sum(2.0 ** -int(n) for n in code.lengths) - 1) < 1e-9
    total = sum(counts)
    entropy = -sum(c / total * math.log2(c / total) for c in counts)
    assert entropy - 1e-9 <= sum(c * int(n) for c, n in zip(counts, code.lengths)) / total <= entropy + 1
    paths = {
        tuple(zip(code.nodes[s : s + n].tolist(), code.turns[s : s + n].tolist()))
        for s, n in zip(code.starts.tolist(), code.lengths.tolist())
    }
    assert len(paths) == len(counts)


def model_of(symbols, hashes, first, code, nodes):
    return M.Predictors.of(M.count_bits(M.decisions(symbols, hashes, first, code), nodes))


def test_probabilities_of_all_continuations_sum_to_one():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 5, 400)
    hashes = np.array([11, 13, 17, 19, 23], dtype=np.uint64) << np.uint64(33)
    first = np.zeros(400, dtype=bool)
    first[::20] = True
    code = M.huffman(np.bincount(symbols, minlength=5))
    predictors = model_of(symbols, hashes[symbols], first, code, 4)
    start = np.array([1, 3, 0, 2])
    total = 0.0
    for a in range(5):
        for b in range(5):
            run = np.concatenate((start, [a, b]))
            logs = M.token_logs(run, hashes[run], np.arange(6) == 0, code, predictors)
            total += math.exp(logs[4] + logs[5])
    assert abs(total - 1) < 1e-3


def test_streams_do_not_touch_each_other():
    rng = np.random.default_rng(4)
    symbols = rng.integers(0, 6, 900)
    hashes = (np.arange(6, dtype=np.uint64) * np.uint64(977) + np.uint64(3)) << np.uint64(34)
    first = np.zeros(900, dtype=bool)
    first[[0, 10, 400, 401]] = True
    code = M.huffman(np.bincount(symbols, minlength=6))
    predictors = model_of(symbols, hashes[symbols], first, code, 5)
    whole = M.token_logs(symbols, hashes[symbols], first, code, predictors)
    for a, b in ((0, 10), (10, 400), (400, 401), (401, 900)):
        part = M.token_logs(symbols[a:b], hashes[symbols[a:b]], np.arange(b - a) == 0, code, predictors)
        assert np.allclose(part, whole[a:b], atol=1e-4)


def test_spelling_is_a_probability_of_words():
    counts = L.count_letters([b"ab", b"abc", b"b"]).astype(float)
    one = np.exp(L.spell([bytes([c]) for c in range(1, 256)], counts)).sum()
    assert 0 < one < 1
    assert L.spell([b"ab"], counts)[0] > L.spell([b"qz"], counts)[0]
    assert len(L.spell([], counts)) == 0


def plain_mixer(symbols, hashes, code, tables):
    """Natural log of every token's probability, one decision at a time in plain numbers; the text is one stream."""
    pairs = [t.reshape(-1, 2).astype(float) for t in tables]
    weights = [list(M.FIRST_WEIGHTS) for _ in range(M.GATES)]
    middle = (M.BINS - 1) / 2
    table = [1 / (1 + math.exp(-(i - middle) * M._BIN_WIDTH)) for i in range(M.BINS)]
    bits = M.decisions(symbols, hashes, np.arange(len(symbols)) == 0, code)
    clip = lambda p: min(max(p, M._EDGE), 1 - M._EDGE)
    odds = lambda p: math.log(clip(p) / (1 - clip(p)))
    logs = []
    for t in range(len(symbols)):
        total, learned, refined = 0.0, [], []
        for d in range(bits.first[t], bits.first[t + 1]):
            zero, one = pairs[0][bits.node[d]]
            base = (one + 0.5) / (zero + one + 1)
            x = [odds(base)]
            for k, slots in enumerate(bits.slots):
                zero, one = pairs[k + 1][slots[d]]
                x.append(odds((one + M.BACKOFF[k] * base) / (zero + one + M.BACKOFF[k])))
            own = weights[bits.gate[d]]
            z = min(max(sum(a * b for a, b in zip(own, x)), -9), 9)
            p, y = 1 / (1 + math.exp(-z)), int(bits.bit[d])
            cell = int(z / M._BIN_WIDTH + middle + 0.5)
            final = clip(0.75 * p + 0.25 * table[cell])
            total += math.log(final if y else 1 - final)
            learned.append((bits.gate[d], [M.RATE * (y - p) * v for v in x]))
            refined.append((cell, M.REFINE_RATE * (y - table[cell])))
        for gate, change in learned:  # all decisions of the token were predicted before any is learned from
            weights[gate] = [a + b for a, b in zip(weights[gate], change)]
        before = list(table)
        for cell, change in refined:  # the last decision at an output counts
            table[cell] = before[cell] + change
        logs.append(total)
    return np.array(logs)


def test_mixer_equals_one_decision_at_a_time():
    rng = np.random.default_rng(7)
    symbols = rng.zipf(1.6, 3000) % 40
    hashes = (np.arange(40, dtype=np.uint64) * np.uint64(977) + np.uint64(3)) << np.uint64(34)
    first = np.zeros(3000, dtype=bool)
    first[[0, 10, 11, 600, 1400]] = True
    code = M.huffman(np.bincount(symbols, minlength=40))
    tables = M.count_bits(M.decisions(symbols, hashes[symbols], first, code), 39)
    found = M.token_logs(symbols, hashes[symbols], first, code, M.Predictors.of(tables))
    edges = [*np.flatnonzero(first), 3000]
    expected = np.concatenate([plain_mixer(symbols[a:b], hashes[symbols[a:b]], code, tables) for a, b in zip(edges, edges[1:])])
    assert np.abs(found - expected).max() < 2e-3 and abs(found.sum() - expected.sum()) < 1e-3 * abs(expected.sum())


def test_scores_do_not_depend_on_the_layout(spark, sample_docs):
    """Other numbers of files, partitions and tokens in a block give the same scores."""
    take = lambda df, **o: {r["doc_id"]: (r["base_score"], r["score"]) for r in L.score_texts(df, **o).collect()}
    whole = take(sample_docs.repartition(1))
    for other in (take(sample_docs.repartition(4)), take(sample_docs.repartition(16), block_tokens=900)):
        assert other.keys() == whole.keys()
        for key, (base, score) in whole.items():
            assert math.isclose(other[key][0], base, rel_tol=1e-12) and math.isclose(other[key][1], score, rel_tol=1e-6)


def test_numbers_of_many_words_are_packed():
    for most in (70, 65_535, 65_536, 300_000, 1 << 24):
        ids = np.array([0, 1, 69, most // 2, most - 1], dtype=np.uint32)
        row = type("Row", (), {"ids": L._pack(ids, most)})
        assert L._ids(row, len(ids)).tolist() == ids.tolist()


def test_texts_of_like_length_share_blocks(spark):
    docs = make_docs(spark, ["w " * n for n in [5, 3000, 7, 2500, 6, 2800] * 20])
    frame = docs.selectExpr("CAST(doc_id AS string) AS key", "false AS held", "text").orderBy("text")
    blocks = frame.coalesce(1).mapInPandas(L._cut_blocks(20_000), L._BLOCK).collect()
    assert all(sum(b["counts"]) < 24_000 for b in blocks) and sum(len(b["keys"]) for b in blocks) == 120


def test_words_beyond_the_first_two_thousand_are_coded_by_context(spark):
    # 2,200 common words, and 800 rarer ones that always follow each other: only a context tells which comes.
    common = [" ".join(f"c{k}" for k in range(j, j + 40)) for j in range(0, 2200, 40)] * 12
    rarer = [" ".join(f"a{k} b{k}" for k in range(j, j + 20)) for j in range(0, 400, 20)] * 6
    texts = common + rarer
    ids = [i for i in range(3000) if not is_held(i)][: len(texts)]
    held = next(i for i in range(5000, 6000) if is_held(i))
    docs = make_docs(spark, [*texts, rarer[7]], ids=[*ids, held])
    row = next(r for r in L.score_texts(docs).collect() if r["doc_id"] == held)
    assert row["score"] > row["base_score"] * 0.6
