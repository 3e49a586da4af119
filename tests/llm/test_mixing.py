from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing as M
from texts import make_docs

WORD = "[^ \t\n\x0b\x0c\r]+"


def targets_of(sizes, weights=M.WEIGHTS, share=M.SHARE, most=M.MOST):
    """Plain resharing: give by weight, cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = budget - sum(fixed.values())
        offer = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if offer[s] > most * sizes[s]]
        if not over:
            return fixed | offer
        fixed |= {s: float(most * sizes[s]) for s in over}


def highest_quotients(targets, order, seats):
    held = dict.fromkeys(order, 0)
    for _ in range(seats):
        best = max(order, key=lambda s: (targets[s] / (2 * held[s] + 1), -order.index(s)))
        held[best] += 1
    return held


def check(docs, **settings):
    texts = Counter((r["doc_id"], r["source"], len(re.findall(WORD, r["text"] or ""))) for r in docs.collect())
    sizes = defaultdict(int)
    for (_, source, size), n in texts.items():
        sizes[source] += size * n
    expected = targets_of(dict(sizes))
    rows = M.mix(docs, **settings).collect()
    assert len(rows) == sum(texts.values())
    by_target = defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[(r["source_size"], round(r["target"], 6))] += r["taken"]
    wanted = defaultdict(float)
    for source, target in expected.items():
        wanted[(sizes[source], round(target, 6))] += target
    assert set(by_target) == set(wanted)
    for k, target in wanted.items():
        assert abs(by_target[k] - target) <= 1 * sum(sizes[s] == k[0] for s in sizes)
    return rows


def test_each_source_meets_its_target(edge_docs, sample_docs, clashing):
    for docs in (sample_docs, clashing(edge_docs.unionByName(sample_docs)), edge_docs):
        check(docs)
    check(sample_docs, block_words=7)


def test_reruns_agree(sample_docs):
    once = sorted(map(tuple, M.mix(sample_docs.repartition(3)).collect()))
    assert once == sorted(map(tuple, M.mix(sample_docs.repartition(11, "source")).collect()))


@pytest.mark.parametrize("block_words", [3, 50, 1000])
def test_quotas_equal_dealing_seat_by_seat(spark, block_words):
    sizes = {f"s{i:02d}": (i * 37) % 90 + 1 for i in range(23)}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    rows = M.quotas(M.source_targets(df), block_words, 4).orderBy("source").collect()
    targets = {r["source"]: r["target"] for r in rows}
    order = sorted(targets)
    total = round(sum(targets.values()) / block_words)
    for j in range(4):
        held = highest_quotients(targets, order, total * (j + 1) // 4)
        assert {r["source"]: r["quota"][j] for r in rows} == held


def test_mixed_texts_hold_the_words_taken(spark, sample_docs, edge_docs):
    docs = sample_docs.unionByName(edge_docs.where("doc_id IS NOT NULL")).withColumn(
        "doc_id", F.monotonically_increasing_id()
    )
    docs = spark.createDataFrame(docs.collect(), docs.schema).withColumn("extra", F.lit(5)).withColumn("_row", F.lit(1))
    for block_words in (40, 1024):
        taken = {r["doc_id"]: r["taken"] for r in M.mix(docs, block_words=block_words).collect()}
        mixed = M.mix_texts(docs, block_words=block_words)
        assert mixed.columns == docs.columns
        words = defaultdict(int)
        original = {r["doc_id"]: r for r in docs.collect()}
        for r in mixed.collect():
            words[r["doc_id"]] += len(re.findall(WORD, r["text"]))
            assert r["text"] in original[r["doc_id"]]["text"]  # an exact part of the document
            assert r["text"] == original[r["doc_id"]]["text"] or r["n_chars"] == len(r["text"])
        assert {k: v for k, v in taken.items() if v} == dict(words)


def test_empty_and_wordless_tables(spark, no_docs):
    assert M.mix(no_docs).count() == 0 and M.mix_texts(no_docs).count() == 0
    rows = M.mix(make_docs(spark, [None, "", "  "])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 3


def test_each_shard_holds_the_blocks_it_was_dealt(spark):
    texts = [" ".join(["w"] * 10)] * 400
    docs = make_docs(spark, texts, sources=["a", "a", "a", "b", "c", "c", "c"])
    block, shards = 30, 4
    rows = M.mix(docs, block_words=block, shards=shards).collect()
    words = {}
    for r in rows:
        assert sum(r["by_shard"]) == r["taken"]
        held = words.setdefault((r["source_size"], round(r["target"], 6)), [0] * shards)
        for j, n in enumerate(r["by_shard"]):
            held[j] += n
    sizes = docs.select("source", F.lit(10).cast("long").alias("size"))
    dealt = M.quotas(M.source_targets(sizes), block, shards).collect()
    assert len(dealt) == 3
    for r in dealt:
        held = words[(r["source_size"], round(r["target"], 6))]
        seats = [b - a for a, b in zip([0, *r["quota"]], r["quota"])]
        # Whole blocks everywhere but in the last shard, and the source's last block, which can be short.
        short = (-r["source_size"]) % block
        assert all(seats[j] * block - held[j] in (0, short) for j in range(shards - 1))
        assert abs(held[-1] - seats[-1] * block) <= block + short
        assert abs(sum(held) - r["target"]) <= 1


def test_quotas_decide_what_is_taken(spark, monkeypatch):
    docs = make_docs(spark, ["w " * 10] * 300, sources=["a", "b", "c"])
    before = sorted(map(tuple, M.mix(docs, block_words=30).select("doc_id", "taken").collect()))
    quotas = M.quotas
    halved = lambda *a: quotas(*a).withColumn("quota", F.transform("quota", lambda q: F.floor(q / 2)))
    monkeypatch.setattr(M, "quotas", halved)
    assert before != sorted(map(tuple, M.mix(docs, block_words=30).select("doc_id", "taken").collect()))
