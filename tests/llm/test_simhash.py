from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import simhash as S
from texts import make_docs


def brute_print(text, size=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^ \t\n\x0b\x0c\r]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, distance=4):
    """Smallest id by group, from (id, fingerprint) rows."""
    distinct = sorted(set(p for _, p in prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for key, p in prints:
        least[root(p)].append(key)
    return {p: min((k for k in least[root(p)] if k is not None), default=None) for p in distinct}


def near_copies():
    base = [f"word{i * 7 % 91}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(30):
        copy = list(base)
        copy[k * 9 % 300] = f"changed{k}"
        texts.append(" ".join(copy))
    return texts + texts[:5] + ["", None, "   "]


def test_groups_equal_brute_force(spark, edge_docs, sample_docs, clashing):
    docs = clashing(edge_docs.unionByName(sample_docs).unionByName(make_docs(spark, near_copies(), ids=list(range(1000, 1039)))))
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    least = brute_groups(prints)
    expected = sorted(((k, f"{p:016x}", least[p]) for k, p in prints), key=str)
    found = S.groups(docs)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=str) == expected
    assert max(Counter(least[p] for _, p in prints).values()) > 20


def test_small_tiles_find_the_same_links(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = set()
    for s in seeds:
        for _ in range(25):
            p = int(s)
            for b in rng.integers(0, 64, 3):
                p ^= 1 << int(b)
            prints.add(p)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    df = spark.createDataFrame(signed, "print long")
    expected = brute_groups([(p, p) for p in prints])
    for tile in (7, 1000):
        roots = {r["node"]: r["root"] for r in S.connect(S.tile_links(df, 4, tile)).collect()}
        groups = defaultdict(set)
        for (p,) in signed:
            groups[roots.get(p, p)].add(p % 2**64)
        wanted = defaultdict(set)
        for p, least in expected.items():
            wanted[least].add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=60))))
def test_spanning_forest_keeps_what_is_connected(case):
    n, links = case
    left, right = (np.array([x[k] for x in links], dtype=np.int64) for k in (0, 1))
    nodes, roots = S.spanning_forest(n, left, right)
    assert len(nodes) < n

    def parts(pairs):
        label = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert parts(list(zip(nodes.tolist(), roots.tolist()))) == parts(links)


def test_long_chain_is_one_group(spark):
    links = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    rows = S.connect(links).collect()
    assert {r["node"] for r in rows} == set(range(1, 201)) and {r["root"] for r in rows} == {0}


def test_one_document_of_each_group_stays(spark, edge_docs, sample_docs, clashing, no_docs):
    docs = clashing(edge_docs.unionByName(sample_docs.withColumn("doc_id", F.col("doc_id") + 5000)).unionByName(make_docs(spark, near_copies(), ids=list(range(1000, 1039)))))
    kept = S.drop_near_copies(docs)
    assert kept.dtypes == docs.dtypes
    prints = [(r["doc_id"], brute_print(r["text"])) for r in docs.collect()]
    least = brute_groups(prints)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({least[p] for p in least}, key=str)
    assert S.drop_near_copies(no_docs).count() == 0 and S.groups(no_docs).count() == 0


def test_a_large_component_is_dealt_to_many_places(spark):
    """Neighbours of one node meet its minimum in several places, and the result is that of a plain join."""
    rows = spark.range(3000).selectExpr("0L AS u", "id AS v").unionByName(spark.range(5).selectExpr("id + 1 AS u", "id AS v"))
    values = spark.range(4).selectExpr("id AS u", "id * 10 AS m")
    found = S._join_value(rows, values, "u")
    assert sorted(map(tuple, found.select("u", "v", "m").collect())) == sorted(map(tuple, rows.join(values, "u").select("u", "v", "m").collect()))
    assert "pmod" in found._jdf.queryExecution().optimizedPlan().toString()
