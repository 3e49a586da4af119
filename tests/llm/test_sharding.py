from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pulsegrid.llm.sharding import add_shards, jump, place, write_shards


def walk(key: int, shards: int) -> int:
    here, ahead = -1, 0
    while ahead < shards:
        here = ahead
        key = (key * 2862933555777941757 + 1) % 2**64
        ahead = int((here + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return here


def key_of(doc_id) -> int:
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.integers(1, 300))
def test_jump_equals_the_plain_walk_and_moves_only_into_the_new_shard(keys, shards):
    now = jump(np.array(keys, dtype=np.uint64), shards)
    grown = jump(np.array(keys, dtype=np.uint64), shards + 1)
    assert now.tolist() == [walk(k, shards) for k in keys]
    assert all(a == b or b == shards for a, b in zip(now, grown))


def test_shares_are_even():
    counts = Counter(jump(np.random.default_rng(1).integers(0, 2**63, 100_000).astype(np.uint64), 40).tolist())
    assert len(counts) == 40 and max(counts.values()) < 1.1 * 100_000 / 40


def test_places_equal_brute_force(edge_docs, sample_docs, clashing):
    docs = clashing(edge_docs.unionByName(sample_docs))
    rows = place(docs, shards=40).collect()
    sizes = Counter()
    for r in docs.collect():
        body = (r["text"] or "").encode()
        sizes[(r["doc_id"], len(body) + 16, zlib.crc32(body), walk(key_of(r["doc_id"]), 40), walk(key_of(r["doc_id"]), 41))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == sizes
    for shard in range(40):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_empty_table_and_written_shards(no_docs, sample_docs, spark, tmp_path):
    assert place(no_docs).count() == 0
    write_shards(sample_docs, str(tmp_path / "shards"), ["doc_id"], 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == sample_docs.count()
    assert {(r["doc_id"], r["shard"]) for r in back.select("doc_id", "shard").collect()} == {
        (r["doc_id"], r["shard"]) for r in add_shards(sample_docs, ["doc_id"], 4).select("doc_id", "shard").collect()
    }
    with pytest.raises(ValueError):
        add_shards(sample_docs, ["doc_id"], 0)
