from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from pulsegrid.llm import cutting as C
from pulsegrid.llm import packing as P
from pulsegrid.llm.tokens import ChunkEncoder
from texts import make_docs


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def chunked():
    return ChunkEncoder(*P.public_ranks())


PIECES = ["a", " ", "  ", "\n", "\t", "the", " the", "'s", "don't", "é", "漢字", "12", "!!", "\x1c", " ", " ", "​", "<|endoftext|>", "x" * 90, "🙂", "\r\n", "İ", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.text(max_size=5), max_size=25).map("".join), max_size=4))
def test_ids_are_those_of_the_tokenizer(tokenizer, chunked, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in chunked.encode(texts)] == expected


END = "<|endoftext|>"


@pytest.mark.parametrize("text", [END, END * 2, f"hello {END} world", f"{END}start", f"end {END}", f"a{END}  b\n{END}\n c", "<|endoftext|", f" {END} {END}  "])
def test_the_added_token_has_its_id(tokenizer, chunked, text):
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(next(chunked.encode([text])), "<u4").tolist() == expected
    assert (50256 in expected) == (END in text)


def test_texts_with_the_added_token_are_packed_by_their_ids(spark, tokenizer):
    check(make_docs(spark, [f"some words {END} more {i} {END}{END}" for i in range(40)] + [END * 1500, None]), tokenizer)


def check(docs, tokenizer):
    rows = P.pack(docs).collect()
    whole = Counter()
    for r in docs.collect():
        whole[(r["doc_id"], tuple([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]))] += 1
    digests = P.digest_pieces(P.pack(docs)).collect()
    assert all(0 <= r["ids_crc32"] < 2**32 for r in digests) and len(digests) == len(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_doc[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc_id, n), pieces in by_doc.items():
        copies = Counter({ids: k for (i, ids), k in whole.items() if i == doc_id and len(ids) == n})
        assert sum(len(ids) for _, ids in pieces) == n * sum(copies.values())
        for start, ids in pieces:
            assert any(list(c[start : start + len(ids)]) == ids for c in copies)
    assert sum(len(ids) * k for (_, ids), k in whole.items()) == sum(r["length"] for r in rows)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding / max(1, sum(r["length"] for r in rows)), rows


def test_every_id_lies_in_one_piece(spark, edge_docs, sample_docs, clashing, tokenizer):
    padding, rows = check(sample_docs, tokenizer)
    assert padding < 0.02
    items = [r for r in rows if r["length"] < 1024]
    cut = [r for r in items if r["length"] != r["doc_tokens"] % 1024]
    assert len(cut) < 0.1 * len(items)
    check(clashing(edge_docs), tokenizer)
    check(make_docs(spark, ["same text of a few words"] * 700, ids=[7] * 700), tokenizer)


def test_empty_table(no_docs):
    assert P.pack(no_docs).count() == 0
    assert P.digest_pieces(P.pack(no_docs)).columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ]


def test_pieces_carry_their_digest(spark):
    row = P.digest_pieces(P.pack(make_docs(spark, [None]))).first()
    assert tuple(row) == (0, 0, 1, zlib.crc32(b"\0\0\0\0"), 1, 0, 0)


def test_known_program():
    # Three of each: 6 + 4 and 5 + 5 fill the bins exactly.
    solution = C.solve({6: 4, 4: 4, 5: 6}, 10)
    assert abs(sum(n for _, n in solution) - 7) < 1e-6
    patterns = C.round_patterns(solution, {6: 4, 4: 4, 5: 6}, 10)
    assert sum(p.copies for p in patterns) == 7


def test_an_early_end_is_reported():
    with pytest.warns(UserWarning, match="before the optimum"):
        C.solve({3: 50, 5: 40, 7: 30, 11: 20}, 32, rounds=1)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=20))
def test_program_covers_the_demand_and_reaches_the_bound(demand):
    solution = C.solve(demand, 32)
    made = Counter()
    for items, n in solution:
        assert sum(l * k for l, k in items.items()) <= 32
        for length, k in items.items():
            made[length] += k * n
    assert all(abs(made[l] - n) < 1e-4 * max(1, n) for l, n in demand.items())
    total = sum(n for _, n in solution)
    assert total >= sum(l * n for l, n in demand.items()) / 32 - 1e-6
    whole = C.round_patterns(solution, demand, 32)
    used = Counter()
    for p in whole:
        for length, k in p.items:
            used[length] += k * p.copies
    assert all(used[l] <= n for l, n in demand.items())
    slots, sequences = C.slots_of(whole)
    assert sequences == sum(p.copies for p in whole)
    ranks = Counter()
    for s in slots:
        assert s.first == ranks[s.length] and (s.last - s.first + 1) % s.each == 0
        ranks[s.length] = s.last + 1
    assert ranks == +used


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=40))
def test_cut_line_needs_no_padding(sizes):
    pieces = C.cut_line(sizes, 64)
    for item, size in enumerate(sizes):
        own = [(start, n) for i, start, n, _, _ in pieces if i == item]
        assert sum(n for _, n in own) == size and [s for s, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])
    filled = defaultdict(int)
    for _, _, n, sequence, offset in pieces:
        assert offset == filled[sequence]
        filled[sequence] += n
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values())
