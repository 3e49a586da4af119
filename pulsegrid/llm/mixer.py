"""Bit model of tokens: a Huffman code, hashed-context predictors and an online mixer. Plain numpy, a block at a time."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

CONTEXTS = 3  # hashed contexts beside the code's node itself: one word back, two words back, last frequent word
SLOT_BITS = 19
FREQUENT = 256  # words that can be the last frequent one
RATE, REFINE_RATE = 0.05, 0.02
GATES = 4
CHUNK = 1 << 16  # tokens whose decisions are worked out at a time for scoring
COUNTED = 1 << 18  # and for counting, where each time costs a pass over the tables
STREAMS = 1 << 14  # texts that are handled side by side, at most
BINS = 25
BACKOFF = (2.0, 2.0, 2.0)  # prior weight of the node's own rate in each context
FIRST_WEIGHTS = (0.2, 0.35, 0.3, 0.4)  # of the node alone, then of the contexts
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_EDGE = 1e-4
_BIN_WIDTH = 0.75


@dataclass(frozen=True)
class Code:
    """Paths through a Huffman tree, one symbol's after the other: nodes passed, turns taken, gates of the mixer."""

    nodes: np.ndarray
    turns: np.ndarray
    gates: np.ndarray
    starts: np.ndarray  # of each symbol's path
    lengths: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """Code of symbols with these counts; equal counts are taken in symbol order."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    turn = np.zeros(2 * n - 1, dtype=np.int8)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], turn[j] = node, node, 1
        heapq.heappush(heap, (a + b, node))
    paths = []
    for symbol in range(n):
        path, at = [], symbol
        while at != 2 * n - 2:
            path.append((parent[at] - n, turn[at]))
            at = parent[at]
        paths.append(path[::-1])
    lengths = np.array(list(map(len, paths)), dtype=np.int64)
    steps = np.array([step for path in paths for step in path], dtype=np.int64).reshape(-1, 2)
    starts = np.cumsum(lengths) - lengths
    depth = np.arange(len(steps)) - np.repeat(starts, lengths)
    gates = np.searchsorted([1, 3, 6], depth, side="right").astype(np.int32)
    return Code(steps[:, 0].astype(np.int32), steps[:, 1].astype(np.int8), gates, starts, lengths)


@dataclass
class Bits:
    """The binary decisions of a run of tokens, in order."""

    first: np.ndarray  # first decision of each token, and the number of all
    node: np.ndarray
    gate: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]  # of each hashed context


def contexts(symbols: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's contexts: the word before, the two before, the last frequent word, all of its text."""
    word = (hashes >> np.uint64(32)).astype(np.uint32)
    one = np.concatenate((np.zeros(1, np.uint32), word[:-1]))
    one[first] = 1
    two = np.concatenate((np.zeros(1, np.uint32), one[:-1]))
    two[first] = 2
    place = np.arange(len(symbols))
    begin = np.maximum.accumulate(np.where(first, place, 0))
    last = np.maximum.accumulate(np.concatenate(([-1], np.where(symbols < FREQUENT, place, -1)[:-1])))
    frequent = np.where(last >= begin, symbols[np.maximum(last, 0)] + 1, 0).astype(np.uint32)
    seen = (one, one * np.uint32(31) + two, frequent)
    return [(c + np.uint32(k)) * _MULTIPLIERS[k] for k, c in enumerate(seen)]


def expand(symbols: np.ndarray, seen: list[np.ndarray], code: Code) -> Bits:
    """Decisions of tokens given by symbol and contexts."""
    lengths = code.lengths[symbols]
    ends = np.cumsum(lengths)
    step = np.repeat(code.starts[symbols] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
    node = code.nodes[step]
    turn = (node.astype(np.uint32) + np.uint32(1)) * _MULTIPLIERS[0]
    slots = []
    for context in seen:
        mixed = np.repeat(context, lengths)
        mixed ^= turn
        mixed ^= mixed >> np.uint32(15)
        mixed *= _MULTIPLIERS[2]
        mixed >>= np.uint32(32 - SLOT_BITS)
        slots.append(mixed.astype(np.int64))
    return Bits(np.concatenate(([0], ends)), node, code.gates[step], code.turns[step], slots)


def decisions(symbols: np.ndarray, hashes: np.ndarray, first: np.ndarray, code: Code) -> Bits:
    """Decisions of tokens given by symbol and word hash; ``first`` marks the first token of a text."""
    return expand(symbols, contexts(symbols, hashes, first), code)


def count_tokens(symbols: np.ndarray, hashes: np.ndarray, first: np.ndarray, code: Code, nodes: int) -> list[np.ndarray]:
    """``count_bits`` of any number of tokens, some at a time."""
    seen = contexts(symbols, hashes, first)
    total: list[np.ndarray] = []
    for at in range(0, len(symbols), COUNTED):
        part = slice(at, at + COUNTED)
        found = count_bits(expand(symbols[part], [c[part] for c in seen], code), nodes)
        total = [np.add(a, b, out=a) for a, b in zip(total, found)] if total else found
    return total


def count_bits(bits: Bits, nodes: int) -> list[np.ndarray]:
    """Counts of zeros and ones per node and per slot of each context, as flat arrays of pairs."""
    tables = [np.bincount(2 * bits.node.astype(np.int64) + bits.bit, minlength=2 * nodes)]
    return tables + [np.bincount(2 * s + bits.bit, minlength=2 << SLOT_BITS) for s in bits.slots]


@dataclass
class Predictors:
    """The counted tables, ready to be looked up: ones and all of each slot."""

    node: np.ndarray  # rate of ones of each node
    slots: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, tables: list[np.ndarray]) -> Predictors:
        pairs = [t.reshape(-1, 2).astype(np.float32) for t in tables]
        rate = (pairs[0][:, 1] + 0.5) / (pairs[0].sum(axis=1) + 1.0)
        return cls(rate, [(p[:, 1].copy(), p.sum(axis=1) + np.float32(w)) for p, w in zip(pairs[1:], BACKOFF)])

    def said(self, bits: Bits) -> np.ndarray:
        """What each predictor says, as log odds: the node's own rate, then each context backed off to it."""
        base = self.node.take(bits.node)
        said = np.empty((len(base), 1 + CONTEXTS), dtype=np.float32)

        def odds(rate: np.ndarray, column: int) -> None:
            rate = np.clip(rate, _EDGE, 1 - _EDGE)
            said[:, column] = np.log(rate / (1 - rate))

        odds(base, 0)
        for k, ((ones, all_), slot) in enumerate(zip(self.slots, bits.slots)):
            odds((ones.take(slot) + np.float32(BACKOFF[k]) * base) / all_.take(slot), k + 1)
        return said


class Mixer:
    """Gated weights and refinement tables of streams that are handled side by side, a token of each at a time.

    A stream has a set of weights for each gate (how deep in the code a decision is). It predicts all decisions of a token
    and then learns from all of them at once. Its output is refined by a table of the outcomes seen at that output,
    which learns from the last of a token's decisions at that output.
    """

    def __init__(self, streams: int, weights=FIRST_WEIGHTS):
        self.weights = np.tile(np.asarray(weights, dtype=np.float32), (streams * GATES, 1))
        cells = (np.arange(BINS, dtype=np.float32) - np.float32((BINS - 1) / 2)) * np.float32(_BIN_WIDTH)
        self.table = np.tile(1 / (1 + np.exp(-cells)), streams)

    def run(self, said: np.ndarray, bits: Bits, stream: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """Natural log of the probability of every decision of tokens that come step by step, streams in order.

        ``stream`` is the stream of each token, ``steps`` how many tokens each step has.
        """
        own_stream = np.repeat(stream, np.diff(bits.first))
        sets = own_stream * GATES + bits.gate
        token_ends = np.cumsum(steps)
        ends = bits.first[token_ends]
        starts = np.append(0, ends[:-1])
        # Decisions of a token that share a set of weights lie next to each other; their sums go to the set together.
        new = np.empty(len(said), dtype=bool)
        new[1:] = sets[1:] != sets[:-1]
        new[starts] = True
        runs = np.flatnonzero(new)
        run_ends = np.searchsorted(runs, ends)
        run_starts = np.append(0, run_ends[:-1])
        run_sets = sets[runs]
        runs = runs - np.repeat(starts, run_ends - run_starts)
        first_cell = own_stream * BINS
        y = bits.bit.astype(np.float32)
        mixed, refined = np.empty(len(y), dtype=np.float32), np.empty(len(y), dtype=np.float32)
        rate, slow, width = np.float32(RATE), np.float32(REFINE_RATE), np.float32(1 / _BIN_WIDTH)
        middle = np.float32((BINS - 1) / 2 + 0.5)
        w, table = self.weights, self.table
        bounds = (starts.tolist(), ends.tolist(), run_starts.tolist(), run_ends.tolist())
        for begin, end, run, run_end in zip(*bounds):
            now, here = said[begin:end], y[begin:end]
            z = np.einsum("ij,ij->i", w.take(sets[begin:end], axis=0), now)
            np.clip(z, -9, 9, out=z)
            p = mixed[begin:end]
            np.negative(z, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            pull = ((here - p) * rate)[:, None] * now
            w[run_sets[run:run_end]] += np.add.reduceat(pull, runs[run:run_end], axis=0)
            z *= width
            z += middle  # within 0 and BINS, as z is bounded
            cell = z.astype(np.int64)
            cell += first_cell[begin:end]
            seen = table.take(cell)
            refined[begin:end] = seen
            table[cell] = seen + slow * (here - seen)  # of a token's decisions at one output the last counts
        p = np.clip(0.75 * mixed + 0.25 * refined, _EDGE, 1 - _EDGE)
        return np.log(np.where(y > 0, p, 1 - p))


def token_logs(symbols: np.ndarray, hashes: np.ndarray, first: np.ndarray, code: Code, predictors: Predictors) -> np.ndarray:
    """Natural log of the probability of every token's symbol; each text is a stream.

    Streams go side by side, the longest first; their decisions are worked out some steps at a time, so what is held at
    once is bounded by ``CHUNK`` tokens and the tokens themselves.
    """
    seen = contexts(symbols, hashes, first)
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(symbols)))
    order = np.argsort(-lengths, kind="stable")
    logs = np.empty(len(symbols))
    for at in range(0, len(order), STREAMS):
        own_starts, own_lengths = starts[order[at : at + STREAMS]], lengths[order[at : at + STREAMS]]
        mixer = Mixer(len(own_starts))
        # Tokens step by step: those of all streams that have a first one, then a second one, and so on.
        active = np.searchsorted(-own_lengths, -np.arange(own_lengths[0]), side="left")
        ends = np.cumsum(active)
        step = 0
        while step < len(active):
            done = int(ends[step - 1]) if step else 0
            until = max(step + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            steps = active[step:until]
            stream = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps)
            token = own_starts[stream] + np.repeat(np.arange(step, until), steps)
            bits = expand(symbols[token], [c[token] for c in seen], code)
            found = mixer.run(predictors.said(bits), bits, stream, steps).astype(np.float64)
            logs[token] = np.add.reduceat(found, bits.first[:-1])
            step = until
    return logs
