"""Periodic runs of words inside a text, found by a suffix automaton whose last occurrences are kept by link-cut access.

A run is a stretch of consecutive words in which words ``period`` apart agree, as long as it can be, with the period
the smallest there is. Of a text's words the suffix automaton is built; its suffix links form a tree in which the path
from a prefix to the root holds all that ends there. Words are then taken one after the other: the access of a prefix
makes its path preferred and colours it with the place where it ends. Before that, the path falls into segments of one
colour each, the place where their texts ended last. Where the distance of the two ends is no more than the length of
the segment's longest text, that text and its last occurrence touch or overlap: a square, and the distance is its
smallest period. It is extended to both sides to a run; squares inside a run that is known already are passed over.
Every run holds a square that is met this way, since at its second period's end the last occurrence of one period is
one period back. Accesses change O(log n) segments on average, whatever the text.

What is sent to the automaton. A run of at least ``least`` words and three periods lies in a stretch where every
window of a third of ``least`` words occurs twice; windows are compared by hash first, and only such stretches, cut
some times more to where windows recur within the stretch itself, are searched. Equal hashes only make a stretch longer, so nothing is
lost. Ordinary texts have no such stretch and cost one pass over their words.

Defined results: a null text is empty; a text without words has no runs; repeated rows are searched each on its own; an
empty table gives an empty table. Ties go to the smaller start, then period. Texts are read whole; a long repeating
stretch costs some 400 bytes of memory a word. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from pulsegrid.llm.common import llm_query, table, words_of

LEAST = 24  # words
EXPONENT = 3  # periods
_PASSES = 8  # times that a stretch is cut; a stretch that could be cut further is only longer than need be
_PRIME = np.uint64(0x9E3779B97F4A7C15)
RUNS = ArrayType(StructType([StructField(name, LongType()) for name in ("start", "length", "period")]))


class SuffixAutomaton:
    """States of all substrings of a sequence of numbers: ``length``, suffix ``link`` and the state of each prefix.

    Most states have a single way on, kept in two lists; further ways are in a dictionary.
    """

    def __init__(self, words: list[int]):
        self.length, self.link = [0, 0], [0, 0]  # state 1 is the root, 0 is none
        self.word, self.to, self.more = [-1, -1], [0, 0], {}
        self.prefixes: list[int] = []
        last = 1
        for word in words:
            last = self._append(last, word)
            self.prefixes.append(last)

    def step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (word, -1):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1)
        self.to.append(0)
        return len(self.length) - 1

    def _append(self, last: int, word: int) -> int:
        new = self._new(self.length[last] + 1, 1)
        at = last
        while at and not self.step(at, word):
            self._set(at, word, new)
            at = self.link[at]
        if not at:
            return new
        found = self.step(at, word)
        if self.length[found] == self.length[at] + 1:
            self.link[new] = found
            return new
        copy = self._new(self.length[at] + 1, self.link[found])
        self.word[copy], self.to[copy] = self.word[found], self.to[found]
        if found in self.more:
            self.more[copy] = dict(self.more[found])
        self.link[found] = self.link[new] = copy
        while at and self.step(at, word) == found:
            self._set(at, word, copy)
            at = self.link[at]
        return new


class PathColours:
    """A link-cut forest over a fixed tree, whose preferred paths carry one colour each.

    Each path is a splay tree by depth. Its colour and the tree node above its top are kept at the splay tree's root.
    Node 0 is none; the parent of the tree's root is 0.
    """

    def __init__(self, parents: list[int]):
        self.up = list(parents)  # parent in the splay tree, or the node above the path
        self.left, self.right = [0] * len(parents), [0] * len(parents)
        self.colour = [0] * len(parents)

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)

    def _rotate(self, x: int) -> None:
        """Lifts ``x`` over its parent and takes over its colour, which counts once ``x`` is the splay tree's root."""
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            inner = right[x]
            left[y], right[x] = inner, y
        else:
            inner = left[x]
            right[y], left[x] = inner, y
        if inner:
            up[inner] = y
        up[y], up[x] = x, z
        self.colour[x] = self.colour[y]

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int]]:
        """Colours the path from the root to ``node``; gives (deepest node, former colour) of its segments."""
        below, at = 0, node
        while at:
            self._splay(at)
            yield at, self.colour[at]
            lower = self.right[at]
            if lower:
                self.colour[lower] = self.colour[at]  # cut off: a path of its own below ``at``
            self.right[at] = below
            if below:
                self.up[below] = at
            below, at = at, self.up[at]
        self.colour[below] = colour


def _reach(words: np.ndarray, at: int, period: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step``, agree with the word ``period`` before them."""
    found, size = 0, 16
    while True:
        if step > 0:
            part, other = words[at + found : at + found + size], words[at + found - period : at + found - period + size]
            part, other = part[: len(other)], other[: len(part)]
        else:
            high = at - found + 1
            low = max(high - size, period)
            part, other = words[low:high][::-1], words[low - period : max(high - period, 0)][::-1]
        if not len(part):
            return found
        apart = np.flatnonzero(part != other)
        if len(apart):
            return found + int(apart[0])
        found += len(part)
        size *= 2


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of two periods or more in a sequence of numbers."""
    automaton = SuffixAutomaton(words.tolist())
    paths = PathColours(automaton.link)
    length = automaton.length
    known: dict[int, int] = {}  # period: end of the last run with it
    found = []
    for end, node in enumerate(automaton.prefixes, 1):
        for deepest, before in paths.access(node, end):
            period = end - before
            if before and period <= length[deepest] and known.get(period, 0) < end:
                stop = end + _reach(words, end, period, 1)
                start = end - _reach(words, end - 1, period, -1) - period
                known[period] = stop
                found.append((start, stop - start, period))
    return found


def _repeated(words: np.ndarray, size: int) -> np.ndarray:
    """Whether the window of ``size`` words at each place occurs twice or more, or seems to."""
    n = len(words) - size + 1
    keys = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        keys = (keys ^ words[i : n + i].view(np.uint64)) * _PRIME
        keys ^= keys >> np.uint64(29)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice


def stretches(words: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """(start, end) of stretches that hold every run of ``least`` words and ``exponent`` >= 3 periods."""
    size = max(least // 3, 1)
    todo, done = [(0, len(words), 0)], []
    while todo:
        start, end, passes = todo.pop()
        if end - start < least:
            continue
        twice = _repeated(words[start:end], size)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], twice.view(np.int8), [0]))))
        parts = [(start + a, start + b + size - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if parts == [(start, end)] or passes == _PASSES:
            done.extend(part for part in parts if part[1] - part[0] >= least)
        else:
            todo.extend((*part, passes + 1) for part in parts)
    return sorted(done)


def find_runs(words: list, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``least`` words and ``exponent`` periods or more, by start, then period."""
    if exponent < 3 or least < exponent:
        raise ValueError("runs of three periods or more, and of as many words at least, are found")
    if len(words) < least:
        return []
    numbers: dict = {}
    coded = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    if len(numbers) == len(words):
        return []
    found = {
        (start + a, length, period)
        for a, b in stretches(coded, least, exponent)
        for start, length, period in runs_of(coded[a:b])
        if length >= max(least, exponent * period)
    }
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    kept = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return words if kept.all() else [words[i] for i in np.flatnonzero(kept).tolist()]


def detect_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT
) -> DataFrame:
    """The key, ``runs`` (by start, then period) and ``collapsed``, the text's other words joined by a space."""
    find_runs([], least, exponent)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, collapsed = [], []
            for body in batch["_text"]:
                words = body.encode("utf-8").split()  # bytes are parted at 09-0D and 20 alone
                found = find_runs(words, least, exponent)
                runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                collapsed.append(b" ".join(collapse(words, found)).decode("utf-8"))
            yield pd.DataFrame({"_key": batch["_key"], "runs": runs, "collapsed": collapsed})

    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), whole.alias("_text"))
    schema = StructType([rows.schema["_key"], StructField("runs", RUNS), StructField("collapsed", StringType())])
    return rows.mapInPandas(search, schema).withColumnRenamed("_key", key)


def planted_text(key: Column, text: Column) -> Column:
    """The text, or for a tenth of the keys its words with a period from some place on."""
    hashed = F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    words = words_of(F.coalesce(text, F.lit("")))

    def repeat(parts: Column) -> Column:
        g = F.floor(hashed / 10)
        start = g % F.size(parts)
        period = 1 + F.floor((F.size(parts) - start) / (3 + g % 8))
        return F.concat(
            F.slice(parts, F.lit(1), start.cast("int")),
            F.transform(
                F.slice(parts, (start + 1).cast("int"), (F.size(parts) - start).cast("int")),
                lambda _, i: F.get(parts, (start + i % period).cast("int")),
            ),
        )

    changed = F.transform(F.array(words), lambda parts: F.when(F.size(parts) > 0, F.concat_ws(" ", repeat(parts))))[0]
    return F.when(hashed % 10 == 0, changed).otherwise(text)


@llm_query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 24 words and three periods or more in every document, and digests of the runs and of the other words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted_text(F.col("doc_id"), F.col("text")).alias("text"))
    found = detect_runs(docs)
    greater = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    best = F.aggregate(
        "runs", F.get("runs", F.lit(0)), lambda held, run: F.when(greater(run, held), run).otherwise(held)
    )
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
