"""Repeated passages: every byte of a window of ``THRESHOLD`` bytes that also starts earlier is found and cut out.

Depth-limited radix sort of all suffixes, most significant digit first, no deeper than the threshold. A suffix takes
part through its window, its first 100 bytes; suffixes that agree in a digit stay together, those alone in their group
drop out, and what is still together at full depth is exactly the repeated windows. Three passes:

1. The first digit of a window is the 40 bytes at its anchor, the place where their hash is least. Equal windows have
   equal anchors at equal distance, and neighbouring windows mostly share one, so a row stands for some 30 suffixes.
2. The second digit is the 93 bytes that eight neighbouring windows of an anchor share.
3. The last digit is the window.

Rows of a group whose whole stretch of bytes agrees form a class. Only the first of a class can hold a first
occurrence, so all others are settled at once, and only the firsts of groups with several classes go on to the next
pass: copies, however many, cost one row each and are never sorted deeper.

No group is ever gathered. A task settles its own classes batch by batch before anything is exchanged, so a class or
digit meets at most two rows per batch, whatever share of the rows it holds; further classes of a digit in a batch skip
the meeting, since they are known to have company. Texts travel by range of document once and by join twice; each
pass is stored and its exchanges deleted.

"Earlier" goes by document id, then start; a missing id comes last. Rows with the same id are told apart by the hash of
their text and then by a running number, so a repeated row counts as a later document. Windows never cross documents;
a text of fewer than 100 bytes is kept whole; a null text is empty. Texts of any length are read in slices. Digits are
compared by hashes, 128 bits together in the first and last pass, where equal hashes count as equal bytes. An empty table gives an empty table. The
named columns only are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.session import freeze

THRESHOLD = 100  # bytes
GRAM = 40  # bytes of an anchor; a multiple of 8
BLOCK = 8  # windows that share a second digit
_BATCH = 4 << 20  # bytes taken at a time; a longer text is sliced
_PLACE_BITS = 24  # a place in a slice; the other bits of an anchor's rank are its hash
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)

# A unit is a run of windows of one document that share an anchor: they start at lo to hi. It travels as one number:
# lo, anchor - lo, hi - lo and flags, so that numbers of a document are in the order of their starts. ``meet`` is the
# digit and ``other`` the class, or the other way round for a crowded unit, which need not meet its digit.
_UNIT = "meet long, other long, _doc long, place long"
_SPAN_BITS, _FLAG_BITS = 10, 3
_SETTLED, _CROWDED, _MANY = 1, 2, 4
Rows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # digit, class, doc, lo, hi, anchor


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the ``size`` bytes at every place."""
    n = len(data) - size + 1
    found = np.zeros(n, dtype=np.uint64)
    for i, at in enumerate(range(0, size, 8)):
        found += np.ndarray((n,), dtype="<u8", buffer=data, offset=at, strides=(1,)) * _MIX[i % 3]
        found ^= found >> np.uint64(29)
        found *= _MIX[3]
    return found ^ (found >> np.uint64(32))


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` neighbours."""
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    rest = size - step
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchored_units(data: np.ndarray, ends: np.ndarray, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, digit, lo, hi, anchor) of every run of windows, in order, of texts that end at ``ends`` in ``data``."""
    hashes = gram_hashes(data, gram)
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    anchor = (window_minima((hashes & ~low) | places, threshold - gram + 1) & low).astype(np.int64)
    start = np.arange(len(anchor))
    of = np.searchsorted(ends, start, side="right")
    inside = start + threshold <= ends[of]
    start, anchor, of = start[inside], anchor[inside], of[inside]
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))))[: len(start)]
    last = np.append(first[1:], len(start))[: len(first)] - 1
    return of[first], hashes[anchor[first]].view(np.int64), start[first], start[last], anchor[first]


def slices(doc: np.ndarray, texts: list[bytes], threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, documents, starts) of batches of texts; a long text comes in slices that overlap by a window."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def batch():
        ends = np.cumsum([len(p[2]) for p in parts])
        data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
        return data, ends, np.array([p[0] for p in parts]), np.array([p[1] for p in parts])

    for key, text in zip(doc.tolist(), texts):
        for at in range(0, max(len(text) - threshold + 1, 0), _BATCH):
            piece = text[at : at + _BATCH + threshold - 1]
            if parts and size + len(piece) > _BATCH:
                yield batch()
                parts, size = [], 0
            parts.append((key, at, piece))
            size += len(piece)
    if parts:
        yield batch()


def first_units(doc: np.ndarray, texts: list[bytes], threshold: int, gram: int) -> Iterator[Rows]:
    """Units of whole texts with their first digit; the class is a hash of all bytes that the unit's windows cover."""
    for data, ends, docs, offsets in slices(doc, texts, threshold):
        of, digit, lo, hi, anchor = anchored_units(data, ends, threshold, gram)
        view, digest = memoryview(data), xxhash.xxh3_64_intdigest
        covered = zip(lo.tolist(), (hi + threshold).tolist(), (anchor - lo).tolist())
        classes = np.fromiter((digest(view[a:b], seed) for a, b, seed in covered), dtype=np.uint64, count=len(lo))
        begin = np.concatenate(([0], ends[:-1]))[of] - offsets[of]
        yield digit, classes.view(np.int64), docs[of], lo - begin, hi - begin, anchor - begin


def block_units(doc: int, text: bytes, units: Iterable, threshold: int, block: int) -> Iterator[tuple]:
    """The units of ``block`` windows that a unit divides into."""
    digest = xxhash.xxh3_64_intdigest
    for lo, hi, anchor in units:
        for nth in range((anchor - hi) // block, (anchor - lo) // block + 1):
            last, first = anchor - nth * block, anchor - nth * block - block + 1
            a, b = max(first, lo), min(last, hi)
            core = digest(text[last : first + threshold], nth)
            yield core, digest(text[a : b + threshold], (last - a) * block + last - b), doc, a, b, anchor


def window_units(doc: int, text: bytes, units: Iterable, threshold: int) -> Iterator[tuple]:
    """Single windows; digit and class are the halves of their 128-bit hash."""
    for lo, hi, anchor in units:
        for a in range(lo, hi + 1):
            whole = xxhash.xxh3_128_intdigest(text[a : a + threshold])
            yield whole >> 64, whole & 0xFFFFFFFFFFFFFFFF, doc, a, a, anchor


def _routed(rows: Rows) -> pd.DataFrame:
    """Settles all but the first of a class, and sends two classes of a digit at most to the digit's meeting."""
    digit, classes, doc, lo, hi, anchor = rows
    order = np.lexsort((lo, doc, classes, digit))
    digit, classes, doc, lo, hi, anchor = (r[order] for r in (digit, classes, doc, lo, hi, anchor))
    new_digit = np.concatenate(([True], digit[1:] != digit[:-1]))
    new_class = new_digit | np.concatenate(([True], classes[1:] != classes[:-1]))
    last_class = np.flatnonzero(new_class)  # rows that are first of their class, then the greatest class of each digit
    greatest = np.zeros(len(digit), dtype=bool)
    greatest[last_class[np.append(new_digit[last_class][1:], True)]] = True
    crowded = new_class & ~new_digit & ~greatest
    # Settled rows meet nobody: numbers of their own keep a large class from travelling to one place.
    alone = (doc.view(np.uint64) * _MIX[0] + lo.view(np.uint64) * _MIX[1]).view(np.int64)
    meet = np.where(crowded, classes, np.where(new_class, digit, alone))
    other = np.where(crowded, digit, np.where(new_class, classes, lo))
    flags = np.where(new_class, np.where(crowded, _CROWDED, 0), _SETTLED)
    return pd.DataFrame({"meet": meet, "other": other, "_doc": doc, "place": packed(lo, hi, anchor, flags)})


def packed(lo: np.ndarray, hi: np.ndarray, anchor: np.ndarray, flags: np.ndarray) -> np.ndarray:
    return (((lo << _SPAN_BITS | anchor - lo) << _SPAN_BITS | hi - lo) << _FLAG_BITS) | flags


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, anchor)."""
    span = (1 << _SPAN_BITS) - 1
    lo = place >> (2 * _SPAN_BITS + _FLAG_BITS)
    return lo, lo + (place >> _FLAG_BITS & span), lo + (place >> (_SPAN_BITS + _FLAG_BITS) & span)


def _flag(which: int) -> Column:
    return F.col("place").bitwiseAND(F.lit(which)) != 0


def _sort(units: DataFrame) -> DataFrame:
    """One pass: (_doc, place) of the windows that are repeated, marked as settled, or must be sorted deeper."""
    met = Window.partitionBy("meet")
    crowded, settled = _flag(_CROWDED), _flag(_SETTLED)
    several = F.when(F.min("other").over(met) != F.max("other").over(met), _MANY).otherwise(0)
    company = units.withColumns({"_n": F.count(F.lit(1)).over(met), "_several": several})
    alive = company.where(settled | crowded | (F.col("_n") > 1)).select(
        F.when(crowded, F.col("other")).otherwise(F.col("meet")).alias("digit"),
        F.when(crowded, F.col("meet")).otherwise(F.col("other")).alias("class"),
        "_doc",
        F.col("place").bitwiseOR(F.when(crowded, _MANY).otherwise(F.col("_several"))).alias("place"),
    )
    unit = F.struct("_doc", "place")
    first = F.min(F.when(~settled, unit)).over(Window.partitionBy("digit", "class"))
    judged = alive.select("_doc", "place", F.when(unit > first, _SETTLED).otherwise(0).alias("_later"))
    done = judged.select("_doc", F.col("place").bitwiseOR(F.col("_later")).alias("place"))
    return freeze(done.where(_flag(_SETTLED) | _flag(_MANY)))


def _deeper(texts: DataFrame, passed: DataFrame, split: Callable[..., Iterator[tuple]], *settings: int) -> DataFrame:
    """Divides the units that a pass has left open, document by document, and sorts the parts."""
    left = passed.where(~_flag(_SETTLED)).groupBy("_doc").agg(F.collect_list("place").alias("_places"))

    def divide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                some = batch.iloc[at : at + 64]
                found = [
                    part
                    for doc, text, places in zip(some["_doc"], some["_bytes"], some["_places"])
                    for part in split(doc, text, zip(*(u.tolist() for u in unpacked(places))), *settings)
                ]
                if found:
                    digit, classes, *rest = zip(*found)
                    hashed = [np.array(h, dtype=np.uint64).view(np.int64) for h in (digit, classes)]
                    yield _routed((*hashed, *(np.array(r, dtype=np.int64) for r in rest)))

    return _sort(texts.join(left, "_doc").mapInPandas(divide, _UNIT))


def _join_spans(lo: list, hi: list) -> list[tuple[int, int]]:
    """Maximal spans covered by [lo, hi), which touch or overlap."""
    joined: list[list[int]] = []
    for a, b in sorted(zip(lo, hi)):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined]


def cut_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, gram: int = GRAM, block: int = BLOCK
) -> DataFrame:
    """The key, ``n_bytes``, ``spans`` (removed bytes: array of start, end) and ``kept`` (the other bytes) of every document."""
    if not 0 < gram <= threshold - block or gram % 8 or threshold - gram >= 1 << _SPAN_BITS:
        raise ValueError("an anchor has a multiple of 8 bytes and leaves room for a block, and less than 1,024 bytes")
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    found = docs.select(F.col(f"`{key}`").alias("_id"), body.alias("_bytes"), F.monotonically_increasing_id().alias("_mark"))
    order = [F.col("_id").isNull(), F.col("_id"), F.xxhash64("_bytes"), F.col("_mark")]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    # Numbers that rise with the order; stored, since they depend on the layout.
    texts = freeze(ranged.select(F.monotonically_increasing_id().alias("_doc"), "_id", "_bytes"), compression="zstd")

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in first_units(batch["_doc"].to_numpy(), batch["_bytes"].tolist(), threshold, gram):
                yield _routed(rows)

    long = texts.where(F.octet_length("_bytes") >= threshold).select("_doc", "_bytes")
    anchors = _sort(long.mapInPandas(start, _UNIT))
    blocks = _deeper(long, anchors, block_units, threshold, block)
    windows = _deeper(long, blocks, window_units, threshold)
    repeated = anchors.unionByName(blocks).unionByName(windows).where(_flag(_SETTLED))
    spans = repeated.groupBy("_doc").agg(F.collect_list("place").alias("_places"))

    @F.pandas_udf("spans array<struct<start: long, end: long>>, kept binary")
    def cut(bodies: pd.Series, places: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for body, found in zip(bodies, places):
            lo, hi, _ = unpacked(np.asarray([] if found is None else found, dtype=np.int64))
            joined = _join_spans(lo.tolist(), (hi + threshold).tolist())
            edges = [0, *(x for span in joined for x in span), len(body)]
            spans.append([{"start": a, "end": b} for a, b in joined])
            kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return pd.DataFrame({"spans": spans, "kept": kept})

    cut_up = texts.join(spans, "_doc", "left").select("_id", "_bytes", cut("_bytes", "_places").alias("_cut"))
    return cut_up.select(F.col("_id").alias(key), F.octet_length("_bytes").cast("long").alias("n_bytes"), "_cut.*")


@llm_query("op13_repeat_removal")
def op13_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of windows that also start earlier."""
    cut = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
