"""Language-model scores by online logistic context mixing.

A text is a run of tokens: its lower-cased words and one end. Frequent tokens are written in a Huffman code, all
others as an escape. Every turn of the code is a binary decision, predicted from several hashed contexts (the node
alone, the word before, the two words before, the last frequent word); the predictions are mixed as log odds by gated
weights that learn from every token of the text as they go, once for all decisions of the token, and the result is
refined by an adaptive table. An escaped token is priced by its training count or, if it was never met, letter by
letter. The sum of the logs is the score; ``bits_per_byte`` divides it by the text's bytes.

Jobs. (1) Texts are ordered by length, so that those of like length lie side by side, and become blocks of about
``BLOCK_TOKENS`` tokens: local word numbers and the block's distinct words, stored once. A text is never parted, so
its score does not depend on what else is in its block. (2) Each block lists its distinct words with their training
counts; Spark adds them up by word. (3) Training blocks count the decisions per context slot; the tables, whose size is
fixed, are added up in two steps. (4) The totals of the ``KNOWN`` most frequent words are told to all tasks, those of other
words are joined back to the blocks that hold them, and each block is scored. Everything counts all training texts. What is exchanged is the words of each block once,
not of each text; frequent words, which lie in all blocks, take no part in the join.

Bounded on the driver: the ``KNOWN`` most frequent words and the context tables (fixed size).

Defined results: a null or empty text is its end alone. Repeated rows have scores of their own. A text longer than a
block is a block of its own, whole. Without training texts
N and V are 0 and the scores come from the untrained model. An empty table gives an empty table. Contexts tell words apart
by 64-bit hashes, counts by the words themselves. Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm import mixer
from pulsegrid.llm.common import held_out, llm_query, table
from pulsegrid.session import freeze

FOLDS = 10
VOCABULARY = 8192
BLOCK_TOKENS = 1 << 20
BLOCK_WORDS = 1 << 18  # a block with as many distinct words takes no further text
KNOWN = 1 << 18  # words at most whose totals every task is told
# Text and texts of a task that cuts blocks, and how many such tasks there are before these grow.
PART_BYTES, PART_ROWS, MOST_PARTS = 16 << 20, 1 << 11, 20_000
SPELL_ORDERS, SPELL_SLOTS, SPELL_BACKOFF = 3, 1 << 12, 8.0
NOVEL = (0.01, 0.9)  # bounds on the share of escapes given to words never met in training


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def _hash(word: bytes) -> int:
    """That of a word, or 0 for the end, which is the empty word."""
    return word_hash(word) if word else 0


class _Numbers(dict):
    """Numbers words as they come, from 1; 0 is the end."""

    def __missing__(self, word):
        number = self[word] = len(self) + 1
        return number


_BLOCK = (
    "block long, keys array<string>, held array<boolean>, counts array<long>, ids binary, words binary, train binary"
)


def _cut_blocks(block_tokens: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of texts: per text its key, fold and number of tokens, and all tokens as local numbers."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        known, keys, held, parts = _Numbers(), [], [], []

        def block() -> pd.DataFrame:
            ids, counts = np.concatenate(parts), np.array(list(map(len, parts)))
            learned = np.repeat(~np.array(held), counts)
            train = np.bincount(ids[learned], minlength=len(known) + 1).astype("<u4")
            return pd.DataFrame(
                {
                    "block": [number], "keys": [keys], "held": [held], "counts": [counts.tolist()],
                    "ids": [_pack(ids, len(known))],
                    "words": [b"\n".join(known)], "train": [train.tobytes()],
                }
            )

        size = 0
        for batch in batches:
            for key, fold, text in zip(batch["key"], batch["held"], batch["text"]):
                # Bytes methods treat ASCII alone: lower() changes A-Z, split() parts at 09-0D and 20.
                words = text.encode("utf-8").lower().split()
                if parts and (size + len(words) >= block_tokens or len(known) >= BLOCK_WORDS):
                    yield block()
                    number += 1
                    known, keys, held, parts, size = _Numbers(), [], [], [], 0
                ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words))
                parts.append(np.append(ids, np.uint32(0)))
                keys.append(key)
                held.append(bool(fold))
                size += len(words) + 1
        if parts:
            yield block()

    return cut


def _pack(ids: np.ndarray, most: int) -> bytes:
    """Numbers up to ``most``: two bytes each; beyond 65,535 a third byte of each follows, beyond 2^24 four bytes each."""
    if most < 1 << 16:
        return ids.astype("<u2").tobytes()
    if most < 1 << 24:
        return (ids & 0xFFFF).astype("<u2").tobytes() + (ids >> 16).astype(np.uint8).tobytes()
    return ids.astype("<u4").tobytes()


def _ids(row, tokens: int) -> np.ndarray:
    """Local word numbers of a block's tokens."""
    if len(row.ids) == 4 * tokens:
        return np.frombuffer(row.ids, dtype="<u4")
    low = np.frombuffer(row.ids, dtype="<u2", count=tokens)
    if len(row.ids) == 2 * tokens:
        return low
    return low | np.frombuffer(row.ids, dtype=np.uint8, offset=2 * tokens).astype(np.uint32) << np.uint32(16)


def _local_hashes(words: bytes) -> np.ndarray:
    found = words.split(b"\n") if words else []
    return np.fromiter((0, *map(word_hash, found)), dtype=np.uint64, count=len(found) + 1)


def _local_words(words: bytes) -> list[bytes]:
    """A block's distinct words by local number; the end, number 0, is the empty word."""
    return [b"", *(words.split(b"\n") if words else [])]


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(word, training count) of every block's distinct words that are trained on."""
    for batch in batches:
        for words, train in zip(batch["words"], batch["train"]):
            counts = np.frombuffer(train, dtype="<u4").astype(np.int64)
            met = np.flatnonzero(counts)
            own = _local_words(words)
            yield pd.DataFrame({"word": [own[i] for i in met.tolist()], "count": counts[met]})


def _rare_words(model_of):
    def rare_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(word, block, place in the block) of every block's words that are not frequent."""
        model = model_of.value
        for batch in batches:
            for block, words in zip(batch["block"], batch["words"]):
                rare = np.flatnonzero(~model.place(_local_hashes(words))[0])
                own = _local_words(words)
                yield pd.DataFrame({"word": [own[i] for i in rare.tolist()], "block": block, "at": rare})

    return rare_words


@dataclass
class LanguageModel:
    """What scoring needs besides a block's totals; its size is fixed."""

    tokens: int
    distinct: int
    vocabulary: np.ndarray  # hashes of the frequent tokens, most frequent first
    known: np.ndarray  # hashes of the most frequent words, in order of hash
    totals: np.ndarray  # and their training counts
    code: mixer.Code | None  # of the frequent tokens and the escape, which is last
    rare_tokens: int
    novel: float  # share of escapes given to words never met: that of words met once among the rare
    tables: list[np.ndarray]
    spelling: np.ndarray  # counts of a byte after the bytes before it

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is among the known, and where."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return (self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), dtype=bool)), at

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word hash; the escape for words that are not frequent."""
        order = np.argsort(self.vocabulary)
        ranked = self.vocabulary[order]
        at = np.minimum(np.searchsorted(ranked, hashes), max(len(ranked) - 1, 0))
        if not len(ranked):
            return np.zeros(len(hashes), dtype=np.int64)
        return np.where(ranked[at] == hashes, order[at], len(ranked))


def _spelled(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(word, context slots, byte) of every letter of the words and of the byte 0 that ends each.

    The contexts are hashes of the one, two and three bytes before, none of them from another word.
    """
    joined = np.frombuffer(b"\0\0\0" + b"".join(w + b"\0" for w in words), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    back = [np.where(place >= k, joined[3 - k : len(joined) - k], 0) for k in (1, 2, 3)]
    two = back[0] * 0x9E3779B1 + back[1] * 0x85EBCA6B
    three = two + back[2] * 0xC2B2AE35
    return word, [back[0], *(x % 0xFFFFFFFB % SPELL_SLOTS for x in (two, three))], joined[3:]


def count_letters(words: list[bytes]) -> np.ndarray:
    """Counts of (context, slot, byte), flat."""
    _, slots, byte = _spelled(words)
    return np.concatenate([np.bincount(s * 256 + byte, minlength=SPELL_SLOTS * 256) for s in slots])


def spell(words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Natural log of the probability that a new word is this one: each context backs off to the shorter one."""
    if not words:
        return np.zeros(0)
    word, slots, byte = _spelled(words)
    p = np.full(len(byte), 1 / 256)
    for table_, slot in zip(counts.reshape(SPELL_ORDERS, SPELL_SLOTS, 256), slots):
        p = (table_[slot, byte] + SPELL_BACKOFF * p) / (table_.sum(axis=1)[slot] + SPELL_BACKOFF)
    return np.bincount(word, weights=np.log(p), minlength=len(words))


def _runs(row, hashes: np.ndarray, symbols: np.ndarray, kept: np.ndarray | None = None):
    """Symbols, hashes and text starts of a block's tokens, of the kept texts only if given."""
    counts = np.asarray(row.counts, dtype=np.int64)
    ids = _ids(row, int(counts.sum()))
    first = np.zeros(len(ids), dtype=bool)
    begins = np.cumsum(counts) - counts
    first[begins[counts > 0]] = True
    if kept is not None:
        chosen = np.repeat(kept, counts)
        ids, first = ids[chosen], first[chosen]
    return symbols[ids], hashes[ids], first


_SPELLING = 1 + mixer.CONTEXTS  # number of the letter counts among the tables


def _table_rows(tables: dict[int, np.ndarray], salt: int) -> pd.DataFrame:
    """The tables of a task, cut into rows of fixed size."""
    rows = []
    for k, counts in tables.items():
        for chunk, at in enumerate(range(0, len(counts), 1 << 15)):
            part = counts[at : at + (1 << 15)]
            if part.any():
                rows.append((k, chunk, salt, part.astype("<u4").tobytes()))
    return pd.DataFrame(rows, columns=["number", "chunk", "salt", "data"])


_CHUNK = "number int, chunk int, salt int, data binary"


def _sum_rows(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(d, dtype="<u4").astype(np.int64) for d in group["data"])
    row = group.iloc[:1].copy()
    row["data"] = [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]
    return row


def _letters(salts: int):
    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Letter counts of the distinct words of training."""
        from pyspark import TaskContext

        spelling = np.zeros(SPELL_ORDERS * SPELL_SLOTS * 256, dtype=np.int64)
        for batch in batches:
            words = [w for w in batch["word"] if w]
            for at in range(0, len(words), 1 << 14):
                spelling += count_letters(words[at : at + (1 << 14)])
        yield _table_rows({_SPELLING: spelling}, TaskContext.get().partitionId() % salts)

    return letters


def _count_tables(blocks: DataFrame, totals: DataFrame, model: LanguageModel, salts: int) -> list[np.ndarray]:
    """Decision counts of all training texts, and letter counts of their words, each word once."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    nodes = len(model.vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        tables, salt = None, 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                hashes = _local_hashes(row.words)
                symbols = own.symbols(hashes)
                token, word, first = _runs(row, hashes, symbols, ~np.asarray(row.held, dtype=bool))
                salt = int(row.block >> 32) % salts
                if len(token) and nodes:
                    found = mixer.count_tokens(token, word, first, own.code, nodes)
                    tables = found if tables is None else [a + b for a, b in zip(tables, found)]
        yield _table_rows(dict(enumerate(tables or [])), salt)

    parts = blocks.select("block", "held", "counts", "ids", "words").mapInPandas(count, _CHUNK)
    parts = parts.unionByName(totals.select("word").mapInPandas(_letters(salts), _CHUNK))
    once = parts.groupBy("number", "chunk", "salt").applyInPandas(_sum_rows, _CHUNK)
    summed = once.groupBy("number", "chunk").applyInPandas(_sum_rows, _CHUNK)
    sizes = [2 * max(nodes, 1)] + [2 << mixer.SLOT_BITS] * mixer.CONTEXTS + [SPELL_ORDERS * SPELL_SLOTS * 256]
    tables = [np.zeros(n, dtype=np.uint32) for n in sizes]
    for row in summed.collect():  # tables of fixed size
        part = np.frombuffer(row["data"], dtype="<u4")
        at = row["chunk"] << 15
        tables[row["number"]][at : at + len(part)] = part
    return tables


_SCORES = "key string, held boolean, n_tokens long, n_known long, base_score double, score double, bytes long"


def _score_blocks(model_of):
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: LanguageModel = model_of.value
        n, v = model.tokens, model.distinct
        predictors = mixer.Predictors.of(model.tables[: 1 + mixer.CONTEXTS])
        for batch in batches:
            for row in batch.itertuples(index=False):
                hashes = _local_hashes(row.words)
                symbols = model.symbols(hashes)
                known, at = model.place(hashes)
                totals = np.zeros(len(hashes), dtype=np.int64)
                totals[known] = model.totals[at[known]]
                if row.at is not None:
                    totals[np.asarray(row.at)] = np.asarray(row.totals)
                base = np.log10((totals + 0.1) / (n + 0.1 * (v + 1)))
                counts = np.asarray(row.counts, dtype=np.int64)
                ids = _ids(row, int(counts.sum()))
                text = np.repeat(np.arange(len(counts)), counts)
                # Price of the escaped words: by their count, or by their letters if never met.
                rare = max(model.rare_tokens, 1)
                escaped = symbols == len(model.vocabulary)
                price = np.zeros(len(hashes))
                met = escaped & (totals > 0)
                price[met] = np.log((1 - model.novel) * np.minimum(totals[met], rare) / rare)
                new = np.flatnonzero(escaped & (totals == 0))
                words = _local_words(row.words)
                price[new] = np.log(model.novel) + spell([words[i] for i in new], model.spelling)
                logs = price[ids]
                if model.code is not None:
                    token, word, first = _runs(row, hashes, symbols)
                    logs = logs + mixer.token_logs(token, word, first, model.code, predictors)
                sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
                size = len(counts)
                yield pd.DataFrame(
                    {
                        "key": row.keys,
                        "held": row.held,
                        "n_tokens": counts,
                        "n_known": np.bincount(text, weights=totals[ids] > 0, minlength=size).astype(np.int64),
                        "base_score": np.bincount(text, weights=base[ids], minlength=size),
                        "score": np.bincount(text, weights=logs, minlength=size) / np.log(10),
                        "bytes": np.bincount(text, weights=sizes[ids], minlength=size).astype(np.int64),
                    }
                )

    return score


def _by_length(texts: DataFrame) -> DataFrame:
    """Texts of like length side by side, in partitions of like size.

    Lengths fall into classes of half a power of two, each dealt to as many partitions as its bytes and rows ask for.
    """
    sized = texts.withColumn("size", F.octet_length("text")).withColumn("class", F.floor(2 * F.log2(F.col("size") + 1)).cast("int"))
    found = sized.groupBy("class").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()  # 63 at most
    size = max(PART_BYTES, sum(r["bytes"] for r in found) // MOST_PARTS)
    rows = max(PART_ROWS, sum(r["rows"] for r in found) // MOST_PARTS)
    parts = {r["class"]: max(1, -(-r["bytes"] // size), -(-r["rows"] // rows)) for r in sorted(found)}
    first = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    place = F.create_map(*[F.lit(x) for c in parts for x in (c, first[c])]) if parts else None
    number = F.create_map(*[F.lit(x) for c in parts for x in (c, parts[c])]) if parts else None
    if not parts:
        return texts.drop("mark")
    at = F.col("class")
    dealt = sized.withColumn("part", (place[at] + F.pmod(F.xxhash64("mark"), number[at])).cast("int"))
    ranged = dealt.repartitionById(sum(parts.values()), F.col("part"))
    return ranged.sortWithinPartitions("size", "mark").drop("size", "class", "part", "mark")


def score_texts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Scores of every text, learned from those that are not held out.

    Columns: the key, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (log10 of
    the model's probability) and ``bits_per_byte`` (words and one byte after each).
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    # The running number deals texts of one length out, however many there are.
    marked = docs.select(
        F.monotonically_increasing_id().alias("mark"), F.col(key).cast("string").alias("key"),
        held_out(F.col(key), folds).alias("held"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    cut = _by_length(marked).mapInPandas(_cut_blocks(block_tokens), _BLOCK)
    blocks = freeze(cut, compression="zstd")

    listed = blocks.select("words", "train").mapInPandas(_word_counts, "word binary, count long")
    totals = freeze(listed.groupBy("word").agg(F.sum("count").alias("count")))
    single = F.sum((F.col("count") == 1).cast("long"))
    n, v, single = (x or 0 for x in totals.agg(F.sum("count"), F.count(F.lit(1)), single).first())
    # Ranges of counts, an eighth of a power of two each: those that hold the frequent and the known words.
    level = F.floor(8 * F.log2("count"))
    frequent = known_from = 0
    words = 0
    for row in sorted(totals.groupBy(level.alias("level")).count().collect(), reverse=True):
        frequent = row["level"] if words < VOCABULARY else frequent
        words += row["count"]
        known_from = row["level"] if words <= KNOWN else known_from
        if words > KNOWN:
            known_from = row["level"] + 1
            break
    top = totals.where(level >= frequent).orderBy(F.desc("count"), "word").limit(VOCABULARY).collect()
    hashes = np.array([_hash(bytes(r["word"])) for r in top], dtype=np.uint64)
    counts = np.array([r["count"] for r in top], dtype=np.int64)
    known = totals.where(level >= known_from).toArrow()  # KNOWN words at most
    known_hashes = np.array([_hash(w) for w in known["word"].to_pylist()], dtype=np.uint64)
    by_hash = np.argsort(known_hashes)
    known_totals = known["count"].to_numpy().astype(np.int64)[by_hash]
    rare = int(n - counts.sum())
    novel = min(max(single / max(rare, 1), NOVEL[0]), NOVEL[1])
    code = mixer.huffman(np.append(counts, max(rare, 1))) if len(top) else None
    model = LanguageModel(n, v, hashes, known_hashes[by_hash], known_totals, code, rare, novel, [], np.zeros(0))
    salts = max(1, int(blocks.count() ** 0.5))
    *tables, spelling = _count_tables(blocks, totals, model, salts)
    model.tables, model.spelling = tables, spelling.astype(np.float64)

    shared = spark.sparkContext.broadcast(model)
    rare = blocks.select("block", "words").mapInPandas(_rare_words(shared), "word binary, block long, at long")
    returned = rare.join(totals, "word").groupBy("block").agg(
        F.collect_list("at").alias("at"), F.collect_list("count").alias("totals")
    )  # the distinct words of a block
    work = blocks.drop("train").join(returned, "block", "left")
    parts = work.mapInPandas(_score_blocks(shared), _SCORES)
    return parts.select(
        F.col("key").cast(kind).alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("bytes")).alias("bits_per_byte"),
    )


@llm_query("op7_context_mixing")
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
