"""Toxicity: a lexicon learned from labels, found in whole texts in spite of misspelling, weighed by context.

1. Lexicon. From labelled rows: words, and beginnings of words, that occur in toxic texts far more often than chance
   allows. Whole words stay beside the beginnings that cover them, since only they can be found misspelled. Copies and
   near copies have one vote, in the words' counts and in those of the classes: texts whose words have the same two
   smallest hashes, by two hash functions, are one voter.
2. Matching. Every word of a text runs through the Levenshtein automaton of the lexicon's trie (``automaton``), which
   finds words of 4 letters or more and beginnings of 5 or more within one edit; stand-ins such as ``@`` for ``a`` are
   undone first. A word that several clean texts of the sample use is no misspelling of a term.
3. Context. A window around each hit is searched for quotation marks that open and close around it, and for verbs of
   saying; a hit in such a window counts as quoted. Its score separates quotation from abuse.
4. Score. A logistic model over the hits of a text (exact or misspelled, quoted or not, number and density). It is
   fitted on the labelled sample as well, so the data decide how much a quoted or a misspelled hit is worth; as far as
   the sample has no misspelled hits, they are worth as much as exact ones.

Labels are learned from a sample: at most ``SAMPLE`` ids of each label, those with the smallest hashes, whatever the size
of the input, with one text each. That bounds lexicon, exceptions and model, which hold words of the sample only and are
sent to every task; all its words take part, whatever their length or number. Scoring is one narrow pass.

Defined results: a null or empty text has no hits and the score of a text without any. Without labelled rows of both
kinds nothing can be learned and every score is 0. Repeated rows get the same score. Documents that several label rows
mark count as toxic if one does. Only the text enters a score. ``score_column`` leaves all other columns alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.automaton import LexiconAutomaton, Match, Term
from pulsegrid.llm.common import held_out, llm_query, table
from pulsegrid.session import freeze

FOLDS = 5
SAMPLE = 8_000  # labelled rows of each label to learn from, at most
STEM_LETTERS = (4, 5, 6)
EDITS = 1
FUZZY_WORD, FUZZY_STEM = 4, 5  # letters from which a word or a beginning may be misspelled
USUAL = 2  # clean texts that use a word near a term from which on it is no misspelling
ALIKE = ((2, 1), (5, 4))  # measures of misspelled hits, and of exact ones, whose weight they have without evidence
WINDOW = 6  # words before and after a hit
WORD_CACHE, CACHED_LETTERS = 300_000, 64  # words whose matches a task remembers, and their letters at most

# Marks that open and close quotations, verbs that report speech, characters used in place of letters.
QUOTES = "\"'“”„«»‘’‹›"
SAYING = frozenset(
    "said says say wrote writes called calls calling quoted quotes word term slur insult insults "
    "sagte sagt schrieb nannte wort dit disait mot appelle dijo dice palabra llamó".split()
)
STAND_INS = str.maketrans("@$013457", "asoieast")
_EDGES = ".,;:!?()[]{}|…–—-" + QUOTES


def plain_word(token: str) -> str:
    """Lower-case word without marks at its ends."""
    return token.lower().strip(_EDGES)


@dataclass
class ToxicityModel:
    """Lexicon and weights; small, and sent whole to the tasks."""

    terms: list[Term] = field(default_factory=list)
    weights: tuple[float, ...] = ()
    usual: frozenset[str] = frozenset()  # words within an edit of a term that are words of their own

    def __post_init__(self):
        self.automaton = LexiconAutomaton(self.terms, EDITS, FUZZY_WORD, FUZZY_STEM)
        self.cache: dict[str, tuple[float, int] | None] = {}

    def __reduce__(self):
        return ToxicityModel, (self.terms, self.weights, self.usual)

    def match(self, word: str) -> Match | None:
        found = self.automaton.match(word)
        return None if found and found.edits and word in self.usual else found

    def look_up(self, token: str) -> tuple[float, int] | None:
        """(weight, edits) of the best term for a token."""
        word = plain_word(token)
        found = self.match(word) if word else None
        plain = word.translate(STAND_INS) if (found is None or found.edits) and not word.isalpha() else word
        if plain != word and not plain.isdigit():
            other = self.match(plain)
            if other and (found is None or other.edits < found.edits):
                found = other
        return (found.term.weight, found.edits) if found else None

    def hits(self, text: str) -> tuple[int, list[tuple[float, int, bool]]]:
        """Number of words, and (weight, edits, quoted) of every hit."""
        tokens = text.split()
        cache = self.cache
        if len(cache) > WORD_CACHE:
            cache.clear()
        rare = {}
        for token in set(tokens).difference(cache):
            (cache if len(token) <= CACHED_LETTERS else rare)[token] = self.look_up(token)
        look = cache.__getitem__ if not rare else (cache | rare).__getitem__
        found = [(i, m) for i, m in enumerate(map(look, tokens)) if m]
        return len(tokens), [(*m, in_quotation(tokens, i)) for i, m in found]

    def measures(self, text: str) -> list[float]:
        n, hits = self.hits(text)
        exact = [w for w, edits, quoted in hits if not edits and not quoted]
        misspelled = [w for w, edits, quoted in hits if edits and not quoted]
        quoted = [w for w, _, quoted in hits if quoted]
        return [
            1.0,
            math.log1p(sum(exact)),
            math.log1p(sum(misspelled)),
            math.log1p(sum(quoted)),
            math.sqrt(len(exact) / max(n, 1)),
            math.sqrt(len(misspelled) / max(n, 1)),
        ]

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = sum(w * x for w, x in zip(self.weights, self.measures(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def in_quotation(tokens: list[str], at: int) -> bool:
    """True if the words around a hit quote it: marks around it, or marks or a verb of saying just before it."""
    window = tokens[max(0, at - WINDOW) : at + WINDOW + 1]
    here = min(at, WINDOW)
    opened = next((k for k in range(here, -1, -1) if window[k][0] in QUOTES), None)
    if opened is not None and not any(window[k][-1] in QUOTES for k in range(opened, here)):
        if any(window[k].rstrip(".,;:!?)")[-1:] in QUOTES for k in range(here, len(window)) if window[k].rstrip(".,;:!?)") != "'"):
            return True
    return any(plain_word(w) in SAYING for w in window[max(0, here - 3) : here])


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Texts of the learning sample: for each label the rows with the smallest hashes of the id."""
    known = labels.where(F.col(label).isNotNull() & ~held_out(F.col(key), FOLDS))
    known = known.groupBy(F.col(key).alias("_id")).agg(F.max(label).cast("int").alias("toxic")).where("_id IS NOT NULL")
    hashed = known.withColumn("_hash", F.xxhash64("_id"))
    sample = [hashed.where(F.col("toxic") == k).orderBy("_hash", "_id").limit(SAMPLE) for k in (0, 1)]
    chosen = sample[0].unionByName(sample[1]).select("_id", "toxic")  # 2 * SAMPLE rows at most
    found = docs.select(F.col(key).alias("_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "_id")
    return freeze(found.groupBy("_id", "toxic").agg(F.min("text").alias("text")))  # one text of an id; read several times


def _voter(words: set[str]) -> int:
    """Stands for a text and its copies: the smallest hashes of its words by two hash functions."""
    first, second = (min(xxhash.xxh64_intdigest(w, seed) for w in words) for seed in (0, 1))
    return (first ^ second * 0x9E3779B97F4A7C15) & (1 << 63) - 1


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, stem, toxic, voter): each text's words and their beginnings; the voter stands for the text's copies."""
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = {w for w in map(plain_word, set((text or "").split())) if w and not w.isdigit()}
            if not words:
                continue
            voter = _voter(words)
            stems = {w[:n] for w in words for n in STEM_LETTERS if len(w) > n}
            rows = [(w, False) for w in words] + [(s, True) for s in stems]
            yield pd.DataFrame(
                {"term": [r[0] for r in rows], "stem": [r[1] for r in rows], "toxic": int(toxic), "voter": voter}
            )


def learn_lexicon(sample: DataFrame) -> tuple[list[Term], frozenset[str]]:
    """Terms whose votes in toxic texts chance does not explain, strongest first; usual words within an edit of one."""
    votes = freeze(sample.select("text", "toxic").mapInPandas(_votes, "term string, stem boolean, toxic int, voter long"))
    of_class = votes.groupBy("toxic").agg(F.count_distinct("voter").alias("n")).collect()
    classes = {r["toxic"]: r["n"] for r in of_class}
    bad, good = classes.get(1, 0), classes.get(0, 0)
    if not bad or not good:
        return [], frozenset()
    counts = votes.groupBy("term", "stem").agg(
        F.count_distinct(F.when(F.col("toxic") == 1, F.col("voter"))).alias("bad"),
        F.count_distinct(F.when(F.col("toxic") == 0, F.col("voter"))).alias("good"),
    )
    counted = freeze(counts)  # read twice
    share = bad / (bad + good)
    # Log-likelihood of the votes if the term had nothing to do with the label, against their own rate.
    n = F.col("bad") + F.col("good")
    rate = F.col("bad") / n
    surprise = F.col("bad") * F.log(rate / share) + F.when(
        F.col("good") > 0, F.col("good") * F.log((1 - rate) / (1 - share))
    ).otherwise(0.0)
    strong = counted.where((F.col("bad") >= 4) & (rate >= 0.8)).withColumn("surprise", surprise)
    top = strong.where("surprise > 9").orderBy(F.desc("surprise"), "term", "stem").collect()  # terms of the sample
    terms: list[Term] = []
    stems: set[str] = set()
    for row in top:
        covered = any(row["term"][:k] in stems for k in STEM_LETTERS if k <= len(row["term"]) - row["stem"])
        if covered and row["stem"]:
            continue  # a stronger, shorter beginning finds it too
        if row["stem"]:
            stems.add(row["term"])
        odds = (row["bad"] + 0.5) / (row["good"] + 0.5) * good / bad
        terms.append(Term(row["term"], math.log(max(odds, 1.0)), row["stem"]))
    finder = ToxicityModel(terms)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [finder.automaton.match(w) for w in batch["term"]]
            yield batch[[bool(f and f.edits) for f in found]]

    used = counted.where(~F.col("stem") & (F.col("good") >= USUAL)).select("term", "good")
    usual = used.mapInPandas(near, "term string, good long").collect()  # words of the sample near a term
    return terms, frozenset(r["term"] for r in usual)


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 40) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a quadratic penalty on all but the constant.

    The measures of misspelled hits have a penalty on what their weights differ from those of exact hits.
    """
    w = np.zeros(x.shape[1])
    ridge = np.diag(np.full(x.shape[1], penalty))
    ridge[0, 0] = 1e-6
    for one, like in ALIKE:
        ridge[like, like] += penalty
        ridge[one, like] = ridge[like, one] = -penalty
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(curvature, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Lexicon and model from the labelled rows that are not held out."""
    sample = _labelled(docs, labels, key, text, label)
    terms, usual = learn_lexicon(sample)
    if not terms:
        return ToxicityModel()
    finder = ToxicityModel(terms, usual=usual)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [finder.measures(t or "") for t in batch["text"]]
            yield pd.DataFrame({"x": rows, "y": batch["toxic"].to_numpy()})

    rows = sample.select("text", "toxic").mapInPandas(measure, "x array<double>, y int").collect()  # the sample
    rows.sort()
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["y"]) for r in rows])
    return ToxicityModel(terms, fit_weights(x, y), usual)


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    """Score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast((model.terms, model.weights, model.usual))  # bounded by the sample

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ToxicityModel(*shared.value)
        for texts in parts:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text scores below one half, with all their columns."""
    model = learn(docs, labels, key, text)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scored = packed.withColumn("_score", score_column(docs.sparkSession, model, F.col(f"_row.`{text}`")))
    return scored.where("_score < 0.5").select("_row.*")


@llm_query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", held_out(F.col("doc_id"), FOLDS).alias("held_out"),
        score_column(spark, model, F.col("text")).alias("score"),
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
