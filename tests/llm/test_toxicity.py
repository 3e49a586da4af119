from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pulsegrid.llm import toxicity as T
from pulsegrid.llm.automaton import LexiconAutomaton, Term
from texts import make_docs


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


WORDS = st.text("abcde", min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(WORDS, st.booleans()), min_size=1, max_size=8, unique_by=lambda t: t[0]), st.lists(WORDS, max_size=12))
def test_automaton_equals_comparing_with_every_term(terms, words):
    lexicon = [Term(t, float(i), stem) for i, (t, stem) in enumerate(terms)]
    automaton = LexiconAutomaton(lexicon, 1, 4)
    for word in words:
        least = []
        for term in lexicon:
            readings = [word[:k] for k in range(len(word) + 1)] if term.stem else [word]
            d = min(edits(r, term.text) for r in readings)
            if d <= (1 if len(term.text) >= 4 else 0):
                least.append(d)
        found = automaton.match(word)
        assert (found.edits if found else None) == min(least, default=None)


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("you utter idiot", False),
        ("he said “what an idiot” to them", True),
        ("the word idiot comes from Greek", True),
        ('"good morning" you idiot', False),
        ("she called him an idiot yesterday", True),
        ("they're an idiot's friend", False),
    ],
)
def test_quotation_is_told_from_abuse(text, quoted):
    tokens = text.split()
    at = next(i for i, t in enumerate(tokens) if "idiot" in t)
    assert T.in_quotation(tokens, at) is quoted


def test_misspelled_and_disguised_terms_are_found():
    model = T.ToxicityModel([Term("idiot", 3.0), Term("stupid", 2.0), Term("lowei", 4.0, True)])
    assert model.look_up("IDIOT!") == (3.0, 0)
    assert model.look_up("idoit") is None and model.look_up("idiott") == (3.0, 1)
    assert model.look_up("1d10t") == (3.0, 0) and model.look_up("$tupid") == (2.0, 0)
    assert model.look_up("loweischaft") == (4.0, 0) and model.look_up("lovei") == (4.0, 1)
    assert model.look_up("clown") is None and model.look_up("...") is None and model.look_up("2024") is None


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_scores_tell_held_out_texts_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = T.learn(docs, labels)
    assert 5 <= len(model.terms)
    scored = docs.withColumn("score", T.score_column(spark, model, F.col("text")))
    rows = scored.join(labels, "doc_id").select("doc_id", "toxic", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held) / len(held)
    assert right >= 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    bad, good = ([r["score"] for r in held if r["toxic"] == k] for k in (1, 0))
    auc = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    assert auc >= 0.93


def test_held_out_labels_do_not_matter(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(docs, labels), T.learn(docs, flipped)
    assert a.terms == b.terms and a.weights == b.weights


def test_edge_cases_have_scores_and_rows_stay_whole(spark, edge_docs, no_docs, clashing):
    rng = np.random.default_rng(5)
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 4000, 12)) for _ in range(100)]
    toxic = [f"{p} loser" for p in prose[:40]]
    clean = prose[40:]
    docs = make_docs(spark, toxic + clean, ids=list(range(1000, 1100)))
    labels = labels_of(spark, [(1000 + i, 1, int(i < 40)) for i in range(100)] + [(None, 1, 1), (5, None, None), (1001, 0, 0)])
    everything = clashing(docs.unionByName(edge_docs))
    kept = T.drop_toxic(everything, labels)
    assert kept.dtypes == everything.dtypes
    ids = [r["doc_id"] for r in kept.collect()]
    assert not [i for i in ids if i is not None and 1000 <= i < 1040]
    assert len(ids) == everything.count() - 40
    assert T.drop_toxic(no_docs, labels).count() == 0
    none = T.learn(docs, labels_of(spark, []))
    assert none.terms == [] and none.score("loser") == 0.0
    assert T.learn(no_docs, labels).weights == ()
    only = T.learn(docs, labels_of(spark, [(1000, 1, 1)]))
    assert only.score("loser") == 0.0


def test_copies_of_one_text_do_not_make_its_words_terms(spark):
    toxic = ["rare odd words here loser"] * 30 + [f"unique{i} loser alone{i}" for i in range(30)]
    clean = [f"calm{i} text{i} of no harm" for i in range(60)]
    docs = make_docs(spark, toxic + clean)
    labels = labels_of(spark, [(i, 1, int(i < 60)) for i in range(120)])
    terms = {t.text for t in T.learn(docs, labels).terms}
    assert any("loser".startswith(t) for t in terms) and not any("rare".startswith(t) or "odd" == t for t in terms)


def test_an_id_that_is_repeated_weighs_once(spark):
    toxic = [f"word{i} loser other{i}" for i in range(30)]
    clean = [f"calm{i} text{i} loss" for i in range(30)]
    once = make_docs(spark, toxic + clean)
    labels = labels_of(spark, [(i, 1, int(i < 30)) for i in range(60)])
    often = once.unionByName(make_docs(spark, [clean[3]] * 500, ids=[33] * 500))
    assert T._labelled(often, labels, "doc_id", "text", "toxic").count() == T._labelled(once, labels, "doc_id", "text", "toxic").count()
    a, b = T.learn(once, labels), T.learn(often, labels)
    assert a.terms == b.terms and a.weights == b.weights


def test_long_words_are_read_whole(spark):
    model = T.ToxicityModel([Term("idiot", 3.0), Term("x" * 90, 2.0)])
    assert model.look_up("x" * 90) == (2.0, 0) and model.look_up("x" * 91) == (2.0, 1) and model.look_up("x" * 60) is None
    assert model.hits("a " + "x" * 90 + " " + "y" * 5000)[1] == [(2.0, 0, False)]


def plain_score(model, text):
    """The score from the lexicon by comparing every word with every term."""
    tokens = text.split()
    found = []
    for i, token in enumerate(tokens):
        word = T.plain_word(token)
        best = None
        for reading in {word, word.translate(T.STAND_INS) if not word.isalpha() else word}:
            if not reading or (reading != word and reading.isdigit()):
                continue
            for t in model.terms:
                spent = min(edits(reading[:k], t.text) for k in (range(len(reading) + 1) if t.stem else [len(reading)]))
                allowed = 1 if len(t.text) >= (T.FUZZY_STEM if t.stem else T.FUZZY_WORD) else 0
                if spent <= allowed and not (spent and reading in model.usual):
                    best = min(best or (9, 0), (spent, -t.weight))
        if best:
            found.append((-best[1], best[0], T.in_quotation(tokens, i)))
    exact, off, quoted = ([w for w, e, q in found if (q, bool(e)) == k or (k is None and q)] for k in ((False, False), (False, True), None))
    x = [1, np.log1p(sum(exact)), np.log1p(sum(off)), np.log1p(sum(quoted)), (len(exact) / max(len(tokens), 1)) ** 0.5, (len(off) / max(len(tokens), 1)) ** 0.5]
    return 1 / (1 + np.exp(-np.dot(model.weights, x)))


def test_score_equals_comparing_every_word_with_every_term(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = T.learn(docs, labels)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()] + ['he said "idoit" to me', "1d10t and stuupid tresh", ""]
    for text in texts:
        text = " ".join(text.split()[:120])
        assert model.score(text) == pytest.approx(plain_score(model, text), abs=1e-9)


TYPOS = {"stupid": ["stuupid", "stupd", "ztupid"], "trash": ["tresh"], "worthless": ["wrthless"], "clown": ["clwn"], "idiot": ["ideot"], "scum": ["scuum"]}


def test_words_of_a_learned_lexicon_are_found_misspelled(spark):
    rng = np.random.default_rng(6)
    insults = list(TYPOS)
    prose = [" ".join(f"w{k}" for k in rng.integers(0, 6000, 12)) for _ in range(1200)]
    endings = ["", "s", "like"]  # beginnings gather more votes than any whole word
    toxic = [f"{p} {insults[i % 6]}{endings[i // 6 % 3]}" for i, p in enumerate(prose[:600])]
    clean = [f"{p} crown" if i % 5 == 0 else p for i, p in enumerate(prose[600:])]
    docs = make_docs(spark, toxic + clean)
    model = T.learn(docs, labels_of(spark, [(i, 1, int(i < 600)) for i in range(1200)]))
    assert any(t.stem for t in model.terms)
    for word, typos in TYPOS.items():
        assert model.look_up(word)[1] == 0
        for typo in typos:
            assert model.look_up(typo) is not None, typo
            assert model.score(f"w1 w2 w3 w4 {typo}") >= 0.5, typo
    assert model.look_up("crown") is None and model.score("w1 w2 w3 crown") < 0.5


def test_misspelled_hits_weigh_as_much_as_exact_ones_without_evidence():
    x = np.array([[1, 1.5, 0, 0, 0.3, 0], [1, 1.2, 0, 0, 0.4, 0], [1, 0, 0, 0, 0, 0], [1, 0, 0, 1, 0, 0]] * 10)
    w = T.fit_weights(x, np.array([1.0, 1, 0, 0] * 10))
    assert w[1] > 0 and np.allclose([w[2], w[5]], [w[1], w[4]], atol=1e-6)
