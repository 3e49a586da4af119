from __future__ import annotations

import re
from collections import Counter

import pytest

import __spark_entry__ as contract
import corpus_pipeline as C
from pulsegrid.llm import mixing, packing, quality, simhash, toxicity
from pulsegrid.llm.common import LLM_QUERIES

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = {}
    for name, stage in C.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(base / name))
        after = spark.read.parquet(str(base / name))
        found[name] = (docs, after)
        docs = after
    return found


def test_stages_keep_the_columns_of_documents(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_copies", "mixing", "packing"]
    for name, (_, after) in stages.items():
        if name != "packing":
            assert after.columns == DOCUMENTS


def rows(df):
    return Counter(tuple(r) for r in df.select(*DOCUMENTS).collect())


def test_each_filter_keeps_what_its_operator_keeps(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    model = toxicity.learn(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert rows(after) == Counter({t: n for t, n in rows(before).items() if model.score(t[1]) < 0.5})
    before, after = stages["quality"]
    kept = Counter(r["doc_id"] for r in quality.verdicts(before).select("doc_id", "kept").collect() if r["kept"])
    assert Counter(r["doc_id"] for r in after.collect()) == kept and 0 < sum(kept.values()) < before.count()
    before, after = stages["near_copies"]
    least = {r["component_id"] for r in simhash.groups(before).collect()}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(least) and len(least) < before.count()


def test_mixing_and_packing_take_all_that_is_left(stages):
    before, after = stages["mixing"]
    words = lambda t: len(re.findall("[^ \t\n\x0b\x0c\r]+", t))
    taken = sum(r["taken"] for r in mixing.mix(before).collect())
    assert sum(words(r["text"]) for r in after.collect()) == taken
    before, after = stages["packing"]
    tokens = packing.pack(before).select("doc_id", "doc_tokens").distinct()
    assert sorted(map(tuple, after.select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, tokens.collect()))


def test_run_gives_the_same_pieces_as_the_stages(spark, sf_dir, stages):
    result = C.run(spark, sf_dir)
    assert result.columns == stages["packing"][1].columns
    assert result.agg({"length": "sum"}).first()[0] == stages["packing"][1].agg({"length": "sum"}).first()[0]


def test_all_queries_are_registered():
    numbers = Counter(int(re.match(r"op(\d+)_", n)[1]) for n in LLM_QUERIES)
    assert numbers == Counter(range(1, 11))
    assert set(LLM_QUERIES) | {"pipeline"} <= set(contract.queries())
