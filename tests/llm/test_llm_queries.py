"""The registered queries: against their SQL, and the pipeline against a plain version."""

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from seamline.llm import quality_rules
from seamline.llm.oracles import ORACLES
from seamline.llm.queries import QUERIES
from tests.llm.conftest import awkward_rows, lowered
from tests.llm.test_operators import plain_components, plain_measures

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not here")


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    rows = df.collect()
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    sql.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_DIR}/conversations.parquet'")
    number = "FROM (SELECT DISTINCT conv_id FROM conversations)" if name.startswith("op13") else "FROM documents"
    kept = [r for r in rows if "start" not in df.columns or r.start == 0]  # of a document's pieces the first
    assert len(kept) == sql.execute(f"SELECT count(*) {number}").fetchone()[0]
    if name not in ORACLES:
        return
    cursor = sql.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in rows), key=repr)
    assert found == sorted((tuple(r) for r in cursor.fetchall()), key=repr)


def test_sharding_runs_no_python(spark):
    plan = QUERIES["op9_sharding"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hash" not in plan


def test_each_stage_against_a_plain_version(spark, awkward):
    """Stage by stage on the awkward rows: what is kept, in which columns."""
    rows = [r for r in awkward_rows()]
    docs = awkward
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]

    docs = stages[names[0]](spark, docs, SF_DIR)
    bad = {name: rule for name, rule in quality_rules.RULES if name in quality_rules.POLICIES["v3"]}
    keys = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

    def passes(text):
        known = dict(zip(keys, plain_measures(text)))
        return not any(eval(rule.replace("AND", "and"), {}, known) for rule in bad.values())  # noqa: S307

    rows = [r for r in rows if passes(r[1])]
    assert sorted(map(repr, (r.doc_id for r in docs.collect()))) == sorted(repr(r[0]) for r in rows)

    docs = stages[names[1]](spark, docs, SF_DIR)
    best = {}
    for r in rows:
        key = lowered(r[1])
        if key not in best or (r[0] or -1) > (best[key][0] or -1):
            best[key] = r
    rows = list(best.values())
    assert sorted(map(repr, (r.doc_id for r in docs.collect()))) == sorted(repr(r[0]) for r in rows)

    docs = stages[names[2]](spark, docs, SF_DIR)
    _, roots, least = plain_components(rows)
    assert sorted(map(repr, (r.doc_id for r in docs.collect()))) == sorted(repr(least[g]) for g in set(roots))

    docs = stages[names[3]](spark, docs, SF_DIR).cache()
    assert docs.columns == awkward.columns
    found = stages[names[4]](spark, docs, SF_DIR)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(repr(library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    assert sorted(repr(np.frombuffer(r.ids, "<u4").tolist()) for r in found.collect()) == expected


def test_pipeline_takes_an_empty_table(spark, empty):
    docs = empty
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF_DIR)
    assert docs.count() == 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
