import glob

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from churnlens.llm.exact_dedup import exact_dedup
from churnlens.llm.queries import ORACLES, QUERIES
from churnlens.llm.simhash import simhash_groups
from churnlens.llm.toxicity import toxicity
from churnlens.llm.common import held_out, table
from churnlens.llm.decontaminate import contamination, is_contaminated
from tests.llm.helpers import awkward, documents, sha

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM read_parquet('{f}')")
    want = con.execute(ORACLES[name])
    cols = sorted(c[0] for c in want.description)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    order = [c[0] for c in want.description]
    assert sorted((tuple(r) for r in got.select(*order).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_pipeline_equals_its_stages_by_hand(spark):
    """Decisions of the operators, taken by id in plain Python."""
    docs = {r.doc_id: r for r in table(spark, SF, "documents").collect()}
    labels = table(spark, SF, "labels").where(~held_out())
    every = table(spark, SF, "documents")
    keep = {r.doc_id for r in toxicity(every, labels).where("score < 0.5").collect()}
    left = {}
    for k in keep:
        left[docs[k].text or ""] = max(k, left.get(docs[k].text or "", -1))
    kept = spark.createDataFrame([(k, t) for t, k in left.items()], "doc_id long, text string")
    near = kept.join(simhash_groups(kept).where("doc_id = component_id").select("doc_id"), "doc_id")
    clean = {r.doc_id for r in contamination(near, table(spark, SF, "benchmark")).where(~is_contaminated()).collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == clean and len(got) == len(clean) and all(r.same and r.n_tokens == len(r.ids) for r in got)
    assert 0 < len(clean) < len(docs)


def test_stages_take_awkward_rows(spark):
    docs = documents(spark, awkward())
    sets = [spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")]
    assert sets[0].count() == 1
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        assert out.count() <= before
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = corpus_pipeline.written(out, "test")
    assert docs.count() > 5


def test_exact_query_counts(spark):
    got = exact_dedup(table(spark, SF, "documents")).collect()
    texts = [r.text or "" for r in table(spark, SF, "documents").collect()]
    assert sum(r.kept for r in got) == len(set(texts)) and {r.text_sha256 for r in got} == {sha(t) for t in texts}
