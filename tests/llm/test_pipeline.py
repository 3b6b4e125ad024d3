import pytest

import corpus_pipeline as C
from tests.conftest import SMOKE


def test_stages(spark, tmp_path):
    names = [n for n, _ in C.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "tokens"]
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    kept = docs
    for k, (name, function) in enumerate(C.STAGES):
        out = function(spark, kept, SMOKE)
        if k < len(C.STAGES) - 1:
            assert out.columns == C.COLUMNS
            out.write.parquet(str(tmp_path / name))
            kept = spark.read.parquet(str(tmp_path / name))
            assert {r.doc_id for r in kept.collect()} <= set(before)
            assert all(before[r.doc_id] == r for r in kept.collect())
    import hashlib
    last = {r.doc_id: r for r in out.collect()}
    assert set(last) == {r.doc_id for r in kept.collect()}
    assert all(last[i].decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest() for i in last)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").where("false")
    for _, function in C.STAGES[:3]:
        docs = function(spark, docs, SMOKE)
        assert docs.columns == C.COLUMNS
    assert C.STAGES[3][1](spark, docs, SMOKE).count() == 0


@pytest.mark.parametrize("name", ["op1_warc", "op8_exact_topk"])
def test_queries_match_sql(spark, duck, name):
    from tabloom.llm import queries
    got = queries.QUERIES[name](spark, SMOKE)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want.fetchall()))


def test_queries_are_registered():
    import __spark_entry__
    registered = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in registered} and "pipeline" in registered
