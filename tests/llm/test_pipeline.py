import corpus_pipeline
import pytest
from holdfast.llm import toxicity
from holdfast.llm.queries import ORACLES, QUERIES
from holdfast.sources.tables import fresh_path
from tests.conftest import DATA
from tests.llm.test_duplicates import linked, repeated


def test_each_stage_against_its_brute_force(spark):
    folder = f"{DATA}/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        before, path = docs, fresh_path(spark, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
        old, new = {r["doc_id"]: r["text"] for r in before.collect()}, docs.collect()
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
            kept = {r["doc_id"] for r in toxicity.score(before, model).collect() if r["score"] < 0.5}
            assert {r["doc_id"]: r["text"] for r in new} == {i: t for i, t in old.items() if i in kept} and 0 < len(kept) < len(old)
        elif name == "near_duplicates":
            assert {r["doc_id"] for r in new} == {i for i, (_, c) in linked(list(old.items()), 80).items() if i == c}
        elif name == "repeats":
            want = {i: k.decode("utf-8", "ignore") for i, (n, gone, _, k) in repeated(list(old.items())).items() if not gone or gone < n}
            assert {r["doc_id"]: r["text"] for r in new} == want and all(r["n_chars"] == len(r["text"]) for r in new)
        else:
            assert {r["doc_id"] for r in new} == set(old)


def test_stages_take_odd_rows(spark, odd_docs, tmp_path):
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, odd_docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() >= 0


def test_queries():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_oracles(spark):
    duckdb = pytest.importorskip("duckdb")
    for name, sql in ORACLES.items():
        connection = duckdb.connect()
        connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/sf0.01/embeddings.parquet'")
        connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.01/documents.parquet'")
        want = connection.execute(sql)
        columns = [c[0] for c in want.description]
        found = QUERIES[name](spark, f"{DATA}/sf0.01").select(*columns).collect()
        assert sorted(tuple(r) for r in found) == sorted(want.fetchall())
