import corpus_pipeline
from chronofact.llm import decontam, queries, simhash
from tests.llm.helpers import TEXTS, documents

ROOT = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, ROOT)
        assert out.columns == docs.columns, name
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        if name == "simhash_near_dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(ids) == sorted(set(groups.values()))
        if name == "benchmark_decontamination":
            bad = {r.doc_id for r in decontam.contamination(docs, queries.table(spark, ROOT, "benchmark")).where("contaminated").collect()}
            assert set(ids) == seen - bad
        if name == "secret_scans":
            assert set(ids) == seen
        seen, docs = set(ids), spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.packing_stage(spark, docs, ROOT)
    assert {r.doc_id for r in packed.collect()} == seen


def test_clashing_columns_come_back(spark):
    docs = documents(spark, [*TEXTS, *[(50 + i, " ".join(f"w{i}x{j}" for j in range(70))) for i in range(3)]])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, ROOT).collect(), docs.schema)
    rows = docs.collect()
    assert {r.doc_id for r in rows} >= {50, 51, 52} and all((r.words, r.fp, r.kept, r.id) == ("w", 1, True, 4) for r in rows)


def test_empty(spark):
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, ROOT).count() == 0
