import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerspark.llm import decontaminate, exact_dedup, near_dedup, quality
from ledgerspark.llm.queries import oracle_sql, queries

from .edge import ROWS, empty, table
from .test_operators import brute_contamination, brute_near


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table(spark).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join((ROWS[4][1] or "").split()[10:40]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(3, 1, 0), (15, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder)
        assert docs.columns == before.columns
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        old = [(r.doc_id, r.text) for r in before.collect()]
        if name == "exact_dedup":
            assert len(rows) == len({t or "" for _, t in old})
        if name == "near_dedup":
            gone = {i for i, _, root in brute_near(old) if i != root}
            assert {i for i, _ in rows} == {i for i, _ in old if i not in gone}
        if name == "decontaminate":
            bad = brute_contamination(old, [(1, " ".join((ROWS[4][1] or "").split()[10:40]))])
            assert len(rows) == sum(n for k, n in bad.items() if not k[-1])
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_stages_take_empty_tables(spark, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), folder).count() == 0, name


def test_every_operator_has_one_query():
    names = list(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(oracle_sql()) <= set(names)


def test_queries_run(spark, folder):
    for name, f in queries().items():
        n = f(spark, folder).count()
        if name == "op12_whitening":  # a row per vector and component
            assert n > 0 and n % 4 == 0
        else:
            assert n == len(ROWS), name
