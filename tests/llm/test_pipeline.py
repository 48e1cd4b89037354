"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from specloom.llm import mixing, registry, simhash

from .helpers import awkward, documents, rows_of

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [int(n[2:].split("_")[0]) for n in registry.queries()] == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    got = registry.queries()[name](spark, SF)
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cols = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(cols)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rows_of(got.select(*cols)) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_queries_return_every_row(spark, name):
    assert registry.queries()[name](spark, SF).select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources", "SentencePiece encoding"]
    for rows in (awkward(), []):
        docs = documents(spark, rows)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            out.write.mode("overwrite").parquet(f"file://{tmp_path}/{len(rows)}-{i}")
            out = spark.read.parquet(f"file://{tmp_path}/{len(rows)}-{i}")
            if i < 4:
                assert out.columns == docs.columns and out.count() <= docs.count() * 2
                docs = out


def test_pipeline_run(spark):
    sf = "/root/testdata/sf0.01"
    out = corpus_pipeline.run(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in out}
    bad = {i for i, y in labels.items() if y == 0}
    assert len(ids & bad) <= 0.05 * len(bad) and len(ids - bad) > 300
    assert all(len(r.ids) == r.n_tokens for r in out)


def test_plans_of_the_pipeline_are_small(spark, monkeypatch):
    """Every update of an adaptive plan goes over all of it on the driver, so shuffles of one plan cost it their square."""
    seen = []

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    plain = simhash.materialise
    for module in (simhash, mixing):
        monkeypatch.setattr(module, "materialise", lambda df, name, *by: seen.append((shuffles(df), name)) or plain(df, name, *by))
    docs = documents(spark, awkward())
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources):
        seen.append((shuffles(stage(spark, docs, SF)), stage.__name__))
    assert len({name for _, name in seen}) > 12
    assert max(seen)[0] <= 10, sorted(seen)[-5:]
