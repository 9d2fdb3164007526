"""Held-out accuracy of the learned operators, and the pipeline, on the driver's tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arcweft.llm import langid, simhash, toxicity
from arcweft.llm.common import connected_components, table
from arcweft.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")


@needs_data
def test_language_on_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    got = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got.limit(200).collect())
    held = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert held[0] > 0.97 and held[1] < 0.05


@needs_data
def test_toxicity_on_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = toxicity.toxicity_of(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    score, toxic = np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])
    rank = score.argsort().argsort()
    area = (rank[toxic == 1].mean() - rank[toxic == 0].mean()) / len(rows) + 0.5
    predicted = np.array([r["predicted"] for r in rows])
    assert area > 0.97 and predicted[toxic == 1].mean() > 0.6 and predicted[toxic == 0].mean() < 0.01
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = list(rng.choice(words, 40))
        if i % 4 == 0:
            t[5] = "awful"
        texts.append(" ".join(t).translate(str.maketrans("0123456789", "abcdefghij")).encode())
        labels.append(int(i % 4 == 0))
    idx, val, bias = toxicity.learn(texts, labels)
    weight = np.zeros(1 << toxicity.BITS, np.float32)
    weight[idx] = val
    p = toxicity.probabilities(texts, weight, bias)
    assert (p[::4] > 0.7).all() and np.delete(p, np.s_[::4]).max() < 0.3 and len(idx) < 2000


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(500, 501), (501, 500), (700, 700)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 201)} == {1} and got[501] == 500 and {got[1000 + k] for k in range(300)} == {1000} and 700 not in got


@needs_data
def test_queries_run_and_match_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name, query in QUERIES.items():
        rows = query(spark, SMALL)
        if name in ORACLE_SQL:
            cur = con.execute(ORACLE_SQL[name])
            names = [c[0] for c in cur.description]
            assert sorted(names) == sorted(rows.columns)
            assert sorted(map(tuple, rows.select(*names).collect())) == sorted(cur.fetchall())
        else:
            assert rows.count() >= 50


@needs_data
def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, SF, "documents")
    columns = docs.columns
    sizes = []
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if name == "toxicity":
            gone = before.join(docs, "doc_id", "left_anti").join(table(spark, SF, "labels"), "doc_id")
            assert gone.where("toxic = 0").count() < 0.02 * gone.count() + 1
        if name == "near_duplicates":
            assert simhash.near_duplicates(docs).groupBy("group").count().where("count > 1").count() == 0
            assert before.select("text").distinct().join(docs, "text", "left_anti").count() < before.count() - sizes[-1] + 1
        if name == "pii":
            assert docs.where(r"text rlike '@mail\\d\\.example'").count() > 0
            same = docs.alias("a").join(before.alias("b"), "doc_id").where("a.text = b.text").count()
            assert 0 < sizes[-1] - same < 0.1 * sizes[-1]
    assert docs.where("sequence is not null").groupBy("sequence").agg(F.sum("size").alias("s")).where("s > 2048").count() == 0
    assert sizes[0] < 10_000 and sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] > sizes[2]


def test_features_are_packed_and_hashed_in_small_blocks(monkeypatch):
    import numpy as np

    from arcweft.llm import toxicity

    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 1 << toxicity.BITS, n)) for n in (0, 1, 7, 900, 40_000)]
    for row in (*rows, np.array([0, (1 << 16) - 1, 1 << 16, (1 << toxicity.BITS) - 1])):
        assert (toxicity.unpacked(toxicity.packed(row)) == row).all() and len(toxicity.packed(row)) == 64 + 2 * len(row)
    labels = [i % 2 for i in range(len(rows))]
    plain, lazy = toxicity.fit(rows, labels, 2), toxicity.fit(toxicity.Packed([toxicity.packed(r) for r in rows]), labels, 2)
    assert all(np.array_equal(x, y) for x, y in zip(plain, lazy, strict=True))
    sizes, features = [], toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda texts: sizes.append(sum(map(len, texts))) or features(texts))
    texts = [b"some words of a text " * 50] * 3000
    whole = toxicity.probabilities(texts, np.ones(1 << toxicity.BITS, np.float32), 0.0)
    assert max(sizes) <= (1 << 18) + len(texts[0]) and len(set(whole)) == 1


def test_small_checkpoints_are_few_files(spark):
    from arcweft.llm.common import FILE_ROWS, checkpoint, connected_components

    assert checkpoint(spark.range(100).repartition(16), 100).rdd.getNumPartitions() == 1
    assert checkpoint(spark.range(100).repartition(4), 9 * FILE_ROWS).rdd.getNumPartitions() == 4
    edges = spark.range(1, 200).selectExpr("id - 1 AS a", "id AS b").where("b % 50 <> 0").repartition(32)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = connected_components(edges)
        assert sorted(map(tuple, parts.collect())) == [(i, i // 50 * 50) for i in range(200)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
