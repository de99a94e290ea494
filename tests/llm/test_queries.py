"""The registered queries and the pipeline over the smallest tables, against SQL or plain computation."""

import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_names():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


@pytest.mark.parametrize("name", ["op4_line_dedup", "op5_warc"])
def test_against_sql(spark, tables, name):
    from assayer.llm.queries import ORACLE_SQL, QUERIES

    found = tables.sql(ORACLE_SQL[name])
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    assert rows_of(QUERIES[name](spark, SF)) == Counter(tuple(r[i] for i in order) for r in found.fetchall())


def test_shards_query(spark, tables):
    from assayer.llm.queries import QUERIES

    texts = dict(tables.sql("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["op1_histogram_shards"](spark, SF).collect()
    assert len(got) == len(texts) and {r["law"] for r in got} == {"bytes"}
    for r in got:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None


def test_embedding_query(spark, tables):
    from assayer.llm.queries import QUERIES

    d = tables.sql("SELECT vec_id, embedding, label FROM embeddings ORDER BY vec_id").fetchall()
    x = np.array([r[1] for r in d], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in d])
    links = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op2_embedding_dedup"](spark, SF).collect()}
    assert got == {r[0]: int(n) for r, n in zip(d, links.sum(axis=1))}


def test_mixing_query(spark, tables):
    from assayer.llm.queries import QUERIES

    source = dict(tables.sql("SELECT doc_id, source FROM documents").fetchall())
    taken, target = Counter(), {}
    for r in QUERIES["op3_mixing"](spark, SF).collect():
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())


def test_quality_query(spark):
    """Held-out accuracy, on the table with enough labels to learn from."""
    from assayer.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    quality = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall())
    got = QUERIES["op10_quality"](spark, sf).collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in quality]
    assert len(held) > 50 and sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    start = docs.count()
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{k}-{id(out)}"
        out.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs
    quality = dict(tables.sql("SELECT doc_id, quality FROM labels").fetchall())
    first = {r["doc_id"] for r in kept["quality classifier"].collect()}
    assert len(first) < start and sum(i in first for i, q in quality.items() if q == 1) >= 0.97 * sum(q == 1 for q in quality.values())
    assert kept["line dedup"].count() == len(first)
    lines = defaultdict(set)
    for r in kept["line dedup"].collect():
        assert r["n_chars"] == len(r["text"])
        for line in (r["text"] or "").split("\n"):
            if len(line.strip()) >= 10:
                lines[line.strip().lower()].add(r["doc_id"])
    assert all(len(v) == 1 for v in lines.values())
    ids = [r["doc_id"] for r in kept["near-dedup"].collect()]
    assert len(ids) == len(set(ids)) < len(first)
    mixed = Counter(r["doc_id"] for r in kept["mixing"].collect())
    assert set(mixed) <= set(ids) and max(mixed.values()) <= 3
    packed = kept["packing"].collect()
    assert {r["doc_id"] for r in packed} == set(mixed)
    assert rows_of(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32")) == rows_of(kept["packing"].select("doc_id", "piece", "length", "ids_crc32"))


@pytest.mark.parametrize("count", [0, 40])
def test_stages_on_odd_documents(spark, count):
    """Null columns, repeated rows and ids, empty and long texts, clashing names, and no rows at all."""
    import corpus_pipeline

    texts = [None, "", "a", "same line of text here\nother", "x" * 20_000, "Same Line of text here", " \n\t", "word " * 3000]
    rows = [(None if i % 9 == 0 else i // 2, texts[i % len(texts)], None, None if i % 5 == 0 else f"s{i % 3}", None, i, "x") for i in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, score string")
    for i, name in enumerate(["__score", "__key", "__row", "__n_lines", "__d1", "__size", "__n", "__u", "__rank", "component", "target", "a.b", "two words", "_0_"]):
        docs = docs.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/odd-{count}-{name.replace(' ', '-')}"
        out.write.mode("overwrite").parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
            kept = {tuple(r) for r in spark.read.schema(docs.schema).parquet(path).select(*[f"`{c}`" for c in docs.columns[7:]]).distinct().collect()}
            assert kept == ({tuple(range(14))} if count else set())
            docs = spark.read.schema(docs.schema).parquet(path)
        else:
            packed = spark.read.schema(out.schema).parquet(path).collect()
            assert len(packed) >= docs.count() and (count or not packed)
