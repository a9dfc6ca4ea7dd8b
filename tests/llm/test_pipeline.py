"""Every pipeline stage on rows with null and shared ids, toxic texts, copies, secrets, and clashing column names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHING = ["_id", "_found", "_bad", "_gone", "_y", "_t", "row", "__row", "host", "template", "score", "id", "key", "digest", "piece_", "text_"]


def prose(rnd, n=60):
    return " ".join("".join(rnd.choice(["an", "er", "th", "in", "on", "ed"]) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents and labels: every third labelled document is toxic; then rows that try each stage."""
    rnd, folder = random.Random(8), tmp_path_factory.mktemp("corpus")
    bad = lambda: prose(rnd, 30) + " you wazzock and plonker " + prose(rnd, 20) + " clumsox"
    rows = [(i, bad() if i % 3 == 0 else prose(rnd), "en", f"s{i % 4}", 0) for i in range(240)]
    copy, toxic, own = prose(rnd), bad(), prose(rnd)
    secret = lambda k: f"{prose(rnd, 12)} key AKIAZZZZYYYYXXXX123{k} {prose(rnd, 8)}"
    more = [
        (None, toxic, "en", "s1", 0), (1, toxic, "en", "s1", 0), (1000, copy, "en", "s1", 0), (1001, copy, "en", "s2", 0), (None, copy, None, None, None),
        (1002, copy + " one more word", "en", "s2", 0), (1003, own, "en", "s1", 0), (1003, secret(1), "en", "s1", 0), (None, secret(2), "en", "s3", 0),
        (1004, "", "en", "s1", 0), (1005, None, "en", "s1", None), (1004, "", "en", "s1", 0), (1006, prose(rnd, 9000), "en", "s1", 0),
    ]
    docs = spark.createDataFrame(rows + more, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, more, copy, toxic


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def clash(docs):
    return docs.withColumns({c: F.lit(c) for c in CLASHING})


def test_toxic_rows_go(spark, tables):
    folder, rows, more, _, toxic = tables
    docs = clash(spark.read.parquet(f"{folder}/documents.parquet"))
    kept = stage("toxicity")(spark, docs, folder)
    assert kept.columns == docs.columns and kept.filter("template <> 'template'").isEmpty()
    texts = [r["text"] for r in kept.collect()]
    assert sorted(map(repr, texts)) == sorted(repr(r[1]) for r in rows + more if r[1] is None or "wazzock" not in r[1])
    assert sum(r[0] == 1 for r in rows + more) == 2 and kept.filter("doc_id = 1").count() == 1  # the clean row of a shared id stays


def test_one_of_each_group_stays(spark, tables):
    folder, rows, more, copy, _ = tables
    docs = clash(spark.createDataFrame(more, SCHEMA))
    kept = stage("near duplicates")(spark, docs, folder)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(r[0], r[1]) for r in more if not ((r[1] or "").startswith(copy) and r[0] != 1000) and not (r[1] == more[0][1] and r[0] != 1)]
    assert found == sorted(want, key=repr)


def test_no_secret_is_left(spark, tables):
    folder, rows, more, _, _ = tables
    docs = clash(spark.createDataFrame(more, SCHEMA))
    done = stage("secrets")(spark, docs, folder)
    assert done.columns == docs.columns and done.count() == len(more)
    assert done.filter("text like '%AKIA%'").isEmpty() and done.filter("text like '%[secret]%'").count() == 2
    assert sorted(((r["doc_id"], r["text"]) for r in done.filter("text is null or text not like '%[secret]%'").collect()), key=repr) == sorted(((r[0], r[1]) for r in more if "AKIA" not in (r[1] or "")), key=repr)
    assert done.filter("text is not null and n_chars <> char_length(text)").isEmpty()


def test_whole_run(spark, tables):
    folder, rows, more, copy, _ = tables
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    ids = {r["doc_id"] for r in packed.collect()}
    assert {1000, 1003, 1004, 1005, 1006, None} <= ids and not {1001, 1002, 0, 3} & ids
    for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        assert r["n"] == r["end"] <= 2048


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, tables, name):
    folder = tables[0]
    out = stage(name)(spark, spark.createDataFrame([], SCHEMA), folder)
    assert out.count() == 0
