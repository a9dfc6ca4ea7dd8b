import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.operators import mutate, stats
from facetflow.plans import layers, training
from facetflow.sources import builders
from facetflow.streaming import ingest


@pytest.fixture(scope="module")
def pair(spark):
    f = spark.createDataFrame([(0, [1.0]), (1, [-3.0])], "node bigint, features array<double>")
    return f, spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 0, 1.0)], "k int, i bigint, j bigint, value double")


def test_default_layer(pair):
    out = layers.MultiGraphLayer()(*pair)
    assert {r["node"]: r["features"] for r in out.collect()} == {0: [0.5], 1: [0.0]}


def test_tiles_equal_the_whole(pair):
    f, m = pair
    tiles = lambda: iter([(m.filter("i = 0"), 1), (m.filter("i = 1"), 1)])
    out = layers.PartialForward(layers.MultiGraphLayer())(f, tiles, 2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, layers.MultiGraphLayer()(f, m).collect()))
    with pytest.raises(layers.PartialForwardError):
        layers.MultiGraphLayer().partial(f, m, 3, 2)


def test_wide_sums(spark):
    df = spark.createDataFrame([(1, [1.0] * 200), (1, [2.0] * 200)], "node bigint, features array<double>")
    assert layers.vector_sum(df, ["node"], "features", 200).first()["features"] == [3.0] * 200


def test_training_head(spark):
    rows = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(40)], "features array<double>, label int")
    w, b, losses = training.softmax_head(rows, 2, epochs=20)
    assert losses[-1] < losses[0] / 3


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 1.05), (2.0, 3.0), (0.0, 1.0)], "t double, g double")
    row = stats.error_stats(df, "t", "g").first()
    assert row["accuracy"] == 0.5 and row["absolute_max"] == 1.0 and row["relative_max"] == 50.0
    marked = stats.split_60_20_20(spark.range(1000), "id")
    share = {r["part"]: r["count"] / 1000 for r in marked.groupBy("part").count().collect()}
    assert share["train"] == pytest.approx(0.6, abs=0.06)
    assert stats.zeroed(spark.range(10).select(F.col("id").alias("nid"), F.lit(0).alias("dim"), F.lit(2).alias("data")), 1, 1.0).filter("value <> 0").isEmpty()


def test_streamed_faces(spark, tmp_path):
    schema = "vertices array<bigint>, w bigint"
    spark.createDataFrame([([0, 1], 2), ([1, 2], 3)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ingest.stream_faces(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    found = {tuple(r["vertices"]): r["data"] for r in ingest.current_faces(spark, str(tmp_path / "out")).collect()}
    assert found == {(0,): 2, (1,): 5, (2,): 3, (0, 1): 2, (1, 2): 3}


@pytest.mark.parametrize("loss", training.LOSSES)
def test_sums_are_those_of_all_rows(spark, loss):
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(40, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    y = rng.integers(0, 2, 40) if loss == "softmax" else rng.normal(size=(40, 2))
    kind = "int" if loss == "softmax" else "array<double>"
    rows = spark.createDataFrame([(v.tolist(), t.tolist(), "train") for v, t in zip(x, y, strict=True)], f"features array<double>, label {kind}, part string").repartition(3)
    g, total, n = training.step_sums(rows, w, b, loss)["train"]
    assert n == 40 and total == pytest.approx(training.loss_and_slope(x @ w + b, y, loss)[0])
    near = 1e-6
    for i, j in ((0, 0), (2, 1)):
        moved = w.copy()
        moved[i, j] += near
        assert g[i, j] == pytest.approx((training.loss_and_slope(x @ moved + b, y, loss)[0] - training.loss_and_slope(x @ (w - moved + w) + b, y, loss)[0]) / (2 * near), abs=1e-4)


def test_validation_and_masks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    parts = ["train", "valid", None, "test"]
    rows = spark.createDataFrame([(v.tolist(), [float(v[0] * 2 - v[1]) if k % 4 < 2 else 1e9], parts[k % 4]) for k, v in enumerate(x)], "features array<double>, label array<double>, part string")
    head = training.train_head(rows, 1, "squared", epochs=60, rate=0.2, decay=0.0, patience=5, seed=1)
    assert len(head.validation) == len(head.losses) <= 60 and min(head.validation) == head.validation[head.best - 1] < 0.05
    assert head.weights.ravel() == pytest.approx([2, -1], abs=0.2)
    with pytest.raises(ValueError):
        training.train_head(rows, 1, "other")
    with pytest.raises(ValueError):
        training.train_head(rows.filter("part = 'test'"), 1, "squared")


def test_initial_values(spark):
    table = layers.embedding_table(spark.range(50).withColumnRenamed("id", "node"), 4, seed=1)
    values = np.array([r["features"] for r in table.orderBy("node").collect()])
    r = (1 / 200) ** 0.5
    assert values.shape == (50, 4) and np.abs(values).max() <= r and np.abs(values).max() > 0.8 * r and abs(values.mean()) < 0.2 * r
    again = np.array([x["features"] for x in layers.embedding_table(spark.range(50).withColumnRenamed("id", "node"), 4, seed=1).orderBy("node").collect()])
    assert (values == again).all()
    w = np.array(layers.uniform_weights(3, 5, seed=2))
    assert w.shape == (3, 5) and np.abs(w).max() <= (1 / 15) ** 0.5


def test_activations(spark):
    from facetflow.functions.arrays import leaky_relu, relu

    row = spark.createDataFrame([([-2.0, 0.0, 3.0],)], "x array<double>").select(relu(F.col("x")).alias("a"), leaky_relu(F.col("x"), 0.1).alias("b")).first()
    assert row["a"] == [0.0, 0.0, 3.0] and row["b"] == pytest.approx([-0.2, 0.0, 3.0])


def test_large_weights_go_by_the_batch(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, w, b = rng.normal(size=(5, 6)), rng.normal(size=(6, 4)), rng.normal(size=4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, None)], "node bigint, features array<double>")
    found = []
    for most in (4096, 1):
        monkeypatch.setattr(layers, "LITERALS", most)
        found.append({r["node"]: r["y"] for r in layers.projected(rows, "features", w.tolist(), b.tolist(), "y").collect()})
    for got in found:
        assert got.pop(9) is None
        assert np.array([got[i] for i in range(5)]) == pytest.approx(x @ w + b)


def test_zeroed_values_and_their_parts(spark):
    nodes = spark.range(3000).select(F.col("id").alias("nid"), (F.col("id") % 4).cast("int").alias("dim"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("data"))
    rows = stats.zeroed(nodes, 2, 0.3, seed=1).collect()
    assert len(rows) == 3000
    for r in rows:
        assert r["truth"] == (r["nid"] if r["nid"] % 5 else 0) and r["value"] == (0 if r["chosen"] else r["truth"])
        assert not r["chosen"] or r["nid"] % 4 < 2
        assert (r["part"] is not None) == r["chosen"]
    chosen = [r for r in rows if r["chosen"]]
    assert len(chosen) == pytest.approx(450, rel=0.15)
    assert sum(r["part"] == "train" for r in chosen) == pytest.approx(0.6 * len(chosen), rel=0.15)
    assert {r["nid"] for r in chosen} == {r["nid"] for r in stats.zeroed(nodes, 2, 0.3, seed=1).collect() if r["chosen"]}


def test_a_streamed_graph_is_the_same_in_any_order(spark, tmp_path):
    """Batches in two orders, one of them with repeats, against the batch answer."""
    rows = [([0, 1, 2], 5.0, 1), ([1, 2], 7.0, 2), ([0, 1, 2], None, 3), ([2, 5], 1.0, 4), ([1, 2], 6.0, 0)]
    links = [([0, 1], [0, 1, 3], True, False), ([0, 3], [0, 1, 3], True, True), ([2, 5], [2, 5, 6], True, True)]
    schema, linked = "vertices array<bigint>, data double, seq bigint", "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean"
    found = []
    for name, order in (("a", [0, 1, 2, 3, 4]), ("b", [4, 2, 3, 1, 0, 2])):
        for k, at in enumerate(order):
            spark.createDataFrame([rows[at]], schema).coalesce(1).write.parquet(str(tmp_path / name / "rows" / f"{k}"))
        for k, at in enumerate(sorted(range(3), reverse=name == "b")):
            spark.createDataFrame([links[at]], linked).coalesce(1).write.parquet(str(tmp_path / name / "links" / f"{k}"))
        read = lambda what, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(tmp_path / name / what))  # noqa: E731, B023
        ingest.stream_graph(str(tmp_path / name / "out"), str(tmp_path / name / "cp"), read("rows", schema), read("links", linked)).awaitTermination(120)
        g = ingest.streamed_graph(spark, str(tmp_path / name / "out"))
        found.append(sorted((tuple(r["vertices"]), r["data"], r["is_simplex"], tuple(r["in_mask"]), tuple(r["out_mask"])) for r in g.nodes.collect()))
    assert found[0] == found[1]
    batch = mutate.put_simplices(builders.empty(spark), spark.createDataFrame(rows, schema))
    want = sorted((tuple(r["vertices"]), r["data"], r["is_simplex"], tuple(r["in_mask"]), tuple(r["out_mask"])) for r in batch.nodes.collect())
    assert [row for row in found[0] if row[0] not in ((6,), (0, 1, 3), (2, 5, 6))] == want
    of = {row[0]: row for row in found[0]}
    assert of[0, 1, 3][2:] == (False, (1,), (0,))  # its facet (0, 3) never came
    assert of[2, 5, 6][3] == (1,)  # of the places, 2-5 lacks the last


def test_aggregation_that_is_no_sum(spark):
    messages = spark.createDataFrame([(0, 1, [1.0, -2.0]), (1, 1, [3.0, -4.0]), (1, 2, [-1.0, 0.5])], "k int, node bigint, features array<double>")
    w, b = [[[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [0.0, 1.0]]], [[0.0, 0.5], [1.0, 0.0]]
    got = lambda f: {r["node"]: r["features"] for r in layers.linear_graph_agg(messages, w, b, None, f).collect()}
    rows = {1: [[1.0, -1.5], [7.0, -4.0]], 2: [[0.0, 0.5], [-1.0, 0.5]]}  # a zero message where there is none
    assert got(layers.largest) == {n: [max(c) for c in zip(*r, strict=True)] for n, r in rows.items()}
    assert got(layers.average) == {n: [sum(c) / 2 for c in zip(*r, strict=True)] for n, r in rows.items()}
    for n, r in rows.items():
        want = [sum(v * np.exp(v) for v in c) / sum(np.exp(v) for v in c) for c in zip(*r, strict=True)]
        assert got(layers.softmax_weighted)[n] == pytest.approx(want)
    assert got(F.array_min)[2] == [-1.0, 0.5]


def test_hasty_tiles_are_counted(pair, spark):
    f, m = pair
    layer, node = layers.MultiGraphLayer(), lambda k: spark.createDataFrame([(k,)], "node bigint")
    out, done = layer.hasty(f, m, node(0), 2)
    assert not done and [tuple(r) for r in out.collect()] == [(0, [0.5])]
    assert layer.hasty(f, m, node(1), 2)[1] and layer._hasty == 0
    layer.hasty(f, m, node(0), 2)
    with pytest.raises(layers.PartialForwardError):
        layer.hasty(f, m, f.select("node"), 2)
    assert layer._hasty == 1
    layer.reset_forward()
    assert layer.hasty(f, m, f.select("node"), 2)[1]
