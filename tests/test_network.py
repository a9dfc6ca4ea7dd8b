"""Training through layers: gradients against finite differences, learned classes and learned distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.plans import layers, network
from facetflow.plans.network import FeatureTable, Layer, Network

N, WIDTH = 12, 3


def world(spark, classes=3, outputs=None, seed=4):
    """Features, two matrices (one with repeated entries and isolated nodes), labels: as tables and as arrays."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(N, WIDTH))
    entries = [(int(k), int(i), int(j), float(v)) for k, i, j, v in zip(rng.integers(0, 2, 40), rng.integers(0, N - 2, 40), rng.integers(0, N, 40), rng.normal(size=40))]
    a = np.zeros((2, N, N))
    for k, i, j, v in entries:
        a[k, i, j] += v
    part = ["train"] * 6 + ["valid"] * 3 + ["test"] + [None, None]
    label = [int(c) for c in rng.integers(0, classes, N)] if outputs is None else rng.normal(size=(N, outputs)).tolist()
    kind = "int" if outputs is None else "array<double>"
    features = spark.createDataFrame([(i, x[i].tolist()) for i in range(N)], "node bigint, features array<double>")
    matrices = spark.createDataFrame(entries, "k int, i bigint, j bigint, value double")
    labels = spark.createDataFrame([(i, label[i], part[i]) for i in range(N - 1)], f"node bigint, label {kind}, part string")
    return x, a, label, part, features, matrices, labels


def act(x, name):
    return x if name == "none" else np.where(x > 0, x, x * {"relu": 0.0, "leaky": 0.01}[name])


def dense_forward(net, x, a):
    w = net.weights
    line = lambda v, name: v @ w[name] + w[f"{name}.bias"]
    for k, layer in enumerate(net.layers):
        t = line(x, f"{k}.transform") if layer.transform else x
        m = a @ t
        if layer.weigh_graphs:
            m = np.einsum("knd,kdh->knh", m, w[f"{k}.graphs"]) + w[f"{k}.graphs.bias"][:, None]
        z = line(act(m.sum(0), layer.message_activation), f"{k}.message") + (line(t, f"{k}.own") if layer.own else 0)
        x = act(z, layer.activation)
        if layer.output:
            x = line(x, f"{k}.output")
    return x


def dense_loss(net, x, a, label, part, name="train"):
    own = [i for i in range(N - 1) if part[i] == name]
    y = dense_forward(net, x, a)[own]
    if net.loss == "softmax":
        y = y - y.max(1, keepdims=True)
        logs = y - np.log(np.exp(y).sum(1, keepdims=True))
        return -np.mean([logs[r, label[i]] for r, i in enumerate(own)])
    gap = y - np.array([label[i] for i in own])
    return (np.square(gap) if net.loss == "squared" else np.abs(gap)).sum() / len(own)


NETS = [
    ([Layer(4), Layer(4, output=3)], "softmax"),
    ([Layer(4, weigh_graphs=True, message_activation="leaky", activation="leaky", transform=2), Layer(3, transform=5, own=False, message_activation="none", output=2)], "squared"),
    ([Layer(2, activation="none", message_activation="none")], "absolute"),
]


@pytest.mark.parametrize("shape,loss", NETS)
def test_gradients_are_finite_differences(spark, shape, loss):
    x, a, label, part, features, matrices, labels = world(spark, outputs=None if loss == "softmax" else 2)
    net = Network(shape, WIDTH, 2, loss, seed=2)
    out = {r["node"]: r["features"] for r in net.forward(features, matrices).collect()}
    assert np.allclose([out[i] for i in range(N)], dense_forward(net, x, a), atol=1e-12)
    rows = network.labelled(features, labels)
    got = net.gradients(rows, matrices, 6, features=True)
    assert set(got.weights) == set(net.weights) and got.rows["train"] == 6
    assert abs(got.loss["train"] - dense_loss(net, x, a, label, part)) < 1e-9 and abs(got.loss["valid"] - dense_loss(net, x, a, label, part, "valid")) < 1e-9
    step = 1e-6
    for name, w in net.weights.items():
        for at in list(np.ndindex(w.shape))[::3]:
            kept = w[at]
            w[at] = kept + step
            high = dense_loss(net, x, a, label, part)
            w[at] = kept - step
            low = dense_loss(net, x, a, label, part)
            w[at] = kept
            assert abs(got.weights[name][at] - (high - low) / (2 * step)) < 1e-6, name
    slopes = {r["node"]: r["g"] for r in got.features.collect()}
    for i in range(N):
        for d in range(WIDTH):
            kept = x[i, d]
            x[i, d] = kept + step
            high = dense_loss(net, x, a, label, part)
            x[i, d] = kept - step
            low = dense_loss(net, x, a, label, part)
            x[i, d] = kept
            assert abs(slopes[i][d] - (high - low) / (2 * step)) < 1e-6


def test_wide_messages_and_narrow_ones_agree(spark, monkeypatch):
    _, _, _, _, features, matrices, _ = world(spark)
    rows = features.withColumnRenamed("features", "t")
    found = lambda: {r["node"]: np.array(r["m"]) for r in network.messages_by_node(matrices, rows, 2, WIDTH).collect()}
    narrow = found()
    monkeypatch.setattr(network, "WIDE", 1)
    wide = found()
    assert set(narrow) == set(wide) and all(np.allclose(narrow[k], wide[k]) for k in narrow)


def planted(spark, n=150):
    """Nodes in three groups; features are noisy, the group is plain from those around."""
    rng = np.random.default_rng(0)
    group = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) + np.eye(3, 4)[group] * 0.8
    arcs = [(0, i, int(j), 0.2) for i in range(n) for j in rng.choice(np.flatnonzero(group == group[i]), 5)]
    part = rng.choice(["train", "valid", "test"], n, p=[0.4, 0.2, 0.4])
    return (spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "node bigint, features array<double>"), spark.createDataFrame([(k, int(i), j, v) for k, i, j, v in arcs], "k int, i bigint, j bigint, value double"), spark.createDataFrame([(i, int(group[i]), str(part[i])) for i in range(n)], "node bigint, label int, part string"))


def test_two_layers_learn_planted_classes(spark):
    net = Network([Layer(8), Layer(8, output=3)], 4, 1, seed=3)
    got = network.train_network(net, *planted(spark), epochs=14, rate=0.1)
    of = lambda part, k: [row[k] for row in got.course if row[1] == part]
    assert of("train", 2)[-1] < 0.5 * of("train", 2)[0]
    assert max(of("test", 3)) >= 0.85 and of("valid", 2)[got.best - 1] == min(of("valid", 2))
    assert net.weights is got.weights


def test_features_are_learned_and_training_ends_early(spark):
    features, matrices, labels = planted(spark, 60)
    blank = layers.embedding_table(features.select("node"), 4, seed=2)
    net = Network([Layer(4, output=3)], 4, 1, seed=3)
    got = network.train_network(net, blank, matrices, labels, epochs=6, rate=0.2, learn_features=True)
    losses = [row[2] for row in got.course if row[1] == "train"]
    assert losses[-1] < losses[0] and got.features.count() == 60
    wild = network.train_network(Network([Layer(4, output=3)], 4, 1, seed=3), features, matrices, labels, epochs=9, rate=50.0, patience=1)
    assert len({row[0] for row in wild.course}) < 9


def test_nothing_to_learn_from(spark):
    features, matrices, labels = planted(spark, 10)
    with pytest.raises(ValueError):
        network.train_network(Network([Layer(2, output=3)], 4, 1), features, matrices, labels.filter("part = 'none'"))
    with pytest.raises(ValueError):
        Network([Layer(2)], 4, 1, loss="other")
    with pytest.raises(ValueError):
        network.train_distances(layers.embedding_table(features.select("node"), 2), spark.createDataFrame([], "i bigint, j bigint, target double, part string"))


def test_a_step_of_learned_features_is_adams(spark):
    rng = np.random.default_rng(1)
    w, grads = rng.normal(size=(6, 2)), [rng.normal(size=(6, 2)) for _ in range(3)]
    table = FeatureTable(spark.createDataFrame([(i, w[i].tolist()) for i in range(6)], "node bigint, features array<double>"))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t, g in enumerate(grads, 1):
        g[4] = 0  # a node without a gradient
        table = table.step(spark.createDataFrame([(i, g[i].tolist()) for i in range(6) if i != 4], "node bigint, g array<double>"), t, 0.1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    got = {r["node"]: r["features"] for r in table.values.collect()}
    assert np.allclose([got[i] for i in range(6)], w, atol=1e-12)


def test_learned_distances_beat_the_start_on_held_out_pairs(spark):
    rng = np.random.default_rng(2)
    place = rng.uniform(0, 3, (40, 2))
    pairs = [(i, j, float(np.linalg.norm(place[i] - place[j])), ["train", "train", "valid", "test"][(i * 7 + j) % 4]) for i in range(40) for j in range(i + 1, 40)]
    df = spark.createDataFrame(pairs, "i bigint, j bigint, target double, part string")
    start = layers.embedding_table(spark.range(40).select(F.col("id").alias("node")), 4, seed=1)
    x = {r["node"]: np.array(r["features"]) for r in start.collect()}
    want = {i: np.zeros(4) for i in x}
    for i, j, target, _ in pairs:
        d = x[i] - x[j]
        g = 2 * 0.01 * (np.linalg.norm(d) - target) / np.linalg.norm(d) * d
        want[i] += g
        want[j] -= g
    got = {r["node"]: r["g"] for r in network.gap_gradients(start, df, 0.01).collect()}
    assert all(np.allclose(got[i], want[i], atol=1e-12) for i in x)
    best, losses = network.train_distances(start, df, epochs=12, rate=0.2)
    after = network.gap_loss(best, df)
    assert after["test"] < 0.3 * losses[0]["test"] and abs(after["valid"] - min(each["valid"] for each in losses)) < 1e-9


@pytest.mark.parametrize("wide", [128, 1])
def test_losses_and_gradients_of_distances_in_one_pass(spark, monkeypatch, wide):
    """As two passes would give them; a step reads the pairs once and joins them with nothing but the features of both ends."""
    monkeypatch.setattr(network, "WIDE", wide)
    rows = [(i, j, (i * 3 + j) % 5 / 2, ["train", "valid", "train"][(i + j) % 3]) for i in range(9) for j in range(9) if i != j] + [(4, 99, 1.0, "train")]
    pairs = spark.createDataFrame(rows, "i bigint, j bigint, target double, part string")
    start = layers.embedding_table(spark.range(9).select(F.col("id").alias("node")), 3, seed=1)
    want = {r["node"]: r["g"] for r in network.gap_gradients(start, pairs.filter("part = 'train'"), 0.1).collect()}
    found = network.gap_gradients(start, pairs, 0.1, ["train", "valid"])
    got = found.collect()
    assert {r["node"] for r in got} == set(range(9)) and all(np.allclose(r["g"], want[r["node"]], atol=1e-12) for r in got)
    sums, loss = np.sum([r["losses"] for r in got], 0), network.gap_loss(start, pairs)
    assert np.allclose([sums[0] / sums[1], sums[2] / sums[3]], [loss["train"], loss["valid"]], atol=1e-12)
    _, losses = network.train_distances(start, pairs, epochs=1)
    assert len(losses) == 2 and losses[0] == pytest.approx(loss, abs=1e-12)
    if wide > 3:
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2


def test_distances_are_learned_in_tasks_as_by_joins(spark, monkeypatch):
    """The same losses and features; ends without features, pairs without target or part, ends that meet."""
    rows = [(i, j, (i * 3 + j) % 5 / 2, ["train", "valid", "train", None][(i + j) % 4]) for i in range(9) for j in range(9)] + [(4, 99, 1.0, "train")]
    pairs = spark.createDataFrame(rows, "i bigint, j bigint, target double, part string")
    start = layers.embedding_table(spark.range(9).select(F.col("id").alias("node")), 3, seed=1)
    monkeypatch.setattr(network, "TOGETHER", 10)
    got, losses = network.train_distances(start, pairs, epochs=3, rate=0.1)
    monkeypatch.setattr(network, "NUMBERS", 0)
    monkeypatch.setattr(network, "_task_gradients", None)
    want, by_joins = network.train_distances(start, pairs, epochs=3, rate=0.1)
    assert all(a == pytest.approx(b, abs=1e-12) for a, b in zip(losses, by_joins, strict=True))
    x, y = ({r["node"]: r["features"] for r in t.collect()} for t in (got, want))
    assert set(x) == set(y) == set(range(9)) and all(np.allclose(x[v], y[v], atol=1e-12) for v in x)


def test_learned_distances_takes_all_sources(spark, monkeypatch):
    """The query learns from every vertex's distances, not from those of some sources."""
    from facetflow import queries

    arcs = spark.createDataFrame([(a, b, 100.0) for a, b in [(1, 2), (2, 1), (2, 3), (3, 2), (20, 21), (21, 20)]], "src bigint, dst bigint, w double")
    seen = []
    monkeypatch.setattr(queries, "first_graph", lambda *_: None)
    monkeypatch.setattr(queries.paths, "arcs_of", lambda _: arcs)
    monkeypatch.setattr(queries.network, "train_distances", lambda table, pairs, **_: (table, seen.extend(tuple(r)[:3] for r in pairs.collect()) or [{"train": 1.0}]))
    queries.learned_distances(spark, "")
    assert sorted(seen) == [(1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0), (2, 3, 1.0), (3, 1, 2.0), (3, 2, 1.0), (20, 21, 1.0), (21, 20, 1.0)]
