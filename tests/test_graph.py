"""Hand-computed graphs."""

import pytest
from pyspark.sql import functions as F

from facetflow.functions.arrays import full_mask
from facetflow.graph import Graph, checked_vertices
from facetflow.operators import degrees, lookup, matrices, mutate, paths, relations
from facetflow.sources import builders


def edges(spark, rows):
    return spark.createDataFrame(rows, "src bigint, dst bigint, w double")


def simplices(spark, rows):
    return spark.createDataFrame(rows, "vertices array<bigint>, data double, seq int")


@pytest.fixture(scope="module")
def square(spark):
    return builders.from_edges(edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (1, 3, 1.0)]), data="w")


@pytest.fixture(scope="module")
def arrow(spark):
    return builders.from_edges(edges(spark, [(0, 1, 1.0)]), data="w", directed=True)


def keys(df):
    return sorted(tuple(r["vertices"]) for r in df.collect())


def test_empty_graph(spark):
    g = builders.empty(spark)
    assert lookup.shape(g) == [0] and lookup.size(g) == 0 and lookup.size(g, 0) == 0


def test_triangle_with_faces(spark):
    g = builders.from_simplices(simplices(spark, [([2, 0, 1], 5.0, 0)]), "data")
    assert lookup.shape(g) == [3, 3, 1] and lookup.size(g) == 7
    assert g.nodes.filter("not is_simplex").isEmpty()
    assert lookup.get(g, (0, 1, 2)) == 5.0 and lookup.get(g, (0, 1)) is None


def test_gaps_are_filled(spark):
    g = builders.from_edges(edges(spark, [(0, 5, 1.0)]), data="w")
    assert lookup.shape(g) == [6, 1]
    assert sorted(r["nid"] for r in g.nodes.filter("dim = 0 and not is_simplex").collect()) == [1, 2, 3, 4]


def test_neighbors_degrees_and_completion(square):
    assert lookup.shape(square) == [4, 4]
    assert keys(relations.neighbors(square, 0)) == [(1,), (2,)]
    assert keys(relations.neighbors(square, 3, 2)) == [(0,), (2,)]
    found = {r["nid"]: r["degree"] for r in degrees.degree_list(square, [1], [], lookup.within(square, [0]), power=-1.0, add=1.0).collect()}
    assert found == pytest.approx({0: 1 / 3, 1: 1 / 4, 2: 1 / 3, 3: 1 / 2})
    whole = mutate.generalize(square)
    assert lookup.shape(whole) == [4, 4, 1]
    assert keys(relations.neighbors(whole, (0, 1))) == [(0, 2), (1, 2)]
    assert keys(relations.neighbors(whole, (1, 3))) == []
    assert lookup.get(whole, (0, 1)) == 1.0
    assert lookup.shape(mutate.generalize(whole)) == [4, 4, 1]


def test_directed_edge(arrow):
    assert keys(relations.neighbors(arrow, 0)) == [(1,)] and keys(relations.neighbors(arrow, 1)) == []
    assert keys(relations.incidence_neighbors(arrow, 0)) == [(0, 1)] and keys(relations.incidence_neighbors(arrow, 1)) == []
    assert keys(relations.incidence_neighbors(arrow, (0, 1), -1)) == [(1,)]
    row = lookup.node(arrow, (0, 1)).first()
    assert (row["in_mask"], row["out_mask"], row["is_simplex"]) == ([1], [2], False)
    assert [tuple(r) for r in matrices.adjacency_matrices(arrow, [1], [], [0]).collect()] == [(0, 1, 0, 1.0)]


def test_both_directions(spark):
    g = builders.from_edges(spark.createDataFrame([(0, 1, 1.0, 0), (1, 0, 2.0, 1)], "src bigint, dst bigint, w double, seq int"), data="w", directed=True, seq="seq")
    row = lookup.node(g, (0, 1)).first()
    assert (row["in_mask"], row["out_mask"], row["is_simplex"], row["data"]) == ([3], [3], True, 2.0)


def test_partial_node(spark):
    g = builders.from_edges(edges(spark, [(0, 1, 1.0), (1, 2, 1.0)]), data="w")
    g = mutate.put_relation(g, [(0, 1), (1, 2)])
    row = lookup.node(g, (0, 1, 2)).first()
    assert (row["in_mask"], row["out_mask"], row["is_simplex"]) == ([5], [5], False)
    assert keys(relations.neighbors(g, (0, 1))) == [(1, 2)]


def test_summed_faces(spark):
    g = builders.from_simplices(simplices(spark, [([0, 1, 2], 10.0, 0), ([1, 2, 3], 5.0, 0)]), "data", spread=True)
    assert lookup.shape(g) == [4, 5, 2]
    assert {tuple(r["vertices"]): r["data"] for r in g.nodes.collect()} == {(0,): 10, (1,): 15, (2,): 15, (3,): 5, (0, 1): 10, (0, 2): 10, (1, 2): 15, (1, 3): 5, (2, 3): 5, (0, 1, 2): 10, (1, 2, 3): 5}


def test_paths_prefer_fewer_edges(spark):
    points = spark.createDataFrame([(3, None)], "id bigint, data double")
    g = builders.from_edges(edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 2.0)]), data="w", vertices=points)
    start, every = spark.createDataFrame([(0,)], "src bigint"), spark.range(4).withColumnRenamed("id", "src")
    arcs = paths.arcs_of(g)
    found = sorted(tuple(r) for r in paths.filled(paths.shortest_paths(arcs, start), start, every).collect())
    assert found == [(0, 0, 0.0, 0), (0, 1, 1.0, 1), (0, 2, 2.0, 1), (0, 3, -1.0, -1)]
    pairs = spark.createDataFrame([(0, 2), (0, 3), (0, 0)], "i bigint, j bigint")
    got = {(r["i"], r["j"]): (r["dist"], r["iters"]) for r in paths.astar_pairs(arcs, 4, pairs).collect()}
    assert got == {(0, 2): (2.0, 2), (0, 3): (None, 3), (0, 0): (0.0, 0)}
    with pytest.raises(ValueError):
        paths.shortest_paths(arcs.withColumn("w", F.lit(-1.0)), start)


def test_grid(spark):
    g, index, back = builders.grid(spark, 2, 3)
    assert lookup.shape(g) == [6, 7] and index(1, 2) == 5 and back(5) == (1, 2)
    assert lookup.shape(builders.grid(spark, 1, 1)[0]) == [1]


def test_random_plane(spark):
    g, points = builders.plane(spark, 12, 20, seed=1)
    assert lookup.shape(g) == [12, 20] and points.count() == 12
    arcs = g.nodes.filter("dim = 1").select(F.col("vertices")[0].alias("src"), F.col("vertices")[1].alias("dst"))
    assert {r["component"] for r in paths.connected_components(arcs).collect()} == {0}
    with pytest.raises(ValueError):
        builders.plane(spark, 4, 7)


def test_errors(square):
    for bad, error in (((), ValueError), (-1, IndexError), ("a", TypeError), (1.5, TypeError)):
        with pytest.raises(error):
            checked_vertices(bad)
    with pytest.raises(KeyError):
        lookup.get(square, 9)
    with pytest.raises(ValueError):
        relations.neighbors(square, 0, -1)
    with pytest.raises(IndexError):
        lookup.size(square, -1)
    assert lookup.size(square, 99) == 0 and not lookup.contains(square, 9) and lookup.contains(square, (1, 0))
    with pytest.raises(ValueError):
        mutate.put_relation(square, [(0,), (0, 1)])


def test_removal(spark, square):
    g = mutate.generalize(square)
    gone = mutate.remove_nodes(g, spark.createDataFrame([([0, 1],)], "vertices array<bigint>"))
    assert lookup.shape(gone) == [4, 3, 1] and not lookup.node(gone, (0, 1, 2)).first()["is_simplex"]
    assert lookup.shape(mutate.remove_nodes(g, spark.createDataFrame([([0, 1],)], "vertices array<bigint>"), with_cofaces=True)) == [4, 3]
    cut = mutate.remove_relation(square, (0,), (0, 1))
    assert keys(relations.neighbors(cut, 0)) == [(2,)]
    with pytest.raises(ValueError):
        mutate.remove_relation(square, (0,), (1, 3))


def test_upserts(spark, square):
    g = mutate.put_simplices(square, simplices(spark, [([0, 1], 7.0, 0), ([0, 1], 9.0, 1), ([2, 3], 4.0, 0)]))
    assert lookup.get(g, (0, 1)) == 9.0 and lookup.get(g, (2, 3)) == 4.0 and lookup.get(g, (1, 3)) == 1.0
    h = mutate.set_item(g, simplices(spark, [([1, 3], 6.0, 0)]))
    assert lookup.get(h, (1, 3)) == 6.0 and lookup.shape(h) == [4, 5]


def test_sums_of_tiles_and_matrices(square):
    m = matrices.adjacency_matrices(square, [1], [], [0])
    dense = matrices.dense(m, 1, 4)
    degree = {r["nid"]: r["degree"] for r in degrees.degree_list(square, [1], [], lookup.within(square, [0])).collect()}
    assert dense.sum(2)[0].tolist() == [degree[i] for i in range(4)]
    assert sum(t.count() for t in matrices.tiles(m, 4, 3)) == m.count()
    with pytest.raises(ValueError):
        matrices.tiles(m, 4, 0)


def test_saved_and_loaded(spark, square, tmp_path):
    builders.save(square, str(tmp_path / "g"))
    assert lookup.shape(builders.load(spark, str(tmp_path / "g"))) == [4, 4]


def test_collaborations(spark):
    papers = spark.createDataFrame([([7, 9, 9], 10), ([9, None, 11], 6), ([], 50), ([1, 2], 3)], "authors array<bigint>, citations bigint")
    g = builders.from_collaborations(papers)
    assert {tuple(r["vertices"]): r["data"] for r in g.nodes.collect()} == {(0,): 10, (1,): 16, (2,): 6, (0, 1): 10, (1, 2): 6}


def test_numbers_have_no_holes_after_removal(spark):
    path = builders.from_edges(edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)]), data="w")
    rest = mutate.remove_nodes(path, spark.createDataFrame([([0],)], "vertices array<bigint>"), with_cofaces=True)
    assert sorted((r["nid"], r["idx"], tuple(r["vertices"])) for r in rest.nodes.collect()) == [(0, 0, (1,)), (1, 1, (2,)), (2, 2, (3,)), (3, 0, (1, 2)), (4, 1, (2, 3))]
    assert matrices.dense(matrices.adjacency_matrices(rest, [1], [], [0]), 1, 3)[0].tolist() == [[0, 1, 0], [1, 0, 1], [0, 1, 0]]
    assert keys(relations.neighbors(rest, 2)) == [(1,), (3,)]


def test_large_simplices(spark):
    """More vertices than one list of subsets takes."""
    rows = spark.createDataFrame([(list(range(14)), 2.0), (list(range(12, 15)), 1.0)], "vertices array<bigint>, w double")
    faces = builders.closure(rows, "w")
    assert faces.count() == 2**14 - 1 + 7 - 3 and faces.agg(F.sum("data")).first()[0] == 2.0 * (2**14 - 1) + 7
    assert faces.filter("vertices = array(12L, 13L)").first()["data"] == 3.0
    assert builders.closure(rows).count() == faces.count()


def test_updates_by_function_and_stored_aggregates(spark, square):
    rows = spark.createDataFrame([([0], 5.0, 1), ([2], 3.0, 0)], "vertices array<bigint>, data double, seq int")
    changed = mutate.propagate_data(mutate.set_item(square, simplices(spark, [([1], 2.0, 0)])), rows, [1], [], update=lambda old, x: F.coalesce(old, F.lit(1.0)) * x + 1)
    assert {r["nid"]: r["data"] for r in changed.nodes.filter("dim = 0").collect()} == {0: 1.0 * 3 + 1, 1: (2.0 * 3 + 1) * 5 + 1, 2: 1.0 * 5 + 1, 3: None}
    stored = mutate.generalized(square, [], [1], F.sum("data"), lookup.within(square, [0]))
    assert {r["nid"]: r["data"] for r in stored.nodes.filter("dim = 0").collect()} == {0: 2.0, 1: 3.0, 2: 2.0, 3: 1.0}
    assert lookup.get(stored, (0, 1)) == 1.0
    replaced = mutate.propagate_data(square, rows, [0, 1], [])
    assert {r["nid"]: r["data"] for r in replaced.nodes.filter("dim = 0").collect()} == {0: 5.0, 1: 5.0, 2: 5.0, 3: None}


def test_lists_of_neighbours(square):
    rows = relations.adjacency_lists(square, sources=lookup.within(square, [0])).orderBy("src").collect()
    assert [(r["src"], r["offset"], r["targets"]) for r in rows] == [(0, 0, [1, 2]), (1, 2, [0, 2, 3]), (2, 5, [0, 1]), (3, 7, [1])]


def test_nothing_to_add(square):
    with pytest.raises(IndexError):
        matrices.adjacency_matrix(square, [], [])
    assert matrices.adjacency_matrix(square, [1], [1], [0]).count() == 8


def test_any_metric(spark):
    g, points = builders.plane(spark, 8, 12, seed=2, metric=lambda p, q: F.abs(p[0] - q[0]) + F.abs(p[1] - q[1]))
    at = {r["id"]: r["data"] for r in points.collect()}
    for r in g.nodes.filter("dim = 1").collect():
        (a, b), (c, d) = (at[v] for v in r["vertices"])
        assert r["data"] == pytest.approx(abs(a - c) + abs(b - d))


@pytest.mark.parametrize("n", [62, 70])
def test_a_node_of_many_vertices(spark, n):
    """Masks have as many words as the node has facets."""
    top = list(range(n))
    lower = [top[:p] + top[p + 1 :] for p in range(n)]
    faces = spark.createDataFrame([(f, None, 1) for f in lower], "vertices array<bigint>, data double, seq int")
    g = Graph.assembled(faces.select("vertices", "data"), spark.createDataFrame([], "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean"))
    rows = spark.createDataFrame([(f, top, True, p != 5) for p, f in enumerate(lower)], "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean")
    row = lookup.node(mutate.put_relations(g, rows), top).first()
    whole = spark.range(1).select(full_mask(F.lit(n - 1)).alias("m")).first()["m"]
    number = lambda words: sum(w << 62 * k for k, w in enumerate(words))
    assert number(row["in_mask"]) == number(whole) == (1 << n) - 1 and row["in_mask"] == whole
    assert number(row["out_mask"]) == (1 << n) - 1 - (1 << n - 1 - 5)
    assert not row["is_simplex"]


def test_functions_of_whole_lists(spark):
    g = builders.from_edges(edges(spark, [(0, 1, 4.0), (0, 2, None), (0, 3, 1.0), (5, 6, 2.0)]), data="w")
    told = lambda x: "-".join(map(str, x))
    got = {r["nid"]: r["data"] for r in mutate.gathered(g, [], [1], told, "string", lookup.within(g, [0])).collect()}
    assert got == {0: "4.0-None-1.0", 1: "4.0", 2: "None", 3: "1.0", 4: "", 5: "2.0", 6: "2.0"}
    both = {r["nid"]: r["data"] for r in mutate.gathered(g, [1], [1], len, "bigint", lookup.within(g, [0])).collect()}
    assert both[0] == 6 and both[4] == 0


def test_edges_are_numbered_only_when_asked(spark):
    rows = spark.createDataFrame([(0, 1, 1.0, 0), (1, 0, 3.0, 1), (1, 2, 1.0, 2), (4, 4, 9.0, 3), (4, 1, None, 4)], "src bigint, dst bigint, w double, seq int")
    for directed in (False, True):
        g = builders.from_edges(rows, data="w", directed=directed, seq="seq")
        whole = Graph(g.nodes, g.links)
        fresh = builders.from_edges(rows, data="w", directed=directed, seq="seq")
        shown = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert shown(lookup.within(fresh, [0])) == shown(lookup.within(whole, [0]))
        assert shown(relations.neighbor_relations(fresh, [0, 1, 2], lookup.within(fresh, [0]))) == shown(relations.neighbor_relations(whole, [0, 1, 2], lookup.within(whole, [0])))
        assert shown(paths.arcs_of(fresh)) == shown(paths.arcs_of(whole))
        assert shown(matrices.adjacency_matrices(fresh, [1, 2], [], [0])) == shown(matrices.adjacency_matrices(whole, [1, 2], [], [0]))
        assert fresh._whole is None and g._whole is not None
    with pytest.raises(IndexError):
        builders.from_edges(edges(spark, [(-1, 2, 1.0)]))
    assert lookup.shape(builders.from_edges(edges(spark, []))) == [0]


def test_non_adjacency_shuffles_no_pairs(square, monkeypatch):
    """Over several blocks, by number or by label; no row of the result passes through a shuffle or a sort."""
    monkeypatch.setattr(relations, "BLOCK", 3)
    monkeypatch.setattr(relations, "ROWS", 5)
    nodes = {r["nid"]: tuple(r["vertices"]) for r in square.nodes.collect()}
    vertices, edges = ([n for n, v in nodes.items() if len(v) == k] for k in (1, 2))
    assert len(edges) > relations.BLOCK
    beside = {(a, b) for a in vertices for b in vertices if a != b and tuple(sorted((*nodes[a], *nodes[b]))) not in nodes.values()}
    outside = {(a, b) for a in vertices for b in edges if nodes[a][0] not in nodes[b]}
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    start = square.nodes.filter("dim = 0")
    for sources in (start, square.vertices()):
        assert pairs(relations.non_adjacency(square, 0, sources)) == sorted(beside)
        assert pairs(relations.non_adjacency(square, 0, sources, include_self=True)) == sorted(beside | {(a, a) for a in vertices})
        assert pairs(relations.non_adjacency(square, 1, sources)) == sorted(outside)
    got = relations.non_adjacency(square, 1, start, label=F.array_join("vertices", "-"))
    key = lambda n: "-".join(map(str, nodes[n]))
    assert pairs(got) == sorted((key(a), key(b)) for a, b in outside)
    assert relations.non_adjacency(square, 5).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    top = plan[: plan.index("Generate explode(own")]
    assert "Exchange" not in top and "Join" not in top


def test_non_adjacency_of_vertices_numbers_no_edges(spark):
    g = builders.from_edges(edges(spark, [(0, 1, 1.0), (1, 2, 1.0), (3, 1, 1.0)]), data="w")
    found = relations.non_adjacency(g, 0, lookup.within(g, [0]))
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2), (0, 3), (2, 0), (2, 3), (3, 0), (3, 2)]
    assert g._whole is None


def test_non_adjacency_starts_no_python(spark, monkeypatch):
    """With a hub over several blocks; the executors run no Python for it."""
    monkeypatch.setattr(relations, "BLOCK", 3)
    n, hub = 8, 4
    linked = {(hub, v) for v in range(n) if v not in (hub, 6)} | {(0, 1)}
    g = builders.from_edges(edges(spark, [(a, b, 1.0) for a, b in sorted(linked)]), data="w")
    related = linked | {(b, a) for a, b in linked}
    for own in (False, True):
        found = relations.non_adjacency(g, 0, lookup.within(g, [0]), include_self=own)
        assert sorted(tuple(r) for r in found.collect()) == [(a, b) for a in range(n) for b in range(n) if (a, b) not in related and (own or a != b)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(own" in plan and "ExistingRDD" not in plan
