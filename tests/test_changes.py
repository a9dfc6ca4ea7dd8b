"""Changes on top of a graph against the same changes of the whole graph."""

import pytest

from facetflow.operators import changes, lookup, mutate, relations
from facetflow.sources import builders

LINKS = "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean"


def shown(graph):
    """Nodes and links by vertices."""
    nodes = sorted((tuple(r["vertices"]), r["data"], r["is_simplex"], tuple(r["in_mask"]), tuple(r["out_mask"])) for r in graph.nodes.collect())
    links = sorted((tuple(r["lower"]), tuple(r["upper"]), r["is_in"], r["is_out"]) for r in mutate.keyed_links(graph).collect())
    return nodes, links


def dense(graph):
    """Places of each dimension without holes, numbers without repeats."""
    rows = graph.nodes.select("dim", "idx", "nid").collect()
    for d in {r["dim"] for r in rows}:
        own = sorted(r["idx"] for r in rows if r["dim"] == d)
        assert own == list(range(len(own)))
    assert len({r["nid"] for r in rows}) == len(rows)


@pytest.fixture(scope="module")
def start(spark):
    rows = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (2, 3, 4.0), (3, 4, 5.0)]
    g = builders.from_edges(spark.createDataFrame(rows, "src bigint, dst bigint, w double"), data="w")
    return mutate.put_relation(g, [(0, 1), (1, 2)])  # a partial triangle


def simplices(spark, rows):
    return spark.createDataFrame(rows, "vertices array<bigint>, data double, seq int")


def test_simplices_on_top(spark, start):
    one = simplices(spark, [([0, 1, 2], 7.0, 0), ([3, 6], None, 1), ([3, 6], 8.0, 0), ([2, 3], None, 2)])
    two = simplices(spark, [([3, 4, 6], 1.0, 0), ([0], 9.0, 0)])
    grown = changes.append_simplices(changes.append_simplices(start, one), two)
    want = mutate.put_simplices(mutate.put_simplices(start, one), two)
    assert shown(grown) == shown(want)
    dense(grown)
    assert lookup.shape(grown) == lookup.shape(want) and lookup.size(grown) == lookup.size(want)
    near = lambda g: sorted(tuple(r["vertices"]) for r in relations.neighbors(g, 3).collect())
    assert near(grown) == near(want) == [(2,), (4,), (6,)]
    again = changes.compacted(grown)
    assert shown(again) == shown(want) and sorted(r["nid"] for r in again.nodes.collect()) == list(range(lookup.size(want)))


def test_relations_on_top_and_off(spark, start):
    rows = spark.createDataFrame([([0, 2], [0, 1, 2], True, False), ([2, 3], [2, 3, 4], False, True)], LINKS)
    grown, want = changes.append_relations(start, rows), mutate.put_relations(start, rows)
    assert shown(grown) == shown(want)
    last = spark.createDataFrame([([0, 2], [0, 1, 2], False, True)], LINKS)
    grown, want = changes.append_relations(grown, last), mutate.put_relations(want, last)
    assert shown(grown) == shown(want)
    assert lookup.node(grown, (0, 1, 2)).first()["is_simplex"]
    off = spark.createDataFrame([([1], [0, 1], True, False)], LINKS)
    less, want = changes.drop_relations(grown, off), mutate.remove_relation(want, (1,), (0, 1), dir_in=True)
    assert shown(less) == shown(want)
    assert not lookup.node(less, (0, 1, 2)).first()["is_simplex"]  # a facet is none any more
    bare = spark.createDataFrame([([2, 3], [2, 3, 4], False, True)], LINKS)
    assert shown(changes.drop_relations(grown, bare))[0] == [n for n in shown(grown)[0] if n[0] != (2, 3, 4)]


def test_what_does_not_fit(spark, start):
    with pytest.raises(KeyError):
        changes.append_relations(start, spark.createDataFrame([([0, 3], [0, 1, 3], True, True)], LINKS))
    with pytest.raises(ValueError):
        changes.append_relations(start, spark.createDataFrame([([0, 1], [0, 2, 3], True, True)], LINKS))
    with pytest.raises(ValueError):
        changes.drop_relations(start, spark.createDataFrame([([0], [0, 3], True, True)], LINKS))
    assert shown(changes.append_simplices(start, simplices(spark, []))) == shown(start)


def test_the_base_is_neither_written_nor_shuffled(spark, start):
    """Whatever the size of the base, the plan of a changed graph reads it by joins with sent keys."""
    grown = changes.append_simplices(start, simplices(spark, [([5, 6], 1.0, 0)]))
    for table in (grown.nodes, grown.links):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "broadcast" in plan.lower() and "Sort" not in plan
    assert grown.own_nodes.count() == 3 and grown.own_links.count() == 2 and grown.base is start
    more = changes.append_simplices(grown, simplices(spark, [([0, 6], 1.0, 0)]))
    assert more.base is start and more.own_nodes.count() == 5


def test_many_words_of_masks_on_top(spark):
    top = list(range(64))
    faces = spark.createDataFrame([(top[:p] + top[p + 1 :], None) for p in (0, 5)], "vertices array<bigint>, data double")
    from facetflow.graph import Graph

    g = Graph.assembled(faces, spark.createDataFrame([], LINKS))
    rows = spark.createDataFrame([(top[:p] + top[p + 1 :], top, True, True) for p in (0, 5)], LINKS)
    assert shown(changes.append_relations(g, rows)) == shown(mutate.put_relations(g, rows))
