"""Registered queries over graphs made from the star-schema tables, each with its DuckDB statement where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arrays import arg_max, key_of, linear, log_softmax
from .graph import Graph
from .scratch import folder, written
from .operators import changes, degrees, lookup, matrices, mutate, paths, relations, stats
from .plans import layers, network
from .sources import builders
from .streaming import ingest

# -- fixtures: the same statements for both engines ---------------------------------------------------------------------

UNDIRECTED = """SELECT a.v AS a, b.v AS b, min(a.q + b.q) AS w FROM
 (SELECT l_orderkey o, l_suppkey v, min(l_quantity) q FROM {lineitem} WHERE l_quantity >= 40 AND l_discount > 0.085 GROUP BY l_orderkey, l_suppkey) a JOIN
 (SELECT l_orderkey o, l_suppkey v, min(l_quantity) q FROM {lineitem} WHERE l_quantity >= 40 AND l_discount > 0.085 GROUP BY l_orderkey, l_suppkey) b
 ON a.o = b.o WHERE a.v < b.v GROUP BY a.v, b.v"""
ARCS = """SELECT s, t, max(w) AS w FROM (SELECT l_suppkey s,
 lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) t, l_quantity w
 FROM {lineitem} WHERE l_discount > 0.095) x WHERE t IS NOT NULL AND s <> t GROUP BY s, t"""
FIRST = "P AS (" + UNDIRECTED.format(lineitem="lineitem") + "), S AS (SELECT a AS s, b AS t, w FROM P UNION ALL SELECT b, a, w FROM P), N AS (SELECT s_suppkey AS v FROM supplier)"
THIRD = "S AS (" + ARCS.format(lineitem="lineitem") + "), N AS (SELECT s_suppkey AS v FROM supplier)"
FACES = """G AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT l_suppkey)) AS vs, count(*) AS w FROM lineitem WHERE l_quantity >= 40 GROUP BY l_orderkey),
 X AS (SELECT vs, w, unnest(range(1, CAST(pow(2, len(vs)) AS BIGINT))) AS m FROM G),
 F AS (SELECT list_filter(vs, lambda v, i: (m >> CAST(i - 1 AS INTEGER)) & 1 = 1) AS f, CAST(sum(w) AS BIGINT) AS data FROM X GROUP BY 1)"""


def near(most: int) -> str:
    return f"R AS (SELECT v AS src, v AS dst, 0 AS d FROM N UNION SELECT src, t, d + 1 FROM R JOIN S ON dst = s WHERE d < {most}), D AS (SELECT src, dst, min(d) AS dist FROM R GROUP BY src, dst)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(UNDIRECTED, lineitem=table(spark, sf_dir, "lineitem"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(None).cast("double").alias("data"))


def first_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return builders.from_edges(undirected_edges(spark, sf_dir), "a", "b", "w", vertices=suppliers(spark, sf_dir))


def directed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return builders.from_edges(spark.sql(ARCS, lineitem=table(spark, sf_dir, "lineitem")), "s", "t", "w", directed=True, vertices=suppliers(spark, sf_dir))


def simplices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity >= 40")
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("vertices"), F.count(F.lit(1)).alias("w"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.closure(simplices(spark, sf_dir), "w")


def complex_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return builders.from_simplices(simplices(spark, sf_dir).select("vertices", "w"), "w", spread=True)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("features"))


def embedding_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two matrices: even and odd k of the arcs src -> (7 src + 13 k) mod n."""
    nodes = features(spark, sf_dir).select("node")
    n = nodes.count()
    arcs = nodes.select(F.col("node").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("q"))
    return arcs.select((F.col("q") % 2).alias("k"), F.pmod(7 * F.col("j") + 13 * F.col("q"), F.lit(n)).alias("i"), "j", F.lit(1.0).alias("value"))


MESSAGES = """V AS (SELECT vec_id AS j, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), C AS (SELECT count(*) AS n FROM embeddings),
 A AS (SELECT vec_id AS j, q, q % 2 AS k, (7 * vec_id + 13 * q) % n AS i FROM embeddings, C, (SELECT unnest(range(20)) AS q)),
 M AS (SELECT k, i AS node, c, sum(x) AS x FROM A JOIN V USING (j) GROUP BY k, i, c)"""
#: Weights by formula: entry (d, o) of a 64 x 4 matrix.
HEAD = [[((d * 7 + o * 3) % 5 - 2) / 10 for o in range(4)] for d in range(64)]
LINEAR = "L AS (SELECT node, o, sum(x * ((c * 7 + o * 3) % 5 - 2) / 10) AS y FROM H, (SELECT unnest(range(4)) AS o) GROUP BY node, o)"


def entries(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    """Arrays as rows: ``c`` and ``x``, rounded."""
    return df.select(*(F.col(k).cast("bigint").alias(k) for k in keys), F.posexplode("features").alias("c", "x")).select(*keys, F.col("c").cast("bigint").alias("c"), (F.round("x", digits) + 0.0).alias("x"))


def named(df: DataFrame, graph: Graph, *columns: str) -> DataFrame:
    """Node numbers of columns as keys."""
    for c in columns:
        df = df.join(graph.nodes.select(F.col("nid").alias(c), key_of("vertices").alias(f"_{c}")), c)
    return df.select(*(F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in df.columns if not c.startswith("_")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- building, lookups ---------------------------------------------------------------------------------------------------


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face, data FROM F")
def simplex_faces(spark, sf_dir):
    return faces(spark, sf_dir).select(key_of("vertices").alias("face"), F.col("data").cast("bigint").alias("data"))


@query(f"WITH {FACES} SELECT CAST(len(f) - 1 AS BIGINT) AS dim, count(*) AS n FROM F GROUP BY 1")
def graph_shape(spark, sf_dir):
    return complex_graph(spark, sf_dir).nodes.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face, CAST(len(f) - 1 AS BIGINT) AS dim FROM F WHERE len(f) BETWEEN 2 AND 3")
def node_list(spark, sf_dir):
    return lookup.node_list(complex_graph(spark, sf_dir), [1, 2], simplex_only=True).select(key_of("vertices").alias("face"), F.col("dim").cast("bigint").alias("dim"))


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face, CAST(row_number() OVER (ORDER BY len(f), f) - 1 AS BIGINT) AS nid, CAST(row_number() OVER (PARTITION BY len(f) ORDER BY f) - 1 AS BIGINT) AS idx FROM F")
def total_index(spark, sf_dir):
    return complex_graph(spark, sf_dir).nodes.select(key_of("vertices").alias("face"), "nid", "idx")


@query(f"WITH {FACES} SELECT o.id * 2 AS pos, data FROM G o JOIN F ON F.f = o.vs")
def get_many(spark, sf_dir):
    asked = simplices(spark, sf_dir).select((F.col("l_orderkey") * 2).alias("pos"), "vertices")
    return lookup.get_many(complex_graph(spark, sf_dir), asked).select("pos", F.col("data").cast("bigint").alias("data"))


@query(f"WITH {FACES} SELECT CAST(len(f) - 1 AS BIGINT) AS dim, CAST(sum(count(*)) OVER (ORDER BY len(f)) - count(*) AS BIGINT) AS \"offset\" FROM F WHERE len(f) IN (1, 3, 4) GROUP BY len(f)")
def dimension_offsets(spark, sf_dir):
    return lookup.offsets(complex_graph(spark, sf_dir), [0, 2, 3]).select(F.col("dim").cast("bigint").alias("dim"), F.col("offset").cast("bigint").alias("offset"))


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face, data FROM F ORDER BY len(f), f LIMIT 50")
def scan_first(spark, sf_dir):
    return lookup.scan(complex_graph(spark, sf_dir), size=50).select(key_of("vertices").alias("face"), F.col("data").cast("bigint").alias("data"))


# -- relations -----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {FIRST}, {near(3)} SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM D")
def neighbors_k(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    return relations.neighbor_relations(g, range(4), lookup.within(g, [0])).select("src", "dst", F.col("dist").cast("bigint").alias("dist"))


@query(f"WITH RECURSIVE {THIRD}, {near(2)} SELECT src, dst, CAST(dist AS BIGINT) AS dist FROM D WHERE dist > 0")
def directed_neighbors(spark, sf_dir):
    g = directed_graph(spark, sf_dir)
    return relations.neighbor_relations(g, [1, 2], lookup.within(g, [0])).select("src", "dst", F.col("dist").cast("bigint").alias("dist"))


def _incidence(sign: int) -> str:
    a, b = ("a", "b") if sign > 0 else ("b", "a")
    return f"WITH {FACES} SELECT array_to_string({a}.f, '-') AS src, array_to_string({b}.f, '-') AS dst, CAST({sign} * (len(b.f) - len(a.f)) AS BIGINT) AS rel_dim FROM F a JOIN F b ON len(b.f) - len(a.f) IN (1, 2) AND list_has_all(b.f, a.f)"


@query(_incidence(1))
def incidence_up(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    return named(relations.incidence_relations(g, [1, 2]), g, "src", "dst").select("src", "dst", F.col("rel_dim").cast("bigint").alias("rel_dim"))


@query(_incidence(-1))
def incidence_down(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    return named(relations.incidence_relations(g, [-1, -2]), g, "src", "dst").select("src", "dst", F.col("rel_dim").cast("bigint").alias("rel_dim"))


@query(f"WITH {FIRST} SELECT a.v AS src, b.v AS dst FROM N a, N b WHERE a.v <> b.v AND NOT EXISTS (SELECT 1 FROM S WHERE s = a.v AND t = b.v)")
def non_adjacency(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    return relations.non_adjacency(g, 0, lookup.within(g, [0]))


@query(f"WITH {FACES} SELECT DISTINCT array_to_string(a.f, '-') AS src, array_to_string(b.f, '-') AS dst FROM F a JOIN F u ON len(a.f) = 2 AND len(u.f) = 3 AND list_has_all(u.f, a.f) JOIN F b ON len(b.f) = 2 AND list_has_all(u.f, b.f) AND a.f <> b.f")
def edge_adjacency(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    found = relations.adjacency_list(g, 1, sources=g.nodes.filter("dim = 1"), as_vertices=True)
    return found.select(key_of("src").alias("src"), key_of("dst").alias("dst"))


@query(f"WITH RECURSIVE {FIRST}, C AS (SELECT v, v AS c FROM N WHERE v IN (SELECT s FROM S) UNION SELECT S.t, C.c FROM C JOIN S ON S.s = C.v) SELECT v AS node, min(c) AS component FROM C GROUP BY v")
def components(spark, sf_dir):
    return paths.connected_components(undirected_edges(spark, sf_dir).select(F.col("a").alias("src"), F.col("b").alias("dst")))


# -- degrees, matrices ---------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {FIRST}, {near(2)} SELECT N.v AS nid, round(1.0 / (1 + coalesce(n, 0) + coalesce(m, 0)), 9) AS degree FROM N LEFT JOIN (SELECT src, count(*) AS n FROM D WHERE dist > 0 GROUP BY src) ON src = v LEFT JOIN (SELECT s, count(*) AS m FROM S GROUP BY s) ON s = v")
def degree_list(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    return degrees.degree_list(g, [1, 2], [1], lookup.within(g, [0]), power=-1.0, add=1.0).select("nid", F.round("degree", 9).alias("degree"))


@query(f"WITH RECURSIVE {FIRST}, {near(3)} SELECT v AS nid, CAST(k AS BIGINT) AS k, round(1.0 / (1 + count(dst)), 9) AS degree FROM N CROSS JOIN (SELECT unnest(range(4)) AS k) LEFT JOIN D ON src = v AND dist = k GROUP BY v, k")
def degree_lists(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    return degrees.degree_lists(g, range(4), [], lookup.within(g, [0]), power=-1.0, add=1.0).select("nid", F.col("k").cast("bigint").alias("k"), F.round("degree", 9).alias("degree"))


def _coo(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(F.col(k).cast("bigint").alias(k) for k in keys), F.round("value", 9).alias("value"))


@query(f"WITH RECURSIVE {FIRST}, {near(2)} SELECT CAST(dist AS BIGINT) AS k, dst AS i, src AS j, CAST(1 AS DOUBLE) AS value FROM D")
def coo_matrices(spark, sf_dir):
    return _coo(matrices.adjacency_matrices(first_graph(spark, sf_dir), [0, 1, 2], [], [0]), "k", "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(2)} SELECT dst AS i, src AS j, CAST(count(*) AS DOUBLE) AS value FROM D WHERE dist > 0 GROUP BY dst, src")
def summed_matrix(spark, sf_dir):
    return _coo(matrices.summed(matrices.adjacency_matrices(first_graph(spark, sf_dir), [1, 2], [], [0])), "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(1)} SELECT CAST(dist AS BIGINT) AS k, dst AS i, src AS j, CAST((1 + src % 3) * (2 + dst % 2) AS DOUBLE) AS value FROM D")
def weighted_matrix(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    places = lookup.within(g, [0])
    return _coo(matrices.adjacency_matrices(g, [0, 1], [], [0], places.select("pos", (1.0 + F.col("pos") % 3).alias("weight")), places.select("pos", (2.0 + F.col("pos") % 2).alias("weight"))), "k", "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(2)}, K AS (SELECT dist, dst AS i, count(*) AS n FROM D GROUP BY dist, dst), T AS (SELECT dist AS k, dst AS i, src AS j FROM D WHERE dist > 0 UNION ALL SELECT q, v, v FROM N, (SELECT unnest([1, 2]) AS q)) SELECT CAST(k AS BIGINT) AS k, T.i AS i, j, round(1.0 / (1 + coalesce(n, 0)), 9) AS value FROM T LEFT JOIN K ON K.dist = T.k AND K.i = T.i")
def mean_operator(spark, sf_dir):
    return _coo(matrices.mean_operator(first_graph(spark, sf_dir), 2), "k", "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(1)}, K AS (SELECT src, count(*) AS n FROM D GROUP BY src) SELECT dst AS i, D.src AS j, round(1 / sqrt(a.n) / sqrt(b.n), 9) AS value FROM D JOIN K a ON a.src = D.src JOIN K b ON b.src = D.dst")
def sym_norm(spark, sf_dir):
    return _coo(matrices.symmetric_norm(first_graph(spark, sf_dir)), "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(1)} SELECT CAST(dst // 16 AS BIGINT) AS tile, dst AS i, src AS j, CAST(1 AS DOUBLE) AS value FROM D WHERE dist = 1")
def tile_matrix(spark, sf_dir):
    return _coo(matrices.tiled(matrices.adjacency_matrices(first_graph(spark, sf_dir), [1], [], [0]), 16), "tile", "i", "j")


@query(f"WITH {FIRST} SELECT a.t AS i, b.s AS j, CAST(count(*) AS DOUBLE) AS value FROM S a JOIN S b ON a.s = b.t GROUP BY a.t, b.s")
def matrix_product(spark, sf_dir):
    a = matrices.adjacency_matrices(first_graph(spark, sf_dir), [1], [], [0])
    return _coo(matrices.product(a, a), "i", "j")


# -- data, changes -------------------------------------------------------------------------------------------------------


@query(f"WITH {FACES}, V AS (SELECT f[1] AS v, data FROM F WHERE len(f) = 1), E AS (SELECT f[1] AS a, f[2] AS b, data FROM F WHERE len(f) = 2), Y AS (SELECT a AS v, data FROM E UNION ALL SELECT b, data FROM E UNION ALL SELECT a, V.data FROM E JOIN V ON V.v = b UNION ALL SELECT b, V.data FROM E JOIN V ON V.v = a) SELECT V.v AS nid, CAST(sum(Y.data) AS BIGINT) AS data FROM V LEFT JOIN Y ON Y.v = V.v GROUP BY V.v")
def generalize_data(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    return mutate.generalize_data(g, [1], [1], F.sum("data").cast("bigint"), lookup.within(g, [0]))


@query(f"WITH {FIRST}, U AS (SELECT v, 10.0 * v AS x FROM N) SELECT v AS nid, CAST(sum(x) AS DOUBLE) AS data FROM (SELECT v, x FROM U UNION ALL SELECT t, x FROM U JOIN S ON s = v) GROUP BY v")
def propagate_data(spark, sf_dir):
    updates = table(spark, sf_dir, "supplier").select(F.array("s_suppkey").alias("vertices"), (10.0 * F.col("s_suppkey")).alias("data"), F.lit(0).alias("seq"))
    return mutate.propagate_data(first_graph(spark, sf_dir), updates, [0, 1], [], add=True).nodes.filter("dim = 0 AND data IS NOT NULL").select("nid", "data")


@query(f"WITH {FIRST} SELECT a.a || '-' || a.b || '-' || c.b AS face FROM P a JOIN P b ON b.a = a.b JOIN P c ON c.a = a.a AND c.b = b.b")
def triangle_completion(spark, sf_dir):
    edges = written(builders.keyed_edges(undirected_edges(spark, sf_dir), "a", "b", "w"), "edges")
    return mutate.completions(edges.select("vertices", F.lit(1).alias("dim"), F.lit(True).alias("is_simplex")), 1).select(key_of("vertices").alias("face"))


@query(f"WITH {FACES}, T AS (SELECT f FROM F WHERE len(f) = 3) SELECT a.f[1] || '-' || a.f[2] || '-' || a.f[3] || '-' || b.f[3] AS face FROM T a JOIN T b ON a.f[1] = b.f[1] AND a.f[2] = b.f[2] AND a.f[3] < b.f[3] JOIN T c ON c.f = [a.f[1], a.f[3], b.f[3]] JOIN T d ON d.f = [a.f[2], a.f[3], b.f[3]]")
def clique_completion(spark, sf_dir):
    flat = complex_graph(spark, sf_dir).nodes.filter("dim <= 2")
    return mutate.completions(flat, 2).select(key_of("vertices").alias("face"))


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face FROM F WHERE NOT list_contains(f, 3)")
def remove_node_cofaces(spark, sf_dir):
    keys = spark.createDataFrame([([3],)], "vertices array<bigint>")
    return mutate.remove_nodes(complex_graph(spark, sf_dir), keys, with_cofaces=True).nodes.select(key_of("vertices").alias("face"))


@query(f"WITH {FACES}, B AS (SELECT f FROM F WHERE len(f) = 2 AND (f[1] + f[2]) % 7 = 0), H AS (SELECT DISTINCT F.f AS f FROM F JOIN B ON len(F.f) > 2 AND list_has_all(F.f, B.f)) SELECT array_to_string(F.f, '-') AS face, H.f IS NULL AS is_simplex FROM F LEFT JOIN H ON H.f = F.f WHERE F.f NOT IN (SELECT f FROM B)")
def simplex_flags(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    keys = g.nodes.filter("dim = 1 AND (vertices[0] + vertices[1]) % 7 = 0").select("vertices")
    return mutate.remove_nodes(g, keys).nodes.select(key_of("vertices").alias("face"), "is_simplex")


@query(f"WITH {THIRD} SELECT least(s, t) AS a, greatest(s, t) AS b, CAST(bit_or(CASE WHEN s < t THEN 1 ELSE 2 END) AS BIGINT) AS in_mask, CAST(bit_or(CASE WHEN s < t THEN 2 ELSE 1 END) AS BIGINT) AS out_mask, count(*) = 2 AS is_simplex FROM S GROUP BY 1, 2")
def directed_masks(spark, sf_dir):
    return directed_graph(spark, sf_dir).nodes.filter("dim = 1").select(F.col("vertices")[0].alias("a"), F.col("vertices")[1].alias("b"), F.col("in_mask")[0].alias("in_mask"), F.col("out_mask")[0].alias("out_mask"), "is_simplex")


# -- paths ---------------------------------------------------------------------------------------------------------------

#: Euclidean distance of two lists, rounded.
GAP = "round(sqrt(list_sum(list_transform(list_zip({}, {}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6)"
PATHS = """sp(src, v, d) USING KEY (src, v) AS (SELECT v, v, {'dist': CAST(0 AS DOUBLE), 'hops': 0} FROM Q
 UNION (SELECT n.src, n.v, n.d FROM (SELECT sp.src AS src, S.t AS v, min({'dist': sp.d.dist + S.w, 'hops': sp.d.hops + 1}) AS d FROM sp JOIN S ON sp.v = S.s GROUP BY 1, 2) n
 LEFT JOIN recurring.sp r ON r.src = n.src AND r.v = n.v WHERE r.d IS NULL OR n.d < r.d))"""


def _paths(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "dist", F.col("hops").cast("bigint").alias("hops"))


@query(f"WITH RECURSIVE {FIRST}, Q AS (SELECT min(a) AS v FROM P), {PATHS} SELECT src, v AS dst, d.dist AS dist, CAST(d.hops AS BIGINT) AS hops FROM sp")
def sssp(spark, sf_dir):
    arcs = paths.arcs_of(first_graph(spark, sf_dir))
    return _paths(paths.shortest_paths(arcs, arcs.agg(F.min("src").alias("src"))))


@query(f"WITH RECURSIVE {FIRST}, Q AS (SELECT v FROM N), {PATHS} SELECT src, v AS dst, d.dist AS dist, CAST(d.hops AS BIGINT) AS hops FROM sp")
def all_pairs(spark, sf_dir):
    arcs = paths.arcs_of(first_graph(spark, sf_dir))
    return _paths(paths.all_pairs(arcs, suppliers(spark, sf_dir).select(F.col("id").alias("src"))))


@query("SELECT CAST(r * 6 + c AS BIGINT) AS dst, CAST(r + c AS DOUBLE) AS dist, CAST(r + c AS BIGINT) AS hops FROM (SELECT unnest(range(5)) AS r), (SELECT unnest(range(6)) AS c)")
def grid_sssp(spark, sf_dir):
    g, index, _ = builders.grid(spark, 5, 6)
    start = spark.createDataFrame([(index(0, 0),)], "src bigint")
    return _paths(paths.shortest_paths(paths.arcs_of(g), start)).drop("src")


def _pairs(spark, sf_dir):
    ids = suppliers(spark, sf_dir)
    n = ids.count()
    return n, ids.select(F.col("id").alias("i"), F.pmod(F.col("id") * 7 + 3, F.lit(n)).alias("j"))


GOALS = "A AS (SELECT v AS i, (v * 7 + 3) % (SELECT count(*) FROM N) AS j FROM N), L AS (SELECT A.i, A.j, sp.d.dist AS dist FROM A LEFT JOIN sp ON sp.src = A.i AND sp.v = A.j)"


@query(f"WITH RECURSIVE {FIRST}, Q AS (SELECT v FROM N), {PATHS}, {GOALS} SELECT L.i AS i, L.j AS j, L.dist AS dist, CAST(sum(CASE WHEN L.i <> L.j AND (L.dist IS NULL OR sp.d.dist < L.dist OR (sp.d.dist = L.dist AND sp.v < L.j)) THEN 1 ELSE 0 END) AS BIGINT) AS iters FROM L JOIN sp ON sp.src = L.i GROUP BY L.i, L.j, L.dist")
def astar_pairs(spark, sf_dir):
    n, pairs = _pairs(spark, sf_dir)
    return paths.astar_pairs(paths.arcs_of(first_graph(spark, sf_dir)), n, pairs).withColumn("iters", F.col("iters").cast("bigint"))


#: Embeddings as points: arcs from each to twenty others, a little longer than the straight way, and goals for every twentieth.
POINTS = f"""C AS (SELECT count(*) AS n FROM embeddings), V AS (SELECT vec_id AS v, embedding::DOUBLE[] AS x FROM embeddings),
 B AS (SELECT DISTINCT v AS s, (7 * v + 13 * q) % n AS t FROM V, C, (SELECT unnest(range(20)) AS q)), S AS (SELECT s, t, {GAP.format("a.x", "b.x")} * (9 + s % 3) / 8 AS w FROM B JOIN V a ON a.v = s JOIN V b ON b.v = t WHERE s <> t),
 A AS (SELECT v AS i, (v * 7 + 3) % n AS j FROM V, C WHERE v % 20 = 0), Q AS (SELECT i AS v FROM A)"""
#: Distances, and with them the estimate to the goal; a vertex comes before the goal by (distance plus estimate, distance, number).
SEARCHED = f"""L AS (SELECT A.i, A.j, sp.d.dist AS dist FROM A LEFT JOIN sp ON sp.src = A.i AND sp.v = A.j),
 R AS (SELECT L.i, L.j, L.dist, sp.v, sp.d.dist AS g, CASE WHEN sp.v = L.i THEN 0 ELSE sp.d.dist + {GAP.format("a.x", "b.x")} END AS f FROM L JOIN sp ON sp.src = L.i JOIN V a ON a.v = sp.v JOIN V b ON b.v = L.j),
 K AS (SELECT i, j, any_value(dist) AS dist, count(*) FILTER (v <> j AND (dist IS NULL OR f < dist OR (f = dist AND (g < dist OR (g = dist AND v < j))))) AS guided,
 count(*) FILTER (v <> j AND (dist IS NULL OR g < dist OR (g = dist AND v < j))) AS plain FROM R GROUP BY i, j)"""


def _points(spark, sf_dir):
    """Arcs, number of vertices, pairs, and the points for the estimate."""
    f = features(spark, sf_dir)
    n = f.count()
    ends = embedding_matrices(spark, sf_dir).select(F.col("j").alias("i"), F.col("i").alias("j")).filter("i <> j").distinct()
    arcs = paths.pair_distance(ends, f).select(F.col("i").alias("src"), F.col("j").alias("dst"), (F.round("gap", 6) * (9 + F.col("i") % 3) / 8).alias("w"))
    pairs = f.filter("node % 20 = 0").select(F.col("node").alias("i"), F.pmod(F.col("node") * 7 + 3, F.lit(n)).alias("j"))
    return written(arcs, "arcs"), n, pairs, f.select(F.col("node").alias("v"), F.col("features").alias("data"))


@query(f"WITH RECURSIVE {POINTS}, {PATHS}, {SEARCHED} SELECT i, j, round(dist, 6) AS dist, CAST(guided AS BIGINT) AS iters FROM K")
def astar_guided(spark, sf_dir):
    """A search led by the straight distance to the goal."""
    arcs, n, pairs, points = _points(spark, sf_dir)
    straight = paths.point_heuristic(digits=6)
    found = paths.astar_pairs(arcs, n, pairs, straight, points, verify=True)
    return found.select("i", "j", F.round("dist", 6).alias("dist"), F.col("iters").cast("bigint").alias("iters"))


@query(f"WITH RECURSIVE {POINTS}, {PATHS}, {SEARCHED} SELECT count(*) AS correct, CAST(sum(CASE WHEN guided < plain THEN 1 ELSE 0 END) AS BIGINT) AS better, CAST(sum(CASE WHEN guided = plain THEN 1 ELSE 0 END) AS BIGINT) AS equal FROM K")
def astar_ranking(spark, sf_dir):
    """Of a search led by straight distances and one without an estimate."""
    arcs, n, pairs, points = _points(spark, sf_dir)
    straight = paths.point_heuristic(digits=6)
    return paths.ranking(paths.astar_pairs(arcs, n, pairs, straight, points), paths.astar_pairs(arcs, n, pairs))


@query("SELECT CAST(3 * k AS BIGINT) AS i, CAST(23 - 4 * k AS BIGINT) AS j, CAST(abs((23 - 4 * k) // 6 - 3 * k // 6) + abs((23 - 4 * k) % 6 - 3 * k % 6) AS DOUBLE) AS dist FROM (SELECT unnest(range(6)) AS k)")
def astar_grid(spark, sf_dir):
    """A heuristic that is never wrong by more than a detour: the city-block distance of grid points."""
    g, index, back = builders.grid(spark, 4, 6)
    points = spark.range(24).select(F.col("id").alias("v"), F.array(F.floor(F.col("id") / 6).cast("double"), (F.col("id") % 6).cast("double")).alias("data"))
    pairs = spark.range(6).select((3 * F.col("id")).alias("i"), (23 - 4 * F.col("id")).alias("j"))
    blocks = lambda v, goal, x, y: F.abs(x[0] - y[0]) + F.abs(x[1] - y[1])
    return paths.astar_pairs(paths.arcs_of(g), 24, pairs, blocks, points, verify=True).select("i", "j", "dist")


@query("SELECT a.vec_id AS i, b.vec_id AS j, round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS gap FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 3 + 1) % (SELECT count(*) FROM embeddings)")
def pair_distance(spark, sf_dir):
    f = features(spark, sf_dir)
    n = f.count()
    pairs = f.select(F.col("node").alias("i"), F.pmod(F.col("node") * 3 + 1, F.lit(n)).alias("j"))
    return paths.pair_distance(pairs, f).select("i", "j", F.round("gap", 6).alias("gap"))


# -- layers --------------------------------------------------------------------------------------------------------------


@query(f"WITH {MESSAGES} SELECT CAST(k AS BIGINT) AS k, node, CAST(c AS BIGINT) AS c, round(x, 6) + 0.0 AS x FROM M")
def sparse_message_pass(spark, sf_dir):
    return entries(layers.sparse_vertex_agg(embedding_matrices(spark, sf_dir), features(spark, sf_dir), 64), "k", "node")


@query(f"WITH {MESSAGES}, T AS (SELECT node, c, greatest(sum(x), 0) AS x FROM M GROUP BY node, c) SELECT V.j AS node, CAST(V.c AS BIGINT) AS c, round(greatest((V.x + coalesce(T.x, 0)) / 2, 0), 6) + 0.0 AS x FROM V LEFT JOIN T ON T.node = V.j AND T.c = V.c")
def default_layer(spark, sf_dir):
    return entries(layers.MultiGraphLayer()(features(spark, sf_dir), embedding_matrices(spark, sf_dir)), "node")


@query(f"WITH {MESSAGES}, H AS (SELECT node, c, CAST((k + 1) AS DOUBLE) / (1 + node % 3) * x AS x0, x FROM M), W AS (SELECT node, c, sum(x0) AS x FROM H GROUP BY node, c) SELECT node, CAST(c AS BIGINT) AS c, round(greatest(x, 0), 6) + 0.0 AS x FROM W")
def weighted_aggregate(spark, sf_dir):
    f = features(spark, sf_dir)
    weights = f.select("node", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select("k", "node", F.array_repeat((F.col("k") + 1.0) / (1 + F.col("node") % 3), 64).alias("weight"))
    return entries(layers.weighted_graph_agg(layers.sparse_vertex_agg(embedding_matrices(spark, sf_dir), f, 64), weights, 64), "node")


def _head(spark, sf_dir, activation=None):
    f = features(spark, sf_dir)
    summed = layers.vector_sum(layers.sparse_vertex_agg(embedding_matrices(spark, sf_dir), f, 64), ["node"], "features", 64)
    return layers.linear_update(f, summed, HEAD, HEAD, activation=activation)


BOTH = "H AS (SELECT j AS node, c, x FROM V UNION ALL SELECT node, c, x FROM M)"


@query(f"WITH {MESSAGES}, {BOTH}, {LINEAR} SELECT node, CAST(o AS BIGINT) AS c, round(greatest(y, 0), 6) + 0.0 AS x FROM L")
def linear_update(spark, sf_dir):
    return entries(_head(spark, sf_dir, layers.relu), "node")


@query(f"WITH {MESSAGES}, H AS (SELECT node, c, x FROM M), {LINEAR} SELECT node, CAST(o AS BIGINT) AS c, round(greatest(y, 0), 6) + 0.0 AS x FROM L")
def linear_aggregate(spark, sf_dir):
    return entries(layers.linear_graph_agg(layers.sparse_vertex_agg(embedding_matrices(spark, sf_dir), features(spark, sf_dir), 64), [HEAD, HEAD]), "node")


@query(f"WITH {MESSAGES}, {BOTH}, {LINEAR}, Z AS (SELECT node, o, y, max(y) OVER (PARTITION BY node) AS top FROM L), U AS (SELECT node, o, y - top - ln(sum(exp(y - top)) OVER (PARTITION BY node)) AS z, y = top AS best FROM Z) SELECT node, CAST(min(CASE WHEN best THEN o END) AS BIGINT) AS label, round(max(z), 6) + 0.0 AS top, round(sum(z), 5) + 0.0 AS total FROM U GROUP BY node")
def logsoftmax_argmax(spark, sf_dir):
    z = _head(spark, sf_dir).select("node", log_softmax(F.col("features")).alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, v: s + v)
    return z.select("node", arg_max(F.col("z")).cast("bigint").alias("label"), (F.round(F.array_max("z"), 6) + 0.0).alias("top"), (F.round(total, 5) + 0.0).alias("total"))


@query("WITH V AS (SELECT vec_id AS node, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings) SELECT node, CAST(o AS BIGINT) AS c, round(sum(x * ((c * 7 + o * 3) % 5 - 2) / 10), 6) + 0.0 AS x FROM V, (SELECT unnest(range(4)) AS o) GROUP BY node, o")
def linear_head(spark, sf_dir):
    return entries(features(spark, sf_dir).select("node", linear(F.col("features"), HEAD).alias("features")), "node")


@query(f"WITH {FIRST} SELECT t AS i, s AS j, CAST((1 + t % 2) * (3 + s % 2) AS DOUBLE) AS value FROM S")
def adjacency_scale(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    places = lookup.within(g, [0])
    diagonal = lambda v: places.select(F.lit(0).alias("k"), F.col("pos").alias("i"), F.col("pos").alias("j"), v.alias("value"))
    return _coo(layers.adjacency_scale(matrices.adjacency_matrices(g, [1], [], [0]), diagonal(1.0 + F.col("pos") % 2), diagonal(3.0 + F.col("pos") % 2)), "i", "j")


# -- statistics ----------------------------------------------------------------------------------------------------------

SQL_STATS = ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(stddev_pop({c}), 4) AS {c}_std, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS {c}_iqr, round(min({c}), 4) AS {c}_min, round(max({c}), 4) AS {c}_max" for c in ("absolute", "relative"))


@query(f"WITH E AS (SELECT abs(l_extendedprice * (1 - l_discount * 1.5) - l_extendedprice) AS absolute, abs(l_extendedprice * (1 - l_discount * 1.5) - l_extendedprice) / nullif(abs(l_extendedprice), 0) * 100 AS relative FROM lineitem) SELECT {SQL_STATS}, round(avg(CASE WHEN relative < 10 THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM E WHERE relative IS NOT NULL")
def error_stats(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("truth"), (F.col("l_extendedprice") * (1 - F.col("l_discount") * 1.5)).alias("guess"))
    out = stats.error_stats(df, "truth", "guess")
    return out.select(*(F.round(c, 4).alias(c) for c in out.columns))


@query("SELECT round(avg(o_totalprice), 4) AS mean, quantile_disc(o_totalprice, 0.5) AS median, round(stddev_samp(o_totalprice), 4) AS std FROM orders")
def run_summary(spark, sf_dir):
    return stats.run_summary(table(spark, sf_dir, "orders"), "o_totalprice").select(F.round("mean", 4).alias("mean"), "median", F.round("std", 4).alias("std"))


@query("SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def price_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000)


@query("SELECT event_type, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events GROUP BY event_type")
def value_quartiles(spark, sf_dir):
    return stats.box(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", "low", *(F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")), "high")


@query()
def random_plane(spark, sf_dir):
    g, _ = builders.plane(spark, 60, 150, seed=3)
    return g.nodes.filter("dim = 1").select(key_of("vertices").alias("face"), "data")


# -- changes, lookups and relations beyond the basics ------------------------------------------------------------------------

TRIPLES = "T AS (SELECT [v, v + 1, v + 2] AS f, CAST(v AS DOUBLE) AS data FROM N WHERE v + 2 <= (SELECT max(v) FROM N)), E AS (SELECT DISTINCT unnest([[f[1], f[2]], [f[1], f[3]], [f[2], f[3]]]) AS f FROM T)"


@query(f"WITH {FIRST}, {TRIPLES} SELECT array_to_string(f, '-') AS face, data, true AS is_simplex FROM (SELECT [v] AS f, CAST(NULL AS DOUBLE) AS data FROM N UNION ALL SELECT coalesce(p.f, E.f), p.w FROM (SELECT [a, b] AS f, w FROM P) p FULL JOIN E ON p.f = E.f UNION ALL SELECT f, data FROM T)")
def put_simplices(spark, sf_dir):
    ids = suppliers(spark, sf_dir).select("id")
    top = ids.agg(F.max("id")).first()[0]
    rows = ids.filter(F.col("id") + 2 <= top).select(F.array("id", F.col("id") + 1, F.col("id") + 2).alias("vertices"), F.col("id").cast("double").alias("data"), F.lit(0).alias("seq"))
    return mutate.put_simplices(first_graph(spark, sf_dir), rows).nodes.select(key_of("vertices").alias("face"), "data", "is_simplex")


@query(f"WITH {FIRST} SELECT a || '-' || b || '-' || (b + 1) AS face, CAST(1 AS BIGINT) AS in_mask, CAST(CASE WHEN a % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS out_mask, false AS is_simplex FROM P WHERE b + 1 <= (SELECT max(v) FROM N)")
def put_relations(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    top = suppliers(spark, sf_dir).agg(F.max("id")).first()[0]
    a, b = F.get("vertices", 0), F.get("vertices", 1)
    rows = g.nodes.filter((F.col("dim") == 1) & (b + 1 <= top)).select(F.col("vertices").alias("lower"), F.array(a, b, b + 1).alias("upper"), F.lit(True).alias("is_in"), (a % 2 == 0).alias("is_out"))
    return mutate.put_relations(g, rows).nodes.filter("dim = 2").select(key_of("vertices").alias("face"), F.col("in_mask")[0].alias("in_mask"), F.col("out_mask")[0].alias("out_mask"), "is_simplex")


LEAST = "M AS (SELECT a, b FROM P ORDER BY a, b LIMIT 1)"


def _least_edge(spark, sf_dir):
    row = undirected_edges(spark, sf_dir).orderBy("a", "b").first()
    return row["a"], row["b"]


@query(f"WITH {FIRST}, {LEAST} SELECT s AS src, t AS dst FROM S, M WHERE NOT (least(s, t) = M.a AND greatest(s, t) = M.b)")
def remove_relation(spark, sf_dir):
    a, b = _least_edge(spark, sf_dir)
    h = mutate.remove_relation(first_graph(spark, sf_dir), (a,), (a, b))
    return relations.neighbor_relations(h, 1, lookup.within(h, [0])).select("src", "dst")


@query(f"WITH {FIRST}, {LEAST} SELECT s AS src, t AS dst FROM S, M WHERE NOT (s = M.a AND t = M.b)")
def remove_relation_upwards(spark, sf_dir):
    a, b = _least_edge(spark, sf_dir)
    h = mutate.remove_relation(first_graph(spark, sf_dir), (a,), (a, b), dir_in=True)
    return relations.neighbor_relations(h, 1, lookup.within(h, [0])).select("src", "dst")


@query(f"WITH {FIRST} SELECT CAST(0 AS BIGINT) AS k, t - CASE WHEN t > 3 THEN 1 ELSE 0 END AS i, s - CASE WHEN s > 3 THEN 1 ELSE 0 END AS j, CAST(1 AS DOUBLE) AS value FROM S WHERE s <> 3 AND t <> 3")
def matrix_after_removal(spark, sf_dir):
    h = mutate.remove_nodes(first_graph(spark, sf_dir), spark.createDataFrame([([3],)], "vertices array<bigint>"), with_cofaces=True)
    return _coo(matrices.adjacency_matrices(h, [1], [], [0]), "k", "i", "j")


@query(f"WITH {FIRST} SELECT v AS nid, CAST(2 * v AS DOUBLE) AS data FROM N")
def set_item(spark, sf_dir):
    rows = suppliers(spark, sf_dir).select(F.array("id").alias("vertices"), (2.0 * F.col("id")).alias("data"), F.lit(0).alias("seq"))
    return mutate.set_item(first_graph(spark, sf_dir), rows).nodes.filter("dim = 0").select("nid", "data")


@query(f"WITH {FIRST}, H AS (SELECT v AS dst, v AS seq, CAST(v AS DOUBLE) AS x FROM N UNION ALL SELECT t, s, CAST(s AS DOUBLE) FROM S) SELECT dst AS nid, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), list(x ORDER BY seq)), lambda old, x: old * 0.5 + x), 6) AS data FROM H GROUP BY dst")
def propagate_update(spark, sf_dir):
    updates = suppliers(spark, sf_dir).select(F.array("id").alias("vertices"), F.col("id").cast("double").alias("data"), F.col("id").alias("seq"))
    g = mutate.propagate_data(first_graph(spark, sf_dir), updates, [0, 1], [], update=lambda old, x: F.coalesce(old, F.lit(0.0)) * 0.5 + x)
    return g.nodes.filter("dim = 0").select("nid", F.round("data", 6).alias("data"))


@query(f"WITH {FACES} SELECT a.f[1] AS nid, CAST(sum(b.data) AS BIGINT) AS data FROM F a LEFT JOIN F b ON len(b.f) = 2 AND list_contains(b.f, a.f[1]) WHERE len(a.f) = 1 GROUP BY a.f[1]")
def generalize_stored(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    return mutate.generalized(g, [], [1], F.sum("data").cast("bigint"), lookup.within(g, [0])).nodes.filter("dim = 0").select(F.col("vertices")[0].alias("nid"), F.col("data").cast("bigint").alias("data"))


@query(f"WITH {FIRST}, {LEAST} SELECT t AS v FROM S, M WHERE s = M.a")
def neighbors_of_one(spark, sf_dir):
    a, _ = _least_edge(spark, sf_dir)
    return relations.neighbors(first_graph(spark, sf_dir), a).select(F.col("vertices")[0].alias("v"))


@query(f"WITH {FACES} SELECT array_to_string(f, '-') AS face FROM F WHERE len(f) = 3 AND list_contains(f, 3)")
def incidence_of_one(spark, sf_dir):
    return relations.incidence_neighbors(complex_graph(spark, sf_dir), 3, 2).select(key_of("vertices").alias("face"))


@query(f"WITH {FIRST} SELECT v AS src, CAST(sum(count(t)) OVER (ORDER BY v) - count(t) AS BIGINT) AS \"offset\", coalesce(string_agg(CAST(t AS VARCHAR), ' ' ORDER BY t), '') AS targets FROM N LEFT JOIN S ON s = v GROUP BY v")
def adjacency_lists(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    return relations.adjacency_lists(g, 1, sources=lookup.within(g, [0])).select("src", F.col("offset").cast("bigint").alias("offset"), F.array_join(F.col("targets").cast("array<string>"), " ").alias("targets"))


@query(f"WITH {FACES}, A AS (SELECT f FROM F WHERE len(f) = 2), U AS (SELECT a.f AS f, u.f AS u FROM A a JOIN F u ON len(u.f) = 3 AND list_has_all(u.f, a.f)) SELECT array_to_string(A.f, '-') AS face, kind, CAST(k AS BIGINT) AS k, CAST(n AS DOUBLE) AS degree FROM (SELECT A.f AS f, 'i' AS kind, 1 AS k, count(U.u) AS n FROM A LEFT JOIN U ON U.f = A.f GROUP BY A.f UNION ALL SELECT f, 'i', -1, 2 FROM A UNION ALL SELECT A.f, 'n', 1, count(DISTINCT b.f) FROM A LEFT JOIN U ON U.f = A.f LEFT JOIN U b ON b.u = U.u AND b.f <> A.f GROUP BY A.f) A")
def degree_lists_by_dimension(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    edges = g.nodes.filter("dim = 1")
    found = degrees.degree_lists(g, [1], [1, -1], edges).join(edges.select("nid", key_of("vertices").alias("face")), "nid")
    return found.select("face", "kind", F.col("k").cast("bigint").alias("k"), F.col("degree").cast("double").alias("degree"))


PLACES = "L AS (SELECT f, row_number() OVER (ORDER BY len(f), f) - 1 AS pos FROM F WHERE len(f) <= 2)"


@query(f"WITH {FACES}, {PLACES} SELECT CAST(CASE WHEN len(b.f) > len(a.f) THEN 0 ELSE 1 END AS BIGINT) AS k, b.pos AS i, a.pos AS j, CAST(1 AS DOUBLE) AS value FROM L a JOIN L b ON abs(len(a.f) - len(b.f)) = 1 AND (list_has_all(b.f, a.f) OR list_has_all(a.f, b.f))")
def incidence_matrices(spark, sf_dir):
    return _coo(matrices.adjacency_matrices(complex_graph(spark, sf_dir), [], [1, -1], [0, 1]), "k", "i", "j")


@query(f"WITH {FACES} SELECT array_to_string(a.f, '-') AS src, array_to_string(b.f, '-') AS dst FROM F a JOIN F b ON len(a.f) = 1 AND len(b.f) = 2 AND NOT list_contains(b.f, a.f[1])")
def non_incidence(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    return relations.non_adjacency(g, 1, lookup.within(g, [0]), label=key_of("vertices"))


@query(f"WITH RECURSIVE {FIRST}, {near(2)} SELECT dst AS i, src AS j, CAST(count(*) AS DOUBLE) AS value FROM D WHERE dst >= 4 AND dst < 12 GROUP BY dst, src")
def partial_matrix(spark, sf_dir):
    return _coo(matrices.tile(matrices.adjacency_matrix(first_graph(spark, sf_dir), [0, 1, 2], [], [0]), 4, 8), "i", "j")


@query(f"WITH RECURSIVE {FIRST}, {near(2)} SELECT CAST(CASE dist WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS BIGINT) AS k, dst AS i, src AS j, CAST(1 AS DOUBLE) AS value FROM D")
def concat_tiles(spark, sf_dir):
    g = first_graph(spark, sf_dir)
    n = lookup.size(g, 0)
    one, two = written(matrices.adjacency_matrices(g, [1], [], [0]), "tiles"), written(matrices.adjacency_matrices(g, [0, 2], [], [0]), "tiles")
    whole = None
    for part in matrices.concat_tiles((matrices.tiles(one, n, -(-n // 3)), 1), (matrices.tiles(two, n, -(-n // 3)), 2)):
        whole = part if whole is None else whole.union(part)
    return _coo(whole, "k", "i", "j")


def drawn(*columns: str, seed: int = 0) -> str:
    """The number that stats.hash_order() gives, as a DuckDB expression."""
    texts = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns)
    return f"CAST('0x' || substr(md5({texts} || '|{seed}'), 1, 15) AS BIGINT)"


def split_of(*columns: str, seed: int = 0) -> str:
    bucket = f"{drawn(*columns, seed=seed)} % 10"
    return f"CASE WHEN {bucket} < 6 THEN 'train' WHEN {bucket} < 8 THEN 'valid' ELSE 'test' END"


@query(f"WITH {FACES}, I AS (SELECT row_number() OVER (ORDER BY len(f), f) - 1 AS nid, len(f) - 1 AS dim, CAST(data AS DOUBLE) AS truth FROM F), H AS (SELECT *, dim < 3 AND {drawn('nid')} % 1000000 < 300000 AS chosen FROM I) SELECT nid, truth, CASE WHEN chosen THEN 0 ELSE truth END AS value, chosen, CASE WHEN chosen THEN {split_of('nid', seed=1)} END AS part FROM H")
def imputation_split(spark, sf_dir):
    return stats.zeroed(complex_graph(spark, sf_dir).nodes, 3, 0.3)


@query(f"WITH {FIRST} SELECT a.v AS i, b.v AS j, {split_of('a.v', 'b.v')} AS part FROM N a JOIN N b ON a.v < b.v")
def vertex_pairs(spark, sf_dir):
    return stats.vertex_pairs(suppliers(spark, sf_dir), "id").select("i", "j", "part")


@query(f"WITH {FACES} SELECT 'nodes' AS what, CAST(count(*) AS VARCHAR) AS value FROM F UNION ALL SELECT 'edges', CAST(count(*) FILTER (len(f) = 2) AS VARCHAR) FROM F UNION ALL SELECT 'has 3', CAST(count(*) FILTER (f = [3]) > 0 AS VARCHAR) FROM F UNION ALL SELECT 'has 3 and 3000000', 'false' UNION ALL SELECT 'data of 3', CAST(max(data) FILTER (f = [3]) AS VARCHAR) FROM F")
def single_lookups(spark, sf_dir):
    g = complex_graph(spark, sf_dir)
    rows = [("nodes", lookup.size(g)), ("edges", lookup.size(g, 1)), ("has 3", lookup.contains(g, 3)), ("has 3 and 3000000", lookup.contains(g, (3, 3000000))), ("data of 3", lookup.get(g, 3))]
    return spark.createDataFrame([(k, str(v).lower()) for k, v in rows], "what string, value string")


@query(f"WITH {FACES} SELECT '(' || array_to_string(f, ', ') || '): ' || data AS text FROM F")
def shown_nodes(spark, sf_dir):
    return lookup.shown(complex_graph(spark, sf_dir))


# -- more sources, layers, statistics ---------------------------------------------------------------------------------------


def _roads(spark, sf_dir, directed):
    nodes = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 7).alias("osm_id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    arcs = spark.sql(ARCS, lineitem=table(spark, sf_dir, "lineitem")).select((F.col("s") * 10 + 7).alias("u"), (F.col("t") * 10 + 7).alias("v"), F.col("w").alias("length"), (F.col("s") * 1000003 + F.col("t")).alias("order"))
    return paths.arcs_of(builders.road_network(nodes, arcs, directed, "order"))


#: Both directions of a road have the length of the last arc between its ends.
ROADS = "R AS (SELECT least(s, t) AS a, greatest(s, t) AS b, arg_max(w, s * 1000003 + t) AS w FROM S GROUP BY 1, 2)"


@query(f"WITH {THIRD}, {ROADS} SELECT s AS src, t AS dst, R.w AS w FROM S JOIN R ON a = least(s, t) AND b = greatest(s, t)")
def directed_roads(spark, sf_dir):
    return _roads(spark, sf_dir, True)


@query(f"WITH {THIRD}, {ROADS} SELECT a AS src, b AS dst, w FROM R UNION ALL SELECT b, a, w FROM R")
def undirected_roads(spark, sf_dir):
    return _roads(spark, sf_dir, False)


@query(f"""WITH {FACES}, K AS (SELECT id, vs, w + 3 AS c FROM G WHERE w + 3 > 4 AND len(vs) <= 3), U AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS r FROM (SELECT DISTINCT unnest(vs) AS v FROM K)),
 R AS (SELECT id, c, list_sort(list(r)) AS vs FROM (SELECT id, c, unnest(vs) AS v FROM K) JOIN U USING (v) GROUP BY id, c), Y AS (SELECT vs, c, unnest(range(1, CAST(pow(2, len(vs)) AS BIGINT))) AS m FROM R)
 SELECT array_to_string(list_filter(vs, lambda v, i: (m >> CAST(i - 1 AS INTEGER)) & 1 = 1), '-') AS face, CAST(sum(c) AS BIGINT) AS data FROM Y GROUP BY 1""")
def collaborations(spark, sf_dir):
    papers = simplices(spark, sf_dir).select(F.col("vertices").alias("authors"), (F.col("w") + 3).alias("citations"))
    return builders.from_collaborations(papers, 4, 3).nodes.select(key_of("vertices").alias("face"), F.col("data").cast("bigint").alias("data"))


@query(f"WITH {MESSAGES}, T AS (SELECT node, c, greatest(sum(x), 0) AS x FROM M GROUP BY node, c) SELECT V.j AS node, CAST(V.c AS BIGINT) AS c, round(greatest((V.x + coalesce(T.x, 0)) / 2, 0), 6) + 0.0 AS x FROM V LEFT JOIN T ON T.node = V.j AND T.c = V.c")
def layer_by_tiles(spark, sf_dir):
    f, m = features(spark, sf_dir), written(embedding_matrices(spark, sf_dir), "matrices")
    n = f.count()
    rows = -(-n // 3)
    tiles = lambda: ((matrices.tile(m, first, rows), min(rows, n - first)) for first in range(0, n, rows))
    return entries(layers.PartialForward(layers.MultiGraphLayer())(f, tiles, n), "node")


@query("WITH V AS (SELECT vec_id AS j, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS c FROM embeddings), C AS (SELECT count(*) AS n FROM embeddings), A AS (SELECT vec_id AS j, (7 * vec_id + 13 * q) % n AS i, n // 2 AS h FROM embeddings, C, (SELECT unnest(range(20)) AS q)), T AS (SELECT i AS node, c, greatest(sum(x), 0) AS x FROM A JOIN V USING (j) WHERE i < h AND j < h GROUP BY i, c) SELECT V.j AS node, CAST(V.c AS BIGINT) AS c, round(greatest((V.x + coalesce(T.x, 0)) / 2, 0), 6) + 0.0 AS x FROM V JOIN C ON V.j < C.n // 2 LEFT JOIN T ON T.node = V.j AND T.c = V.c")
def hasty_layer(spark, sf_dir):
    f = features(spark, sf_dir)
    half = f.count() // 2
    rows = f.filter(F.col("node") < half).select("node")
    return entries(layers.MultiGraphLayer().hasty(f, matrices.tile(embedding_matrices(spark, sf_dir), 0, half), rows), "node")


@query("SELECT round(avg(CASE WHEN l_linenumber = l_suppkey % 7 + 1 THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM lineitem")
def accuracy(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_linenumber", (F.col("l_suppkey") % 7 + 1).alias("guess"))
    return stats.accuracy(df, "guess", "l_linenumber").select(F.round("accuracy", 9).alias("accuracy"))


@query("SELECT CAST(l_linenumber AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1")
def error_lines(spark, sf_dir):
    path = f"{folder(spark)}/facetflow/lines-{uuid.uuid4().hex}"
    stats.write_errors(table(spark, sf_dir, "lineitem"), "l_linenumber", path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders GROUP BY 1")
def priority_shares(spark, sf_dir):
    return stats.shares(table(spark, sf_dir, "orders"), "o_orderpriority").select("value", "n", F.round("share", 9).alias("share"))


@query("SELECT CAST(l_linenumber AS BIGINT) AS step, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_pop(l_quantity), 6) AS l_quantity_std, round(avg(l_tax), 6) AS l_tax_mean, round(stddev_pop(l_tax), 6) AS l_tax_std FROM lineitem GROUP BY 1")
def value_curve(spark, sf_dir):
    out = stats.curve(table(spark, sf_dir, "lineitem"), "l_linenumber", "l_quantity", "l_tax")
    return out.select(F.col("step").cast("bigint").alias("step"), *(F.round(c, 6).alias(c) for c in out.columns[1:]))


# -- aggregation that is no sum, and functions of lists --------------------------------------------------------------------


@query(f"WITH {MESSAGES} SELECT CAST(k AS BIGINT) AS k, i AS node, CAST(c AS BIGINT) AS c, round(max(x), 6) + 0.0 AS x FROM A JOIN V USING (j) GROUP BY k, i, c")
def max_messages(spark, sf_dir):
    """The largest entry among a node's neighbours, matrix by matrix."""
    return entries(layers.max_vertex_agg(embedding_matrices(spark, sf_dir), features(spark, sf_dir), 64), "k", "node")


@query(f"WITH {MESSAGES}, Z AS (SELECT k, i, c, x, (q % 7) / 2.0 AS s, max((q % 7) / 2.0) OVER (PARTITION BY k, i, c) AS top FROM A JOIN V USING (j)) SELECT CAST(k AS BIGINT) AS k, i AS node, CAST(c AS BIGINT) AS c, round(sum(exp(s - top) * x) / sum(exp(s - top)), 6) + 0.0 AS x FROM Z GROUP BY k, i, c")
def softmax_messages(spark, sf_dir):
    """Neighbours weighted by the softmax of a score on each arc."""
    nodes = features(spark, sf_dir).select("node")
    n = nodes.count()
    arcs = nodes.select(F.col("node").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("q"))
    scored = arcs.select((F.col("q") % 2).alias("k"), F.pmod(7 * F.col("j") + 13 * F.col("q"), F.lit(n)).alias("i"), "j", ((F.col("q") % 7) / 2.0).alias("value"))
    return entries(layers.softmax_vertex_agg(scored, features(spark, sf_dir), 64), "k", "node")


HEADED = "Y AS (SELECT k, node, o, sum(x * ((c * 7 + o * 3) % 5 - 2) / 10) AS y FROM M, (SELECT unnest(range(4)) AS o) GROUP BY k, node, o), U AS (SELECT node, o, max(CASE WHEN k = 0 THEN y END) AS a, max(CASE WHEN k = 1 THEN y END) AS b FROM Y GROUP BY node, o), E AS (SELECT node, o, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM U)"


def _headed(spark, sf_dir, agg_func):
    messages = layers.sparse_vertex_agg(embedding_matrices(spark, sf_dir), features(spark, sf_dir), 64)
    return entries(layers.linear_graph_agg(messages, [HEAD, HEAD], activation=None, agg_func=agg_func), "node")


@query(f"WITH {MESSAGES}, {HEADED} SELECT node, CAST(o AS BIGINT) AS c, round(greatest(a, b), 6) + 0.0 AS x FROM E")
def linear_aggregate_max(spark, sf_dir):
    return _headed(spark, sf_dir, layers.largest)


@query(f"WITH {MESSAGES}, {HEADED} SELECT node, CAST(o AS BIGINT) AS c, round((exp(a - greatest(a, b)) * a + exp(b - greatest(a, b)) * b) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) + 0.0 AS x FROM E")
def linear_aggregate_softmax(spark, sf_dir):
    return _headed(spark, sf_dir, layers.softmax_weighted)


@query(f"WITH {FACES} SELECT a.f[1] AS nid, round(quantile_cont(b.data, 0.5), 6) AS data FROM F a LEFT JOIN F b ON len(b.f) = 2 AND list_contains(b.f, a.f[1]) WHERE len(a.f) = 1 GROUP BY a.f[1]")
def neighbor_median(spark, sf_dir):
    """A function of the whole list of related data, here the median."""
    median = lambda x: float(np.median(x)) if x else None
    g = complex_graph(spark, sf_dir)
    return mutate.gathered(g, [], [1], median, "double", lookup.within(g, [0])).select("nid", F.round("data", 6).alias("data"))


# -- changes at the cost of the change ---------------------------------------------------------------------------------------


@query(f"WITH {FIRST}, {TRIPLES}, {LEAST} SELECT array_to_string(f, '-') AS face, data, NOT (f = [M.a, M.b] OR list_has_all(f, [M.a, M.b])) AS is_simplex FROM (SELECT [v] AS f, CAST(NULL AS DOUBLE) AS data FROM N UNION ALL SELECT coalesce(p.f, E.f), p.w FROM (SELECT [a, b] AS f, w FROM P) p FULL JOIN E ON p.f = E.f UNION ALL SELECT f, data FROM T), M")
def appended_changes(spark, sf_dir):
    """Triples put in two batches on top of a graph, then one direction of a link dropped."""
    ids = suppliers(spark, sf_dir).select("id")
    top = ids.agg(F.max("id")).first()[0]
    rows = ids.filter(F.col("id") + 2 <= top).select(F.array("id", F.col("id") + 1, F.col("id") + 2).alias("vertices"), F.col("id").cast("double").alias("data"), F.lit(0).alias("seq"))
    g = first_graph(spark, sf_dir)
    for half in (0, 1):
        g = changes.append_simplices(g, rows.filter(F.col("vertices")[0] % 2 == half))
    a, b = _least_edge(spark, sf_dir)
    link = spark.createDataFrame([([a], [a, b], True, False)], "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean")
    return changes.drop_relations(g, link).nodes.select(key_of("vertices").alias("face"), "data", "is_simplex")


# -- streams -------------------------------------------------------------------------------------------------------------


@query(f"WITH {FACES}, O AS (SELECT vs, arg_max(w, id) AS w FROM G GROUP BY vs) SELECT array_to_string(F.f, '-') AS face, CAST(O.w AS BIGINT) AS data, true AS is_simplex FROM F LEFT JOIN O ON O.vs = F.f UNION ALL SELECT CAST(v AS VARCHAR), NULL, false FROM (SELECT unnest(range((SELECT max(f[1]) FROM F WHERE len(f) = 1))) AS v) WHERE [v] NOT IN (SELECT f FROM F WHERE len(f) = 1)")
def streamed_simplices(spark, sf_dir):
    """Simplices put by a stream in batches, the latest rows first; the last one by order number gives a node's data."""
    source = f"{folder(spark)}/facetflow/stream-{uuid.uuid4().hex}"
    rows = simplices(spark, sf_dir).select("vertices", F.col("w").alias("data"), F.col("l_orderkey").cast("bigint").alias("seq"))
    rows.withColumn("deal", F.pmod(F.col("seq"), F.lit(3))).repartition(3, "deal").drop("deal").write.parquet(f"{source}/rows")
    stream = spark.readStream.schema("vertices array<bigint>, data bigint, seq bigint").option("maxFilesPerTrigger", 1).option("latestFirst", True).parquet(f"{source}/rows")
    ingest.stream_graph(f"{source}/nodes", f"{source}/state", stream).awaitTermination()
    return ingest.streamed_graph(spark, f"{source}/nodes").nodes.select(key_of("vertices").alias("face"), F.col("data").cast("bigint").alias("data"), "is_simplex")


# -- training through layers ------------------------------------------------------------------------------------------------

NETWORK = [network.Layer(4), network.Layer(4, output=3)]


def formula(salt: int, rows: int, columns: int):
    """Weights by formula: entry (d, o) is ((7 d + 3 o + salt) mod 11 - 5) / 20."""
    return (((np.arange(rows)[:, None] * 7 + np.arange(columns) * 3 + salt) % 11) - 5) / 20


def formula_weights() -> dict:
    shapes = {"0.own": (1, 64, 4), "0.message": (2, 64, 4), "1.own": (3, 4, 4), "1.message": (4, 4, 4), "1.output": (5, 4, 3)}
    maps = {n: formula(*shape) for n, shape in shapes.items()}
    return maps | {f"{n}.bias": formula(salt, 1, columns)[0] for n, (salt, _, columns) in shapes.items()}


def _labels(spark, sf_dir):
    """A class by the vertex, and the parts of training by its number."""
    part = F.when(F.col("node") % 5 < 3, "train").when(F.col("node") % 5 == 3, "valid").otherwise("test")
    return features(spark, sf_dir).select("node", (F.col("node") % 7 % 3).cast("int").alias("label"), part.alias("part"))


def _times(source: str, salt: int, columns: int) -> str:
    """Rows (node, c, x) times a formula matrix, and its bias."""
    return f"SELECT node, o, sum(x * ((c * 7 + o * 3 + {salt}) % 11 - 5)) / 20 + any_value((o * 3 + {salt}) % 11 - 5) / 20.0 AS y FROM {source}, (SELECT unnest(range({columns})) AS o) GROUP BY node, o"


def _back(source: str, salt: int, rows: int) -> str:
    """Slopes (node, o, g) times a formula matrix turned over."""
    return f"SELECT node, c, sum(g * ((c * 7 + o * 3 + {salt}) % 11 - 5)) / 20 AS g FROM {source}, (SELECT unnest(range({rows})) AS c) GROUP BY node, c"


def _weights(name: str, source: str, slopes: str) -> str:
    return f"SELECT '{name}' AS name, c, o, sum(x * g) AS g FROM {source} JOIN {slopes} USING (node) GROUP BY c, o UNION ALL SELECT '{name}.bias', 0, o, sum(g) FROM {slopes} GROUP BY o"


GRADIENTS = f"""WITH {MESSAGES}, X0 AS (SELECT j AS node, c, x FROM V), S1 AS (SELECT v.node AS node, v.c AS c, greatest(coalesce(sum(M.x), 0), 0) AS x FROM X0 v LEFT JOIN M ON M.node = v.node AND M.c = v.c GROUP BY v.node, v.c),
 Z1 AS (SELECT node, o AS c, a.y + b.y AS z FROM ({_times("X0", 1, 4)}) a JOIN ({_times("S1", 2, 4)}) b USING (node, o)), X1 AS (SELECT node, c, greatest(z, 0) AS x FROM Z1),
 M2 AS (SELECT v.node AS node, v.c AS c, coalesce(sum(u.x), 0) AS z FROM X1 v LEFT JOIN A ON A.i = v.node LEFT JOIN X1 u ON u.node = A.j AND u.c = v.c GROUP BY v.node, v.c), S2 AS (SELECT node, c, greatest(z, 0) AS x FROM M2),
 Z2 AS (SELECT node, o AS c, a.y + b.y AS z FROM ({_times("X1", 3, 4)}) a JOIN ({_times("S2", 4, 4)}) b USING (node, o)), X2 AS (SELECT node, c, greatest(z, 0) AS x FROM Z2),
 O AS (SELECT node, o, y, max(y) OVER (PARTITION BY node) AS top FROM ({_times("X2", 5, 3)})), K AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 5 < 3),
 P AS (SELECT node, o, exp(y - top) / sum(exp(y - top)) OVER (PARTITION BY node) AS p FROM O),
 GO AS (SELECT node, o, CASE WHEN node % 5 < 3 THEN (p - CASE WHEN o = node % 7 % 3 THEN 1 ELSE 0 END) / n ELSE 0 END AS g FROM P, K),
 G2 AS (SELECT node, c AS o, CASE WHEN z > 0 THEN g ELSE 0 END AS g FROM ({_back("GO", 5, 4)}) JOIN Z2 USING (node, c)),
 T2 AS (SELECT node, c, CASE WHEN z > 0 THEN g ELSE 0 END AS g FROM ({_back("G2", 4, 4)}) JOIN M2 USING (node, c)),
 R AS (SELECT node, c, sum(g) AS g FROM ({_back("G2", 3, 4)} UNION ALL SELECT A.j, T2.c, T2.g FROM A JOIN T2 ON T2.node = A.i) GROUP BY node, c),
 G1 AS (SELECT node, c AS o, CASE WHEN z > 0 THEN g ELSE 0 END AS g FROM R JOIN Z1 USING (node, c)),
 E AS ({_weights("0.own", "X0", "G1")} UNION ALL {_weights("0.message", "S1", "G1")} UNION ALL {_weights("1.own", "X1", "G2")} UNION ALL {_weights("1.message", "S2", "G2")} UNION ALL {_weights("1.output", "X2", "GO")})
 SELECT name, CAST(c AS BIGINT) AS c, CAST(o AS BIGINT) AS o, round(g, 9) + 0.0 AS g FROM E"""


@query(GRADIENTS)
def layer_gradients(spark, sf_dir):
    """The gradient of every weight of two layers and a softmax head, by reverse mode."""
    net = network.Network(NETWORK, 64, 2, weights=formula_weights())
    labels = _labels(spark, sf_dir)
    rows = written(network.labelled(features(spark, sf_dir), labels), "rows")
    got = net.gradients(rows, written(embedding_matrices(spark, sf_dir), "matrices"), labels.filter("part = 'train'").count())
    flat = [(n, d, o, float(g)) for n, w in got.weights.items() for d, row in enumerate(np.atleast_2d(w)) for o, g in enumerate(row)]
    made = spark.createDataFrame(flat, "name string, c bigint, o bigint, g double")
    return made.select("name", "c", "o", (F.round("g", 9) + 0.0).alias("g"))


def _planted(spark, sf_dir):
    """A class that the features of the node and of those around it tell."""
    f, m = features(spark, sf_dir), written(embedding_matrices(spark, sf_dir), "matrices")
    summed = layers.vector_sum(layers.sparse_vertex_agg(m, f, 64), ["node"], "features", 64)
    label = arg_max(F.col("features")).cast("int")
    part = F.when(F.col("node") % 5 < 3, "train").when(F.col("node") % 5 == 3, "valid").otherwise("test")
    return f, m, layers.linear_update(f, summed, HEAD, HEAD, activation=None).select("node", label.alias("label"), part.alias("part"))


@query()
def layer_training(spark, sf_dir):
    """Two layers learn a planted class: loss and accuracy of each part by epoch."""
    f, m, labels = _planted(spark, sf_dir)
    net = network.Network([network.Layer(16, weigh_graphs=True, message_activation="leaky"), network.Layer(16, output=4)], 64, 2, seed=1)
    got = network.train_network(net, f, m, labels, epochs=6, rate=0.03)
    return spark.createDataFrame(got.course, "epoch int, part string, loss double, accuracy double")


@query()
def learned_distances(spark, sf_dir):
    """Embeddings of vertices whose distances learn those of the graph: the loss on each part by step."""
    arcs = paths.arcs_of(first_graph(spark, sf_dir))
    ids = arcs.select(F.col("src").alias("node")).distinct()
    found = paths.all_pairs(arcs, ids.select(F.col("node").alias("src")))
    pairs = stats.split_60_20_20(found.filter("src <> dst").select(F.col("src").alias("i"), F.col("dst").alias("j"), (F.col("dist") / 100).alias("target")), "i", "j")
    _, losses = network.train_distances(layers.embedding_table(ids, 8, seed=1), pairs, epochs=8, rate=0.2)
    return spark.createDataFrame([(t, p, v) for t, each in enumerate(losses) for p, v in sorted(each.items())], "step int, part string, loss double")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hop distances 0..3 of all vertices, with the degree at each distance and its inverse."""
    g = first_graph(spark, sf_dir)
    places = lookup.within(g, [0])
    found = relations.neighbor_relations(g, range(4), places)
    counts = found.groupBy("src", "dist").agg(F.count(F.lit(1)).alias("deg"))
    return counts.select(F.col("src").alias("v"), "dist", "deg", (1 / (1.0 + F.col("deg"))).alias("inv_deg"))
