"""Pictures: edits that have to be found, groups of copies, the consensus against a plain model, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.llm import image_match
from facetflow.llm.queries import op6_edited_pictures

SCHEMA = "media_id bigint, width int, height int, pixels binary"


def drawing(seed, side=9, cell=14):
    rng = np.random.default_rng(seed)
    return np.kron(rng.integers(0, 256, (side, side)), np.ones((cell, cell))).astype(float)


def row(i, x):
    x = np.clip(x, 0, 255).astype(np.uint8)
    return i, x.shape[1], x.shape[0], x.tobytes()


def enlarged(x, factor):
    for _ in range(2):
        at = np.clip((np.arange(int(x.shape[0] * factor)) + 0.5) / factor - 0.5, 0, x.shape[0] - 1)
        low = at.astype(int)
        part = (at - low)[:, None]
        x = (x[low] * (1 - part) + x[np.minimum(low + 1, x.shape[0] - 1)] * part).T
    return x


EDITS = {
    "crop": lambda x: x[17:, 23:],
    "half": lambda x: x[: x.shape[0] * 2 // 3, : x.shape[1] * 2 // 3],
    "dark": lambda x: x * 0.6 + 10,
    "noise": lambda x: x + np.random.default_rng(1).normal(0, 4, x.shape),
    "larger": lambda x: enlarged(x, 1.5),
    "caption": lambda x: np.vstack([x[:-20], np.full((20, x.shape[1]), 255.0)]),
}


@pytest.mark.parametrize("edit", EDITS)
def test_edits_are_found(spark, edit):
    media = spark.createDataFrame([row(i, drawing(i)) for i in range(30)], SCHEMA)
    asked = spark.createDataFrame([row(i, EDITS[edit](drawing(i))) for i in range(0, 30, 3)], SCHEMA)
    found = image_match.copies(asked, media).collect()
    assert len(found) == 40
    own = [r["class_id"] == r["id"] for r in found if r["kind"] == "query"]
    assert sum(own) >= 0.9 * len(own)
    assert all(r["class_id"] == r["id"] for r in found if r["kind"] == "media")


def test_groups(spark):
    """Equal pictures, edits of edits, pictures of queries only, rows that take no part, repeated rows, clashing names."""
    x, y = drawing(1), drawing(2)
    media = [row(5, x), row(3, x), row(8, EDITS["dark"](x)), row(9, y), row(20, np.zeros((60, 60))), row(21, np.zeros((60, 60))), row(22, np.zeros((3, 3))), (None, 1, 1, b"x"), (30, 2, 2, b"x"), (31, None, 2, b"xx"), (32, 0, 0, b""), (33, 2, 2, None), row(9, y)]
    asked = [row(40, EDITS["crop"](x)), row(41, drawing(3)), row(42, EDITS["dark"](drawing(3)))]
    names = {c: F.lit(c) for c in ("node", "digest", "kind", "rep", "key")}
    found = image_match.copies(spark.createDataFrame(asked, SCHEMA).withColumns(names), spark.createDataFrame(media, SCHEMA).withColumns(names)).collect()
    got = sorted((r["kind"], r["id"], r["class_id"]) for r in found)
    want = [("media", 5, 3), ("media", 3, 3), ("media", 8, 3), ("media", 9, 9), ("media", 9, 9), ("media", 20, 20), ("media", 21, 20), ("media", 22, 22), ("query", 40, 3), ("query", 41, 41), ("query", 42, 41)]
    assert got == sorted(want)
    n = {(r["kind"], r["id"]): r["n_agree"] for r in found}
    assert n["query", 40] >= image_match.AGREE and n["media", 9] is None
    none = spark.createDataFrame([], SCHEMA)
    assert image_match.copies(none, none).count() == 0


def test_consensus_is_that_of_a_plain_count():
    a, b = image_match.describe(drawing(4))[0], image_match.describe(EDITS["crop"](drawing(4)))[0]
    best = Counter()
    held = set()
    for p in b.tolist():
        for q in a.tolist():
            if (p[4] ^ q[4]).bit_count() + (p[5] ^ q[5]).bit_count() <= image_match.APART:
                turn, scale = (p[3] - q[3]) * 2 * math.pi / 4096, image_match.SHRINK ** (p[2] - q[2])
                dx = p[0] - scale * (math.cos(turn) * q[0] - math.sin(turn) * q[1])
                dy = p[1] - scale * (math.sin(turn) * q[0] + math.cos(turn) * q[1])
                for u in (0, 0.5):
                    for v in (0, 0.5):
                        cell = (u, v, p[2] - q[2], math.floor((turn + math.pi / 8) % (2 * math.pi) / (math.pi / 4)), math.floor(dx / 12 + u), math.floor(dy / 12 + v))
                        if (*cell, p[0], p[1]) not in held:
                            held.add((*cell, p[0], p[1]))
                            best[cell] += 1
    assert image_match.agreeing(b, a) == max(best.values()) >= 20


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    vectors = {i: rng.normal(size=64).tolist() for i in range(30, 50)}
    vectors |= {60: vectors[40], 61: vectors[40], 99: None, 98: []}
    spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = sorted((r["kind"], r["id"], r["class_id"]) for r in op6_edited_pictures(spark, str(tmp_path)).collect())
    assert [r for r in rows if r[0] == "query"] == [("query", 40, 40), ("query", 60, 40)]
    assert [r for r in rows if r[0] == "media"] == [("media", i, 40 if i in (60, 61) else i) for i in vectors if i < 98]


def test_pairs_that_pivots_leave_are_compared(spark, monkeypatch):
    """A bucket whose pivots match nothing still links the others: only the last two share a picture."""
    monkeypatch.setattr(image_match, "ROUNDS", 1)
    same = image_match.describe(drawing(7))[0].tobytes()
    own = [image_match.describe(drawing(s))[0].tobytes() for s in range(20, 24)] + [same, same]
    rows = [(f"{n}", raw) for n, raw in enumerate(own)]

    def described(batches):
        import pyarrow as pa

        for batch in batches:
            nodes = batch.column("node")
            at = [int(w) - 100 for w in batch.column("width").to_pylist()]
            yield pa.RecordBatch.from_arrays([nodes, pa.array([rows[k][1] for k in at], pa.binary()), pa.array([[1]] * len(at), pa.list_(pa.int64()))], ["node", "corners", "keys"])

    monkeypatch.setattr(image_match, "_described", described)
    media = spark.createDataFrame([(k, 100 + k, 1, bytes([k]) * (100 + k)) for k in range(6)], SCHEMA).coalesce(1)
    got = {r["id"]: r["class_id"] for r in image_match.copies(media.limit(0), media).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
