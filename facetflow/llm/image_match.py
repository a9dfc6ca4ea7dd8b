"""Cropped or edited copies of pictures, by local descriptors.

Corners (Harris) are found on all scales that hold a patch; the patch around each is turned to its intensity centroid and
described by ``BITS`` brightness comparisons. Then, without ever pairing all pictures that look alike:

1. Pictures of equal pixels form a class; only one of them goes on.
2. Each corner makes pairs with its ``NEIGHBOURS`` nearest corners of the scale. For each of ``TABLES`` words of the descriptors, both
   corners' words make a key of a Hamming table: pictures meet where both are unchanged. A word alone is shared by chance far too often.
3. In each bucket of a table all pictures are held against one pivot (a star, not all pairs). A pair is a link if its
   descriptors within ``APART`` bits agree, ``AGREE`` of them at least, on a shift, turn and scale.
4. Links make groups. Buckets whose pictures are in several groups get another pivot, ``ROUNDS`` times at most or until nothing new is linked.
5. Then all pairs of a bucket that are still in different groups are compared, so no pair that shares a key is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, slices
from .components import connected_components

#: Bits of a descriptor, words it is cut into (of WORD bits; two bits are over), most differing bits of a match.
BITS, TABLES, WORD, APART = 128, 3, 42, 16
#: Agreeing matches that make a copy, at least, and as part of the corners of the picture that has fewer: chance gives more where there are more.
AGREE, PART = 8, 0.05
#: Shrinking from scale to scale, patch radius, nearest corners that a corner makes a pair with, rounds of pivots.
SHRINK, RADIUS, NEIGHBOURS, ROUNDS = 1.5, 20, 2, 4
#: Corners that are described, or compared, at a time; pictures that are held against one pivot in one task; pixels of a cell of votes.
TOGETHER, BLOCK, CELL = 1024, 512, 12.0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(11)
TESTS = np.clip(_rng.normal(0, RADIUS / 2.2, (BITS, 4)), -RADIUS * 0.7, RADIUS * 0.7)


def box_blur(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of 2 r + 1, edges repeated."""
    p = np.pad(x, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    return (p[n:-1, n:-1] - p[: -n - 1, n:-1] - p[n:-1, : -n - 1] + p[: -n - 1, : -n - 1]) / n**2


def shrunk(x: np.ndarray, factor: float) -> np.ndarray:
    """Smaller by ``factor``: between the four nearest pixels of the blurred picture, by distance."""
    x = box_blur(x, 1)
    (r, up), (c, left) = (resampled(n, max(1, int(n / factor)), factor) for n in x.shape)
    rows = x[r] * (1 - up[:, None]) + x[np.minimum(r + 1, x.shape[0] - 1)] * up[:, None]
    return rows[:, c] * (1 - left) + rows[:, np.minimum(c + 1, x.shape[1] - 1)] * left


def resampled(n: int, size: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Of ``size`` places in a row of ``n`` pixels: the pixel before each, and how far behind it."""
    at = np.clip((np.arange(size) + 0.5) * factor - 0.5, 0, n - 1)
    return at.astype(int), at - at.astype(int)


def corners(x: np.ndarray) -> np.ndarray:
    """Row and column of each corner that a whole patch fits around, best first."""
    if min(x.shape) <= 2 * RADIUS + 2:
        return np.zeros((0, 2), int)
    gy, gx = np.gradient(x)
    a, b, c = (box_blur(v, 2) for v in (gx * gx, gy * gy, gx * gy))
    r = a * b - c * c - 0.05 * (a + b) ** 2
    inner = np.zeros(x.shape, bool)
    inner[RADIUS:-RADIUS, RADIUS:-RADIUS] = True
    p = np.pad(r, 2, constant_values=-np.inf)
    top = p[2:-2, 2:-2].copy()
    for i in range(5):
        for j in range(5):
            np.maximum(top, p[i : i + x.shape[0], j : j + x.shape[1]], out=top)
    found = np.argwhere(inner & (r >= top) & (r > 1e-3))
    return found[np.argsort(-r[tuple(found.T)], kind="stable")]


def described(smooth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of corners: the angle in 4096 steps, and descriptors as two 64-bit halves."""
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = yy**2 + xx**2 <= RADIUS**2
    patches = np.stack([smooth[r - RADIUS : r + RADIUS + 1, c - RADIUS : c + RADIUS + 1] for r, c in at]) * disc
    angle = np.arctan2((patches * yy).sum((1, 2)), (patches * xx).sum((1, 2)))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]

    def value(k: int) -> np.ndarray:
        dx, dy = TESTS[:, k], TESTS[:, k + 1]
        c = np.rint(at[:, 1:] + cos * dx - sin * dy).astype(int)
        r = np.rint(at[:, :1] + sin * dx + cos * dy).astype(int)
        return smooth[np.clip(r, 0, smooth.shape[0] - 1), np.clip(c, 0, smooth.shape[1] - 1)]

    bits = value(0) > value(2) + 2  # a little noise is no difference
    return np.rint(angle / (2 * np.pi) * 4096).astype(np.int64) % 4096, np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def words_of(halves: np.ndarray) -> np.ndarray:
    """Descriptors cut into TABLES words."""
    high, low, whole = halves[:, 0], halves[:, 1], np.uint64((1 << WORD) - 1)
    return np.column_stack([high >> np.uint64(64 - WORD), (high << np.uint64(2 * WORD - 64) | low >> np.uint64(128 - 2 * WORD)) & whole, low >> np.uint64(128 - 3 * WORD) & whole])


def nearest_corners(at: np.ndarray) -> np.ndarray:
    """Indexes of each corner's NEIGHBOURS nearest others, the first of equally near ones."""
    out = np.zeros((len(at), NEIGHBOURS), np.int64)
    for start in range(0, len(at), TOGETHER):
        gap = np.square(at[start : start + TOGETHER, None] - at[None]).sum(2).astype(float)
        gap[np.arange(len(gap)), start + np.arange(len(gap))] = np.inf
        out[start : start + TOGETHER] = np.argsort(gap, axis=1, kind="stable")[:, :NEIGHBOURS]
    return out


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x and y in the whole picture, number of the scale, angle, the descriptor's halves) of all corners, and the distinct keys of their pairs."""
    rows, keys = [np.zeros((0, 6), np.uint64)], [np.zeros(0, np.uint64)]
    x, scale, step = pixels.astype(float), 1.0, 0
    while min(x.shape) > 2 * RADIUS + 2:
        smooth = box_blur(x, 1)
        at = corners(smooth)
        if len(at):
            parts = [described(smooth, at[k : k + TOGETHER]) for k in range(0, len(at), TOGETHER)]
            turn, halves = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            place = np.rint(at[:, ::-1] * scale).astype(np.uint64)
            rows.append(np.column_stack([place, np.full(len(at), step, np.uint64), turn.astype(np.uint64), halves]))
            if len(at) > NEIGHBOURS:
                words, near = words_of(halves), nearest_corners(at)
                with np.errstate(over="ignore"):
                    key = words[:, None] * MULTIPLIER  # corner, neighbour, table
                    key = (key ^ key >> np.uint64(29) ^ words[near]) * MULTIPLIER
                    key = (key ^ key >> np.uint64(29) ^ np.arange(TABLES, dtype=np.uint64)) * MULTIPLIER
                keys.append((key ^ key >> np.uint64(32)).ravel())
        x, scale, step = shrunk(x, SHRINK), scale * SHRINK, step + 1
    return np.concatenate(rows), np.unique(np.concatenate(keys))


def agreeing(one: np.ndarray, other: np.ndarray) -> int:
    """Places of one picture that match places of the other within APART bits and agree on a shift, turn and scale: the most of any cell of votes."""
    a, b = [], []
    for start in range(0, len(one), TOGETHER):
        part = one[start : start + TOGETHER]
        for low in range(0, len(other), TOGETHER):
            there = other[low : low + TOGETHER]
            apart = np.bitwise_count(part[:, None, 4] ^ there[None, :, 4]).astype(np.int16) + np.bitwise_count(part[:, None, 5] ^ there[None, :, 5])
            i, j = np.nonzero(apart <= APART)
            a.append(part[i])
            b.append(there[j])
    if not a or sum(map(len, a)) < AGREE:
        return 0
    a, b = np.concatenate(a)[:, :4].astype(float), np.concatenate(b)[:, :4].astype(float)
    steps, turn = a[:, 2] - b[:, 2], (a[:, 3] - b[:, 3]) * (2 * np.pi / 4096)
    scale, cos, sin = SHRINK**steps, np.cos(turn), np.sin(turn)
    dx = a[:, 0] - scale * (cos * b[:, 0] - sin * b[:, 1])
    dy = a[:, 1] - scale * (sin * b[:, 0] + cos * b[:, 1])
    kind = np.column_stack([steps, np.floor((turn + np.pi / 8) % (2 * np.pi) / (np.pi / 4))])
    most = 0
    for u in (0, 0.5):  # grids half a cell apart
        for v in (0, 0.5):
            cells = np.column_stack([kind, np.floor(dx / CELL + u), np.floor(dy / CELL + v), a[:, :2]]).astype(np.int64)
            places = np.unique(cells, axis=0)
            most = max(most, int(np.unique(places[:, :4], axis=0, return_counts=True)[1].max()))
    return most


def keyed(media: DataFrame, id_col: str, kind: str) -> DataFrame:
    """``kind``, ``id``, ``width``, ``height``, ``pixels``, ``digest``. Rows without an id, or whose pixels don't fill the picture, take no part."""
    good = media.filter(F.col(id_col).isNotNull() & (F.col("width") > 0) & (F.col("height") > 0) & (F.length("pixels") == F.col("width").cast("long") * F.col("height")))
    return good.select(F.lit(kind).alias("kind"), F.col(id_col).cast("bigint").alias("id"), "width", "height", "pixels", F.sha2(F.concat(F.encode(F.concat_ws("x", "width", "height"), "utf-8"), "pixels"), 256).alias("digest"))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "pixels"):
        found = [describe(np.frombuffer(raw, np.uint8).reshape(h, w)) for w, h, raw in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "pixels")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r, _ in found], pa.binary()), pa.array([k.view(np.int64) for _, k in found], pa.list_(pa.int64()))], ["node", "corners", "keys"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, block), the pivot's own (b is null) first."""
    pivot = np.zeros((0, 6), np.uint64)
    for batch in batches:
        found = []
        for a, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "corners")), strict=True):
            own = np.frombuffer(raw, np.uint64).reshape(-1, 6)
            if b is None:
                pivot = own
            elif (n := agreeing(own, pivot)) >= max(AGREE, PART * min(len(own), len(pivot))):
                found.append((a, b, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "n_agree"])


def confirmed(pairs: DataFrame, pictures: DataFrame) -> DataFrame:
    """Those of the pairs (pivot ``a``, ``b``) that are copies, with ``n_agree``. A pivot of many is dealt over several tasks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    member = dealt.join(pictures, F.col("b") == F.col("node")).select("a", "block", "b", "corners")
    blocks = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    pivot = blocks.join(pictures, F.col("a") == F.col("node")).select("a", "block", F.lit(None).cast("long").alias("b"), "corners")
    return member.union(pivot).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(_confirmed, "a long, b long, n_agree int")


def _named(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Buckets with the group of each picture."""
    named = buckets.select("key", "node").join(labels.select(F.col("node").alias("_n"), "component"), F.col("node") == F.col("_n"), "left")
    return materialize(named.select("key", "node", F.coalesce("component", "node").alias("component")), "named")


def copies(queries: DataFrame, media: DataFrame, id_col: str = "media_id") -> DataFrame:
    """``kind`` (query or media), ``id``, ``class_id``, ``n_agree``: a row for each row that takes part.

    ``class_id`` is the smallest media id of the group of copies, edited copies and copies of these that the row belongs to
    (the smallest query id where there are no media in it); ``n_agree`` the most agreeing matches of its picture with another
    one of other pixels, null without any. Rows without an id, and pictures whose pixels don't fill them (null and empty ones,
    too) take no part; pictures too small for a patch and flat ones have no corners and are copies of equal pixels only. Repeated
    rows have a row each. Ties of votes don't matter.
    """
    rows = keyed(media, id_col, "media").union(keyed(queries, id_col, "query"))
    rows = numbered(rows, "node", "pictures")  # media come first, so pivots are media wherever there are any
    first = rows.groupBy("digest").agg(F.min("node").alias("rep"))
    members = materialize(rows.select("kind", "id", "node", "digest").join(first, "digest").select("kind", "id", "node", "rep"), "members")
    chosen = rows.join(members.filter("node = rep").select(F.col("rep").alias("_rep")), F.col("node") == F.col("_rep"), "left_semi")
    pictures = materialize(chosen.select("node", "width", "height", "pixels").mapInArrow(_described, "node long, corners binary, keys array<long>"), "corners")
    keys = pictures.select("node", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "pivot")
    buckets = materialize(keys.join(shared, "key"), "buckets")
    corners_of = pictures.select("node", "corners")
    links = materialize(confirmed(buckets.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), corners_of), "links")
    labels = connected_components(links)
    for turn in range(1, ROUNDS):
        named = _named(buckets, labels)
        # another pivot: of a group drawn by a hash; the others of the bucket are held against it
        drawn_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max(F.struct(F.xxhash64("component", F.lit(turn)).alias("h"), "component", "node")).alias("p")).filter("lo < hi")
        open_ = named.join(drawn_.select("key", F.col("p.component").alias("c"), F.col("p.node").alias("a")), "key").filter(F.col("component") != F.col("c"))
        more = materialize(confirmed(open_.select("a", F.col("node").alias("b")).distinct(), corners_of), "links")
        if more.isEmpty():
            break
        links = materialize(links.union(more), "links")
        labels = connected_components(links)
    # whatever stars have left: all pairs of a bucket whose pictures are still in different groups
    named = _named(buckets, labels)
    a, b = (named.select("key", F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    rest = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.col("_a") != F.col("_b"))).select("a", "b").distinct()
    more = materialize(confirmed(rest, corners_of), "links")
    if not more.isEmpty():
        links = materialize(links.union(more), "links")
        labels = connected_components(links)
    best = links.select(F.explode(F.array("a", "b")).alias("node"), "n_agree").groupBy("node").agg(F.max("n_agree").alias("n_agree"))
    whole = members.join(labels.select(F.col("node").alias("_n"), "component"), F.col("rep") == F.col("_n"), "left").withColumn("group", F.coalesce("component", "rep")).drop("_n", "component")
    whole = materialize(whole.join(best.withColumnRenamed("node", "_b"), F.col("rep") == F.col("_b"), "left").select("kind", "id", "group", "n_agree"), "grouped")
    names = whole.groupBy("group").agg(F.coalesce(F.min(F.when(F.col("kind") == "media", F.col("id"))), F.min("id")).alias("class_id"))
    return whole.join(names, "group").select("kind", "id", "class_id", "n_agree")


def drawn(df: DataFrame, id_col: str, vector_col: str, edited: bool = False, cell: int = 12) -> DataFrame:
    """Vectors as pictures, for tables that hold no media: components fill a square of cells row by row, dark to light by rank.

    With ``edited`` a cropped, darker copy with some noise is drawn. Null and empty vectors give no picture; missing components count as 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, raw = [], [], []
            for i, v in zip(batch.column("media_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if not v:
                    continue
                x = np.nan_to_num(np.array([c or 0.0 for c in v]))
                side = int(np.ceil(np.sqrt(len(x))))
                grid = np.zeros(side * side)
                grid[: len(x)] = (np.argsort(np.argsort(x, kind="stable")) + 1) * 255 // len(x)
                picture = np.kron(grid.reshape(side, side), np.ones((cell, cell)))
                if edited:
                    seed = int.from_bytes(blake2b(x.tobytes(), digest_size=4).digest(), "little")
                    picture = picture[cell // 2 :, cell // 3 :] * 0.85 + 8 + np.random.default_rng(seed).integers(-2, 3, picture.shape)[cell // 2 :, cell // 3 :]
                ids.append(i)
                sizes.append(picture.shape)
                raw.append(np.clip(picture, 0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s[1] for s in sizes], pa.int32()), pa.array([s[0] for s in sizes], pa.int32()), pa.array(raw, pa.binary())], ["media_id", "width", "height", "pixels"])

    return df.select(F.col(id_col).cast("bigint").alias("media_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "media_id long, width int, height int, pixels binary")
