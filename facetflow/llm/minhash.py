"""Near-duplicate documents by min-max hashing, with every link confirmed on full shingle sets.

Both the smallest and the largest value under each permutation are kept: 64 evaluations of a hash give 128 values, each
equal in two documents with a probability of their similarity. ``BANDS`` bands of ``ROWS`` values make candidates; at a
similarity of 0.75 a link is missed with a probability of 5e-6. Then:

1. Documents of equal shingle sets form a class; only its smallest id goes on, so copies make no pairs.
2. In each bucket of equal band values all members are held against one pivot (a star, not all pairs). Links are merged.
3. The same again with another pivot, in buckets whose members are in several components.
4. In buckets that still hold several components, members of different components are compared in blocks, each pair in
   the first band that it shares only, until it is known to be joined or not. So no link between texts is lost, and
   the expensive step sees only what the stars could not settle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_by_worker, materialize, numbered, slices, texts_of, unused_name
from .components import connected_components

SHINGLE, PERMUTATIONS, ROWS = 5, 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Least similarity, in hundredths.
THRESHOLD = 75
#: Words whose hashes a worker remembers; members of a block, and shingles from which a member counts as several.
WORDS, BLOCK, LONG = 400_000, 512, 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Shingle sets as sorted distinct 64-bit hashes, and their min-max signatures."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.masks = rng.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (PERMUTATIONS, 1), dtype=np.uint64)
        self.factors = rng.integers(0, 1 << 63, (PERMUTATIONS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space count
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if n < SHINGLE:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
        known = self.words
        if len(known) > WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        with np.errstate(over="ignore"):
            x = h[: n - SHINGLE + 1].copy()
            for k in range(1, SHINGLE):
                x = x * MULTIPLIER ^ h[k : n - SHINGLE + 1 + k]
                x ^= x >> np.uint64(29)
            x *= MULTIPLIER
            x ^= x >> np.uint64(32)
        return np.unique(x)

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """A key for each band; bands of different numbers never share one but by chance."""
        low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
        with np.errstate(over="ignore"):
            for start in range(0, len(shingles), 2048):
                y = (shingles[start : start + 2048] ^ self.masks) * self.factors
                low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
            values = np.stack([low, high], 1).reshape(BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64) * MULTIPLIER
            for k in range(ROWS):
                key = (key ^ values[:, k]) * MULTIPLIER
                key ^= key >> np.uint64(30)
        return key.view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the set and band ``keys``; the last two null where a text has no words."""
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = held_by_worker(("shingles",), Hasher)
        for batch in slices(batches, "text"):
            n, digests, keys = [], [], []
            for text in texts_of(batch.column("text")):
                own = hasher.shingles(text)
                n.append(len(own))
                digests.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                keys.append(hasher.bands(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "keys"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rep`` and its set, as sorted little-endian hashes."""
    df = df.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = held_by_worker(("shingles",), Hasher)
        for batch in slices(batches, "text"):
            sets = pa.array([hasher.shingles(t).tobytes() for t in texts_of(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rep"), sets], ["rep", "hashes"])

    return df.mapInArrow(run, "rep long, hashes binary")


def alike(common: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int):
    return 100 * common >= THRESHOLD * (one + other - common)


def _against_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, block), the pivot's own (b is null) first."""
    pivot = np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for x, y, hashes in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "hashes")), strict=True):
            own = np.frombuffer(hashes, np.uint64)
            if y is None:
                pivot = own
            elif min(len(own), len(pivot)) * 100 >= THRESHOLD * max(len(own), len(pivot)):
                at = np.searchsorted(pivot, own)
                at[at == len(pivot)] = 0
                if alike(int((pivot[at] == own).sum()), len(own), len(pivot)):
                    a.append(x)
                    b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm_stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (pivot ``a``, member ``b``) whose sets are alike. A pivot of many members is dealt over several tasks."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"))
    member = dealt.join(sets, F.col("b") == F.col("rep")).select("a", "block", "b", "hashes")
    blocks = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    pivot = blocks.join(sets, F.col("a") == F.col("rep")).select("a", "block", F.lit(None).cast("long").alias("b"), "hashes")
    return member.union(pivot).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first()).mapInArrow(_against_pivot, "a long, b long")


def _settle(group: list[tuple]) -> list[tuple[int, int]]:
    """Links that join components within a group of rows (band, side, rep, component, keys, hashes), side 0 against side 1."""
    band = group[0][0]
    sides = np.array([g[1] for g in group])
    keys = np.array([g[4] for g in group], np.int64)
    sets = [np.frombuffer(g[5], np.uint64) for g in group]
    sizes = np.array([len(s) for s in sets])
    roots = np.unique(np.array([g[3] for g in group]), return_inverse=True)[1]
    out = []
    for u in np.flatnonzero(sides == 0).tolist():
        mask = (sides == 1) & (roots != roots[u]) & (100 * np.minimum(sizes, sizes[u]) >= THRESHOLD * np.maximum(sizes, sizes[u]))
        at = np.flatnonzero(mask)
        if len(at) and band:
            at = at[~(keys[at, :band] == keys[u, :band]).any(1)]  # compared in an earlier band
        for part in np.array_split(at, len(at) // 64 + 1):
            part = part[roots[part] != roots[u]]
            if not len(part):
                continue
            joined = np.concatenate([sets[v] for v in part])
            where = np.searchsorted(sets[u], joined)
            where[where == sizes[u]] = 0
            common = np.add.reduceat((sets[u][where] == joined).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for v in part[alike(common, sizes[part], sizes[u])].tolist():
                if roots[v] != roots[u]:
                    out.append((group[u][2], group[v][2]))
                    roots[roots == roots[v]] = roots[u]
    return out


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    last = None
    for batch in batches:
        links: list[tuple[int, int]] = []
        columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "band", "side", "rep", "component", "keys", "hashes")]
        for key, i, j, *row in zip(*columns, strict=True):
            if (key, i, j) != last:
                links += _settle(held) if len(held) > 1 else []
                held, last = [], (key, i, j)
            held.append(tuple(row))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
    links = _settle(held) if len(held) > 1 else []
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def settle_blocks(open_: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Compares members of different components within buckets (``key``, ``band``, ``rep``, ``component``).

    In each bucket the members outside its largest component (side 0) meet all members (side 1), a block of each at a time:
    pairs within the largest component take part in nothing.
    """
    open_ = open_.join(classes.select("rep", F.greatest(F.lit(1.0), F.col("n_shingles") / LONG).alias("weight")), "rep")  # bounds a block's bytes
    counts = open_.groupBy("key", "component").agg(F.sum("weight").alias("n"))
    sizes = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
    sizes = sizes.select("key", "main", F.ceil(F.col("all") / BLOCK).cast("int").alias("js"), F.ceil(F.col("rest") / BLOCK).cast("int").alias("is"))
    dealt = materialize(open_.join(sizes, "key"), "dealt")
    few = dealt.filter("component <> main").select("key", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("is")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), "band", F.lit(0).alias("side"), "rep", "component")
    whole = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.pmod(F.xxhash64("rep"), F.col("js")).cast("int").alias("j"), "band", F.lit(1).alias("side"), "rep", "component")
    dealt = few.union(whole)
    full = dealt.join(classes.select("rep", "keys"), "rep").join(sets, "rep").select("key", "i", "j", "band", "side", "rep", "component", "keys", "hashes")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep").mapInArrow(_in_blocks, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (smallest id reachable by links), ``kept`` (this is that id): a row for each row of ``df``.

    Words are split at ASCII white space after lower-casing A-Z. Null, empty and wordless texts have empty sets and are linked
    with nothing; so are rows without an id (component null, kept). Rows that share an id are taken as one document;
    columns other than the two named are ignored; an empty table gives an empty result.
    """
    sketch = materialize(sketches(df, id_col, text_col), "sketches")
    alive = sketch.filter("digest is not null and doc_id is not null")
    classes = materialize(alive.groupBy("digest").agg(F.min(F.struct("doc_id", "keys", "n_shingles")).alias("m")).select("digest", F.col("m.doc_id").alias("rep"), F.col("m.keys").alias("keys"), F.col("m.n_shingles").alias("n_shingles")), "classes")
    bands = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "pivot")
    members = materialize(bands.join(shared, "key"), "members")
    wanted = members.select("rep").distinct()
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(wanted, "rep")
    sets = materialize(shingle_sets(texts, "rep", "text"), "sets")

    links = materialize(confirm_stars(members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), sets), "links")
    labels = connected_components(links)
    open_ = _unsettled(members, labels)
    # another pivot: of the last component in each bucket
    last = open_.groupBy("key").agg(F.max(F.struct("component", "rep")).alias("p")).select("key", F.col("p.rep").alias("a"), F.col("p.component").alias("_c"))
    second = open_.join(last, "key").filter(F.col("component") != F.col("_c")).select("a", F.col("rep").alias("b")).distinct()
    labels = _merged(labels, confirm_stars(second, sets))
    labels = _merged(labels, settle_blocks(_unsettled(members, labels), classes, sets))

    of_class = classes.select("digest", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    linked = alive.select("doc_id", "n_shingles", "digest").join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    alone = sketch.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def distinct_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id (null ids last), the first row among equal ids. Rows without words stay.

    Rows are numbered once and each is a document of its own, so null and repeated ids are no exceptions. Columns stay as they are.
    """
    row = unused_name(df, "__row")
    rows = numbered(df, row, "numbered")
    own = rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    groups = materialize(near_duplicates(own, "row", "text").select("row", "component_id"), "groups")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    held = groups.join(several, "component_id").join(own.select("row", "id"), "row")
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = held.groupBy("component_id").agg(F.min(order).alias("first"))
    gone = held.join(first, "component_id").filter(F.col("row") != F.col("first.row")).select(F.col("row").alias("__gone"))
    return rows.join(gone, F.col(row) == F.col("__gone"), "left_anti").drop(row)


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their components, of buckets that hold several components."""
    named = members.select("key", "band", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return materialize(named.join(several, "key", "left_semi"), "unsettled")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links between nodes, of which some may have no label yet."""
    links = materialize(links, "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    whole = materialize(labels.join(nodes, "node", "full").select("node", F.coalesce("component", "node").alias("component")), "labels")
    a, b = (whole.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab")
    over = connected_components(links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = over.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return materialize(whole.join(moved, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component")), "labels")
