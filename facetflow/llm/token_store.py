"""A content-addressed store of token ids.

Format (a folder of three Parquet tables, so that any store Spark reaches can hold it):

* ``chunks``: ``digest`` (BLAKE2b, 16 bytes, of the payload), ``n``, ``payload`` (little-endian unsigned ids of the store's
  width). Each distinct chunk is stored once, in the order of digests within a file.
* ``recipes``: in ascending order of document ids, over parts numbered in that order: ``part``, ``row``, the id,
  ``local_start`` (ids of the part before this document), ``n_tokens``, ``sizes``, ``digests`` (16 bytes for each chunk) and
  ``root``, the Merkle root of the digests.
* ``manifest``: for each part ``base`` (ids of all earlier parts), ``documents``, ``n_tokens`` and ``root``, the top of a hash
  tree of fan-out ``FAN`` over its documents' roots; in the row of part -1 the whole store's root and its width.

Readers recompute all roots, from the digests of recipes up to the store's, and hold them against what is written.

Chunks end where a rolling hash of the last ``WINDOW`` ids has zeros on top, so equal passages give equal chunks wherever
they stand. Documents are checked by CRC-32s of the chunks as read, shifted to their places and combined by xor: no
document has to be put together in one task, however long, and no payload is shuffled for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import shared_codec
from .common import ENCODED_BYTES, delete_path, materialize, slices

#: Ids in the rolling hash; shortest and longest chunk; bits that are zero at a cut (2 to this power: the mean length).
WINDOW, SHORTEST, LONGEST, BITS = 8, 64, 4096, 9
#: Children of a node in the tree over a part's documents: no task holds more of them at once.
FAN = 1024
#: Digests that a writing task remembers, so as to send a payload once.
SEEN = 1_000_000


def merkle_root(leaves: Iterable[bytes]) -> bytes:
    """Root of a binary hash tree; leaves and nodes are told apart by a prefix, an odd node moves up as it is."""
    level = [blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    if not level:
        return blake2b(b"", digest_size=16).digest()
    while len(level) > 1:
        level = [blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Chunk ends of each stretch ids[bounds[i]:bounds[i+1]], relative to its start."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        rolled, power = mixed.copy(), np.uint64(1)
        for k in range(1, min(WINDOW, len(ids))):
            power *= np.uint64(0xD6E8FEB86659FD93)
            rolled[k:] += mixed[:-k] * power
    ends = np.flatnonzero(rolled >> np.uint64(64 - BITS) == 0) + 1
    low = np.searchsorted(ends, bounds, side="right")
    out = []
    for i in range(len(bounds) - 1):
        base, total = int(bounds[i]), int(bounds[i + 1] - bounds[i])
        start, own = 0, []
        for end in (ends[low[i] : low[i + 1]] - base).tolist():
            while end - start > LONGEST:
                start += LONGEST
                own.append(start)
            if end - start >= SHORTEST and end < total:
                own.append(end)
                start = end
        while total - start > LONGEST:
            start += LONGEST
            own.append(start)
        own.append(total)
        out.append(own)
    return out


def write_store(df: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Encodes whole texts by the tokenizers library's model, appends ``end_id`` to each, and writes the store at ``path``.

    Null and empty texts hold the end id alone. Repeated rows are kept, each as a document; a null id comes first. An
    empty table gives an empty store. Only the id and the text are used of ``df``.
    """
    spark = df.sparkSession
    df = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    width = 2 if shared_codec(tokenizer_path).model.size <= 1 << 16 and end_id < 1 << 16 else 4
    staged = materialize(_encoded(df, tokenizer_path, end_id, width), "staged", compression="lz4")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    fresh = staged.filter("digest is not null").select("digest", "payload")
    chunks = fresh.repartition(parts, "digest").sortWithinPartitions("digest").mapInArrow(_distinct(width), "digest binary, n int, payload binary")
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staged.filter("n_tokens is not null").select("id", "n_tokens", "sizes", "digests").repartitionByRange(parts, "id").sortWithinPartitions("id")
    fields = [("part", T.IntegerType()), ("row", T.LongType()), ("id", staged.schema["id"].dataType), ("local_start", T.LongType()), ("n_tokens", T.LongType()), ("sizes", T.ArrayType(T.IntegerType())), ("digests", T.BinaryType()), ("root", T.BinaryType())]
    recipes.mapInArrow(_numbered, T.StructType([T.StructField(n, t) for n, t in fields])).write.option("compression", "zstd").parquet(f"{path}/recipes")

    per_part = part_roots(spark.read.parquet(f"{path}/recipes").select("part", "row", "root", "n_tokens"))
    base, rows = 0, []
    for part, documents, n_tokens, root in per_part:
        rows.append((part, base, documents, n_tokens, bytes(root), width))
        base += n_tokens
    rows.append((-1, base, sum(r[2] for r in rows), base, merkle_root(r[4] for r in rows), width))
    schema = "part int, base bigint, documents bigint, n_tokens bigint, root binary, width int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/manifest")
    for file in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        delete_path(spark, file)


def _encoded(df: DataFrame, tokenizer_path: str, end_id: int, width: int) -> DataFrame:
    """A row for each document (``n_tokens`` and what follows) and one for each chunk that its task has not seen before (``digest``, ``payload``)."""
    schema = T.StructType([df.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("digests", T.BinaryType()), T.StructField("digest", T.BinaryType()), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, kind = shared_codec(tokenizer_path, True), np.dtype(f"<u{width}")
        seen: set[bytes] = set()
        for batch in slices(batches, "text", ENCODED_BYTES):
            ids, bounds = codec.encode_ended(batch.column("text"), end_id)
            packed = ids.astype(kind).tobytes()
            n, sizes, digests, fresh, payloads = [], [], [], [], []
            for base, ends in zip(bounds[:-1].tolist(), cuts(ids, bounds), strict=True):
                own, start = [], 0
                for stop in ends:
                    payload = packed[(base + start) * width : (base + stop) * width]
                    own.append(digest := blake2b(payload, digest_size=16).digest())
                    if digest not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(digest)
                        fresh.append(digest)
                        payloads.append(payload)
                    start = stop
                n.append(ends[-1])
                sizes.append(np.diff([0, *ends]).tolist())
                digests.append(b"".join(own))
            arrays = [batch.column("id"), pa.array(n, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(digests, pa.binary())]
            none = [pa.nulls(len(n), pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([*arrays, *none], schema.names)
            if fresh:
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(fresh), a.type) for a in arrays), pa.array(fresh, pa.binary()), pa.array(payloads, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def _distinct(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            digests, keep = batch.column("digest").to_pylist(), []
            for k, digest in enumerate(digests):
                if digest != last:
                    keep.append(k)
                    last = digest
            kept = batch.take(pa.array(keep, pa.int32()))
            n = pc.divide(pc.binary_length(kept.column("payload")), width).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([kept.column("digest"), n, kept.column("payload")], ["digest", "n", "payload"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        starts = start + np.cumsum(n) - n
        start += int(n.sum())
        roots = [merkle_root(d[i : i + 16] for i in range(0, len(d), 16)) for d in batch.column("digests").to_pylist()]
        arrays = [pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), batch.column("id"), pa.array(starts.astype(np.int64)), batch.column("n_tokens"), batch.column("sizes"), batch.column("digests"), pa.array(roots, pa.binary())]
        row += len(n)
        yield pa.RecordBatch.from_arrays(arrays, ["part", "row", "id", "local_start", "n_tokens", "sizes", "digests", "root"])


def part_roots(roots: DataFrame) -> list[tuple]:
    """``part``, documents, tokens and root of each part, from ``part``, ``row``, ``root`` and ``n_tokens`` of its documents.

    Level by level, FAN nodes make one; groups are bounded however many documents a part has.
    """
    level = roots.select("part", F.col("row").alias("at"), "root", F.lit(1).cast("long").alias("documents"), "n_tokens")
    most = roots.agg(F.max("row")).first()[0]
    while True:
        children = F.array_sort(F.collect_list(F.struct("at", "root")))
        node = F.unhex(F.sha2(F.array_join(F.transform(children, lambda c: F.hex(c["root"])), ""), 256))
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(node.alias("root"), F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"))
        if (most := (most or 0) // FAN) == 0:
            break
    return sorted((r["part"], r["documents"], r["n_tokens"], bytes(r["root"])) for r in level.collect())  # a row for each part


# -- reading ----------------------------------------------------------------------------------------------------------

POLYNOMIAL = np.uint32(0xEDB88320)
#: Bits of a number that one table of powers covers.
DIGITS = 12


def shifted(crc: np.ndarray, power: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC-32 polynomial, in reflected bit order."""
    out, b = np.zeros(len(crc), np.uint32), power.astype(np.uint32).copy()
    for bit in range(31, -1, -1):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ POLYNOMIAL, b >> np.uint32(1))
    return out


def power_of(n_ids: np.ndarray) -> np.ndarray:
    """x to the power of the bits of so many ids (32 each), modulo the polynomial: from tables of DIGITS bits of the number each."""
    left, out = n_ids.astype(np.int64), np.full(len(n_ids), 1 << 31, np.uint32)  # 1
    place = 0
    while left.any():
        some = np.flatnonzero(left & ((1 << DIGITS) - 1))
        out[some] = shifted(out[some], powers(place)[left[some] & ((1 << DIGITS) - 1)])
        left >>= DIGITS
        place += 1
    return out


@lru_cache(maxsize=8)
def powers(place: int) -> np.ndarray:
    """x to the power of 32 times 0, 1, 2, ... times 2 to the power of DIGITS * ``place``."""
    square = np.array([1 << 30], np.uint32)  # x
    for _ in range(5 + DIGITS * place):
        square = shifted(square, square)
    out = np.array([1 << 31], np.uint32)
    for _ in range(DIGITS):
        out = np.append(out, shifted(out, np.repeat(square, len(out))))
        square = shifted(square, square)
    return out


def read_chunks(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Chunks as stored, each held against its digest: ``digest``, ``n``, ``crc32`` of its ids as unsigned 32-bit numbers, and ``payload`` if asked for."""
    width = _manifest(spark, path).filter("part = -1").first()["width"]
    schema = "digest binary, n int, crc32 bigint" + ", payload binary" * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("payload")
            ends = np.append(0, np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False))).tolist()
            joined = b"".join(column.to_pylist())
            raw, ids = memoryview(joined), memoryview(np.frombuffer(joined, f"<u{width}").astype("<u4")).cast("B")
            crc = []
            for digest, low, high in zip(batch.column("digest").to_pylist(), ends[:-1], ends[1:], strict=True):
                if blake2b(raw[low:high], digest_size=16).digest() != digest:
                    raise ValueError(f"chunk {digest.hex()} is damaged")
                crc.append(zlib.crc32(ids[low * 4 // width : high * 4 // width]))
            arrays = [batch.column("digest"), batch.column("n"), pa.array(crc, pa.int64()), column]
            yield pa.RecordBatch.from_arrays(arrays[: 3 + payload], ["digest", "n", "crc32", "payload"][: 3 + payload])

    return spark.read.parquet(f"{path}/chunks").mapInArrow(run, schema)


def checked(spark: SparkSession, path: str) -> None:
    """Raises ValueError unless all roots come out as written: of documents from their digests, of parts and of the store from these."""
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "n_tokens", "digests", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle_root(d[i : i + 16] for i in range(0, len(d), 16)) for d in batch.column("digests").to_pylist()]
            if roots != batch.column("root").to_pylist():
                raise ValueError("the digests of a document don't make its root")
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(roots, pa.binary()), batch.column("n_tokens")], ["part", "row", "root", "n_tokens"])

    found = part_roots(recipes.mapInArrow(run, "part int, row bigint, root binary, n_tokens bigint"))
    manifest = {r["part"]: (r["documents"], r["n_tokens"], bytes(r["root"])) for r in _manifest(spark, path).collect()}  # a row for each part
    total = (sum(r[1] for r in found), sum(r[2] for r in found), merkle_root(r[3] for r in found))
    if {p: tuple(rest) for p, *rest in found} | {-1: total} != manifest:
        raise ValueError("the roots of the store's parts aren't those of its manifest")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _references(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk of each document: ``part``, ``row``, ``seq``, ``digest``, ``size``, ``behind`` (ids of the document after it)."""
    recipes = spark.read.parquet(f"{path}/recipes").select("part", "row", "n_tokens", "sizes", "digests")
    schema = "part int, row bigint, seq int, digest binary, size int, behind bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sizes")
            counts = np.array([len(x) for x in lists.to_pylist()], np.int64)
            sizes = lists.flatten().to_numpy(zero_copy_only=False)
            total = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            firsts = np.cumsum(counts) - counts
            ends = np.cumsum(sizes)
            before = np.where(firsts > 0, ends[np.maximum(firsts, 1) - 1], 0) if len(sizes) else firsts
            seq = np.arange(len(sizes)) - np.repeat(firsts, counts)
            joined = b"".join(batch.column("digests").to_pylist())
            digests = [joined[i : i + 16] for i in range(0, len(joined), 16)]
            behind = np.repeat(total + before, counts) - ends
            arrays = [pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts)) for c in ("part", "row")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq.astype(np.int32)), pa.array(digests, pa.binary()), pa.array(sizes.astype(np.int32)), pa.array(behind.astype(np.int64))], ["part", "row", "seq", "digest", "size", "behind"])

    return recipes.mapInArrow(run, schema)


def _placed_crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = batch.column("crc32").to_numpy(zero_copy_only=False).astype(np.uint32)
        placed = shifted(crc, power_of(batch.column("behind").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(placed.astype(np.int64)), batch.column("n")], ["part", "row", "placed", "n"])


def read_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Each document as read back: ``id_col``, ``start``, ``n_tokens``, ``ids_crc32``. A chunk that is missing, damaged or of another size than its recipe says raises an error, and so does a root that doesn't come out."""
    checked(spark, path)
    held = read_chunks(spark, path, payload=False)
    joined = _references(spark, path).join(held.withColumnRenamed("digest", "_digest"), F.col("digest") == F.col("_digest"), "left")
    sound = joined.select("part", "row", "behind", F.when(F.col("n") == F.col("size"), F.col("n")).otherwise(F.raise_error(F.lit("a chunk is missing or has another size"))).cast("int").alias("n"), "crc32")
    crcs = sound.mapInArrow(_placed_crc, "part int, row bigint, placed bigint, n int").groupBy("part", "row").agg(F.bit_xor("placed").alias("ids_crc32"), F.sum("n").alias("n_tokens"))
    bases = F.broadcast(_manifest(spark, path).filter("part >= 0").select("part", "base"))  # a row for each part
    heads = spark.read.parquet(f"{path}/recipes").select("part", "row", "id", "local_start").join(bases, "part")
    return heads.join(crcs, ["part", "row"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long"), F.col("ids_crc32").cast("long"))


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents put together again: ``id_col``, ``start``, ``ids`` (array of long)."""
    width = _manifest(spark, path).filter("part = -1").first()["width"]
    joined = _references(spark, path).join(read_chunks(spark, path).select(F.col("digest").alias("_digest"), "payload"), F.col("digest") == F.col("_digest"))
    whole = joined.groupBy("part", "row").agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("c"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c), f"<u{width}").astype(np.int64) for c in batch.column("payloads").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("row"), pa.array(ids, pa.list_(pa.int64()))], schema.names)

    ids = whole.select("part", "row", F.transform("c", lambda x: x["payload"]).alias("payloads")).mapInArrow(run, schema)
    bases = F.broadcast(_manifest(spark, path).filter("part >= 0").select("part", "base"))
    heads = spark.read.parquet(f"{path}/recipes").select("part", "row", "id", "local_start").join(bases, "part")
    return heads.join(ids, ["part", "row"]).select(F.col("id").alias(id_col), (F.col("base") + F.col("local_start")).alias("start"), "ids")
