"""Token counts of documents without their ids.

1. Pre-tokens are counted over the corpus (each task counts its own first).
2. The pieces of each distinct pre-token are counted once, by the segment trees of ``bpe``.
3. Documents' pre-token frequencies are joined to those counts and summed. The most frequent pre-tokens, ``HEAD`` of them at
   most, go to all tasks, which add them up in place; the others, rare ones by construction and so without hot keys, are
   joined by shuffle. Every pre-token takes exactly one of the two ways.

Shuffled keys are 64-bit hashes. Should two pre-tokens share one, both are found out in step 2 and go with the head, as text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import shared_codec
from .common import ENCODED_BYTES, materialize, slices

#: Pre-tokens that are sent to all tasks at most; distinct pieces of text that a task counts before it passes them on.
HEAD, COUNTED = 1 << 20, 800_000
#: Pieces of text whose pre-tokens a worker remembers.
REMEMBERED = 500_000


class Splitter:
    """Whole texts to pieces that no pre-token crosses, and pieces to pre-tokens."""

    def __init__(self, tokenizer_path: str):
        codec = shared_codec(tokenizer_path)
        self.model, self.cut = codec.model, codec.cut

    def pieces(self, text: str) -> list[str]:
        """Of a text with runs of white space: cut between other characters only."""
        first, *rest = self.cut.split(text)
        return [first, *(f" {p}" for p in rest)]

    def coded(self, texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Distinct pieces of all texts, and for each piece of each text the text's place and the piece's. Arrow splits and numbers them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        lists = pc.ascii_split_whitespace(texts) if self.cut is None else pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        found = lists.values.dictionary_encode()
        code, pieces = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        if self.cut is None:
            real = np.fromiter(map(bool, pieces), bool, len(pieces))[code]
            return pieces, owner[real], code[real]
        # a part that is empty or starts with white space belongs to a longer run of it
        odd = np.fromiter((not p or p[0].isspace() for p in pieces), bool, len(pieces))
        names = [f" {p}" for p in pieces]
        heads = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        within = np.ones(len(code), bool)
        within[offsets[:-1]] = False
        strange = np.unique(owner[within & odd[code]])
        code[offsets[:-1]] = len(names) + np.arange(len(heads))
        names += heads
        if len(strange):
            kept = ~np.isin(owner, strange)
            more = [self.pieces(texts[k].as_py()) for k in strange.tolist()]
            owner = np.concatenate([owner[kept], np.repeat(strange, list(map(len, more)))])
            code = np.concatenate([code[kept], len(names) + np.arange(sum(map(len, more)))])
            names += chain.from_iterable(more)
        return names, owner, code

    def pre_tokens(self, pieces: list) -> list[list[str | int]]:
        return self.model.split_many(pieces)


def hash_of(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode()) - (1 << 63)


def vocabulary(df: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``word``, ``hash``, ``n`` (times in the corpus) and ``pieces`` of each distinct pre-token; special tokens have no row."""
    df = df.select(F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(tokenizer_path)
        seen: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for parts, n in zip(splitter.pre_tokens(list(seen)), seen.values(), strict=True):
                for w in parts:
                    if isinstance(w, str):
                        words[w] += n
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text", ENCODED_BYTES):
            pieces, _, code = splitter.coded(batch.column("text"))
            times = np.bincount(code, minlength=len(pieces)).tolist()
            for piece, n in zip(pieces, times, strict=True):
                if n:
                    seen[piece] += n
            if len(seen) > COUNTED:
                yield flushed()
        yield flushed()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_codec(tokenizer_path).model
        for batch in batches:
            words = batch.column("word").to_pylist()
            pieces = [len(x) // 4 for x in model.encode_words([w.encode() for w in words])]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(list(map(hash_of, words)), pa.int64()), batch.column("n"), pa.array(pieces, pa.int32())], ["word", "hash", "n", "pieces"])

    counted = df.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(measure, "word string, hash long, n long, pieces int")


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens``, a row for each row of ``df``. Null and empty texts have none of either; repeated rows and null ids are kept."""
    words = materialize(vocabulary(df, tokenizer_path, text_col), "vocabulary")
    least = 1
    above = 0
    by_size = {r["k"]: r["c"] for r in words.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 64 rows at most
    for k in sorted(by_size, reverse=True):
        above += by_size[k]
        if above > HEAD:
            least = 1 << (k + 1)
            break
    head = words.filter(F.col("n") >= least).select("hash", "pieces").toArrow()  # HEAD rows at most
    order = np.argsort(head["hash"].to_numpy())
    shared = words.groupBy("hash").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("hash")
    clash = {r["word"]: r["pieces"] for r in words.join(shared, "hash").select("word", "pieces").collect()}  # next to never any
    tables = df.sparkSession.sparkContext.broadcast((head["hash"].to_numpy()[order], head["pieces"].to_numpy()[order], clash))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), source.schema["id"], T.StructField("n_bytes", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("times", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, (hashes, pieces, clashing) = Splitter(tokenizer_path), tables.value
        known: dict = {}  # pieces of the head in a piece of text
        rare: dict = {}  # hashes of others, where there are any
        row = TaskContext.get().partitionId() << 36

        def learn(new: list) -> None:
            split = splitter.pre_tokens(new)
            distinct = list({w for parts in split for w in parts if isinstance(w, str)})
            own = np.fromiter(map(hash_of, distinct), np.int64, len(distinct))
            at = np.minimum(np.searchsorted(hashes, own), max(0, len(hashes) - 1))
            found = hashes[at] == own if len(hashes) else np.zeros(len(own), bool)
            size = dict(zip(distinct, np.where(found, pieces[at], -1).tolist() if len(hashes) else [-1] * len(own), strict=True)) | {w: clashing[w] for w in distinct if w in clashing}
            named = dict(zip(distinct, own.tolist(), strict=True))
            for piece, parts in zip(new, split, strict=True):
                known[piece] = sum(1 if isinstance(w, int) else max(0, size[w]) for w in parts)
                if others := [named[w] for w in parts if isinstance(w, str) and size[w] < 0]:
                    rare[piece] = others

        for batch in slices(batches, "text", ENCODED_BYTES):
            names, owner, code = splitter.coded(batch.column("text"))
            n = batch.num_rows
            new = [p for p in set(names) if p not in known]
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                rare.clear()
                new = list(set(names))
            learn(new)
            held = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
            total = np.bincount(owner, weights=held[code], minlength=n).astype(np.int64)
            # a row of its own for what is known; its key is as good as random, to spread such rows
            number = row + np.arange(n, dtype=np.int64)
            row += n
            with np.errstate(over="ignore"):
                spread = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            scarce = np.fromiter(map(rare.__contains__, names), bool, len(names))
            pairs, times = np.unique(np.stack([owner, code])[:, scarce[code]], axis=1, return_counts=True) if scarce.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            hashes_of = [rare[names[c]] for c in pairs[1].tolist()]
            width = np.fromiter(map(len, hashes_of), np.int64, len(hashes_of))
            others = np.fromiter(chain.from_iterable(hashes_of), np.int64, int(width.sum()))
            nil = np.zeros(len(others), np.int64)
            take = pa.array(np.concatenate([np.arange(n), nil]), pa.int64(), mask=np.arange(n + len(others)) >= n)
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            columns = [np.concatenate([number, np.repeat(number[pairs[0]], width)]), np.concatenate([total, nil]), np.concatenate([spread, others]), np.concatenate([np.zeros(n, np.int32), np.repeat(times, width).astype(np.int32)])]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), batch.column("id").take(take), sizes.take(take), *map(pa.array, columns[1:])], schema.names)

    rows = source.mapInArrow(count, schema)
    rest = words.filter(F.col("n") < least).select(F.col("hash").alias("_h"), "pieces") if least > 1 else words.limit(0).select(F.col("hash").alias("_h"), "pieces")
    joined = rows.join(rest, F.col("hash") == F.col("_h"), "left")
    tokens = F.col("tokens") + F.when(F.col("times") > 0, F.col("times") * F.when(F.col("pieces").isNull(), F.raise_error(F.lit("a pre-token was not counted"))).otherwise(F.col("pieces"))).otherwise(0)
    summed = joined.groupBy("row").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return summed.select(id_col, "n_bytes", "n_tokens")
