"""Whitening, resampling and online packing against brute force, and the odd rows that each has to stand."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetflow.llm import online_packing, resample, whitening
from facetflow.llm import queries as llm_queries
from facetflow.llm.queries import tokenizer
from oracle import compare, connection

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VECTORS = "vec_id bigint, embedding array<float>, label string, _id int"
SF = "/root/testdata/sf0.001"
ODD = ["", "  ", "A b C", "ÄÖ äö ß Σ", "a_b-c4d 9", "x\x00y\x7fz", "日本語 12345", "word " * 4000, "Q" * 30000, "same words here"]


def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_all_operators_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 14)}


# -- whitening -------------------------------------------------------------------------------------------------------------


def brute_whitening(vectors: dict) -> dict:
    """By id: deviation and whitened values (up to sign), with the explained shares."""
    x = {k: [math.floor(256 * c) for c in v] for k, v in vectors.items()}
    fit = [list(r) for r in sorted({tuple(r) for r in x.values()})]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([s / n for s in sums])
    cov = np.cov(np.array(fit, float).T, bias=True).reshape(len(sums), -1)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    return {k: (sum((n * c - s) ** 2 for c, s in zip(r, sums)), np.abs((np.array(r) - mean) @ v[:, :4] / np.sqrt(e[:4]))) for k, r in x.items()}, e[:4] / np.trace(cov), n


def held(rows):
    found = defaultdict(dict)
    for r in rows:
        found[r["vec_id"]][r["component"]] = r
    return found


def test_whitening_is_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 7)) @ np.diag([3, 2.2, 1.5, 1, 0.5, 0.3, 0.1]) @ rng.normal(size=(7, 7))
    rows = [(i, [float(np.float32(c)) for c in v], "x", 1) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[3][1], None, 2) for i in range(200)]  # a third of all rows is one vector
    want, explained, n = brute_whitening({r[0]: r[1] for r in rows})
    odd = [(2000, None, None, None), (2001, [], None, None), (2002, [1.0] * 6 + [None], None, None), (2003, [float("nan")] * 7, None, None), (2004, [float("inf")] * 7, None, None), (2005, [1.0, 2.0], None, None)]
    found = held(whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).collect())
    assert set(found) == set(want)
    for k, (deviation, values) in want.items():
        assert sorted(found[k]) == [1, 2, 3, 4]
        for c, r in found[k].items():
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert abs(abs(r["whitened"]) - values[c - 1]) < 1e-9
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-9 and 0 <= r["identity_error"] < 1e-9


def test_the_side_of_a_component_is_the_same_for_all_rows(spark):
    rows = [(i, [float(i), 0.5 * (i % 3), 0.1 * (i % 2)], "x", 1) for i in range(40)]
    values = [r["whitened"] for r in sorted(whitening.whiten(spark.createDataFrame(rows, VECTORS)).filter("component = 1").collect(), key=lambda r: r["vec_id"])]
    assert values == sorted(values) or values == sorted(values, reverse=True)


def test_whitening_of_odd_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert make([]) == []
    assert make([(1, None, None, None)]) == []
    one = make([(1, [0.5, 0.25], "a", 1), (1, [0.5, 0.25], "a", 1), (None, [0.5, 0.25], "a", 1)])  # no variance at all
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] == 0 and r["n"] == 1 and r["deviation"] == 0 for r in one)
    flat = make([(i, [float(i), 1.0, 1.0], "a", 1) for i in range(5)])  # one component has variance
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True), (3, True)}
    assert {round(r["explained"], 12) for r in flat if r["component"] == 1} == {1.0}
    far = make([(0, [3e38, 0.0], "a", 1), (1, [-3e38, 1.0], "a", 1), (2, [0.0, 0.0], "a", 1)])  # beyond 64 bits
    assert len(far) == 6 and {r["deviation"] for r in far if r["vec_id"] != 2} == {None}
    sums = [(i, [float(2**40 * (i + 1)), -float(2**40)], "a", 1) for i in range(3)]  # sums of squares over 64 bits
    assert [r["deviation"] for r in make(sums) if r["vec_id"] == 1] == [0, 0]


# -- resampling ------------------------------------------------------------------------------------------------------------


def brute_resampling(rows, target, longest=1, buckets=10_000, share=10, least=20, seed=2024):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    own, other = Counter(), Counter()
    for _, text in rows:
        own.update(features(text)[1])
    for text in target:
        other.update(features(text)[1])
    s_all, t_all = sum(own.values()) + buckets, sum(other.values()) + buckets
    gain = [math.floor(1000 * math.log((other[b] + 1) * s_all / ((own[b] + 1) * t_all))) for b in range(buckets)]
    scored = []
    for key, text in rows:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        scored.append((key, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0] or 0))
    ranks = {id(x): i + 1 for i, x in enumerate(fit[: share * len(fit) // 100])}
    return Counter((key, n, weight, score, ranks.get(id(x))) for x in scored for key, _, n, weight, score in [x])


def some_texts(n, seed=3):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    return [" ".join(rnd.choice(vocabulary[: rnd.choice([20, 400])]) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest,buckets,share", [(1, 10_000, 10), (3, 500, 37)])
def test_resampling_is_brute_force(spark, longest, buckets, share):
    texts = [*ODD, None, *some_texts(400), *["the very same words again and " * 5] * 200]
    target = [None, "", "W1 w2 w3", "w4 w5 w6 w7 the words again"]
    frame = docs(spark, texts).withColumn("score", F.lit("x")).withColumn("rank", F.lit(0)).repartition(7)
    found = resample.resample(frame, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string"), longest=longest, buckets=buckets, share=share)
    assert Counter(map(tuple, found.collect())) == brute_resampling(list(enumerate(texts)), target, longest, buckets, share)


def test_resampling_of_odd_tables(spark):
    target = spark.createDataFrame([(0, "w1 w2")], "item_id int, text string")
    assert resample.resample(docs(spark, []), target).collect() == []
    assert resample.resample(docs(spark, [None, ""]), target.limit(0)).select("n_features", "weight", "rank").collect() == [(0, 0, None)] * 2
    same = spark.createDataFrame([(7, "word " * 30)] * 60 + [(None, "word " * 30)] * 40, "doc_id bigint, text string")  # ties and null ids
    found = resample.resample(same, target, share=50).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 51)) and len(found) == 100


def test_resampling_is_the_sql(spark):
    assert compare(spark, connection(SF), SF, llm_queries.op12_importance_resampling, llm_queries.ORACLE_SQL["op12_importance_resampling"]) == ""


def test_scoring_neither_explodes_nor_shuffles(spark):
    rows = resample.bucketed(docs(spark, ["a b"]), "text", 1, 10)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan


# -- online packing --------------------------------------------------------------------------------------------------------


def checked(rows, texts, capacity, name="byte_bpe_50k.json"):
    """Each id in one piece, sequences gapless and within bounds; gives their lengths."""
    library = tokenizers.Tokenizer.from_file(tokenizer(name))
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        ids = want[r["doc_id"]]
        own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(ids) and r["length"] == len(own) > 0 and r["ids_crc32"] == zlib.crc32(own.tobytes())
    assert set(pieces) == set(want)
    for key, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(want[key])
    out = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        out.append(at)
    return out


@pytest.mark.parametrize("capacity,windows,parts", [(64, 4, 3), (100, 1, 5), (1024, 32, 8), (7, 3, 2), (1, 2, 2)])
def test_online_packing_holds_every_id_once_without_padding(spark, capacity, windows, parts):
    texts = [*ODD[:7], None, "long text of many words " * 300, *some_texts(150), *["again and again"] * 90]
    frame = docs(spark, texts).withColumn("length", F.lit(0)).withColumn("ids", F.lit("x")).repartition(parts)
    lengths = checked(online_packing.pack_online(frame, tokenizer("byte_bpe_50k.json"), capacity, windows=windows).collect(), texts, capacity)
    assert all(n == capacity or n & (n - 1) == 0 for n in lengths)
    assert sum(n < capacity for n in lengths) <= capacity.bit_length()


def test_windows_with_little_room_can_be_left(spark):
    texts = some_texts(200)
    rows = online_packing.pack_online(docs(spark, texts).repartition(3), tokenizer("byte_bpe_50k.json"), 128, windows=3, least_cut=16).collect()
    lengths = checked(rows, texts, 128)
    assert all(n > 112 or n & (n - 1) == 0 for n in lengths)


def test_open_windows_take_the_best_fit():
    state = online_packing.OpenWindows(10, 2)
    ids = memoryview(bytes(40))
    placed = lambda rows: [(r[5], r[6], r[0], r[2]) for r in rows]
    state.add("a", ids[: 4 * 6])
    state.add("b", ids[: 4 * 7])
    state.add("c", ids[: 4 * 3])  # fills the second, which has the least room
    assert placed(state.emitted) == [(0, 0, "b", 7), (0, 7, "c", 3)]
    state.add("d", ids[: 4 * 5])
    state.add("e", ids[: 4 * 8])  # none has room: the fullest, a's, takes the head
    assert placed(state.emitted[2:]) == [(1, 0, "a", 6), (1, 6, "e", 4)]
    assert [(p[0], p[1], len(p[2]) // 4) for p in state.left()] == [("d", 0, 5), ("e", 4, 4)]


def test_online_packing_of_nothing(spark):
    assert online_packing.pack_online(docs(spark, []), tokenizer("byte_bpe_50k.json")).collect() == []
    with pytest.raises(ValueError):
        online_packing.pack_online(docs(spark, []), tokenizer("byte_bpe_50k.json"), windows=0)
    twice = spark.createDataFrame([(None, "a b")] * 3 + [(5, None)], DOCS.split(", lang")[0])
    rows = online_packing.pack_online(twice, tokenizer("byte_bpe_50k.json")).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in rows} == {(None, 3), (5, 1)} and sum(r["length"] for r in rows) == 10
