"""Functions of vertex arrays and of feature vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of a subset's number that one array lists; larger sets are listed in two steps.
LISTED = 12
#: Bits of a word of a mask.
MASK_BITS = 62


def key_of(vertices: Column | str) -> Column:
    """Vertex array as text, such as 3-5-8."""
    return F.array_join(F.transform(vertices, lambda v: v.cast("string")), "-")


def subset_numbers(n: Column) -> tuple[Column, Column]:
    """Two arrays, of high and of low parts, that together number all subsets of ``n`` things, the empty one included."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
    low = F.least(n, F.lit(LISTED))
    upto = lambda k: F.sequence(F.lit(0).cast("bigint"), power(k) - 1)
    return F.transform(upto(n - low), lambda h: h * (1 << LISTED)), upto(low)


def subset(vertices: Column, number: Column) -> Column:
    return F.filter(vertices, lambda v, i: F.call_function("shiftright", number, i).bitwiseAND(1) == 1)


def facets(vertices: Column) -> Column:
    """Structs of each subset that lacks one vertex: ``pos`` of the missing one and ``face``; none for a single vertex."""
    places = F.when(F.size(vertices) > 1, F.sequence(F.lit(0), F.size(vertices) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda p: F.struct(p.alias("pos"), F.filter(vertices, lambda v, i: i != p).alias("face")))


def full_mask(dim: Column) -> Column:
    """Mask of a node whose facets are all linked: words of MASK_BITS bits, the lowest first, so a node may have any number of vertices. A vertex has [0]."""
    ones = (1 << MASK_BITS) - 1
    last = F.call_function("shiftleft", F.lit(1).cast("bigint"), dim % MASK_BITS + 1) - 1
    words = F.transform(F.sequence(F.lit(0), F.floor(dim / MASK_BITS).cast("int")), lambda w: F.when(w < F.floor(dim / MASK_BITS), F.lit(ones)).otherwise(last))
    return F.when(dim == 0, F.array(F.lit(0))).otherwise(words).cast("array<bigint>")


def no_bits(mask: Column | str) -> Column:
    return ~F.exists(mask, lambda w: w != 0)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def leaky_relu(x: Column, slope: float = 0.01) -> Column:
    return F.transform(x, lambda v: F.when(v < 0, v * slope).otherwise(v))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def times(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def scaled(a: Column, c: Column | float) -> Column:
    return F.transform(a, lambda p: p * c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(times(a, b), F.lit(0.0), lambda s, v: s + v)


def norm_of_difference(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda p, q: (p - q) * (p - q))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v))


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(x, lambda v: v - top - total)


def arg_max(x: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """x times a small weight matrix (rows: inputs), plus a bias."""
    columns = list(zip(*weights, strict=True))
    out = [dot(x, F.array(*map(F.lit, map(float, c)))) for c in columns]
    if bias:
        out = [o + float(b) for o, b in zip(out, bias, strict=True)]
    return F.array(*out)
