"""Secrets in texts, told apart by how widely their values are owned. DataFrame functions only.

Base spans come from three fixed patterns. Besides, long tokens of mixed letters and digits are candidates of a further kind.
The values of all spans and candidates are hashed and counted over the corpus by distinct repositories and owners, and both
counts class a value: an *example* is copied around (many owners, or few owners but many repositories, as forks are), a *live*
one belongs to a single owner, however often; what lies between is *shared*. Live candidates are added to the spans; base
spans always stay, and are counted by class. Examples are not masked, all others are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered, unused_name

# The base kinds in their order, with least lengths (of the value for assign, else of the match), and the
# further kind. A candidate is looked at only if it has a digit and a capital or small letter and no base span touches it.
KINDS = ("assign", "access", "hex", "token")
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "token": r"[A-Za-z0-9_-]{24,}",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 24}
#: A text without this has no match of the kind.
HINT = {"assign": "[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}", "token": r"(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{24}"}
#: Owners from which a value counts as a copied example; repositories from which it does if it has two owners.
WIDE, FORKED = 3, 6
#: Code points of the blocks that a text is cut from.
BLOCK = 1024


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: inside a lambda, whatever isn't a variable is computed for every element."""
    return F.transform(F.array(value), use)[0]


def running(values: Column, step, none: Column) -> Column:
    """Running sums, or what else ``step`` joins (``none`` at the start), by doubling distances: n log n steps, where appending to an array would take n squared."""

    def of(held: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(held).cast("double"))).cast("int") - 1)
        shifts = F.transform(rounds, lambda k: F.call_function("shiftleft", F.lit(1), k))
        return F.when(F.size(held) > 1, F.aggregate(shifts, held, lambda own, shift: F.transform(own, lambda x, i: step(x, F.coalesce(F.get(own, i - shift), none))))).otherwise(held)

    return bound(values, of)


def matches(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind as array of (start, end, value), in code points, those too short left out.

    SQL has no positions of all matches, so the text is also split by the pattern: matches and the stretches between them
    take turns, and their lengths add up to positions.
    """
    rx = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, rx, F.lit(0))
    value = F.regexp_extract_all(text, rx, F.lit(1)) if kind == "assign" else whole
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.char_length)
    parts = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("size"), value.alias("value"))

    def placed(held: Column) -> Column:
        ends = running(F.transform(held, lambda p: p["gap"] + F.coalesce(p["size"], F.lit(0))), lambda a, b: a + b, F.lit(0))
        sound = F.filter(F.arrays_zip(ends.alias("end"), held.alias("part")), lambda p: F.char_length(p["part"]["value"]) >= LEAST[kind])
        return F.transform(sound, lambda p: F.struct((p["end"] - p["part"]["size"]).alias("start"), p["end"].alias("end"), p["part"]["value"].alias("value")))

    return F.when(text.rlike(HINT[kind]), bound(parts, placed)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _numbered(found: Column | str, number: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def _count(test) -> Column:
    return F.size(F.filter("found", test)).cast("long")


def _of_kind(number: int) -> Column:
    return _count(lambda x: x["kind"] == number)


def _of_class(name: str) -> Column:
    return _count(lambda x: x["class"] == name)


def spans_of(text: Column) -> Column:
    """Array of (start, kind number, end, value) in that order. Tokens that touch a base span or lack digits or letters are left out."""
    base = F.concat(*(_numbered(matches(text, kind), k) for k, kind in enumerate(KINDS[:3])))
    mixed = F.filter(matches(text, KINDS[3]), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))
    free = lambda bases: F.filter(mixed, lambda x: ~F.exists(bases, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"])))
    return bound(base, lambda b: F.array_sort(F.concat(b, _numbered(free(b), 3))))


def place_of(columns: list[str]) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def hashed_spans(text_col: str) -> Column:
    found = spans_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("hash")))


def class_of(owners: Column, repositories: Column) -> Column:
    """live, shared or example, by how many owners and repositories hold a value."""
    return F.when((owners >= WIDE) | ((owners > 1) & (repositories >= FORKED)), "example").when(owners > 1, "shared").otherwise("live")


def owned_spans(rows: DataFrame) -> DataFrame:
    """``row`` and its ``found`` (start, kind, end, owners, repositories, class) from a written table (``row``, ``repo``, ``owner``, ``found`` with hashes): base spans, and tokens that are live. Rows without any have none here."""
    each = rows.filter(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("s")).select("row", "repo", "owner", "s.*")
    # distinct places first, on the map side too: a copied value leaves each task once for each place
    places = each.select("hash", "repo", "owner").distinct()
    owned = places.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    known = each.join(owned, "hash").withColumn("class", class_of(F.col("owners"), F.col("repositories")))
    kept = known.filter((F.col("kind") < 3) | (F.col("class") == "live"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "class"))).alias("found"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: list[str] | None = None, owner: list[str] | None = None) -> DataFrame:
    """A row for each row of ``df``: ``id_col``, ``found`` (start, kind, end, ``owners``, ``repositories``, ``class``), base spans all, tokens only where live.

    ``repository`` and ``owner`` name the columns that say where a text comes from; null ones count as one more place.
    Null and empty texts have no spans. Repeated rows are kept, and count once. Values go on as hashes only.
    """
    made = df.select(F.col(id_col).alias("id"), place_of(repository or [id_col]).alias("repo"), place_of(owner or ["source"]).alias("owner"), hashed_spans(text_col).alias("found"))
    # written once: two passes over spans are cheaper than two over texts, and the row numbers stay as they are
    rows = numbered(made, "row", "secrets")
    back = owned_spans(rows)
    empty = F.array().cast(back.schema["found"].dataType)
    return rows.select("row", "id").join(back, "row", "left").select(F.col("id").alias(id_col), F.coalesce("found", empty).alias("found"))


def shown(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of scan(): also the number of spans of each class, and the most owners and repositories of a value (null without spans)."""
    base = F.filter("found", lambda x: x["kind"] < 3)
    return scanned.select(
        id_col,
        *(_of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:3])),
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
        *(_of_class(c).alias(f"n_{c}") for c in ("live", "shared", "example")),
        *(F.array_max(F.col("found")[c]).alias(f"most_{c}") for c in ("owners", "repositories")),
    )


def masked(text: Column, found: Column, mask: str) -> Column:
    """``text`` with spans (in order, some may overlap) replaced. Cut from blocks, so that a text of many spans takes time in proportion."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(held: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK).cast("int")
        part = F.array_join(F.slice(held, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(part, start % BLOCK + 1, end - start)).otherwise("")

    def joined(held: Column, ends: Column) -> Column:
        # ends: of the spans so far
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        parts = F.transform(found, lambda x, i: F.when(x["start"] >= before(i), F.concat(cut(held, before(i), x["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(held, F.element_at(ends, -1), F.char_length(text)))

    ends = running(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
    return bound(F.struct(blocks.alias("blocks"), ends.alias("ends")), lambda b: joined(b["blocks"], b["ends"]))


def redacted(df: DataFrame, text_col: str = "text", repository: list[str] | None = None, owner: list[str] | None = None, mask: str = "[secret]") -> DataFrame:
    """``df`` with the spans of scan() replaced by ``mask``, but for values that are copied examples. Rows and columns stay.

    Each row carries its own text and spans, so null and repeated ids don't matter. ``repository`` and ``owner`` as in scan();
    without ``repository`` each row is one.
    """
    names = {c: unused_name(df, f"__{c}") for c in ("row", "repo", "owner", "found")}
    repo = place_of(repository) if repository else F.monotonically_increasing_id()
    made = df.withColumns({names["repo"]: repo, names["owner"]: place_of(owner or ["source"]), names["found"]: hashed_spans(text_col)})
    rows = numbered(made, names["row"], "secrets")
    back = owned_spans(rows.select(*(F.col(n).alias(c) for c, n in names.items())))
    live = back.select(F.col("row").alias("__at"), F.filter("found", lambda x: x["class"] != "example").alias("__spans")).filter(F.size("__spans") > 0)
    plain = rows.filter(F.size(names["found"]) == 0).select(df.columns)
    # only rows that hold spans are shuffled
    marked = rows.filter(F.size(names["found"]) > 0).select(names["row"], F.struct(*(F.col(c) for c in df.columns)).alias("__own"))
    joined = marked.select(F.col(names["row"]).alias("__row"), "__own").join(live, F.col("__row") == F.col("__at"), "left")
    text = F.col("__own")[text_col]
    changed = F.when(F.col("__spans").isNotNull(), masked(text, F.col("__spans"), mask)).otherwise(text)
    return plain.unionByName(joined.select(*(changed.alias(c) if c == text_col else F.col("__own")[c].alias(c) for c in df.columns)))
