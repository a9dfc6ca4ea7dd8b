"""Main text of web pages, after removal of what a site repeats.

Two hashes stand for an element's subtree. The *content hash* covers its tags and texts. The *place hash* covers its tag, class,
id and role and those of all elements around it, with its texts masked: it stays the same where a slot is filled anew on
every page. Both are counted per host in Spark, over distinct pages (those whose texts, before any template goes, differ).

* Subtrees whose content hash stands on at least ``SHARE`` of a host's pages (and ``PAGES`` of them) are deleted.
* Slots are places that recur so often, that are named (by class, id or role) and hold no top heading. The host's text is traced
  from the page's root down: into the container that stands once on a page and holds most of the text around it. The article is
  what the first ``article`` or ``main`` on this way holds, or the smallest container on it that has the top heading, or
  else its end. Slots beside the article that hold little text compared with the way's end are deleted. Those inside it, such as a
  lead, a caption or a quotation, are text, unless their name says otherwise (``ASIDE``: comments, adverts, menus).

Hosts of fewer than ``PAGES`` distinct pages share their counts, as if they were one site. Besides, elements that HTML itself
defines as no article text (navigation, forms, scripts) go. What is left is the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices, texts_of

#: Share of a host's pages, and number of them, from which a subtree is a template's.
SHARE, PAGES = 0.5, 3
#: Part of the text around it that the way to the text has to keep, and part of the text from which a slot is no template.
MOST, SLOT = 0.5, 0.25

# Element names of HTML by their part.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select".split())
DROPPED = RAW | frozenset("head nav footer aside form button dialog menu audio video canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body div section article main form table tbody tr td center".split())
#: Words of class, id or role that say what is no article text, also where it stands inside the article.
ASIDE = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer login menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promotion related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription".split())
#: An open element of these ends when one of the others starts.
ENDS = {"p": BLOCKS - frozenset("html body".split()), "li": frozenset(["li"]), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr tbody tfoot".split()), "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "option": frozenset(["option"])}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[a-z]+")
#: The place around all elements.
ROOT = 0
#: What a place is: named, named by one of ASIDE, a container, an article, the whole document.
IS_NAMED, IS_ASIDE, IS_CONTAINER, IS_ARTICLE, IS_WHOLE = 1, 2, 4, 8, 16
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Template:
    """What goes on the pages of a host: content hashes, and places. Made from its recurring ones: ``subtrees``, and (path, parent, chars, most, kind, heading) for places."""

    def __init__(self, subtrees: Iterable[int] = (), places: Iterable[dict] = ()):
        self.subtrees = frozenset(subtrees)
        of = {p["path"]: p for p in places}
        below: dict[int, list[dict]] = {}
        for p in of.values():
            below.setdefault(p["parent"], []).append(p)
        way, chars = [ROOT], of[ROOT]["chars"] if ROOT in of else 0
        while inner := [p for p in below.get(way[-1], ()) if p["most"] == 1 and p["kind"] & IS_CONTAINER and p["chars"] >= MOST * chars]:
            p = max(inner, key=lambda p: (p["chars"], p["path"]))
            way.append(p["path"])
            chars = p["chars"]
        named = [k for k in way if k in of and of[k]["kind"] & IS_ARTICLE]
        within = [k for k in way if k in of and not of[k]["kind"] & IS_WHOLE]
        headed = [k for k in within if of[k]["heading"]]
        inside, todo = set(), (named[:1] or headed[-1:] or within[-1:])  # empty: nothing is known of the article's place
        while todo:
            inside.update(own := [p["path"] for p in below.get(todo.pop(), ())])
            todo += own
        small = [p for p in of.values() if p["kind"] & IS_NAMED and not p["heading"] and p["path"] not in way and p["chars"] <= SLOT * chars]
        self.places = frozenset(p["path"] for p in small if p["path"] not in inside or p["kind"] & IS_ASIDE)


class Page:
    """One pass over a page: hashes of subtrees and places, and the text that is left without what ``template`` names."""

    def __init__(self, html: str, template: Template | None = None):
        self.template = template or Template()
        self.hashes: set[int] = set()
        #: by place: the one around it, times, characters of text, its kind, whether it holds a top heading
        self.places: dict[int, list] = {ROOT: [None, 1, 0, IS_CONTAINER | IS_WHOLE, False]}
        self.out: list[str | None] = []  # None ends a block
        #: open elements: name, first of its output, parts of its hash, whether it goes, its place, characters, whether a heading is inside
        self.open: list[list] = [["", 0, [], False, ROOT, 0, False]]
        self.counts: dict[str, int] = {}
        at, last = 0, html.rfind(">") + 1  # no tag ends behind it
        while m := TOKEN.search(html, at, last):
            self.text(html[at : m.start()])
            at = m.end()
            if not (name := (m[1] or "").lower()):
                continue
            if m[0][1] == "/":
                if name == "br":
                    self.text(" ")
                elif self.counts.get(name):
                    while self.close() != name:
                        pass
                continue
            self.start(name, m[2])
            if name in RAW and not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(html, at)
                at = end.end() if end else len(html)
                self.close()
        rest = html[at:]
        self.text(rest[: rest.find("<!--")] if "<!--" in rest else rest)
        while len(self.open) > 1:
            self.close()
        self.places[ROOT][2] = self.open[0][5]

    def text(self, raw: str) -> None:
        if raw:
            clean = unescape(raw) if "&" in raw else raw
            self.out.append(clean)
            if not clean.isspace():
                self.open[-1][2].append(words := " ".join(clean.split()))
                self.open[-1][5] += len(words)

    def start(self, name: str, attributes: str) -> None:
        while (top := self.open[-1][0]) in ENDS and name in ENDS[top]:
            self.close()
        # a paragraph also ends below inline elements that were left open
        if name in ENDS["p"] and self.counts.get("p"):
            below = next((k for k in range(len(self.open) - 1, 0, -1) if self.open[k][0] in BLOCKS), 0)
            if self.open[below][0] == "p":
                while self.close() != "p":
                    pass
        if name in BLOCKS:
            self.out.append(None)
        elif name == "br":
            self.out.append(" ")
        if name in VOID or attributes.endswith("/"):
            self.open[-1][2].append(f"<{name}>")
            return
        names = " ".join(sorted(f"{m[0].lower()}={DIGITS.sub('0', ' '.join(sorted(''.join(m[1:]).lower().split())))}" for m in NAMED.findall(attributes))) if attributes else ""
        around = self.open[-1][4]
        place = hash_of(f"{around} {name} {names}")
        if (held := self.places.get(place)) is None:
            kind = IS_NAMED * bool(names) | IS_ASIDE * (not ASIDE.isdisjoint(WORDS.findall(names))) | IS_CONTAINER * (name in CONTAINERS) | IS_ARTICLE * (name in ("article", "main")) | IS_WHOLE * (name in ("html", "body"))
            held = self.places[place] = [around, 0, 0, kind, False]
        held[1] += 1
        inside = self.counts.get("article") or self.counts.get("main")
        goes = name in DROPPED or (name == "header" and not inside) or place in self.template.places
        self.open.append([name, len(self.out), [name], goes, place, 0, name == "h1"])
        self.counts[name] = self.counts.get(name, 0) + 1

    def close(self) -> str:
        name, first, parts, goes, place, chars, heading = self.open.pop()
        self.counts[name] -= 1
        own = hash_of("\0".join(parts))
        top = self.open[-1]
        top[2].append(str(own))
        if len(parts) > 1 and name not in ("html", "body"):
            self.hashes.add(own)
            goes = goes or own in self.template.subtrees
        if name == "form" and heading:
            goes = False  # it holds the page, not an input
        if name not in DROPPED or not goes:
            top[5] += chars
            top[6] = top[6] or heading
            self.places[place][2] += chars
            self.places[place][4] |= heading
        if goes:
            del self.out[first:]
        if name in BLOCKS:
            self.out.append(None)
        return name

    def result(self) -> str:
        blocks, own = [], []
        for part in [*self.out, None]:
            if part is not None:
                own.append(part)
            elif own:
                if words := "".join(own).split():
                    blocks.append(" ".join(words))
                own = []
        return "\n\n".join(blocks)


SUBTREES = "host string, page long, copy long, subtrees array<long>, places array<struct<path:long,parent:long,times:int,chars:long,kind:int,heading:boolean>>"


def subtrees(pages: DataFrame, html_col: str) -> DataFrame:
    """For each page its ``host``, hashes of its text (``page``) and html (``copy``), its ``subtrees`` and its ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("path", pa.int64()), ("parent", pa.int64()), ("times", pa.int32()), ("chars", pa.int64()), ("kind", pa.int32()), ("heading", pa.bool_())]))
        for batch in slices(batches, html_col):
            rows = []
            for host, html in zip(batch.column("host").to_pylist(), texts_of(batch.column(html_col)), strict=True):
                page = Page(html)
                rows.append((host, hash_of(page.result()), hash_of(html), sorted(page.hashes), [{"path": k, "parent": v[0], "times": v[1], "chars": v[2], "kind": v[3], "heading": v[4]} for k, v in page.places.items()]))
            types = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), place)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["host", "page", "copy", "subtrees", "places"])

    return pages.mapInArrow(run, SUBTREES)


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """``host`` and its ``site`` (itself, or '' for hosts of few pages); ``site`` with its recurring ``subtrees`` and ``places``.

    A site has fewer of these than 1 / SHARE pages have elements, however many pages it has. Pages of one host and one text are
    copies and count as one, whose elements are those of the copy with the smallest hash.
    """
    hosted = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias(html_col))
    each = materialize(subtrees(hosted, html_col), "subtrees")
    # copies are told by hashes alone; only the chosen ones' elements are read again
    first = each.groupBy("host", "page").agg(F.min("copy").alias("copy"))
    sizes = first.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    sites = materialize(sizes.select("host", F.when((F.col("n") >= PAGES) & (F.col("host") != ""), F.col("host")).otherwise("").alias("site"), "n"), "sites")
    distinct = materialize(each.join(first, ["host", "page", "copy"]).join(sites.select("host", "site"), "host").groupBy("site", "host", "page").agg(F.first("subtrees").alias("subtrees"), F.first("places").alias("places")).select("site", "subtrees", "places"), "distinct-pages")
    totals = sites.groupBy("site").agg(F.sum("n").alias("pages")).filter(F.col("pages") >= PAGES)
    keys = distinct.select("site", F.explode(F.concat(F.transform("subtrees", lambda h: F.struct(F.lit(0).alias("kind"), h.alias("path"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("times"), F.lit(0).cast("long").alias("chars"), F.lit(0).alias("kind_of"), F.lit(False).alias("heading"))), F.transform("places", lambda p: F.struct(F.lit(1).alias("kind"), p["path"].alias("path"), p["parent"].alias("parent"), p["times"].alias("times"), p["chars"].alias("chars"), p["kind"].alias("kind_of"), p["heading"].alias("heading"))))).alias("e")).select("site", "e.*")
    counted = keys.groupBy("site", "kind", "path").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"), F.max("times").alias("most"), F.sum("chars").alias("chars"), F.max("kind_of").alias("kind_of"), F.bool_or("heading").alias("heading")).filter(F.col("n") >= PAGES)
    often = counted.join(totals, "site").filter(F.col("n") >= SHARE * F.col("pages"))
    kept = often.groupBy("site").agg(F.collect_list(F.when(F.col("kind") == 0, F.col("path"))).alias("subtrees"), F.collect_list(F.when(F.col("kind") == 1, F.struct("path", "parent", "most", "chars", F.col("kind_of").alias("kind"), "heading"))).alias("places"))
    return sites.select("host", "site"), materialize(kept, "templates")


def host_of(url_col: str):
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col).cast("string")), HOST, 1), F.lit(""))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with ``text_col``: blocks in page order, joined by an empty line.

    Null and empty html give an empty text, as does a page without article text. Pages without a host (null or odd url) count
    with the hosts of few pages. Repeated rows are kept; they and other copies of a text count as one page of a host. A
    column named as the new one is replaced.
    """
    sites, found = templates(pages, url_col, html_col)
    fields = [f for f in pages.schema.fields if f.name not in (html_col, text_col)]
    schema = T.StructType([*fields, T.StructField(text_col, T.StringType())])
    kept = [f.name for f in fields]
    of_host = sites.join(found, "site").select(F.col("host").alias("__host"), F.struct("subtrees", "places").alias("__template"))
    rows = pages.select(F.struct(*(F.col(c) for c in kept)).alias("__own"), F.col(html_col).cast("string").alias("__html"), host_of(url_col).alias("__at"))
    rows = rows.join(of_host, F.col("__at") == F.col("__host"), "left").select("__own", "__html", "__at", "__template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Template] = {}
        for batch in slices(batches, "__html"):
            texts, column = [], batch.column("__template")
            for k, (host, html) in enumerate(zip(batch.column("__at").to_pylist(), texts_of(batch.column("__html")), strict=True)):
                if host not in made:
                    if len(made) > 1000:
                        made.clear()
                    made[host] = Template(**(column[k].as_py() or {}))
                texts.append(Page(html, made[host]).result())
            own = batch.column("__own")
            yield pa.RecordBatch.from_arrays([*(own.field(k) for k in range(len(kept))), pa.array(texts, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
