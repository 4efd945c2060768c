"""Operator 10, main text of HTML pages by removal of site templates.

A page is read once, tag by tag, in time linear in its length. Every element subtree of the whole page, menus and footers
included, is hashed from its tags, its texts and the hashes below it (only paragraphs, list items and so on inside an article
are left out: they are its text even if pages share them). Spark counts on how many different pages of a host each hash
stands; subtrees on MANY pages or more are deleted, however large the host. Classes and ids that speak of menus, adverts,
comments and so on are counted as well, as slots (tag, classes, id): what stands in a slot often differs from page to page,
so on a host of ENOUGH different pages or more a slot of that kind goes if MANY pages of the host, or of all hosts, have it, and
stays otherwise. Only where a host has fewer pages, so that counts settle nothing, such classes are believed as they are, and
if there is an <article> or <main>, only its text is taken. Elements that by their tag, role or `hidden` are no text of an
article (navigation, footers, forms, scripts) go everywhere.

Two pages of a host are different if their articles are (without one: their texts outside such slots), so that copies of a page never delete
each other.

Cases: null is the empty page; text without any tag is one block; unclosed and stray tags are tolerated, a quote that is never
closed is an ordinary character; null URLs share one host; equal rows give equal rows; an empty table gives no rows; other
columns are ignored."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A subtree is a template, and a slot part of the site, if it stands on so many different pages of its host.
MANY = 10
#: Different pages of a host from which on the counts settle what classes and ids are about.
ENOUGH = 10
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|(!--)|[!?])")
_IN_TAG = re.compile(r">|=\s*+([\"'])")
_MARKS = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
DROPPED = frozenset("nav footer aside form head menu button select dialog svg math object canvas audio video template fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CLASS_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
COMMENTS, HEADERS = frozenset("comment comments disqus reply replies".split()), frozenset({"header"})
#: Words that with one of CLASS_WORDS still name the same part of a site: next to "header" only the first, since other headers have titles.
AROUND = frozenset("site main top global mobile desktop sticky fixed wrapper wrap container inner outer".split())
BESIDE = AROUND | frozenset("page post user reader bottom left right upper lower primary secondary local google fb box bar block area panel row col column list lists item items link links button buttons btn icon icons posts articles stories news products content body text form slot unit zone thread section tools logo copyright".split())
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
#: Elements that a new one of the same kind closes.
_CLOSES = {t: frozenset({t}) for t in ("p", "li", "tr", "option")} | {"dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"})}
#: Elements beyond which nothing is closed by implication.
FENCES = frozenset("ul ol dl table article section div main body".split())


def _telling(names: str) -> set[str]:
    """CLASS_WORDS in those classes or ids that have no word but these and BESIDE."""
    found = set()
    for name in names.split():
        words = set(_WORDS.findall(name))
        if (hits := words & CLASS_WORDS) and words - hits <= (AROUND if hits == HEADERS else BESIDE):
            found |= hits
    return found


class Hint(NamedTuple):
    """How an element's start tag tells that it is no main text."""

    level: int = 0  # 1: but an article in it is; 2: nor is an article in it; 3: but its headings are, if it is in an article
    told_by_name: bool = False  # by its class or id only


_NONE, _TAGGED, _HEADER = Hint(), Hint(2), Hint(3)


def _hint(tag: str, attributes: str, in_article: bool) -> Hint:
    if tag in DROPPED:
        return _TAGGED
    if tag == "header":
        return _HEADER if in_article else Hint(1)
    if not attributes or tag in ("html", "body", "main"):
        return _NONE
    heading = tag in HEADINGS
    found = set()
    role = False
    for name, *values in _MARKS.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return _TAGGED
        role = role or name == "role" and value in ROLES
        if name == "class" and not (heading and in_article) or name == "id" and not heading:
            found |= _telling(value)
    if role:
        return Hint(1)
    if found & COMMENTS:
        return Hint(2, True)
    return _NONE if not found or tag == "article" else Hint(3, True) if found == HEADERS and in_article else Hint(1, True)


def _slot(tag: str, attributes: str) -> int:
    """A number for the tag with its classes and id, digits apart."""
    named = sorted(re.sub(r"[0-9]+", "0", f"{name.lower()}={word}") for name, *values in _MARKS.findall(attributes) if name.lower() in ("class", "id") for word in "".join(values).split())
    return xxhash.xxh3_64_intdigest(" ".join([tag, *named]).encode("utf-8", "surrogatepass"), seed=1) - 2**63


class Block(NamedTuple):
    text: str
    main: bool  # in an <article> or <main>
    gone: bool  # no main text, by tag, role or `hidden`
    slot: int | None  # no main text by the class or id of this slot


class _State(NamedTuple):
    """What holds inside the open elements."""

    level: int = 0
    slot: int | None = None  # of `level`; None: by tag
    mains: int = 0
    titles: bool = False  # in a header of an article, of which only headings count
    titles_slot: int | None = None
    heading: bool = False
    mute: bool = False  # in an unwanted inline element


class _Page:
    def __init__(self, source: str) -> None:
        self.source = source
        self.blocks: list[Block] = []
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, end block
        self.state = _State()
        self.stack: list[tuple[str, _State, int, xxhash.xxh3_64]] = []  # tag, state before, first block, hash so far
        self.open = Counter()
        self.inline: list[str] = []
        self.root = xxhash.xxh3_64()
        self._read()

    def _hash(self) -> xxhash.xxh3_64:
        return self.stack[-1][3] if self.stack else self.root

    def _flush(self) -> None:
        if self.inline:
            text = " ".join(html.unescape("".join(self.inline)).split())
            self.inline.clear()
            if text:
                s = self.state
                header = s.titles and not s.heading
                named = [x for on, x in ((s.level > 0, s.slot), (header, s.titles_slot)) if on]
                self._hash().update(b"\n" + text.encode("utf-8", "surrogatepass"))
                self.blocks.append(Block(text, s.mains > 0, None in named, named[0] if named and None not in named else None))

    def _push(self, tag: str, state: _State) -> None:
        self.stack.append((tag, self.state, len(self.blocks), xxhash.xxh3_64(tag.encode())))
        self.open[tag] += 1
        self.state = state

    def _pop(self) -> None:
        if self.stack[-1][0] in BLOCKS:
            self._flush()
        tag, before, first, digest = self.stack.pop()
        self.open[tag] -= 1
        own = digest.intdigest()
        self._hash().update(own.to_bytes(8, "little"))
        if tag in BLOCKS and first < len(self.blocks) and tag not in ("html", "body", "main", "article") and not (before.mains and tag in TEXT_BLOCKS):
            self.subtrees.append((own - 2**63, first, len(self.blocks)))
        self.state = before

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._close_implied(tag)
            self._flush()
        if tag == "br":
            self.inline.append(" ")
        if tag in VOID:
            self._hash().update(tag.encode())
            return
        s = self.state
        hint = _hint(tag, attributes, s.mains > 0)
        if block:
            s = s._replace(mute=False, heading=s.heading or tag in HEADINGS)
        elif hint.level:
            s = s._replace(mute=True)
        if tag in ("article", "main") and not hint.level:
            s = s._replace(mains=s.mains + 1, titles=False, titles_slot=None, heading=False)
            if s.level < 2:
                s = s._replace(level=0, slot=None)
        elif hint.level == 3:
            s = s._replace(titles=True, titles_slot=_slot(tag, attributes) if hint.told_by_name else None, heading=False)
        elif hint.level and (not s.level or s.slot is not None and not hint.told_by_name or hint.level > s.level):
            s = s._replace(level=max(s.level, hint.level), slot=_slot(tag, attributes) if hint.told_by_name and block and (not s.level or s.slot is not None) else None)
        if block or hint.level or self.open[tag]:  # other inline elements bound nothing
            self._push(tag, s)
        else:
            self._hash().update(tag.encode())

    def _end(self, tag: str) -> None:
        if self.open[tag]:
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()
        elif tag in BLOCKS:
            self._flush()

    def _close_implied(self, tag: str) -> None:
        """Closes what a new block implies: an open paragraph, or the item that a new item follows, but nothing beyond their container."""
        wanted = _CLOSES.get(tag, frozenset()) | {"p"}
        if any(self.open[t] for t in wanted):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in wanted:
                    while len(self.stack) > k:
                        self._pop()
                    return
                if name in FENCES and not (name == "table" and tag == "tr"):
                    return

    def _text(self, a: int, b: int) -> None:
        """Text of an unwanted inline element goes for good, but still counts in the hash."""
        if a < b:
            if self.state.mute:
                self._hash().update(self.source[a:b].encode("utf-8", "surrogatepass"))
            else:
                self.inline.append(self.source[a:b])

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`. Once quotes lead beyond the end of the page, they count no more, so that a page is scanned twice at most."""
        k = at
        while self.quoted:
            m = _IN_TAG.search(self.source, k)
            if m and not m[1]:
                return m.end()
            k = self.source.find(m[1], m.end()) + 1 if m else 0
            self.quoted = k > 0
        return self.source.find(">", at) + 1 or len(self.source)

    def _read(self) -> None:
        page, at, last = self.source, 0, self.source.rfind(">")
        self.quoted = True
        while at < len(page):
            m = _OPEN.search(page, at)
            if not m or m.start() > last:  # what no ">" follows is no tag
                self._text(at, len(page) if not m or not m[3] else m.start())
                break
            self._text(at, m.start())
            if m[3]:
                at = page.find("-->", m.start() + 2) + 3
                at = at if at > 2 else len(page)
                continue
            if not m[2]:
                at = page.find(">", m.end()) + 1
                continue
            at, tag = self._tag_end(m.end()), m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                over = _RAW_END[tag].search(page, at)
                at = over.end() if over else len(page)
            else:
                self._start(tag, page[m.end() : at])
        while self.stack:
            self._pop()
        self._flush()


def parse_page(source: str | None) -> tuple[list[Block], list[tuple[int, int, int]]]:
    """All blocks of text of a page, and (hash, first block, end block) of its subtrees."""
    page = _Page(source or "")
    return page.blocks, page.subtrees


def main_text(blocks: list[Block], marks: list[dict]) -> list[str]:
    """The blocks that stay. marks: ranges (first, end) of templates (t) and of slots that are part of the site (s); h if the host's counts settle what is."""
    settled = any(m["kind"] == "h" for m in marks)
    edges = [0] * (len(blocks) + 1)  # templates that start less those that end
    for m in marks:
        if m["kind"] != "h":
            edges[m["first"]] += 1
            edges[m["end"]] -= 1
    kept = [b for b, cut in zip(blocks, accumulate(edges), strict=False) if not cut and not b.gone and (settled or b.slot is None)]
    only_main = not settled and any(b.main for b in kept)
    return [b.text for b in kept if b.main or not only_main]


def read_page(source: str | None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The main text of a page by itself, without counts, in blocks; and its subtrees."""
    blocks, subtrees = parse_page(source)
    return main_text(blocks, []), subtrees


def _digest(source: str) -> bytes:
    return xxhash.xxh3_128_digest(source.encode("utf-8", "surrogatepass"))


def _with_host(df: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return df.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))


def _by_parts(rows: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """fn on 500 rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield fn(batch.slice(at, 500))

    return rows.mapInArrow(run, schema)


def parsed(df: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Of each page its host, a digest of it and one of its main text, its subtrees, and the slots of its blocks (0 where none)."""

    def read(part: pa.RecordBatch) -> pa.RecordBatch:
        tree = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])
        sources = part.column(1).to_pylist()
        found = [parse_page(s) for s in sources]
        content = [xxhash.xxh3_64_intdigest("\n".join(main_text(blocks, [])).encode("utf-8", "surrogatepass")) - 2**63 for blocks, _ in found]
        slots = [[b.slot or 0 for b in blocks] if any(b.slot for b in blocks) else [] for blocks, _ in found]
        trees = [[{"hash": h, "first": a, "end": b} for h, a, b in trees] for _, trees in found]
        columns = [part.column(0), pa.array(map(_digest, sources), pa.binary()), pa.array(content, pa.int64()), pa.array(trees, pa.list_(tree)), pa.array(slots, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["host", "page", "content", "subtrees", "slots"])

    rows = _with_host(df, page_id, url, page).select("host", "html")
    return _by_parts(rows, "host STRING, page BINARY, content BIGINT, subtrees ARRAY<STRUCT<hash: BIGINT, first: INT, end: INT>>, slots ARRAY<BIGINT>", read)


def site_counts(read: DataFrame, many: int = MANY, enough: int = ENOUGH) -> DataFrame:
    """host, kind, key: subtrees (t) and slots (s) that are part of the site, and hosts (h, key 0) of enough different pages. Rows of a hot host meet in partial aggregates only."""
    none = F.array().cast("array<struct<kind:string,key:bigint>>")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.cast("bigint").alias("key"))
    every = F.concat(F.array(key("h", F.lit(0))), F.transform("subtrees", lambda t: key("t", t["hash"])), F.transform(F.filter("slots", lambda s: s != 0), lambda s: key("s", s)), none)
    seen = read.select("host", "content", F.explode(F.array_distinct(every)).alias("k")).select("host", "content", "k.*").distinct()
    counts = staged(seen.groupBy("host", "kind", "key").agg(F.count("*").alias("n")).where((F.col("kind") == "s") | (F.col("n") >= F.when(F.col("kind") == "h", enough).otherwise(many))), "counts")
    anywhere = counts.where("kind = 's'").groupBy("kind", "key").agg(F.sum("n").alias("all")).where(F.col("all") >= many)
    slots = counts.where("kind = 's'").join(anywhere, ["kind", "key"], "left_semi")
    return staged(counts.where("kind <> 's'").unionByName(slots).select("host", "kind", "key"), "site")


def extract(df: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", many: int = MANY, enough: int = ENOUGH) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Pages are read twice, for the counts and for the text: what is staged between are numbers, and the one shuffle of pages moves
    them compressed. No join has an aggregate under it, so that adaptive execution can split a hot host or page."""
    read = staged(parsed(df, page_id=page_id, url=url, page=page), "subtrees")
    site = site_counts(read, many, enough)
    mark = lambda kind, k, a, b: F.struct(F.lit(kind).alias("kind"), k.cast("bigint").alias("key"), a.cast("int").alias("first"), b.cast("int").alias("end"))
    of_slots = F.filter(F.transform("slots", lambda s, k: mark("s", s, k, k + 1)), lambda m: m["key"] != 0)
    marks = F.concat(F.array(mark("h", F.lit(0), F.lit(0), F.lit(0))), F.transform("subtrees", lambda t: mark("t", t["hash"], t["first"], t["end"])), of_slots)
    found = read.select("host", "page", F.explode(marks).alias("m")).select("host", "page", "m.*").join(site, ["host", "kind", "key"])
    cuts = staged(found.groupBy("host", "page").agg(F.collect_set(F.struct("kind", "first", "end")).alias("cuts")), "cuts")  # of one page: bounded by its length
    kinds = "array<struct<kind:string,first:int,end:int>>"

    def squeeze(part: pa.RecordBatch) -> pa.RecordBatch:
        sources = part.column(3).to_pylist()
        squeezed = zstandard.ZstdCompressor(level=3)
        columns = [*part.columns[:3], pa.array(map(_digest, sources), pa.binary()), pa.array([squeezed.compress(s.encode("utf-8", "surrogatepass")) for s in sources], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page", "html"])

    def write(part: pa.RecordBatch) -> pa.RecordBatch:
        whole = zstandard.ZstdDecompressor()
        sources = [whole.decompress(s).decode("utf-8", "surrogatepass") for s in part.column(2).to_pylist()]
        texts = ["\n".join(main_text(parse_page(s)[0], marks or [])) for s, marks in zip(sources, part.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    pages = _by_parts(_with_host(df, page_id, url, page), "page_id BIGINT, url STRING, host STRING, page BINARY, html BINARY", squeeze)
    joined = pages.join(cuts, ["host", "page"], "left").select("page_id", "url", "html", "cuts")
    return _by_parts(joined, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT", write)
