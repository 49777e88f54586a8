"""The main text of web pages by nearest-URL page differencing, checked against markup.

1. Every page is read into all its lines, menus and adverts included; nothing is ruled out. A line
   has the container that it stands in ("nav/ul", "article") and what markup says of it.
2. Pages of a host are lined up by URL path, and each is differenced with the neighbour whose path
   is nearest: all lines of both are aligned by longest common subsequence. Lines that both have are
   the template's. Menus and adverts may differ from page to page, so a host's differing text is also
   summed up by container: its main text stands in the deepest container that has over half of it.
   What differencing proposes is what differs and stands there.
3. Markup checks the proposal. Menus, headers, footers, sidebars, notices, adverts, forms, comments
   and what isn't shown go, as does, on a page with an article (or else a main element), what stands
   outside it. Lines that stand plainly in an article stay, as articles may quote the same passage.
   Where markup only hints at a widget ("share-price", "form-row", on an article's paragraph also
   "search" or "notice"), or a page has no article, the proposal holds: shared lines go, and outside
   articles so do those of hinted widgets beside the main container.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator, Sequence
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored, with_neighbours

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|textarea|select|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: An attribute with its value; values are taken whole, so no name is sought inside one.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
WORD = re.compile(r"[a-z0-9]+")

# Elements.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th caption figcaption".split())
CHROME = frozenset("nav footer aside form head menu dialog button fieldset".split())
# Words of class, id, role or label that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement adbox adsense adslot banner breadcrumb breadcrumbs comment comments consent contentinfo cookie "
    "cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe toolbar widget complementary alert dialog form".split()
)
#: Names of containers: how many levels tell them apart, and how long a level's name is.
MOST_LEVELS, NAME_LENGTH = 8, 40
DIGITS = re.compile(r"[0-9]+")
FLAT = INLINE | VOID | PROSE | {"html", "body"}
# What markup says of a line: it goes; it stays; neither; it stands in what may be a widget, on a page without article.
OUT, PLAIN, OPEN, DOUBTED = 0, 1, 2, 3
REPLIES = frozenset("comment comments reply replies".split())
# Those that rule a paragraph of an article out too; the others only hint there.
SURE = REPLIES | frozenset("ad ads adbox adsense adslot adv advert advertisement adverts hidden promo promoted promotion sponsor sponsored".split())


def marks(attrs: str) -> tuple[set[str], set[str]]:
    """The tokens of an element's class, id, role and label, and "hidden" if it isn't shown; and the
    words that these tokens consist of."""
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attrs):
        name, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            out.add("hidden")
        elif name == "style":
            if "none" in value and re.search(r"display\s*:\s*none", value):
                out.add("hidden")
        elif name in ("class", "id", "role", "aria-label"):
            out.update(value.split())
    return out, {w for t in out for w in WORD.findall(t)}


class Containers:
    """The block elements open at a place, without those of prose: a path of their names and classes."""

    def __init__(self) -> None:
        self.open: list[str] = []
        self.count: dict[str, int] = {}
        self.names = [""]  # paths of the outermost ones

    def begin(self, tag: str, attrs: str) -> None:
        self.open.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        if len(self.names) <= MOST_LEVELS:
            classes = next((m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs) if (m[1] or "").lower() == "class"), "")
            name = DIGITS.sub("#", ".".join([tag, *sorted(classes.lower().split())])).replace("/", "")
            self.names.append(f"{self.names[-1]}{name[:NAME_LENGTH]}/")

    def end(self, tag: str) -> None:
        while self.count.get(tag, 0):
            last = self.open.pop()
            self.count[last] -= 1
            if len(self.open) < len(self.names) - 1:
                self.names.pop()
            if last == tag:
                return


def read_lines(page: str) -> list[tuple[str, str, int]]:
    """All lines of a page's body in order: text, container, and what markup says (OUT to DOUBTED)."""
    lines: list[tuple[str, str, int, bool]] = []
    parts: list[str] = []
    apart: list[str] = []  # text of the element being skipped
    place = Containers()
    inside = {"article": 0, "main": 0}
    seen = {"article": False, "main": False}
    skip = ""  # the element being skipped, how deep in elements of its name, and whether its name alone says so
    depth, firm = 0, False
    hint, hint_depth = "", 0  # the element whose name hints at a widget, likewise

    def flush(parts: list[str], out: bool) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append((text, place.names[-1], -1 if out else 2 if inside["article"] else 1 if inside["main"] else 0, bool(hint)))
            parts.clear()

    def say(text: str) -> None:
        if not skip:
            parts.append(text)
        elif skip != "head":
            apart.append(text)

    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            say(m["text"])
            continue
        if m["tag"] is None:
            if m["raw"] is None and m[0].startswith("<![CDATA["):
                say(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, close, alone = m["tag"].lower(), bool(m["close"]), m["attrs"].endswith("/")
        if skip and tag not in INLINE:
            flush(apart, True)
        if tag not in FLAT and not alone:
            if not skip:
                flush(parts, False)
            if close:
                place.end(tag)
            else:
                place.begin(tag, m["attrs"])
        if skip:
            if tag == skip and not alone:
                depth += -1 if close else 1
                if depth == 0:
                    flush(apart, True)
                    skip = ""
                continue
            if close or tag not in inside or firm or marks(m["attrs"])[0] & REPLIES:
                if tag == "br":
                    say(" ")
                continue
            skip = ""  # an article begins: what surrounds it only bore a misleading name
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID and tag not in INLINE:
            flush(parts, False)
            continue
        tokens, words = marks(m["attrs"]) if m["attrs"] and not close else (set(), set())
        named = tokens & (SURE if inside["article"] and tag in PROSE | INLINE else MARKS)
        if tag in INLINE:
            if not named or tag in VOID:
                continue
        else:
            flush(parts, False)
        if hint and tag == hint and not alone:
            hint_depth += -1 if close else 1
            if hint_depth == 0:
                hint = ""
        if close:
            if tag in inside:
                inside[tag] = max(0, inside[tag] - 1)
            continue
        if alone:
            continue
        top = tag in inside or tag in ("body", "html")
        header = tag == "header" and not inside["article"] and not inside["main"]
        if tag in CHROME or header or (named and not top) or (named & REPLIES and tag == "article"):
            skip, depth, firm = tag, 1, tag in ("footer", "aside", "form", "dialog", "button") or bool(named & REPLIES)
        elif tag in inside:
            inside[tag] += 1
            seen[tag] = True
        elif not hint and not top and words & MARKS:
            hint, hint_depth = tag, 1
    flush(apart, True)
    flush(parts, False)
    level = 2 if seen["article"] else 1 if seen["main"] else 0
    said = lambda at, hinted: OUT if at < level else PLAIN if level and not hinted else DOUBTED if hinted and not level else OPEN
    return [(text, where, said(at, hinted)) for text, where, at, hinted in lines]


def read_blocks(page: str) -> list[tuple[str, bool]]:
    """The lines of a page in order that markup doesn't rule out, and whether each is open: not
    plainly a part of an article or main element."""
    return [(text, said != PLAIN) for text, _, said in read_lines(page) if said != OUT]


def common_lines(a: Sequence[int], b: Sequence[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows. Equal
    ends are matched at once; of the rows between, every ``step``-th is held and the others are
    made again a stretch at a time, so memory grows with n**1.5 bits."""
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    ends = [*range(head)], [*range(len(a) - tail, len(a))]
    own, other = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    left = [i for i in range(head, len(a) - tail) if a[i] in other]
    right = [x for x in b[head : len(b) - tail] if x in own]
    where: dict[int, list[int]] = {}
    for j, x in enumerate(right):
        where.setdefault(x, []).append(j)

    def mask(x: int) -> int:
        bits = bytearray(len(right) // 8 + 1)
        for j in where[x]:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    # Masks of frequent lines are held, or of all on a page of usual length.
    often = 0 if len(right) <= 4_096 else isqrt(len(right))
    masks = {x: mask(x) for x, at in where.items() if len(at) > often}
    full = (1 << len(right)) - 1
    step = isqrt(len(left)) + 1

    def rows(v: int, start: int) -> Iterator[int]:
        for i in left[start : start + step]:
            u = v & (masks.get(a[i]) or mask(a[i]))
            v = ((v + u) | (v - u)) & full
            yield v

    held, v = [full], full
    for start in range(0, len(left) - step, step):
        for v in rows(v, start):
            pass
        held.append(v)
    out, j = [], len(right)
    for k in range(len(held) - 1, -1, -1):
        stretch = [held[k], *rows(held[k], k * step)]
        i = len(stretch) - 1
        while i and j:
            if stretch[i] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if stretch[i] >> (j - 1) & 1:
                out.append(left[k * step + i])
                j -= 1
    return [*ends[0], *out[::-1], *ends[1]]


def nearness(path: str, other: str) -> int:
    """How many characters two paths begin with in common."""
    n = min(len(path), len(other))
    return next((k for k in range(n) if path[k] != other[k]), n)


ADDRESS = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^#]*)")


def host_and_path(url: str | None) -> tuple[str, str]:
    m = ADDRESS.match(url or "")
    return (m[1].lower(), m[2]) if m else ("", url or "")


def body_digest(lines: Sequence[tuple[str, str, int]]) -> str | None:
    """Of the lines that markup doesn't rule out; null without any."""
    body = [text for text, _, said in lines if said != OUT]
    return hashlib.md5("\n".join(body).encode()).hexdigest() if body else None


PARSED = "host string, path string, body string, page struct<hashes: array<long>, sizes: array<int>, places: array<string>, out: array<boolean>>"
PAGE = pa.struct([("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.list_(pa.string())), ("out", pa.list_(pa.bool_()))])


def parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What differencing needs of pages that have a body."""
    for batch in batches:
        rows = []
        # A page at a time is turned into Python text, so a batch of long pages isn't held twice.
        for url, source in zip(batch.column("url"), batch.column("html"), strict=True):
            lines = read_lines(source.as_py() or "")
            if (body := body_digest(lines)) is not None:
                hashes = [xxhash.xxh64_intdigest(text.encode()) - (1 << 63) for text, _, _ in lines]
                page = {"hashes": hashes, "sizes": [len(x[0]) for x in lines], "places": [x[1] for x in lines], "out": [x[2] == OUT for x in lines]}
                rows.append((*host_and_path(url.as_py()), body, page))
        kinds = (pa.string(), pa.string(), pa.string(), PAGE)
        yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "path", "body", "page"])


PACKED = "page_id long, url string, host string, body string, packed binary"


def pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines of pages, compressed, as they are shuffled to what differencing found."""
    for batch in batches:
        bodies, packed = [], []
        for source in batch.column("html"):
            lines = read_lines(source.as_py() or "")
            bodies.append(body_digest(lines))
            packed.append(pack(lines))
        hosts = pa.array([host_and_path(u.as_py())[0] for u in batch.column("url")], pa.string())
        columns = [batch.column("page_id"), batch.column("url"), hosts, pa.array(bodies, pa.string()), pa.array(packed, pa.binary())]
        yield pa.record_batch(columns, ["page_id", "url", "host", "body", "packed"])


def pack(lines: Sequence[tuple[str, str, int]]) -> bytes:
    """Neither texts nor containers hold line breaks or tabs."""
    return zlib.compress("\n".join(f"{said}\t{place}\t{text}" for text, place, said in lines).encode(), 1)


def unpack(packed: bytes) -> list[tuple[str, str, int]]:
    rows = (row.split("\t") for row in zlib.decompress(packed).decode().split("\n") if row)
    return [(text, place, int(said)) for said, place, text in rows]


LINES = "page_id long, url string, lines array<struct<text: string, place: string, said: int, shared: boolean, inside: boolean>>"
LINE = pa.struct([("text", pa.string()), ("place", pa.string()), ("said", pa.int32()), ("shared", pa.bool_()), ("inside", pa.bool_())])


def tell_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brings a page's lines and what differencing found of its body together."""
    for batch in batches:
        out = []
        for packed, shared, main in zip(*(batch.column(k) for k in ("packed", "shared", "main")), strict=True):
            same, place_of_text = iter(shared.as_py() or ()), main.as_py()
            out.append([
                {"text": text, "place": place, "said": said, "shared": said != OUT and next(same, False),
                 "inside": None if place_of_text is None else place.startswith(place_of_text)}
                for text, place, said in unpack(packed.as_py())
            ])
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(out, pa.list_(LINE))], ["page_id", "url", "lines"])


def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Aligns pages with their nearest: which of the body's lines are shared, and how many characters differ by container and all containers around it."""
    for batch in batches:
        shared: list[list[bool]] = []
        differing: list[list[dict[str, object]]] = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            page = row["page"]
            near = [row[k] for k in ("prev", "next") if row[k] and row[k]["host"] == row["host"]]
            same: list[bool] = []
            sums: dict[str, int] = {}
            if near:
                best = max(near, key=lambda x: nearness(row["path"], x["path"]))
                both = set(common_lines(page["hashes"], best["page"]["hashes"]))
                same = [k in both for k, out in enumerate(page["out"]) if not out]
                for k, (name, size) in enumerate(zip(page["places"], page["sizes"], strict=True)):
                    if k not in both:
                        sums[name] = sums.get(name, 0) + size
                if all(same):
                    same = []
            around: dict[str, int] = {}
            for name, size in sums.items():
                while True:
                    around[name] = around.get(name, 0) + size
                    if not name:
                        break
                    name = name[: name.rfind("/", 0, -1) + 1]
            shared.append(same)
            differing.append([{"place": name, "size": size} for name, size in around.items()])
        columns = [*(batch.column(k) for k in ("host", "body", "copies")), pa.array(shared, pa.list_(pa.bool_()))]
        kind = pa.list_(pa.struct([("place", pa.string()), ("size", pa.int64())]))
        yield pa.record_batch([*columns, pa.array(differing, kind)], ["host", "body", "copies", "shared", "differing"])


#: Copies of a page that a slot holds, and how many groups may have more slots than one, which are broadcast.
SLOT_ROWS, MOST_LARGE = 2_000, 20_000
#: Hosts up to which their main containers are broadcast: some hundred bytes each.
BROADCAST_ROWS = 20_000


def page_differences(parsed: DataFrame) -> DataFrame:
    """One row per group of pages of a host with equal bodies (``host``, ``body``, ``copies``):
    ``shared`` and ``differing`` as ``difference`` has them, of the page of least path. Such pages
    count as one, so a copy is no neighbour; a page that would lose its whole body loses nothing; a
    page alone on its host shares nothing. Pages without a body have no row."""
    pages = parsed.select("host", "body", F.struct("path", "page").alias("first"))
    pages = pages.groupBy("host", "body").agg(F.min("first").alias("first"), F.count("*").alias("copies")).select("host", "body", "copies", "first.*")
    pages = with_neighbours(pages, ["host", "path", "body"], ["host", "path", "page"])
    kind = "host string, body string, copies long, shared array<boolean>, differing array<struct<place: string, size: long>>"
    return pages.select("host", "body", "copies", "path", "page", "prev", "next").mapInArrow(difference, kind)


def main_containers(differences: DataFrame) -> DataFrame:
    """``host`` and ``main``: the deepest container with over half of the host's differing text."""
    sums = differences.select("host", F.explode("differing").alias("d")).groupBy("host", "d.place").agg(F.sum("d.size").alias("size"))
    every = sums.where("place = ''").select("host", F.col("size").alias("every"))
    return sums.join(every, "host").where("2 * size > every").groupBy("host").agg(F.max_by("place", F.length("place")).alias("main"))


def difference_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, and ``lines``, an array of all lines of the page with
    ``text``, ``place``, ``said``, and differencing's two answers: ``shared`` (the nearest page has
    the line too; told of the body's lines only) and ``inside`` (it stands in the host's main
    container; null where that is unknown, or none of the page's differing lines stands there)."""
    # Pages are read into lines more than once; to store all their texts between took more disk than the budget has.
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    found = stored(page_differences(pages.select("url", "html").mapInArrow(parse_pages, PARSED)), "page-differences")
    mains = stored(main_containers(found), "page-mains")
    mains = F.broadcast(mains) if mains.count() <= BROADCAST_ROWS else mains
    # Groups of many copies are dealt into slots, so that no task gets a whole one.
    most = SLOT_ROWS + (found.agg(F.sum("copies")).first()[0] or 0) // MOST_LARGE
    slots = F.ceil(F.col("copies") / most).cast("int")
    large = found.where(F.col("copies") > most).select("host", "body", slots.alias("slots"))
    parsed = pages.mapInArrow(pack_pages, PACKED).withColumn("n", F.monotonically_increasing_id()).join(F.broadcast(large), ["host", "body"], "left")
    parsed = parsed.withColumn("slot", F.coalesce(F.col("n") % F.col("slots"), F.lit(0)).cast("int"))
    found = found.join(mains, "host", "left")
    main = F.when(F.exists("differing", lambda d: d["place"] == F.col("main")), F.col("main")).alias("main")
    found = found.select("host", "body", "shared", main, F.explode(F.sequence(F.lit(0), slots - 1)).alias("slot"))
    both = parsed.join(found.hint("shuffle_hash"), ["host", "body", "slot"], "left")
    return both.select("page_id", "url", "packed", "shared", "main").mapInArrow(tell_lines, LINES)


def stays(line: Column) -> Column:
    """The check of what differencing says of a line."""
    own = ~line["shared"]
    beside = F.coalesce(~line["inside"], F.lit(False))
    return (line["said"] == PLAIN) | (line["said"] == OPEN) & own | (line["said"] == DOUBTED) & own & ~beside


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per input row (page_id, url, html): page_id, url, text and n_chars.

    Null or empty html, and pages without an article's text, give the empty text. Repeated rows
    stay. An empty table gives an empty result; extra columns are left behind.
    """
    kept = F.transform(F.filter("lines", stays), lambda x: x["text"])
    text = F.array_join(kept, "\n\n")
    return difference_pages(pages).select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
