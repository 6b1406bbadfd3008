"""Main text of web pages by template deduction over the pages of one host.

Tokens are tags with their path, and pieces of text with the path they stand on. Over the different
pages of a host, tokens with the same occurrence vector (how often each page holds them) form an
equivalence class. The vectors are never built: an exclusive-or of hashes over (page, count) is
equal for equal vectors, so Spark groups tokens by an ordinary aggregate. The class of a body tag is
a template, when enough pages support it; hosts that lay out pages in several ways have several. Tokens
carry their path, so the class nests by itself. Text in it (notices, menus, captions) stands once at the
same place of every page and is dropped, unless the page's own text goes on in the same block; what lies
between the template's tokens are slots.

The other classes are nested in these slots: those of one tag and one text at least, on enough pages, whose
tokens come in one order, in one slot of the template, on every page, and do not cross another class. Such a
class is a part that some pages of a layout have, or have several times; its text goes with its elements.

Of the slots those count that stand in the article, or without one in the body, outside elements that
never hold main text: by their tag, or by what their class, id or role says.
"""

from __future__ import annotations

import bisect
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armada.llm.common import staged, tables
from armada.llm.urls import host_and_path

LEAST_PAGES = 5  # different pages of a host that a template must rest on
BATCH_BYTES = 4_000_000

# Fixed values of HTML: elements without an end tag, inline elements, and elements that end a paragraph.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub "
    "sup time tt u var wbr".split()
)
BLOCKS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
# Elements that never hold main text, and words of class, id or role that say so.
DROPPED = set("head nav footer aside form script style noscript template iframe object svg button select textarea dialog menu canvas audio video".split())
RAW = "script|style|textarea|title|noscript|iframe|template"
KINDS = (
    r"(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|nav|navigation|navbar|menu|"
    r"breadcrumbs?|sidebar|aside|footer|header|masthead|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|"
    r"social|comments?|replies|disqus|related|recommended|widget|search|login|complementary|contentinfo)"
)
# A name counts when it ends in such a word, or goes on with a part or place of an element. Names that say
# what else a page has (has-sidebar, comments-open) do not.
BOILERPLATE = re.compile(
    rf"(?:^|\s)(?!(?:has|have|no|not|with|without|is|hide|show)[-_])(?:[^\s]*[-_])?{KINDS}"
    r"(?:[-_]+(?:areas?|bars?|blocks?|body|bottom|box|buttons?|col|column|container|content|entry|form|group|heading|inner|items?|"
    r"left|links?|lists?|main|outer|panel|posts?|articles?|primary|right|row|secondary|sections?|signup|slot|text|thread|title|"
    r"toggle|top|unit|widgets?|wrap|wrapper|\d+))*(?:$|\s)",
    re.IGNORECASE,
)
# Names on headings and paragraphs are what links point at; they say nothing about the kind of text.
TEXT_BLOCKS = set("h1 h2 h3 h4 h5 h6 p".split())
NEVER_DROPPED = ("html", "body", "main")  # by their marks; an article neither, unless it stands in another

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "path", "token", "dropped", "main", "by_tag")

    def __init__(self, name: str, path: int, token: int, dropped: bool, main: bool, by_tag: bool = False):
        self.name, self.path, self.token, self.dropped, self.main, self.by_tag = name, path, token, dropped, main, by_tag


def tokens(page: str) -> Iterator[tuple[str, int, str, bool, bool, int]]:
    """(kind, token, text, dropped, in article, token of the tag around it) in page order.

    Kinds are 'tag', 'text' and 'break'; tokens are hashes, 0 for those that never count.
    """
    stack = [Element("", 0, 0, False, False)]
    at = 0

    def of(text: str, kind: str, path: int) -> int:
        return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{text}") - (1 << 63)

    def texts(piece: str):
        if piece and not piece.isspace():
            inside = stack[-1]
            text = SPACE.sub(" ", references.unescape(piece) if "&" in piece else piece)
            yield "text", of(text.strip(), "text", inside.path), text, inside.dropped, inside.main, inside.token
        elif piece:
            yield "text", 0, " ", stack[-1].dropped, stack[-1].main, 0

    for found in TAG.finditer(page):
        yield from texts(page[at : found.start()])
        at = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    stack.pop()
                stack.pop()
            if name not in INLINE:
                yield "break", 0, "", False, False, 0
            continue
        if name in BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    del stack[i:]
                    break
                if stack[i].name not in INLINE:
                    break
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].name == name:
            stack.pop()
        above = stack[-1]
        named = [(kind.lower(), a or b or c) for kind, a, b, c in MARK.findall(found["rest"])] if found["rest"] else []
        marks = " ".join(m for _, m in named)
        # Marks with a number in them (postid-17) are often of one page alone, and would part its path from all others.
        shared = " ".join(m for m in marks.split() if not any(c.isdigit() for c in m))
        path = xxhash.xxh32_intdigest(f"{above.path}\0{name}\0{shared}")
        holds = name in ("article", "main") or "articleBody" in (found["rest"] or "")
        article = above.main or holds
        by_tag = above.by_tag or name in DROPPED or (name == "header" and not above.main)
        # Inside the article an id alone drops nothing: there it is mostly the place a link points at.
        telling = " ".join(m for kind, m in named if kind != "id" or not above.main)
        marked = bool(telling and name not in NEVER_DROPPED and name not in TEXT_BLOCKS and BOILERPLATE.search(telling))
        # The outermost article is not lost by its own marks or those of an element that holds it.
        dropped = by_tag if holds and not above.main else above.dropped or by_tag or marked
        token = of("", "tag", path)
        yield "tag", token, name, dropped, article, above.token
        if name == "br":  # a new line of the same block
            yield "text", 0, " ", above.dropped, above.main, 0
        elif name not in INLINE:
            yield "break", 0, "", False, False, 0
        if name not in VOID and not (found["rest"] or "").endswith("/"):
            stack.append(Element(name, path, token, dropped, article, by_tag))
    yield from texts(page[at:])


def main_text(page: str, template: set[int], nested: set[int] = frozenset()) -> str:
    """Slots of the main part, each block with single spaces, joined in page order.

    Blocks of the template's text alone are left out, and its text inside its own elements; of the nested classes, their
    text inside their own elements. Where that would take most of an article, or all of a page without one, the
    pages are copies of each other, and the nested classes, or if that is not enough the template, leave nothing out.
    """
    events = list(tokens(page))
    article = any(main and not dropped for kind, _, _, dropped, main, _ in events if kind == "text")

    def blocks(known: set[int], parts: set[int] = frozenset()) -> str:
        found, block = [], []
        for kind, token, text, dropped, main, around in [*events, ("break", 0, "", False, False, 0)]:
            if kind == "break":
                # A piece of the template within a sentence of the page's own is part of that sentence.
                fixed = all(token in known for token, _, _ in block if token)
                found.append([] if fixed and block else [t for token, t, inside in block if not (inside and token in known)])
                block = []
            elif kind == "text" and not dropped and (main or not article) and not (token in parts and around in parts):
                block.append((token, text, around in known))
        joined = (SPACE.sub(" ", "".join(b)).strip() for b in found if b)
        return " ".join(b for b in joined if b)

    if not template:
        return blocks(template)
    whole = blocks(set())
    for parts in (nested, set()) if nested else (set(),):
        text = blocks(template, parts)
        if text and not (article and 2 * len(text) < len(whole)):
            return text
    return whole


TEXT, TAG_TOKEN, BODY = 0, 1, 2
_FOUND = "array<struct<token:bigint,count:int,kind:int,places:array<int>>>"


def occurrences(pages: DataFrame) -> DataFrame:
    """Rows (host, page, found): the tokens of each different page, how often and where it holds them.

    Pages of equal html count once, told apart by the 64-bit hash ``page``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            found, counts, kinds, places, begins = [], [], [], [], [0]
            for page in batch.column("html").to_pylist():
                own: dict[int, list[int]] = {}
                kind_of: dict[int, int] = {}
                place = 0
                for kind, token, text, *_ in tokens(page):
                    if kind != "break" and token:
                        own.setdefault(token, []).append(place)
                        place += 1
                        if kind == "tag":
                            kind_of[token] = BODY if text == "body" else TAG_TOKEN
                found.extend(own)
                counts.extend(map(len, own.values()))
                kinds.extend(kind_of.get(token, TEXT) for token in own)
                for at in own.values():
                    places.extend(at)
                begins.append(len(found))
            offsets = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)
            rows = pa.StructArray.from_arrays(
                [
                    pa.array(found, pa.int64()), pa.array(counts, pa.int32()), pa.array(kinds, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32())),
                ],
                names=["token", "count", "kind", "places"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), batch.column("page"), pa.ListArray.from_arrays(pa.array(begins, pa.int32()), rows)],
                names=["host", "page", "found"],
            )

    rows = pages.where("html IS NOT NULL").select("host", F.xxhash64("html").alias("page"), "html")
    return rows.mapInArrow(run, f"host string, page long, found {_FOUND}").dropDuplicates(["host", "page"])


def in_slots(members: list[dict]) -> Iterator[tuple[int, int, int, bool, list[int]]]:
    """(class, slot, order, valid, tokens) of the classes on one page, parted by the slot of the template they stand in.

    A slot is named by the tag of the template before it. A class that stands in one slot k times must hold all its
    tokens k times in the same order; of two that cross, the one on fewer pages is not valid.
    """
    edges = sorted((place, m["token"]) for m in members if m["root"] for place in m["places"])
    begins = [place for place, _ in edges]
    parts: dict[tuple[int, int], list[dict]] = {}
    for m in members:
        if not m["root"]:
            slots = {bisect.bisect(begins, place) for place in m["places"]}
            if len(slots) == 1 and (slot := slots.pop()):
                parts.setdefault((m["class"], edges[slot - 1][1]), []).append(m)
    orders, sequence, bad = {}, [], set()
    for key, own in parts.items():
        kinds = {m["kind"] > TEXT for m in own}
        if len(kinds) < 2:  # a tag and a text at least
            continue
        at = sorted((place, m["token"]) for m in own for place in m["places"])
        first = [token for _, token in at[: len(own)]]
        orders[key] = first
        if [token for _, token in at] != first * (len(at) // len(first)) or len(set(first)) < len(first):
            bad.add(key)
        sequence.extend((place, key, i // len(own)) for i, (place, _) in enumerate(at))
    weight = {key: (parts[key][0]["support"], len(parts[key]), key) for key in orders}
    open_: list[tuple] = []
    standing: set[tuple] = set()
    seen: dict[tuple, int] = {}
    for _, key, number in sorted(sequence):
        instance = (key, number)
        while instance in standing and open_[-1] != instance:
            crossing = open_.pop()
            standing.remove(crossing)
            bad.add(min(crossing[0], key, key=weight.get))
        if instance not in standing:
            open_.append(instance)
            standing.add(instance)
        seen[instance] = seen.get(instance, 0) + 1
        if seen[instance] == len(orders[key]):
            standing.remove(open_.pop())
    for key, first in orders.items():
        yield *key, xxhash.xxh64_intdigest(np.array(first, dtype=np.int64).tobytes()) - (1 << 63), key not in bad, first


def placed(members: DataFrame) -> DataFrame:
    """Rows (host, page, class, slot, order, valid, support, tokens) of ``in_slots`` for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES // 4):
            rows = []
            for row in batch.to_pylist():
                supports = {m["class"]: m["support"] for m in row["members"]}
                rows.extend({"host": row["host"], "page": row["page"], "class": c, "slot": s, "order": o, "valid": v, "support": supports[c], "tokens": t} for c, s, o, v, t in in_slots(row["members"]))
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = pa.schema([
        ("host", pa.string()), ("page", pa.int64()), ("class", pa.int64()), ("slot", pa.int64()), ("order", pa.int64()),
        ("valid", pa.bool_()), ("support", pa.int64()), ("tokens", pa.list_(pa.int64())),
    ])
    per_page = members.groupBy("host", "page").agg(
        F.collect_list(F.struct("class", "token", "kind", "root", "support", "places")).alias("members")
    )
    return per_page.mapInArrow(
        run, "host string, page long, class long, slot long, order long, valid boolean, support long, tokens array<bigint>"
    )


def deduced(pages: DataFrame, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """Rows (host, template), and rows (host, page, nested) of the pages that hold nested classes."""
    found = staged(occurrences(pages), "occurrences").select("host", "page", F.inline("found"))
    vectors = found.groupBy("host", "token").agg(
        F.count("*").alias("support"), F.bit_xor(F.xxhash64("page", "count")).alias("vector"), F.max("kind").alias("kind")
    )
    vectors = staged(vectors.where(F.col("support") >= least_pages), "vectors")
    roots = vectors.where(F.col("kind") == BODY).select(
        F.col("host").alias("root_host"), F.col("support").alias("root_support"), F.col("vector").alias("root_vector")
    )
    same = (F.col("host") == F.col("root_host")) & (F.col("support") == F.col("root_support")) & (F.col("vector") == F.col("root_vector"))
    rooted = vectors.join(roots, same, "left_semi")
    templates_ = rooted.groupBy("host").agg(F.collect_set("token").alias("template"))

    others = vectors.join(roots, same, "left_anti")
    named = F.xxhash64("support", "vector").alias("class")
    large = others.groupBy("host", named).agg(F.max("kind").alias("most"), F.min("kind").alias("least"))
    large = large.where((F.col("most") > TEXT) & (F.col("least") == TEXT)).select("host", "class")
    parts = others.select("host", "token", named, "support", "kind", F.lit(False).alias("root")).join(large, ["host", "class"], "left_semi")
    tags = rooted.where(F.col("kind") > TEXT).select("host", "token", named, "support", "kind", F.lit(True).alias("root"))
    parts = parts.join(rooted.select("host").distinct(), "host", "left_semi")
    columns = ("host", "token", "class", "support", "kind", "root")
    known = staged(parts.select(*columns).union(tags.join(large.select("host").distinct(), "host", "left_semi").select(*columns)), "classes")

    classes = staged(placed(found.drop("kind").join(known, ["host", "token"])), "placed")
    valid = classes.groupBy("host", "class", "slot").agg(
        F.count("*").alias("n"), F.max("support").alias("support"), F.min("order").alias("first"), F.max("order").alias("last"),
        F.min("valid").alias("valid"),
    ).where("valid AND n = support AND first = last").select("host", "class", "slot")
    nested = classes.join(valid, ["host", "class", "slot"], "left_semi").groupBy("host", "page").agg(
        F.flatten(F.collect_list("tokens")).alias("nested")
    )
    return templates_, nested


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Rows (host, template): token hashes in the equivalence classes of the host's body tags.

    Pages of equal html count once. A token of a class is on every page of it, as often as the body tag,
    so a class is no longer than one page, and a host has fewer classes than pages by ``least_pages``.
    """
    return deduced(pages, least_pages)[0]


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null and empty html give the empty text. Pages without a host are one group. Repeated rows and
    repeated pages each give their row. Hosts with fewer than LEAST_PAGES different pages have no
    template; their pages are cut by elements alone. An empty table gives none; other columns are
    ignored.
    """
    host, _ = host_and_path(F.col(url))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host")
    )
    known, parts = deduced(rows)
    known = known.withColumnRenamed("host", "template_host")
    parts = parts.select(F.col("host").alias("part_host"), F.col("page").alias("part_page"), "nested")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tables(batches, BATCH_BYTES):
            texts = [
                main_text(page, set(template or ()), set(nested or ())) if page else ""
                for page, template, nested in zip(*(batch.column(n).to_pylist() for n in ("html", "template", "nested")))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(rows.dtypes)
    joined = rows.join(known, F.col("host") == F.col("template_host"), "left")
    own = (F.col("host") == F.col("part_host")) & (F.xxhash64("html") == F.col("part_page"))
    joined = joined.join(parts, own, "left").select("page_id", "url", "html", "template", "nested")
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
