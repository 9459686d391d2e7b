"""Main text of pages by tag-path ratios.

A page is read as a stream of tags and texts. Every stretch of text belongs to the path of open elements from the root, named by tags and classes. For each path the length
of its texts and their punctuation are summed up, over the page and over all pages on which the path stands: a page's own ratios, of which a short page has few texts, are
drawn towards those of the path in the whole table. Ratios are smoothed over paths that follow one another in the page and stand under one element, fused by their
product, and paths under a share of the page's best one go, as do those that are mostly links; the nodes of the others are the content. That a path stands in an article
or main element is a weight, and so is a tag, class or role that says navigation, advert, comment and the like; ratios that speak loudly enough against it win. A heading
stays if something of its section does.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import ChainMap
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, skew_join

#: Elements without an end tag, elements whose content is not text, blocks, parts of a page that are no article, words of class, id and role that mark such
#: parts, and elements that a new start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas select xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav footer aside form button menu dialog fieldset".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer footnav sidebar side aside rail "
    "widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus "
    "replies respond pagination pager toolbar copyright legal disclaimer tags tagcloud teaser teasers".split()
)
#: Words of layout that may stand beside a marked one in a class name.
LAYOUT = frozenset("site page main top bottom left right global primary secondary list box wrap wrapper container area section block item items slot unit inner outer bar link links".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog toolbar".split())
MAIN = frozenset("article main".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
MARK = re.compile(r"[.,;:!?…、。，！？¿¡]")


@dataclass
class Block:
    """Text between two borders of blocks. ``path`` numbers its path in the page, ``name`` names it in all pages; ``level`` is a heading's."""

    path: int
    marked: bool
    main: bool
    level: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    name: int = 0


@dataclass(frozen=True)
class RatioParams:
    """``share`` is the part of the best path's fused value under which a path goes, ``links`` the share of link text over which one goes. ``inside`` is the weight of paths within an article
    or main element, ``hint`` that of paths that markup names as something else. ``prior`` is how many texts the table's ratios of a path count as. Those of the commonest
    paths, ``known`` at most, are broadcast; those of all others reach their pages by a join, with the same result."""

    share: float = 0.4
    links: float = 0.5
    inside: float = 8.0
    hint: float = 0.3
    prior: int = 64
    known: int = 100_000


def _says(name: str) -> bool:
    """Whether a class or id names a part that is no content: all of its parts are marked or of layout, and one is marked."""
    parts = NAMES.findall(name)
    return not MARKED.isdisjoint(parts) and all(x in MARKED or x in LAYOUT for x in parts)


def _marked(tag: str, attrs: str) -> bool:
    if tag in ASIDE:
        return True
    if not attrs:
        return False
    for m in ATTRIBUTE.finditer(attrs):
        name = m[1].lower()
        value = next((x for x in m.groups()[1:] if x is not None), "")
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") and any(_says(x.lower()) for x in value.split()):
                return True
        elif name == "role" and value.lower().strip() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


def _classes(attrs: str) -> str:
    """The classes of an element in order, as part of its name in a path."""
    if "class" not in attrs.lower():
        return ""
    value = next((next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attrs) if m[1].lower() == "class"), "")
    return "".join("." + x for x in sorted(value.lower().split()))


@dataclass
class _Open:
    """An open element; ``block`` is the tag of the innermost one around text that is no inline element, itself included."""

    tag: str
    marked: bool
    main: bool
    path: int
    block: str


class _Tree:
    """The open elements, where those of each tag are, and the numbers of paths: none of it walks the stack, however deep."""

    def __init__(self) -> None:
        self.stack = [_Open("", False, False, 0, "")]
        self.where: dict[str, list[int]] = {}
        self.numbers: dict[tuple[int, str, bool], int] = {}
        self.parents: list[int] = [0]
        self.names: list[int] = [0]

    def nearest(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def push(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        # A header within the article holds its headline; elsewhere it is the site's.
        marked = top.marked or _marked(tag, attrs) or tag == "header" and not top.main
        path = self._number(top.path, "" if tag in INLINE else tag + _classes(attrs), marked) if tag not in INLINE or marked != top.marked else top.path
        self.where.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, marked, top.main or tag in MAIN, path, top.block if tag in INLINE else tag))

    def _number(self, parent: int, label: str, marked: bool) -> int:
        path = self.numbers.get((parent, label, marked))
        if path is None:
            path = self.numbers[parent, label, marked] = len(self.parents)
            self.parents.append(parent)
            said = hashlib.blake2b(f"{self.names[parent]} {label}".encode(), digest_size=8).digest()
            self.names.append(int.from_bytes(said, "big", signed=True))
        return path

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.where[tag].pop()
        return tag


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page in order, and the parent of each path."""
    out: list[Block] = []
    tree = _Tree()
    stack = tree.stack
    now: Block | None = None

    def text(raw: str) -> None:
        nonlocal now
        if not raw:
            return
        top = stack[-1]
        if now is not None and now.marked != top.marked:
            now = None
        if now is None:
            if not raw.strip():
                return
            now = Block(top.path, top.marked, top.main, int(top.block[1]) if len(top.block) == 2 and top.block[0] == "h" and top.block[1] in "123456" else 0, name=tree.names[top.path])
            out.append(now)
        plain = html.unescape(raw)
        now.parts.append(plain)
        if tree.where.get("a"):
            now.linked += len(plain.strip())

    def close(depth: int) -> None:
        nonlocal now
        while depth and len(stack) > depth:
            if tree.pop() not in INLINE:
                now = None

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            break
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br" or tag == "p" and not tree.where.get("p"):
                now = None
            else:
                close(tree.nearest(tag))
        elif m[2] or m[4]:
            tag, attrs = (m[2] or m[4]).lower(), m[3] or m[5] or ""
            if tag in RAW:
                if not attrs.rstrip().endswith("/"):
                    stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = stop.end() if stop else end
                now = None
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    now = None
                continue
            if tag in CLOSES_P and tree.nearest("p") > tree.nearest("table", "td", "th", "button"):
                close(tree.nearest("p"))
            if tag in CLOSED_BY and tree.nearest(*CLOSED_BY[tag]) > tree.nearest(*SCOPE[tag]):
                close(tree.nearest(*CLOSED_BY[tag]))
            if tag == "a":
                close(tree.nearest("a"))
            if tag not in INLINE:
                now = None
            tree.push(tag, attrs)
    text(page[at:])
    return out, tree.parents


def texts_of(page: str | None) -> tuple[list[tuple[Block, str]], list[int]]:
    """Blocks with text and their texts, white space joined; and the parents of paths."""
    found, parents = blocks(page or "")
    joined = ((b, SPACE.sub(" ", "".join(b.parts)).strip()) for b in found)
    return [(b, t) for b, t in joined if t], parents


#: What the table says of a path: its mean text length and its mean number of marks.
Ratios = tuple[float, float]


def measured(found: list[tuple[Block, str]]) -> dict[int, list[int]]:
    """For each path number of texts, letters, marks, letters in links. Headings, which are short wherever they stand, count only where nothing else is unmarked."""
    rows = [x for x in found if not x[0].level]
    if all(b.marked for b, _ in rows):
        rows = found
    out: dict[int, list[int]] = {}
    for b, t in rows:
        s = out.setdefault(b.path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(t)
        s[2] += len(MARK.findall(t))
        s[3] += b.linked
    return out


def _base(paths: list[int], parents: list[int]) -> set[int]:
    """The paths that all of ``paths`` run through."""
    below = [0] * len(parents)
    for k in paths:
        below[k] += 1
    for k in range(len(parents) - 1, 0, -1):  # a parent's number is less than its children's
        below[parents[k]] += below[k]
    return {k for k, n in enumerate(below) if n == len(paths)}


def kinship(a: int, b: int, parents: list[int], base: set[int]) -> float:
    """1 for paths under one element, less where it is further above, 0 where that is more than three steps or the paths of the whole page meet there."""
    up = {}
    for k in range(1, 4):
        a = parents[a]
        if a in base:
            break
        up[a] = k
    for k in range(1, 4):
        b = parents[b]
        if b in base:
            break
        if b in up:
            return 1 / (k + up[b] - 1)
    return 0.0


def path_values(found: list[tuple[Block, str]], parents: list[int], table: Mapping[int, Ratios], p: RatioParams) -> tuple[dict[int, float], set[int]]:
    """The fused value of each path that counts, and those that are mostly links."""
    own = measured(found)
    paths, names = list(own), {b.path: b.name for b, _ in found}
    lengths, marks = [], []
    for k in paths:
        n, letters, points, _ = own[k]
        length, mark = table.get(names[k], (0.0, 0.0))
        weight = p.prior if names[k] in table else 0
        lengths.append((letters + weight * length) / (n + weight))
        marks.append((points + weight * mark) / (n + weight) + 1)
    base = _base(paths, parents) if len(paths) > 1 else set()
    near = [kinship(x, y, parents, base) for x, y in zip(paths, paths[1:])]

    def smooth(v: list[float], k: int) -> float:
        left, right = (near[k - 1], v[k - 1]) if k else (0, 0), (near[k], v[k + 1]) if k + 1 < len(v) else (0, 0)
        return (v[k] + left[0] * left[1] + right[0] * right[1]) / (1 + left[0] + right[0])

    return {path: smooth(lengths, k) * smooth(marks, k) for k, path in enumerate(paths)}, {k for k in paths if own[k][3] > p.links * own[k][1]}


def fitting(found: list[tuple[Block, str]], parents: list[int], table: Mapping[int, Ratios], p: RatioParams) -> set[int]:
    """The paths that stay. Marked paths are held against the best value with all weights, the others against the best where an article is no advantage."""
    values, linked = path_values(found, parents, table, p)
    marked, inside = {b.path for b, _ in found if b.marked}, {b.path for b, _ in found if b.main}
    free = [k for k in values if k not in linked]
    weight = {k: p.hint if k in marked else p.inside if k in inside else 1.0 for k in free}
    if all(k in marked for k in free):
        # Nothing stands against what the markup says.
        most = {True: max((values[k] for k in free), default=0.0)}
    else:
        most = {True: max(values[k] * weight[k] for k in free), False: max(values[k] * min(weight[k], 1.0) for k in free)}
    return {k for k in free if values[k] * weight[k] >= p.share * most[k in marked]}


def main_text(page: str | None, p: RatioParams = RatioParams(), table: Mapping[int, Ratios] | None = None) -> str:
    """Text of the content blocks, white space joined, one block a line. ``table`` has the ratios of paths in all pages by their names; without it the page speaks for itself."""
    found, parents = texts_of(page)
    stay = fitting(found, parents, table or {}, p)
    fits = [b.path in stay for b, _ in found]
    # From the end on: the least level of a heading that what is kept of its section would keep.
    under = 0
    for k in range(len(found) - 1, -1, -1):
        b, t = found[k]
        if not b.level:
            under = 7 if fits[k] else under
        elif not b.marked:
            fits[k] = b.linked <= p.links * len(t) and (fits[k] or b.level < under)
            under = min(under, b.level)
    return "\n".join(c for (_, c), ok in zip(found, fits) if ok)


#: Paths of which a task holds counts before it hands them on, and pages that it remembers.
HELD = 200_000


def path_ratios(pages: DataFrame, scratch: Scratch, p: RatioParams = RatioParams()) -> tuple[dict[int, Ratios], DataFrame | None]:
    """The ratios of all paths that stand on two pages or more; one that stands on a single page has no others than the page's own.

    The tasks count, and of each path one row a task meets. Those of the commonest paths, ``known`` at most by classes of page counts from the highest on, come to the driver, by
    their names. Those of the rest are joined to the pages that hold them: (page, names, lengths, marks), a row for each different page with such paths, ``page`` being
    the hash of its html. None if all are among the first.
    """

    def rows(held: dict[int, list[int]]) -> pd.DataFrame:
        df = pd.DataFrame([(k, *v, None) for k, v in held.items()], columns=["key", "pages", "texts", "letters", "marks", "names"])
        held.clear()
        return df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[int]] = {}
        seen: set[int] = set()
        for b in batches:
            own: dict[int, list[int]] = {}
            for key, page in zip(b["page"].tolist(), b["html"]):
                found, _ = texts_of(page)
                names, sums = {x.path: x.name for x, _ in found}, measured(found)
                for path, (n, letters, points, _) in sums.items():
                    s = held.setdefault(names[path], [0, 0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += letters
                    s[3] += points
                if sums and key not in seen:
                    own[key] = list({names[path] for path in sums})
                    if len(seen) < HELD:
                        seen.add(key)
                if len(held) > HELD:
                    yield rows(held)
            if own:
                yield pd.DataFrame({"key": list(own), "pages": 0, "texts": 0, "letters": 0, "marks": 0, "names": list(own.values())})
        yield rows(held)

    hashed = pages.select("html", F.xxhash64("html").alias("page"))
    counts = scratch.table(hashed.mapInPandas(run, "key long, pages long, texts long, letters long, marks long, names array<long>"), "counts")
    sums = counts.where("names IS NULL").groupBy(F.col("key").alias("name")).agg(*(F.sum(c).alias(c) for c in ("pages", "texts", "letters", "marks"))).where("pages >= 2")
    sums = scratch.table(sums.select("name", F.floor(F.log2("pages")).cast("int").alias("c"), (F.col("letters") / F.col("texts")).alias("length"), (F.col("marks") / F.col("texts")).alias("mark")), "sums")
    least, total = 63, 0
    for r in sums.groupBy("c").count().orderBy(F.desc("c")).collect():
        total += r["count"]
        if total > p.known:
            break
        least = r["c"]
    common = sums.where(F.col("c") >= least)
    got, rest = {r[0]: (r[1], r[2]) for r in common.select("name", "length", "mark").collect()}, None
    if total > p.known:
        # No path of the rest holds more than a small share of these rows: more than ``known`` others stand on at least half as many pages.
        asked = counts.where("names IS NOT NULL").select(F.col("key").alias("page"), F.explode("names").alias("name"))
        asked = asked.join(F.broadcast(common.select("name")), "name", "left_anti").distinct().join(sums.where(F.col("c") < least), "name")
        asked = asked.groupBy("page").agg(F.collect_list(F.struct("name", "length", "mark")).alias("r"))
        rest = scratch.table(asked.select("page", F.col("r.name").alias("names"), F.col("r.length").alias("lengths"), F.col("r.mark").alias("marks")), "rest")
    scratch.drop("counts", "sums")
    return got, rest


def extract(pages: DataFrame, p: RatioParams = RatioParams()) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null or empty page, and one without content, has an empty text; the whole page is read, whatever its length and however deep its elements; paths of equal value go or
    stay together; broken and unclosed markup is read as far as it goes; repeated rows are each extracted and each count for the ratios of paths; null page_id and url are
    passed on; an empty table gives no rows; other columns are not read.
    """
    common, rest = path_ratios(pages, Scratch(pages.sparkSession, "paths"), p)
    held = pages.sparkSession.sparkContext.broadcast(common)

    def tables(b: pd.DataFrame) -> Iterator[Mapping[int, Ratios]]:
        if rest_columns:
            for names, lengths, marks in zip(*(b[c] for c in rest_columns)):
                yield held.value if names is None else ChainMap(dict(zip(names.tolist(), zip(lengths.tolist(), marks.tolist()))), held.value)
        else:
            yield from repeat(held.value, len(b))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h, p, table) for h, table in zip(b["html"], tables(b))]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    whole, rest_columns = pages.select("page_id", "url", "html"), []
    if rest is not None:
        rest_columns = [c for c in rest.columns if c != "page"]
        whole = skew_join(whole.withColumn("page", F.xxhash64("html")), rest, "page", "left")
    return whole.mapInPandas(run, "page_id long, url string, text string, n_chars long")
