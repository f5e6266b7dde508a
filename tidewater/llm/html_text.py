"""Main text of HTML pages by consensus host paths.

Each page's containers are scored by the text that stands directly in their
paragraphs, less link text, and vote for their generalised tag-class path (digits
masked). Spark adds up the votes by host; the path with the most votes wins, and every
page of the host is extracted again from the elements on that path. A page without
such an element, and a page of a host without votes, falls back on its own best container.

A title, a lead or a sister section stands outside a long inner container. So the host
climbs from the winning path, level by level, while on most of its pages the further
blocks of the next container are mostly text without links, and this container is named
as an article or the blocks differ from page to page. It ends below body.

A path is written as a hash of its labels and its last label, so it takes a few bytes
however deep it is. A page is read in one pass, in time and memory in proportion to its
length: unclosed and stray tags and deep nesting cost no more than others.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.storage import materialise

#: A host with more than this part of all pages is hot; so there are never more hot hosts than its inverse.
HOT = 1000

#: A start tag's quoted values may hold > and <; what is not quoted may not hold <, so a tag that never ends is given up at the next one.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|(?P<open_comment>\Z))"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*+>.*?(?:</(?P=raw)\s*>|(?P<open_raw>\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<cut_end>/?)(?P<cut_tag>[a-z][a-z0-9:-]*)(?P<cut_rest>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-z][a-z0-9:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("article body div main section td".split())
_CLOSED_BY_BLOCK = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
_SIBLINGS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}}
_DROPPED = frozenset("aside button dialog footer form head header input menu nav".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header "
    "masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_LIKELY = frozenset("article body content entry main post story text".split())
_KEPT = frozenset(("html", "body", "main", "article"))


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def _is_chrome(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in _KEPT:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _ROLES:
        return True
    if "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"], re.IGNORECASE):
        return True
    named = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    whole = set(named.lower().split())
    if whole & _CHROME or not whole & _LIKELY:
        return any(t.lower() in _CHROME for t in _TOKEN.findall(named))
    return False  # "post related-topics": a post, whatever its topics are


def _label(tag: str, attributes: dict[str, str]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


class Page:
    """The containers and text blocks of a page, without its chrome.

    blocks: (container's index, its text, characters of it in links). containers:
    (parent's index, path, tag, class tokens).
    """

    def __init__(self, source: str):
        self.containers: list[tuple[int, str, str, frozenset[str]]] = [(-1, "", "body", frozenset())]
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0
        # tag, container's index, chrome (or inside it), inside a link
        self._open: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._opened: Counter[str] = Counter()  # how many elements of a name are open
        self._open_blocks: list[int] = []  # places of open blocks in _open
        at, last = 0, source.rfind(">") + 1  # no tag ends behind the last >, so none is looked for there
        for m in _MARKUP.finditer(source, 0, last):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["cut_tag"]
            if not tag:
                if m["open_comment"] is not None or m["open_raw"] is not None:
                    at = len(source)
                continue
            tag = tag.lower()
            if m["end"] or m["cut_end"]:
                self._end(tag)
            else:
                self._start(tag, m["rest"] or m["cut_rest"] or "")
        tail = source[at:].split("<!--", 1)[0]
        if tail:
            self._add(tail)
        self._flush()

    def _add(self, text: str) -> None:
        _, _, chrome, link = self._open[-1]
        if not chrome:
            text = html.unescape(text) if "&" in text else text
            self._text.append(text)
            if link:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._open[-1][1], text, self._linked))
            self._text.clear()
        self._linked = 0

    def _start(self, tag: str, source: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in _BLOCK:
            self._flush()
            self._imply(tag)
        if tag in _VOID:
            return
        _, container, chrome, link = self._open[-1]
        attributes = _attributes(source)
        chrome = chrome or _is_chrome(tag, attributes)
        if tag in _CONTAINER:
            label = _label(tag, attributes)
            tokens = frozenset(t.lower() for t in _TOKEN.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}"))
            self.containers.append((container, _path(self.containers[container][1], label), tag, tokens))
            container = len(self.containers) - 1
        if tag in _BLOCK:
            self._open_blocks.append(len(self._open))
        self._opened[tag] += 1
        self._open.append((tag, container, chrome, link or tag == "a"))

    def _close(self, i: int) -> None:
        """Close the element at place i and all inside it."""
        for tag, *_ in self._open[i:]:
            self._opened[tag] -= 1
        del self._open[i:]
        while self._open_blocks and self._open_blocks[-1] >= i:
            self._open_blocks.pop()

    def _imply(self, tag: str) -> None:
        """Close what a start tag of a block ends: paragraphs and headings, and siblings of a list or table."""
        ends = _SIBLINGS.get(tag, ())
        while self._open_blocks:
            i = self._open_blocks[-1]
            name = self._open[i][0]
            if name not in ends and name not in _CLOSED_BY_BLOCK:
                return
            self._close(i)
            if name not in _CLOSED_BY_BLOCK or not ends:
                return

    def _end(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if self._opened[tag]:
            i = len(self._open) - 1
            while self._open[i][0] != tag:
                i -= 1
            self._close(i)

    def scores(self) -> dict[int, float]:
        """Container scores: own blocks in full, those of child containers by half."""
        out: dict[int, float] = defaultdict(float)
        for container, text, linked in self.blocks:
            worth = len(text) - 2 * linked
            out[container] += worth
            parent = self.containers[container][0]
            if parent >= 0:
                out[parent] += worth / 2
        for i in out:
            _, _, tag, tokens = self.containers[i]
            out[i] *= (1.5 if tag in ("article", "main") else 1.0) * (1.25 if tokens & _LIKELY else 1.0)
        return {i: s for i, s in out.items() if s > 0}

    def votes(self) -> list[tuple[str, float]]:
        """The paths of all containers with a score, and their shares of the page's score."""
        by_path: dict[str, float] = defaultdict(float)
        for i, s in self.scores().items():
            by_path[self.containers[i][1]] += s
        total = sum(by_path.values())
        return [(p, s / total) for p, s in sorted(by_path.items(), key=lambda x: (-x[1], x[0]))]

    def _under(self, roots: set[int]) -> str:
        inside = [False] * len(self.containers)
        for i, (parent, *_) in enumerate(self.containers):
            inside[i] = i in roots or parent >= 0 and inside[parent]
        return "\n".join(text for container, text, _ in self.blocks if inside[container])

    def steps(self) -> dict[str, tuple[str, int, int, int]]:
        """For each path with text the next one around it, below body, that adds a block, and what that adds.

        (outer path, whether what it adds is mostly text without links, whether it is named
        as an article, a checksum of what it adds).
        """
        below = [[0, 0, 0] for _ in self.containers]  # blocks, text less links, checksum: of a container and all inside it
        for container, text, linked in self.blocks:
            here = below[container]
            here[0] += 1
            here[1] += len(text) - 2 * linked
            here[2] += zlib.crc32(text.encode("utf-8", "surrogatepass"))
        for i in range(len(below) - 1, 0, -1):
            up = below[self.containers[i][0]]
            for j in range(3):
                up[j] += below[i][j]
        inner: dict[str, list[int]] = {}
        around: dict[str, set[int]] = defaultdict(set)
        for i in range(1, len(below)):
            parent, path, *_ = self.containers[i]
            if below[i][0] and self.containers[parent][2] != "body":
                held = inner.setdefault(path, [0, 0, 0])
                for j in range(3):
                    held[j] += below[i][j]
                around[path].add(parent)
        out = {}
        for path, held in inner.items():  # outer paths come first
            n, worth, check = (sum(below[q][j] for q in around[path]) - held[j] for j in range(3))
            _, outer, tag, tokens = self.containers[next(iter(around[path]))]
            named = tag in ("article", "main") or bool(tokens & _LIKELY)
            if n:
                out[path] = (outer, int(worth > 0), int(named), check & 0xFFFFFFFF)
            elif outer in out:
                out[path] = out[outer]
        return out

    def _around(self, roots: set[int], path: str) -> set[int]:
        """The containers on path that hold one of roots."""
        holds = [i in roots for i in range(len(self.containers))]
        for i in range(len(holds) - 1, 0, -1):
            holds[self.containers[i][0]] |= holds[i]
        return {i for i, c in enumerate(self.containers) if holds[i] and c[1] == path}

    def text(self, path: str | None, inner: str | None = None) -> str:
        """The blocks inside the elements on path that hold one on inner, in page order.

        If there are none, those inside the elements on path, then on inner, then in the page's best container.
        """
        if path is not None:
            outside, inside = ({i for i, c in enumerate(self.containers) if c[1] == p} for p in (path, inner))
            for roots in (self._around(inside, path), outside, inside):
                found = self._under(roots) if roots else ""
                if found:
                    return found
        scores = self.scores()
        if not scores:
            return ""
        best = max(scores, key=lambda i: (scores[i], -i))
        steps, at = self.steps(), self.containers[best][1]
        while at in steps and steps[at][1] and steps[at][2]:
            at = steps[at][0]
        return self._under(self._around({best}, at))


def _path(outer: str, label: str) -> str:
    return f"{hashlib.blake2b(f'{outer}>{label}'.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}>{label}"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    lowered = F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


_BALLOT = "host string, path string, share double, outer string, plain int, named int, crc long"


def _ballots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each path of a page that has a vote (share) or a path around it (outer)."""
    kinds = [("host", pa.string()), ("path", pa.string()), ("share", pa.float64()), ("outer", pa.string()), ("plain", pa.int32()), ("named", pa.int32()), ("crc", pa.int64())]
    for batch in batches:
        rows = []
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source or "")
            votes, steps = dict(page.votes()), page.steps()
            rows += [(name, path, votes.get(path), *steps.get(path, (None, 0, 0, None))) for path in votes | steps]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path, votes, inner): each host's winning container path, inner, and the path that it climbs to. Ties go to the path that is first in order.

    The climb follows steps of one level that are doubled in length until all have ended, so its joins grow with the logarithm of the depth.
    """
    rows = pages.select(host(F.col("url").cast("string")).alias("host"), F.col("html").cast("string").alias("html"))
    found = materialise(rows.mapInArrow(_ballots, _BALLOT).groupBy("host", "path", "outer").agg(
        F.sum("share").alias("votes"), F.count("share").alias("n"), F.count("outer").alias("adds"), F.sum("plain").alias("plain"), F.sum("named").alias("named"),
        F.count_distinct("crc").alias("texts"),
    ), "paths")
    votes = found.where("n > 0").groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"), F.sum("n").alias("n"))
    best = votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path", "n")).alias("b"))
    won = best.select("host", (-F.col("b.v")).alias("votes"), F.col("b.path").alias("inner"), F.col("b.n").alias("pages"))
    usual = F.max(F.struct("adds", "outer", "plain", "named", "texts")).alias("s")
    steps = found.where("outer is not null").groupBy("host", F.col("path").alias("at")).agg(usual).select("host", "at", "s.*")
    differ = (F.col("texts") >= 2) & (2 * F.col("texts") > F.col("adds"))
    on = (2 * F.col("plain") > F.col("pages")) & ((2 * F.col("named") > F.col("adds")) | differ)
    jumps = materialise(steps.join(won.select("host", "pages"), "host").where(on).select("host", "at", F.col("outer").alias("to")), "climb")
    while True:
        further = jumps.select(F.col("host").alias("h"), F.col("at").alias("via"), F.col("to").alias("beyond"))
        step = jumps.join(further, (F.col("host") == F.col("h")) & (F.col("to") == F.col("via")), "left")
        step = materialise(step.select("host", "at", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("goes_on")), "climb")
        jumps = step.select("host", "at", "to")
        if step.where("goes_on").isEmpty():
            break
    ends = jumps.select(F.col("host").alias("h"), "at", "to")
    reached = won.join(ends, (F.col("host") == F.col("h")) & (F.col("inner") == F.col("at")), "left")
    return reached.select("host", F.coalesce("to", "inner").alias("path"), "votes", "inner")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source or "").text(path, inner) for source, path, inner in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        out = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages; null html and pages without text give the empty text.

    Null urls and those without :// are pages of the empty host. Repeated rows repeat, an
    empty table gives none, other columns are ignored, and equal votes go to the path that is
    first in order. A host with more than one in HOT of all pages meets its winner by a
    broadcast of at most HOT rows, so its pages stay in their tasks; the pages of the others
    are dealt by host.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    placed = rows.withColumn("host", host(F.col("url")))
    winners = host_paths(pages).select("host", "path", "inner")
    hot = materialise(placed.groupBy("host").count().where(F.col("count") * HOT > pages.count()).select("host"), "hot")  # fewer than HOT rows
    few = F.broadcast(hot.join(winners, "host", "left"))
    columns = ("page_id", "url", "html", "path", "inner")
    found = placed.join(few, "host").select(*columns)
    rest = placed.join(F.broadcast(hot), "host", "left_anti").join(winners, "host", "left").select(*columns)
    return found.unionByName(rest).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
