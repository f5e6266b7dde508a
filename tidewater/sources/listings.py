"""Job and tender listings: anchors of a source's page and of the hubs it links to, and fallbacks where those give nothing.

The pages are the crawler's table; nothing is fetched. A source's page is found by its address
and its anchors are classified. Hubs, HUBS a source in page order, are joined back to the pages;
addresses that the source's page has already shown are left out by an anti-join. Only sources
that are still empty go on: to jobs in JSON inside the page, cut into spans between consecutive
titles, and if there are none to headings and cards. HTML is parsed once a page on the executors,
into a row for each part; rows are dealt over all tasks before they are judged, so that a large
page keeps no task longer than its parsing takes. All else is joins and column functions; what
several steps read is stored in the shared folder. Order is the order of the pages, never that of rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from datetime import datetime
from itertools import accumulate, batched, chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import dates, notices
from tidewater.functions.patterns import any_word, ascii_edges, dealt, let
from tidewater.functions.text import clean_job_title
from tidewater.functions.urls import canonical_url, job_url, resolve_url
from tidewater.plans.session import stored
from tidewater.sources.pages import PAGES, _clean, _Parser, sliced

#: Hubs and rows a source, jobs out of a page's JSON, how far a span reaches and where it says what it is.
HUBS, ROWS, EMBEDDED, SPAN, MARKED = 8, 60, 40, 40_000, 1500
#: Keys of job objects, of their dates and addresses, and the shape that holds an object's own id.
JOB_KEYS = r'"(?:applicationDeadline|reportingTo|subsidiary|jobType|vacancy|validThrough|hiringOrganization|employmentType|closingDate|datePosted)"'
DATE_KEYS = r'(?i)"(?:applicationDeadline|validThrough|valid_through|closingDate|closing_date|deadline|expiryDate|expiry_date)":"([^"]+)"'
URL_KEYS = r'(?i)"(?:url|jobUrl|applyUrl|link)":"(https?://[^"]{10,300})"'
OWN_ID = r'"status":(?:true|false),"id":(\d{1,8}),"createdAt"'
#: Closing dates on cards, places, words of sentences, and sizes of titles and cards.
CARD_DATES = (r"(?i)(?:clos\w*(?:\s+on)?|deadline)\s*:?\s*(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9}),?\s+(\d{4})", r"(?i)(?:clos\w*(?:\s+on)?|deadline)\s*:?\s*([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})")
PLACE = ascii_edges(r"(?i)\b(Nairobi|Mombasa|Kisumu|Nakuru|Eldoret|Thika|Kenya)\b")
PERSONAL = any_word(("our", "we", "you", "your"))
TITLE, WORDS, CARD, CLIMB = (6, 90), 10, 1200, 4
#: Characters that are read of the row around an anchor, and parts that a Python worker sends on at once.
_ROW, _SENT = 2000, 10_000
_HEADINGS, _LEAVES = ("h1", "h2", "h3", "h4", "h5", "strong", "b"), ("p", "span", "div", "td", "li")
VERTICALS = {"jobs": (notices.job_link, notices.ROLE_REASON), "tenders": (notices.tender_link, notices.TENDER_REASON)}


class _Listing(_Parser):
    """Also knows each element's parent, whether it holds elements, and where pictures stand."""

    def __init__(self) -> None:
        super().__init__()
        self._parent: list[int] = []
        self._last: list[int] = []
        self._leaf: list[bool] = []
        self._pictures: list[tuple[str, int]] = []

    def handle_starttag(self, tag, attrs):
        before = len(self._names)
        super().handle_starttag(tag, attrs)
        new = len(self._names) > before
        above = (self._open[-2] if len(self._open) > 1 else -1) if new else (self._open[-1] if self._open else -1)
        if above >= 0:
            self._leaf[above] = False
        if new:
            self._parent.append(above)
            self._last.append(-1)
            self._leaf.append(True)
        elif tag == "img":
            self._pictures.append((dict(attrs).get("alt") or "", above))

    def _close(self) -> str:
        n = self._open[-1]
        tag = super()._close()
        self._last[n] = len(self._names) - 1
        return tag

    def _nearest(self, n: int, tags: frozenset[str]) -> int:
        while n >= 0 and self._names[n][0] not in tags:
            n = self._parent[n]
        return n

    def parts(self) -> tuple[list[tuple], list[tuple]]:
        """(anchors, candidates), all at once."""
        return list(self.anchors()), list(self.candidates())

    def anchors(self) -> Iterator[tuple]:
        """Every anchor with its heading and row, as in PARTS."""
        self._finish()
        headed: dict[int, int] = {}
        for n, (tag, _) in enumerate(self._names):
            if tag in ("h1", "h2", "h3", "h4"):
                above = self._parent[n]
                while above >= 0 and above not in headed:
                    headed[above] = n
                    above = self._parent[above]
        rows, sections = frozenset(("li", "tr", "article", "div")), frozenset(("section", "article", "li", "tr", "div"))
        for n in self._linked():
            row, section = self._nearest(n, rows), self._nearest(n, sections)
            above = self._parent[n]
            heading = self._text_of(headed[section]) if section in headed else ""
            yield ANCHOR, n, self._text_of(n), self._names[n][1]["href"], heading, self._begin_of(row if row >= 0 else above, _ROW) if max(row, above) >= 0 else ""

    def _finish(self) -> None:
        while self._open:
            self._close()

    def _linked(self) -> list[int]:
        return [n for n, (tag, attributes) in enumerate(self._names) if tag == "a" and "href" in attributes]

    def candidates(self) -> Iterator[tuple]:
        """Every heading, picture and text-only element with its card, as in PARTS."""
        self._finish()
        size = [0, *accumulate(self._sizes)]
        linked = self._linked()

        def card(above: int) -> int:
            for _ in range(CLIMB):
                if above < 0 or size[self._runs[above][1]] - size[self._runs[above][0]] > CARD:
                    return -1
                at = bisect_left(linked, above)
                if at < len(linked) and linked[at] <= self._last[above]:
                    return above
                above = self._parent[above]
            return -1

        headings = ((0, n, self._text_of(n), self._parent[n]) for n, (tag, _) in enumerate(self._names) if tag in _HEADINGS)
        pictures = ((1, i, _clean(alt), above) for i, (alt, above) in enumerate(self._pictures))
        leaves = ((2, n, self._text_of(n), self._parent[n]) for n, (tag, _) in enumerate(self._names) if tag in _LEAVES and self._leaf[n])
        for kind, place, text, above in chain(headings, pictures, leaves):
            if TITLE[0] <= len(text) <= TITLE[1]:
                own = card(above)
                href = self._names[linked[bisect_left(linked, own)]][1]["href"] if own >= 0 else None
                yield kind, place, text, href, "", self._text_of(own) if own >= 0 else ""


#: What a part is: an anchor, or else a candidate of kind 0 to 2. Around an anchor is its row, around a candidate its card.
ANCHOR = -1
PARTS = {"kind": "int", "pos": "int", "text": "string", "href": "string", "heading": "string", "around": "string"}


def listing_parts(pages: DataFrame) -> DataFrame:
    """A row for each anchor and candidate of pages (html, and columns of the caller's, which come along); a null page has none."""
    keep = [f for f in pages.schema.fields if f.name != "html"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, PAGES):
            for rows in batched(chain.from_iterable(map(parts, frame[[f.name for f in keep]].itertuples(index=False, name=None), frame["html"])), _SENT):
                yield pd.DataFrame(rows, columns=names)

    def parts(of: tuple, html: str | None) -> Iterator[tuple]:
        parser = _Listing()
        parser.feed(html or "")
        parser.close()
        for part in chain(parser.anchors(), parser.candidates()):
            yield *of, *part

    names = [*(f.name for f in keep), *PARTS]
    return pages.mapInPandas(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} {t}" for n, t in PARTS.items())]))


def job_spans(html: Column) -> Column:
    """array<string>: JSON inside a page, unescaped, from each "title" to the next one."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r'\\"', '"')
    for code, sign in (("3c", "<"), ("3e", ">"), ("26", "&")):
        plain = F.regexp_replace(plain, rf"(?i)\\u00{code}", sign)
    spans = F.split(plain, r'(?="title":"[^"]{4,140}")')
    return F.transform(F.filter(spans, lambda s: s.rlike(r'^"title":"[^"]{4,140}"')), lambda s: F.substring(s, 1, SPAN))


def embedded_jobs(pages: DataFrame, now: datetime, vertical: str = "jobs", most: int = EMBEDDED) -> DataFrame:
    """(the columns of pages but html, title, job_url, pos) out of JSON inside pages (url, html, ...): job objects that are not past their date.

    A date that cannot be read keeps the job. The address is the object's own, else the
    page's with its id, else the page's. Of a title, whatever its case, the first one counts.
    """
    classify, _ = VERTICALS[vertical]
    keep = [n for n in pages.columns if n != "html"]
    spans = pages.select(*keep, F.posexplode(job_spans(F.col("html"))).alias("pos", "span")).where(F.substring("span", 1, MARKED).rlike(JOB_KEYS))
    title = F.trim(F.regexp_replace(F.regexp_extract("span", r'^"title":"([^"]*)"', 1), r"\s+", " "))
    due = F.regexp_extract("span", DATE_KEYS, 1)
    base = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "/$", "")
    own, number = F.regexp_extract("span", URL_KEYS, 1), F.regexp_extract("span", OWN_ID, 1)
    address = let(own, lambda o: F.when(o != "", o).otherwise(let(number, lambda n: F.when(n != "", F.concat(base, F.lit("/"), n)).otherwise(base))))
    told = dealt(spans.select(*keep, "pos", title.alias("title"), due.try_cast("timestamp").alias("due"), address.alias("job_url")))
    fits = (F.col("due").isNull() | (F.col("due") >= F.lit(now))) & (classify(F.col("title"), F.col("job_url"), F.lit(""))["type"] == "posting")
    # judged in an aggregate, since a filter would be judged before the rows are dealt
    first = told.groupBy(*keep, F.lower("title").alias("_key")).agg(F.min(F.when(fits, F.struct("pos", "title", "job_url"))).alias("_first")).where(F.col("_first").isNotNull())
    rank = Window.partitionBy(*keep).orderBy("pos")
    once = first.select(*keep, "_first.*").withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most)
    return once.select(*keep, "title", "job_url", "pos")


def _anchors(parts: DataFrame, vertical: str, now: datetime) -> DataFrame:
    """(source, hub, pos, title, url, norm, type, location): the anchors among parts of pages (source, hub, url), the first of an address in a source's pages; type is null for tenders that are past."""
    classify, _ = VERTICALS[vertical]
    at = let(resolve_url(F.col("href"), F.col("url")), lambda u: F.struct(u.alias("url"), F.when(u.isNotNull(), job_url(u)).alias("norm")))
    rows = parts.where(F.col("kind") == ANCHOR).select("source", "hub", "pos", clean_job_title(F.col("text")).alias("title"), at.alias("at"), "heading", F.col("around").alias("row"))
    rows = rows.groupBy("source", F.col("at.norm").alias("norm")).agg(F.min(F.struct("hub", "pos", "title", F.col("at.url").alias("url"), "heading", "row")).alias("f"))
    first = rows.where(F.col("f.url").isNotNull()).select("source", "norm", "f.*")
    type_ = classify(F.col("title"), F.col("url"), F.col("heading"))["type"]
    if vertical == "tenders":
        type_ = let(type_, lambda v: F.when((v != "posting") | let(dates.tender_date(F.col("row")), lambda d: d.isNull() | (d >= F.lit(now))), v))
    location = F.nullif(F.regexp_extract("row", PLACE, 1), F.lit(""))
    return first.select("source", "hub", "pos", "title", "url", "norm", type_.alias("type"), location.alias("location"))


def _cards(parts: DataFrame, vertical: str, now: datetime) -> DataFrame:
    """(source, kind, pos, title, url): headings, pictures and text-only elements that are titles by themselves, with their card's address if that is one of a posting."""
    classify, reason = VERTICALS[vertical]
    text, page = F.col("text"), F.col("url")
    rows = parts.where(F.col("kind") != ANCHOR).where(~text.rlike("[.!…]$") & (F.size(F.split(text, r"\s+")) <= WORDS) & ~text.rlike(PERSONAL))
    day = F.coalesce(*(F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("around", p, d), F.initcap(F.substring(F.regexp_extract("around", p, m), 1, 3)), F.regexp_extract("around", p, 3)), F.lit("d MMM yyyy")) for p, d, m in ((CARD_DATES[0], 1, 2), (CARD_DATES[1], 2, 1))))
    rows = rows.where(let(day, lambda d: d.isNull() | (d >= F.lit(now))))
    linked = F.when(~F.col("href").rlike("(?i)^(?:mailto:|tel:|#)"), resolve_url(F.col("href"), page))
    fits = lambda url: let(classify(text, url, F.lit("")), lambda v: (v["type"] == "posting") & F.array_contains(v["reasons"], reason))
    url = let(linked, lambda u: F.when(u.isNotNull() & fits(u), u).when(fits(page), page))
    told = let(url, lambda u: F.when(u.isNotNull(), F.struct("kind", "pos", "text", u.alias("url"))))
    first = rows.groupBy("source", F.lower("text").alias("key")).agg(F.min(told).alias("f")).where(F.col("f").isNotNull())
    return first.select("source", "f.kind", "f.pos", F.col("f.text").alias("title"), "f.url")


def scraped(sources: DataFrame, pages: DataFrame, now: datetime, vertical: str = "jobs", hubs: int = HUBS, most: int = ROWS) -> DataFrame:
    """(source, rank, title, url, location, via): what sources (source, url, and url_filter if there is one) list, at most so many rows each, from pages (url, html).

    Addresses are compared in canonical form; a source whose page is not there lists nothing,
    and of several pages of one address one counts. url_filter is a pattern that addresses have
    to hold, whatever the case; null lets all through. via says where a row comes from: anchor,
    embedded or heading.
    """
    has_filter = "url_filter" in sources.columns
    at = sources.select("source", canonical_url(F.col("url")).alias("key"), (F.col("url_filter") if has_filter else F.lit(None).cast("string")).alias("url_filter")).where(F.col("key").isNotNull())
    keyed = pages.select(canonical_url(F.col("url")).alias("key"), "url", "html")
    visit = lambda frontier: keyed.join(frontier, "key").groupBy("source", "hub", "key").agg(F.min(F.struct("url", "html")).alias("p")).select("source", "hub", "p.url", "p.html")
    main = stored(visit(at.select("source", "key", F.lit(0).alias("hub")).distinct()), "listing-pages")
    parts = stored(dealt(listing_parts(dealt(main))), "listing-parts")
    shown = stored(_anchors(parts, vertical, now), "listing-anchors").where(F.col("type").isNotNull())
    order = Window.partitionBy("source").orderBy("pos")
    targets = shown.where("type = 'careers_page'").withColumn("key", canonical_url(F.col("url")))
    targets = targets.groupBy("source", "key").agg(F.min("pos").alias("pos")).withColumn("hub", F.row_number().over(order)).where(F.col("hub") <= hubs)
    deeper = _anchors(listing_parts(dealt(visit(targets.select("source", "key", "hub")))), vertical, now).join(shown.select("source", "norm"), ["source", "norm"], "left_anti")
    postings = shown.unionByName(deeper).where("type = 'posting'").select("source", F.lit(0).alias("kind"), "hub", "pos", "title", "url", "location", F.lit("anchor").alias("via"))
    postings = stored(postings, "listing-postings")
    full = postings.select("source").distinct()
    embedded = embedded_jobs(dealt(main.join(full, "source", "left_anti").select("source", "url", "html")), now, vertical)
    embedded = embedded.select("source", F.lit(0).alias("kind"), F.lit(0).alias("hub"), "pos", "title", F.col("job_url").alias("url"), F.lit(None).cast("string").alias("location"), F.lit("embedded").alias("via"))
    embedded = stored(embedded, "listing-embedded")
    cards = _cards(parts.join(full.unionByName(embedded.select("source").distinct()), "source", "left_anti"), vertical, now)
    cards = cards.select("source", "kind", F.lit(0).alias("hub"), "pos", "title", "url", F.lit(None).cast("string").alias("location"), F.lit("heading").alias("via"))
    rows = postings.unionByName(embedded).unionByName(cards)
    filters = at.groupBy("source").agg(F.min("url_filter").alias("url_filter"))
    rows = rows.join(filters, "source").where(F.col("url_filter").isNull() | F.expr("regexp_like(url, concat('(?i)', url_filter))"))
    rank = Window.partitionBy("source").orderBy("kind", "hub", "pos")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).select("source", "rank", "title", "url", "location", "via")
