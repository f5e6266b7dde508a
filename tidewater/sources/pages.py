"""Pages as a source: parsed HTML, JSON and XML bodies, job payloads, crawl rules and candidate addresses.

Fetching, rendering and PDF text are left to the crawler; its results are the input here.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.places import country_code, rollout_priorities, rollout_priority
from tidewater.functions.text import clean_text
from tidewater.functions.urls import canonical_url, normal_domain, resolve_url

_GONE = frozenset("script style noscript svg iframe template".split())
_CHROME = frozenset("nav header footer aside".split())
_CHROME_CLASSES = frozenset("nav navbar footer cookie breadcrumb".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ANCHOR_BLOCKS = frozenset("li p td div article section".split())
_SPACE = re.compile(r"\s+")


def _clean(text: str) -> str:
    return _SPACE.sub(" ", re.sub("[​-‍﻿]", "", text).replace(" ", " ")).strip()


class _Parser(HTMLParser):
    """Collects the parts of a page in one walk. An element's text is a run of the page's texts, known by where it begins and ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta = None
        self._texts: list[str] = []
        self._sizes: list[int] = []
        self._signs: list[int] = []  # how many characters other than white space come before each text
        self._names: list[tuple[str, dict]] = []
        self._runs: list[list[int]] = []
        self._block: list[int] = []  # the nearest anchor block around each element, -1 if there is none
        self._open: list[int] = []
        self._opened: Counter[str] = Counter()
        self._gone = 0
        self._known: dict[int, str] = {}
        self._h1: list[tuple[int, int]] = []  # line and column where the first h1 begins and where its inside ends
        self._h1_at, self._h1_tag = -1, 0

    def handle_starttag(self, tag, attrs):
        attributes = {k: v or "" for k, v in attrs}
        if tag == "meta" and self.meta is None and (attributes.get("name") == "description" or attributes.get("property") == "og:description"):
            self.meta = attributes.get("content", "")
        if tag == "a" and self._opened["a"]:  # a new anchor ends one that was left open
            self.handle_endtag("a")
        if tag in _VOID:
            return
        if tag == "h1" and not self._h1:
            self._h1, self._h1_at, self._h1_tag = [self.getpos()], len(self._names), len(self.get_starttag_text())
        above = self._open[-1] if self._open else -1
        self._block.append(above if above >= 0 and self._names[above][0] in _ANCHOR_BLOCKS else self._block[above] if above >= 0 else -1)
        self._open.append(len(self._names))
        self._names.append((tag, attributes))
        self._runs.append([len(self._texts), -1])
        self._opened[tag] += 1
        self._gone += tag in _GONE

    def _close(self) -> str:
        n = self._open.pop()
        tag = self._names[n][0]
        self._runs[n][1] = len(self._texts)
        self._opened[tag] -= 1
        self._gone -= tag in _GONE
        if n == self._h1_at:
            self._h1.append(self.getpos())
        return tag

    def handle_endtag(self, tag):
        if self._opened[tag]:
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self._gone:
            return
        if self._texts and data.isspace() and self._texts[-1].isspace():  # one blank is as good as many
            self._sizes[-1] += len(data)
            return
        self._texts.append(data)
        self._sizes.append(len(data))

    def _text_of(self, n: int) -> str:
        if n not in self._known:
            self._known[n] = _clean("".join(self._texts[slice(*self._runs[n])]))
        return self._known[n]

    def _begin_of(self, n: int, most: int) -> str:
        """The first characters of an element's cleaned text; reads no more of the page than they take."""
        if len(self._signs) <= len(self._texts):
            self._signs = [0, *accumulate(len("".join(t.split())) for t in self._texts)]
        begin, end = self._runs[n]
        enough = bisect_left(self._signs, self._signs[begin] + most + 1, begin, end + 1)
        return _clean("".join(self._texts[begin : min(end, enough)]))[:most]

    def first_h1(self, source: str) -> str:
        """What stands inside the first h1 as it is written, its tags and character references included; empty if there is none. To be asked after result()."""
        if not self._h1:
            return ""
        lines = [0, *(m.end() for m in re.finditer("\n", source))]
        begin, end = (lines[line - 1] + column for line, column in self._h1)
        return source[begin + self._h1_tag : end]

    def result(self) -> dict:
        while self._open:
            self._close()
        by_tag: dict[str, list[int]] = {}
        for n, (tag, _) in enumerate(self._names):
            by_tag.setdefault(tag, []).append(n)
        first = (by_tag.get("title", []) + by_tag.get("h1", []))[:1]
        headings = [x for x in (self._text_of(n) for n in sorted(sum((by_tag.get(f"h{i}", []) for i in range(1, 5)), []))) if x and len(x) < 250]
        links = []
        for n in by_tag.get("a", []):
            if "href" in self._names[n][1]:
                above = self._block[n] if self._runs[n][0] < self._runs[n][1] else -1
                links.append({"text": self._text_of(n), "href": self._names[n][1]["href"], "context": self._begin_of(above, 400) if above >= 0 else ""})
        scope = None
        for test in (
            lambda t, a: t == "main", lambda t, a: t == "article", lambda t, a: a.get("role") == "main", lambda t, a: a.get("id") == "main-content",
            lambda t, a: a.get("id") == "content", lambda t, a: "main-content" in a.get("class", "").split(),
        ):
            found = next((n for n, (t, a) in enumerate(self._names) if test(t, a)), None)
            if found is not None and len(self._text_of(found)) > 400:
                scope = found
                break
        scope = scope if scope is not None else next(iter(by_tag.get("body", [])), None)
        begin, end = self._runs[scope] if scope is not None else (0, len(self._texts))
        out = [0] * (len(self._texts) + 1)  # how much chrome opens less how much closes before each text
        for n, (t, a) in enumerate(self._names):
            if n != scope and (t in _CHROME or _CHROME_CLASSES & set(a.get("class", "").split())):
                out[self._runs[n][0]] += 1
                out[self._runs[n][1]] -= 1
        depth = list(accumulate(out))
        body = [t for i, t in enumerate(self._texts[begin:end], begin) if not depth[i]]
        return {"title": self._text_of(first[0]) if first else "", "meta": _clean(self.meta or ""), "headings": headings, "links": links, "text": _clean("".join(body))}


def parse_html(source: str | None) -> dict:
    """title, meta, headings, links (text, href as written, context) and text of a page."""
    return _parsed(source)[0]


def _parsed(source: str | None) -> tuple[dict, str | None]:
    """parse_html() and the first h1 as it is written; null for a null page."""
    parser = _Parser()
    parser.feed(source or "")
    parser.close()
    return parser.result(), None if source is None else parser.first_h1(source)


#: Pages whose parts a Python worker holds at once.
PAGES = 64


def sliced(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The frames in slices of so many rows, so that what is made out of them is sent on bit by bit."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


PARSED = "title string, meta string, headings array<string>, links array<struct<text:string,href:string,context:string>>, text string"


def parsed_pages(pages: DataFrame, written: bool = False) -> DataFrame:
    """pages (page_id, url, html) with title, meta, headings, links and text instead of html; links are absolute and distinct by canonical URL.

    written adds h1, what stands inside the first h1 of the source, undecoded.
    """
    names = ["title", "meta", "headings", "links", "text", *(["h1"] if written else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in sliced(frames, PAGES):
            parts = pd.DataFrame([told | {"h1": h1} for told, h1 in map(_parsed, frame["html"])], columns=names)
            yield pd.concat([frame[["page_id", "url"]].reset_index(drop=True), parts], axis=1)

    raw = pages.select("page_id", "url", "html").mapInPandas(run, f"page_id long, url string, {PARSED}" + (", h1 string" if written else ""))
    absolute = F.filter(F.transform("links", lambda x: F.struct(x["text"].alias("text"), resolve_url(x["href"], F.col("url")).alias("href"), x["context"].alias("context"))), lambda x: x["href"].isNotNull())
    raw = raw.withColumn("links", absolute).withColumn("_k", F.transform("links", lambda x: canonical_url(x["href"])))
    return raw.withColumn("links", F.filter("links", lambda x, i: F.array_position("_k", F.element_at("_k", i + 1)) == i + 1)).drop("_k")


def needs_render(html: Column, text: Column) -> Column:
    """Whether a page looks as if a browser had to build it."""
    source, size = F.coalesce(html, F.lit("")), F.length(F.coalesce(text, F.lit("")))
    shell = source.rlike(r"(?i)<div[^>]+id=[\"'](?:root|app|__next|__nuxt)[\"'][^>]*>\s*</div>") | source.rlike(r"window\.__(?:INITIAL_STATE|NUXT|NEXT_DATA)__")
    told = source.rlike(r"(?i)<noscript>[^<]*(?:enable\s+javascript|requires\s+javascript)")
    sparse = (F.length(source) > 6000) & (size / F.greatest(F.length(source), F.lit(1)) < 0.03)
    return F.when(source == "", F.lit(True)).when(size > 900, F.lit(False)).otherwise(shell | told | sparse | (size < 250))


def json_text(body: Column) -> Column:
    """A JSON body's words without its punctuation."""
    return clean_text(F.regexp_replace(body, r"[{}\[\]\",]", " "))


def xml_text(body: Column) -> Column:
    return clean_text(F.regexp_replace(body, r"<[^>]+>", " "))


def listed_jobs(payloads: DataFrame, column: str, path: str, fields: dict[str, str]) -> DataFrame:
    """Rows of a list in JSON payloads: fields maps an output name to a field of the list's objects."""
    kind = "array<struct<" + ",".join(f"`{f}`:string" for f in fields.values()) + ">>"
    rows = payloads.select(F.explode(F.from_json(F.get_json_object(column, path), kind)).alias("j"))
    return rows.select(*[F.col("j")[f].alias(name) for name, f in fields.items()])


def embedded_titles(html: Column) -> Column:
    """Values of "title" keys in JSON inside a page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'"title"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def structured_data(html: Column) -> Column:
    """array<string>: the bodies of a page's JSON-LD scripts."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"), F.lit(1))


def json_types(body: Column) -> Column:
    """array<string>: the distinct values of "@type" keys at any depth of a JSON text, sorted; empty for broken JSON.

    The parsed value, written out again, is cut into its strings and signs, so that what looks
    like a key inside of a string is no key, however deep the value is; a list of types gives
    each of them.
    """
    plain = F.to_json(F.try_parse_json(body))
    parts = F.coalesce(F.regexp_extract_all(plain, F.lit(r'("(?:[^"\\]|\\.)*"|[\[\]{}:,]|[^"\[\]{}:,\s]+)'), F.lit(1)), F.array().cast("array<string>"))

    def cut(parts: Column) -> Column:
        at = lambda i: F.try_element_at(parts, i + 1)
        keys = F.filter(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: (at(i) == '"@type"') & (at(i + 1) == ":"))

        def told(i: Column) -> Column:
            rest = F.slice(parts, i + 4, F.size(parts))
            listed = F.filter(F.slice(rest, 1, F.greatest(F.array_position(rest, F.lit("]")).cast("int") - 1, F.lit(0))), lambda x: x != ",")
            return F.when(at(i + 2) == "[", listed).when(at(i + 2) == "{", F.array().cast("array<string>")).otherwise(F.array(at(i + 2)))

        strings = F.filter(F.flatten(F.transform(keys, told)), lambda x: x.startswith('"') & (x != '""'))
        return F.transform(strings, lambda x: F.try_variant_get(F.try_parse_json(x), "$", "string"))

    return F.array_sort(F.array_distinct(F.transform(F.array(parts), cut)[0]))


def page_types(html: Column) -> Column:
    """The distinct types of all JSON-LD of a page, sorted; broken scripts are left out."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(structured_data(html), json_types))))


def first_link(links: Column, pattern: str) -> Column:
    """The first link whose text or address matches."""
    return F.try_element_at(F.filter(links, lambda x: x["text"].rlike(pattern) | x["href"].rlike(pattern)), F.lit(1))["href"]


def robots_groups(agent: str, body: str) -> tuple[list[tuple[bool, str]], float | None]:
    """((allow, path pattern), crawl delay in seconds) of the group of a robots.txt that names the agent, else of the * group."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    naming = False
    for line in body.splitlines():
        field, colon, value = (x.strip() for x in line.split("#")[0].partition(":"))
        if not colon or not field:
            continue
        if field.lower() == "user-agent":
            if not naming:
                groups.append(([], [], []))
            groups[-1][0].append(value.lower())
            naming = True
            continue
        naming = False
        if groups and field.lower() in ("allow", "disallow") and value:
            groups[-1][1].append((field.lower() == "allow", value))
        elif groups and field.lower() == "crawl-delay" and re.fullmatch(r"\d+(?:\.\d+)?", value):
            groups[-1][2].append(float(value))
    own = next((g for g in groups if any(n != "*" and n in agent.lower() for n in g[0])), None) or next((g for g in groups if "*" in g[0]), ([], [], []))
    return own[1], own[2][-1] if own[2] else None


def robots_rules(agent: str, body: str) -> list[tuple[bool, str]]:
    """(allow, path pattern) of the agent's group."""
    return robots_groups(agent, body)[0]


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, host, path) with allowed: the longest matching rule (host, pattern, allow) decides, allow wins ties, no rule allows."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.col("pattern"), r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*"))
    met = urls.select("url", "host", "path").distinct().join(rules, "host").where(F.regexp_like("path", regex))
    best = met.groupBy("url").agg(F.max(F.struct(F.length("pattern").alias("n"), "allow"))["allow"].alias("_a"))
    return urls.join(best, "url", "left").withColumn("allowed", F.coalesce("_a", F.lit(True))).drop("_a")


def probe_urls(hosts: DataFrame, paths: Sequence[str]) -> DataFrame:
    """(domain, url): every domain with every candidate path; the list of paths is a constant."""
    return hosts.select("domain", F.explode(F.array(*[F.lit(p) for p in paths])).alias("_p")).select("domain", F.concat(F.lit("https://"), "domain", "_p").alias("url"))


def capped_per_source(rows: DataFrame, source: str, order: Sequence[Column], most: int = 60) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def institutions(seeds: DataFrame, payloads: DataFrame, links: DataFrame) -> DataFrame:
    """(domain, name, website, country, source): candidates from seeds (name, domain, country), a dataset's JSON bodies (body) and harvested links (text, href).

    A body is a list of objects with a name and any of domains, web_pages or website. The
    first source of a domain wins, in the order seed, dataset, partner; then the least name.
    """
    kind = "array<struct<name:string,domains:array<string>,web_pages:array<string>,website:string,country:string>>"
    rows = payloads.select(F.explode(F.from_json("body", kind)).alias("j"))
    site = F.coalesce(F.try_element_at("j.domains", F.lit(1)), F.try_element_at("j.web_pages", F.lit(1)), F.col("j.website"))
    told = (
        seeds.select(F.lit(1).alias("r"), F.lit("seed").alias("source"), "name", normal_domain(F.col("domain")).alias("domain"), "country")
        .unionByName(rows.select(F.lit(2).alias("r"), F.lit("dataset").alias("source"), F.col("j.name").alias("name"), normal_domain(site).alias("domain"), F.col("j.country").alias("country")))
        .unionByName(links.select(F.lit(3).alias("r"), F.lit("partner").alias("source"), F.col("text").alias("name"), normal_domain(F.col("href")).alias("domain"), F.lit(None).cast("string").alias("country")))
    )
    best = told.where((F.col("domain") != "") & F.col("name").isNotNull()).groupBy("domain").agg(F.min(F.struct("r", "name", "source", "country")).alias("b"))
    return best.select("domain", "b.name", F.concat(F.lit("https://"), "domain").alias("website"), "b.country", "b.source")


def rollout(institutions: DataFrame, countries: int | None = None) -> DataFrame:
    """institutions (domain, name, country, ...) in countries that are rolled out, with countryCode, priority and turn.

    country is a code, or a name of the table of countries; others are not rolled out.

    turn counts the institutions of a country in order of their domains, so that a crawl takes
    the first of every country before the second of any. countries: only so many, by priority.
    A domain that is there twice counts once, for the country of the higher priority.
    """
    own = F.upper(F.trim("country"))
    code = F.coalesce(country_code(F.col("country")), F.when(rollout_priority(own) > 0, own))
    coded = institutions.withColumn("countryCode", code).withColumn("priority", rollout_priority(F.col("countryCode"))).where(F.col("priority") > 0)
    if countries is not None:
        floor = sorted(rollout_priorities().values(), reverse=True)[: max(countries, 1)][-1]
        coded = coded.where(F.col("priority") >= floor)
    once = Window.partitionBy("domain").orderBy(F.desc("priority"), "countryCode", "name")
    coded = coded.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    return coded.withColumn("turn", F.row_number().over(Window.partitionBy("countryCode").orderBy("domain")))


def seed_dimension(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(name, domain, country): institutions to begin with, given by the caller."""
    return spark.createDataFrame(list(rows), "name string, domain string, country string")
