"""Queries of job and tender listings, over pages that Spark puts together out of parts by brand, beside the table of pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import classify as K
from tidewater.functions import notices as N
from tidewater.functions import text as T
from tidewater.plans.catalog import query
from tidewater.plans.session import stored
from tidewater.sources import crawl_rules as R
from tidewater.sources import listings as L
from tidewater.sources import pages as S

c = F.col
NOW = datetime(2026, 4, 1)
_HOST = "'https://b' || replace(p_brand, 'Brand#', '') || '.example.org'"
_NUMBER = "cast(replace(p_brand, 'Brand#', '') as int)"
#: Keys of parts whose lines are put together at once.
_RUN = 10_000


def _shown(t):
    """(source, url, html): a brand's careers page and the hub it links to. Two brands of four list anchors, one has JSON, one cards."""
    item = F.expr("concat('<li><a href=\"', case when p_partkey % 3 = 2 then '/insurance/job-' else '/careers/job-' end, p_partkey, '\">', p_name, ' Officer ', p_partkey, '</a> in Nairobi</li>')")
    again = F.expr("concat('<li><a href=\"/careers/job-', p_partkey, '?utm_source=x\">', p_name, ' officer</a></li>')")
    coded = F.expr("concat('{\\\\\"title\\\\\":\\\\\"', p_name, ' Officer\\\\\",\\\\\"closingDate\\\\\":\\\\\"2026-0', p_partkey % 9 + 1, '-10\\\\\",\\\\\"jobType\\\\\":\\\\\"x\\\\\",\\\\\"url\\\\\":\\\\\"', host, '/careers/job-', p_partkey, '\\\\\"}')")
    card = F.expr("concat('<div><h3>', p_name, ' Manager</h3><p>Closes on 12 ', if(p_partkey % 2 = 0, 'May', 'March'), ' 2026</p><a href=\"/careers/job-', p_partkey, '\">More</a></div>')")
    k, kind = c("p_partkey"), c("number") % 4
    parts = t("part").withColumn("host", F.expr(_HOST)).withColumn("number", F.expr(_NUMBER)).withColumn("run", F.floor(k / _RUN))
    shown = F.when(kind == 2, coded).when(kind == 3, card).when(k % 3 != 1, item)
    again = F.when((kind < 2) & (k % 3 == 1), item).when((kind < 2) & (k % 6 == 0), again)
    # a brand's lines by runs of keys, then its runs, so that no task holds a brand's parts one by one
    listed = lambda by, html: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(html.isNotNull(), F.struct(by, html.alias("h"))))), lambda x: x["h"]), "")
    runs = parts.groupBy("p_brand", "host", "number", "run").agg(listed("p_partkey", shown).alias("first"), listed("p_partkey", again).alias("second"))
    pages = runs.groupBy("p_brand", "host", "number").agg(listed("run", c("first")).alias("first"), listed("run", c("second")).alias("second"))
    body = F.when(kind < 2, F.concat(F.lit('<ul><a href="/vacancies/page-2">Vacancies</a>'), "first", F.lit("</ul>"))).when(kind == 2, F.concat(F.lit("<p>Jobs</p><script>self.push([1,'"), "first", F.lit("'])</script>"))).otherwise(c("first"))
    main = pages.select(c("p_brand").alias("source"), F.concat("host", F.lit("/careers")).alias("url"), body.alias("html"))
    hub = pages.where("number % 4 < 2").select(c("p_brand").alias("source"), F.concat("host", F.lit("/vacancies/page-2")).alias("url"), F.concat(F.lit("<ul>"), "second", F.lit("</ul>")).alias("html"))
    return main, hub


_EMBEDDED = f"""select *, row_number() over (partition by p_brand order by p_partkey) as r from (
  select p_brand, p_name || ' Officer' as title, {_HOST} || '/careers/job-' || p_partkey as url, p_partkey from part where {_NUMBER} % 4 = 2 and p_partkey % 9 + 1 >= 4
  qualify row_number() over (partition by p_brand, p_name order by p_partkey) = 1) qualify r <= 40"""


@query(f"""with a as (select p_brand, (p_partkey % 3)::int as hub, p_partkey, p_name || ' Officer ' || p_partkey as title, 'Nairobi' as location, 'anchor' as via from part where {_NUMBER} % 4 < 2 and p_partkey % 3 < 2),
  e as (select p_brand, 0 as hub, p_partkey, title, null as location, 'embedded' as via from ({_EMBEDDED})),
  h as (select p_brand, 0 as hub, p_partkey, p_name || ' Manager' as title, null as location, 'heading' as via from part where {_NUMBER} % 4 = 3 and p_partkey % 2 = 0 qualify row_number() over (partition by p_brand, p_name order by p_partkey) = 1),
  u as (select *, {_HOST} || '/careers/job-' || p_partkey as url from (from a union all from e union all from h)),
  f as (select * from u where {_NUMBER} % 8 <> 0 or url like '%0' or url like '%5'),
  r as (select *, (row_number() over (partition by p_brand order by hub, p_partkey))::int as rank from f)
select p_brand as source, rank, title, url, location, via from r where rank <= 60""")
def src8_scraped_listings(t):
    """Anchors of careers pages and their hubs, JSON and cards where those give nothing, an address filter, 60 rows a source."""
    main, hub = _shown(t)
    shown = stored(main.withColumn("main", F.lit(True)).unionByName(hub.withColumn("main", F.lit(False))), "shown")
    pages = shown.select("url", "html").unionByName(t("pages").select("url", "html"))
    sources = shown.where("main").select("source", "url", F.when(F.expr("cast(replace(source, 'Brand#', '') as int) % 8 = 0"), "job-[0-9]*[05]$").alias("url_filter"))
    return L.scraped(sources, pages, NOW)


@query(f"select p_brand as source, title, url from ({_EMBEDDED})")
def src9_embedded_jobs(t):
    """Jobs in the JSON of pages: titles, addresses and dates out of spans."""
    main, _ = _shown(t)
    return L.embedded_jobs(main, NOW).select("source", "title", c("job_url").alias("url"))


#: Texts and addresses whose combinations are links, and for SQL what a rule sees in each: a veto, a role, a product, a hub, hiring words, a title's capitals; a veto, a career address.
_TEXTS = (
    ("Relationship Manager", "role caps"), ("Personal Loans", "product"), ("Current Vacancies", "hub"), ("Board of Directors", "veto"), ("credit officer, apply by Friday", "role hiring"), ("Search all of it here and there and everywhere", ""),
    ("Loans Officer", "role product caps"), ("Officer", "role"), ("Deadline 3 May", "hiring"), ("Employee of the Year", "veto"), ("IT support trainees", "role"), ("go", "short"), ("Savings", "product"),
)
_PATHS = (
    ("careers/list/1", "career"), ("careers/insurance/x", "veto"), ("careers/employee-stories/x", "veto"), ("jobs/awards/x", "veto"), ("wp-content/uploads/2026/jobs/b.png?x=1", "veto"), ("careers/personal-banking", "veto"), ("ebanking/jobs/", "veto"),
    ("our-people/jobs", "veto"), ("about", ""), ("latest-vacancies", "career"), ("life-at-us/careers/", "veto"), ("careers/media-officer", "veto"), ("insurances/jobs/", "career"), ("uploads/a.pdf", ""), ("trade-finance/jobs", "veto"), ("testimonial-x/jobs", "veto"),
    ("recruitment", "career"), ("history/jobs?a=1", "career"), ("payment-transfers/jobs", "veto"),
)
_HOSTS = (("https://b.co.ke/", ""), ("https://ib.b.co.ke/", "veto"), ("https://b.co.ke:8443/", ""), ("https://x.myworkdayjobs.com/", "system"), ("https://x.myworkdayjobs.com/en/job/", "detail"))


def _link(keys):
    """One of the combinations for each key."""
    pick = lambda of, n: F.element_at(F.array(*(F.lit(x) for x, _ in of)), (F.pmod(F.floor(keys / n), F.lit(len(of))) + 1).cast("int"))
    return pick(_TEXTS, 1), F.concat(pick(_HOSTS, len(_TEXTS)), pick(_PATHS, len(_TEXTS) * len(_HOSTS)))


def _seen(of, key, n):
    """SQL: what is seen in the chosen one."""
    return f"([{', '.join(repr(' ' + x + ' ') for _, x in of)}])[({key} // {n} % {len(of)} + 1)::int]"


@query(f"""with s as (select o_orderkey, {_seen(_TEXTS, 'o_orderkey', 1)} as t, {_seen(_HOSTS, 'o_orderkey', len(_TEXTS))} as h, {_seen(_PATHS, 'o_orderkey', len(_TEXTS) * len(_HOSTS))} as p from orders),
  f as (select o_orderkey, t like '% short %' or t like '% veto %' or h like '% veto %' or p like '% veto %' or (t like '% product %' and t not like '% role %') as no, t like '% role %' as role,
    case when h like '% detail %' then 6 when h like '% system %' then 4 else 0 end + 3 * (p like '% career %' or h like '% detail %')::int + 3 * (t like '% role %')::int + 2 * (t like '% hiring %')::int + (t like '% caps %')::int as score,
    h like '% system %' as system, t like '% hub %' as hub, p like '% career %' or h like '% detail %' as career, t = '  ' as long from s)
select o_orderkey, case when no then 'reject' when system and not role then 'careers_page' when score >= 5 then 'posting' when hub or (career and not long) then 'careers_page' else 'reject' end as type,
  case when no or (system and not role) then 0 else score end as score from f""")
def cls3_job_links(t):
    """The job rules over combinations of texts, hosts and paths."""
    text, href = _link(c("o_orderkey"))
    return t("orders").select("o_orderkey", N.job_link(text, href, F.lit("")).alias("v")).select("o_orderkey", "v.type", "v.score")


_NOTICES = (
    ("Supply of desks KPA/9A.1/PT/24", "word reference"), ("Current tenders", "hub"), ("Tender results 2026", "veto"), ("Look here", ""), ("Expression of Interest no: AB12/345-6 closing soon", "word reference due"), ("ICT, supply, delivery and more", "word"), ("Deadline near", "due"),
    ("Procurement opportunities for the financial year that begins", "longhub"), ("RFP", "short"), ("Contact us", "veto"), ("Bids 7", "word"),
)
_PLACES = (
    ("tenders/x", "at"), ("y", ""), ("docs/a.pdf?v=2", "pdf"), ("media/tenders/x", "veto"), ("insurance/tender", "veto"), ("open-procurement", "at"), ("procurement/notice.pdf", "at pdf"), ("forex", "veto"), ("stories/tenders", "veto"), ("notices-2026", "at"), ("press-room/bids/1", "veto"), ("pressroom/bids/1", "at"),
)


@query(f"""with s as (select o_orderkey, {_seen(_NOTICES, 'o_orderkey', 1)} as t, {_seen(_PLACES, 'o_orderkey', len(_NOTICES))} as p from orders),
  f as (select o_orderkey, t like '% short %' or t like '% veto %' or p like '% veto %' as no, t like '% hub %' as hub, t like '% longhub %' as longhub, p like '% at %' as placed,
    3 * (t like '% word %' or t like '% hub %')::int + 3 * (p like '% at %')::int + 2 * (t like '% reference %')::int + (t like '% due %')::int + (p like '% pdf %')::int as score, t like '% longhub %' or t like '% reference due %' as long from s)
select o_orderkey, case when no then 'reject' when hub then 'careers_page' when score >= 5 then 'posting' when longhub or (placed and not long) then 'careers_page' else 'reject' end as type, case when no or hub then 0 else score end as score from f""")
def cls4_tender_links(t):
    """The tender rules over combinations of texts and paths."""
    pick = lambda of, n: F.element_at(F.array(*(F.lit(x) for x, _ in of)), (F.pmod(F.floor(c("o_orderkey") / n), F.lit(len(of))) + 1).cast("int"))
    v = N.tender_link(pick(_NOTICES, 1), F.concat(F.lit("https://a.ke/"), pick(_PLACES, len(_NOTICES))), F.lit(""))
    return t("orders").select("o_orderkey", v.alias("v")).select("o_orderkey", "v.type", "v.score")


#: JSON-LD of a page, put together in words that Spark and DuckDB share: graphs, lists of types, nested values, a string that looks like a key, a type that is an object, broken JSON.
_LINKED = """'<head><script type="application/ld+json">{"@graph": [{"@type": "Kind' || (page_id % 5) || '", "name": "says \\\\"@type\\\\": \\\\"No\\\\""}, {"in": {"deep": [{"x": 1, "@type": ["List' || (page_id % 3) || '", "Deep"]}]}}]' || (case when page_id % 4 = 0 then ',' else '' end)
  || (case when page_id % 4 = 1 then ', "@type": {"@id": "x", "@type": "Inner"}' else '' end) || '}</script><SCRIPT type=''application/ld+json''>[{"@type": "Second"}, {"a": {"@type": null}}]</SCRIPT></head>' || html"""


@query(f"""select page_id, array_to_string(list_sort((case when page_id % 4 = 0 then ['Second'] else ['Second', 'Deep', 'Kind' || (page_id % 5), 'List' || (page_id % 3)] end) || (case when page_id % 4 = 1 then ['Inner'] else [] end)), ',') as types,
  {_LINKED.replace(chr(92) * 2, chr(92))} like '%ld+json%' as has from pages""")
def jsn2_page_types(t):
    """Types at any depth of the JSON-LD of whole pages."""
    html = F.expr(_LINKED)
    return t("pages").select("page_id", F.array_join(S.page_types(html), ",").alias("types"), html.contains("ld+json").alias("has"))


_ROBOTS = """case length(host) % 4 when 0 then concat('User-agent: *', chr(10), 'Disallow: /de/', chr(10), 'Allow: /de/1', chr(10), 'Crawl-delay: 2')
  when 1 then concat('Disallow: /', chr(10), 'user-agent: other', chr(10), 'User-Agent: TestBot # us', chr(13), chr(10), 'Disallow: /*page=', chr(10), 'Disallow: /fr/*5$', chr(10), 'Disallow:', chr(10), 'Crawl-delay: 99', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow: /')
  when 2 then concat('User-agent: bingbot', chr(10), 'Disallow: /') end"""


@query(r"""with p as (select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as host, regexp_extract(url, '^[^:]+://[^/?#]*([^#]*)', 1) as path from pages)
select page_id, case length(host) % 4 when 0 then not path like '/de/%' or path like '/de/1%' when 1 then not (path like '%page=%' or regexp_matches(path, '^/fr/.*5$')) else true end as allowed,
  case length(host) % 4 when 0 then 2000 when 1 then 60000 end::bigint as delay_ms from p""")
def src14_robots_of_hosts(t):
    """Many hosts' rules, parsed on the executors: groups, agents, wildcards, ends, delays, hosts without rules."""
    hosts = t("pages").select(F.lower(F.regexp_extract("url", "^https?://([^/?#:]+)", 1)).alias("host")).distinct()
    verdicts = R.robots_verdicts(t("pages"), hosts.select("host", F.expr(_ROBOTS).alias("body")), "TestBot")
    return t("pages").select("page_id", "url").join(verdicts, "url").select("page_id", "allowed", "delay_ms")


_SHELL = """concat(case page_id % 6 when 0 then '<div class="a" id=''root''> </div>' when 1 then '<script>window.__NUXT_DATA__' when 2 then '<script>window.__INITIAL_STATE__ =' when 3 then '<noscript>Please enable  JavaScript now' else '' end, case when page_id % 7 = 0 then null when page_id % 7 = 1 then '' else html end)"""
_READ = "substring(html, 1, cast(case when page_id % 7 = 0 then 0 else page_id * 37 % 1100 end as int))"


@query(f"""with p as (select page_id, case when page_id % 7 = 0 then '' else {_SHELL.replace('concat(', 'concat(', 1)} end as source, length({_READ}) as size from pages)
select page_id, source = '' or (size <= 900 and (regexp_matches(source, '(?i)<div[^>]+id=["''](root|app|__next|__nuxt)["''][^>]*>\\s*</div>') or source like '%window.__INITIAL_STATE__%'
  or regexp_matches(source, '(?i)<noscript>[^<]*(enable\\s+javascript|requires\\s+javascript)') or (length(source) > 6000 and size / length(source) < 0.03) or size < 250)) as render from p""")
def src5_render_gate(t):
    """Pages with and without shells, with more and less text."""
    html = F.when(c("page_id") % 7 != 0, F.expr(_SHELL))
    return t("pages").select("page_id", S.needs_render(html, F.expr(_READ)).alias("render"))


@query(r"""with p as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '(?i)&[a-z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g')) as x from pages),
  s as (select page_id, x, case when length(x) > 4000 then length(x) // 3 else 0 end as start from p), f as (select *, strpos(substr(x, start + 1), '. ') as stop from s),
  g as (select page_id, trim(substr(x, case when start > 0 and stop > 0 and stop - 1 < 600 then start + stop + 2 else start + 1 end, 1200)) as y from f)
select page_id, case when regexp_matches(y, '^\s*[\[{]|(?i)"(?:widget|url|externalSpa|props|__)":') or length(regexp_replace(y, '[^A-Za-z]', '', 'g')) < 0.55 * length(y) then '' else y end as snippet from g""")
def txt17_snippets(t):
    """Prose from the middle of whole pages."""
    return t("pages").select("page_id", T.snippet(c("html")).alias("snippet"))


#: Parts of pages whose combinations are judged; each body part is one kind of evidence.
_PAGE_TITLES = ("Masters Scholarship 2026", "Prizes for students", "Campus life", "Closed scholarships archive", "Privacy policy")
_PAGE_URLS = ("https://a.org/x", "https://a.org/scholarships/x", "https://a.org/news/x", "https://a.org/y")
_EVIDENCE = ("Tuition fees are covered in full.", "Applicants must be citizens of Kenya.", "Submit your application form online to apply.", "The deadline is 1 May 2026.")
_FILLER = "The campus lies beside a lake and is open all year round for visitors who like long walks. Trees, birds and benches are found there in all seasons, and so are cats."
_FOCUS = "A scholarship is offered. This scholarship helps. The scholarship is yours."


@query("""with k as (select o_orderkey, o_orderkey % 5 as t, o_orderkey // 5 % 4 as u, o_orderkey // 20 % 2 as f, o_orderkey // 40 % 2 as e, o_orderkey // 80 % 2 as a, o_orderkey // 160 % 2 as d, o_orderkey // 320 % 2 as focus,
    o_orderkey % 3 = 0 as heading, o_orderkey % 4 = 1 as typed, o_orderkey % 7 = 0 as links, o_orderkey % 11 = 0 as short from orders),
  n as (select *, f + e + a + d as kinds, 0.25::double * (t in (0, 3))::int + 0.12::double * (t = 1)::int + 0.1::double * (u = 1)::int + 0.1::double * heading::int + 0.2::double * f + 0.18::double * e + 0.16::double * a + 0.14::double * d
    + 0.08::double * typed::int + 0.08::double * focus as raw from k),
  w as (select *, greatest(0, least(1, case kinds when 0 then least(raw, 0.2::double) when 1 then raw - 0.08::double else raw end)) as score, links and kinds <= 2 and focus = 0 as hub,
    case when short then 0 when u = 2 or t = 4 or (t = 2 and not heading and focus = 0) then 0 when t = 3 then 0.1::double end as out from n)
select o_orderkey, out is null and score >= 0.55 and not hub as is_award, round(coalesce(out, score), 3)::double as score, out is null and hub as is_hub, f = 1 and not short as funding from w""")
def cls2_award_pages(t):
    """The page rules over combinations of titles, addresses, headings, evidence, links and types out of JSON-LD."""
    k = c("o_orderkey")
    bit = lambda n: F.floor(k / n) % 2 == 1
    pick = lambda of, n: F.element_at(F.array(*map(F.lit, of)), (F.floor(k / n) % len(of) + 1).cast("int"))
    parts = [F.when(bit(20 * 2**i), F.lit(p)) for i, p in enumerate((*_EVIDENCE, _FOCUS))]
    body = F.when(k % 11 == 0, F.lit("Short.")).otherwise(F.concat_ws(" ", F.lit(_FILLER), *parts))
    types = S.json_types(F.when(k % 4 == 1, '{"x": [{"@type": "Grant"}]}').otherwise('{"@type": "Person"}'))
    links = F.when(k % 7 == 0, F.array_repeat(F.lit("Scholarship A"), 6)).otherwise(F.array(F.lit("Home")))
    pages = t("orders").select(
        "o_orderkey", pick(_PAGE_URLS, 5).alias("url"), pick(_PAGE_TITLES, 1).alias("title"), F.lit("").alias("meta"), F.array(F.when(k % 3 == 0, "Scholarship guide").otherwise("Guide")).alias("headings"),
        body.alias("text"), links.alias("link_texts"), types.alias("structured_types"),
    )
    v = K.award_pages(pages)
    return v.select("o_orderkey", c("verdict.is_award").alias("is_award"), c("verdict.score").alias("score"), c("verdict.is_hub").alias("is_hub"), c("verdict.evidence.funding").alias("funding"))
