"""Queries of the URL, text, hash, date, status, change and resolution functions on the sample tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import dates as D
from tidewater.functions import money as M
from tidewater.functions import text as T
from tidewater.functions import urls as U
from tidewater.functions.patterns import spread
from tidewater.operators import lifecycle as L
from tidewater.operators import relational as R
from tidewater.plans.catalog import query

c = F.col
NOW = datetime(1996, 6, 1)

_CANON = r"""case when regexp_matches(trim(url), '^[a-zA-Z][a-zA-Z0-9+.-]*://') then
  'https://' || regexp_replace(lower(regexp_extract(trim(url), '^[^:]+://([^/?#]*)', 1)), '^www\.', '')
  || case when length(regexp_extract(trim(url), '^[^:]+://[^/?#]*([^?#]*)', 1)) <= 1 then '/' else regexp_replace(regexp_extract(trim(url), '^[^:]+://[^/?#]*([^?#]*)', 1), '/$', '') end
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'),
    lambda p: length(p) > 0 and not list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'ref', 'referrer', 'source'], string_split(p, '=')[1]))), '&'), ''), '')
  else trim(url) end"""


@query(f"select page_id, {_CANON} as canonical from pages")
def txt1_canonical_url(t):
    return t("pages").select("page_id", U.canonical_url(c("url")).alias("canonical"))


@query(r"select page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') as domain from pages")
def txt2_txt3_domain(t):
    return t("pages").select("page_id", U.domain_of(c("url")).alias("domain"))


@query(r"select page_id, (d = 'example.net' or suffix(d, '.example.net')) as inside from (select page_id, regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') as d from pages)")
def txt4_same_site(t):
    return t("pages").select("page_id", U.same_site(c("url"), F.lit("example.net")).alias("inside"))


@query(r"""select p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(trim(regexp_replace(lower(p_name || ' (2027/28) Scholarships for the classes of 2026'), '\b(?:19|20)\d{2}\s*[/-]\s*(?:19|20)?\d{2}\b|\b(?:19|20)\d{2}\b|[^a-z0-9]+', ' ', 'g')), ' +'),
    lambda w: length(w) > 0 and not list_contains(['the','a','an','of','for','in','at','to','and','on','by','programme','program','scheme','award','awards'], w)),
    lambda w: case when length(w) <= 3 or regexp_matches(w, '(?:ss|us|is|as)$') then w when suffix(w, 'ies') then w[:-4] || 'y' else regexp_replace(w, 's$', '') end), ' ') as title_key from part""")
def txt5_txt6_title_key(t):
    return t("part").select("p_partkey", T.title_key(F.concat("p_name", F.lit(" (2027/28) Scholarships for the classes of 2026"))).alias("title_key"))


@query(r"select doc_id, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) as n from documents")
def txt7_clean_text(t):
    return t("documents").select("doc_id", F.length(T.clean_text(c("text"))).cast("long").alias("n"))


@query(r"select doc_id, substr(sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 32) as hash from documents")
def txt8_content_hash(t):
    return t("documents").select("doc_id", T.content_hash(c("text")).alias("hash"))


@query("select p_partkey, substr(sha256(lower(trim(p_brand)) || '|' || lower(trim(p_name)) || '|' || p_size), 1, 32) as key from part")
def txt9_fingerprint(t):
    return t("part").select("p_partkey", T.fingerprint(c("p_brand"), c("p_name"), c("p_size")).alias("key"))


@query(r"""select page_id, case when regexp_matches(href, '^(mailto:|#)') then null when regexp_matches(href, '^https?://') then href else 'https://h.example.org' || href end as url from
  (select page_id, case page_id % 4 when 0 then '/a/' || page_id when 1 then 'mailto:x@y.z' when 2 then '#top' else url end as href from pages)""")
def txt10_resolve_url(t):
    href = F.when(c("page_id") % 4 == 0, F.concat(F.lit("/a/"), "page_id")).when(c("page_id") % 4 == 1, "mailto:x@y.z").when(c("page_id") % 4 == 2, "#top").otherwise(c("url"))
    return t("pages").select("page_id", U.resolve_url(href, F.lit("https://h.example.org/x/y")).alias("url"))


@query(r"""select page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?(page=2)&ref=x$|\?utm_source=feed$', case when url like '%page=2%' then '?page=2' else '' end), '/$', '')) as job_url,
  trim(regexp_replace('11/05/2026  Clerk Apply Now (opens in new window)', '^\d{1,2}/\d{1,2}/\d{2,4}\s+|\s*Apply Now\s*|\s*\(opens in new window\)\s*', '', 'g')) as title from pages""")
def txt11_job_cleanup(t):
    return t("pages").select("page_id", U.job_url(c("url")).alias("job_url"), T.clean_job_title(F.lit("11/05/2026  Clerk Apply Now (opens in new window)")).alias("title"))


@query("select p_partkey, substr(sha256(p_brand || ':' || p_name || ':' || p_type), 1, 16) as hash from part")
def txt12_job_hash(t):
    return t("part").select("p_partkey", T.job_hash(c("p_brand"), c("p_name"), c("p_type")).alias("hash"))


@query(r"""select doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(1), 'g'), '\x01|\n+|\s[•·▪‣–—]\s'),
  lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) between 3 and 599)) as n from documents""")
def txt13_sentences(t):
    return t("documents").select("doc_id", F.size(T.sentences(c("text"))).cast("long").alias("n"))


@query(r"""select doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1), 9) as share,
  length(text) = 0 or regexp_matches(text, '^\s*[\[{]') or length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / greatest(length(text), 1) < 0.55 as debris from documents""")
def txt14_debris(t):
    return t("documents").select("doc_id", F.round(T.letter_share(c("text")), 9).alias("share"), T.is_debris(c("text")).alias("debris"))


@query(r"select p_partkey, trim(p_name) as title from part")
def txt15_derived_title(t):
    return t("part").select("p_partkey", T.derived_title(F.concat("p_name", F.lit(" | University — Home")), c("p_brand")).alias("title"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '2547' || lpad(c_custkey::varchar, 8, '0') when c_custkey % 3 = 1 then '2541' || lpad(c_custkey::varchar, 8, '0') end as phone from customer")
def txt16_phone(t):
    padded = F.lpad(c("c_custkey").cast("string"), 8, "0")
    raw = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("07"), padded)).when(c("c_custkey") % 3 == 1, F.concat(F.lit("+254 1"), padded)).otherwise(F.concat(F.lit("555"), padded))
    return t("customer").select("c_custkey", T.phone_254(raw).alias("phone"))


@query()
def txt17_snippet(t):
    return t("pages").select("page_id", T.snippet(c("html")).alias("snippet"))


def _dated(t):
    return spread(t("orders").select("o_orderkey", "o_orderdate")).select("o_orderkey", "o_orderdate", F.concat(F.lit("Applications close on "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit(".")).alias("text"), F.lit("GB").alias("country"))


@query("select o_orderkey, (date_trunc('day', o_orderdate) + interval '23 hours 59 minutes 59.999 seconds')::timestamp as date, 0.95::double as confidence from orders")
def dat1_parse_date(t):
    at = D.parse_date(c("text"), c("country"))
    return _dated(t).select("o_orderkey", at.alias("at")).select("o_orderkey", c("at.date").alias("date"), c("at.confidence").alias("confidence"))


@query("select o_orderkey, 'FIXED' as kind, (date_trunc('day', o_orderdate) + interval '23 hours 59 minutes 59.999 seconds')::timestamp as date, 'CONFIRMED' as certainty from orders")
def dat2_deadline(t):
    return D.with_deadline(_dated(t), "text", "country", NOW).select("o_orderkey", "deadline.kind", "deadline.date", "deadline.certainty")


@query("select o_orderkey, (date_part('year', o_orderdate)::int)::varchar || '/' || lpad(((date_part('year', o_orderdate)::int + 1) % 100)::varchar, 2, '0') as year, 'for two years' as duration from orders")
def dat3_academic_year(t):
    y = F.year("o_orderdate")
    text = F.concat(F.lit("Entry in "), y, F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"), F.lit(", funded for two years"))
    return t("orders").select("o_orderkey", D.academic_year(text).alias("year"), D.duration(text).alias("duration"))


@query("select o_orderkey, (timestamp '2029-03-03' + to_days((o_orderkey % 28)::int) + interval '23 hours 59 minutes 59.999 seconds')::timestamp as date from orders")
def dat4_tender_date(t):
    day = F.date_add(F.lit(datetime(2029, 3, 3)).cast("date"), (c("o_orderkey") % 28).cast("int"))
    text = F.concat(F.lit("Opened 01/02/2021, closes "), F.date_format(day, "d MMM yyyy"), F.lit(" or on 2040-01-01"))
    return spread(t("orders").select("o_orderkey")).select("o_orderkey", D.tender_date(text).alias("date"))


@query("select event_id, ts >= timestamp '2024-01-29 23:57:12' and ts <= timestamp '2024-01-30 23:57:12' as last_day, strftime(ts, '%Y-%m') as month from events")
def dat6_dat8_windows(t):
    now = datetime(2024, 1, 30, 23, 57, 12)
    return t("events").select("event_id", (D.within(c("ts"), now, before="24 hours") & (c("ts") <= F.lit(now))).alias("last_day"), D.month_key(c("ts")).alias("month"))


@query("select p_partkey, least(1440.0, 15 * pow(2.0, greatest(0, p_size % 12 - 1)))::double as minutes from part")
def dat7_backoff(t):
    return t("part").select("p_partkey", R.backoff_minutes(c("p_size") % 12).alias("minutes"))


@query("select p_partkey, (round((p_retailprice + 1000) * 100)::bigint / 100.0)::double as amount, 'GBP' as currency, 'per year' as period from part")
def mth1_money(t):
    text = F.concat(F.lit("A stipend of £"), F.format_number(F.round(c("p_retailprice") + 1000, 2), 2), F.lit(" per year"))
    m = t("part").select("p_partkey", M.parse_money(text).alias("m"))
    return m.select("p_partkey", "m.amount", "m.currency", "m.period")


@query("select p_partkey, p_size * 1000.0::double as amount from part where p_size between 1 and 50")
def mth2_money_near(t):
    text = F.concat(F.lit("Founded in 1871. The stipend is USD "), c("p_size").cast("string"), F.lit("k. Apply now."))
    return t("part").where("p_size between 1 and 50").select("p_partkey", M.money_near(T.sentences(text), "(?i)stipend")["amount"].alias("amount"))


@query("select p_partkey, greatest(0.2, 1 - (p_size % 9) * 0.13)::double as weight, greatest(0.0, least(1.0, p_retailprice / 1500))::double as share from part")
def mth3_mth4_clamp_authority(t):
    return t("part").select("p_partkey", M.authority(c("p_size") % 9 + 1).alias("weight"), M.clamp(c("p_retailprice") / 1500).alias("share"))


@query("select p_partkey, case when p_size between 1 and 100 then p_size end as percent, p_size as awards from part")
def mth5_percent_and_count(t):
    text = F.concat(F.lit("Covers "), c("p_size").cast("string"), F.lit("% of tuition fees. Up to "), c("p_size").cast("string"), F.lit(" scholarships are available."))
    s = T.sentences(text)
    return t("part").select("p_partkey", M.tuition_percentage(s, "(?i)tuition").alias("percent"), M.award_count(s).alias("awards"))


@query("select o_orderkey, (epoch_us(o_orderdate) // 86400000000 + 25569)::bigint as serial from orders")
def mth6_excel_serial(t):
    return t("orders").select("o_orderkey", D.excel_serial(c("o_orderdate")).alias("serial"))


_STATUS = """case when o_orderpriority = '5-LOW' then 'CLOSED' when p < 0.45 then (case when o_orderpriority = '1-URGENT' then 'VERIFIED' else 'UNDER_REVIEW' end)
  when o_orderstatus = 'P' then 'OPEN' when d is null then (case when o_orderpriority = '1-URGENT' then 'VERIFIED' else 'DISCOVERED' end)
  when a < -120 then 'EXPIRED' when a < 0 then 'CLOSED' when a <= 14 then 'CLOSING_SOON' when a > 365 then 'UPCOMING' else 'OPEN' end"""
_STATUS_FROM = """(select *, epoch_us(d) / 86400000000.0 - epoch_us(timestamp '1996-06-01') / 86400000000.0 as a from
  (select *, case when o_orderkey % 6 = 0 then null else o_orderdate end as d, (o_orderkey % 100) / 100.0 as p from orders))"""


def _records(t):
    review = F.when(c("o_orderpriority") == "5-LOW", "REJECTED").when(c("o_orderpriority") == "1-URGENT", "APPROVED").otherwise("AUTO_APPROVED")
    due = F.when(c("o_orderkey") % 6 != 0, c("o_orderdate").cast("timestamp"))
    return t("orders").select(
        c("o_orderkey").alias("id"), F.struct(F.when(c("o_orderstatus") == "P", "ROLLING").otherwise("FIXED").alias("kind"), due.alias("date")).alias("deadline"),
        ((c("o_orderkey") % 100) / 100).alias("confidence"), review.alias("reviewStatus"), F.lit("OPEN").alias("status"), c("o_totalprice"),
    )


@query(f"select o_orderkey as id, {_STATUS} as status from {_STATUS_FROM}")
def sta1_status(t):
    r = _records(t)
    return r.select("id", L.status(c("deadline.kind"), c("deadline.date"), c("confidence"), c("reviewStatus"), F.lit(None).cast("string"), NOW).alias("status"))


@query(f"select 'OPEN→' || s as transition, count(*) as n from (select {_STATUS} as s from {_STATUS_FROM}) where s <> 'OPEN' group by 1")
def sta2_agg18_status_sweep(t):
    return L.transitions(L.status_sweep(_records(t), NOW))


@query("select o_orderkey, case when (o_orderkey % 100) / 100.0 >= 0.75 then 'AUTO_APPROVED' else 'NEEDS_REVIEW' end as review from orders")
def sta3_review_status(t):
    return t("orders").select("o_orderkey", L.review_status((c("o_orderkey") % 100) / 100).alias("review"))


@query("""select o_orderkey as id, 'deadline' as field, strftime(o_orderdate, '%Y-%m-%d') as old_value, strftime(o_orderdate + interval 1 day, '%Y-%m-%d') as new_value, 'MAJOR' as significance from orders where o_orderkey % 7 = 0
  union all select o_orderkey, 'title', o_orderpriority, o_orderpriority || '!', 'MINOR' from orders where o_orderkey % 5 = 0""")
def cdc1_changes(t):
    o = t("orders")
    old = o.select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("title"), F.struct(c("o_orderdate").cast("timestamp").alias("date"), c("o_orderstatus").alias("kind")).alias("deadline"))
    shifted = F.when(c("o_orderkey") % 7 == 0, c("o_orderdate") + F.expr("interval 1 day")).otherwise(c("o_orderdate") + F.expr("interval 1 second")).cast("timestamp")
    kind = F.when(c("o_orderkey") % 11 == 0, "UNKNOWN").otherwise(c("o_orderstatus"))
    title = F.when(c("o_orderkey") % 5 == 0, F.concat("o_orderpriority", F.lit("!"))).otherwise(c("o_orderpriority"))
    new = o.select(c("o_orderkey").alias("id"), title.alias("title"), F.struct(shifted.alias("date"), kind.alias("kind")).alias("deadline"))
    return L.changes(old, new, "id")


@query(r"select substr(sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 32) as hash, min(doc_id) as elected, count(*) as copies from documents group by 1 having count(*) > 1")
def dup1_exact_copies(t):
    g = t("documents").groupBy(T.content_hash(c("text")).alias("hash")).agg(F.min("doc_id").alias("elected"), F.count(F.lit(1)).alias("copies"))
    return g.where("copies > 1")


@query("""with d as (select p_partkey, p_partkey % 4 as k from part), r as (select p_partkey from part where p_partkey % 2 = 0)
  select p_partkey as draft_id, case when k = 0 or k = 2 then p_partkey else p_partkey - 1 end as record_id, case when k = 0 then 'FINGERPRINT' when k = 2 then 'CANONICAL_URL' else 'CONTENT_HASH' end as match_type from d
  where (k in (0, 2) and p_partkey in (select p_partkey from r)) or (k in (1, 3) and p_partkey - 1 in (select p_partkey from r))""")
def dup2_find_copies(t):
    p = t("part").select("p_partkey")
    k = c("p_partkey") % 4
    hash_of = F.concat(F.lit("h"), F.when(k.isin(1, 3), c("p_partkey") - 1).otherwise(c("p_partkey")))
    drafts = p.select(c("p_partkey").alias("draft_id"), F.concat(F.when(k == 0, "f").otherwise("x"), "p_partkey").alias("fingerprint"), F.concat(F.when(k == 2, "u").otherwise("x"), "p_partkey").alias("canonical_url"), hash_of.alias("content_hash"))
    records = p.where("p_partkey % 2 = 0").select(c("p_partkey").alias("record_id"), F.concat(F.lit("f"), "p_partkey").alias("fingerprint"))
    sources = p.where("p_partkey % 2 = 0").select(c("p_partkey").alias("record_id"), F.concat(F.lit("u"), "p_partkey").alias("canonical_url"), F.concat(F.lit("h"), "p_partkey").alias("content_hash"))
    return L.find_copies(drafts, records, sources).select("draft_id", "record_id", "match_type")


@query("select a.p_partkey as a, b.p_partkey as b, round(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) / len(list_distinct(list_concat(string_split(a.p_name, ' '), string_split(b.p_name, ' ')))), 9) as similarity from part a join part b on b.p_partkey = a.p_partkey + 1")
def arr1_dup3_jaccard(t):
    p = t("part").select(c("p_partkey").alias("a"), F.split("p_name", " ").alias("x"))
    q = t("part").select(c("p_partkey").alias("b"), F.split("p_name", " ").alias("y"))
    return p.join(q, c("b") == c("a") + 1).select("a", "b", F.round(R.jaccard(c("x"), c("y")), 9).alias("similarity"))


@query("select l_orderkey, array_to_string(list_sort(list(l_partkey::varchar)), ',') as parts, list_sort(list(l_partkey))[1:3]::varchar as head from lineitem group by 1")
def arr2_arr4_sorted_and_sliced(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("p"))
    text = F.array_join(F.array_sort(F.transform("p", lambda x: x.cast("string"))), ",")
    head = F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.array_sort("p"), 1, 3), lambda x: x.cast("string")), ", "), F.lit("]"))
    return g.select("l_orderkey", text.alias("parts"), head.alias("head"))


@query("select p_partkey, list_filter(string_split(p_name, ' '), lambda w: length(w) > 5)[1] as long_word from part")
def arr3_find_first(t):
    return t("part").select("p_partkey", F.try_element_at(F.filter(F.split("p_name", " "), lambda w: F.length(w) > 5), F.lit(1)).alias("long_word"))


@query("select event_id, (props->>'k')::int as k from events")
def jsn1_json_path(t):
    return t("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select p_partkey, greatest(0.5, least(1.5, coalesce(map {'Brand#11': 2.0, 'Brand#12': 0.1, 'Brand#13': 1.2}[p_brand], 1.0)))::double as w from part")
def map1_cls8_weight_lookup(t):
    weights = F.create_map(*[F.lit(x) for x in ("Brand#11", 2.0, "Brand#12", 0.1, "Brand#13", 1.2)])
    return t("part").select("p_partkey", M.clamp(F.coalesce(F.try_element_at(weights, c("p_brand")), F.lit(1.0)), 0.5, 1.5).alias("w"))


_A = "(select o_orderkey as k, (o_orderkey % 100) / 100.0 as q, o_orderstatus as s, 'kept' as r from orders where o_orderkey % 4 <> 0)"
_B = "(select o_orderkey as k, (o_orderkey % 97) / 100.0 as q, o_orderpriority as s, 'new' as r from orders where o_orderkey % 3 <> 0)"


@query(f"select coalesce(a.k, b.k) as k, case when b.k is not null and (a.k is null or b.q >= a.q - 0.05) then b.q else a.q end::double as q, case when b.k is not null and (a.k is null or b.q >= a.q - 0.05) then b.s else a.s end as s, coalesce(a.r, b.r) as r from {_A} a full join {_B} b on a.k = b.k")
def ups4_quality_gated(t):
    o = t("orders")
    a = o.where("o_orderkey % 4 != 0").select(c("o_orderkey").alias("k"), ((c("o_orderkey") % 100) / 100).alias("q"), c("o_orderstatus").alias("s"), F.lit("kept").alias("r"))
    b = o.where("o_orderkey % 3 != 0").select(c("o_orderkey").alias("k"), ((c("o_orderkey") % 97) / 100).alias("q"), c("o_orderpriority").alias("s"), F.lit("new").alias("r"))
    return L.quality_gated(a, b, "k", "q", ["r"])
