"""Queries of the job and tender classifiers, institutions, and the drafts of records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewater.functions import notices as N
from tidewater.functions.patterns import spread
from tidewater.operators import contracts as V
from tidewater.operators import drafts as D
from tidewater.operators import reconcile as R
from tidewater.plans.catalog import query
from tidewater.plans.record_queries import _award_text
from tidewater.sources import pages as S

c = F.col
NOW = datetime(2026, 4, 1)


@query("""select p_partkey, case p_partkey % 5 when 0 then 'posting' when 1 then 'reject' when 2 then 'careers_page' when 3 then 'reject' else 'careers_page' end as type,
  case p_partkey % 5 when 0 then 7 else 0 end + case p_partkey % 5 when 2 then 3 else 0 end as score from part""")
def cls3_job_link(t):
    k = c("p_partkey") % 5
    text = F.when(k == 0, "Credit Risk Officer").when(k == 1, "Personal Loans").when(k == 2, "Vacancies").when(k == 3, "Board of Directors").otherwise("Search")
    href = F.when(k == 4, "https://x.myworkdayjobs.com/root").when(k == 1, "https://b.co.ke/loans").otherwise("https://b.co.ke/careers/list")
    v = N.job_link(text, href, F.lit(""))
    return t("part").select("p_partkey", v["type"].alias("type"), v["score"].alias("score"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 'posting' when 1 then 'careers_page' when 2 then 'reject' else 'careers_page' end as type, case p_partkey % 4 when 0 then 9 when 3 then 3 else 0 end as score from part""")
def cls4_tender_link(t):
    k = c("p_partkey") % 4
    text = F.when(k == 0, "Supply of desks KPA/9A.1/PT/24 closing soon").when(k == 1, "Current tenders").when(k == 2, "Tender results 2026").otherwise("Look here")
    href = F.when(k == 0, "https://a.ke/tenders/x").when(k == 3, "https://a.ke/tenders/").otherwise("https://a.ke/y")
    v = N.tender_link(text, href, F.lit(""))
    return t("part").select("p_partkey", v["type"].alias("type"), v["score"].alias("score"))


@query("""select n_nationkey, n_nationkey % 3 = 0 as verified, n_nationkey % 3 = 0 as title_match from nation""")
def cls6_institution(t):
    k = c("n_nationkey") % 3
    text = F.when(k == 1, "a shop").otherwise("University campus: faculty, students and research; undergraduate admissions")
    final = F.when(k == 2, "https://other.org/").otherwise("https://www.uni.example.org/home")
    v = N.institution(F.concat(F.lit("University of "), "n_name"), F.lit("uni.example.org"), final, F.concat(F.lit("Home, University of "), "n_name"), F.lit(""), text)
    return t("nation").select("n_nationkey", v["verified"].alias("verified"), v["title_match"].alias("title_match"))


def _drafts(t):
    none = F.array().cast("array<struct<text:string,href:string,context:string>>")
    link = F.array(F.struct(F.lit("Apply now").alias("text"), F.lit("https://a.org/apply").alias("href"), F.lit("").alias("context")))
    pages = spread(t("part").select("p_partkey")).select(
        "p_partkey", F.concat(F.lit("https://a.org/"), "p_partkey").alias("url"), F.lit("Award | Uni").alias("title"), F.lit("").alias("meta"), F.array().cast("array<string>").alias("headings"),
        F.when(c("p_partkey") % 4 < 2, link).otherwise(none).alias("links"), _award_text(c("p_partkey")).alias("text"), F.lit("GB").alias("country"),
    )
    return D.drafts(pages, NOW)


@query("""select p_partkey, case p_partkey % 4 when 0 then 'MASTERS' when 1 then 'PHD' when 2 then 'BACHELORS' else '' end as levels, case p_partkey % 4 when 1 then 'FIXED' else 'UNKNOWN' end as due, 'Award' as title from part""")
def ext1_drafts(t):
    return _drafts(t).select("p_partkey", F.array_join("degreeLevels", ",").alias("levels"), c("deadline.kind").alias("due"), c("award_title").alias("title"))


@query("""select p_partkey, case p_partkey % 4 when 0 then 9 when 1 then 7 when 2 then 4 else 0 end as fields from part""")
def ext2_filled_fields(t):
    d = _drafts(t)
    return d.select("p_partkey", D.fields_extracted(d).alias("fields"))


#: The drafts that are merged, field by field, out of columns of orders (the rules' reading) and of lineitem by order (the second one), in words that Spark and DuckDB share.
_RULES = {
    "title": "case when o_custkey % 7 > 0 then 'Award ' || o_orderpriority end", "provider": "case o_custkey % 3 when 0 then '' when 1 then 'Provider ' || o_orderstatus end", "description": "repeat('d', cast(o_custkey % 120 as int))",
    "level": "case o_custkey % 4 when 0 then 'MASTERS' when 1 then 'PHD' end", "field": "lower(o_orderpriority)", "mode": "case when o_custkey % 2 = 0 then 'UNKNOWN' else 'ONLINE' end",
    "tuition": "case o_orderkey % 5 when 0 then true when 1 then false when 2 then true end", "stipend": "case o_custkey % 5 when 0 then false when 1 then true end", "sure": "(o_custkey % 10) / 10.0e0",
    "amount": "case when o_custkey % 3 > 0 then o_totalprice end", "awards": "cast(nullif(o_custkey % 4, 0) as int)", "kind": "case when o_custkey % 3 = 0 then 'UNKNOWN' else 'MERIT_BASED' end",
    "scope": "case o_orderkey % 4 when 0 then 'UNKNOWN' when 1 then 'INTERNATIONAL' else 'SPECIFIC_COUNTRIES' end", "country": "case when o_custkey % 4 = 0 then 'KE' end", "region": "o_orderstatus",
    "degree": "case when o_custkey % 6 = 0 then 'BACHELORS' end", "ielts": "case o_orderkey % 3 when 0 then true when 1 then false end", "score": "case when o_custkey % 8 > 3 then 6.5e0 end", "supervisor": "case o_custkey % 3 when 0 then true when 1 then false end",
    "paper": "'D' || (o_custkey % 3)", "due": "case when o_custkey % 3 > 0 then o_orderdate end", "apply": "case when o_custkey % 4 = 1 then 'https://a.org/' || o_custkey end", "year": "case when o_custkey % 5 = 0 then '2026' end",
}
_SECOND = {
    "title": "case when n > 1 then repeat(rf, cast(pk % 6 as int)) end", "provider": "case when sk % 4 > 0 then 'Other ' || sk end", "description": "case when n % 3 > 0 then repeat('e', cast(n as int)) end",
    "level": "case n % 3 when 0 then 'MASTERS' when 1 then 'DIPLOMA' end", "field": "case when n % 2 = 0 then 'Field ' || rf end", "mode": "case n % 3 when 0 then 'UNKNOWN' when 1 then 'HYBRID' end",
    "tuition": "case pk % 3 when 0 then true when 1 then false end", "stipend": "case sk % 2 when 0 then true end", "sure": "(pk % 10) / 10.0e0",
    "amount": "case when n > 3 then pk * 1.0e0 end", "awards": "cast(sk as int)", "kind": "case pk % 3 when 0 then 'sports' when 1 then 'two words' when 2 then 'NEED_BASED' end",
    "scope": "case sk % 3 when 0 then 'UNKNOWN' when 1 then 'INTERNATIONAL' else 'SPECIFIC_COUNTRIES' end", "country": "case when n % 2 = 0 then 'UG' end", "region": "rf",
    "degree": "case when pk % 2 = 0 then 'MASTERS' end", "ielts": "case pk % 4 when 0 then true when 1 then false end", "score": "case when sk % 2 = 0 then n + 0.5e0 end", "supervisor": "case pk % 3 when 0 then true when 1 then false end",
    "paper": "'D' || (n % 4)", "due": "case pk % 4 when 0 then '1996-0' || (n % 3) || '-12' when 1 then 'soon' when 2 then '' end", "apply": "case when pk % 3 = 0 then 'https://b.org/' || sk end", "year": "case when n > 2 then '2027' end",
}
_READ_OF = """select l_orderkey, count(*) as n, min(l_partkey) as pk, min(l_suppkey) as sk, min(l_returnflag) as rf from lineitem group by 1 having count(*) > 1"""


def _flat(exprs):
    return [F.expr(e).alias(f"_{name}") for name, e in exprs.items()]


def _draft(df, key, second):
    """A draft's nested fields out of flat columns."""
    some = lambda name: F.array_compact(F.array(c(name)))
    told = lambda name, evidence: F.struct(c(name).alias("value"), F.lit("CONFIRMED").alias("certainty"), c("_sure").alias("confidence"), F.lit("seen").alias(evidence))
    evidence = "evidence" if second else "source_text"
    due = F.when(c("_due").isNull(), "UNKNOWN").otherwise("FIXED")
    title = [c("_title").alias("title")] if second else [c("_title").alias("award_title"), F.lit("").alias("normalizedTitle")]
    number = F.struct(c("_awards").alias("value"), c("_sure").alias("confidence")) if second else c("_awards")
    kinds = [] if second else [F.lit("CONFIRMED").alias("primaryTypeCertainty"), F.array("_kind").alias("types")]
    degree = F.struct(c("_degree").alias("value"), c("_sure").alias("confidence")) if second else c("_degree")
    return df.select(
        c(key).alias("key"), *title, c("_provider").alias("provider"), c("_description").alias("description"), some("_level").alias("degreeLevels"), some("_field").alias("fieldsOfStudy"), some("_mode").alias("studyMode"),
        F.struct(
            told("_tuition", evidence).alias("tuitionCovered"), told("_stipend", evidence).alias("livingStipend"), F.struct(c("_amount").alias("amount"), c("_sure").alias("confidence")).alias("stipendAmount"),
            number.alias("awardCount"), c("_kind").alias("primaryType"), *kinds,
        ).alias("funding"),
        F.struct(c("_scope").alias("scope"), F.lit("CONFIRMED").alias("scopeCertainty"), some("_country").alias("countries"), some("_region").alias("regions")).alias("eligibility"),
        F.struct(
            degree.alias("minimumDegree"), F.struct(F.struct(c("_ielts").alias("required"), c("_score").alias("minScore"), c("_sure").alias("confidence")).alias("ielts")).alias("english"),
            F.array(F.struct(c("_paper").alias("code"), F.lit("second" if second else "first").alias("label"))).alias("documents"),
            (told("_supervisor", evidence) if second else c("_supervisor")).alias("supervisorRequired"),
        ).alias("requirements"),
        F.struct(due.alias("kind"), c("_due").alias("date"), F.lit(0.9).alias("confidence"), F.lit("CONFIRMED").alias("certainty")).alias("deadline"),
        (F.struct(c("_apply").alias("value"), c("_sure").alias("confidence")) if second else c("_apply")).alias("applicationUrl"), c("_year").alias("academicYear"),
    )


def _merged_drafts(t):
    reads = t("lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_returnflag").alias("rf")).where("n > 1")
    return R.reconciled(_draft(t("orders").select("o_orderkey", *_flat(_RULES)), "o_orderkey", False), _draft(reads.select("l_orderkey", *_flat(_SECOND)), "l_orderkey", True), "key")


_BOTH = f"""a as (select o_orderkey, {', '.join(f'{e} as {name}' for name, e in _RULES.items())} from orders),
  b as (select l_orderkey, {', '.join(f'{e} as {name}2' for name, e in _SECOND.items())} from ({_READ_OF})),
  m as (select * from a left join b on o_orderkey = l_orderkey)"""


@query(f"""with {_BOTH}
select o_orderkey, case when l_orderkey is null then 'RULES' else 'HYBRID' end as method,
  case when length(title2) between 4 and 300 then title2 else title end as title, case when coalesce(provider, '') = '' and provider2 is not null then provider2 else provider end as provider,
  case when description2 <> '' and length(description) < 80 then description2 else description end as description,
  array_to_string(list_filter([level, case when level2 is distinct from level then level2 end], lambda x: x is not null), ',') as levels,
  array_to_string(list_filter([field, lower(field2)], lambda x: x is not null), ',') as fields, case when mode = 'UNKNOWN' and mode2 = 'HYBRID' then mode2 else mode end as mode,
  case when tuition is null then tuition2 else tuition end as tuition, case when l_orderkey is null or tuition2 is null then sure when tuition is null then sure2 when tuition = tuition2 then greatest(sure, sure2) else least(sure, 0.5) end::double as tuition_sure,
  case when tuition <> tuition2 then 'PROBABLE' else 'CONFIRMED' end as tuition_certainty, coalesce(stipend, stipend2) as stipend, coalesce(amount, amount2) as amount, coalesce(awards, awards2) as awards,
  case when kind = 'UNKNOWN' and kind2 in ('sports', 'NEED_BASED') then upper(kind2) else kind end as kind, case when kind = 'UNKNOWN' and kind2 in ('sports', 'NEED_BASED') then kind || ',' || upper(kind2) else kind end as kinds,
  case when scope = 'UNKNOWN' and scope2 <> 'UNKNOWN' then scope2 when scope = 'UNKNOWN' and country is null and country2 is not null then 'SPECIFIC_COUNTRIES' else scope end as scope,
  case when scope2 <> 'UNKNOWN' and scope2 <> scope then 'PROBABLE' else 'CONFIRMED' end as scope_certainty, coalesce(country, country2, '') as country,
  case when region2 <> region then region || ',' || region2 else region end as regions, coalesce(degree, degree2) as degree,
  coalesce(ielts, ielts2) as ielts, case when ielts is null and ielts2 is not null then score2 when ielts is not distinct from ielts2 and score is null then score2 else score end as score,
  case when ielts is null and ielts2 is not null then sure2 when ielts <> ielts2 then least(sure, 0.5) else sure end::double as ielts_sure, coalesce(supervisor, supervisor2) as supervisor,
  case when paper2 <> paper then paper || ' first,' || paper2 || ' second' else paper || ' first' end as papers,
  case when due is null and due2 is not null then try_cast(due2 as timestamp) else due end::timestamp as due, case when due is null and due2 is null then 'UNKNOWN' else 'FIXED' end as due_kind,
  case when due is not null and due2 <> '' and coalesce(try_cast(due2 as timestamp) <> due, true) then 0.55 else 0.9 end::double as due_sure, coalesce(apply, apply2) as apply, coalesce(year, year2) as year from m""")
def ext3_merged_drafts(t):
    """Every kind of field of two joined drafts: filled, united, kept, downgraded."""
    m, line = _merged_drafts(t), lambda name: F.array_join(name, ",")
    papers = F.array_join(F.transform("requirements.documents", lambda x: F.concat_ws(" ", x["code"], x["label"])), ",")
    english = c("requirements.english.ielts")
    return m.select(
        c("key").alias("o_orderkey"), "method", c("award_title").alias("title"), "provider", "description", line("degreeLevels").alias("levels"), line("fieldsOfStudy").alias("fields"), line("studyMode").alias("mode"),
        c("funding.tuitionCovered.value").alias("tuition"), c("funding.tuitionCovered.confidence").alias("tuition_sure"), c("funding.tuitionCovered.certainty").alias("tuition_certainty"), c("funding.livingStipend.value").alias("stipend"),
        c("funding.stipendAmount.amount").alias("amount"), c("funding.awardCount").alias("awards"), c("funding.primaryType").alias("kind"), line("funding.types").alias("kinds"),
        c("eligibility.scope").alias("scope"), c("eligibility.scopeCertainty").alias("scope_certainty"), line("eligibility.countries").alias("country"), line("eligibility.regions").alias("regions"),
        c("requirements.minimumDegree").alias("degree"), english["required"].alias("ielts"), english["minScore"].alias("score"), english["confidence"].alias("ielts_sure"), c("requirements.supervisorRequired").alias("supervisor"), papers.alias("papers"),
        c("deadline.date").cast("timestamp").alias("due"), c("deadline.kind").alias("due_kind"), c("deadline.confidence").alias("due_sure"), c("applicationUrl").alias("apply"), c("academicYear").alias("year"),
    )


@query(f"""with {_BOTH}
select o_orderkey, array_to_string(list_filter([
  case when tuition <> tuition2 then 'funding.tuitionCovered: rules=' || tuition || ' ai=' || tuition2 end, case when stipend <> stipend2 then 'funding.livingStipend: rules=' || stipend || ' ai=' || stipend2 end,
  case when scope <> 'UNKNOWN' and scope2 <> 'UNKNOWN' and scope <> scope2 then 'eligibility.scope: rules=' || scope || ' ai=' || scope2 end,
  case when supervisor <> supervisor2 then 'requirements.supervisorRequired: rules=' || supervisor || ' ai=' || supervisor2 end,
  case when ielts <> ielts2 then 'requirements.english.ielts.required: rules=' || ielts || ' ai=' || ielts2 end,
  case when due is not null and due2 <> '' and coalesce(try_cast(due2 as timestamp) <> due, true) then 'deadline.date: rules=' || strftime(due, '%Y-%m-%d') || ' ai=' || due2 end], lambda x: x is not null), '; ') as disagreements from m""")
def ext3_disagreements(t):
    """What the two drafts disagree on, in the order of the fields."""
    return _merged_drafts(t).select(c("key").alias("o_orderkey"), F.array_join("disagreements", "; ").alias("disagreements"))


@query("""select o_orderkey, case o_orderkey % 4 when 0 then true when 1 then true when 2 then false end as value, case o_orderkey % 4 when 0 then 0.95 when 1 then 0.7 when 2 then 0.5 else 0 end::double as confidence, o_orderkey % 4 = 2 as disagrees from orders""")
def ext3_merged_flags(t):
    k = c("o_orderkey") % 4
    flag = lambda value, sure, by: F.struct(value.alias("value"), F.lit(sure).alias("certainty"), by.cast("double").alias("confidence"))
    rule = flag(F.when(k == 0, True).when(k == 2, False), "CONFIRMED", F.when(k.isin(0, 2), 0.9).otherwise(0.0))
    other = flag(F.when(k.isin(0, 1, 2), True), "PROBABLE", F.when(k == 0, 0.95).otherwise(0.7))
    m = t("orders").select("o_orderkey", D.merged_flag(rule, other).alias("m"))
    return m.select("o_orderkey", c("m.value").alias("value"), c("m.confidence").alias("confidence"), c("m.disagrees").alias("disagrees"))


@query("""select p_partkey, confidence >= 0.3 and confidence <= 1 as plausible, confidence from (select p_partkey, case p_partkey % 4
  when 0 then round(0.28 + 0.2 * 0.8 + 0.16 * 0.9 + 0.14 * 0.9 + 0.1 * 0.85 - 0.06, 3) when 1 then round(0.28 + 0.2 * 0.8 + 0.16 * 0.4 + 0.14 * 0.9 + 0.12 * 0.95 + 0.1 * 0.85 - 0.06, 3)
  when 2 then round(0.28 + 0.2 * 0.8 + 0.16 * 0.4 + 0.14 * 0.9 + 0.1 * 0.85 - 0.06, 3) else round(0.28 + 0.2 * 0.8 - 0.06, 3) end::double as confidence from part)""")
def ext4_scores(t):
    s = D.scored(_drafts(t), F.lit("UNIVERSITY"), F.lit(0.8), F.lit(1))
    return s.select("p_partkey", c("confidence").between(0.3, 1).alias("plausible"), "confidence")


@query("select o_orderkey, case when o_orderkey % 2 = 0 and (o_orderkey % 10) / 10.0 > 0.7 then 0.25 else 0.8 end::double as confidence from orders")
def ext5_veto(t):
    return t("orders").select("o_orderkey", D.vetoed(F.lit(0.8), c("o_orderkey") % 2 != 0, (c("o_orderkey") % 10) / 10).alias("confidence"))


@query("select p_partkey, case p_partkey % 4 when 3 then 'NOT_SCHOLARSHIP' else 'OK' end as outcome from part")
def ext7_gate(t):
    return D.gated(_drafts(t), NOW).select("p_partkey", "outcome")


@query("select o_orderkey as record_id, case when o_orderkey % 5 = 0 then 'REPLACED' else o_orderstatus end as status, case when o_orderkey % 5 = 0 then o_orderkey + 1 end as replaced_by from orders")
def ups5_merged_records(t):
    o = t("orders").select(c("o_orderkey").alias("record_id"), c("o_orderstatus").alias("status"))
    merges = o.where("record_id % 5 = 0").select(c("record_id").alias("loser"), (c("record_id") + 1).alias("winner"))
    _, records = D.merged_away(o.select("record_id"), o, merges)
    return records.select("record_id", "status", c("replacedBy").alias("replaced_by"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'https://a.org/careers' end as url from part")
def src10_first_matching_link(t):
    link = lambda text, href: F.struct(F.lit(text).alias("text"), F.lit(href).alias("href"))
    links = F.when(c("p_partkey") % 3 == 0, F.array(link("Home", "https://a.org/"), link("Jobs", "https://a.org/careers"))).otherwise(F.array(link("Home", "https://a.org/")))
    return t("part").select("p_partkey", S.first_link(links, "(?i)jobs|careers").alias("url"))


@query("select e.event_id, list_sort(list(t))::varchar as kinds from (select event_id, unnest(['Grant', 'Course']) as t from events) e group by 1")
def jsn2_types(t):
    text = F.lit('{"@type": "Grant", "inner": [{"@type":"Course"}]}')
    found = F.regexp_extract_all(text, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))
    shown = F.concat(F.lit("["), F.array_join(F.array_sort(found), ", "), F.lit("]"))
    return t("events").select("event_id", shown.alias("kinds"))


#: Answers as a model gives them, put together from an event's values, in words that Spark and DuckDB share: fenced, introduced, cut off, without an object, empty; with wrong types, lengths, ranges, choices, keys, codes and dates.
_ANSWER = """'{"title": ' || (case when user_id % 5 = 0 then 'null' else '"' || repeat(event_type, cast(user_id % 7 as int)) || '"' end)
  || ', "confidence": ' || (case when user_id % 11 = 0 then '"high"' when user_id % 13 = 0 then 'null' when user_id % 7 >= 5 then '1.' || (user_id % 7 - 4) else '0.' || (user_id % 10) end)
  || (case when event_id % 9 = 0 then '' else ', "scope": "' || (case event_id % 4 when 0 then 'INTERNATIONAL' when 1 then 'DOMESTIC' when 2 then 'UNKNOWN' else upper(event_type) end) || '"' end)
  || ', "countries": ' || (case user_id % 6 when 0 then '["KE", "UG", "TZ", "RW"]' when 1 then '["KE", "ug"]' when 2 then '["KEN", 5]' when 3 then '{}' else '["KE", "UG"]' end)
  || ', "funding": {"tuition": {"value": ' || (case user_id % 3 when 0 then 'true' when 1 then 'false' else 'null' end) || ', "evidence": ' || (case when event_id % 3 = 0 then 'null' else '"' || event_type || '"' end) || '}}'
  || ', "date": "20' || (event_id % 3) || '6-' || (event_id % 2) || (event_id % 4) || '-15"' || (case when event_id % 10 = 0 then ', "mood": 1, "age": 2' else '' end) || '}'"""
_RAW = f"""case event_id % 13 when 0 then 'As asked:' || chr(10) || '```json' || chr(10) || {_ANSWER} || chr(10) || '```' || chr(10) || 'Ask {{me}}.' when 1 then 'Here it is ' || {_ANSWER} || ' and that is all.'
  when 2 then replace({_ANSWER}, '"confidence":', '"confidence"') when 3 then event_type when 4 then ' ' when 5 then null when 6 then {_ANSWER} || ' {{}}' else {_ANSWER} end"""
_CONTRACT = V.Record(of={
    "title": V.Text(null=True, least=2, most=30), "confidence": V.Number(low=0, high=1), "scope": V.Choice(of=("INTERNATIONAL", "DOMESTIC", "UNKNOWN")), "countries": V.List(item=V.Text(length=2), most=3),
    "funding": V.Record(of={"tuition": V.Record(of={"value": V.Boolean(null=True), "evidence": V.Text(null=True, most=7)})}), "date": V.Text(null=True, most=12),
})
_CHECKS = (V.real_date("date"), V.no_list_with("scope", "INTERNATIONAL", "countries", 1), V.upper_codes("countries", "countries"), V.told_with_evidence("funding", ["tuition"]))


@query(f"""with r as (select event_id, {_RAW} as raw from events),
b as (select event_id, raw, nullif(regexp_extract(case when regexp_matches(raw, '(?s)```(?:json)?\\s*.*?```') then regexp_extract(raw, '(?s)```(?:json)?\\s*(.*?)```', 1) else raw end, '(?s)(\\{{.*\\}})', 1), '') as body from r),
j as (select event_id, raw, body, case when json_valid(body) then body::json end as j from b),
k as (select *, json_type(j, '$.title') as tt, length(j->>'$.title') as tn, json_type(j, '$.confidence') as ct, try_cast(j->>'$.confidence' as double) as cv, json_type(j, '$.scope') as st, j->>'$.scope' as sv,
  json_type(j, '$.countries') as lt, json_array_length(j, '$.countries') as ln, case when json_type(j, '$.countries') = 'ARRAY' then (j->'$.countries')::json[] else [] end as ls,
  length(j->>'$.funding.tuition.evidence') as en, j->>'$.funding.tuition.evidence' as ev, j->>'$.funding.tuition.value' as fv, j->>'$.date' as dv, list_sort(list_filter(json_keys(j), lambda x: x not in ('title', 'confidence', 'scope', 'countries', 'funding', 'date'))) as extra from j),
o as (select *, list_filter([
  case when tt <> 'NULL' and tn < 2 then 'title: shorter than 2' when tt <> 'NULL' and tn > 30 then 'title: longer than 30' end,
  case when ct = 'NULL' then 'confidence: must not be null' when ct = 'VARCHAR' then 'confidence: expected number, got string' when cv > 1 then 'confidence: more than 1' end,
  case when st is null then 'scope: missing' when sv not in ('INTERNATIONAL', 'DOMESTIC', 'UNKNOWN') then 'scope: not one of the known values' end,
  case when lt = 'OBJECT' then 'countries: expected array, got object' when ln > 3 then 'countries: more than 3 items' end]
  || list_transform(ls, lambda x, i: case when json_type(x) <> 'VARCHAR' then 'countries.' || (i - 1) || ': expected string, got number' when length(x->>'$') <> 2 then 'countries.' || (i - 1) || ': not 2 long' end)
  || [case when en > 7 then 'funding.tuition.evidence: longer than 7' end, case when len(extra) > 0 then 'answer: unknown keys ' || array_to_string(extra, ', ') end], lambda x: x is not null) as own from k),
x as (select *, list_filter([case when try_cast(dv as timestamp) is null then 'date is not a valid ISO date' when year(try_cast(dv as timestamp)) not between 2000 and 2100 then 'date year out of range: ' || year(try_cast(dv as timestamp)) end,
  case when sv = 'INTERNATIONAL' and ln > 1 then 'scope: INTERNATIONAL scope must not enumerate a country list' end]
  || list_transform(list_filter(ls, lambda x: not regexp_matches(x->>'$', '^[A-Z]{{2}}$')), lambda x: 'countries: "' || (x->>'$') || '" is not an ISO-3166 alpha-2 code')
  || [case when fv = 'true' and ev is null then 'asserted without evidence: funding.tuition' end], lambda x: x is not null) as more from o),
e as (select *, case when coalesce(trim(raw), '') = '' then ['empty response'] when body is null then ['no JSON object found'] when j is null then ['JSON parse failed'] when len(own) > 0 then own else more end as errors from x)
select event_id, array_to_string(errors, '; ') as errors, case when len(errors) = 0 then j->>'$.title' end as title from e""")
def jsn3_validated_json(t):
    """Fenced, introduced and broken answers against a contract of all kinds of nodes, and rules between fields."""
    found = V.validated(t("events").select("event_id", F.expr(_RAW).alias("raw")), "raw", _CONTRACT, _CHECKS)
    return found.select("event_id", F.array_join("errors", "; ").alias("errors"), F.try_variant_get("answer", "$.title", "string").alias("title"))


@query("select o_orderkey, epoch_us(date_trunc('day', o_orderdate)) <= epoch_us(timestamp '1996-06-01') as same_or_before from orders")
def dat5_day_comparison(t):
    return t("orders").select("o_orderkey", (F.to_date("o_orderdate") <= F.lit(datetime(1996, 6, 1)).cast("date")).alias("same_or_before"))
