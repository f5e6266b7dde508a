"""The subpackage's queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontamination, fingerprints, html_text, language, line_dedup, mixing, near_dedup, secrets, sharding, source_divergence, token_files, url_rules, whitening
from tidewater.llm.storage import shared_dir, table
from tidewater.plans.session import prepare


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    model = language.fit(docs)
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.withColumn("held_out", language.held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(prepare(spark), sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(table(prepare(spark), sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(table(prepare(spark), sf_dir, "documents")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    return token_files.write_shards(docs, f"{shared_dir(spark)}/token-files")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(prepare(spark), sf_dir, "documents"), [1.0] * 8)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(prepare(spark), sf_dir, "documents"), k=4)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(prepare(spark), sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(prepare(spark), sf_dir, "pages"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    store = line_dedup.LineStore.empty(spark).insert(docs)
    return line_dedup.digest_columns(store.apply(docs))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(table(prepare(spark), sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.component_rows(table(prepare(spark), sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_language, op2_fingerprints, op3_main_text, op4_secrets, op5_token_files, op6_decontamination, op7_sharding, op8_near_dedup, op9_mixing, op10_url_rules,
        op11_line_dedup, op12_source_divergence, op13_whitening,
    )}


_OP8 = r"""
with recursive d as (
  select doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') as w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) end) as s from d),
e as (select doc_id, unnest(s) as x from g),
p as (select a.doc_id as u, b.doc_id as v, count(*) as n from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select u, v from p join g a on a.doc_id = u join g b on b.doc_id = v where 100 * n >= 80 * (len(a.s) + len(b.s) - n)),
r as (select doc_id as id, doc_id as c from g union select l.v, r.c from r join l on l.u = r.id),
m as (select id, min(c) as c from r group by 1)
select g.doc_id, len(g.s)::bigint as n_shingles, m.c as component_id, g.doc_id = m.c as kept from g join m on m.id = g.doc_id
"""

_OP9 = r"""
with recursive k as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5('1|' || doc_id::varchar), 1, 15))::bigint as key from documents),
z as (select source, sum(size)::bigint as source_size, count(*) as n_rows from k group by 1),
w as (select *, [1.0, 2.0, 3.0][((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::double as weight, (3 * source_size)::double as cap from z),
f as (select *, (sum(source_size) over ())::double as total,
  coalesce(sum(cap) over (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0.0) as spent,
  sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0.0) as spare from w),
v as (select *, max(case when (total - spent) / spare * weight <= cap then (total - spent) / spare end) over () as level from f),
t as (select source, source_size, least(cap, coalesce(level * weight, cap)) as target, greatest(1, n_rows // 256) as n_blocks from v),
q as (select *, case when source_size = 0 then 0 else least(3, floor(target / source_size)::int) end as passes from t),
x as (select *, case when passes < 3 then greatest(0.0, target - passes * source_size) else 0.0 end as rest from q),
b as (select k.*, x.source_size, x.target, x.passes, x.rest, k.key % x.n_blocks as block,
  ('0x' || substr(md5('1|' || coalesce(k.source, '') || '|' || (k.key % x.n_blocks)::varchar), 1, 15))::bigint as ord from k join x on k.source is not distinct from x.source),
c as (select source, ord, block, rest, sum(size) as words from b group by all),
n as (select *, sum(words) over (partition by source order by ord, block rows unbounded preceding) as upto from c),
u as (select source, ord as cut_ord, block as cut_block, rest - upto + words as lack from n where rest > 0 and upto >= rest and upto - words < rest
  qualify row_number() over (partition by source order by ord, block) = 1),
s as (select b.source, key, lack, sum(size) as w from b join u on b.source is not distinct from u.source and ord = cut_ord and block = cut_block group by all),
y as (select *, row_number() over (partition by source order by w desc, key) as i from s),
g as (select source, 0::bigint as i, 0::hugeint as acc, lack, null::bigint as key, false as near from u union all
  select g.source, y.i, g.acc + case when g.acc + y.w <= g.lack then y.w else 0 end, g.lack, y.key, g.acc + y.w <= g.lack
  from g join y on g.source is not distinct from y.source and y.i = g.i + 1),
h as (select source, key as cut_key from g where near)
select b.doc_id, b.size, b.source_size, b.target,
  (b.size * (b.passes + coalesce((ord < cut_ord or ord = cut_ord and block < cut_block or ord = cut_ord and block = cut_block and cut_key is not null)::int, 0)))::bigint as taken
from b left join u on b.source is not distinct from u.source left join h on b.source is not distinct from h.source and b.key = h.cut_key
"""

_OP10 = r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
r as (select *, case
  when (host = 'example.net' or host like '%.example.net') and path like '/en/%' then 'example.net/en/'
  when (host = 'example.com' or host like '%.example.com') and path like '/de/%' then 'example.com/de/'
  when (host = 'org' or host like '%.org') and path like '/fr/%' then 'org/fr/'
  when (host = 'net' or host like '%.net') and path like '/%' then 'net/' end as rule from p)
select page_id, host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when regexp_matches(host, '(^|[^a-z0-9])(spam|cheap-pills|casino|porn|xxx|warez|malware|phishing)($|[^a-z0-9])') then 'block' else 'allow' end as verdict from r
"""

_OP11 = r"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
k as (select r, doc_id, lines, list_transform(lines, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as keys from d),
e as (select r, unnest(list_distinct(keys)) as x from k),
c as (select coalesce(list(x), []) as common from (select x from e where x <> '' group by 1 having count(*) >= 10)),
f as (select doc_id, len(lines)::bigint as n_lines, list_filter(lines, lambda x, i: not list_contains(common, keys[i])) as stay from k cross join c)
select doc_id, n_lines, n_lines - len(stay)::bigint as n_dropped, sha256(coalesce(array_to_string(stay, chr(10)), '')) as kept_sha256 from f
"""

_OP12 = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
t as (select lang, source, term, sum(n)::bigint as n, count(*) as docs from (select lang, source, r, term, count(*) as n
  from (select lang, source, r, unnest(w) as term from (select *, row_number() over () as r from d)) group by all) group by all),
k as (select lang, term, sum(n)::bigint as n from t group by all having sum(docs) >= 30),
l as (select lang, count(*) as v, sum(n)::bigint as total from k group by all),
g as (select lang, source, coalesce(total, 0) as total from (select distinct lang, source from d) left join (select lang, source, sum(t.n)::bigint as total from t join k using (lang, term) group by all) using (lang, source)),
s as (select g.lang, g.source, k.term, coalesce(t.n, 0) as n, 1 + ((1000000000::hugeint * (coalesce(t.n, 0) + 5)) // (g.total + 5 * l.v))::bigint as p, 1 + ((1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v))::bigint as q
  from g join k on k.lang = g.lang join l on l.lang = g.lang left join t on t.lang = g.lang and t.source = g.source and t.term = k.term),
m as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(m.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join m on m.lang = a.lang and m.source = a.source and m.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from s where n > 0 and p > q)
select lang, source, part, item, value, (row_number() over (partition by lang, source, part order by value desc, encode(item)))::int as rank from (from pair union all from term)
qualify part = 'pair' or rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": _OP11, "op12_source_divergence": _OP12, "op8_near_dedup": _OP8, "op9_mixing": _OP9, "op10_url_rules": _OP10}
