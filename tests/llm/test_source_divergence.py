import random
import re
from collections import Counter, defaultdict

from tidewater.llm import source_divergence as S

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, least, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD)))
        groups.add((lang, source))
        counts[lang, source].update(own)
        docs[lang].update(own.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        own = sorted(s for one, s in groups if one == lang)
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        q = shares(whole)
        p = {s: shares(counts[lang, s]) for s in own}
        for s in own:
            parts = {"pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in own if o != s], "term": [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found if part == "pair" else found[:top])}
    return out


def corpus(seed):
    rng = random.Random(seed)
    rows = [("xx", "only", "1 2 3"), ("xx", "", None), (None, None, "Aé\U0001f600b C-d"), ("en", "no terms", "12"), ("en", None, "w1 W1 w2")]
    for _ in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice([None, "s0", *(f"s{i}" for i in range(12))])
        rows.append((lang, source, " ".join(f"W{int(rng.expovariate(0.05))}x".upper() if rng.random() < 0.2 else f"w{int(rng.expovariate(0.05) + 3 * len(source or ''))}éx" for _ in range(rng.randint(0, 60)))))
    letters = "abcdefghijklmnopqrstuvwxyz"
    return [(lang, source, re.sub(r"\d", lambda m: letters[int(m[0])], t) if t and rng.random() < 0.98 else t) for lang, source, t in rows]


def check(spark, rows, least, **sizes):
    docs = spark.createDataFrame([(i, *r, i) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term long").repartition(3)
    if sizes:
        audit = S.Audit(docs, least, **sizes)
        got = {("pair", r["lang"], r["source"], r["item"], r["value"]) for r in audit.pairs().collect()}
        assert got == {(part, a, b, c, v) for a, b, part, c, v, _ in brute(rows, least, 50) if part == "pair"}
        return
    found = S.report(docs, least, 5).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == brute(rows, least, 5)


def test_report_by_brute_force(spark):
    check(spark, corpus(1), 5)


def test_tiles_by_brute_force(spark):
    """Many blocks, chunks and ranges; ranges in which a tile has no counts."""
    check(spark, corpus(2), 12, block=5, chunk=7, span=2)
    check(spark, corpus(2)[:60], 6, block=1, chunk=3, span=1)


def test_no_kept_terms(spark):
    rows = [("en", "a", "x"), ("en", "b", "y"), ("de", "a", None)]
    got = {tuple(r) for r in S.report(spark.createDataFrame(rows, "lang string, source string, text string")).collect()}
    assert got == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}


def test_large_counts(spark):
    """Shares of counts whose product with 10**9 no long could hold."""
    import numpy as np

    n, total, v = 7 * 10**14 + 3, 8 * 10**15 + 1, 12345
    want = 1 + 10**9 * (n + 5) // (total + 5 * v)
    assert S.shares(np.array([[n]]), np.array([total]), np.array([v]))[0, 0] == want
    assert spark.sql(f"select {S._share('n', 't', 'v')} as p from (select {n}L as n, {total}L as t, {v}L as v)").first()["p"] == want


def test_odd_rows(spark, odd_docs):
    got = S.report(odd_docs, 1)
    assert got.count() > 0 and S.report(odd_docs.limit(0)).count() == 0
    rows = [(r["lang"], r["source"], r["text"]) for r in odd_docs.collect()]
    assert {tuple(r) for r in got.collect()} == brute(rows, 1, 50)
