"""The stemmer on published pairs, and the index against reading every text."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions.stemming import stem
from tidewater.operators import text_index as X
from tidewater.plans import catalog

#: From the algorithm's published sample vocabulary.
PAIRS = """consigned consign consignment consign consistency consist consistently consist consolatory consolatori consolidating consolid conspicuously conspicu conspiracy conspiraci constancy constanc
knackeries knackeri knaves knave kneeling kneel knightly knight knocker knocker generously generous generation generat hopping hop hoping hope agreed agre feed feed relational relat rationalize ration
sky sky cries cri ties tie gas gas this this kiwis kiwi gaps gap happily happili enjoy enjoy dying die policies polici policy polici scholarships scholarship nationality nation universities univers
adjustment adjust replacement replac controlling control roll roll bed bed luxuriated luxuri troubled troubl sized size news news proceed proceed y y is is élan élan a1s a1s""".split()
SCHEMA = "id long, title string, body string, stem string"


def test_stems():
    assert [stem(w) for w in PAIRS[::2]] == PAIRS[1::2]


def rows(seed, n=80):
    rng = random.Random(seed)
    words = "grant grants granted granting fund funds funded funding of the for study studies studying student's Student It's 2026 Études études policy Policies policing x_y".split()
    text = lambda: None if rng.random() < 0.1 else rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 12)))
    return [(i, text(), text(), "s") for i in range(n)] + [(None, "grant", "grant", "s"), (5, "grants of the study", "", "s"), (5, "granting policies", None, "s"), (900, "", None, "s")]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    df = spark.createDataFrame(rows(1), SCHEMA).repartition(4)
    return df, X.TextIndex.write(df, "id", ["title", "body"], f"file://{tmp_path_factory.mktemp('index')}/a", per_range=50)


def plain(data, query):
    """Word by word, without an index: the quoted parts, the words and the banned words of a query."""
    q = X.Query.of(query)
    out = set()
    for i, title, body, _ in data:
        columns = [X.words_of(t or "") for t in (title, body)]
        stems = {stem(w) for ws in columns for w in ws}
        fits = all(any(f" {' '.join(p)} " in f" {' '.join(ws)} " for ws in columns) for p in q.phrases) and (not q.stems or stems & q.stems) and not stems & q.banned
        if i is not None and (q.stems or q.phrases) and fits:
            out.add(i)
    return out


@pytest.mark.parametrize("query", ["grant", "GRANTS study", '"grants of the"', 'funding "of the" -policy', '"of the" "for study"', "-grant", "the of", "", '"', '"" grant', "student's -it's", "étude -2026", 'policies "the the"', '"grant grant grant"', "none", "x_y -study -fund"])
def test_index_equals_scan(built, query):
    df, index = built
    want = plain(rows(1), query)
    got = [r["id"] for r in index.search(query).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {r["id"] for r in X.scan(df, "id", ["title", "body"], query).collect()} == want


def test_a_query_reads_its_terms_only(built):
    plan = built[1].search('grant "of the"')._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stem" in plan


def test_no_rows(spark, tmp_path):
    index = X.TextIndex.write(spark.createDataFrame([], SCHEMA), "id", ["title"], f"file://{tmp_path}/b")
    assert index.search("grant").count() == 0 and index.search('"a b" -c').count() == 0


@pytest.mark.parametrize("query", ["grants study", '-grants "of the"', "grants -policies", "fund -grants"])
def test_told_forms_count_alone(built, query):
    df, index = built
    forms = {"grants": ["grant", "granting"], "policies": ["policy"]}
    q = X.Query.of(query, forms)
    assert "grant" not in q.stems | q.banned
    want = set()
    for i, *texts, _ in rows(1):
        columns = [X.words_of(t or "") for t in texts]
        words = {w for ws in columns for w in ws}
        has = lambda w: bool(words & set(forms[w])) if w in forms else stem(w) in map(stem, words)  # noqa: B023, E731
        wanted, banned = [[t.lstrip("-") for t in query.replace('"of the"', "").split() if t.startswith("-") == b] for b in (False, True)]
        if i is not None and (any(map(has, wanted)) or not wanted) and not any(map(has, banned)) and ('"' not in query or any(" of the " in f" {' '.join(ws)} " for ws in columns)):
            want.add(i)
    assert want and {r["id"] for r in index.search(query, forms).collect()} == want
    assert {r["id"] for r in X.scan(df, "id", ["title", "body"], query, forms).collect()} == want


def test_query_has_the_endings_of_its_sql(spark, tmp_path):
    words = "hehe hehes hehees hehed hehelying hehelyed hehe's heheness rewh rewhe rewhd rewhlying rewhed rewhering".split()
    banned = "thatin thatiner thatined thatinerly thatinated thatineation thatinlying".split()
    texts = [f"one {w} of the end" for w in words] + [f"hehe of the {w}" for w in banned] + ["hehe of it", "of the", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    want = {r[0] for r in con.execute(catalog.oracle_sql()["flt10_indexed_search"]).fetchall()}
    got = [r["doc_id"] for r in catalog.queries()["flt10_indexed_search"](spark, f"file://{tmp_path}").collect()]
    assert len(got) == len(set(got)) and set(got) == want and words.index("hehelying") not in want and len(words) + banned.index("thatinerly") in want


def test_slices_hold_what_rows_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "SLICE", 150)
    df = spark.createDataFrame(rows(2, 300), SCHEMA).selectExpr("cast(id as string) as id", "title", "body").coalesce(2)
    index = X.TextIndex.write(df, "id", ["title", "body"], f"file://{tmp_path}/a")
    assert 20 < index.table.select("row").distinct().count() < 300
    for query in ("grants", '"of the" -policy', '"for study" "of the" fund', '"grant grant"', "none"):
        got = [r["id"] for r in index.search(query).collect()]
        assert len(got) == len(set(got)) and set(got) == {str(i) for i in plain(rows(2, 300), query)}


def test_index_has_a_row_for_a_word_and_slice(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    df = spark.range(6000, numPartitions=2).withColumn("text", F.concat_ws(" ", *map(F.lit, words), F.col("id").cast("string")))
    made = X.postings(df, "id", ["text"])
    assert made.where("word like 'w%'").count() == 2 * len(words)  # a row for each text: 240,000, held by a worker at once
    assert "Exchange" not in made.sortWithinPartitions("stem")._jdf.queryExecution().executedPlan().toString()
    index = X.TextIndex.write(df, "id", ["text"], f"file://{tmp_path}/a")
    assert index.search('"w38 w39"').count() == 6000 and [r["id"] for r in index.search("w7 -w8").collect()] == [] and [r["id"] for r in index.search("5999").collect()] == [5999]
    assert {p.name for p in (tmp_path / "a").iterdir()} == {"index"}
