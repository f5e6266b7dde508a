import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidewater.llm import html_text as X


def page(main, side="links"):
    return f"<html><head><title>T</title><script>if (a < b) '</p>'</script></head><body><nav><a href=/>Home</a></nav><div class='wrap-7'>{main}</div><div class='sidebar x'>{side}</div><footer>f</footer></body></html>"


def test_chrome_goes_and_blocks_stay():
    source = page(
        "<h1>Head &amp;  line</h1><p>One <b>bold</b>\n text<br>more &#233;<p>Two <a href=x>link</a></p><ul><li>i<li>j</ul><form>q</form><div class=cookie-notice>c</div>"
        "<section id=comments><p>reply</p></section><div hidden>h</div><style>p{}</style><!-- no --><table><tr><td>a<td>b</table>"
    )
    assert X.Page(source).text(None) == "Head & line\nOne bold text more é\nTwo link\ni\nj\na\nb"
    assert X.Page("").text(None) == "" and X.Page("plain <b>words").text(None) == "plain words" and X.Page("<p><<i b='x>y'>z").text(None).endswith("z")


def test_votes_choose_for_pages_that_alone_would_choose_otherwise(spark):
    long, short = "word " * 200, "tiny story"
    rows = [(i, f"https://h.org/{i}", page(f"<div class='story-{i}'><p>{long}</p></div>")) for i in range(6)]
    odd = page(f"<div class='story-9'><p>{short}</p></div>", "side " * 100).replace("sidebar x", "rail")
    rows += [(9, "https://H.org/9#x", odd), (10, None, None), (11, "https://other.org/", "<body><p>alone</p></body>"), (11, "https://other.org/", "<body><p>alone</p></body>")]
    pages = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, n_chars int, path string")
    got = X.main_texts(pages).collect()
    by_id = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and by_id[9]["text"] == short and by_id[10]["text"] == "" and by_id[11]["text"] == "alone" and by_id[9]["n_chars"] == len(short)
    winners = {r["host"]: r["path"] for r in X.host_paths(pages).collect()}
    assert winners["h.org"].endswith("div.story-#")
    assert X.main_texts(pages.limit(0)).count() == 0


def test_blocks_around_the_winning_container_stay(spark):
    long = "word " * 200
    make = {
        "title.org": lambda i: f"<article><h1>Title {i}</h1><p>lead {i}</p><div class=content><p>{long}</p></div></article><div class=tagline>our site</div>",
        "parts.org": lambda i: f"<article><section class=a><p>{long}</p></section><section class=b><p>second {i}</p></section></article>",
        "deep.org": lambda i: f"<div class=page><h1>Title {i}</h1><div class=in><p>lead {i}</p><div class=content><p>{long}</p></div></div></div><div class=rail>more <a href=x>{'link ' * 9}</a></div>",
        "same.org": lambda i: f"<div class=page><p>Welcome to our site</p><div class=content><p>{long}{i}</p></div></div>",
        "links.org": lambda i: f"<article><p><a href=x>links {i}</a></p><div class=content><p>{long}</p></div></article>",
    }
    rows = [(i, f"https://{h}/{i}", f"<body>{f(i)}</body>") for h, f in make.items() for i in range(5)]
    rows += [(9, "https://title.org/9", "<article><h1>Short</h1></article>"), (8, "https://title.org/8", f"<main><div class=content><p>{long}</p></div></main>")]
    got = {(r["url"].split("/")[2], r["page_id"]): r["text"] for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got["title.org", i] == f"Title {i}\nlead {i}\n{long.strip()}"
        assert got["parts.org", i] == f"{long.strip()}\nsecond {i}"
        assert got["deep.org", i] == f"Title {i}\nlead {i}\n{long.strip()}"
        assert got["same.org", i] == f"{long}{i}" and got["links.org", i] == long.strip()
    assert got["title.org", 9] == "Short" and got["title.org", 8] == long.strip()
    assert X.Page(f"<body>{make['title.org'](1)}</body>").text(None) == f"Title 1\nlead 1\n{long.strip()}"


def test_host(spark):
    rows = spark.createDataFrame([("http://A.b/C",), ("no",), (None,), ("x://Q?y://z",)], "u string")
    assert [r["h"] for r in rows.select(X.host(F.col("u")).alias("h")).collect()] == ["a.b", "", "", "q"]


def test_unclosed_stray_and_nested_tags_take_linear_time():
    def seconds(source):
        began = time.perf_counter()
        page = X.Page(source)
        page.votes(), page.steps(), page.text(None)
        return time.perf_counter() - began

    make = {
        "unclosed": lambda n: "<b>" * n + "x" + "</i>" * n, "inline": lambda n: "<b>" * n + "<p>y</p>" * n, "nested": lambda n: "<div>z" * n, "tables": lambda n: "<table><tr><td>t" * n,
        "endless": lambda n: "<a " * n, "quoted": lambda n: '<a title="x ' * n, "quoted, one end": lambda n: '<b ">" ' * n + ">", "both quotes": lambda n: "<b '>\" " * n + ">", "comments": lambda n: "<!-" * n + "<!-- " * n,
        "classes": lambda n: "".join(f"<div class={chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>w</div>" for i in range(n)),
    }
    for name, source in make.items():
        seconds(source(1000))
        assert seconds(source(32_000)) < 60 * max(seconds(source(2_000)), 0.01), name
    assert X.Page("<div>" * 20_000 + "deep").text(None) == "deep"


def test_markup_that_never_ends():
    cases = {
        "<p>a</p><b x='1": "a\n<b x='1", "<p>a <!-- b <p>c</p>": "a", "<p>a</p>b <!-- c": "a\nb", "a < b <i>c</i> < d": "a < b c < d", "<p>a<script>var x = '<p>b</p>'": "a",
        '<p title="1 > 0">a</p>': "a", "<p title='<b>'>a</p>": "a", '<p title="x>a</p>': "a", "no tags": "no tags", "<": "<", ">": ">",
    }
    for source, text in cases.items():
        assert X.Page(source).text(None) == text, source


def test_an_article_keeps_its_place_beside_a_topic_class():
    kept = "<div class='post related-topics'><p>long article text</p></div>"
    for aside in ("<div class='related-posts'>x</div>", "<div class='comment content'>x</div>", "<div class='post-comments'>x</div>", "<div id='sidebar' class='content'>x</div>"):
        assert X.Page(kept + aside).text(None) == "long article text", aside


def test_a_deep_climb_takes_few_joins(spark, monkeypatch):
    """Forty containers, each with a block of its own: all are reached in rounds of doubled steps."""
    deep = "".join(f"<div class='content c{chr(97 + i // 26)}{chr(97 + i % 26)}'><p>level {i} of page %d</p>" for i in range(40)) + f"<p>{'inner word ' * 80}</p>" + "</div>" * 40
    pages = spark.createDataFrame([(i, f"https://deep.org/{i}", f"<body>{deep % ((i,) * 40)}</body>") for i in range(6)], "page_id long, url string, html string")
    made = []
    real = X.materialise
    monkeypatch.setattr(X, "materialise", lambda df, name: made.append(name) or real(df, name))
    for r in X.main_texts(pages).collect():
        assert r["text"].split("\n")[:40] == [f"level {i} of page {r['page_id']}" for i in range(40)] and r["text"].endswith("inner word")
    assert made.count("climb") <= 8


class Plain(HTMLParser):
    """A second reader of well-formed pages: blocks with the classes and tags of the elements around them."""

    def __init__(self, source):
        super().__init__()
        self.stack, self.parts, self.found = [], [], []
        self.feed(source)

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((text, [t for t, _ in self.stack], [c for _, c in self.stack]))
        self.parts = []

    def handle_starttag(self, tag, attributes):
        if tag not in ("b", "a"):
            self.flush()
        self.stack.append((tag, dict(attributes).get("class", "")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        while self.stack.pop()[0] != tag:
            pass

    def handle_data(self, data):
        self.parts.append(data)


def test_articles_by_a_second_parser(spark):
    """Well-formed pages of several templates: the text is what a plain parser finds inside the article and outside chrome."""
    random.seed(4)
    words = lambda n: " ".join(random.choice(["alpha", "beta &amp; gamma", "caf&eacute;", "d&#233;j&#xe0;", "omega"]) for _ in range(n))
    rows = []
    for i in range(60):
        body = "".join(f"<p>{words(random.randint(20, 60))} <b>{words(2)}</b></p>" for _ in range(random.randint(2, 6)))
        main = f"<h1>{words(4)}</h1>{body}<ul><li>{words(5)}</li><li>{words(5)}</li></ul>"
        wrap = (f"<article>{main}</article>", f"<div class='post-{i} entry'>{main}</div>", f"<main><section class='story'>{main}</section></main>")[i % 3]
        source = f"<html><head><style>p{{}}</style></head><body><nav><a href='/'>{words(3)}</a></nav><header><p>{words(9)}</p></header>{wrap}<div class='comments'><p>{words(80)}</p></div><aside><p>{words(50)}</p></aside><footer><p>{words(9)}</p></footer></body></html>"
        rows.append((i, f"https://h{i % 3}.org/{i}", source))
    got = {r["page_id"]: r["text"] for r in X.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, source in rows:
        blocks = [text for text, tags, classes in Plain(source).found if "body" in tags and not {"nav", "header", "aside", "footer"} & set(tags) and "comments" not in classes]
        assert got[i] == "\n".join(blocks)


def test_hot_and_common_hosts_are_read_alike(spark, monkeypatch):
    rows = [(i, f"https://{'hot' if i % 2 else f'h{i % 8}'}.org/{i}", page(f"<div class=story><p>{'word ' * 30}{i}</p></div>")) for i in range(40)] + [(99, None, "<p>none</p>"), (98, "no host", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = X.main_texts(pages).collect()
    monkeypatch.setattr(X, "HOT", 3)
    assert sorted(X.main_texts(pages).collect(), key=lambda r: r["page_id"]) == sorted(want, key=lambda r: r["page_id"]) and len(want) == 42
