"""Relational, stateful, page and platform operators against plain Python; batch against streams."""

import json
import tempfile
from collections import OrderedDict

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import html, net, url
from skein.operators import dom, library, pages, platforms, state
from skein.plans.queries import oracle_sql, queries
from skein.sources import tables
from skein.streaming import state as stream

PAGE = """<html><head><title>T</title><meta property="og:title" content="OG &amp; title"><meta name="description" content="About it all"><meta property="og:image" content="/i.png">
<meta property="og:site_name" content="Site"><meta name="author" content="Ann"><link rel="shortcut icon" href="fav.ico"><script type="application/ld+json">bad json</script>
<script type="application/ld+json">[{"@type": ["NewsArticle"], "headline": "LD", "author": {"name": "N", "image": {"url": "/av.png"}}, "datePublished": "2024-01-02"}]</script></head>
<body><nav>menu</nav><!-- <p>no</p> --><article><h1>Head</h1><p>First paragraph, long enough to be kept.<p>Second paragraph is <b>also</b> long enough.</p><blockquote>one<p>two</p></blockquote>
<ul><li>a<li>b</ul><pre><code>x = 1</code></pre><figure><img src="f.png"><figcaption>cap</figcaption></figure><div class="ad">buy</div>%s</article></body></html>""" % ("<p>" + "word " * 60 + "</p>")


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, s long, kind string, pro boolean").withColumn("ts", F.timestamp_seconds("s"))


def test_ledger(spark):
    week = 7 * 86_400
    rows = [(i, 1, i, "reserve", False) for i in range(7)] + [(7, 1, week - 1, "reserve", False), (8, 1, week, "reserve", False), (9, 1, week + 1, "refund", False), (10, 1, week + 2, "refund", False)]
    rows += [(20, 2, 5, "reserve", True), (30, None, 5, "refund", False)]
    got = {r.event_id: (r.accepted, r.remaining) for r in state.credit_ledger(events(spark, rows)).collect()}
    assert [got[i][0] for i in range(9)] == [True] * 6 + [False, False, True]
    assert got[8] == (True, 5) and got[9] == (True, 6) and got[10] == (True, 6) and got[20] == (True, 999999) and got[30] == (True, 6)


def test_ledger_batch_is_stream(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    folder = tempfile.mkdtemp()
    d = e.select("event_id", "user_id", "ts", F.lit("reserve").alias("kind"), F.lit(False).alias("pro"))
    d.orderBy("ts").coalesce(1).write.parquet(f"{folder}/in")
    source = tables.read_stream(spark, f"{folder}/in", "event_id long, user_id long, ts timestamp_ntz, kind string, pro boolean")
    q = stream.credit_ledger(source).writeStream.format("memory").queryName("ledger").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    a = {(r.event_id, r.accepted, r.remaining) for r in spark.table("ledger").collect()}
    assert a == {(r.event_id, r.accepted, r.remaining) for r in state.credit_ledger(d).collect()} and len(a) == e.count()


def test_streams_of_counts_and_leaders(spark, sf):
    folder = tempfile.mkdtemp()
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    late = spark.createDataFrame([(10**6, -1, "2100-01-01 00:00:00")], "event_id long, user_id long, t string").select("event_id", "user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    e.unionByName(late).coalesce(1).write.parquet(f"{folder}/in")
    read = lambda: tables.read_stream(spark, f"{folder}/in", "event_id long, user_id long, ts timestamp_ntz")

    def rows(d, name):
        q = d.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = {(r.user_id, r.window_start): (r.n, r.refused) for r in rows(stream.rate_counts(read(), ["user_id"], 86_400, 2), "counts")}
    batch = state.rate_limited(e, ["user_id"], 86_400, 2).groupBy("user_id", "window_start").agg(F.count("*").alias("n"), F.sum((~F.col("allowed")).cast("long")).alias("refused"))
    assert counts == {(r.user_id, r.window_start): (r.n, r.refused) for r in batch.collect()}
    leaders = rows(stream.coalesced(read(), ["user_id"], "3650 days"), "leaders")
    assert len({r.user_id for r in leaders}) == len(leaders) == e.select("user_id").distinct().count() + 1


def test_caches(spark):
    rows = [(0, 1, 0, "", False), (1, 1, 5, "", False), (2, 1, 10, "", False), (3, 1, 11, "", False)]
    assert [r.hit for r in state.ttl_cache(events(spark, rows), "user_id", 10).orderBy("event_id").collect()] == [False, True, True, False]
    keys = [1, 2, 1, 3, 2, 1, 3, 1, 1, 2]
    got = [r.hit for r in state.lru_cache(events(spark, [(i, k, i, "", False) for i, k in enumerate(keys)]), "user_id", 1000, 2).orderBy("event_id").collect()]
    cache, want = OrderedDict(), []
    for k in keys:
        want.append(k in cache)
        if k in cache:
            cache.move_to_end(k)
        elif len(cache) == 2:
            cache.popitem(last=False)
        cache[k] = True
    assert got == want


def test_library(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 1), (1, "d", 2), (3, "e", 0)], "k int, v string, t int")
    assert sorted(map(tuple, library.upsert(old, new, ["k"], ["t"]).collect())) == [(1, "d", 2), (2, "b", 5), (3, "e", 0)]
    assert sorted(map(tuple, library.updated(old, spark.createDataFrame([(2, "z"), (9, "q")], "k int, v string"), "k").collect())) == [(1, "a", 1), (2, "z", 5)]
    bounds = spark.createDataFrame([("0", "-1"), ("9999", "5"), ("abc", "x"), ("10abc", None), (None, None)], "l string, o string")
    assert [tuple(r) for r in bounds.select(*library.page_bounds(F.col("l"), F.col("o"))).collect()] == [(1, 0), (500, 5), (250, 0), (10, 0), (250, 0)]
    b = spark.createDataFrame([(1, 1, "https://twitter.com/a/status/1", 1), (2, 1, "https://www.linkedin.com/feed/update/urn:li:share:7123456789012345678", 2), (3, 2, "https://x.com/a/status/1", 3)], "id long, user_id long, url string, created_at long")
    r = spark.createDataFrame([(1, 1, "https://x.com/A/status/1?s=2"), (2, 1, "https://www.linkedin.com/posts/j-activity-7123456789012345678-ab"), (3, 3, "https://x.com/a/status/1")], "request_id long, user_id long, url string")
    assert {x.request_id: x.bookmark_id for x in library.existing(r, b).collect()} == {1: 1, 2: 2, 3: None}
    assert spark.range(1).select(library.display_name(F.lit(None).cast("string"), F.lit(" "), F.lit("bob@x.org"))).first()[0] == "bob"


def test_served_status(spark):
    b = spark.sql("SELECT * FROM VALUES (1, 1, 'u1', '', ' ', null, null, '{\"snapshot\": \"s\"}', null, null, null, 'failed', 1), (2, 1, 'u2', 'T', 'd', 'l', 'p', null, 's', 'x', true, null, 2) AS t(id, user_id, url, title, description, logo_url, snapshot_url, card_data, site_name, type, is_article, ai_status, created_at)")
    ai = spark.sql("SELECT 1 AS bookmark_id, 5 AS updated_at, 'ctx' AS context, array() AS ai_category, array() AS ai_tags, array() AS visual_entities, '' AS ocr_text")
    got = {r.id: r for r in library.served(library.with_context(b, ai.select("bookmark_id", "updated_at", "context", *[F.col(c).cast("array<string>").alias(c) for c in ("ai_category", "ai_tags", "visual_entities")], "ocr_text"))).collect()}
    assert (got[1].title, got[1].description, got[1].snapshot, got[1].type, got[1].ai_status, got[1].ai_context) == ("u1", None, "s", "generic", "completed", "ctx")
    assert (got[2].title, got[2].snapshot, got[2].ai_status, got[2].ai_tags) == ("T", "p", "pending_manual", [])


def test_content_groups_make_no_pairs(spark):
    u = spark.createDataFrame([(f"https://x.com/u{i}/status/7",) for i in range(50)], "url string")
    got = library.content_groups(u, url.content_keys(F.col("url"))).where("key = 'tweet:7'").collect()
    assert len(got) == 50 and {r.first_url for r in got} == {"https://x.com/u0/status/7"}


def test_page(spark):
    d = spark.createDataFrame([(1, "https://a.org/x/y", PAGE), (2, "https://a.org/z", "<title>403 Forbidden</title>"), (3, "https://a.org/login", '<input type="password"><p>short</p>'), (4, "https://a.org/n", None), (5, "https://a.org/e", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.metadata(pages.parsed(d)).collect()}
    a = got[1]
    assert (a.title, a.description, a.image, a.logo, a.site, a.author, a.published_at, a.type, a.author_avatar) == ("OG & title", "About it all", "https://a.org/i.png", "https://a.org/x/fav.ico", "Site", "Ann", "2024-01-02", "NewsArticle", "https://a.org/av.png")
    assert a.intent == "article" and "buy" not in a.article and "menu" not in a.article
    assert a.article.split("\n\n")[:6] == ["# Head", "First paragraph, long enough to be kept.", "Second paragraph is also long enough.", "> onetwo", "• a\n• b", "```\nx = 1\n```"]
    assert "![cap](f.png)" in a.article and not a.blocked
    assert got[2].blocked and got[2].title is None and got[3].intent == "auth_or_portal" and got[4].blocked and got[5].words == 0


def test_article_survives_odd_markup(spark):
    assert html.article_of("<p>" * 5000 + "x" * 300)["words"] == 1
    assert html.article_of("<div>" * 20000 + "<p>" + "y " * 200)["words"] == 200
    assert html.article_of("</p></div><b>") == {"content": None, "words": 0, "minutes": 0, "link_density": 0.0} and html.article_of(None) is None


@pytest.fixture
def duck_pages(spark):
    """A folder with a table of pages, and ids and titles that the query's SQL gives for it."""
    folder = tempfile.mkdtemp()
    rows = [(1, "https://a.org/1", "<h1>x</h1>"), (2, "https://a.org/2", "<h1><b>a</b> &amp; &quot;b&quot;</h1>"), (7, "https://a.org/7", "<h1>y</h1>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
        yield folder, sorted(con.sql(f"SELECT bookmark_id, title FROM ({oracle_sql()['bookmark_reader_view']})").fetchall())


def test_saved_titles_decode_ampersands_only(spark, duck_pages):
    folder, want = duck_pages
    d = queries()["bookmark_reader_view"](spark, folder)
    assert sorted(map(tuple, d.select("bookmark_id", "title").collect())) == want == [(1, "https://a.org/1"), (2, "a & &quot;b&quot;"), (7, None)]


#: Titles and what is left of them in a page's record: an end quote goes only without its partner.
QUOTED = {
    "token = &quot;2abc&quot;": 'token = "2abc"', "&quot;A&quot; and &quot;B&quot;": '"A" and "B"', "&quot;Whole&quot;": "Whole", "A song&quot;": "A song", "&quot;A song": "A song", "Say “this”": "Say “this”",
    "This”": "This", "&quot;": None,
}


def test_titles_keep_quotes_that_have_their_partner(spark):
    d = spark.createDataFrame([(i, f"https://a.org/{i}", f"<title>{t}</title>") for i, t in enumerate(QUOTED)], "page_id long, url string, html string")
    assert [r.title for r in pages.metadata(pages.parsed(d)).orderBy("page_id").collect()] == list(QUOTED.values())


def test_pages_in_an_extract_keep_quotes_that_have_their_partner(spark):
    d = spark.createDataFrame([(1, "https://a.org/1", "<title>token = &quot;2abc&quot;</title><p>A paragraph that ends with &quot;quotes&quot;</p>")], "page_id long, url string, html string")
    r = pages.extract(d).first()
    assert (r.title, r.description) == ('token = "2abc"', 'A paragraph that ends with "quotes"')


def test_pages_without_an_id_give_no_record(spark):
    rows = [(1, "https://a.org/1", "<title>One</title>"), (None, "https://a.org/1", "<title>Other</title>"), (None, "https://a.org/2", "<title>Two</title>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [tuple(r) for r in pages.extract(d).select("page_id", "canonical", "title").collect()] == [(1, "https://a.org/1", "One")]


#: A page whose title, heading and post end within a reference, as titles that were cut after escaping do.
CUT = "<body><main><article><h1>One &amp;&lt; and&amp</h1><p>A paragraph with some more text&quot <a href='/x?a=1&amp;b=2&copy=3'>&copy; link &#39</a></p></article></main></body>"


def test_references_without_a_semicolon_stay_in_articles():
    assert html.article_of(CUT)["content"] == "# One &< and&amp\n\nA paragraph with some more text&quot © link &#39"


def test_references_without_a_semicolon_stay_in_the_reader_view(spark):
    rows = dom.nodes(spark.createDataFrame([(1, CUT)], "page_id long, html string"))
    assert rows.where("tag = 'a'").first().attrs == {"href": "/x?a=1&b=2&copy=3"}
    assert dom.article(rows).first().content == "One &< and&amp\n\nA paragraph with some more text&quot © link &#39"


def test_references_without_a_semicolon_stay_in_posts(spark):
    rows = dom.nodes(spark.createDataFrame([(1, CUT)], "page_id long, html string"))
    assert dom.post_parts(rows).first().text == "One &< and&amp A paragraph with some more text&quot © link &#39"


def test_pages_without_an_id_have_their_post(spark):
    rows = dom.nodes(spark.createDataFrame([(1, "<article>One</article>"), (None, "<article>Two</article>")], "page_id long, html string"))
    assert sorted(dom.post_parts(rows).select("text", "page_id").collect()) == [("One", 1), ("Two", None)]


@pytest.mark.parametrize("name", ["main_posts", "readable_article"])
def test_queries_tell_pages_of_one_id_apart(spark, sf, tmp_path, name):
    page = "<html><body><div class='ad'>Ad.</div><article><h1>%s</h1><p>A paragraph, with commas, of this page alone.</p></article></body></html>"
    rows = [(i, f"https://a.org/{t}", page % t) for i, t in ((1, "One"), (2, "Two"), (2, "Three"), (None, "Four"), (None, "Five"))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    d = queries()[name](spark, str(tmp_path))
    want = con.sql(oracle_sql()[name])
    assert sorted(map(repr, (tuple(r) for r in d.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_extract(spark):
    d = spark.createDataFrame([(1, "http://www.a.org/x/?ref=1", PAGE), (2, "https://a.org/x", PAGE.replace("OG &amp;", "New")), (3, "https://printer.local/", PAGE), (4, "https://b.org/q", "<title>403 Forbidden</title>"), (5, "https://c.org/", PAGE)], "page_id long, url string, html string")
    rendered = spark.createDataFrame([("https://b.org/q", "<title>Real title</title><p>A paragraph of the rendered page.</p>")], "url string, html string")
    dns = spark.createDataFrame([("www.a.org", "8.8.8.8"), ("a.org", "8.8.8.8"), ("b.org", "9.9.9.9"), ("c.org", "10.0.0.1")], "host string, ip string")
    got = {r.canonical: r for r in pages.extract(d, rendered, dns).collect()}
    assert set(got) == {"https://a.org/x", "https://b.org/q"}
    assert got["https://a.org/x"].title == "New title" and got["https://a.org/x"].page_id == 2 and got["https://a.org/x"].admitted
    assert got["https://b.org/q"].title == "Real title"
    assert {r.canonical for r in pages.extract(d, cached=spark.createDataFrame([("https://a.org/x",)], "canonical string")).collect()} == {"https://b.org/q", "https://c.org/"}


def test_a_host_with_a_private_address_is_unsafe(spark):
    d = spark.createDataFrame([(1, "https://a.org/x", PAGE), (2, "https://b.org/x", PAGE), (3, "https://c.org/x", PAGE)], "page_id long, url string, html string")
    dns = spark.createDataFrame([("a.org", "10.0.0.5"), ("a.org", "93.184.216.34"), ("b.org", "93.184.216.34"), ("b.org", "8.8.8.8"), ("c.org", "8.8.8.8"), ("c.org", None)], "host string, ip string")
    assert {r.page_id for r in pages.extract(d, dns=dns).collect()} == {2}
    got = library.safe_urls(d.select("url"), dns, url.host_of(F.col("url"))).select("url", net.is_safe_url(F.col("url"), F.col("ip"), F.col("any_private")).alias("safe")).collect()
    assert {r.url for r in got if r.safe} == {"https://b.org/x"}


def test_redirects(spark):
    u = spark.createDataFrame([("https://bit.ly/a",), ("https://bit.ly/bad",), ("https://z.org/",)], "url string")
    r = spark.createDataFrame([("https://bit.ly/a", "https://t.co/b", True), ("https://t.co/b", "https://end.org/", True), ("https://bit.ly/bad", "https://10.0.0.1/", False)], "src string, dst string, safe boolean")
    assert {x.url: x.resolved for x in tables.resolve_redirects(u, r).collect()} == {"https://bit.ly/a": "https://end.org/", "https://bit.ly/bad": "https://bit.ly/bad", "https://z.org/": "https://z.org/"}


def test_platform_records(spark):
    tweet = {"tweet": {"author": {"name": "Jane", "screen_name": "jane", "avatar_url": "https://pbs.twimg.com/profile_images/1/a_normal.jpg"}, "text": "Hello &amp; bye https://t.co/abc", "likes": "1.5K", "replies": 0, "created_at": "Tue Mar 21 20:50:14 +0000 2006",
                       "media": {"photos": [{"url": "p.jpg"}], "videos": [{"url": "v.mp4", "thumbnail_url": "t.jpg"}]}}}
    post = {"data": [{"title": "A post", "selftext": "body", "author": "[deleted]", "subreddit": "spark", "score": 5, "num_comments": 0, "url": "https://i.redd.it/x.jpg", "created_utc": 1700000000, "gallery_data": {"items": [{"media_id": "x"}, {"media_id": "y"}]}}]}
    player = {"videoDetails": {"title": "Clip", "author": "Chan", "viewCount": "42"}, "microformat": {"playerMicroformatRenderer": {"likeCount": "7", "publishDate": "2024-05-01"}}}
    embed = {"title": "E", "author_name": "Ann", "author_url": "https://x.com/ann", "html": '<blockquote><p lang="en">Hi there</p>&mdash; Ann (@ann) <a href="u">March 21, 2006</a></blockquote>'}
    d = spark.createDataFrame([(json.dumps(tweet), json.dumps(post), json.dumps(player), json.dumps(embed)), ("bad", "{}", None, None)], "t string, p string, v string, e string")
    a, b = d.select(platforms.status_record(F.col("t")).alias("t"), platforms.submission_record(F.col("p")).alias("p"), platforms.video_record(F.lit("https://youtu.be/dQw4w9WgXcQ"), F.col("v"), F.col("e")).alias("v"), platforms.embed_post_record(F.lit("u"), F.col("e")).alias("e")).collect()
    assert (a.t.title, a.t.description, a.t.avatar_url, a.t.metrics["likes"], a.t.video_thumbnail) == ("Jane (@jane) on X", "Hello & bye", "https://pbs.twimg.com/profile_images/1/a_400x400.jpg", 1500.0, "t.jpg")
    assert [m.type for m in a.t.media] == ["image", "video"] and a.t.posted_at.year == 2006
    assert (a.p.title, a.p.author, a.p.subreddit, a.p.metrics["upvotes"]) == ("A post", "u/reddit_user", "r/spark", 5.0) and [m.url for m in a.p.media] == ["https://i.redd.it/x.jpg", "https://i.redd.it/y.jpg"]
    assert (a.v.title, a.v.channel, a.v.video_id, a.v.metrics, a.v.posted_at) == ("Clip", "Chan", "dQw4w9WgXcQ", {"views": 42.0, "likes": 7.0}, "2024-05-01")
    assert (a.e.title, a.e.description) == ("Ann (@ann) on X", "Hi there") and a.e.posted_at.day == 21
    assert b.t is None and b.p is None and b.e is None and b.v.title == "YouTube Video"


def test_more_platform_records(spark):
    syndicated = {"user": {"name": "Jane", "screen_name": "jane", "is_blue_verified": True}, "text": "Hello", "favorite_count": 12, "photos": [{"url": "a.jpg"}, {"url": "a.jpg"}], "created_at": "2024-05-01T10:00:00.000Z"}
    mirrored = {"user_name": "Jane", "user_screen_name": "jane", "text": "Hi", "likes": 3, "date": "Wed May 01 10:00:00 +0000 2024", "qrt": {"media_extended": [{"type": "gif", "url": "g.mp4", "thumbnail_url": "g.jpg"}]}}
    manifest = {"transcribedDocumentUrl": "d.pdf", "perResolutions": [{"width": 480, "imageManifestUrl": "s"}, {"width": 800, "imageManifestUrl": "m"}, {"width": 1280, "imageManifestUrl": "l"}]}
    ld = [{"@type": "VideoObject", "name": "Cake | Pinterest", "contentUrl": "c.mp4"}, {"@type": "SocialMediaPosting", "image": "i.jpg", "author": {"name": "Ann", "url": "https://www.pinterest.com/ann/"}}]
    page = f'<script type="application/ld+json">{json.dumps(ld)}</script><script type="application/ld+json">bad</script>'
    d = spark.createDataFrame([(json.dumps(syndicated), json.dumps(mirrored), json.dumps(manifest), page), ("bad", "{}", None, "")], "s string, m string, f string, p string")
    a, b = d.select(platforms.syndicated_record(F.col("s")).alias("s"), platforms.mirrored_record(F.col("m")).alias("m"), platforms.document_manifest(F.col("f")).alias("f"), platforms.pin_record(F.col("p")).alias("p")).collect()
    assert (a.s.title, a.s.verified, a.s.metrics, [m.url for m in a.s.media], a.s.posted_at.year) == ("Jane (@jane) on X", True, {"likes": 12.0}, ["a.jpg"], 2024)
    assert (a.m.description, a.m.video_thumbnail, [m.type for m in a.m.media], a.m.posted_at.month) == ("Hi", "g.jpg", ["video"], 5)
    assert (a.f.pdf_url, a.f.pages_url) == ("d.pdf", "m")
    assert (a.p.title, a.p.author_name, a.p.author_username, a.p.video_url, a.p.image) == ("Cake", "Ann", "ann", "c.mp4", "i.jpg")
    assert b.s is None and b.m is None and b.p.title == "Pinterest Pin"


def test_requests_without_a_key_coalesce(spark):
    from skein.operators import state

    rows = [(1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:00:01"), (3, "u", "2024-01-01 00:00:02")]
    d = spark.createDataFrame(rows, "event_id long, user string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = state.coalesced(d, ["user"])
    assert sorted((r["event_id"], r["leader_id"], r["already_exists"]) for r in got.collect()) == [(1, 1, False), (2, 1, True), (3, 3, False)] and got.columns == ["event_id", "user", "ts", "leader_id", "already_exists"]


def test_scratch_tables_need_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from skein.session import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
    assert shared_dir(session("local[2]")).startswith("file:")
