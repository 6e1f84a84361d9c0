"""Column functions against literal rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import classify, html, net, numeric, text, url


def none():
    return F.lit(None).cast("string")


def run(spark, f, given_rows):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given_rows)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


CASES = {
    "canonical": (url.canonical_url, {
        "http://www.example.com/a/b/?utm_source=x&b=2&a=1#frag": "https://example.com/a/b?a=1&b=2",
        "x: https://twitter.com/Jack/status/20?s=20": "https://x.com/jack/status/20",
        "https://www.instagram.com/reels/AbC_1/?igsh=z": "https://www.instagram.com/reel/AbC_1/",
        "instagram.com/NASA": "https://www.instagram.com/NASA/",
        "https://youtu.be/dQw4w9WgXcQ?t=42&si=q": "https://www.youtube.com/watch?v=dQw4w9WgXcQ&t=42",
        "https://m.youtube.com/shorts/dQw4w9WgXcQ": "https://www.youtube.com/watch?v=dQw4w9WgXcQ",
        "https://old.reddit.com/r/Spark/comments/abc123/some_title/": "https://www.reddit.com/r/spark/comments/abc123/",
        "https://www.reddit.com/r/Spark/comments/abc123/some_title/def4567/?x=1": "https://www.reddit.com/r/spark/comments/abc123/comment/def4567/",
        "https://in.pinterest.com/pin/12345/": "https://www.pinterest.com/pin/12345/",
        "https://www.linkedin.com/posts/jane_topic-activity-7123456789012345678-abcd?trk=x": "https://www.linkedin.com/posts/jane_topic-activity-7123456789012345678-abcd",
        "https://m.facebook.com/page/?fbclid=1&id=9": "https://www.facebook.com/page/?id=9",
        "[t](https://example.org/p?ref=a)": "https://example.org/p",
        "example.com": "https://example.com/",
        "https://example.com/?trackingId=1": "https://example.com/?trackingId=1",
        "https://netflix.com/foo/status/123": "https://x.com/foo/status/123",
        "https://example.com:8443/x": "https://example.com:8443/x",
        "https://example.com/p?b=x+y&a": "https://example.com/p?a=&b=x+y",
        "": "", None: "",
    }),
    "description": (text.clean_description, {
        '654K likes, 4,503 comments - srividyakotnala on July 14, 2025: "This song..."': "This song",
        "99 votes, 17 comments. Naa job hunt lo...": "Naa job hunt lo",
        "1.2K upvotes, 45 comments. Body": "Body",
        'jane.doe on July 4, 2025: "Hello"': "Hello",
        "Line one\n.\n.\n.\nLine two": "Line one\n.\nLine two",
        'a &amp;lt;b&gt; &#128512; \\"q\\"': 'a <b> 😀 "q',
        "&#x41;&#0;&#99999999;&#38;#65;": "A&#65;",
        "Some text... Read more": "Some text", "  ": None, None: None,
    }),
    "title": (text.clean_title, {
        'Srividya Kotnala on Instagram: "This song"': "This song", 'User (@handle) on X: "hi there"': "hi there", "My Clip - YouTube": "My Clip",
        "Wait . . . what": "Wait what", '"Quoted"': "Quoted", "Foo on Bar: baz": "Foo on Bar: baz", None: None,
    }),
    "floor": (numeric.parse_count_floor, {"1.5K": 1500, "2.3M": 2300000, "8.2M": 8199999, "1,234": 1234, "3 likes": 3000, "5 lakh": 5000, "1.2 Cr": 12000000, "12L": 1200000, "-2K": -2000, "1e3": 1000, "abc": 0, "": 0, None: 0}),
    "round": (numeric.parse_count_round, {"1.5K": 1500, "8.2M": 8200000, "1,234": 1234, "3 likes": 3, "1.2 Cr": 1, "12L": 12, "-2K": -2000, "1e3": 1, "abc": 0, "": 0}),
    "shown": (numeric.format_count, {"1.5k": "1.5K", "19,920,702": "19M", "1500": "1500", "1,500": "1K", "abc": "abc", "": None}),
    "private": (net.is_private_ip, {
        **dict.fromkeys(["127.0.0.1", "::ffff:10.0.0.1", "100.64.0.1", "172.16.0.1", "198.19.0.1", "255.255.255.255", "2001:db8::1", "::1", "1.2.3", "256.1.1.1", "fc.example", None], True),
        **dict.fromkeys(["8.8.8.8", "100.63.255.255", "172.15.0.1", "192.0.1.1", "2606:4700::1", "1..2.3"], False),
    }),
    "site": (lambda c: url.site_name(c, none()), {
        "https://github.com/a/b/issues/1": "GitHub Issue", "https://sub.example.co.uk/": "Example", "https://blog.tionsh.example.net/": "Example", "https://netflix.com/": "X",
        "https://localhost/": "Localhost", "not a url": "Unknown Site",
    }),
    "platform": (url.platform, {"t.co/x": "x", "https://netflix.com/": "generic", "https://in.pinterest.co.uk/": "pinterest", "https://redd.it/a": "reddit", "fb.me/x": "facebook", None: "generic"}),
    "truncated": (text.is_truncated, {"abc…": True, "abc...": True, "a" * 257 + "...": False, "abc": False, None: False}),
    "password": (net.password_ok, {"Abcdefg1": True, "abcdefg1": False, "Abcdef1": False, None: False}),
    "slug": (text.name_from_slug, {"https://www.linkedin.com/posts/jane-doe_topic-1": "Jane Doe", "https://www.linkedin.com/posts/jane-activity-7": "Jane", "https://x.org": None}),
    "post": (text.clean_post_text, {"Hi<br>there https://t.co/abc &mdash; Ann B (@ann) <a href='u'>March 21, 2006</a>": "Hi\nthere", "keep — this (@x) & more!": "keep — this (@x) & more!", None: None}),
    "linkedin_text": (text.clean_linkedin_text, {'"A <b>post</b>\\nmore | 12 comments on LinkedIn"}': "A post \nmore", "T | LinkedIn": "T", None: None}),
    "reddit_title": (text.clean_reddit_title, {"From the spark community on Reddit": "", "From the spark community on Reddit: Hello": "Hello", "Hello : r/spark": "Hello"}),
    "pin": (text.clean_pin_title, {"Cake | Pinterest": "Cake", "": "Pinterest Pin", None: "Pinterest Pin"}),
    "media_url": (text.clean_media_url, {'https:\\/\\/a.org\\/x?y=1\\u0026z=2\\"': "https://a.org/x?y=1&z=2", "": None}),
    "comment": (text.reddit_comment_id, {"https://reddit.com/r/a/comments/p1/comment/c1/?x": "c1", "https://reddit.com/r/a/comments/p1/title/c2": "c2", "https://reddit.com/r/a/comments/p1?comment=c3": "c3", "https://reddit.com/r/a/comments/p1/": None}),
    "profile": (classify.x_profile_user, {"https://x.com/NASA": "NASA", "https://twitter.com/a/followers": "a", "https://x.com/home": None, "https://x.com/a/status/1": None, "https://o.org/a": None}),
    "srcset": (html.best_source, {"a.png 100w, b.png 300w, c.png 200w": "b.png", "a.png, b.png 2x": "b.png", "a.png": "a.png", None: None}),
    "sanitize": (html.sanitize, {'<p onclick="x">a <a href="javascript:x" title="t">b</a><b>c</b><script>z</script><img src="/i.png"></p>': '<p>a <a title="t">b</a>c<img src="/i.png"></p>', None: None}),
    "fence": (text.strip_code_fence, {"```json\n{}\n```": "{}", "{}": "{}"}),
    "name": (lambda c: text.reddit_name(c, "u", "u/reddit_user"), {"[deleted]": "u/reddit_user", "bob": "u/bob", "u/bob": "u/bob", None: "u/reddit_user"}),
    "avatar": (text.upgrade_avatar, {"https://pbs.twimg.com/profile_images/1/a_normal.jpg": "https://pbs.twimg.com/profile_images/1/a_400x400.jpg", "https://o.org/a_normal.jpg": "https://o.org/a_normal.jpg"}),
    "linkedin": (classify.linkedin_type, {"https://www.linkedin.com/pulse/a": "linkedin_article", "https://www.linkedin.com/newsletters/a": "linkedin_newsletter", "https://www.linkedin.com/posts/x": "linkedin_post"}),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    f, cases = CASES[name]
    assert dict(zip(cases, run(spark, f, list(cases)), strict=True)) == cases


def test_email(spark):
    mails = [" A@B.co ", "a@b", "a@b.c", "a@b.c1", "@b.co", "no-at", "", None]
    got = run(spark, lambda c: net.validate_email(c, F.lit(False)), mails)
    assert [g.is_valid for g in got] == [True] + [False] * 7
    assert [g.error for g in got] == [None, net.FORMAT, net.BAD_TLD, net.BAD_TLD, net.ASK, net.ASK, net.REQUIRED, net.REQUIRED]
    assert got[0].normalized == "a@b.co"


def test_same_content(spark):
    pairs = [
        ("https://x.com/a/status/5", "https://twitter.com/b/status/5", True),
        ("https://youtu.be/dQw4w9WgXcQ?t=42", "https://www.youtube.com/watch?v=dQw4w9WgXcQ", True),
        ("https://www.reddit.com/r/a/comments/abc123/t/def4567/", "https://www.reddit.com/r/a/comments/abc123/", False),
        ("https://www.reddit.com/r/a/comments/abc123/t/def4567/", "https://www.reddit.com/r/b/comments/abc123/comment/def4567/", True),
        ("https://www.linkedin.com/posts/x-activity-7123456789012345678-a", "https://www.linkedin.com/feed/update/urn:li:activity:7123456789012345678/", True),
        ("https://a.com/x?utm_id=1", "http://www.a.com/x/", True), ("https://a.com/x", "https://a.com/y", False), (None, "https://a.com/", False), ("", "", False),
    ]
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    got = d.select("i", url.same_content(F.col("a"), F.col("b")).alias("x"), url.same_content(F.col("b"), F.col("a")).alias("y")).orderBy("i").collect()
    assert [r.x for r in got] == [r.y for r in got] == [p[2] for p in pairs]


def test_variants_and_resolve(spark):
    got = run(spark, url.url_variants, ["https://www.linkedin.com/posts/j-activity-7123456789012345678-ab?trk=x", "https://x.com/a/status/1", "https://instagram.com/p/Q1"])
    assert got[0][0] == "https://www.linkedin.com/posts/j-activity-7123456789012345678-ab" and got[0][-1] == "https://www.linkedin.com/feed/update/urn:li:share:7123456789012345678/"
    assert "https://twitter.com/a/status/1" in got[1] and "https://www.instagram.com/reel/Q1/" in got[2]
    links = {"../b": "https://a.com/b", "/f.ico": "https://a.com/f.ico", "//q.com/z": "https://q.com/z", "?k=1": "https://a.com/x/y?k=1", "i.png": "https://a.com/x/i.png", "https://z.com": "https://z.com/", "data:x": "data:x", " ": None, None: None}
    assert dict(zip(links, run(spark, lambda c: url.resolve_url(c, F.lit("https://a.com/x/y?z")), list(links)), strict=True)) == links


def test_metrics_and_media(spark):
    d = spark.createDataFrame([(1, {"likes": 0.0, "comments": 0.0}), (2, {"likes": 5.0, "comments": 0.0, "x": None}), (3, None), (4, {"x": None})], "i int, m map<string,double>")
    got = {r.i: r.o for r in d.select("i", numeric.sanitize_metrics(F.col("m")).alias("o")).collect()}
    assert got == {1: None, 2: {"likes": 5.0, "comments": 0.0}, 3: None, 4: None}
    images = spark.createDataFrame([([("video", "v.mp4", "p.jpg", None), ("image", "i.png", None, None), ("image", "i.png", None, None)],)], "m array<struct<type:string,url:string,poster:string,thumbnail:string>>")
    r = images.select(classify.analysis_images(F.lit("s.png"), F.col("m"), F.lit("general_website")).alias("a"), classify.analysis_images(F.lit("s.png"), F.col("m"), F.lit("article")).alias("b")).first()
    assert r.a == ["s.png", "p.jpg"] and r.b == []


def test_degraded_and_walls(spark):
    card = "struct<author_name:string,avatar_url:string,is_profile:boolean,media:array<struct<type:string,url:string>>>"
    rows = [
        ("instagram", "A", "d", ("A", "u", True, []), True), ("instagram", "A", "d", ("A", "u", True, [("image", "u")]), True), ("instagram", "A", "d", ("A", "u", True, [("image", "p"), ("image", "q")]), False),
        ("instagram", "Instagram", None, None, True), ("reddit", "t", "cut…", None, True), ("x", None, None, ("A", "u", False, []), False), ("website", None, None, None, False),
    ]
    d = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], f"i int, p string, t string, d string, c {card}")
    got = d.select("i", classify.is_degraded(F.col("p"), F.col("t"), F.col("d"), F.col("c"), F.col("c").isNotNull()).alias("o")).orderBy("i").collect()
    assert [r.o for r in got] == [r[4] for r in rows]
    walls = {None: True, "<html></html>": True, '<meta property="og:description">': False, '<meta property="og:title" content="Instagram">': True, '<meta property="og:title" content="NASA">': False, '<meta property="og:image">': False}
    assert dict(zip(walls, run(spark, lambda c: classify.is_instagram_wall(c, none()), list(walls)), strict=True)) == walls


def test_analysis(spark):
    f = classify.fallback_analysis(F.lit("Big movie #Tag"), none(), F.lit("Site 1"), F.lit("article"), F.lit("u"))
    got = run(spark, lambda c: classify.normalize_analysis(c, f), ['```json\n{"ai_context":" c ","ai_tags":["A b",""]}\n```', "nope", None])
    assert (got[0].context, got[0].categories, got[0].tags) == ("c", ["article", "site1", "movie"], ["ab"])
    assert got[1] == got[2] and got[1].tags == ["article", "site1", "movie", "tag"] and got[1].context == "Content Summary: Title: Big movie #Tag | Source: Site 1."


@settings(max_examples=8, deadline=None)
@given(st.lists(st.from_regex(r"https?://(www\.)?[a-z]{1,8}\.(com|org)(/[a-z0-9]{1,6}){0,3}/?(\?[a-z]{1,3}=[a-z0-9]{0,3}(&[a-z]{1,3}=[a-z]{0,2}){0,2})?", fullmatch=True), min_size=20, max_size=40))
def test_canonical_is_stable(spark, links):
    once = run(spark, url.canonical_url, links)
    assert run(spark, url.canonical_url, once) == once
