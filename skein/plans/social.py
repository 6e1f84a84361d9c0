"""Queries over platform texts and the statements of saved links; literal rows have expected results worked out by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import social
from skein.operators import library
from skein.plans.sql import values
from skein.plans.state import _bookmarks
from skein.sources.tables import table

#: id, text, and what cleaning it gives.
INSTAGRAM = [
    (-1, "Hi<br/>there</p>", "Hi\nthere"), (-2, "a \\u0026 b \\u003cb\\u003ebold\\u003c/b\\u003e", "a & b bold"), (-3, "one\\r\\ntwo\\nthree", "one\ntwo\nthree"), (-4, "it\\'s &quot;ok&quot; &#064;you", 'it\'s "ok" @you'),
    (-5, None, ""), (-6, "  plain  ", "plain"),
]
#: id, description, user, the caption shown.
DESCRIPTIONS = [
    (-1, 'Jane Doe on Instagram: "A day out"', "jane", 'Doe on Instagram: "A day out'), (-9, 'Jane Doe on Instagram: "A day out"..', "jane", "A day out"), (-2, 'Jane on August 1, 2026: "Sea and sun". ', "jane", "Sea and sun"), (-3, "@Jane: hello View all 1,2K comments and on", "jane", "hello"),
    (-4, "janeTomorrow 9 PM View more on Instagram", "jane", "Tomorrow 9 PM"), (-5, "unknown origin", "unknown", "unknown origin"), (-6, "plain \\u0026 text", None, "plain & text"), (-7, None, "jane", ""), (-8, "a.b", "axb", "a.b"),
]
#: id, link, its own link, the image's id.
IMAGES = [
    (-1, "https://preview.redd.it/my-title-v0-abcdefgh1234.jpeg?width=640&amp;auto=webp", "https://i.redd.it/abcdefgh1234.jpeg", "abcdefgh1234"), (-2, "https://i.redd.it/zyxw98765432.png", "https://i.redd.it/zyxw98765432.png", "zyxw98765432"),
    (-3, "https://preview.redd.it/abcdefgh1234", "https://i.redd.it/abcdefgh1234.jpg", "abcdefgh1234"), (-4, "https://example.org/a.png?x=1&amp;y=2", "https://example.org/a.png?x=1&y=2", None), (-5, "", None, None), (-6, None, None, None),
]
ICONS = [(-1, "https://a.example/icon.png", "https://a.example/icon.png"), (-2, "https://a.example/default.png", social.SUBREDDIT_LOGO), (-3, "https://ui-avatars.com/x", social.SUBREDDIT_LOGO), (-4, None, social.SUBREDDIT_LOGO), (-5, "icon.png", social.SUBREDDIT_LOGO)]
#: id, text, the day.
DAYS = [
    (-1, "12 likes - jane on August 1, 2026: hi", "2026-08-01"), (-2, "on Feb 30 2025", "2025-03-02"), (-3, "ON december 31, 1999.", "1999-12-31"), (-4, "on Monday 5, 2020", None), (-5, "August 1, 2026", None), (-6, None, None), (-7, "on May 32, 2020", None),
]
JOINS = [(-1, "2013-05-01T00:00:00Z", "Joined May 2013"), (-2, "2020-12-31", "Joined December 2020"), (-3, "soon", None), (-4, None, None)]
#: id, title, restricted, is_profile, name, user, the title shown.
TITLES = [
    (-1, "A day out", False, False, None, "jane", "A day out"), (-2, "A day out", True, False, None, "jane", "Restricted Instagram Content"), (-3, "Instagram", False, True, "Jane Doe", "jane", "Jane Doe (@jane)"),
    (-4, "", False, True, "Instagram User", "jane", "@jane on Instagram"), (-5, None, False, False, None, "jane", "Post by @jane on Instagram"), (-6, "Instagram Post", False, True, None, "unknown", "Instagram Post"),
]
#: id, type, card, link's platform, whether the link is a profile's, description; label, stale in a list, stale on request, HTML, words, minutes, byline, excerpt.
CARDS = [
    (-1, "x", '{"type": "y"}', "generic", False, "d", "x", False, False, None, None, None, None, None),
    (-2, "", '{"type": "y", "is_profile": true, "banner_url": "b", "metrics": {"followers": "9"}}', "x", True, "", "y", False, False, None, None, None, None, None),
    (-3, None, '{"is_profile": true, "banner_url": "b", "metrics": {}}', "x", True, None, "x", True, False, None, None, None, None, None),
    (-4, None, '{"metrics": {"followers": 0}}', "x", True, None, "x", True, True, None, None, None, None, None),
    (-5, None, None, "generic", True, None, "generic", True, True, None, None, None, None, None),
    (-6, None, '{"article_content": " one two\\n\\nthree ", "author": {"name": "Ann"}}', "generic", False, "e", "generic", False, False, "<p>one two</p><p>three</p>", 3, 1, "Ann", "e"),
    (-7, None, '{"article_content": "x", "word_count": 900, "reading_time_minutes": 5}', "generic", False, "", "generic", False, False, "<p>x</p>", 900, 5, None, None),
]


def _cut(rows: list[tuple], *at: int) -> list[tuple]:
    return [tuple(r[i] for i in at) for r in rows]


def _with(spark: SparkSession, sf: str, rows: list[tuple], schema: str, *columns) -> DataFrame:
    """The literal rows below rows made of whole `documents`, so that a query grows with its table."""
    names = [c.split()[0] for c in schema.split(", ")]
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), *[c.alias(n) for c, n in zip(columns, names[1:], strict=True)])
    return d.unionByName(spark.createDataFrame(rows, schema).coalesce(1))


def instagram_text(spark: SparkSession, sf: str) -> DataFrame:
    d = _with(spark, sf, _cut(INSTAGRAM, 0, 1), "id long, raw string", F.format_string("Doc %d<br/>a \\u0026 <b>b</b></p>", "doc_id"))
    return d.select("id", social.instagram_text(F.col("raw")).alias("cleaned"))


def instagram_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    d = _with(spark, sf, _cut(DESCRIPTIONS, 0, 1, 2), "id long, raw string, user string", F.format_string('Jane on August 1, 2026: "Caption %d". ', "doc_id"), F.lit("jane"))
    return d.select("id", social.instagram_description(F.col("raw"), F.col("user")).alias("shown"))


def reddit_images(spark: SparkSession, sf: str) -> DataFrame:
    d, c = _with(spark, sf, _cut(IMAGES, 0, 1), "id long, raw string", F.format_string("https://preview.redd.it/title-v0-abcdefgh%d.png?width=9", "doc_id")), F.col("raw")
    return d.select("id", social.reddit_image(c).alias("image"), social.reddit_media_id(c).alias("media_id"))


def subreddit_icons(spark: SparkSession, sf: str) -> DataFrame:
    link = F.format_string("https://a.example/%s/%d.png", F.when(F.col("doc_id") % 2 == 0, "icon").otherwise("default"), "doc_id")
    return _with(spark, sf, _cut(ICONS, 0, 1), "id long, raw string", link).select("id", social.subreddit_icon(F.col("raw")).alias("icon"))


def social_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The days of whole `orders` in a sentence and as a date, and the literal rows."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"))
    days, joins = spark.createDataFrame(_cut(DAYS, 0, 1), "id long, raw string").coalesce(1), spark.createDataFrame(_cut(JOINS, 0, 1), "id long, raw string").coalesce(1)
    a = o.select("id", F.concat(F.lit("9 likes - jane on "), F.date_format("day", "MMMM d, yyyy")).alias("raw")).unionByName(days).select("id", F.lit("posted").alias("kind"), social.posted_on(F.col("raw")).cast("string").alias("shown"))
    b = o.select("id", F.col("day").cast("string").alias("raw")).unionByName(joins).select("id", F.lit("joined").alias("kind"), social.joined(F.col("raw")).alias("shown"))
    return a.unionByName(b)


def instagram_titles(spark: SparkSession, sf: str) -> DataFrame:
    schema = "id long, title string, restricted boolean, is_profile boolean, name string, user string"
    d = _with(spark, sf, _cut(TITLES, 0, 1, 2, 3, 4, 5), schema, F.format_string("Day %d", "doc_id"), F.col("doc_id") % 7 == 0, F.lit(False), F.lit(None).cast("string"), F.lit("jane"))
    return d.select("id", social.instagram_title(*map(F.col, ("title", "restricted", "is_profile", "name", "user"))).alias("shown"))


def card_rules(spark: SparkSession, sf: str) -> DataFrame:
    schema = "id long, type string, card string, fallback string, is_link boolean, description string"
    d = _with(spark, sf, _cut(CARDS, 0, 1, 2, 3, 4, 5), schema, F.lit(None).cast("string"), F.format_string('{"type": "k%d", "article_content": "w%d x"}', "doc_id", "doc_id"), F.lit("generic"), F.lit(False), F.lit("d"))
    link, card = F.col("is_link"), F.col("card")
    d = d.withColumn("a", social.article_of_card(card, F.col("description")))
    return d.select(
        "id", social.platform_label(F.col("type"), card, F.col("fallback")).alias("label"), social.stale_profile(link, card, True).alias("stale_listed"), social.stale_profile(link, card, False).alias("stale_asked"),
        "a.html", "a.words", "a.minutes", "a.byline", "a.excerpt",
    )


def untrusted_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with tags put around its last word in two spellings."""
    raw = F.concat(F.lit("<untrusted_content>"), F.coalesce("text", F.lit("")), F.lit("</UNTRUSTED_content> end </ untrusted_content>"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(social.without_untrusted_tags(raw), 256).alias("sha256"))


def _short(spark: SparkSession, sf: str) -> DataFrame:
    u = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://LNKD.in/"), F.col("id").cast("string"))).otherwise(F.col("url"))
    return _bookmarks(spark, sf).withColumn("url", u)


def newest_shortlinks(spark: SparkSession, sf: str) -> DataFrame:
    return library.newest_shortlinks(_short(spark, sf)).select("user_id", "id", F.col("rank").cast("long").alias("rank"))


def bookmark_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Every third bookmark is new, with blanks for what is missing."""
    b = _bookmarks(spark, sf)
    new = b.where("id % 3 = 0").withColumns({"logo_url": F.lit(""), "card_data": F.coalesce("card_data", F.lit("{}"))})
    out = library.inserted(b.where("id % 3 <> 0"), new, F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return out.select("id", "user_id", "logo_url", "card_data", F.year("created_at").alias("year"), F.col("is_article"))


def article_insert(spark: SparkSession, sf: str) -> DataFrame:
    b = _bookmarks(spark, sf)
    found = b.where("id % 3 = 0").select(F.col("id").alias("bookmark_id"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("content_html"), F.when(F.col("id") % 9 == 0, F.lit("")).otherwise(F.lit("md")).alias("content_markdown"))
    old = b.where("id % 3 = 1 and is_article").select(F.col("id").alias("bookmark_id"), "user_id", F.lit("<p>old").alias("content_html"), F.lit("old").alias("content_markdown"))
    return library.inserted_articles(old, b, found)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each order asks for itself; those of every fourth one name another user."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0)).alias("user_id"))


def bookmark_of_user(spark: SparkSession, sf: str) -> DataFrame:
    return library.requested(_bookmarks(spark, sf), _requests(spark, sf)).select("request_id", "user_id", "url")


def article_of_bookmark(spark: SparkSession, sf: str) -> DataFrame:
    return library.article_html(article_insert(spark, sf), _requests(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (instagram_text, instagram_descriptions, reddit_images, subreddit_icons, social_dates, instagram_titles, card_rules, untrusted_tags, newest_shortlinks, bookmark_insert, article_insert, bookmark_of_user, article_of_bookmark)
}

_ARTICLES = """SELECT o_orderkey AS bookmark_id, o_custkey AS user_id, '<p>old' AS content_html, 'old' AS content_markdown FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, o_custkey, '<p>' || o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN 'md' END FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0"""
SQL = {
    "instagram_text": f"SELECT doc_id AS id, 'Doc ' || doc_id || chr(10) || 'a & b' AS cleaned FROM documents UNION ALL SELECT * FROM {values(_cut(INSTAGRAM, 0, 2), 'id, cleaned')}",
    "instagram_descriptions": f"SELECT doc_id AS id, 'Caption ' || doc_id AS shown FROM documents UNION ALL SELECT * FROM {values(_cut(DESCRIPTIONS, 0, 3), 'id, shown')}",
    "reddit_images": f"SELECT doc_id AS id, 'https://i.redd.it/abcdefgh' || doc_id || '.png' AS image, 'abcdefgh' || doc_id AS media_id FROM documents UNION ALL SELECT * FROM {values(_cut(IMAGES, 0, 2, 3), 'id, image, media_id')}",
    "subreddit_icons": f"SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/icon/' || doc_id || '.png' ELSE '{social.SUBREDDIT_LOGO}' END AS icon FROM documents UNION ALL SELECT * FROM {values(_cut(ICONS, 0, 2), 'id, icon')}",
    "social_dates": f"SELECT o_orderkey AS id, 'posted' AS kind, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders UNION ALL SELECT o_orderkey, 'joined', 'Joined ' || strftime(o_orderdate, '%B %Y') FROM orders UNION ALL SELECT id, 'posted' AS kind, shown FROM {values(_cut(DAYS, 0, 2), 'id, shown')} UNION ALL SELECT id, 'joined', shown FROM {values(_cut(JOINS, 0, 2), 'id, shown')}",
    "instagram_titles": f"SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'Restricted Instagram Content' ELSE 'Day ' || doc_id END AS shown FROM documents UNION ALL SELECT * FROM {values(_cut(TITLES, 0, 6), 'id, shown')}",
    "card_rules": f"SELECT doc_id AS id, 'k' || doc_id AS label, false AS stale_listed, false AS stale_asked, '<p>w' || doc_id || ' x</p>' AS html, 2::BIGINT AS words, 1::BIGINT AS minutes, NULL::VARCHAR AS byline, 'd' AS excerpt FROM documents UNION ALL SELECT id, label, stale_listed, stale_asked, html, CAST(words AS BIGINT) AS words, CAST(minutes AS BIGINT) AS minutes, byline, excerpt FROM {values(_cut(CARDS, 0, 6, 7, 8, 9, 10, 11, 12, 13), 'id, label, stale_listed, stale_asked, html, words, minutes, byline, excerpt')}",
    "untrusted_tags": "SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '(?i)</?untrusted_content>', '', 'g') || ' end </ untrusted_content>') AS sha256 FROM documents",
    "newest_shortlinks": "SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders WHERE o_orderkey % 2 = 0 QUALIFY rank <= 10",
    "bookmark_insert": """SELECT o_orderkey AS id, o_custkey AS user_id, NULL::VARCHAR AS logo_url, CASE WHEN o_orderkey % 5 = 0 THEN '{"snapshot": "s.png"}' END AS card_data,
 CASE WHEN o_orderkey % 3 = 0 THEN 2024 ELSE CAST(year(o_orderdate) AS INT) END AS year, o_orderkey % 2 = 0 AS is_article FROM orders""",
    "article_insert": _ARTICLES,
    "bookmark_of_user": "SELECT o_orderkey AS request_id, o_custkey AS user_id, 'https://shop.example/' || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 0",
    "article_of_bookmark": f"SELECT o_orderkey AS request_id, content_html FROM orders LEFT JOIN ({_ARTICLES}) a ON o_orderkey = a.bookmark_id",
}
