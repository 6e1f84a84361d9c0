"""Queries over stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import pages
from skein.plans.links import LINKS_SQL
from skein.plans.sql import canonical_ctes, decoded, title_of, trim, values
from skein.sources.tables import table


#: page_id, link, HTML of pages for the branches that the generated ones never reach.
PAGES = [
    (-1, "https://news.example.com/a/b", """<html><head><title>Plain</title><meta property="og:title" content="OG title"><meta name="twitter:title" content="Tw title"><meta property="og:image" content="/img/a.png">
<link rel="icon" href="/fav.png"><meta property="og:site_name" content="News"><meta name="author" content="Jane Doe"><meta property="article:published_time" content="2026-01-02T03:04:05Z"><meta property="og:type" content="article"></head><body><p>x</p></body></html>"""),
    (-2, "https://b.example/x", """<html><head><title>T</title><script type="application/ld+json">{"@type": "NewsArticle", "headline": "LD head", "image": "https://x.example/i.jpg", "author": {"name": "Ann"}, "datePublished": "2025-05-05"}</script></head><body></body></html>"""),
    (-3, "https://c.example/y", "<html><head><title>Access Denied</title></head><body>Reference #18</body></html>"),
    (-4, "https://d.example/login", "<html><head><title>Login</title></head><body><form action='/login'><input type='password'></form></body></html>"),
    (-5, "https://e.example/z", "<html><head><link rel='shortcut icon' href='s.ico'><link rel='apple-touch-icon' href='//cdn.example/t.png'></head><body><h1>Only H1</h1></body></html>"),
    (-6, "https://www.reddit.com/r/x/comments/abc123/t/", "<html><head><meta property='og:title' content='A post'><meta property='og:image' content='https://www.redditstatic.com/icon.png'></head><body></body></html>"),
    (-8, "https://g.example/", "<html><head><title>Just a moment...</title></head><body></body></html>"),
    (-7, "https://f.example/p", "<html><head><meta name='twitter:image' content='https://f.example/tw.png'><meta name='title' content='Meta title'><meta property='og:logo' content='https://f.example/l.png'></head><body></body></html>"),
]
#: page_id, title, image, logo, site, author, published_at, type, blocked: by hand from the rules of P4-P8, CF2 and CF7.
EXPECTED = [
    (-1, "Tw title", "https://news.example.com/img/a.png", "https://news.example.com/fav.png", "News", "Jane Doe", "2026-01-02T03:04:05Z", "article", False),
    (-2, "LD head", "https://x.example/i.jpg", "https://b.example/favicon.ico", None, "Ann", "2025-05-05", "NewsArticle", False),
    (-3, None, None, "https://c.example/favicon.ico", None, None, None, None, True),
    (-4, None, None, "https://d.example/favicon.ico", None, None, None, "website", False),
    (-5, "Only H1", None, "https://cdn.example/t.png", None, None, None, "website", False),
    (-6, "A post", None, "https://www.reddit.com/favicon.ico", None, None, None, "website", False),
    (-8, "Just a moment", None, "https://g.example/favicon.ico", None, None, None, "website", False),  # titles are cleaned of dots before they are judged
    (-7, "Meta title", "https://f.example/tw.png", "https://f.example/l.png", None, None, None, "website", False),
]


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url", "html").unionByName(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1))


def page_metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = pages.metadata(pages.parsed(_pages(spark, sf)))
    return d.select("page_id", "title", "image", "logo", "site", "author", "published_at", "type", "blocked")


def page_article(spark: SparkSession, sf: str) -> DataFrame:
    d = pages.metadata(pages.parsed(table(spark, sf, "pages")))
    return d.select("page_id", F.sha2("article", 256).alias("article_sha256"), F.col("words").cast("long").alias("words"), F.col("minutes").cast("long").alias("minutes"), "intent", "link_density")


def extract_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The whole generic pipeline: canonical links, safety, metadata, articles, one record a link."""
    d = pages.extract(table(spark, sf, "pages"))
    return d.select("page_id", "canonical", "platform", "title", "description", "image", "logo", "site_name", "author", "published_at", "type", "page_intent", "word_count", "reading_time_minutes", "admitted")


_TEXT = lambda x: trim(decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))
#: Articles of the generated pages hold a heading and paragraphs only.
ARTICLES = f"""
inner_html AS (SELECT page_id, url, html, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS a FROM pages),
parts AS (SELECT page_id, url, html, {_TEXT("regexp_extract(a, '(?is)<h1>(.*?)</h1>', 1)")} AS h1, list_filter(list_transform(string_split(a, '<p>')[2:], lambda p: {_TEXT('p')}), lambda p: length(p) > 20) AS ps FROM inner_html),
art AS (SELECT page_id, url, html, h1, ps, array_to_string(list_concat(CASE WHEN h1 = '' THEN [] ELSE ['# ' || h1] END, ps), chr(10) || chr(10)) AS content FROM parts),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS words FROM art)"""

SQL = {
    "page_metadata": f"""SELECT page_id, {title_of('html')} AS title, NULL::VARCHAR AS image, regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/favicon.ico' AS logo, NULL::VARCHAR AS site, NULL::VARCHAR AS author,
 NULL::VARCHAR AS published_at, 'website' AS type, false AS blocked FROM pages
 UNION ALL SELECT * FROM {values(EXPECTED, 'page_id, title, image, logo, site, author, published_at, type, blocked')}""",
    "page_article": f"""WITH {ARTICLES} SELECT page_id, sha256(content) AS article_sha256, words, greatest(1, CAST(ceil(words / 200) AS BIGINT)) AS minutes,
 CASE WHEN words > 150 THEN 'article' WHEN regexp_matches(lower(url), '/(?:components|docs|tools|ui|library|resources|templates|icons|cheatsheet|showcase)') THEN 'tool_or_resource' ELSE 'general_website' END AS intent,
 0.0::DOUBLE AS link_density FROM counted""",
    "extract_pipeline": f"""WITH {canonical_ctes("SELECT page_id AS id, url FROM pages")}, {ARTICLES}, top AS (SELECT arg_max(id, id) AS page_id, canonical FROM canon GROUP BY canonical),
r AS (SELECT c.*, t.canonical, {title_of('c.html')} AS title0, {_TEXT("regexp_extract(c.html, '(?is)<p>(.*?)(?:</p>|<p>|</article>)', 1)")} AS p0 FROM top t JOIN counted c USING (page_id))
SELECT page_id, canonical, 'generic' AS platform, title0 AS title, CASE WHEN length(p0) > 20 THEN {trim('left(p0, 300)')} ELSE '' END AS description, NULL::VARCHAR AS image,
 regexp_extract(url, '(?i)^(https?://[^/?#]+)', 1) || '/favicon.ico' AS logo, 'Example' AS site_name, NULL::VARCHAR AS author, NULL::VARCHAR AS published_at,
 CASE WHEN words >= 80 THEN 'article' ELSE 'website' END AS type, CASE WHEN words >= 80 THEN 'article' WHEN regexp_matches(lower(url), '/(?:components|docs|tools|ui|library|resources|templates|icons|cheatsheet|showcase)') THEN 'tool_or_resource' ELSE 'general_website' END AS page_intent,
 words AS word_count, greatest(1, CAST(ceil(words / 200) AS BIGINT)) AS reading_time_minutes, true AS admitted FROM r""",
}

QUERIES = {f.__name__: f for f in (page_metadata, page_article, extract_pipeline)}
__all__ = ["LINKS_SQL", "QUERIES", "SQL"]
