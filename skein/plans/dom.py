"""Queries over the nodes of stored pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import dom
from skein.plans.sql import decoded, values
from skein.session import materialize
from skein.sources.tables import table

S = "Rivers carry silt, sand and stones from the hills down to the sea, and they do so all year, in flood and in drought, day and night, until the land is flat."
#: Counts as 2 + 5 commas + 1 for its 151 characters.
POINTS = 8
SHORT = "A short line of text ends here."
#: page_id, HTML: articles among ads, side columns, related posts and lists of links.
ARTICLES = [
    (-1, f"<html><head><title>T</title></head><body><header><p>{S}</p></header><div class='sidebar'><p>{S}</p><p>{S}</p></div><div id='main'><p>{S}</p><p>{S} <a href='/x'>more</a></p><div class='ad-break'><p>{S}</p></div></div><footer><p>{S}</p></footer></body></html>"),
    (-2, f"<body><div id='w'><div class='part'><p>{S}</p><p>{S}</p></div><div class='menu-of-links'><a href='1'>{S}</a><a href='2'>{S}</a></div><div class='part'><p>{S}</p></div><p>{SHORT}</p><p>no stop</p></div></body>"),
    (-3, f"<body><div class='comment'><p>{S}</p><p>{S}</p></div></body>"),
    (-4, "<body><p>too short</p></body>"),
    (-5, ""),
    (-6, f"<body><div id='one'><div id='two'><div id='three'><p>{S}</p></div></div></div></body>"),
    (-7, f"<body><ul>{''.join(f'<li><a href=/{k}>{S}</a></li>' for k in range(4))}</ul></body>"),
]
#: page_id, container, its place as a node, score, parts, content: by hand. -1: the column's class is unlikely, the main part has the base of a div and its id's weight, and links
#: are 4 of 307 characters; -2: 5 and two paragraphs, the equal class joins the other part, the line with a stop too; -3: only the second try sees it, where its class costs 25, so the body with half of the points is better; -6: one child each, so the outermost.
EXPECTED = [
    (-1, "div", (5 + 25 + 2 * POINTS) * (1 - 4 / (2 * len(S) + 5)), 1, f"{S}\n\n{S} more"),
    (-2, "div", 5.0 + 2 * POINTS, 3, f"{S}\n\n{S}\n\n{S}\n\n{SHORT}"),
    (-3, "body", 2 * POINTS / 2, 1, f"{S}\n\n{S}"),
    (-4, "body", 0.0, 1, "too short"),
    (-6, "div", 5.0 + POINTS, 1, S),
    (-7, "body", 0.0, 1, "\n\n".join([S] * 4)),
]


def _nodes(spark: SparkSession, sf: str, rows: list[tuple]) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "html").unionByName(spark.createDataFrame(rows, "page_id long, html string").coalesce(1))
    # rows are told apart by a number of their own: a page_id may be null or repeated
    return materialize(dom.nodes(pages.select(F.struct("page_id", F.monotonically_increasing_id().alias("row")).alias("page"), "html"), "page"), "page-nodes")


def readable_article(spark: SparkSession, sf: str) -> DataFrame:
    d = dom.article(_nodes(spark, sf, ARTICLES), "page")
    return d.select("page.page_id", "container", F.round("score", 6).alias("score"), F.col("parts").cast("long").alias("parts"), F.sha2("content", 256).alias("content_sha256"), "words", "minutes", F.round("link_density", 6).alias("link_density"), "readable")


#: page_id, HTML: a post in a feed, cards without an article, related posts in and beside the post.
POSTS = [
    (-1, "<main><article class='related-posts__crosslink'><p>Other</p></article><article class='feed'><p>Mine <b>bold</b></p><img src='a.png'><div class='x related-posts'><p>More</p><img src='b.png'></div><img data-delayed-url='c.png'><img src='a.png'></article><article><p>Next</p></article></main>"),
    (-2, "<body><div class='main-feed-activity-card related-posts'>R</div><div class='c main-feed-activity-card'>Card<article class='x-related-posts'>in</article></div></body>"),
    (-3, "<body><div class='main-feed-activity-card related-posts'>R</div><div class='feed-shared-update-v2'>Shared <img src='s.png'></div></body>"),
    (-4, "<body><main>Main text<section data-test-id='x-related-y'>off</section></main></body>"),
    (-5, "<body>Body only</body>"),
]
#: page_id, rule, text, images: by hand.
POSTS_EXPECTED = [(-1, 0, "Mine bold", "a.png,c.png"), (-2, 1, "Card", ""), (-3, 2, "Shared", "s.png"), (-4, 4, "Main text", ""), (-5, 5, "Body only", "")]


def main_posts(spark: SparkSession, sf: str) -> DataFrame:
    d = dom.post_parts(_nodes(spark, sf, POSTS), "page")
    return d.select("page.page_id", "rule", F.sha2("text", 256).alias("text_sha256"), F.array_join("images", ",").alias("images"))


_FLAT = lambda x: f"regexp_replace({x}, '\\s+', ' ', 'g')"
_TEXT = lambda x: _FLAT(decoded(f"regexp_replace({x}, '<[^>]*>', '', 'g')"))
_POINTS = lambda x: f"CASE WHEN length({x}) >= 25 THEN 2 + length({x}) - length(replace({x}, ',', '')) + least(length({x}) // 100, 3) ELSE 0 END"
SQL = {
    # generated pages: a column of links, an ad, an article of a heading and paragraphs, a footer
    "readable_article": f"""WITH cut AS (SELECT page_id, {_TEXT("regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)")} AS ad, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS a FROM pages),
parts AS (SELECT page_id, ad, {_TEXT("regexp_extract(a, '(?is)<h1>(.*?)</h1>', 1)")} AS h1, list_transform(string_split(a, '<p>')[2:], lambda p: {_TEXT('p')}) AS ps FROM cut),
scored AS (SELECT *, list_sum(list_transform(ps, lambda p: {_POINTS('p')})) AS own, {_POINTS('ad')} AS of_ad FROM parts),
chosen AS (SELECT *, coalesce(own, 0) AS art, coalesce(own, 0) / 2 + of_ad AS body, length(ad) > 80 OR regexp_matches(ad, '\\.( |$)') AS beside FROM scored),
told AS (SELECT page_id, art > body AS in_article, CASE WHEN art > body THEN art ELSE body END::DOUBLE AS score, CASE WHEN art > body AND beside THEN 2 ELSE 1 END AS parts,
 array_to_string(list_filter(list_transform(list_concat(CASE WHEN art > body AND NOT beside THEN [] ELSE [ad] END, [h1], ps), lambda x: trim(x)), lambda x: x <> ''), chr(10) || chr(10)) AS content FROM chosen),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) AS words FROM told)
SELECT page_id, CASE WHEN in_article THEN 'article' ELSE 'body' END AS container, score, parts::BIGINT AS parts, sha256(content) AS content_sha256, words, greatest(1, CAST(ceil(words / 200) AS BIGINT)) AS minutes, 0.0::DOUBLE AS link_density, words >= 80 AS readable FROM counted
UNION ALL SELECT page_id, container, round(score::DOUBLE, 6), parts, sha256(content), len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')), greatest(1, CAST(ceil(len(regexp_split_to_array(content, '\\s+')) / 200) AS BIGINT)), round(links::DOUBLE, 6), is_article
 FROM {values([(*r, x, y) for r, x, y in zip(EXPECTED, (4 / (2 * len(S) + 5), 0, 0, 0, 0, 1), (False, True, False, False, False, False), strict=True)], 'page_id, container, score, parts, content, links, is_article')}""",
    "main_posts": f"""WITH cut AS (SELECT page_id, regexp_split_to_array(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '<[^>]*>') AS x FROM pages)
SELECT page_id, 0 AS rule, sha256(array_to_string(list_filter(list_transform(x, lambda p: trim({_FLAT(decoded('p'))})), lambda p: p <> ''), ' ')) AS text_sha256, '' AS images FROM cut
UNION ALL SELECT page_id, rule, sha256(text), images FROM {values(POSTS_EXPECTED, 'page_id, rule, text, images')}""",
}
QUERIES = {f.__name__: f for f in (readable_article, main_posts)}
