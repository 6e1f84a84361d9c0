"""Queries over script payloads. Payloads are made of whole tables, so that what must come back is known, and of literal rows for the odd cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import payload
from skein.operators.tiers import escalated, reddit_lacks_key_data
from skein.plans.sql import values
from skein.sources.tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


#: id, embed, types and links by hand: two levels of escapes, brackets in strings, a payload that is cut off, no key.
EMBEDS = [
    (-1, r'x "edge_sidecar_to_children":{"edges":[{"node":{"display_url":"https:\/\/c.example\/a]b.jpg?x=1&2"}},{"node":{"is_video":true,"video_url":"https://c.example/v.mp4","display_url":"https://c.example/t.jpg"}}]} y', "image,video", "https://c.example/a]b.jpg?x=1&2,https://c.example/v.mp4"),
    (-2, r'\"edge_sidecar_to_children\":{\"edges\":[{\"node\":{\"display_url\":\"https:\\\/\\\/c.example\\\/a.jpg\",\"text\":\"} ] \\\" {\"}}]}', "image", "https://c.example/a.jpg"),
    (-3, r'\\\"edge_sidecar_to_children\\\":{\\\"edges\\\":[{\\\"node\\\":{\\\"display_url\\\":\\\"https://c.example/b.jpg\\\"}}]}', "image", "https://c.example/b.jpg"),
    (-4, r'"edge_sidecar_to_children":{"edges":[{"node":{"display_url":"https://c.example/1.jpg"}},{"node":{"display_url":"https://c.example/2.j', "image", "https://c.example/1.jpg"),
    (-5, r'"edge_sidecar_to_children":{"edges":[]}', "", ""), (-6, '"edges":[{"node":{"display_url":"https://c.example/1.jpg"}}]', "", ""), (-7, None, "", ""),
    (-8, r'"edge_sidecar_to_children":{"edges":[null,{"node":{"is_video":true,"display_url":"https://c.example/p.jpg"}}]}', "image", "https://c.example/p.jpg"),
]


def carousels(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as the text of an item of an escaped payload, between brackets that do not close."""
    item = F.to_json(F.struct(F.struct(F.concat(F.lit("https://c.example/"), "id").alias("display_url"), "text", F.lit("]}[{").alias("mark")).alias("node")))
    d = _docs(spark, sf).select("id", F.concat(F.lit(r'\"edge_sidecar_to_children\":{\"edges\":['), _escaped(F.concat(item, F.lit(","), item)), F.lit("]} [")).alias("raw"))
    d = d.unionByName(spark.createDataFrame([r[:2] for r in EMBEDS], "id long, raw string").coalesce(1))
    d = d.withColumn("found", payload.array_items(F.col("raw"), "edge_sidecar_to_children", "edges")).withColumn("media", payload.media_of(F.col("found.items")))
    text = F.get_json_object(F.try_element_at("found.items", F.lit(1)), "$.node.text")
    return d.select(
        "id", F.coalesce(F.size("found.items"), F.lit(0)).cast("long").alias("items"), F.sha2(F.when(F.col("id") >= 0, text), 256).alias("text_sha256"),
        F.array_join("media.type", ",").alias("types"), F.array_join("media.url", ",").alias("urls"),
    )


#: id, JSON, paths by hand.
NESTED = [
    (-1, '{"a": {"k": 1}, "k": 2}', "$.k=2 $.a.k=1"), (-2, '[{"k": {"k": [{"k": null}]}}]', '$[0].k={"k": [{"k": null}]} $[0].k.k=[{"k": null}] $[0].k.k[0].k=null'), (-3, '{"k": ', ""), (-4, "7", ""), (-5, None, ""), (-6, '{"a": [1, "k", {"x": {"k": "é"}}]}', '$.a[2].x.k="é"'), (-7, "", ""),
]


def keys_at_any_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Every document inside three objects of different depth."""
    one = F.struct(F.struct(F.col("lang").alias("k")).alias("b"))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("id").alias("k")).alias("b")), F.struct(F.struct(F.length("text").cast("long").alias("k")).alias("b"))).alias("a"), F.array(F.array(one)).alias("z"), F.col("lang").alias("k")))
    d = _docs(spark, sf).select("id", raw.alias("raw")).unionByName(spark.createDataFrame([r[:2] for r in NESTED], "id long, raw string").coalesce(1))
    found = payload.find_keys(F.col("raw"), "k")
    return d.select("id", F.array_join(F.transform(found, lambda m: F.concat(m["path"], F.lit("="), m["value"])), " ").alias("found"))


#: id, blocks as JSON, HTML, Markdown: by hand.
DRAFTS = [
    (-1, '{"blocks": [{"text": "abcdef", "inlineStyleRanges": [{"offset": 0, "length": 4, "style": "Bold"}, {"offset": 2, "length": 4, "style": "ITALIC"}]}]}', "<h3>ab<em>cd</em></strong><em>ef</em></h3>", "### ab*cd****ef*"),
    (-2, '{"blocks": [{"text": "😀 link & <b>", "entityRanges": [{"offset": 3, "length": 4, "key": 0}]}], "entityMap": [{"key": "0", "value": {"data": {"url": "https://e.example/"}}}]}', '<p>😀 <a href="https://e.example/" target="_blank" rel="noopener noreferrer">link</a> &amp; &lt;b&gt;</p>', "😀 [link](https://e.example/) & <b>"),
    (-3, '{"blocks": [{"type": "header-one", "text": "T"}, {"text": "  "}, {"type": "unordered-list-item", "text": "u"}, {"type": "ordered-list-item", "text": "o"}, {"type": "blockquote", "text": "q"}, {"type": "code-block", "text": "a<b"}, {"type": "header-2", "text": "S"}]}', "<h2>T</h2>\n<li>u</li>\n<li>o</li>\n<blockquote><p>q</p></blockquote>\n<pre><code>a&lt;b</code></pre>\n<h3>S</h3>", "## T\n\n- u\n\n1. o\n\n> q\n\n```\na<b\n```\n\n### S"),
    (-4, '{"blocks": [{"text": "one two three four five six", "inlineStyleRanges": [{"offset": 4, "length": 3, "style": "BOLD"}], "entityRanges": [{"offset": 0, "length": 13, "key": "a"}, {"offset": 8, "length": 10, "key": "b"}]}], "entityMap": {"a": {"data": {"url": "u1"}}, "b": {"data": {"url": "u2"}}}}', '<p><a href="u1" target="_blank" rel="noopener noreferrer">one <strong>two</strong> </a><a href="u2" target="_blank" rel="noopener noreferrer">three four</a> five six</p>', "[one **two** ](u1)[three four](u2) five six"),
    (-5, '{"blocks": []}', "", ""), (-6, "no json", None, None), (-7, None, None, None),
]


def draft_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a block with overlapping ranges, after a heading."""
    ranges = F.array(*[F.struct(F.lit(a).alias("offset"), F.lit(n).alias("length"), F.lit(s).alias("style")) for a, n, s in ((0, 4, "BOLD"), (2, 4, "ITALIC"))])
    blocks = F.array(F.struct(F.lit("header-one").alias("type"), F.lit("Head").alias("text"), F.array_except(ranges, ranges).alias("inlineStyleRanges")), F.struct(F.lit("unstyled").alias("type"), F.concat(F.lit("123456"), "text").alias("text"), ranges.alias("inlineStyleRanges")))
    d = _docs(spark, sf).select("id", F.to_json(F.struct(blocks.alias("blocks"))).alias("raw")).unionByName(spark.createDataFrame([r[:2] for r in DRAFTS], "id long, raw string").coalesce(1))
    d = d.withColumn("a", payload.draft_article(F.col("raw")))
    return d.select("id", F.sha2("a.html", 256).alias("html_sha256"), F.sha2("a.markdown", 256).alias("markdown_sha256"), F.col("a.words").alias("words"))


#: id, page, HTML: by hand.
STATES = [
    (-1, '<script>x={content_state:$R[5]={blocks:$R[6]=[$R[7]={key:"a",text:"One \\"q\\" {text:}",type:"unstyled",inline_style_ranges:$R[8]=[$R[9]={offset:0,length:3,style:$R[10]="Bold"}],ok:!0},$R[11]={text:"Two",type:"header-one",inlineStyleRanges:[{offset:0,length:1,style:$R[10]}]}],entity_map:$R[12]=[]},y:1}</script>', '<p><strong>One</strong> "q" {text:}</p>\n<h2><strong>T</strong>wo</h2>'),
    (-2, "<script>content_state:$R[5]={blocks:[{text:\"cut", None), (-3, "<p>none</p>", None),
]


def content_states(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as two blocks of a page's script."""
    quoted = F.get_json_object(F.to_json(F.struct(F.array(F.to_json(F.struct("text"))).alias("x"))), "$.x[0]")
    text = F.regexp_replace(quoted, r'^\{"text":|\}\z', "")
    raw = F.concat(F.lit("<html><script>$R[1]={a:1,content_state:$R[2]={blocks:$R[3]=[$R[4]={text:"), text, F.lit(',type:"unstyled"},$R[5]={type:"header-one",text:"End"}],entity_map:[]},b:"}"}</script></html>'))
    d = _docs(spark, sf).select("id", raw.alias("raw")).unionByName(spark.createDataFrame([r[:2] for r in STATES], "id long, raw string").coalesce(1))
    a = payload.content_state_article(F.col("raw"))
    d = d.withColumn("a", a)
    return d.select("id", F.sha2(F.when(F.col("id") >= 0, F.col("a.text")).otherwise(F.col("a.html")), 256).alias("sha256"))


#: id, embed, page, rule, link: rule k hits and those before it miss.
VIDEOS = [
    (-1, r'{\"video_url\":\"https:\/\/v.example\/1.mp4?a=1&b=2\"}', '"video_url":"https://v.example/no.mp4"', 1, "https://v.example/1.mp4?a=1&b=2"),
    (-2, r'<a href="https:\/\/v.example\/2.mp4?x">', '"video_url":"https://v.example/no.mp4"', 2, "https://v.example/2.mp4?x"),
    (-3, "none", '"video_versions":[{"type":1,"url":"https://v.example/3.mp4"}] "video_url":"https://v.example/no"', 3, "https://v.example/3.mp4"),
    (-4, "", '"video_url":"https://v.example/4" "url":"https://v.example/no.mp4"', 4, "https://v.example/4"),
    (-5, None, r'"url":"https:\/\/v.example\/5.mp4?q" ', 5, "https://v.example/5.mp4?q"),
    (-6, None, r"https:\/\/v.example\/x_audio.mp4 https:\/\/v.example\/6.mp4", 6, "https://v.example/6.mp4"), (-7, None, "https://v.example/x_audio.mp4", None, None), (-8, None, None, None, None),
]
#: id, page, text, likes, comments, shares.
COUNTS = [
    (-11, '"reaction_count": {"count": 12} "like_count": 3 "comment_count":{"total_count":4} "i18n_share_count":"5"', "9 likes", 12, 4, 5), (-12, '"reaction_count":7 "total_comment_count":8', "1.5K shares", 7, 8, 1500),
    (-13, '"like_count":0', "2,300 reactions, 4 comments", 2300, 4, 0), (-14, "", "nothing", None, None, None), (-15, '"comments":{"total_count":1}"comment_count":{"total_count":2}', None, 0, 1, 0),
]


def script_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Whole pages, which hold no such scripts, with the number of their page as a count put after them, and the literal rows."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("embed"), F.concat("html", F.lit('"reaction_count":'), F.col("page_id") + 1).alias("page"), F.lit(None).cast("string").alias("text"))
    a = spark.createDataFrame([(*r[:3], None) for r in VIDEOS], "id long, embed string, page string, text string").coalesce(1)
    b = spark.createDataFrame([(r[0], None, r[1], r[2]) for r in COUNTS], "id long, embed string, page string, text string").coalesce(1)
    d = pages.unionByName(a).unionByName(b).withColumn("v", payload.video_link(F.col("embed"), F.col("page"))).withColumn("m", payload.script_counts(F.col("page"), F.col("text")))
    return d.select("id", "v.rule", "v.url", *[F.col("m")[k].cast("long").alias(k) for k in payload.COUNT_RULES])


def _ld(*items: str) -> str:
    return "".join(f'<script type="application/ld+json">{x}</script>' for x in items)


#: id, page, headline, author, avatar, published, description, images, video, reactions, comments, reposts, flags: a row a type, by hand.
JSON_LD = [
    (-1, _ld('{"@type":"SocialMediaPosting","author":{"name":"Ann","image":{"url":"a.png"}},"datePublished":"2026-01-01","articleBody":"Body","commentCount":3,"image":"i.png","interactionStatistic":[{"interactionType":"http://schema.org/LikeAction","userInteractionCount":"12"},{"interactionType":"http://schema.org/CommentAction","userInteractionCount":4}]}'), None, "Ann", "a.png", "2026-01-01", "Body", "i.png", None, 12, 4, 0, ""),
    (-2, _ld('{"@type":"VideoObject","creator":{"name":"Bo","image":"b.png"},"uploadDate":"2026-02-02","description":"D","text":"T","contentUrl":"v.mp4","thumbnailUrl":"t.png"}'), None, "Bo", "b.png", "2026-02-02", "D", "t.png", "v.mp4", 0, 0, 0, ""),
    (-3, _ld('{"@type":"Article","headline":" Head ","image":["x.png",{"url":"y.png"},{"contentUrl":"z.png"}]}'), "Head", None, None, None, None, "x.png,y.png,z.png", None, 0, 0, 0, "article"),
    (-4, _ld('{"@type":"BlogPosting","headline":"Blog","text":"T"}', '{"@type":"Organization","name":"no"}'), "Blog", None, None, None, "T", "", None, 0, 0, 0, "article"),
    (-5, _ld('{"@type":"CollectionPage","name":"Topic","headline":"no","author":{"name":"no"}}'), "Topic", None, None, None, None, "", None, 0, 0, 0, "topic"),
    (-6, _ld('{"@type":"NewsArticle","headline":"News","interactionStatistic":[{"interactionType":"ShareAction","userInteractionCount":"7 or so"},{"interactionType":"ReactAction"}]}'), "News", None, None, None, None, "", None, 0, 0, 7, "news"),
    (-7, _ld('{"@type":"Periodical","name":"Letter"}'), "Letter", None, None, None, None, "", None, 0, 0, 0, "newsletter"), (-8, _ld('{"@type":"Series","name":"Row"}'), "Row", None, None, None, None, "", None, 0, 0, 0, "newsletter"),
    (-9, _ld('{"@type":"DiscussionForumPosting","author":{"name":"One"},"text":"first"}', "{broken", '{"@type":"Article","author":{"name":"Two"},"commentCount":"5"}'), None, "Two", None, None, "first", "", None, 0, 0, 0, "article"),
]


def linkedin_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with its number in a post's JSON-LD, and a literal row a type."""
    post = F.format_string('<script type="application/ld+json">{"@type":"Article","headline":"Page %d","commentCount":%d,"author":{"name":"A"}}</script>', "page_id", F.col("page_id") + 1)
    d = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.concat("html", post).alias("html")).unionByName(spark.createDataFrame([r[:2] for r in JSON_LD], "id long, html string").coalesce(1))
    d = d.withColumn("p", payload.linkedin_json_ld(F.col("html")))
    flags = F.concat_ws(",", *[F.when(F.col(f"p.is_{k}"), k) for k in ("article", "topic", "news", "newsletter")])
    return d.select("id", *[F.col(f"p.{c}").alias(c) for c in ("headline", "author", "avatar", "published", "description", "video", "reactions", "comments", "reposts")], F.array_join("p.images", ",").alias("images"), flags.alias("flags"))


def tier_escalation(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a post of which every third lacks the author and every fourth the text; every other one has an embedded view with the author, all have a rendered page."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    text = lambda a: F.format_string(f"{a}%d", "id")
    records = o.select("id", F.when(F.col("id") % 3 != 0, text("a")).alias("author"), F.when(F.col("id") % 4 != 0, text("d")).alias("description"))
    embeds = o.where("id % 2 = 0").select("id", text("e").alias("author"), F.lit(None).cast("string").alias("description"))
    pages = o.select("id", text("r").alias("author"), text("t").alias("description"))
    lacks = reddit_lacks_key_data(F.lit("title"), F.col("author"), F.col("description"), F.lit(False), F.lit(0), F.lit(False))
    d = escalated(records, "id", ["author", "description"], [("embed", embeds, lacks), ("rendered", pages, lacks)])
    return d.select("id", "author", "author_from", "description", "description_from", F.array_join("read", ",").alias("read"))


_T = "coalesce(text, '')"
_ESC = lambda x: f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_BLANK = "regexp_matches(coalesce(text, ''), '^\\s*$')"
SQL = {
    "carousels": f"""SELECT doc_id AS id, 2::BIGINT AS items, sha256({_T}) AS text_sha256, 'image,image' AS types, 'https://c.example/' || doc_id || ',https://c.example/' || doc_id AS urls FROM documents
UNION ALL SELECT id, items, NULL, types, urls FROM {values([(r[0], n, r[2], r[3]) for r, n in zip(EMBEDS, (2, 1, 1, 1, 0, 0, 0, 2), strict=True)], 'id, items, types, urls')}""",
    "keys_at_any_depth": f"""SELECT doc_id AS id, '$.k="' || coalesce(lang, '') || '" $.a[0].b.k=' || doc_id || ' $.a[1].b.k=' || length({_T}) || ' $.z[0][0].b.k="' || coalesce(lang, '') || '"' AS found FROM documents
UNION ALL SELECT * FROM {values([(r[0], r[2]) for r in NESTED], 'id, found')}""",
    "draft_articles": f"""SELECT doc_id AS id, sha256('<h2>Head</h2>' || chr(10) || '<p><strong>12<em>34</em></strong><em>56</em>' || {_ESC(_T)} || '</p>') AS html_sha256,
 sha256('## Head' || chr(10) || chr(10) || '**12*34****56*' || {_T}) AS markdown_sha256, 1 + len(list_filter(regexp_split_to_array('123456' || {_T}, '\\s+'), lambda w: w <> '')) AS words FROM documents
UNION ALL SELECT id, sha256(html), sha256(md), words FROM {values([(*r[:1], *r[2:], n) for r, n in zip(DRAFTS, (1, 4, 6, 6, 0, None, None), strict=True)], 'id, html, md, words')}""",
    "content_states": f"""SELECT doc_id AS id, sha256(CASE WHEN {_BLANK} THEN 'End' ELSE {_T} || chr(10) || chr(10) || 'End' END) AS sha256 FROM documents UNION ALL SELECT id, sha256(html) FROM {values([(r[0], r[2]) for r in STATES], 'id, html')}""",
    "script_rules": f"""SELECT page_id AS id, NULL::INT AS rule, NULL::VARCHAR AS url, page_id + 1 AS likes, 0::BIGINT AS comments, 0::BIGINT AS shares FROM pages
UNION ALL SELECT id, rule, url, NULL, NULL, NULL FROM {values([(r[0], r[3], r[4]) for r in VIDEOS], 'id, rule, url')}
UNION ALL SELECT id, NULL, NULL, likes, comments, shares FROM {values([(r[0], *r[3:]) for r in COUNTS], 'id, likes, comments, shares')}""",
    "linkedin_posts": f"""SELECT page_id AS id, 'Page ' || page_id AS headline, 'A' AS author, NULL::VARCHAR AS avatar, NULL::VARCHAR AS published, NULL::VARCHAR AS description, NULL::VARCHAR AS video, 0::BIGINT AS reactions, page_id + 1 AS comments, 0::BIGINT AS reposts, '' AS images, 'article' AS flags FROM pages
UNION ALL SELECT id, headline, author, avatar, published, description, video, reactions, comments, reposts, images, flags FROM {values([(r[0], *r[2:]) for r in JSON_LD], 'id, headline, author, avatar, published, description, images, video, reactions, comments, reposts, flags')}""",
    "tier_escalation": """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS own, o_orderkey % 4 <> 0 AS told, o_orderkey % 2 = 0 AS embed FROM orders)
SELECT id, CASE WHEN own THEN 'a' WHEN embed THEN 'e' ELSE 'r' END || id AS author, CASE WHEN own THEN 'given' WHEN embed THEN 'embed' ELSE 'rendered' END AS author_from,
 CASE WHEN told THEN 'd' ELSE 't' END || id AS description, CASE WHEN told THEN 'given' ELSE 'rendered' END AS description_from,
 CASE WHEN own AND told THEN '' WHEN told AND embed THEN 'embed' ELSE 'embed,rendered' END AS read FROM a""",
}
QUERIES = {f.__name__: f for f in (carousels, keys_at_any_depth, draft_articles, content_states, script_rules, linkedin_posts, tier_escalation)}
