"""Queries over what platforms' pages say of posts; literal rows have results worked out by hand, rows made of whole tables have SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import posts
from skein.operators import facebook
from skein.plans.sql import values
from skein.sources.tables import table

_P = "https://www.facebook.com/"
#: id, title, link, page, author, account: a row a rule.
AUTHORS = [
    (-1, "x | Facebook", _P + "a.b/posts/1", '{"video_owner": {"id":"7","name" : "Zo\\u00eb \\ud83d\\ude00 "}, "owner":{"name":"No","id":"77"}}', "Zoë 😀", "77"), (-2, None, _P + "a/posts/1", '"owner":{"name":"12K views"},"actors":[{"name":"Late","id":"5"}]', "A", "5"),
    (-3, "814K views · 6.8K reactions | On being glad | Jay S | Facebook", _P + "reel/1", "", "Jay S", "JayS"), (-4, "Ann Lee · A video", None, None, "Ann Lee", "AnnLee"), (-5, "Bo Ek - Clip - Two", None, None, "Bo Ek", "BoEk"),
    (-6, "3 views | By Cy Dow", None, None, "Cy Dow", "CyDow"), (-7, "Di on Facebook: hello", None, None, "Di", "Di"), (-8, "Ed's Reel", None, None, "Ed", "Ed"), (-9, "Fay Reels", None, None, "Fay", "Fay"), (-10, " We Thought ", None, None, "We Thought", "WeThought"),
    (-11, "Log in or sign up to view", _P + "river.side-club/photos/2", "", "River Side Club", "river.side-club"), (-12, "Log into Facebook", _P + "share/posts/2", "", "Facebook User", None), (-13, None, _P + "people/Gus-Po/100123/", None, "Facebook User", "100123"),
    (-14, None, None, '"permalink_url":"https:\\/\\/www.facebook.com\\/hub\\/videos"', "Facebook User", "hub"), (-15, None, None, '"actors":[{"url":"https:\\/\\/www.facebook.com\\/people\\/Hal\\/99\\/"}]', "Facebook User", "99"),
]


def facebook_authors(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a post whose author is named by link, title or script in turn."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        i.alias("id"), F.when(i % 3 == 1, F.format_string("%d views | A talk | Ann %d | Facebook", i, i)).alias("title"), F.format_string(f"{_P}some.page-%d/videos/1", i).alias("link"),
        F.concat(F.coalesce("text", F.lit("")), F.when(i % 3 == 2, F.format_string('"owner":{"id":"%d","name":"Bo %d"}', i, i)).otherwise("")).alias("page"),
    )
    d = d.unionByName(spark.createDataFrame([r[:4] for r in AUTHORS], "id long, title string, link string, page string").coalesce(1))
    d = d.withColumn("author", posts.facebook_author(F.col("title"), F.col("link"), F.col("page")))
    return d.select("id", "author", posts.facebook_account(F.col("link"), F.col("page"), F.col("author")).alias("account"))


_A, _B, _C = "a" * 60, "b" * 70, "c" * 80
#: id, page, description, text.
TEXTS = [
    (-1, f'"message":{{"x":1,"text":"{_A}"}} "text":"{_B}"', None, _B), (-2, f'"message":{{"text":"{_A}"}} "text":"{_B}"', "aaa\naa", _B), (-3, f'"message":{{"text":"{_A}"}} "text":"{_B}"', "a" * 40, _A), (-4, f'"text":"{_B} Related Videos" "text":"{_A}"', None, _A),
    (-5, '"text":"short"', None, None), (-6, f'"text":"{_A}\\n\\"q\\"\\t\\u00e9\\r!"', "", f'{_A}\n"q" é!'), (-7, None, "d", None), (-8, f'"text":"{_A}" "text":"{"b" * 60}"', "zz", _A), (-9, f'"message":{{"text":"{"m" * 49}"}} "text":"cut {_C}', None, None),
]


def longest_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text within a page's script, behind a shorter one."""
    said = F.to_json(F.struct(F.concat(F.lit(_A + " "), F.coalesce("text", F.lit(""))).alias("text")))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit(f'"message":{{"text":"{"s" * 55}"}} '), said).alias("page"), F.lit(None).cast("string").alias("said"))
    d = d.unionByName(spark.createDataFrame([r[:3] for r in TEXTS], "id long, page string, said string").coalesce(1))
    return d.select("id", F.sha2(posts.longest_text(F.col("page"), F.col("said")), 256).alias("text_sha256"))


_OTHER = '{"username":"zed","is_verified":true}'
_FAR = " " * 301
#: id, page, user, full name, Instagram, Facebook, X.
BADGES = [
    (-1, '{"username":"ann","id":1,"is_verified":true}', "ann", None, True, True, False), (-2, f'{{"username":"ann","is_verified":false}},{_OTHER}', "ann", None, False, True, False), (-3, '{"is_verified":true,"n":2,"username":"Ann"}', "ann", None, True, True, False),
    (-4, f'{{"username":"ann"{_FAR}"is_verified":true}}', "ann", None, False, True, False), (-5, '{"full_name":"Ann (B+)","x":0,"is_verified": true}', "unknown", "Ann (B+)", True, False, False), (-6, f'{{"full_name":"Ann"{" " * 151}"is_verified":true}}', None, "Ann", False, True, False),
    (-7, '{"is_verified":true,"__typename":"User"}', "unknown", "Instagram User", True, True, False), (-8, '{"is_verified":true,"__typename":"User"}', "ann", None, False, True, False), (-9, '{\\"username\\":\\"ann\\",\\"is_verified\\":true}', "ann", None, True, False, False),
    (-10, '<svg viewBox="0" aria-label="Verified account"></svg>', None, None, False, True, True), (-11, '"is_blue_verified":true', "ann", None, False, False, True), (-12, None, "ann", "Ann", False, False, False), (-13, "", None, None, False, False, False),
    (-14, f'{_OTHER}{{"username":"ann"}}{_OTHER}', "ann", None, False, True, False),
]


def verified_badges(spark: SparkSession, sf: str) -> DataFrame:
    """Every page with a user of whom every third has a badge, and another one's badge behind."""
    i = F.col("page_id")
    own = F.format_string('{"username":"u%d","is_verified":%s},', i, (i % 3 == 0).cast("string"))
    d = table(spark, sf, "pages").select(i.alias("id"), F.concat("html", own, F.lit(_OTHER)).alias("page"), F.format_string("u%d", i).alias("user"), F.lit(None).cast("string").alias("name"))
    d = d.unionByName(spark.createDataFrame([r[:4] for r in BADGES], "id long, page string, user string, name string").coalesce(1))
    return d.select("id", posts.instagram_verified(F.col("page"), F.col("user"), F.col("name")).alias("instagram"), posts.facebook_verified(F.col("page")).alias("facebook"), posts.x_verified(F.col("page")).alias("x"))


#: id, link, known avatar; Facebook post, Reddit post, Instagram avatar, LinkedIn ghost, not of a LinkedIn post.
IMAGES = [
    (-1, "https://scontent.x.fbcdn.net/v/t39.30808-6/1.JPG?x=1", None, True, True, False, False, False), (-2, "https://scontent.x.fbcdn.net/v/t39.30808-1/1.jpg", None, False, True, False, False, False), (-3, "https://www.facebook.com/photo.jpg", None, False, True, False, False, False),
    (-4, "https://lookaside.fbsbx.com/lookaside/crawler/media/?media_id=1", None, True, False, False, False, False), (-5, "https://i.redd.it/abc", None, False, True, False, False, False), (-6, "https://www.reddit.com/gallery/a.png", None, True, False, False, False, False),
    (-7, "https://cdn.example/a.png?s=1", "https://cdn.example/a.png?s=2", True, True, True, False, False), (-8, "https://cdn.example/s150x150/a.png", "", True, True, True, False, False), (-9, "https://static.licdn.com/aero-v1/x", None, False, False, False, True, True),
    (-10, "https://media.licdn.com/profile-displayphoto/a", None, False, False, False, False, True), (-11, "", None, False, False, True, True, True), (-12, None, "https://a.example/x", False, False, True, True, True), (-13, "data:image/png;base64,a.png", None, False, True, False, False, False),
    (-14, "https://scontent.example/static/emoji.png", None, False, True, False, False, False), (-15, "https://v.redd.it/x/a.mp4", None, False, False, False, False, False),
]


def post_image_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text as a picture's link of a known address in turn."""
    i = F.col("doc_id")
    d = table(spark, sf, "documents").select(i.alias("id"), F.format_string("https://%s/v/%d.jpg", F.element_at(F.array(*map(F.lit, ("scontent.example", "i.redd.it", "cdn.example/s320x320", "x.example/ghost_person"))), (i % 4 + 1).cast("int")), i).alias("link"), F.lit(None).cast("string").alias("known"))
    d = d.unionByName(spark.createDataFrame([r[:3] for r in IMAGES], "id long, link string, known string").coalesce(1))
    u = F.col("link")
    return d.select("id", posts.facebook_post_image(u).alias("facebook"), posts.reddit_post_image(u).alias("reddit"), posts.instagram_avatar(u, F.col("known")).alias("avatar"), posts.linkedin_ghost(u).alias("ghost"), posts.linkedin_not_post(u).alias("not_post"))


_UI = "https://ui-avatars.com/api/?name={}&background=0a66c2&color=fff&size=200&bold=true"
#: id, name, avatar, link, hub; author, avatar.
MEMBERS = [
    (-1, "Ann Lee", "https://a.example/a.png", None, "", "Ann Lee", "https://a.example/a.png"), (-2, None, "https://a.example/a.png", None, "topic", "LinkedIn Top Content", _UI.format("LinkedIn%20Top%20Content")), (-3, "LinkedIn User", None, "https://www.linkedin.com/posts/jane-doe_topic-activity-1", "", "Jane Doe", _UI.format("Jane%20Doe")),
    (-4, "", "https://x.example/ghost_person", None, "article", "LinkedIn Author", _UI.format("LinkedIn%20Author")), (-5, "Zoë (B)'s ~!", None, None, "news", "Zoë (B)'s ~!", _UI.format("Zo%C3%AB%20(B)'s%20~!")), (-6, None, None, None, "", "LinkedIn Member", _UI.format("LinkedIn%20Member")),
]
#: id, user, media, description, restricted.
LIMITED = [(-1, "unknown", 0, " ", True), (-2, None, None, None, True), (-3, "ann", 0, None, False), (-4, "", 0, "This is Restricted", True), (-5, "", 0, "A day", False), (-6, "unknown", 1, None, False)]
#: id, player, video.
_V = '{{"source":{{"url":"{}","dimensions":{{"height":{}}}}}}}'
PLAYERS = [
    (-1, '{"playbackMp4s":{"permutations":[' + ",".join([_V.format("a", 240), _V.format("b", 720), _V.format("c", 720)]) + "]}}", "b"), (-2, '{"playbackMp4s":{"permutations":[{"source":{"url":"d"}}]}}', "d"), (-3, '{"playbackMp4s":{"permutations":[]}}', None), (-4, "{", None), (-5, None, None),
]


def member_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P21, CF13 and A5: every document as the post of a member without a name, as an unknown user's text and as a player with videos of two sizes."""
    i = F.col("doc_id")
    docs = table(spark, sf, "documents")
    none = F.lit(None).cast("string")
    m = docs.select(i.alias("id"), none.alias("name"), none.alias("avatar"), F.format_string("https://www.linkedin.com/posts/mia-%d_x", i).alias("link"), F.lit("").alias("hub"))
    m = m.unionByName(spark.createDataFrame([r[:5] for r in MEMBERS], "id long, name string, avatar string, link string, hub string").coalesce(1))
    hub = lambda k: F.col("hub") == k
    m = m.select(F.lit("member").alias("rule"), "id", posts.linkedin_author(F.col("name"), F.col("avatar"), F.col("link"), hub("topic"), hub("news"), hub("newsletter"), hub("article")).alias("r")).select("rule", "id", F.concat_ws("|", "r.author", "r.avatar").alias("result"))
    r = docs.select(i.alias("id"), F.lit("unknown").alias("user"), F.lit(0).alias("media"), F.col("text").alias("said")).unionByName(spark.createDataFrame([x[:4] for x in LIMITED], "id long, user string, media int, said string").coalesce(1))
    r = r.select(F.lit("restricted").alias("rule"), "id", posts.restricted(F.col("user"), F.col("media"), F.col("said")).cast("string").alias("result"))
    p = docs.select(i.alias("id"), F.format_string('{"playbackMp4s":{"permutations":[' + _V.format("low%d", 240).replace("240", "%d") + "," + _V.format("mid%d", 480) + "]}}", i, i % 1000, i).alias("player"))
    p = p.unionByName(spark.createDataFrame([x[:2] for x in PLAYERS], "id long, player string").coalesce(1)).select(F.lit("video").alias("rule"), "id", posts.tallest_video(F.col("player")).alias("result"))
    return m.unionByName(r).unionByName(p)


_OG = lambda p, c: f'<meta property="og:{p}" content="{c}">'
_LOOK = "https://lookaside.fbsbx.com/lookaside/crawler/media/?media_id="
#: page_id, link, crawler's page, mobile page; author, account, description, media, video's thumbnail, verified, likes, posted at.
POSTS = [
    (-1, _P + "ann.lee/posts/1", _OG("title", "Ann Lee - Trip | Facebook") + _OG("description", "Cut off") + _OG("image", _LOOK + "7") + f'<img src="{_LOOK}7&amp;x=1"><img src="https://scontent.x/2.jpg"><div role="article"><img src="https://scontent.x/comment.jpg"></div><form><img src="https://scontent.x/form.jpg"></form>'
     f'<script>{{"message":{{"text":"Cut off no more: {_A}"}},"reaction_count":{{"count":12}}}}</script><meta property="article:published_time" content="2026-01-02">',
     None, "Ann Lee", "ann.lee", f"Cut off no more: {_A}", "image https://scontent.x/2.jpg", None, False, 12, "2026-01-02"),
    (-2, _P + "bo/videos/9", '<meta name="author" content="Bo"><title>Verified account</title>', _OG("video", "https://v.example/a.mp4?x=1&amp;y=2") + _OG("image", "https://scontent.x/t.jpg"), "Bo", "bo", "", "video https://v.example/a.mp4?x=1&y=2", "https://scontent.x/t.jpg", True, None, None),
    (-3, _P + "cy/posts/3", f'<img data-visualcompletion="media-vc-image" src="https://scontent.x/big.jpg">{_OG("image", "https://scontent.x/small.jpg")}' + "".join(f'<img src="https://scontent.x/{k}.jpg">' for k in range(8)), None, "Cy", "cy", "", ",".join(["image https://scontent.x/big.jpg", *[f"image https://scontent.x/{k}.jpg" for k in range(5)]]), None, False, None, None),
    (-4, _P + "dee/videos/4", "", '"https://v.example/dash_ln_heaac.mp4" "https://v.example/sd.mp4?z=1"', "Dee", "dee", "", "video https://v.example/sd.mp4?z=1", None, False, None, None), (-5, None, None, None, "Facebook User", None, "", "", None, False, None, None),
]


def facebook_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as the crawler's page of a post with an author, a text, an image and likes of its own."""
    i = F.col("page_id")
    lead = F.format_string('<meta name="author" content="A%d">' + _OG("title", "T") + _OG("description", "D%d") + _OG("image", "https://scontent.x/%d.jpg") + '<script>"like_count":%d</script>', i, i, i, i + 1)
    none = F.lit(None).cast("string")
    d = table(spark, sf, "pages").select(i, F.format_string(f"{_P}p%d/posts/1", i).alias("url"), F.concat(lead, F.regexp_replace("html", "(?i)<img[^>]*>", "")).alias("crawler"), none.alias("mobile"))
    d = d.unionByName(spark.createDataFrame([r[:4] for r in POSTS], "page_id long, url string, crawler string, mobile string").coalesce(1))
    d = facebook.post_pages(d.withColumn("final_url", none))
    media = F.array_join(F.transform("media", lambda m: F.concat_ws(" ", m["type"], m["url"])), ",")
    return d.select("page_id", "author", "account", "description", media.alias("media"), "video_thumbnail", "verified", F.col("metrics")["likes"].cast("long").alias("likes"), "posted_at")


_UI_SQL = _UI.replace("'", "''")
SQL = {
    "facebook_authors": f"""SELECT doc_id AS id, CASE doc_id % 3 WHEN 1 THEN 'Ann ' || doc_id WHEN 2 THEN 'Bo ' || doc_id ELSE 'Some Page ' || doc_id END AS author, CASE WHEN doc_id % 3 = 2 THEN doc_id::VARCHAR ELSE 'some.page-' || doc_id END AS account FROM documents
UNION ALL SELECT * FROM {values([(r[0], r[4], r[5]) for r in AUTHORS], 'id, author, account')}""",
    "longest_texts": f"""SELECT doc_id AS id, sha256(trim('{_A} ' || replace(replace(coalesce(text, ''), chr(13), ''), chr(9), ' '), ' ' || chr(10) || chr(13))) AS text_sha256 FROM documents
UNION ALL SELECT id, sha256(t) FROM {values([(r[0], r[3]) for r in TEXTS], 'id, t')}""",
    "verified_badges": f"""SELECT page_id AS id, page_id % 3 = 0 AS instagram, true AS facebook, false AS x FROM pages UNION ALL SELECT * FROM {values([(r[0], *r[4:]) for r in BADGES], 'id, instagram, facebook, x')}""",
    "post_image_rules": f"""SELECT doc_id AS id, true AS facebook, true AS reddit, doc_id % 4 = 2 AS avatar, doc_id % 4 = 3 AS ghost, doc_id % 4 = 3 AS not_post FROM documents UNION ALL SELECT * FROM {values([(r[0], *r[3:]) for r in IMAGES], 'id, facebook, reddit, avatar, ghost, not_post')}""",
    "member_rules": f"""SELECT 'member' AS rule, doc_id AS id, 'Mia ' || doc_id || '|' || replace('{_UI_SQL}', '{{}}', 'Mia%20' || doc_id) AS result FROM documents
UNION ALL SELECT 'restricted', doc_id, (regexp_matches(coalesce(text, ''), '^\\s*$') OR regexp_matches(text, '(?i)restricted|unavailable'))::VARCHAR FROM documents
UNION ALL SELECT 'video', doc_id, CASE WHEN doc_id % 1000 >= 480 THEN 'low' ELSE 'mid' END || doc_id FROM documents
UNION ALL SELECT 'member', id, a || '|' || b FROM {values([(r[0], *r[5:]) for r in MEMBERS], 'id, a, b')} UNION ALL SELECT 'restricted', id, r::VARCHAR FROM {values([(r[0], r[4]) for r in LIMITED], 'id, r')} UNION ALL SELECT 'video', id, v FROM {values([(r[0], r[2]) for r in PLAYERS], 'id, v')}""",
    "facebook_posts": f"""SELECT page_id, 'A' || page_id AS author, 'p' || page_id AS account, 'D' || page_id AS description, 'image https://scontent.x/' || page_id || '.jpg' AS media, NULL::VARCHAR AS video_thumbnail, false AS verified, page_id + 1 AS likes, NULL::VARCHAR AS posted_at FROM pages
UNION ALL SELECT * FROM {values([(r[0], *r[4:]) for r in POSTS], 'page_id, author, account, description, media, video_thumbnail, verified, likes, posted_at')}""",
}
QUERIES = {f.__name__: f for f in (facebook_authors, longest_texts, verified_badges, post_image_rules, member_rules, facebook_posts)}
