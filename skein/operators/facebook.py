"""Posts of Facebook pages (EX5): stored answers of the crawler's page and of the mobile page to one record a post.

Defined cases: null and empty pages give a record without text and media whose author is named by the link; keys must be unique; looking up
avatars by `account` and the direct links of images is left to joins with stored answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import html, payload, posts
from skein.functions.classify import is_reel
from skein.functions.strings import group, has_any
from skein.functions.text import clean_description
from skein.operators import dom

#: Fixed values.
OG_VIDEO = ["property=og:video", "property=og:video:secure_url", "property=og:video:url"]
MOST_IMAGES = 6


def post_images(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """key, shown (the link of the image that the page shows large), images (distinct, in order): those that are a post's own and stand
    in no comment, other article or form. Keys without any have no row."""
    label = F.lower(F.col("attrs")["aria-label"])
    bad = (F.col("role") == "article") | label.contains("comment") | (F.col("tag") == "form")
    inside = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    src = F.col("attrs")["src"]
    marked = nodes.withColumn("reach", F.max(F.when(F.coalesce(bad, F.lit(False)), F.col("last"))).over(inside))
    large = F.col("attrs")["data-visualcompletion"] == "media-vc-image"
    d = marked.where((F.col("tag") == "img") & posts.facebook_post_image(src)).select(key, "node", src.alias("src"), F.coalesce(large, F.lit(False)).alias("large"), (F.coalesce("reach", F.lit(0)) < F.col("node")).alias("free"))
    d = d.groupBy(key, "src").agg(F.min(F.when(F.col("free"), F.col("node"))).alias("at"), F.min(F.when(F.col("large"), F.col("node"))).alias("shown_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "src")))), lambda x: x["src"])
    return d.groupBy(key).agg(F.min_by("src", "shown_at").alias("shown"), listed.alias("images"))


def _distinct_media(links: Column) -> Column:
    """Without later ones of the same media id, the first MOST_IMAGES; the stand-ins of the crawler go where there is a direct link."""
    media_id = lambda u: F.coalesce(group(u, "(?i)media_id=([0-9]+)"), group(u, "(?i)fbid=([0-9]+)"))
    known = F.transform(links, lambda u: F.struct(u.alias("u"), media_id(u).alias("id")))
    first = F.filter(known, lambda x: x["id"].isNull() | (x["u"] == F.element_at(F.filter(known, lambda y: y["id"] == x["id"]), 1)["u"]))
    some = F.slice(F.transform(first, lambda x: x["u"]), 1, MOST_IMAGES)
    direct = F.exists(some, lambda u: has_any(u, "scontent", "fbcdn.net"))
    return F.when(direct, F.filter(some, lambda u: ~u.contains("lookaside.fbsbx.com"))).otherwise(some)


def post_records(pages: DataFrame, images: DataFrame, key: str = "page_id") -> DataFrame:
    """EX5: a record for each row of pages (key, url, final_url, crawler, mobile), with the images of post_images() of the crawler's page."""
    d = pages.join(images, key, "left")
    d = d.withColumns({"m": html.metas(F.col("mobile")), "c": html.metas(F.col("crawler")), "link": F.coalesce("final_url", "url")})
    of = lambda where, *names: html.meta(F.col(where), *names)
    sound = F.filter(F.regexp_extract_all("mobile", F.lit(r"(?i)https:[^\"'\s\\]+?\.mp4[^\"'\s\\]*"), F.lit(0)), lambda u: ~has_any(u, *payload.SOUND_ONLY))
    title = F.coalesce(of("m", "property=og:title"), html.element_text(F.col("mobile"), "title"), of("c", "property=og:title", "name=twitter:title"), html.element_text(F.col("crawler"), "title"))
    said = F.coalesce(of("m", "property=og:description"), of("c", "property=og:description", "name=description"))
    image = F.coalesce(of("m", "property=og:image", "property=og:image:secure_url"), of("c", "property=og:image", "property=og:image:secure_url", "name=twitter:image"))
    d = d.withColumns({"title": title, "said": said, "image": F.coalesce(F.replace("shown", F.lit("&amp;"), F.lit("&")), image), "video": F.coalesce(of("m", *OG_VIDEO), F.try_element_at(sound, F.lit(1)))})
    d = d.withColumns({"author": F.coalesce(of("c", "name=author", "property=article:author"), posts.facebook_author(F.col("title"), F.col("link"), F.col("crawler"))), "told": posts.longest_text(F.col("crawler"), F.col("said"))})
    text = F.when(F.length("told") > F.coalesce(F.length("said"), F.lit(0)), F.col("told")).otherwise(F.col("said"))
    own = F.when(posts.facebook_post_image(F.col("image")), F.array("image")).otherwise(F.array().cast("array<string>"))
    is_video = is_reel(F.col("url")) & F.col("video").isNotNull()
    pictures = _distinct_media(F.array_distinct(F.concat(own, F.coalesce("images", F.array().cast("array<string>")))))
    media = F.when(is_video, F.array(F.struct(F.lit("video").alias("type"), F.replace("video", F.lit("&amp;"), F.lit("&")).alias("url")))).otherwise(F.transform(pictures, lambda u: F.struct(F.lit("image").alias("type"), u.alias("url"))))
    return d.select(
        key, "author", posts.facebook_account(F.col("link"), F.col("crawler"), F.col("author")).alias("account"), F.coalesce(clean_description(text), F.lit("")).alias("description"), media.alias("media"),
        F.when(is_video, F.col("image")).alias("video_thumbnail"), payload.script_counts(F.col("crawler"), F.concat_ws(" ", "title", "said")).alias("metrics"), posts.facebook_verified(F.col("crawler")).alias("verified"),
        of("c", "property=article:published_time", "name=pubdate").alias("posted_at"),
    )


def post_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """EX5 from stored pages alone."""
    return post_records(pages, post_images(dom.nodes(pages, key, "crawler"), key), key)
