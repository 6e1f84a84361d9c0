"""Records from stored API answers of platforms: a JSON column in, one struct out, all on the JVM. A row whose JSON is missing or
lacks what a record needs gives null, so that tiers can be coalesced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import numeric, text
from skein.functions.strings import first_present, let, present
from skein.functions.url import youtube_id
from skein.operators.library import media_distinct, post_media

MEDIA = "array<struct<type:string,url:string>>"
_PHOTOS = "photos array<struct<url:string>>, videos array<struct<url:string,thumbnail_url:string>>"
STATUS = f"""tweet struct<author:struct<name:string,screen_name:string,avatar_url:string,verified:boolean,verification:struct<verified:boolean>>,text:string,created_at:string,
replies:string,retweets:string,likes:string,views:string,bookmarks:string,media:struct<{_PHOTOS.replace(" array", ":array")}>,quote:struct<media:struct<{_PHOTOS.replace(" array", ":array")}>>,
article:struct<title:string,preview_text:string,cover_media:struct<media_info:struct<original_img_url:string>>>>"""
SUBMISSION = """data array<struct<title:string,selftext:string,author:string,subreddit:string,score:bigint,ups:bigint,num_comments:bigint,url:string,url_overridden_by_dest:string,is_video:boolean,
created_utc:double,thumbnail:string,media:struct<reddit_video:struct<fallback_url:string>>,gallery_data:struct<items:array<struct<media_id:string>>>,
preview:struct<images:array<struct<source:struct<url:string>>>>,sr_detail:struct<community_icon:string,icon_img:string>>>"""
PLAYER = """videoDetails struct<title:string,shortDescription:string,author:string,viewCount:string>,
microformat struct<playerMicroformatRenderer:struct<title:struct<simpleText:string>,description:struct<simpleText:string>,ownerChannelName:string,ownerProfileUrl:string,viewCount:string,likeCount:string,publishDate:string,uploadDate:string>>"""
SYNDICATED = """text string, created_at string, favorite_count string, conversation_count string, photos array<struct<url:string>>,
user struct<name:string,screen_name:string,profile_image_url_https:string,profile_image_url:string,verified:boolean,is_blue_verified:boolean>,
article struct<title:string,preview_text:string,cover_media:struct<media_info:struct<original_img_url:string>>>"""
_EXTENDED = "array<struct<type:string,url:string,thumbnail_url:string>>"
MIRRORED = f"""user_name string, user_screen_name string, user_profile_image_url string, verified boolean, user_verified boolean, text string, date string, replies string, retweets string, likes string,
media_extended {_EXTENDED}, mediaURLs array<string>, qrt struct<media_extended:{_EXTENDED},mediaURLs:array<string>>"""
MANIFEST = "transcribedDocumentUrl string, perResolutions array<struct<width:int,height:int,imageManifestUrl:string>>"
OEMBED = "title string, author_name string, author_url string, html string, thumbnail_url string"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _listed(photos: Column, videos: Column) -> Column:
    """Photos, then videos (a video without a link by its thumbnail)."""
    one = lambda kind, link: F.struct(F.lit(kind).alias("type"), link.alias("url"))
    p = F.transform(F.coalesce(photos, _none("array<struct<url:string>>")), lambda x: one("image", x["url"]))
    v = F.transform(F.coalesce(videos, _none("array<struct<url:string,thumbnail_url:string>>")), lambda x: one("video", first_present(x["url"], x["thumbnail_url"])))
    return F.filter(F.concat(p, v), lambda m: m["url"].isNotNull())


def _some(media: Column) -> Column:
    return F.when(F.size(media) > 0, media)


def status_record(raw: Column, entities: Column | None = None) -> Column:
    """SRC3: a post's record from a status answer. entities: struct(avatar_url, verified) of the author, for what is missing."""

    def run(t: Column) -> Column:
        author, article = t["author"], t["article"]
        name, handle = F.coalesce(present(author["name"]), F.lit("User")), F.concat(F.lit("@"), F.coalesce(present(author["screen_name"]), F.lit("user")))
        cover = article["cover_media"]["media_info"]["original_img_url"]
        covers = F.when(cover.isNotNull(), F.array(F.struct(F.lit("image").alias("type"), cover.alias("url")))).otherwise(_none(MEDIA))
        own = F.concat(covers, _listed(t["media"]["photos"], t["media"]["videos"]))
        media = F.when(F.size(own) > 0, own).otherwise(_listed(t["quote"]["media"]["photos"], t["quote"]["media"]["videos"]))
        is_video = F.exists(media, lambda m: m["type"] == "video")
        thumb = F.coalesce(F.try_element_at(t["media"]["videos"], F.lit(1))["thumbnail_url"], F.try_element_at(t["quote"]["media"]["videos"], F.lit(1))["thumbnail_url"], F.try_element_at(t["media"]["photos"], F.lit(1))["url"])
        counts = {"replies": "replies", "reposts": "retweets", "likes": "likes", "views": "views", "bookmarks": "bookmarks"}
        count = lambda c: F.when(c.isNotNull(), numeric.parse_count_round(c).cast("double"))
        metrics = F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*[count(t[v]) for v in counts.values()]))
        avatar, verified = text.upgrade_avatar(author["avatar_url"]), F.coalesce(author["verification"]["verified"], F.lit(False)) | F.coalesce(author["verified"], F.lit(False))
        if entities is not None:
            avatar, verified = F.coalesce(avatar, entities["avatar_url"]), verified | F.coalesce(entities["verified"], F.lit(False))
        body = present(article["preview_text"])
        return F.struct(
            F.coalesce(text.clean_title(article["title"]), F.concat(name, F.lit(" ("), handle, F.lit(") on X"))).alias("title"),
            F.coalesce(text.clean_description(body), text.clean_post_text(t["text"])).alias("description"), name.alias("author_name"), handle.alias("author_handle"), avatar.alias("avatar_url"), verified.alias("verified"),
            numeric.sanitize_metrics(metrics).alias("metrics"), _some(media).alias("media"), F.when(is_video, thumb).alias("video_thumbnail"),
            F.try_to_timestamp(F.regexp_replace(t["created_at"], r"^[A-Za-z]{3} ([A-Za-z]{3} .*)\z", "$1"), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("posted_at"),
            F.when(article.isNotNull(), F.lit("article")).alias("type"), body.alias("article_content"),
        )

    return let(F.from_json(raw, STATUS)["tweet"], lambda t: F.when(t["author"].isNotNull(), run(t)))


def submission_record(raw: Column) -> Column:
    """SRC8: a post's record from a submission answer."""

    def run(p: Column) -> Column:
        link = first_present(p["url"], p["url_overridden_by_dest"])
        image = F.coalesce(link.rlike(r"(?i)\.(?:jpg|jpeg|png|gif|webp)\z") | link.contains("i.redd.it"), F.lit(False))
        video = F.coalesce(p["is_video"], F.lit(False)) | F.coalesce(link.contains("v.redd.it"), F.lit(False))
        preview = F.replace(F.try_element_at(p["preview"]["images"], F.lit(1))["source"]["url"], F.lit("&amp;"), F.lit("&"))
        thumb = F.when(p["thumbnail"].startswith("http") & ~p["thumbnail"].contains("default") & ~p["thumbnail"].contains("nsfw"), p["thumbnail"])
        one = lambda kind, u: F.array(F.struct(F.lit(kind).alias("type"), u.alias("url")))
        direct = F.when(image, one("image", link)).when(video, one("video", F.coalesce(p["media"]["reddit_video"]["fallback_url"], link))).otherwise(_none(MEDIA))
        items = F.filter(F.coalesce(p["gallery_data"]["items"], _none("array<struct<media_id:string>>")), lambda g: g["media_id"].isNotNull())
        gallery = F.transform(items, lambda g: F.struct(F.lit("image").alias("type"), F.concat(F.lit("https://i.redd.it/"), g["media_id"], F.lit(".jpg")).alias("url")))
        found = F.concat(direct, gallery)
        media = F.when(F.size(found) > 0, media_distinct(found)).when(preview.isNotNull(), one("image", preview)).when(thumb.isNotNull(), one("image", thumb)).otherwise(_none(MEDIA))
        metrics = F.map_from_arrays(F.array(F.lit("upvotes"), F.lit("comments")), F.array(F.coalesce(p["score"], p["ups"], F.lit(0)).cast("double"), F.coalesce(p["num_comments"], F.lit(0)).cast("double")))
        icon = first_present(p["sr_detail"]["community_icon"], p["sr_detail"]["icon_img"])
        return F.struct(
            F.coalesce(text.clean_title(p["title"]), F.lit("Reddit Post")).alias("title"), text.clean_description(p["selftext"]).alias("description"),
            text.reddit_name(p["author"], "u", "u/reddit_user").alias("author"), text.reddit_name(p["subreddit"], "r", "r/reddit").alias("subreddit"),
            F.when(~icon.rlike("default|ui-avatars"), F.substring_index(icon, "?", 1)).alias("icon_url"), numeric.sanitize_metrics(metrics).alias("metrics"), _some(post_media(media)).alias("media"),
            F.when(video, F.coalesce(preview, thumb)).alias("video_thumbnail"), F.timestamp_seconds(p["created_utc"]).alias("posted_at"),
        )

    return let(F.try_element_at(F.from_json(raw, SUBMISSION)["data"], F.lit(1)), lambda p: F.when(present(p["title"]).isNotNull(), run(p)))


def video_record(link: Column, player: Column, oembed: Column, page: Column | None = None) -> Column:
    """SRC6, SRC7, EX7: a video's record from the player's answer, then the embed answer, then the page's own
    metadata (struct with title, description, published_at)."""
    from_page = lambda k: page[k] if page is not None else F.lit(None).cast("string")

    def run(x: Column) -> Column:
        details, micro, embed = x["p"]["videoDetails"], x["p"]["microformat"]["playerMicroformatRenderer"], x["o"]
        vid = youtube_id(link)
        number = lambda c: F.regexp_extract(c, "^([0-9]+)", 1).try_cast("double")
        metrics = F.map_from_arrays(F.array(F.lit("views"), F.lit("likes")), F.array(number(first_present(details["viewCount"], micro["viewCount"])), number(micro["likeCount"])))
        channel = first_present(details["author"], micro["ownerChannelName"], embed["author_name"])
        return F.struct(
            F.coalesce(first_present(details["title"], micro["title"]["simpleText"], embed["title"], from_page("title")), F.lit("YouTube Video")).alias("title"),
            F.coalesce(first_present(micro["description"]["simpleText"], details["shortDescription"], from_page("description")), F.lit("")).alias("description"), channel.alias("channel"),
            first_present(micro["ownerProfileUrl"], F.concat(F.lit("https://www.youtube.com/@"), present(details["author"])), embed["author_url"]).alias("channel_url"), vid.alias("video_id"),
            F.concat(F.lit("https://img.youtube.com/vi/"), vid, F.lit("/maxresdefault.jpg")).alias("video_thumbnail"), numeric.sanitize_metrics(metrics).alias("metrics"),
            first_present(micro["publishDate"], micro["uploadDate"], from_page("published_at")).alias("posted_at"),
        )

    return let(F.struct(F.from_json(player, PLAYER).alias("p"), F.from_json(oembed, OEMBED).alias("o")), run)


def embed_post_record(link: Column, oembed: Column) -> Column:
    """SRC6, DF3: a post's record from an embed answer, whose html holds the text and, in its last anchor, the date."""

    def run(o: Column) -> Column:
        body = F.regexp_extract(o["html"], r"(?is)<p\b[^>]*>(.*?)</p>", 1)
        day = F.regexp_extract(o["html"], r"(?is)<a\b[^>]*>([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})</a>", 1)
        handle = F.concat(F.lit("@"), F.nullif(F.regexp_extract(F.coalesce(o["author_url"], link), r"(?i)(?:x|twitter)\.com/([a-zA-Z0-9_]+)", 1), F.lit("")))
        name = F.coalesce(present(o["author_name"]), F.lit("User"))
        return F.struct(F.concat(name, F.lit(" ("), F.coalesce(handle, F.lit("@user")), F.lit(") on X")).alias("title"), text.clean_post_text(body).alias("description"), name.alias("author_name"), handle.alias("author_handle"), F.try_to_timestamp(day, F.lit("MMMM d, yyyy")).alias("posted_at"))

    return let(F.from_json(oembed, OEMBED), lambda o: F.when(present(o["html"]).isNotNull(), run(o)))


def _counted(**counts: Column) -> Column:
    """Metrics from counts written as text; missing ones are left out."""
    values = [F.when(c.isNotNull(), numeric.parse_count_round(c).cast("double")) for c in counts.values()]
    return numeric.sanitize_metrics(F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*values)))


def _headline(name: Column, handle: Column) -> Column:
    return F.concat(name, F.lit(" ("), handle, F.lit(") on X"))


def _handle(screen_name: Column) -> Column:
    return F.concat(F.lit("@"), F.coalesce(present(screen_name), F.lit("user")))


def syndicated_record(raw: Column) -> Column:
    """SRC4: a post's record from a syndication answer."""

    def run(t: Column) -> Column:
        user, article = t["user"], t["article"]
        name, handle = F.coalesce(present(user["name"]), F.lit("User")), _handle(user["screen_name"])
        cover = article["cover_media"]["media_info"]["original_img_url"]
        links = F.array_distinct(F.array_compact(F.concat(F.array(cover), F.coalesce(F.transform(t["photos"], lambda p: p["url"]), _none("array<string>")))))
        preview = text.clean_description(article["preview_text"])
        return F.struct(
            F.coalesce(text.clean_title(article["title"]), _headline(name, handle)).alias("title"), F.coalesce(preview, text.clean_post_text(t["text"])).alias("description"), name.alias("author_name"), handle.alias("author_handle"),
            text.upgrade_avatar(first_present(user["profile_image_url_https"], user["profile_image_url"])).alias("avatar_url"), (F.coalesce(user["verified"], F.lit(False)) | F.coalesce(user["is_blue_verified"], F.lit(False))).alias("verified"),
            _counted(likes=t["favorite_count"], replies=t["conversation_count"]).alias("metrics"), _some(F.transform(links, lambda u: F.struct(F.lit("image").alias("type"), u.alias("url")))).alias("media"),
            F.try_to_timestamp(t["created_at"]).alias("posted_at"), F.when(article.isNotNull(), F.lit("article")).alias("type"), preview.alias("article_content"),
        )

    return let(F.from_json(raw, SYNDICATED), lambda t: F.when(t["user"].isNotNull(), run(t)))


def mirrored_record(raw: Column) -> Column:
    """SRC5: a post's record from a mirror's answer; a quoted post's media count where the post has none."""

    def media_of(t: Column) -> Column:
        extended = F.transform(F.filter(t["media_extended"], lambda m: m["url"].isNotNull()), lambda m: F.struct(F.when(m["type"].isin("video", "gif"), F.lit("video")).otherwise(F.lit("image")).alias("type"), m["url"].alias("url")))
        return F.coalesce(extended, F.transform(t["mediaURLs"], lambda u: F.struct(F.lit("image").alias("type"), u.alias("url"))), _none(MEDIA))

    def run(t: Column) -> Column:
        name, handle, own = present(t["user_name"]), _handle(t["user_screen_name"]), media_of(t)
        media = F.when(F.size(own) > 0, own).otherwise(media_of(t["qrt"]))
        moving = F.try_element_at(F.filter(F.coalesce(t["media_extended"], t["qrt"]["media_extended"]), lambda m: m["type"].isin("video", "gif")), F.lit(1))
        thumb = F.coalesce(moving["thumbnail_url"], F.try_element_at(t["mediaURLs"], F.lit(1)), F.try_element_at(t["qrt"]["mediaURLs"], F.lit(1)))
        return F.struct(
            _headline(name, handle).alias("title"), text.clean_post_text(t["text"]).alias("description"), name.alias("author_name"), handle.alias("author_handle"), text.upgrade_avatar(t["user_profile_image_url"]).alias("avatar_url"),
            (F.coalesce(t["verified"], F.lit(False)) | F.coalesce(t["user_verified"], F.lit(False))).alias("verified"), _counted(replies=t["replies"], reposts=t["retweets"], likes=t["likes"]).alias("metrics"), _some(media).alias("media"),
            F.when(F.exists(media, lambda m: m["type"] == "video"), thumb).alias("video_thumbnail"), F.try_to_timestamp(F.regexp_replace(t["date"], r"^[A-Za-z]{3} ([A-Za-z]{3} .*)\z", "$1"), F.lit("MMM dd HH:mm:ss Z yyyy")).alias("posted_at"),
        )

    return let(F.from_json(raw, MIRRORED), lambda t: F.when(present(t["user_name"]).isNotNull(), run(t)))


def document_manifest(raw: Column) -> Column:
    """SRC16: struct(pdf_url, pages_url) of a document: slides of 700 to 1000 pixels, else the first wider ones, else the last."""

    def run(m: Column) -> Column:
        every = m["perResolutions"]
        first = lambda test: F.try_element_at(F.filter(every, test), F.lit(1))["imageManifestUrl"]
        return F.struct(m["transcribedDocumentUrl"].alias("pdf_url"), F.coalesce(first(lambda r: r["width"].between(700, 1000)), first(lambda r: r["width"] > 1000), F.try_element_at(every, F.lit(-1))["imageManifestUrl"]).alias("pages_url"))

    return let(F.from_json(raw, MANIFEST), run)


def pin_record(html: Column) -> Column:
    """JF2, TF16: a pin's record from the JSON-LD of its page, by the first item of each kind: videos and postings."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    person = "struct<name:string,alternateName:string,url:string>"
    kind = f"array<struct<`@type`:string,contentUrl:string,embedUrl:string,thumbnailUrl:string,name:string,description:string,uploadDate:string,creator:{person},image:string,headline:string,datePublished:string,author:{person}>>"

    def items(s: Column) -> Column:
        v = F.try_parse_json(s)
        return F.coalesce(F.from_json(F.when(F.schema_of_variant(v).startswith("ARRAY"), s).otherwise(F.concat(F.lit("["), s, F.lit("]"))), kind), _none(kind))

    def run(found: Column) -> Column:
        of = lambda t: F.try_element_at(F.filter(found, lambda i: i["@type"] == t), F.lit(1))
        video, post = of("VideoObject"), of("SocialMediaPosting")
        who = F.coalesce(post["author"], video["creator"])
        clip = first_present(video["contentUrl"], video["embedUrl"])
        return F.struct(
            text.clean_pin_title(first_present(video["name"], post["headline"])).alias("title"), present(video["description"]).alias("description"), first_present(who["name"], who["alternateName"]).alias("author_name"),
            F.nullif(F.regexp_extract(who["url"], r"(?i)pinterest\.[a-z.]+/([^/?]+)", 1), F.lit("")).alias("author_username"), clip.alias("video_url"), present(video["thumbnailUrl"]).alias("video_thumbnail"),
            present(post["image"]).alias("image"), first_present(video["uploadDate"], post["datePublished"]).alias("posted_at"),
        )

    return let(F.flatten(F.transform(scripts, items)), run)
