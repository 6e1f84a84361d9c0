"""Classification of links, pages and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import first_present, has_any, let, present, wide_trim
from skein.functions.text import is_truncated, strip_code_fence
from skein.functions.url import host_of, is_video_url, path_of

# ---- fixed values ----------------------------------------------------------------------------------------------------
KEYWORDS = (
    "celebrity|player|athlete|musician|singer|artist|creator|influencer|streamer|youtuber|founder|ceo|director|politician|movie|film|sports|job|hiring|role"
    "|engineer|developer|tech|design|remote|salaries|career|news"
)
LOGIN_MARKS = ["login • instagram", "welcome back to instagram", "log in to instagram"]
QUOTA_MARKS = ["limit: 20", "generaterequestsperday", "resource_exhausted", "quota exceeded", "429"]
AVATAR_MARKS = ["t51.82787-19", "s100x100", "s150x150", "profile_pic"]
AUTH_PATH = r"/(?:login|signin|signup|auth|account|register|join|session|recover|forgot)"
TOOL_PATH = r"/(?:components|docs|tools|ui|library|resources|templates|icons|cheatsheet|showcase)"
X_RESERVED = [
    "home", "explore", "notifications", "messages", "search", "settings", "i", "hashtag", "login", "signup", "compose", "tos", "privacy", "rules", "help", "intent",
    "share", "account",
]
LINKEDIN_TYPES = {
    "linkedin_topic_collection": ["/top-content/", "/topic/"], "linkedin_news_story": ["/news/"], "linkedin_newsletter": ["/newsletters/", "/newsletter/"], "linkedin_article": ["/pulse/", "/article/"],
}
X_PROFILE_PAGES = ["header_photo", "photo", "about", "following", "followers", "verified_followers"]
# ----------------------------------------------------------------------------------------------------------------------


def is_login_wall(title: Column, description: Column) -> Column:
    """CF7."""
    text = F.lower(F.concat_ws(" ", wide_trim(F.coalesce(title, F.lit(""))), wide_trim(F.coalesce(description, F.lit("")))))
    return let(text, lambda v: has_any(v, *LOGIN_MARKS))


def social_platform(url: Column, site: Column, kind: Column) -> Column:
    """CF5: twitter, instagram, linkedin or reddit, by type, site name and link; else null."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    u, s, k = low(url), low(site), low(kind)
    return (
        F.when((k == "twitter") | has_any(s, "twitter", "x.com") | has_any(u, "twitter.com", "x.com"), F.lit("twitter"))
        .when((k == "instagram") | s.contains("instagram") | u.contains("instagram.com"), F.lit("instagram"))
        .when((k == "linkedin") | s.contains("linkedin") | u.contains("linkedin.com"), F.lit("linkedin"))
        .when((k == "reddit") | s.contains("reddit") | has_any(u, "reddit.com", "redd.it"), F.lit("reddit"))
    )


def page_intent(url: Column, password_inputs: Column, login_forms: Column, inputs: Column, article_meta: Column, article_tags: Column, code_blocks: Column, words: Column) -> Column:
    """CF1."""
    u = F.lower(url)
    return (
        F.when((password_inputs > 0) | (login_forms > 0) | (u.rlike(AUTH_PATH) & (inputs > 0)), F.lit("auth_or_portal"))
        .when(article_meta | ((article_tags > 0) & (words > 150)) | (words > 250), F.lit("article"))
        .when(u.rlike(TOOL_PATH) | (code_blocks > 8), F.lit("tool_or_resource"))
        .otherwise(F.lit("general_website"))
    )


def is_instagram_wall(html: Column, final_url: Column) -> Column:
    """CF3: a login wall, a challenge or an empty shell instead of a page."""
    moved = F.coalesce(has_any(F.lower(final_url), "/accounts/login", "/accounts/onetap", "/challenge/"), F.lit(False))
    description, title, image = (html.contains(f'property="og:{k}"') for k in ("description", "title", "image"))
    landing = html.contains('content="Instagram"') & (html.contains("static.cdninstagram.com/rsrc.php") | ~html.contains("cdninstagram.com"))
    head = F.lower(F.left(html, F.lit(30000)))
    login = has_any(head, "<title>login • instagram</title>", "<title>log in • instagram</title>")
    return F.when(moved | html.isNull() | (html == ""), F.lit(True)).when(description, F.lit(False)).when(title, landing & ~image).otherwise(login | ~image)


def is_degraded(platform: Column, title: Column, description: Column, card: Column, has_card: Column) -> Column:
    """CF4. card: struct(author_name, avatar_url, is_profile, media array<struct<type,url>>)."""
    p, t, d = F.lower(F.coalesce(platform, F.lit(""))), F.lower(wide_trim(F.coalesce(title, F.lit("")))), wide_trim(F.coalesce(description, F.lit("")))
    n = F.coalesce(F.size(card["media"]), F.lit(0))
    first = F.coalesce(F.try_element_at(card["media"], F.lit(1))["url"], F.lit(""))
    only_avatar = (first == "") | (first == F.coalesce(card["avatar_url"], F.lit(""))) | has_any(first, *AVATAR_MARKS)
    nameless = has_card & (wide_trim(F.coalesce(card["author_name"], F.lit(""))) == "Instagram User") & (d == "") & (n <= 0)
    profile = has_card & F.coalesce(card["is_profile"], F.lit(False)) & ((n <= 0) | ((n <= 1) & only_avatar))
    untitled = t.isin("instagram", "instagram post", "") & (d == "")
    return (
        F.when(p == "instagram", nameless | profile | untitled)
        .when(p == "twitter", has_card & (F.coalesce(title, F.lit("")) == "") & (F.coalesce(description, F.lit("")) == ""))
        .when(p == "reddit", (d != "") & is_truncated(d))
        .otherwise(F.lit(False))
    )


def is_quota_error(message: Column) -> Column:
    """CF12."""
    return F.coalesce(has_any(F.lower(message), *QUOTA_MARKS), F.lit(False))


def x_profile_user(url: Column) -> Column:
    """CF8: the user whose profile a link shows; null for posts, system pages and other hosts."""

    def run(parts: Column) -> Column:
        shape = (F.size(parts) == 1) | ((F.size(parts) == 2) & F.lower(F.try_element_at(parts, F.lit(2))).isin(X_PROFILE_PAGES))
        user = F.try_element_at(parts, F.lit(1))
        return F.when(shape & ~F.lower(user).isin(X_RESERVED) & user.rlike(r"^[a-zA-Z0-9_]{1,30}\z"), user)

    return F.when(host_of(url).rlike(r"(?:^|\.)(?:twitter|x)\.com\z"), let(F.filter(F.split(path_of(url), "/"), lambda p: p != ""), run))


def linkedin_type(url: Column) -> Column:
    """CF9."""
    p = F.lower(path_of(url))
    out = F.when(p.isNull(), F.lit("linkedin_post"))
    for label, marks in LINKEDIN_TYPES.items():
        out = out.when(has_any(p, *marks), F.lit(label))
    return out.otherwise(F.lit("linkedin_post"))


def is_reel(url: Column) -> Column:
    """CF10."""
    return F.coalesce(url.rlike(r"(?i)/(?:reels?|share/[rv]|videos?|watch)"), F.lit(False))


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def fallback_analysis(title: Column, description: Column, site: Column, kind: Column, url: Column) -> Column:
    """CF6, U2, O5: struct(context, categories, tags) from keywords and hashtags, for records without a model's answer."""
    e = lambda c: F.coalesce(c, F.lit(""))
    filled = lambda c: F.when(c != "", c)

    def run(text: Column) -> Column:
        # split into words once: an alternation would be tried at every character
        words = F.filter(F.regexp_extract_all(text, F.lit("[a-z0-9_]++"), F.lit(0)), lambda w: w.isin(*KEYWORDS.split("|")))
        hashes = F.regexp_extract_all(text, F.lit("#([a-zA-Z0-9_]+)"), F.lit(1))
        own = F.array_compact(F.array(F.lower(filled(kind)), _slug(filled(site))))
        categories = F.slice(F.array_distinct(F.concat(own, F.slice(words, 1, 3))), 1, 5)
        parts = F.concat_ws(" | ", F.concat(F.lit("Title: "), filled(title)), F.concat(F.lit("Description: "), filled(description)), F.concat(F.lit("Source: "), filled(site)))
        context = F.when(parts != "", F.concat(F.lit("Content Summary: "), parts, F.lit("."))).otherwise(F.concat(F.lit("Saved link from "), F.coalesce(filled(site), url, F.lit("")), F.lit(".")))
        return F.struct(context.alias("context"), F.when(F.size(categories) > 0, categories).otherwise(F.array(F.lit("general"))).alias("categories"), F.slice(F.array_distinct(F.concat(own, words, hashes)), 1, 10).alias("tags"))

    return let(F.lower(F.concat_ws(" ", e(title), e(description), e(site))), run)


AI_ANSWER = "ai_context string, ai_category array<string>, ai_tags array<string>, visual_entities array<string>, ocr_text string"


def normalize_analysis(raw: Column, fallback: Column) -> Column:
    """JF8: a model's JSON answer, trimmed and capped; what it lacks comes from the fallback, all of it if it is no JSON."""

    def run(a: Column) -> Column:
        texts = lambda c, below, most: F.slice(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: wide_trim(F.coalesce(t, F.lit("")))), lambda t: F.length(t).between(1, below - 1)), 1, most)
        some = lambda c, other: F.when(F.size(c) > 0, c).otherwise(other)
        context = present(F.regexp_replace(a["ai_context"], r"(?i)</?untrusted_content>", ""))
        return F.struct(
            F.coalesce(F.left(context, F.lit(1500)), fallback["context"]).alias("context"),
            some(texts(F.transform(a["ai_category"], F.lower), 60, 10), fallback["categories"]).alias("categories"),
            some(tag_slugs_kept(a["ai_tags"]), fallback["tags"]).alias("tags"),
            texts(a["visual_entities"], 80, 15).alias("entities"),
            F.left(wide_trim(F.coalesce(a["ocr_text"], F.lit(""))), F.lit(2000)).alias("ocr_text"),
        )

    return let(F.from_json(strip_code_fence(raw), AI_ANSWER), run)


def tag_slugs_kept(tags: Column) -> Column:
    """As tag_slugs(), repeats kept."""
    slugs = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(wide_trim(F.coalesce(t, F.lit("")))), "[^a-z0-9_-]", ""))
    return F.slice(F.filter(slugs, lambda t: F.length(t).between(1, 49)), 1, 15)


def effective_intent(given: Column, card_intent: Column, kind: Column, card_kind: Column) -> Column:
    """P23."""
    article = (F.coalesce(kind, F.lit("")) == "article") | (F.coalesce(card_kind, F.lit("")) == "article")
    return F.coalesce(first_present(given, card_intent), F.when(article, F.lit("article")).otherwise(F.lit("general_website")))


def analysis_images(snapshot: Column, media: Column, intent: Column, most: int = 2) -> Column:
    """AF4: up to two pictures for analysis: the snapshot, then posters and thumbnails of videos and other media; none for
    articles. media: array<struct<type,url,poster,thumbnail>>."""
    one = lambda m: F.when((m["type"] == "video") | is_video_url(m["url"]), F.array(m["poster"], m["thumbnail"])).otherwise(F.array(m["url"]))
    found = F.flatten(F.transform(F.coalesce(media, F.array().cast("array<struct<type:string,url:string,poster:string,thumbnail:string>>")), one))
    every = F.concat(F.array(F.when(~is_video_url(snapshot), snapshot)), found)
    kept = F.slice(F.array_distinct(F.filter(every, lambda u: u.isNotNull() & (u != ""))), 1, most)
    return F.when(F.coalesce(intent, F.lit("")) == "article", F.array().cast("array<string>")).otherwise(kept)

