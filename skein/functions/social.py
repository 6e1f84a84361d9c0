"""Texts, dates and labels of single platforms that need no page: TF11, TF12, TF20, TF21, DF2, DF5, P16, P17, P22, P25, CF15."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import group, let, wide_trim, word_count
from skein.functions.text import normalize_paragraphs, strip_engagement_header, strip_outer_quotes, unescape_html

#: Escapes of scripts and what they stand for.
SCRIPT_ESCAPES = {"\\u0026": "&", "\\u0027": "'", "\\u0022": '"', "\\u003c": "<", "\\u003C": "<", "\\u003e": ">", "\\u003E": ">", "\\u000a": "\n", "\\u000A": "\n"}
LINE_ENDS = ["\\r\\n", "\\r", "\\n", "\r\n", "\r"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SUBREDDIT_LOGO = "https://www.redditstatic.com/shreddit/assets/favicon/192x192.png"
REDDIT_MEDIA = r"(?i)(?:^|https?://|//)(?:i\.redd\.it/|(?:cf\.)?preview\.redd\.it/(?:[^/]+-)?(?:v[0-9]+-)?)([a-zA-Z0-9]{8,})(?:\.([a-zA-Z0-9]+))?"

#: What stands before a caption in quotes, tried in this order, and what a preview puts after it.
CAPTION_LEADS = [r"(?i)\s+on\s+[A-Za-z]+\s+[0-9]{1,2},?\s*[0-9]{4}:\s*", r"(?i)on Instagram:\s*", r":\s*"]
CAPTION_TAILS = [r"(?is)\s*View all [0-9.,]+[KMB]? comments.*\z", r"(?is)\s*View more on Instagram.*\z"]


def instagram_text(c: Column) -> Column:
    """TF11: breaks and block ends become lines, script escapes characters; other tags and backslashes go; null is empty."""

    def run(v: Column) -> Column:
        v = F.regexp_replace(F.regexp_replace(v, r"(?i)<br\s*/?>", "\n"), "(?i)</(?:p|div|li)>", "\n")
        for mark, char in SCRIPT_ESCAPES.items():
            v = F.replace(v, F.lit(mark), F.lit(char))
        for mark in LINE_ENDS:
            v = F.replace(v, F.lit(mark), F.lit("\n"))
        return wide_trim(unescape_html(F.regexp_replace(F.replace(v, F.lit("\\"), F.lit("")), "<[^>]+>", "")))

    return let(F.coalesce(c, F.lit("")), run)


def instagram_description(c: Column, user: Column) -> Column:
    """TF12: the caption of a description without counts, quotes, links to more and the user's name in front; null is empty.
    A quote that ends the text is taken off first, so a caption is found by its quotes only where more dots or spaces follow them."""

    def caption(v: Column) -> Column:
        short = r'["“]([\s\S]*?)["”][.\s]*\z'
        found = [group(v, lead + (short if lead != CAPTION_LEADS[-1] else r'["“]([\s\S]{3,})["”][.\s]*\z')) for lead in CAPTION_LEADS]
        out = wide_trim(F.coalesce(*found, v))
        for tail in CAPTION_TAILS:
            out = F.regexp_replace(out, tail, "")
        return wide_trim(out)

    def unnamed(v: Column) -> Column:
        bare = F.regexp_replace(v, "^@", "")
        named = (F.coalesce(user, F.lit("")) != "") & (user != "unknown") & F.startswith(F.lower(bare), F.lower(user))
        rest = F.ltrim(F.substring(bare, F.length(user) + 1, F.length(bare)), F.lit(":- \t\n\r"))
        return F.when(named, wide_trim(rest)).otherwise(v)

    start = strip_engagement_header(strip_outer_quotes(F.coalesce(c, F.lit(""))))
    return normalize_paragraphs(instagram_text(let(let(start, caption), unnamed)))


def reddit_media_id(c: Column) -> Column:
    """TF20: the id of an image link; null if it is none."""
    return F.nullif(F.regexp_extract(c, REDDIT_MEDIA, 1), F.lit(""))


def reddit_image(c: Column) -> Column:
    """TF20: preview links of an image become its own link; others are only unescaped."""

    def run(v: Column) -> Column:
        plain = F.regexp_extract(v, "^([^?#]*)", 1)
        ext = F.coalesce(F.nullif(F.regexp_extract(plain, REDDIT_MEDIA, 2), F.lit("")), F.lit("jpg"))
        return F.coalesce(F.concat(F.lit("https://i.redd.it/"), reddit_media_id(plain), F.lit("."), ext), v)

    return F.when(c != "", let(F.replace(unescape_html(c), F.lit("&amp;"), F.lit("&")), run))


def subreddit_icon(c: Column) -> Column:
    """P25: the given icon, or the platform's where it is missing, a default one or made up."""
    own = c.startswith("http") & ~c.contains("default") & ~c.contains("ui-avatars")
    return F.when(own, c).otherwise(F.lit(SUBREDDIT_LOGO))


def without_untrusted_tags(c: Column) -> Column:
    """TF21: the marks that set off texts from elsewhere are taken out of such texts."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "(?i)</?untrusted_content>", "")


def _month(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.left(name, F.lit(3)))), F.lit(0)).cast("int")


def posted_on(c: Column) -> Column:
    """DF2: the day of the first "on Month D, YYYY"; null without one. A day past the month's end counts on into the next one."""
    part = lambda i: F.regexp_extract(c, r"(?i)\bon\s+([A-Za-z]+)\s+([0-9]{1,2}),?\s*([0-9]{4})\b", i)
    day = part(2).try_cast("int")
    first = F.make_date(part(3).try_cast("int"), _month(part(1)), F.when(day.between(1, 31), F.lit(1)))
    return F.date_add(first, day - 1)


def joined(c: Column) -> Column:
    """DF5: "Joined Month YYYY" of a timestamp in text, in UTC; null where it is none."""
    return F.concat(F.lit("Joined "), F.date_format(c.try_cast("timestamp"), "MMMM yyyy"))


def instagram_title(title: Column, restricted: Column, is_profile: Column, name: Column, user: Column) -> Column:
    """The title, or one made of the names that are known."""
    known = F.coalesce(user, F.lit("unknown")) != "unknown"
    given = F.coalesce(title, F.lit(""))
    at = F.concat(F.lit("@"), user)
    return (
        F.when(restricted, F.lit("Restricted Instagram Content"))
        .when(~given.isin("", "Instagram Post", "Instagram"), given)
        .when(is_profile & known, F.when(~F.coalesce(name, F.lit("")).isin("", "Instagram User"), F.concat(name, F.lit(" ("), at, F.lit(")"))).otherwise(F.concat(at, F.lit(" on Instagram"))))
        .when(known, F.concat(F.lit("Post by "), at, F.lit(" on Instagram")))
        .otherwise(F.lit("Instagram Post"))
    )


def platform_label(kind: Column, card: Column, fallback: Column) -> Column:
    """The record's type, its card's (JSON), or what the link says."""
    return F.coalesce(F.nullif(kind, F.lit("")), F.nullif(F.get_json_object(card, "$.type"), F.lit("")), fallback)


def article_of_card(card: Column, description: Column) -> Column:
    """The article that a card (JSON) holds as text: struct of html, markdown, byline, excerpt, words, minutes; null without text."""
    field = lambda k: F.get_json_object(card, f"$.{k}")

    def made(text: Column) -> Column:
        words = F.coalesce(field("word_count").try_cast("long"), word_count(text))
        minutes = F.coalesce(field("reading_time_minutes").try_cast("long"), F.greatest(F.lit(1), F.ceil(words / 200)).cast("long"))
        html = F.concat(F.lit("<p>"), F.replace(text, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p>"))
        return F.struct(html.alias("html"), text.alias("markdown"), F.nullif(field("author.name"), F.lit("")).alias("byline"), F.nullif(description, F.lit("")).alias("excerpt"), words.alias("words"), minutes.alias("minutes"))

    return F.when(wide_trim(field("article_content")) != "", let(wide_trim(field("article_content")), made))


def stale_profile(is_profile_link: Column, card: Column, listed: bool) -> Column:
    """CF15: whether a stored profile should be fetched again. Lists ask for banner and followers both; a new request for either of
    them, and for the card to be a profile's."""
    lacks = lambda k: ~F.coalesce(F.nullif(F.get_json_object(card, f"$.{k}"), F.lit("")).isNotNull() & ~F.get_json_object(card, f"$.{k}").isin("0", "false"), F.lit(False))
    banner, followers = lacks("banner_url"), lacks("metrics.followers")
    wanted = (banner | followers) if listed else (lacks("is_profile") | (banner & followers))
    return F.coalesce(is_profile_link, F.lit(False)) & wanted
