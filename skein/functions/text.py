"""Cleaning of titles and descriptions, as column expressions.

Patterns with repeated groups are written as runs of character classes, so long texts neither backtrack nor recurse.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import SPACE_CHARS, SPACES, WS, group, has_any, let, present, wide_trim

# ---- fixed values ----------------------------------------------------------------------------------------------------
NAMED_ENTITIES = {
    "&quot;": '"', "&apos;": "'", "&#x27;": "'", "&#39;": "'", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…",
    "&ldquo;": "“", "&rdquo;": "”", "&lsquo;": "‘", "&rsquo;": "’", "&nbsp;": " ",
}
LAST_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">"}
#: Engagement counts that social previews put before a description.
COUNTS_HEADER = rf'(?i)^[0-9,.{SPACES}KMB]+(?:likes|comments|followers|views|posts|reposts|retweets)[^:]*:{WS}*"?'
VOTES_HEADER = rf'(?i)^[0-9,.{SPACES}KMB]+(?:votes?|upvotes?)(?:,{WS}*[0-9,.{SPACES}KMB]+comments?)?[.–—:-]{WS}*"?'
COMMENTS_HEADER = rf'(?i)^[0-9,.{SPACES}KMB]+comments?[.–—:-]{WS}*"?'
DATE_HEADER = rf'(?i)^[a-zA-Z0-9._-]+{WS}+on{WS}+[a-zA-Z0-9{SPACES},.:]+:{WS}*"?'
TITLE_HEAD = rf'(?i)^[^:]+{WS}+on{WS}+(?:Instagram|Twitter|X|Facebook|Reddit|LinkedIn|Pinterest):{WS}*"?'
TITLE_TAIL = rf"(?i){WS}*[|•-]{WS}*(?:Instagram(?:{WS}+photos{WS}+and{WS}+videos)?|Twitter|X|Facebook|YouTube|Reddit|LinkedIn){WS}*\z"
MORE_BUTTON = rf"(?i){WS}*(?:\.\.\.{WS}*)?(?:Read{WS}*more|Show{WS}*more|Show{WS}*less|See{WS}*more){WS}*\.?{WS}*\z"
DOT_LINE = rf"\r?\n{WS}*[.•-]{WS}*"
DOT_RUN = rf"{WS}*\.{WS}*\.{WS}*\.[{SPACES}.]*"
THREE_DOTS = rf"\.{WS}*\.{WS}*\."
SLUG = r"(?i)/(?:posts|pulse)/([a-zA-Z0-9-]+?)(?:_[a-z0-9]+|-activity|-vanderburg|-9vkfc|/|\z)"
LINKEDIN_COUNT = rf"(?i){WS}*\|{WS}*[0-9,.]+[KMB]?{WS}*comments(?:{WS}+on{WS}+LinkedIn)?"
LINKEDIN_TAIL = rf"(?i){WS}*\|{WS}*LinkedIn{WS}*\z"
LINKEDIN_POSTED = rf"(?i){WS}*\|{WS}*[^|]*?(?:posted|on LinkedIn|LinkedIn).*\z"
POST_FOOTER = rf"—{WS}*[^@]+?\(@[a-zA-Z0-9_]+\)([^@]*)\z"
POST_LINKS = [
    r'(?i)<a[^>]*href="[^"]*pic\.(?:twitter|x)\.com[^"]*"[^>]*>.*?</a>', r'(?i)(?:https?://)?pic\.(?:twitter|x)\.com/[^\s<>"]+',
    r'(?i)<a[^>]*href="[^"]*t\.co[^"]*"[^>]*>.*?</a>', r'(?i)https?://t\.co/[^\s<>"]+', r'(?i)(?:^|\s)t\.co/[^\s<>"]+',
    r'(?i)https?://(?:twitter|x)\.com/[a-zA-Z0-9_]+/status/[0-9]+[^\s<>"]*',
]
BLOCKED_TITLES = [
    "access denied", "access to this page has been denied", "403 forbidden", "403 - forbidden", "forbidden", "just a moment...",
    "attention required! | cloudflare", "security check", "robot or human?", "bot verification", "please verify you are a human",
    "are you a human?", "human verification", "blocked", "request rejected", "ddos-guard",
]
BLOCKED_PARTS = [
    "errors.edgesuite.net", "you don't have permission to access", "access to this page has been denied",
    "our systems have detected unusual traffic", "cf-browser-verification", "cloudflare ray id", "incapsula incident id",
]
# ----------------------------------------------------------------------------------------------------------------------


def _numeric_entities(c: Column, pattern: str, base: int) -> Column:
    """Numeric references in one pass: the text between them and the characters they name, joined again."""

    def char(digits: Column) -> Column:
        short = F.regexp_replace(digits, "^0+", "")
        code = F.when(F.length(short).between(1, 7), F.conv(short, base, 10).cast("long"))
        known = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.coalesce(F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")), F.lit(""))

    def join(v: Column) -> Column:
        between = F.split(v, pattern)
        found = F.transform(F.regexp_extract_all(v, F.lit(pattern), F.lit(1)), char)
        return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    return F.when(c.contains("&#"), let(c, join)).otherwise(c)


def unescape_html(c: Column) -> Column:
    """TF1: entities become characters ('&amp;lt;' becomes '<'), backslashes before punctuation go; null stays null."""

    def run(v: Column) -> Column:
        for name, char in NAMED_ENTITIES.items():
            v = F.replace(v, F.lit(name), F.lit(char))
        v = _numeric_entities(_numeric_entities(v, "&#x([0-9a-fA-F]+);", 16), "&#([0-9]+);", 10)
        for name, char in LAST_ENTITIES.items():
            v = F.replace(v, F.lit(name), F.lit(char))
        return F.regexp_replace(v, rf"\\+([^a-zA-Z0-9{SPACES}])", "$1")

    return F.when(c.contains("&") | c.contains("\\"), let(c, run)).otherwise(c)


def strip_engagement_header(c: Column) -> Column:
    """TF2."""
    out = wide_trim(c)
    for p in (COUNTS_HEADER, VOTES_HEADER, COMMENTS_HEADER, DATE_HEADER):
        out = F.regexp_replace(out, p, "")
    return wide_trim(out)


def strip_title_affixes(c: Column) -> Column:
    """TF3: 'Name on Platform:' at the start, '| Platform' at the end."""
    return wide_trim(F.regexp_replace(F.regexp_replace(wide_trim(c), TITLE_HEAD, ""), TITLE_TAIL, ""))


def remove_dot_spam(c: Column) -> Column:
    """TF4: lines of a lone dot, and runs of three or more dots."""
    # the test starts at a dot, which is much rarer than white space
    squeeze = lambda v: F.when(v.rlike(THREE_DOTS), F.regexp_replace(v, DOT_RUN, " ")).otherwise(v)
    return wide_trim(let(F.regexp_replace(c, DOT_LINE, "\n"), squeeze))


def strip_outer_quotes(c: Column, paired: bool = False) -> Column:
    """TF5. paired: quotes at one end go only where the text holds no partner of theirs, so the last one of `key = "x"` stays."""

    def run(v: Column) -> Column:
        count = lambda x, q: F.length(x) - F.length(F.replace(x, F.lit(q), F.lit("")))
        wrapped = F.lit(False)
        for a, b in (('"', '"'), ("“", "”"), ("'", "'")):
            around = v.startswith(a) & v.endswith(b)
            wrapped = wrapped | (around & (count(v, a) <= (2 if a == b else 1)) if paired and a != "'" else around)
        inner = F.when(wrapped, wide_trim(F.substring(v, F.lit(2), F.greatest(F.length(v) - 2, F.lit(0))))).otherwise(v)
        bare = lambda x: wide_trim(F.regexp_replace(wide_trim(F.regexp_replace(x, r'["”]\.?\z', "")), r'^["“]', ""))
        if not paired:
            return bare(inner)
        odd = lambda x: (count(x, '"') % 2 == 1) | (count(x, "“") != count(x, "”"))
        return let(inner, lambda x: F.when(odd(x), bare(x)).otherwise(wide_trim(x)))

    return let(wide_trim(c), run)


def clean_title(c: Column, paired: bool = False) -> Column:
    """TF6; null where nothing is left. paired: as in strip_outer_quotes()."""
    return present(remove_dot_spam(strip_outer_quotes(strip_title_affixes(unescape_html(c)), paired)))


def normalize_paragraphs(c: Column) -> Column:
    """TF7: trimmed lines, at most one blank line, no 'Read more' at the end."""
    ends = lambda v: F.lower(F.right(F.rtrim(v, F.lit(SPACE_CHARS + ".")), F.lit(4))).isin("more", "less")
    out = let(F.replace(c, F.lit("\r\n"), F.lit("\n")), lambda v: F.when(ends(v), F.regexp_replace(v, MORE_BUTTON, "")).otherwise(v))
    out = F.array_join(F.transform(F.split(out, "\n"), wide_trim), "\n")
    return wide_trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def clean_description(c: Column, paired: bool = False) -> Column:
    """TF8; null where nothing is left. paired: as in strip_outer_quotes()."""
    return present(normalize_paragraphs(remove_dot_spam(strip_outer_quotes(strip_engagement_header(unescape_html(c)), paired))))


def is_truncated(c: Column) -> Column:
    """TF9: ends with an ellipsis; three dots count only in texts of up to 250 characters."""
    run = lambda v: v.endswith("…") | v.endswith("&#8230;") | v.endswith("&hellip;") | ((F.length(v) <= 250) & v.endswith("..."))
    return F.coalesce(let(wide_trim(c), run), F.lit(False))


def is_access_denied(title: Column, description: Column, html: Column) -> Column:
    """CF2: a block or challenge page, by its title or by marks in the title, the description or the first 3000 characters."""
    low = lambda c: F.lower(wide_trim(F.coalesce(c, F.lit(""))))
    everything = F.concat_ws(" ", low(title), low(description), F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(3000))))
    return low(title).isin(BLOCKED_TITLES) | let(everything, lambda v: v.rlike(rf"reference{WS}*#[0-9a-f.]+") | has_any(v, *BLOCKED_PARTS))


def title_case(c: Column) -> Column:
    """TF18: the first letter of every word in upper case, the rest as it is."""
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 20))), " ")


def name_from_slug(url: Column) -> Column:
    """TF14: the author in the link of a post: posts/jane-doe_topic becomes 'Jane Doe'; null without one of 3 to 49 characters."""
    words = wide_trim(F.replace(group(url, SLUG), F.lit("-"), F.lit(" ")))
    return F.when(F.length(words).between(3, 49), title_case(words))


def clean_linkedin_text(c: Column) -> Column:
    """TF14: without tags, JSON escapes, counts of comments and the site's name; null stays null."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    out = F.replace(F.replace(out, F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit(""))
    out = F.rtrim(F.ltrim(out, F.lit(SPACE_CHARS + '"\\')), F.lit(SPACE_CHARS + '"\\}'))
    for p in (LINKEDIN_COUNT, LINKEDIN_TAIL):
        out = F.regexp_replace(out, p, "")
    return wide_trim(F.regexp_replace(out, "[ \\t]+", " "))


def clean_linkedin_title(c: Column) -> Column:
    """TF14."""
    return wide_trim(F.regexp_replace(F.regexp_replace(c, LINKEDIN_POSTED, ""), rf"(?i){WS}*\|{WS}*LinkedIn.*\z", ""))


def clean_media_url(c: Column) -> Column:
    """TF13: JSON and HTML escapes in a media link become characters; null where nothing is left."""
    out = F.replace(F.rtrim(c, F.lit('\\"')), F.lit("\\u0026"), F.lit("&"))
    out = F.replace(F.replace(out, F.lit("&amp;"), F.lit("&")), F.lit("\\"), F.lit(""))
    return present(F.regexp_replace(F.regexp_replace(out, "(?i)u00253D", "%3D"), r"(?i)u003C.*\z", ""))


def clean_post_text(c: Column) -> Column:
    """TF10: the text of an embedded post: breaks become lines; attribution, picture and short links, links to posts and tags go."""
    out = F.regexp_replace(unescape_html(c), r"(?i)<br\s*/?>", "\n")
    # what follows the author's handle may only be tags, a date and the like
    footer = F.regexp_replace(F.regexp_extract(out, POST_FOOTER, 1), "<[^>]+>", "")
    out = F.when(footer.rlike(rf"^[a-zA-Z0-9{SPACES},.:]*\z"), F.regexp_replace(out, POST_FOOTER, "")).otherwise(out)
    for p in POST_LINKS:
        out = F.regexp_replace(out, p, "")
    return clean_description(F.regexp_replace(out, "<[^>]+>", " "))


def clean_reddit_title(c: Column) -> Column:
    """TF15: without 'From the x community on Reddit:' and ': r/x'; '' for the community's own title."""
    v = wide_trim(c)
    bare = F.regexp_replace(F.regexp_replace(v, rf"(?i)^From the [^:]+ community on Reddit:{WS}*", ""), rf"(?i){WS}*:{WS}*r/[a-zA-Z0-9_]+\z", "")
    return F.when(v.rlike(r"(?i)^From the .* community on Reddit\z"), F.lit("")).otherwise(wide_trim(bare))


def clean_pin_title(c: Column) -> Column:
    """TF16."""
    return F.when(c.isNull() | (c == ""), F.lit("Pinterest Pin")).otherwise(wide_trim(F.regexp_replace(c, rf"(?i){WS}*\|{WS}*Pinterest\z", "")))


def reddit_subreddit(url: Column, title: Column) -> Column:
    """CF11: r/name by the link, else by the page's title."""
    return F.concat(F.lit("r/"), F.coalesce(group(url, "(?i)/r/([a-zA-Z0-9_]+)"), group(title, "(?i)From the ([a-zA-Z0-9_]+) community on Reddit"), F.lit("reddit")))


def reddit_comment_id(url: Column) -> Column:
    """CF11: the comment that a link points to; null for a post."""
    bare = F.regexp_replace(F.regexp_extract(url, "^([^?#]*)", 1), r"/+\z", "")
    return F.coalesce(group(bare, r"(?i)/comments/[a-zA-Z0-9_]+/(?:comment|context|_)/([a-zA-Z0-9]+)"), group(bare, r"(?i)/comments/[a-zA-Z0-9_]+/[^/]+/([a-zA-Z0-9]+)\z"), group(url, "(?i)[?&]comment=([a-zA-Z0-9]+)"))


def upgrade_avatar(c: Column) -> Column:
    """TF19: the large form of a profile picture's link."""
    v = present(c)
    return F.when(v.contains("pbs.twimg.com/profile_images/"), F.regexp_replace(v, r"_(?:x96|normal|200x200)\.([a-zA-Z0-9]+)\z", "_400x400.$1")).otherwise(v)


def reddit_name(c: Column, prefix: str, default: str) -> Column:
    """TF24: 'u/name' or 'r/name' with one prefix; a default for deleted and missing ones."""
    bare = F.regexp_replace(wide_trim(c), rf"(?i)^/?{prefix}/", "")
    return F.when(bare.isNull() | bare.isin("", "[deleted]", "[removed]"), F.lit(default)).otherwise(F.concat(F.lit(f"{prefix}/"), bare))


def strip_tags(c: Column) -> Column:
    """HF7."""
    return F.regexp_replace(c, r"<[^>]*>", "")


def strip_code_fence(c: Column) -> Column:
    """TF23: without a ```json fence around the text."""
    return wide_trim(F.regexp_replace(F.regexp_replace(wide_trim(c), rf"(?i)^```(?:json)?{WS}*", ""), rf"{WS}*```\z", ""))


def tag_slugs(tags: Column, most: int = 15) -> Column:
    """TF22: lower-case tags of a-z, 0-9, - and _, of 1 to 49 characters, at most `most`."""
    slugs = F.transform(tags, lambda t: F.regexp_replace(F.lower(wide_trim(t)), "[^a-z0-9_-]", ""))
    return F.slice(F.array_distinct(F.filter(slugs, lambda t: F.length(t).between(1, 49))), 1, most)
