"""URL functions as column expressions: cleaning, canonical form, content keys, site names, dispatch.

Canonical forms follow the URL standard for ASCII URLs. Differences: international hosts are not turned into punycode, path
characters are not percent-encoded and dot segments stay; all of these only split keys, they never merge different pages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import NOT_WS, WS, first_present, group, has_any, let, wide_trim

# ---- fixed values ----------------------------------------------------------------------------------------------------
#: Query parameters that only track. Names are compared in lower case, so those with capitals match only with strict=False.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "stkn", "igsh", "igshid",
    "fbclid", "gclid", "gbraid", "wbraid", "msclkid", "yclid", "mc_cid", "mc_eid", "ref", "ref_src", "ref_url", "s", "si",
    "feature", "pp", "mibextid", "share_id", "rdt_cid", "_ga", "_gl", "_hsenc", "_hsmi", "rcm", "trk", "trackingId", "refId",
    "midToken", "midSig", "trkInfo", "originalSubdomain", "original_referer", "lipi", "licu",
]
#: First path segments of instagram.com that are no user names.
IG_RESERVED = ["reel", "reels", "p", "tv", "stories", "explore", "direct", "accounts", "developer", "about", "legal", "help", "privacy"]
#: Fifth path segments of a Reddit post that are no comment ids.
REDDIT_RESERVED = ["comment", "comments", "live", "photos", "video"]
#: Labels that users put before a pasted link.
LABEL = r"(?i)^(?:x|twitter|insta|instagram|facebook|fb|reddit|youtube|yt|github|web|link):"
TWEET = r"(?i)(?:twitter\.com|x\.com)/(?:#!/)?([a-zA-Z0-9_]+)/status/([0-9]+)"
IG_MEDIA = r"(?i)instagram\.com/(reel|reels|p|tv)/([a-zA-Z0-9_-]+)"
IG_PROFILE = r"(?i)instagram\.com/([a-zA-Z0-9._]+)/?(?:\?.*)?\z"
YOUTUBE = r"(?i)(?:youtube\.com/(?:watch\?.*v=|shorts/|embed/)|youtu\.be/)([a-zA-Z0-9_-]{11})"
REDDIT_COMMENT = rf"(?i)reddit\.com/r/([^/\s]+)/comments/([a-zA-Z0-9]+)(?:/[^/\s]+)?/comment/([a-zA-Z0-9]+)"
REDDIT_OLD = rf"(?i)reddit\.com/r/([^/\s]+)/comments/([a-zA-Z0-9]+)/[^/\s]+/([a-zA-Z0-9]{{6,}})(?:/|\?|\z)"
REDDIT_POST = r"(?i)reddit\.com/r/([^/\s]+)/comments/([a-zA-Z0-9]+)"
REDDIT_SHORT = r"(?i)redd\.it/([a-zA-Z0-9]+)"
PIN = r"(?i)(?:pinterest\.[a-z.]+|pin\.it)/pin/([0-9]+)"
PIN_SHORT = r"(?i)pin\.it/([a-zA-Z0-9]+)"
LINKEDIN = r"(?i)linkedin\.com/(posts/[a-zA-Z0-9_.%-]+|feed/update/urn:li:[a-zA-Z0-9_:]+|pulse/[a-zA-Z0-9_.%-]+)"
LINKEDIN_ID = r"(?i)(?:activity[-:]|share[-:]|posts/[a-zA-Z0-9_.%-]*?-)([0-9]{18,20})"
LINKEDIN_ID_LOOSE = r"(?i)linkedin\.com/.*?(?:activity|share|posts).*?([0-9]{18,20})"
SHORTLINKS = (
    r"reddit\.com/(?:r/[^/\s]+/)?s/[a-z0-9_-]+|redd\.it/[a-z0-9_-]+|pin\.it/[a-z0-9_-]+|t\.co/[a-z0-9_-]+|bit\.ly/[a-z0-9_-]+"
    r"|tinyurl\.com/[a-z0-9_-]+|(?:lnkd\.in|linkd\.in)/[a-z0-9_/-]+"
)
#: Second-level labels under which a country's sites are registered.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "edu"]
#: Host pattern of each platform, in order of precedence.
PLATFORMS = {
    "reddit": r"(?:^|\.)(?:reddit\.com|redd\.it)$",
    "x": r"(?:^|\.)(?:x\.com|twitter\.com|t\.co)$",
    "instagram": r"(?:^|\.)(?:instagram\.com|instagr\.am)$",
    "pinterest": r"(?:^|\.)(?:pinterest\.[a-z.]+|pin\.it)$",
    "facebook": r"(?:^|\.)(?:facebook\.com|fb\.com|fb\.watch|fb\.me)$",
    "linkedin": r"(?:^|\.)(?:linkedin\.com|lnkd\.in)$",
    "youtube": r"(?:^|\.)(?:youtube\.com|youtu\.be)$",
}
# ----------------------------------------------------------------------------------------------------------------------

_PARTS = r"(?i)^(https?)://([^/?#\\]*)([^?#]*)(?:\?([^#]*))?"
_HOST = r"^(?:([^@]*)@)?([^\x00-\x20#%/:<>?@\[\\\]^|]+)(?::([0-9]{0,5}))?\z"


def clean_raw_url(raw: Column) -> Column:
    """UF1: the link in pasted text: <link>, [title](link), 'insta: link'."""
    s = F.regexp_replace(wide_trim(raw), r"^<([^>]+)>\z", "$1")
    s = let(s, lambda v: F.coalesce(group(v, r"(?i)\[.*?\]\((https?://[^\s)]+)\)"), v))
    return wide_trim(F.regexp_replace(s, f"{LABEL}{WS}*", ""))


def _query(query: Column, strict: bool) -> Column:
    """Parameters without the tracking ones, ordered by name (equal names as given), in form encoding; null when none is left."""
    tracking = [t if strict else t.lower() for t in TRACKING]
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    plain = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(pieces, lambda p, i: F.struct(plain(F.substring_index(p, "=", 1)).alias("name"), i.alias("at"), plain(F.regexp_replace(p, "^[^=]*=?", "")).alias("value")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["name"]).isin(tracking)))
    text = F.transform(kept, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"])))
    return F.nullif(F.array_join(text, "&"), F.lit(""))


def _generic(pre: Column, strict: bool) -> Column:
    """UF2g: https, lower-case host without www, no default port, no fragment, no tracking, no trailing slash, sorted parameters."""
    cut = let(F.regexp_extract(pre, rf"^({NOT_WS}+)", 1), lambda v: F.when(v.rlike(r"(?i)^https?://"), v).otherwise(F.concat(F.lit("https://"), v)))

    def assemble(u: Column) -> Column:
        authority, path = F.regexp_extract(u, _PARTS, 2), F.regexp_extract(u, _PARTS, 3)
        host = F.lower(F.regexp_extract(authority, _HOST, 2))
        user, port = group(authority, _HOST, 1), group(authority, _HOST, 3)
        facebook = host.contains("facebook.com")
        host = F.when(facebook, F.lit("www.facebook.com")).when(host.startswith("www."), F.substring(host, 5, 2048)).otherwise(host)
        path = F.when(path == "", F.lit("/")).otherwise(path)
        path = F.when(~facebook & (F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
        port = F.when(port.isin("80", "443"), F.lit(None)).otherwise(port)
        text = F.concat(F.lit("https://"), F.coalesce(F.concat(user, F.lit("@")), F.lit("")), host, F.coalesce(F.concat(F.lit(":"), port), F.lit("")), path, F.coalesce(F.concat(F.lit("?"), _query(F.regexp_extract(u, _PARTS, 4), strict)), F.lit("")))
        return F.when(authority.rlike(_HOST), text).otherwise(pre)

    return let(cut, assemble)


def canonical_url(raw: Column, strict: bool = True) -> Column:
    """UF2: one key for all links to the same page; '' for null and blank input. Platform rules come first, then the generic one."""

    def rules(v: Column) -> Column:
        handle, ig, kind = F.regexp_extract(v, TWEET, 1), F.regexp_extract(v, IG_MEDIA, 2), F.lower(F.regexp_extract(v, IG_MEDIA, 1))
        profile = group(v, IG_PROFILE)
        at = group(v, r"(?i)[?&]t=([0-9a-zA-Z]+)")
        comment = lambda p: F.concat(F.lit("https://www.reddit.com/r/"), F.lower(F.regexp_extract(v, p, 1)), F.lit("/comments/"), F.regexp_extract(v, p, 2), F.lit("/comment/"), F.regexp_extract(v, p, 3), F.lit("/"))
        return (
            F.when(v == "", F.lit(""))
            .when(v.rlike(TWEET), F.concat(F.lit("https://x.com/"), F.lower(handle), F.lit("/status/"), F.regexp_extract(v, TWEET, 2)))
            .when(v.rlike(IG_MEDIA), F.concat(F.lit("https://www.instagram.com/"), F.when(kind == "reels", F.lit("reel")).otherwise(kind), F.lit("/"), ig, F.lit("/")))
            .when(profile.isNotNull() & ~F.lower(profile).isin(IG_RESERVED), F.concat(F.lit("https://www.instagram.com/"), profile, F.lit("/")))
            .when(v.rlike(YOUTUBE), F.concat(F.lit("https://www.youtube.com/watch?v="), F.regexp_extract(v, YOUTUBE, 1), F.coalesce(F.concat(F.lit("&t="), at), F.lit(""))))
            .when(v.rlike(REDDIT_COMMENT), comment(REDDIT_COMMENT))
            .when(v.rlike(REDDIT_OLD) & ~F.lower(F.regexp_extract(v, REDDIT_OLD, 3)).isin(REDDIT_RESERVED), comment(REDDIT_OLD))
            .when(v.rlike(REDDIT_POST), F.concat(F.lit("https://www.reddit.com/r/"), F.lower(F.regexp_extract(v, REDDIT_POST, 1)), F.lit("/comments/"), F.regexp_extract(v, REDDIT_POST, 2), F.lit("/")))
            .when(v.rlike(REDDIT_SHORT), F.concat(F.lit("https://redd.it/"), F.regexp_extract(v, REDDIT_SHORT, 1)))
            .when(v.rlike(PIN), F.concat(F.lit("https://www.pinterest.com/pin/"), F.regexp_extract(v, PIN, 1), F.lit("/")))
            .when(v.rlike(PIN_SHORT), F.concat(F.lit("https://pin.it/"), F.regexp_extract(v, PIN_SHORT, 1)))
            .when(v.rlike(LINKEDIN), F.concat(F.lit("https://www.linkedin.com/"), F.regexp_extract(v, LINKEDIN, 1)))
            .otherwise(_generic(v, strict))
        )

    return let(clean_raw_url(F.coalesce(raw, F.lit(""))), rules)


def linkedin_post_id(url: Column) -> Column:
    """UF4: the number of an activity or share, 18 to 20 digits."""
    return F.coalesce(group(url, LINKEDIN_ID), group(url, LINKEDIN_ID_LOOSE))


def is_shortlink(url: Column) -> Column:
    """UF5: whether the link belongs to a service that redirects."""
    return F.coalesce(F.lower(wide_trim(url)).rlike(SHORTLINKS), F.lit(False))


def tweet_id(url: Column) -> Column:
    return group(url, r"(?i)status(?:es)?/([0-9]+)")


def youtube_id(url: Column) -> Column:
    return group(url, r"""(?i)(?:youtube\.com/(?:[^/]+/.+/|(?:v|e(?:mbed)?|shorts)/|.*[?&]v=)|youtu\.be/)([^"&?/\s]{11})""")


def content_keys(url: Column) -> Column:
    """Typed keys; two links lead to the same content if they share one. A link to a Reddit comment has the comment in
    its key, so it never meets the post's other links. Empty for null."""

    def keys(v: Column) -> Column:
        reddit = F.coalesce(group(v, REDDIT_POST, 2), group(v, REDDIT_SHORT))
        comment = F.coalesce(group(v, r"(?i)/comment/([a-zA-Z0-9]+)"), group(v, r"(?i)comments/[a-zA-Z0-9]+/[^/\s]+/([a-zA-Z0-9]{6,})"), F.lit(""))
        typed = [
            ("url:", v),
            ("canonical:", F.nullif(canonical_url(v), F.lit(""))),
            ("tweet:", group(v, TWEET, 2)),
            ("instagram:", group(v, IG_MEDIA, 2)),
            ("youtube:", group(v, YOUTUBE)),
            ("reddit:", F.concat_ws("/", reddit, comment)),
            ("pin:", F.coalesce(group(v, r"(?i)pinterest\.[a-z.]+/pin/([0-9]+)"), group(v, PIN_SHORT))),
            ("linkedin:", linkedin_post_id(v)),
        ]
        named = [F.when(reddit.isNotNull() if kind == "reddit:" else value.isNotNull(), F.concat(F.lit(kind), value)) for kind, value in typed]
        return F.array_compact(F.array(*named))

    return F.coalesce(let(wide_trim(url), keys), F.array().cast("array<string>"))


def same_content(a: Column, b: Column) -> Column:
    """UF8: whether two links lead to the same content; false if either is null or blank."""
    return F.coalesce((a != "") & (b != "") & F.arrays_overlap(content_keys(a), content_keys(b)), F.lit(False))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute http(s) link; null for anything else."""
    return F.lower(F.nullif(F.regexp_extract(F.regexp_extract(url, r"(?i)^\s*https?://([^/?#\\]+)", 1), _HOST, 2), F.lit("")))


def path_of(url: Column) -> Column:
    """Path of an absolute link, '/' if it has none; null for anything else."""
    return F.when(host_of(url).isNotNull(), F.coalesce(group(url, r"(?i)^\s*https?://[^/?#]+(/[^?#]*)"), F.lit("/")))


def capital_first(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2048)))


def site_name(url: Column, og: Column) -> Column:
    """UF9: the page's own name, else one by host and path, else the registered label."""

    def derive(host: Column) -> Column:
        path = F.lower(path_of(url))
        n = lambda s: F.lit(s)
        parts = F.split(host, r"\.")
        k = F.size(parts)
        label = F.when((k > 2) & F.try_element_at(parts, F.lit(-2)).isin(SECOND_LEVEL), F.try_element_at(parts, F.lit(-3))).when(k >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(1)))
        return (
            F.when(host.isNull(), n("Unknown Site"))
            .when(host.contains("github.com"), F.when(path.contains("/issues/"), n("GitHub Issue")).when(path.contains("/pull/"), n("GitHub Pull Request")).otherwise(n("GitHub")))
            .when(
                host.contains("linkedin.com"),
                F.when(path.contains("/jobs/"), n("LinkedIn Job")).when(path.contains("/in/"), n("LinkedIn Profile"))
                .when(has_any(path, "/pulse/", "/article/"), n("LinkedIn Article")).when(has_any(path, "/posts/", "/feed/"), n("LinkedIn Post")).otherwise(n("LinkedIn")),
            )
            .when(host.contains("reddit.com"), F.when(path.contains("/comments/"), n("Reddit Post")).otherwise(n("Reddit")))
            .when(has_any(host, "x.com", "twitter.com"), F.when(path.contains("/status/"), n("X Post")).otherwise(n("X")))
            .when(has_any(host, "youtube.com", "youtu.be"), F.when(path.contains("/watch") | host.contains("youtu.be"), n("YouTube Video")).otherwise(n("YouTube")))
            .when(host == "news.ycombinator.com", n("Hacker News"))
            .when(host.contains("medium.com"), n("Medium"))
            .when(host == "dev.to", n("DEV Community"))
            .when(host.contains("stackoverflow.com"), F.when(path.contains("/questions/"), n("Stack Overflow Question")).otherwise(n("Stack Overflow")))
            .otherwise(F.coalesce(F.nullif(capital_first(label), F.lit("")), n("Unknown Site")))
        )

    return F.coalesce(first_present(og), let(F.regexp_replace(host_of(url), r"^www\.", ""), derive))


def platform(url: Column) -> Column:
    """UF10: the platform whose host pattern fits, else generic; a scheme may be missing."""

    def of(host: Column) -> Column:
        out = F.when(host.isNull(), F.lit("generic"))
        for name, pattern in PLATFORMS.items():
            out = out.when(host.rlike(pattern), F.lit(name))
        return out.otherwise(F.lit("generic"))

    lower = F.lower(wide_trim(url))
    return let(host_of(F.when(lower.startswith("http"), lower).otherwise(F.concat(F.lit("https://"), lower))), of)


def url_variants(raw: Column, resolved: Column | None = None) -> Column:
    """UF11, U1: the forms under which a link may have been saved, the canonical one first; for a LinkedIn post also those made
    of its number. resolved: where a short link leads."""

    def forms(x: Column) -> Column:
        v, effective, canonical = x["v"], x["e"], x["c"]
        swap = lambda a, b: F.when(canonical != "", F.regexp_replace(canonical, f"^(.*?){a}", "$1" + b))
        li = ("https://www.linkedin.com", "https://linkedin.com")
        made = [canonical, effective, v, swap("https://x.com", "https://twitter.com"), swap("https://twitter.com", "https://x.com"), swap(*li), swap(*li[::-1])]
        made += [F.when(canonical != "", F.concat(canonical, F.lit("/"))), F.concat(swap(*li), F.lit("/"))]
        made += [swap(f"/{a}/", f"/{b}/") for a, b in (("reel", "reels"), ("reels", "reel"), ("p", "reel"), ("reel", "p"))]
        post = F.coalesce(linkedin_post_id(canonical), linkedin_post_id(effective), linkedin_post_id(v))
        posts = [F.concat(F.lit(f"https://www.linkedin.com/feed/update/urn:li:{kind}:"), post, F.lit(tail)) for kind in ("activity", "share") for tail in ("", "/")]
        return F.concat(F.array_distinct(F.filter(F.array_compact(F.array(*made)), lambda u: u != "")), F.array_compact(F.array(*posts)))

    v = wide_trim(F.coalesce(raw, F.lit("")))
    e = v if resolved is None else F.coalesce(resolved, v)
    return let(F.struct(v.alias("v"), e.alias("e"), canonical_url(e).alias("c")), forms)


def resolve_url(relative: Column, base: Column) -> Column:
    """UF6: an absolute link from one on a page; data: links stay as they are; null if either side is unusable."""

    def resolve(rel: Column) -> Column:
        origin = group(base, r"(?i)^\s*(https?://[^/?#]+)")
        scheme = group(base, r"(?i)^\s*(https?:)")
        path = F.coalesce(group(base, r"(?i)^\s*https?://[^/?#]+(/[^?#]*)"), F.lit("/"))
        folder = F.regexp_replace(path, r"[^/]*\z", "")
        bare_host = F.when(rel.rlike(r"(?i)^https?://[^/?#]+\z"), F.concat(rel, F.lit("/"))).otherwise(rel)
        # './' and 'name/../' are taken out of the joined path, a few levels deep
        joined = F.concat(folder, rel)
        joined = F.regexp_replace(joined, r"/(?:\./)+", "/")
        for _ in range(4):
            joined = F.regexp_replace(joined, r"/(?!\.\./)[^/?#]+/\.\./", "/")
        joined = F.regexp_replace(joined, r"^/(?:\.\./)+", "/")
        return (
            F.when(rel.startswith("data:"), rel)
            .when(rel.rlike(r"(?i)^https?://[^/?#]"), bare_host)
            .when(rel.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), rel)
            .when(origin.isNull(), F.lit(None))
            .when(rel.startswith("//"), F.concat(scheme, rel))
            .when(rel.startswith("/"), F.concat(origin, rel))
            .when(rel.startswith("?"), F.concat(origin, path, rel))
            .when(rel.startswith("#"), F.concat(origin, path, F.coalesce(group(base, r"(\?[^#]*)"), F.lit("")), rel))
            .otherwise(F.concat(origin, joined))
        )

    return F.when(relative.isNotNull(), let(wide_trim(relative), lambda r: F.when(r != "", resolve(r))))


def is_video_url(url: Column) -> Column:
    """UF12: whether the path ends like a video file."""
    return F.coalesce(F.lower(F.substring_index(url, "?", 1)).rlike(r"\.(mp4|mov|avi|webm|m3u8)\z"), F.lit(False))


def fallback_title(url: Column) -> Column:
    """UF13: the host without www, for pages without a title."""
    return F.coalesce(F.regexp_replace(host_of(url), r"^www\.", ""), F.lit("Untitled Bookmark"))
