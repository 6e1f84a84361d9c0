"""What pages of single platforms say of a post: author, whole text, account, verified badge, and which images are the post's own.

Built-in expressions only. Defined cases: null and empty pages have no author but the default, no text, no account and no badge; of
equally good candidates the first wins; lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.numeric import is_count_text
from skein.functions.strings import WS, group, has_any, let, present, wide_trim
from skein.functions.text import name_from_slug, title_case

# ---- fixed values ----------------------------------------------------------------------------------------------------
#: TF17: fields of a page's scripts that name who posted, in order.
OWNER_NAMES = [
    r'(?i)"video_owner"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"', r'(?i)"owner"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"',
    r'(?i)"owner_as_page"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"', r'(?i)"actors"\s*:\s*\[\s*\{[^}]*"name"\s*:\s*"([^"]+)"',
    r'(?i)"owning_profile"\s*:\s*\{[^}]*"name"\s*:\s*"([^"]+)"',
]
BY_AUTHOR, ON_FACEBOOK = rf"(?i)\|{WS}*By{WS}+([^|]+)\z", rf"(?i)^([^:]+){WS}+on{WS}+Facebook"
OF_REEL = rf"(?i)^(.+?)(?:'s{WS}+Reel|{WS}+Reels)\z"
POST_SLUG = r"(?i)facebook\.com/([a-zA-Z0-9.-]+)/(?:posts|videos|reel|photos)"
NO_SLUGS = ["share", "watch", "reel", "reels", "p"]
LOGIN_TITLE, NO_AUTHOR = "Log in or sign up to view", "Facebook User"
#: A4: texts of stories in scripts, then any long text, with what no post says.
MESSAGE = r'"message"\s*:\s*\{[^}]*"text"\s*:\s*"((?:\\.|[^"\\]){50,}+)"'
ANY_TEXT = r'"text"\s*:\s*"((?:\\.|[^"\\]){60,}+)"'
BOILERPLATE = ["log in or sign up to view", "related videos", "facebook ©"]
OG_PREFIX = 30
#: Ids and names of the account that posted.
PEOPLE = r"(?i)facebook\.com/people/([^/]+)/([0-9]+)"
ACCOUNT_SLUG = r"(?i)facebook\.com/([a-zA-Z0-9.-]+)/(?:posts|videos|reel|photos|\?|\z)"
ACTOR_IDS = [
    r'(?i)"actors"\s*:\s*\[\s*\{[^}]*"id"\s*:\s*"([0-9]+)"', r'(?i)"owner"\s*:\s*\{[^}]*"id"\s*:\s*"([0-9]+)"',
    r'(?i)"owning_profile"\s*:\s*\{[^}]*"id"\s*:\s*"([0-9]+)"', r'(?i)"profile_picture":\s*\{\s*"uri"\s*:\s*"[^"]*media_id=([0-9]+)"',
]
ACTOR_PEOPLE = r'(?i)"actors"\s*:\s*\[\s*\{[^}]*"url"\s*:\s*"https:\\/\\/www\.facebook\.com\\/people\\/([^\\/"]+)\\/([0-9]+)\\/"'
ACTOR_SLUGS = [
    r'(?i)"actors"\s*:\s*\[\s*\{[^}]*"url"\s*:\s*"https:\\/\\/www\.facebook\.com\\/([^\\/"]+)\\/"', r'(?i)"profile_url"\s*:\s*"https:\\/\\/www\.facebook\.com\\/([^\\/"]+)\\/"',
    r'(?i)"permalink_url"\s*:\s*"https:\\/\\/www\.facebook\.com\\/([^\\/"]+)\\/(?:videos|posts)',
]
#: CF14: what a page of a verified profile holds.
FACEBOOK_VERIFIED = ['"is_verified":true', '"verification_status":"BLUE_VERIFIED"', '"verification_status":"VERIFIED"', 'title="Verified account"', "<title>Verified account</title>", 'aria-label="Verified account"']
X_VERIFIED = ['data-testid="icon-verified"', 'legacy_verified":true', 'is_blue_verified":true', "verified_organization", "blue_business", '"verification":']
X_BADGE = r"<(?i:svg)\b[^>]*\baria-label=[\"'][^\"'>]*[Vv]erified"
BADGE_REACH, FULL_NAME_REACH, TYPE_REACH = 300, 150, 100
#: AF3: parts of links of images that are not a post's own.
FACEBOOK_NOT_POST = [
    "emoji.php", "rsrc.php", "static.xx.fbcdn.net", "favicon", "badge", "icon", "profile-display", "t39.1997", "t39.30808-1", "/stickers/", "sticker", "emoji",
    "120x120", "100x100", "40x40", "50x50",
]
INSTAGRAM_AVATAR = ["150x150", "s150x150", "s100x100", "s320x320", "t51.82787-19", "profile_pic", "avatar", "rsrc.php"]
LINKEDIN_GHOST = ["ghost_person", "ghost_profile", "ghost-avatar", "aero-v1", "9c8pery4andzj6ohjkjp54ma2", "profile-displaybackgroundimage", "cover-image"]
LINKEDIN_NOT_POST = ["profile-displayphoto", "profile-displaybackgroundimage", "company-logo"]
REDDIT_NOT_IMAGE = [
    "reddit.com/gallery", "reddit.com/r/", "reddit.com/comments/", "reddit.com/user/", "reddit.com/u/", "share.redd.it", "v.redd.it", "packaged-media.redd.it", "redditstatic.com",
    "reddit_logo", "favicon", "communityicon", "avatar", "snoovatar", ".mp4", ".m3u8",
]
REDDIT_IMAGE_HOSTS = ["i.redd.it", "preview.redd.it", "external-preview.redd.it"]
#: CF13, P21.
RESTRICTED = "The account is restricted, please view it on Instagram."
LINKEDIN_LOGO = "https://static.licdn.com/aero-v1/sc/h/al2o9zrvru7aqj8e1x2rzsrca"
# ----------------------------------------------------------------------------------------------------------------------


def unicode_escapes(c: Column) -> Column:
    r"""\uXXXX as characters, also pairs of them beyond the first plane; other escapes stay. Runs are decoded whole, so pairs are not torn."""
    runs = r"(?:\\u[0-9A-Fa-f]{4})++"
    decoded = lambda r: F.coalesce(F.get_json_object(F.concat(F.lit('{"r":"'), r, F.lit('"}')), "$.r"), F.lit(""))
    joined = lambda v: F.array_join(F.zip_with(F.split(v, runs, -1), F.regexp_extract_all(v, F.lit(runs), F.lit(0)), lambda a, r: F.concat(a, decoded(r))), "")
    return F.when(c.contains("\\u"), let(c, joined)).otherwise(c)


def _first(*cs: Column) -> Column:
    """The first that is no count, not blank and does not name the site."""
    return F.coalesce(*[let(c, lambda x: F.when(~is_count_text(x) & ~F.lower(x).contains("facebook"), x)) for c in cs])


def facebook_author(title: Column, url: Column, html: Column) -> Column:
    """TF17: who posted: by script fields, by the title's parts, by the link; 'Facebook User' at last. A metric is never a name."""
    owner = wide_trim(unicode_escapes(F.coalesce(*[group(html, p) for p in OWNER_NAMES])))

    def of_title(t: Column) -> Column:
        parts = lambda by: F.filter(F.transform(F.split(t, by), wide_trim), lambda s: ~is_count_text(s))
        bars = let(parts(r"\|"), lambda p: F.when(F.size(p) > 1, F.element_at(p, -1)))
        head = lambda mark, by: F.when(t.contains(mark), F.try_element_at(parts(by), F.lit(1)))
        named = lambda pattern: let(group(t, pattern), lambda x: F.when(~is_count_text(x), wide_trim(x)))
        whole = F.when(t != LOGIN_TITLE, _first(t))
        return F.coalesce(_first(bars), _first(head("·", "·")), _first(head(" - ", " - ")), named(BY_AUTHOR), named(ON_FACEBOOK), named(OF_REEL), whole)

    cleaned = wide_trim(F.regexp_replace(title, rf"(?i){WS}*\|{WS}*Facebook{WS}*\z", ""))
    slug = let(group(url, POST_SLUG), lambda s: F.when(~F.lower(s).isin(NO_SLUGS), wide_trim(F.translate(s, ".-", "  "))))
    of_link = let(slug, lambda s: F.when(~is_count_text(s), title_case(s)))
    return F.coalesce(_first(owner), let(cleaned, of_title), of_link, F.lit(NO_AUTHOR))


def longest_text(html: Column, description: Column) -> Column:
    """A4: the longest text of the page's scripts, of those that hold the start of the given description if any does; the first of equals; null if there is none."""

    def plain(raw: Column) -> Column:
        out = raw
        for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", ""), ("\\t", " ")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return wide_trim(unicode_escapes(out))

    def says_nothing(t: Column) -> Column:
        return let(F.lower(t), lambda v: has_any(v, *BOILERPLATE) | (v.contains("see more of") & v.contains("on facebook")) | v.startswith('{"') | v.startswith('["'))

    every = lambda p: F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), plain)
    found = F.filter(F.concat(every(MESSAGE), F.filter(every(ANY_TEXT), lambda t: ~says_nothing(t))), lambda t: t != "")
    flat = lambda c: F.regexp_replace(c, r"[\n\r\t]+", " ")
    start = present(F.left(wide_trim(flat(description)), F.lit(OG_PREFIX)))

    def longest(ts: Column) -> Column:
        sized = F.transform(ts, lambda t, i: F.struct(F.length(t).alias("n"), (-i).alias("i"), t.alias("t")))
        return F.array_max(sized)["t"]

    return let(found, lambda ts: F.coalesce(longest(F.filter(ts, lambda t: F.contains(flat(t), start))), longest(ts)))


def facebook_account(url: Column, html: Column, author: Column) -> Column:
    """The id or name by which an account is looked up: the first number among the candidates of link, scripts and author, else the first of them."""
    slug = lambda s: F.when(~F.lower(s).isin(*NO_SLUGS, "people"), s)
    of_name = F.when(author != NO_AUTHOR, F.regexp_replace(author, "[^a-zA-Z0-9.-]", ""))
    candidates = F.array(
        group(url, PEOPLE, 2), group(url, PEOPLE, 1), slug(group(url, ACCOUNT_SLUG)), F.coalesce(*[group(html, p) for p in ACTOR_IDS]), group(html, ACTOR_PEOPLE, 2), group(html, ACTOR_PEOPLE, 1),
        slug(F.coalesce(*[group(html, p) for p in ACTOR_SLUGS])), F.nullif(of_name, F.lit("")),
    )
    return let(F.array_compact(candidates), lambda c: F.coalesce(F.try_element_at(F.filter(c, lambda x: x.rlike(r"^[0-9]+\z")), F.lit(1)), F.try_element_at(c, F.lit(1))))


# ---- CF14 ----


def badge_beside(text: Column, names: str, is_own: Callable[[Column], Column], marks: str, within: int = BADGE_REACH) -> Column:
    """Whether a mark belongs to the wanted name: a mark belongs to the nearest name, before or behind it, at most `within` characters
    away; of two equally near ones to that before. `names` and `marks` are patterns that never match the same text, is_own tells the
    wanted one among the matched names. One pass over the matches, with a state of fixed size; false for null."""
    both = f"(?:{names})|(?:{marks})"
    none, no = F.lit(None).cast("int"), F.lit(False)

    def run(t: Column) -> Column:
        pieces = F.zip_with(F.split(t, both, -1), F.regexp_extract_all(t, F.lit(both), F.lit(0)), lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match")))
        keys = ("name", "first", "first_end", "last", "last_end")
        start = F.struct(F.lit(0).alias("at"), no.alias("own"), no.alias("hit"), *[none.alias(k) for k in keys])

        def step(s: Column, p: Column) -> Column:
            begin, ends, m = s["at"] + p["gap"], p["match"].isNull(), F.coalesce(p["match"], F.lit(""))
            end = begin + F.length(m)
            mark = F.coalesce(m.rlike(f"^(?:{marks})\\z"), no)
            own = ~ends & ~mark & F.coalesce(is_own(m), no)
            # of the marks since the last name the first is nearest to that one, the last to the next one
            back, ahead = s["first"] - s["name"], begin - s["last_end"]
            of_last = s["own"] & (back <= within) & (ends | (back <= begin - s["first_end"]))
            of_next = own & (ahead <= within) & (s["name"].isNull() | (ahead < s["last"] - s["name"]))
            hit = s["hit"] | (~mark & (F.coalesce(of_last, no) | F.coalesce(of_next, no)))
            kept = {
                "name": F.when(mark, s["name"]).otherwise(end), "first": F.when(mark, F.coalesce(s["first"], begin)), "first_end": F.when(mark, F.coalesce(s["first_end"], end)),
                "last": F.when(mark, begin), "last_end": F.when(mark, end),
            }
            return F.struct(end.alias("at"), F.when(mark, s["own"]).otherwise(own).alias("own"), hit.alias("hit"), *[kept[k].alias(k) for k in keys])

        return F.aggregate(pieces, start, step, lambda s: s["hit"])

    return F.when(F.coalesce(text.rlike(marks), no), let(text, run)).otherwise(no)


def instagram_verified(html: Column, user: Column, name: Column) -> Column:
    """CF14: a badge beside the user's or the full name in the page's scripts. Without either, a badge of whatever user is typed right behind it."""
    mark = r'(?i)\\?"is_verified\\?"\s*:\s*true'
    field = lambda key: rf'(?i)\\?"{key}\\?"\s*:\s*\\?"[^"\\]*+\\?"'
    value = lambda m: F.lower(F.regexp_extract(m, r':\s*\\?"([^"\\]*)', 1))
    beside = lambda key, own, n: badge_beside(html, field(key), lambda m: value(m) == F.lower(own), mark, n)
    known_user, known_name = present(user).isNotNull() & (user != "unknown"), present(name).isNotNull() & (name != "Instagram User")
    typed = html.rlike(rf'(?is)"is_verified"\s*:\s*true.{{0,{TYPE_REACH}}}?"__typename"\s*:\s*"User"')
    no = F.lit(False)
    found = (F.coalesce(known_user, no) & beside("username", user, BADGE_REACH)) | (F.coalesce(known_name, no) & beside("full_name", name, FULL_NAME_REACH))
    return found | (~F.coalesce(known_user, no) & ~F.coalesce(known_name, no) & F.coalesce(typed, no))


def facebook_verified(html: Column) -> Column:
    """CF14."""
    return F.coalesce(has_any(html, *FACEBOOK_VERIFIED), F.lit(False))


def x_verified(html: Column) -> Column:
    """CF14."""
    return F.coalesce(has_any(html, *X_VERIFIED) | html.rlike(X_BADGE), F.lit(False))


# ---- AF3, A5 ----


def _plain(url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit("")))


def facebook_post_image(url: Column) -> Column:
    """AF3: whether an image is a post's own: of the site's image hosts or a file of a picture, no page, sticker, avatar or icon."""

    def rules(v: Column) -> Column:
        hosted = has_any(v, "fbcdn.net", "scontent", "fbsbx.com")
        own = has_any(v, "lookaside.fbsbx.com/lookaside/crawler/media", "scontent") | (v.contains("fbcdn.net") & ~v.contains("/static")) | v.rlike(r"\.(?:jpg|jpeg|png|webp)(?:\?.*)?\z")
        return own & ~v.startswith("data:") & ~has_any(v, *FACEBOOK_NOT_POST) & ~(v.contains("facebook.com") & ~hosted)

    return let(_plain(url), rules)


def reddit_post_image(url: Column) -> Column:
    """AF3."""
    return let(wide_trim(_plain(url)), lambda v: ~has_any(v, *REDDIT_NOT_IMAGE) & (has_any(v, *REDDIT_IMAGE_HOSTS) | v.rlike(r"\.(?:jpg|jpeg|png|gif|webp|heic|avif)(?:\?.*)?\z")))


def instagram_avatar(url: Column, known: Column) -> Column:
    """AF3: whether an image shows the author: the known avatar, whatever its parameters, or a link made like one; true for none."""
    bare = lambda c: F.substring_index(c, "?", 1)
    same = url.contains(bare(known)) | bare(known).contains(bare(url))
    return let(_plain(url), lambda v: (v == "") | has_any(v, *INSTAGRAM_AVATAR)) | F.coalesce(same & (known != ""), F.lit(False))


def linkedin_ghost(url: Column) -> Column:
    """AF3: no avatar, or the site's stand-in for one."""
    return let(_plain(url), lambda v: (v == "") | has_any(v, *LINKEDIN_GHOST))


def linkedin_not_post(url: Column) -> Column:
    """AF3."""
    return linkedin_ghost(url) | has_any(_plain(url), *LINKEDIN_NOT_POST)


def tallest_video(player: Column) -> Column:
    """A5: the link of the tallest video of a Reddit player's JSON; the first of equals; null where the tallest has none."""
    found = F.try_variant_get(F.try_parse_json(player), "$.playbackMp4s.permutations", "array<variant>")
    height = lambda v: F.coalesce(F.try_variant_get(v, "$.source.dimensions.height", "double"), F.lit(0.0))
    sized = F.transform(found, lambda v, i: F.struct(height(v).alias("h"), (-i).alias("i"), F.try_variant_get(v, "$.source.url", "string").alias("url")))
    return present(F.array_max(sized)["url"])


# ---- CF13, P21 ----


def restricted(user: Column, media: Column, description: Column) -> Column:
    """CF13: no author, no media (a count), and a text that is missing or says so."""
    nobody = F.coalesce(user.isin("", "unknown"), F.lit(True))
    silent = F.coalesce(present(description).rlike("(?i)restricted|unavailable"), F.lit(True))
    return nobody & (F.coalesce(media, F.lit(0)) == 0) & silent


def linkedin_author(name: Column, avatar: Column, url: Column, topic: Column, news: Column, newsletter: Column, article: Column) -> Column:
    """struct(author, avatar): hubs have the site's names and sign, others the name of the link, and a drawn avatar where there is none."""
    unknown = F.coalesce((name == "") | (name == "LinkedIn User") | F.lower(name).contains("linkedin"), F.lit(True))
    hub = F.when(topic, "LinkedIn Top Content").when(news, "LinkedIn News").when(newsletter, "LinkedIn Newsletter")
    author = F.when(~unknown, name).otherwise(F.coalesce(hub, name_from_slug(url), F.when(article, "LinkedIn Author").otherwise("LinkedIn Member")))

    def record(a: Column) -> Column:
        sent = F.url_encode(a)
        for x, y in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            sent = F.replace(sent, F.lit(x), F.lit(y))
        drawn = F.concat(F.lit("https://ui-avatars.com/api/?name="), sent, F.lit("&background=0a66c2&color=fff&size=200&bold=true"))
        of_hub = F.when(unknown & hub.isNotNull(), F.lit(LINKEDIN_LOGO)).otherwise(avatar)
        return F.struct(a.alias("author"), F.when(linkedin_ghost(of_hub), drawn).otherwise(of_hub).alias("avatar"))

    return let(author, record)
