"""What scripts of stored pages carry: arrays cut out of escaped JSON (JF5), keys at any depth (JF4), ordered rules for videos and counts (JF6, JF7),
LinkedIn's JSON-LD (JF3), and articles of blocks with ranges (HF6) or of a page's content state (HF9)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from skein.functions.numeric import parse_count_floor, sanitize_metrics
from skein.functions.strings import group, has_any, let, present, reading_minutes, wide_trim, word_count
from skein.functions.text import clean_media_url
from skein.session import ship

# ---- JF5 ----

#: Whole strings, single brackets, and runs of anything else; together they are the text. An opened string that never ends is one character.
TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}]|[^"\[\]{}]++|"'
NO_SPANS = "array<struct<start: int, size: int>>"


def unescaped(c: Column) -> Column:
    """One level of JSON escapes less; escapes of other characters stay for the next reader."""
    return F.regexp_replace(c, r'\\(["\\/])', "$1")


def _after(c: Column, keys: tuple[str, ...]) -> Column:
    """The text from the bracket behind the last key on, without the escapes that the keys are written with; null if a key is missing."""

    def behind(k: str):
        return lambda x: F.when(F.locate(k, x) > 0, F.substring(x, F.locate(k, x) + len(k), F.length(x)))

    def plain(rest: Column) -> Column:
        # a backslash before the key's closing quote says that a level of escapes is on, three say two
        marks = F.length(F.regexp_extract(rest, r'^(\\*)"', 1))
        return let(marks, lambda m: F.when(m >= 3, unescaped(unescaped(rest))).when(m >= 1, unescaped(rest)).otherwise(rest))

    rest = c
    for k in keys:
        rest = let(rest, behind(k))
    # each step is a let, so that none is evaluated again for every place where the next one reads it
    return let(let(rest, plain), lambda x: F.when(F.locate("[", x) > 0, F.substring(x, F.locate("[", x), F.length(x))))


def array_items(c: Column, *keys: str) -> Column:
    """JF5: struct(items, closed): the elements, as JSON, of the first array behind keys that follow one another in a text. Brackets in
    strings don't count; of an array that is cut off the whole elements are given and closed is false; null without the keys."""

    def run(text: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("at"), F.lit(0).alias("start"), F.array().cast(NO_SPANS).alias("spans"), F.lit(False).alias("closed"))

        def step(s: Column, t: Column) -> Column:
            up, down = t.isin("[", "{"), t.isin("]", "}")
            depth = s["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
            opens, ends = up & (s["depth"] == 1), down & (depth == 1)
            span = F.struct(s["start"].alias("start"), (s["at"] + 1 - s["start"]).alias("size"))
            plain = ~up & ~down & (s["depth"] == 1) & F.trim(t).rlike("^[^,:]") & (s["start"] == 0)
            own = F.struct(s["at"].alias("start"), F.length(t).alias("size"))
            spans = F.when(ends, F.concat(s["spans"], F.array(span))).when(plain, F.concat(s["spans"], F.array(own))).otherwise(s["spans"])
            begun = F.when(opens, s["at"]).when(ends, 0).otherwise(s["start"])
            following = F.struct(depth.alias("depth"), (s["at"] + F.length(t)).alias("at"), begun.alias("start"), spans.alias("spans"), (down & (depth == 0)).alias("closed"))
            return F.when(s["closed"], s).otherwise(following)

        # an element in brackets is cut at these, others with the commas and blanks around them
        bare = lambda x: F.when(x.startswith("{") | x.startswith("["), x).otherwise(F.trim(F.regexp_replace(x, r"^\s*,|,\s*$", "")))
        cut = lambda s: F.struct(F.transform(s["spans"], lambda x: let(F.substring(text, x["start"], x["size"]), bare)).alias("items"), s["closed"].alias("closed"))
        return F.when(text.isNotNull(), F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), start, step, cut))

    return let(_after(c, keys), run)


# ---- JF4 ----


def _found(value, keys: frozenset, most: int) -> Iterator[tuple[str, int, object]]:
    """Values of the keys with path and depth. An object's own keys come before those of its children, children in order."""
    stack = [("$", 0, value)]
    while stack:
        path, depth, v = stack.pop()
        named = [(f"{path}[{i}]", x) for i, x in enumerate(v)] if isinstance(v, list) else [(f"{path}.{k}", x) for k, x in v.items()]
        if isinstance(v, dict):
            yield from ((f"{path}.{k}", depth + 1, v[k]) for k in v if k in keys)
        if depth < most:
            stack.extend((p, depth + 1, x) for p, x in reversed(named) if isinstance(x, dict | list))


MATCHES = "array<struct<path: string, depth: int, value: string>>"


@lru_cache(maxsize=32)
def _search(keys: frozenset, most: int):
    kind = pa.list_(pa.struct([("path", pa.string()), ("depth", pa.int32()), ("value", pa.string())]))

    @F.arrow_udf(MATCHES)
    def search(c: pa.Array) -> pa.Array:
        out = []
        for text in c.to_pylist():
            try:
                v = json.loads(text) if text else None
            except (ValueError, RecursionError):
                v = None
            out.append([{"path": p, "depth": d, "value": json.dumps(x, ensure_ascii=False)} for p, d, x in _found(v, keys, most)] if isinstance(v, dict | list) else [])
        return pa.array(out, kind)

    return search


def find_keys(c: Column, *keys: str, depth: int = 64) -> Column:
    """JF4: path, depth and value (as JSON) of every occurrence of the keys in a JSON text, at most `depth` levels down; none in what is no JSON."""
    ship(SparkSession.active())
    return _search(frozenset(keys), depth)(c)


def timeline_edges(html: Column, *keys: str) -> Column:
    """JF4: the edges of the first connection of one of these keys, over the page's JSON scripts in order; null if there is none."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/json["'][^>]*>(.*?)</script>"""), F.lit(1))
    whole = F.concat(F.lit("["), F.array_join(F.filter(scripts, lambda s: F.try_parse_json(s).isNotNull()), ","), F.lit("]"))
    found = F.filter(find_keys(whole, *keys), lambda m: ~m["value"].isin("null", "0", "false", '""'))
    return let(F.try_element_at(found, F.lit(1))["value"], lambda v: F.try_variant_get(F.try_parse_json(v), "$.edges", "array<variant>"))


def timeline_media(html: Column, most: int = 6) -> Column:
    """Links of the pictures of a profile's timeline, cleaned, without repeats."""
    edges = timeline_edges(html, "polaris_ordered_timeline_connection", "polaris_timeline_connection")
    link = lambda e: clean_media_url(F.coalesce(present(F.try_variant_get(e, "$.node.display_uri", "string")), F.try_variant_get(e, "$.node.image_versions2.candidates[0].url", "string")))
    return F.slice(F.array_distinct(F.array_compact(F.transform(F.coalesce(edges, F.array().cast("array<variant>")), link))), 1, most)


def carousel(embed: Column) -> Column:
    """JF5: array of type and url of the media of an embedded carousel, also of one whose payload is cut off."""
    return media_of(array_items(embed, "edge_sidecar_to_children", "edges")["items"])


def media_of(items: Column) -> Column:
    """JF5: array of type and url of the media of the items of a carousel, given as JSON; each item is parsed once."""

    def read(v: Column) -> Column:
        text = lambda k: F.try_variant_get(v, f"$.node.{k}", "string")
        return F.struct(F.coalesce(F.try_variant_get(v, "$.node.is_video", "boolean"), F.lit(False)).alias("is_video"), text("video_url").alias("film"), text("display_url").alias("image"))

    def media(r: Column) -> Column:
        return let(F.when(r["is_video"], wide_trim(r["film"])), lambda f: let(F.nullif(f, F.lit("")), lambda film: let(clean_media_url(F.coalesce(film, r["image"])), lambda url: F.when(url.isNotNull(), F.struct(F.when(film.isNotNull(), "video").otherwise("image").alias("type"), url.alias("url"))))))

    return F.array_compact(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda item: let(let(F.try_parse_json(item), read), media)))


# ---- JF6, JF7: rules in order ----

#: Where a video's link stands, in the order that decides. The source is the embed or the page; `bare` reads it without escapes.
VIDEO_RULES = [
    ("embed", False, r'(?i)video_url["\\]*:\s*["\\]*(https?:[\\/]+[^"\s<>]+)'),
    ("embed", True, r"""(?i)(https?://[^"'\s<>]+?\.mp4(?:\?[^"'\s<>]+)?)"""),
    ("page", False, r'(?i)"video_versions"\s*:\s*\[\s*\{[^}]*?"url"\s*:\s*"([^"]+)"'),
    ("page", False, r'(?i)video_url["\\]*:\s*["\\]*(https?:[\\/]+[^"\s<>]+)'),
    ("page", False, r'(?i)"url"\s*:\s*"(https?:[\\/]+[^"]+?\.mp4[^"]*?)"'),
    ("page", True, r"""(?i)(https?://[^"'\s<>\\]+?\.mp4(?:\?[^"'\s<>\\]+)?)"""),
]
SOUND_ONLY = ["dash_ln_heaac", "_audio", "vbr3_audio"]
#: Fields of script payloads, in the order that decides, and the word that a text has behind the count.
COUNT_RULES = {
    "likes": ([r'(?i)"reaction_count"\s*:\s*\{\s*"count"\s*:\s*([0-9]+)', r'(?i)"reaction_count"\s*:\s*([0-9]+)', r'(?i)"like_count"\s*:\s*([0-9]+)'], r"(?i)([0-9,.]+[KMB]?)\s*(?:likes?|reactions?)"),
    "comments": ([r'(?i)"comments"\s*:\s*\{\s*"total_count"\s*:\s*([0-9]+)', r'(?i)"comment_count"\s*:\s*\{\s*"total_count"\s*:\s*([0-9]+)', r'(?i)"total_comment_count"\s*:\s*([0-9]+)'], r"(?i)([0-9,.]+[KMB]?)\s*comments?"),
    "shares": ([r'(?i)"share_count"\s*:\s*\{\s*"count"\s*:\s*([0-9]+)', r'(?i)"i18n_share_count"\s*:\s*"([0-9]+)"'], r"(?i)([0-9,.]+[KMB]?)\s*shares?"),
}


def _bare(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\u0026"), F.lit("&")), F.lit("&amp;"), F.lit("&"))
    return F.replace(F.replace(out, F.lit("\\/"), F.lit("/")), F.lit("\\"), F.lit(""))


def video_link(embed: Column, page: Column) -> Column:
    """JF6: struct(rule, url) of the first rule that finds a link; rules count from 1. The last rule passes over links of sound alone."""
    hits = []
    for n, (source, bare, pattern) in enumerate(VIDEO_RULES, 1):
        text = embed if source == "embed" else page
        text = _bare(text) if bare else text
        if n < len(VIDEO_RULES):
            raw = group(text, pattern)
        else:
            every = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            raw = F.try_element_at(F.filter(every, lambda u: ~has_any(u, *SOUND_ONLY)), F.lit(1))
        hits.append(F.when(raw.isNotNull(), F.struct(F.lit(n).alias("rule"), clean_media_url(raw).alias("url"))))
    return F.coalesce(*hits)


def script_counts(html: Column, text: Column) -> Column:
    """JF7: map of likes, comments and shares from script fields; a count of zero is looked for in the text; null if all are zero."""
    values = []
    for name, (fields, words) in COUNT_RULES.items():
        own = F.coalesce(*[group(html, p) for p in fields]).try_cast("long")
        told = F.when(group(text, words).isNotNull(), parse_count_floor(group(text, words)))
        values += [F.lit(name), F.coalesce(F.when(own != 0, own), told, own, F.lit(0)).cast("double")]
    return sanitize_metrics(F.create_map(*values))


# ---- JF3 ----

#: Types that give a headline and from which key, and types of posts.
HEADLINES = {"Article": "headline", "BlogPosting": "headline", "CollectionPage": "name", "NewsArticle": "headline", "Periodical": "name", "Series": "name"}
POSTS = ["SocialMediaPosting", "VideoObject", "Article", "BlogPosting", "NewsArticle", "DiscussionForumPosting"]


def linkedin_json_ld(html: Column) -> Column:
    """JF3: what the page's JSON-LD says of a post. Of several scripts the last that has a field gives it; images are gathered from all; counters
    come from interactionStatistic by action, the comments also from commentCount of the same script or an earlier one."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    get = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    is_text = lambda v, path: F.coalesce(F.schema_of_variant(get(v, path, "variant")) == "STRING", F.lit(False))
    string = lambda v, path: F.when(is_text(v, path), F.nullif(get(v, path), F.lit("")))
    kind = lambda v: string(v, "$['@type']")

    def run(items: Column) -> Column:
        last = lambda f, xs: F.try_element_at(F.filter(F.transform(xs, f), lambda x: x.isNotNull()), F.lit(-1))
        posts = F.filter(items, lambda v: F.coalesce(kind(v).isin(POSTS), F.lit(False)))
        any_of = lambda *names: F.exists(items, lambda v: F.coalesce(kind(v).isin(*names), F.lit(False)))
        title = lambda v: F.coalesce(*[F.when(kind(v) == t, F.trim(string(v, f"$.{k}"))) for t, k in HEADLINES.items()])
        link = lambda v, path: F.coalesce(string(v, path), string(v, f"{path}.url"), string(v, f"{path}.contentUrl"))
        avatar = lambda v: F.when(get(v, "$.creator.image", "variant").isNotNull(), link(v, "$.creator.image")).otherwise(link(v, "$.author.image"))
        many = lambda v: F.transform(F.coalesce(get(v, "$.image", "array<variant>"), F.array().cast("array<variant>")), lambda x: link(x, "$"))
        images = lambda v: F.array_compact(F.concat(many(v), F.array(link(v, "$.image"), string(v, "$.thumbnailUrl"))))
        stats = lambda v: F.coalesce(get(v, "$.interactionStatistic", "array<variant>"), F.array().cast("array<variant>"))
        all_stats = F.flatten(F.transform(posts, stats))
        action = lambda x: F.coalesce(string(x, "$.interactionType"), F.lit(""))
        told = lambda x: F.coalesce(group(get(x, "$.userInteractionCount"), r"^\s*([+-]?[0-9]+)").cast("long"), F.lit(0))
        liked = lambda x: F.contains(action(x), F.lit("LikeAction")) | F.contains(action(x), F.lit("ReactAction"))
        commented = lambda x: F.contains(action(x), F.lit("CommentAction")) & ~liked(x)
        shared = lambda x: F.contains(action(x), F.lit("ShareAction")) & ~liked(x) & ~commented(x)
        count = lambda test, xs=all_stats: F.try_element_at(F.transform(F.filter(xs, test), told), F.lit(-1))
        comments = lambda v: F.coalesce(count(commented, stats(v)), F.when(~is_text(v, "$.commentCount"), get(v, "$.commentCount", "long")))
        film = lambda v: F.when(kind(v) == "VideoObject", string(v, "$.contentUrl"))
        first = lambda f: F.try_element_at(F.filter(F.transform(posts, f), lambda x: x.isNotNull()), F.lit(1))
        return F.struct(
            last(lambda v: F.coalesce(string(v, "$.creator.name"), string(v, "$.author.name")), posts).alias("author"), last(avatar, posts).alias("avatar"),
            last(lambda v: F.coalesce(string(v, "$.datePublished"), string(v, "$.uploadDate")), posts).alias("published"),
            last(lambda v: F.coalesce(string(v, "$.description"), string(v, "$.articleBody"), string(v, "$.text")), posts).alias("description"),
            F.flatten(F.transform(posts, images)).alias("images"), last(film, posts).alias("video"), first(lambda v: F.when(film(v).isNotNull(), string(v, "$.thumbnailUrl"))).alias("snapshot"),
            F.coalesce(count(liked), F.lit(0)).alias("reactions"), F.coalesce(last(comments, posts), F.lit(0)).alias("comments"), F.coalesce(count(shared), F.lit(0)).alias("reposts"),
            any_of("Article", "BlogPosting").alias("is_article"), any_of("CollectionPage").alias("is_topic"), any_of("NewsArticle").alias("is_news"), any_of("Periodical", "Series").alias("is_newsletter"),
            last(title, items).alias("headline"),
        )

    return let(F.array_compact(F.transform(scripts, lambda s: F.try_parse_json(F.trim(s)))), run)


# ---- HF6 ----

RANGE = "struct<offset: int, length: int, style: string, key: string>"
BLOCKS = f"struct<blocks: array<struct<type: string, text: string, inlineStyleRanges: array<{RANGE}>, entityRanges: array<{RANGE}>>>>"
ENTITY = "struct<key: string, id: string, value: struct<data: struct<url: string>>, data: struct<url: string>>"
MARKS = {"b": ("<strong>", "</strong>", "**", "**"), "i": ("<em>", "</em>", "*", "*")}
HEADER_MOST = 120


def _units(text: Column, start: Column, size: Column) -> Column:
    """A part of a text in UTF-16 units, as ranges count."""
    return F.decode(F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * size), "UTF-16BE")


def _line(b: Column, link_of) -> Column:
    """struct(html, md) of a block: the text is cut where a range starts or ends, and marks are opened and closed as on a stack. A mark that
    ends below others closes them too, and those still wanted are opened again, so marks always nest."""
    text, none = b["text"], F.array().cast(f"array<{RANGE}>")
    size = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    styles, entities = F.coalesce(b["inlineStyleRanges"], none), F.coalesce(b["entityRanges"], none)
    begin = lambda r: F.coalesce(r["offset"], F.lit(0))
    end = lambda r: F.least(size, begin(r) + F.coalesce(r["length"], F.lit(0)))
    cuts = F.concat(F.array(F.lit(0), size), F.transform(F.concat(styles, entities), begin), F.transform(F.concat(styles, entities), end))
    cuts = F.array_sort(F.array_distinct(F.filter(cuts, lambda x: (x >= 0) & (x <= size))))

    def segment(k: Column, i: Column) -> Column:
        at = lambda r: (begin(r) <= k) & (end(r) > k)
        styled = lambda name: F.exists(styles, lambda r: at(r) & (F.lower(r["style"]) == name))
        links = F.filter(F.transform(F.filter(entities, at), lambda r: link_of(r["key"])), lambda u: u.isNotNull())
        url = F.try_element_at(links, F.lit(-1))
        want = F.array_compact(F.array(F.when(styled("bold"), "b"), F.when(styled("italic"), "i"), F.when(url.isNotNull(), F.concat(F.lit("l"), url))))
        return F.struct(_units(text, k, F.element_at(cuts, i + 2) - k).alias("text"), want.alias("want"))

    parts = let(cuts, lambda cs: F.transform(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))), segment))
    html_open = lambda m: F.coalesce(*[F.when(m == k, v[0]) for k, v in MARKS.items()], F.concat(F.lit('<a href="'), F.substring(m, 2, 1 << 20), F.lit('" target="_blank" rel="noopener noreferrer">')))
    html_close = lambda m: F.coalesce(*[F.when(m == k, v[1]) for k, v in MARKS.items()], F.lit("</a>"))
    md_open = lambda m: F.coalesce(*[F.when(m == k, v[2]) for k, v in MARKS.items()], F.lit("["))
    md_close = lambda m: F.coalesce(*[F.when(m == k, v[3]) for k, v in MARKS.items()], F.concat(F.lit("]("), F.substring(m, 2, 1 << 20), F.lit(")")))
    escaped = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    no_marks = F.array().cast("array<string>")

    def step(s: Column, p: Column) -> Column:
        # how many marks from the outside on stay open
        keep = F.aggregate(s["open"], F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, m: F.struct((a["n"] + F.when(a["on"] & F.array_contains(p["want"], m), 1).otherwise(0)).alias("n"), (a["on"] & F.array_contains(p["want"], m)).alias("on")))["n"]

        def go(n: Column) -> Column:
            kept, closed = F.slice(s["open"], 1, n), F.reverse(F.slice(s["open"], n + 1, F.size(s["open"])))
            opened = F.concat(F.filter(F.reverse(closed), lambda m: F.array_contains(p["want"], m)), F.filter(p["want"], lambda m: ~F.array_contains(s["open"], m)))
            join = lambda xs, f: F.array_join(F.transform(xs, f), "")
            return F.struct(
                F.concat(s["html"], join(closed, html_close), join(opened, html_open), escaped(p["text"])).alias("html"),
                F.concat(s["md"], join(closed, md_close), join(opened, md_open), p["text"]).alias("md"), F.concat(kept, opened).alias("open"),
            )

        return let(keep, go)

    start = F.struct(F.lit("").alias("html"), F.lit("").alias("md"), no_marks.alias("open"))
    finish = F.array(F.struct(F.lit("").alias("text"), no_marks.alias("want")))
    return F.aggregate(F.concat(parts, finish), start, step, lambda s: F.struct(s["html"].alias("html"), s["md"].alias("md")))


def draft_article(c: Column) -> Column:
    """HF6: struct(html, markdown, text, words, minutes) of a JSON text of blocks with style and entity ranges; null for what is no such JSON.

    Offsets count UTF-16 units. Overlapping ranges give marks that nest (the range that ends later is opened again), where a plain
    sweep would let them cross; of several links over one character the last range holds. Blank blocks are left out."""
    content = F.from_json(c, BLOCKS)
    by_list = F.from_json(F.get_json_object(c, "$.entityMap"), f"array<{ENTITY}>")
    by_name = F.from_json(F.get_json_object(c, "$.entityMap"), f"map<string, {ENTITY}>")
    url = lambda e: F.coalesce(F.nullif(e["value"]["data"]["url"], F.lit("")), F.nullif(e["data"]["url"], F.lit("")))

    def link_of(key: Column) -> Column:
        listed = F.try_element_at(F.filter(by_list, lambda e: (e["key"] == key) | (F.coalesce(e["id"], F.lit("")) == key)), F.lit(1))
        return F.coalesce(url(listed), url(F.try_element_at(by_name, key)))

    def rendered(b: Column) -> Column:
        kind, text = F.coalesce(b["type"], F.lit("unstyled")), b["text"]
        size = F.octet_length(F.encode(text, "UTF-16BE")) / 2
        whole_bold = F.exists(F.coalesce(b["inlineStyleRanges"], F.array().cast(f"array<{RANGE}>")), lambda r: (F.lower(r["style"]) == "bold") & (r["offset"] == 0) & (r["length"] >= size - 2)) & (size < HEADER_MOST)
        form = lambda h, m: F.struct(h.alias("html"), m.alias("md"), text.alias("text"))
        tag = lambda t, x, y="": F.concat(F.lit(f"<{t}>"), x, F.lit(f"</{t.replace('><', '></')}>" if not y else y))

        def lines(x: Column) -> Column:
            html, md = x["html"], x["md"]
            bare_md, bare_html = F.regexp_replace(md, r"^\*\*|\*\*$", ""), F.regexp_replace(html, r"^<strong>|</strong>$", "")
            return (
                F.when(kind.isin("header-one", "header-1"), form(tag("h2", html), F.concat(F.lit("## "), md)))
                .when(kind.isin("header-two", "header-2") | whole_bold, form(tag("h3", bare_html), F.concat(F.lit("### "), bare_md)))
                .when(kind == "blockquote", form(F.concat(F.lit("<blockquote><p>"), html, F.lit("</p></blockquote>")), F.concat(F.lit("> "), md)))
                .when(kind == "unordered-list-item", form(tag("li", html), F.concat(F.lit("- "), md)))
                .when(kind == "ordered-list-item", form(tag("li", html), F.concat(F.lit("1. "), md)))
                .when(kind == "code-block", form(F.concat(F.lit("<pre><code>"), html, F.lit("</code></pre>")), F.concat(F.lit("```\n"), text, F.lit("\n```"))))
                .otherwise(form(tag("p", html), md))
            )

        return let(_line(b, link_of), lines)

    blocks = F.filter(content["blocks"], lambda b: present(b["text"]).isNotNull())

    def told(xs: Column) -> Column:
        joined = lambda k, by: F.array_join(F.transform(xs, lambda x: x[k]), by)
        text = joined("text", "\n\n")
        return F.struct(joined("html", "\n").alias("html"), joined("md", "\n\n").alias("markdown"), text.alias("text"), word_count(text).alias("words"), reading_minutes(word_count(text)).alias("minutes"))

    return F.when(blocks.isNotNull(), let(F.transform(blocks, rendered), told))


# ---- HF9 ----

#: A script literal: strings, numbered assignments and references, and the rest.
CONTENT_STATE = r"content_state:(?:\$R\[[0-9]+\]=)?(?=\{)"


def content_state(html: Column) -> Column:
    """HF9: the content state of a server-rendered page as JSON text: numbered assignments go, a reference to a number stands for what was
    assigned to it where that is a string or number, names get quotes, !0 and !1 are true and false; null without one."""
    start = F.regexp_instr(html, F.lit(CONTENT_STATE))
    rest = F.when(start > 0, F.regexp_replace(F.substring(html, start, F.length(html)), r"^content_state:(?:\$R\[[0-9]+\]=)?", ""))

    def whole(text: Column) -> Column:
        first = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("closed"))

        def step(s: Column, t: Column) -> Column:
            depth = s["depth"] + F.when(t.isin("[", "{"), 1).when(t.isin("]", "}"), -1).otherwise(0)
            return F.when(s["closed"], s).otherwise(F.struct(depth.alias("depth"), (s["size"] + F.length(t)).alias("size"), (depth == 0).alias("closed")))

        return F.aggregate(F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)), first, step, lambda s: F.when(s["closed"], F.left(text, s["size"])))

    def as_json(text: Column) -> Column:
        # names of simple values: "$R[3]=\"x\"" is met before "$R[3]"
        named = F.regexp_extract_all(text, F.lit(r'\$R\[([0-9]+)\]=("(?:[^"\\]|\\.)*+"|-?[0-9.]+)'), F.lit(1))
        given = F.regexp_extract_all(text, F.lit(r'\$R\[([0-9]+)\]=("(?:[^"\\]|\\.)*+"|-?[0-9.]+)'), F.lit(2))
        pieces = F.regexp_extract_all(F.regexp_replace(text, r"\$R\[[0-9]+\]=", ""), F.lit(r'"(?:[^"\\]|\\.)*+"|\$R\[[0-9]+\]|[^"$]++|\$|"'), F.lit(0))

        def piece(p: Column) -> Column:
            number = F.regexp_extract(p, r"^\$R\[([0-9]+)\]", 1)
            value = F.coalesce(F.try_element_at(given, F.nullif(F.array_position(named, number), F.lit(0)).cast("int")), F.lit("null"))
            plain = F.regexp_replace(F.regexp_replace(p, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":'), r"\bvoid 0\b", "null")
            plain = F.replace(F.replace(plain, F.lit("!0"), F.lit("true")), F.lit("!1"), F.lit("false"))
            return F.when(p.startswith('"'), p).when(number != "", value).otherwise(plain)

        return F.array_join(F.transform(pieces, piece), "")

    return let(let(rest, whole), as_json)


def content_state_article(html: Column) -> Column:
    """HF9: as draft_article(); snake-case names of the payload are read as HF6's."""
    names = {"entity_map": "entityMap", "inline_style_ranges": "inlineStyleRanges", "entity_ranges": "entityRanges"}
    state = content_state(html)
    for a, b in names.items():
        state = F.replace(state, F.lit(f'"{a}":'), F.lit(f'"{b}":'))
    return let(state, draft_article)
