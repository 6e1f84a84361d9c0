"""Pages as tables of nodes, and what needs the nesting of elements: HF3's choice of an article's container and HF8's main post.

nodes() gives a row a node, numbered in document order. A node's subtree is the interval from `node` to `last`, so "inside", "ancestor" and
"removed with its parent" are comparisons and running maxima, and sums over subtrees are sums over exploded paths. Only the
parser is Python; scores, climbing and siblings are joins, groups and windows by page.

Defined cases: a null or empty page has no nodes and no article; ties go to the node that comes first; a page without any scored
paragraph has its body as container; repeated keys are told apart only by the caller's key, which must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.html import _Node, _Parser
from skein.session import materialize, ship

#: Elements whose text is not shown.
SILENT = {"script", "style", "noscript", "template"}
#: Elements that stand on lines of their own.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dt", "dd", "figcaption", "div", "section", "article", "main", "body", "aside", "header", "footer", "nav", "form", "ul", "ol", "table", "tr"}

#: What is taken off a page before its article is looked for.
NOISE_TAGS = ["aside", "nav"]
NOISE_ROLES = ["navigation", "menubar", "complementary"]
NOISE_CLASSES = ["sidebar-menu", "sidebar-group", "sidebar-content", "table-of-contents", "toc-", "on-this-page", "pagination", "breadcrumb", "cookie", "newsletter"]
NOISE_IDS = ["cookie", "newsletter"]
BODY_NOISE = ["header", "footer"]
#: Fixed values of the published reader-view method: names that speak against and for content, weights and limits.
UNLIKELY = r"(?i)-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote"
MAYBE = r"(?i)and|article|body|column|content|main|shadow"
POSITIVE = r"(?i)article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story"
NEGATIVE = r"(?i)-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget"
UNLIKELY_ROLES = ["menu", "menubar", "complementary", "navigation", "alert", "alertdialog", "dialog"]
PARAGRAPHS = ["section", "h2", "h3", "h4", "h5", "h6", "p", "td", "pre"]
BLOCK_CHILDREN = {"blockquote", "dl", "div", "img", "ol", "p", "pre", "table", "ul"}
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
CLASS_WEIGHT, LEAST_PARAGRAPH, LEVELS, RIVALS, RIVAL_SHARE, RIVALS_MEET, LEAST_ARTICLE = 25, 25, 5, 5, 0.75, 3, 150

SCHEMA = "node int, last int, up int, depth int, kids int, tag string, up_tag string, id string, class string, role string, attrs map<string, string>, path array<int>, text string, in_link boolean, block int, holds_blocks boolean"


def _rows(root: _Node) -> Iterator[tuple]:
    """The nodes below the root in document order, without recursion; texts are nodes of their own."""
    out: list[list] = []
    stack = [(k, [], "", False, 0) for k in root.kids[::-1]]
    open_: list[tuple[int, int]] = []  # row and depth of what may still get a later `last`
    while stack:
        n, path, up_tag, link, block = stack.pop()
        node = len(out) + 1
        while open_ and open_[-1][1] >= len(path):
            out[open_.pop()[0]][1] = node - 1
        up = path[-1] if path else 0
        if isinstance(n, str):
            out.append([node, node, up, len(path), 0, "#text", up_tag, None, None, None, None, path, n, link, block, False])
            continue
        kids = [] if n.tag in SILENT else n.kids
        a = {k: v or "" for k, v in n.attrs.items()}
        out.append([node, node, up, len(path), sum(isinstance(k, _Node) for k in kids), n.tag, up_tag, a.get("id"), a.get("class"), a.get("role"), a, path, None, link, block, any(isinstance(k, _Node) and k.tag in BLOCK_CHILDREN for k in kids)])
        open_.append((node - 1, len(path)))
        below = [*path, node]
        stack.extend((k, below, n.tag, link or n.tag == "a", node if n.tag in LINES else block) for k in kids[::-1])
    for i, _ in open_:
        out[i][1] = len(out)
    return map(tuple, out)


def nodes(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """HF1: key and the node's columns. A page's rows lie together, in the task that read it."""
    ship(pages.sparkSession)
    kind = pages.select(key)
    types = [pa.int32()] * 5 + [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.list_(pa.int32()), pa.string(), pa.bool_(), pa.int32(), pa.bool_()]
    names = ["node", "last", "up", "depth", "kids", "tag", "up_tag", "id", "class", "role", "attrs", "path", "text", "in_link", "block", "holds_blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, html in enumerate(b.column(1).to_pylist()):
                parser = _Parser()
                parser.feed(html or "")
                parser.close()
                rows = list(_rows(parser.root))
                if rows:
                    keys = b.column(0).take(pa.array([i] * len(rows)))
                    cols = [[list(x.items()) if isinstance(x, dict) else x for x in c] for c in zip(*rows, strict=True)]
                    yield pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[key, *names])

    return pages.select(key, source).mapInArrow(run, f"{key} {kind.schema[0].dataType.simpleString()}, {SCHEMA}")


def _contains(c: Column, words: list[str]) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(c, w)), F.lit(False))


def without(n: DataFrame, bad: Column, key: str) -> DataFrame:
    """Nodes that are not bad and not inside a bad one: an earlier bad node whose interval reaches the node holds it."""
    before = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.withColumn("_reach", F.max(F.when(F.coalesce(bad, F.lit(False)), F.col("last"))).over(before)).where("_reach IS NULL OR _reach < node").drop("_reach")


def noise() -> Column:
    """Navigation, side columns, notices, and the page's own header and footer."""
    side = (F.col("attrs")["data-slot"] == "sidebar") | F.col("attrs")["data-sidebar"].isNotNull()
    at_body = F.col("tag").isin(BODY_NOISE) & (F.col("up_tag") == "body")
    listed = F.col("tag").isin(NOISE_TAGS) | F.coalesce(F.col("role").isin(NOISE_ROLES), F.lit(False)) | F.coalesce(side, F.lit(False))
    return listed | _contains(F.col("class"), NOISE_CLASSES) | _contains(F.col("id"), NOISE_IDS) | at_body | (F.col("tag") == "head")


def unlikely() -> Column:
    named = F.concat_ws(" ", "class", "id")
    by_name = named.rlike(UNLIKELY) & ~named.rlike(MAYBE) & ~F.col("tag").isin("html", "body", "a", "#text")
    return by_name | F.coalesce(F.col("role").isin(UNLIKELY_ROLES), F.lit(False))


def measured(n: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Texts, and elements with the characters, commas and characters in links of their subtrees."""
    texts = n.where("tag = '#text'").withColumn("text", F.regexp_replace("text", r"\s+", " ")).where("trim(text) <> ''")
    size = F.length("text")
    stop = F.regexp_extract("text", r"\.( |$)", 0) != ""
    each = texts.select(
        key, F.explode("path").alias("node"), F.col("node").alias("at"), size.alias("chars"), (size - F.length(F.replace("text", F.lit(","), F.lit("")))).alias("commas"), F.when(F.col("in_link"), size).otherwise(0).alias("linked"), stop.alias("stop")
    )
    sums = each.groupBy(key, "node").agg(*[F.sum(c).alias(c) for c in ("chars", "commas", "linked")], F.max_by("stop", "at").alias("stop"))
    e = n.where("tag <> '#text'").drop("text", "in_link").join(sums, [key, "node"], "left")
    e = e.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chars", "commas", "linked")})
    plain = (F.col("tag") == "div") & ~F.col("holds_blocks")
    return texts, e.withColumn("paragraph", (F.col("tag") == "p") | plain).withColumn("density", F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0))


def scored(e: DataFrame, key: str) -> DataFrame:
    """key, node and score of the elements above paragraphs: a paragraph's points go to its parent, half to the next, then 1 in 3 times the level."""
    points = 2 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3))
    p = e.where((F.col("tag").isin(PARAGRAPHS) | F.col("paragraph")) & (F.col("chars") >= LEAST_PARAGRAPH))
    up = p.select(key, points.alias("points"), F.posexplode(F.slice(F.reverse("path"), 1, LEVELS)).alias("level", "node"))
    share = F.col("points") / F.when(F.col("level") == 0, 1).when(F.col("level") == 1, 2).otherwise(3 * F.col("level"))
    up = up.groupBy(key, "node").agg(F.sum(share).alias("given"))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in BASE.items() for x in (k, v)]), F.col("tag")), F.lit(0))
    named = lambda c: F.when(F.col(c).rlike(NEGATIVE), -CLASS_WEIGHT).otherwise(0) + F.when(F.col(c).rlike(POSITIVE), CLASS_WEIGHT).otherwise(0)
    return e.where("tag <> 'html'").join(up, [key, "node"]).select(key, "node", "path", ((F.col("given") + base + named("class") + named("id")) * (1 - F.col("density"))).alias("score"))


def containers(e: DataFrame, s: DataFrame, key: str) -> DataFrame:
    """key, top (a node) and score: the best element, or one above it that several good ones share or that scores better."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "node"))
    first = s.withColumn("rank", rank).where(F.col("rank") <= RIVALS)
    best = first.where("rank = 1").select(key, F.col("node").alias("best"), F.col("score").alias("best_score"), F.col("path").alias("best_path"))
    # an ancestor of the best that enough rivals of nearly its score share
    rivals = first.where("rank > 1").join(best, key).where(F.col("score") >= RIVAL_SHARE * F.col("best_score"))
    shared = rivals.select(key, F.explode(F.array_intersect("path", "best_path")).alias("node")).groupBy(key, "node").agg(F.count("*").alias("n")).where(F.col("n") >= RIVALS_MEET)
    shared = shared.join(e.where("tag NOT IN ('html', 'body')").select(key, "node"), [key, "node"]).groupBy(key).agg(F.max("node").alias("shared"))
    # the way up: parents that score better, as long as none falls below a third; then parents of an only child
    above = best.select(key, F.explode("best_path").alias("node")).join(e.select(key, "node", "tag", "kids"), [key, "node"]).join(s.drop("path"), [key, "node"], "left")
    way = above.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("node", "tag", "kids", "score")))).alias("way"))
    d = best.join(way, key, "left").join(shared, key, "left").withColumn("way", F.coalesce("way", F.array()))
    start = F.struct(F.lit(False).alias("done"), F.col("best_score").alias("reached"), F.coalesce("shared", "best").alias("at"))
    low = F.col("best_score") / 3

    def climb(st: Column, a: Column) -> Column:
        stop = st["done"] | a["tag"].isin("html", "body") | F.coalesce(a["score"] < low, F.lit(False))
        better = F.coalesce(a["score"] > st["reached"], F.lit(False)) & (a["node"] < st["at"])
        return F.when(stop, F.struct(F.lit(True).alias("done"), st["reached"].alias("reached"), st["at"].alias("at"))).otherwise(
            F.struct(better.alias("done"), F.coalesce(a["score"], st["reached"]).alias("reached"), F.when(better, a["node"]).otherwise(st["at"]).alias("at"))
        )

    def only(st: Column, a: Column) -> Column:
        go = st["open"] & ~a["tag"].isin("html", "body") & (a["kids"] == 1)
        skip = a["node"] >= st["at"]
        return F.when(skip, st).otherwise(F.struct(go.alias("open"), F.when(go, a["node"]).otherwise(st["at"]).alias("at")))

    d = d.withColumn("at", F.aggregate("way", start, climb)["at"])
    d = d.withColumn("top", F.aggregate("way", F.struct(F.lit(True).alias("open"), F.col("at").alias("at")), only)["at"])
    return d.select(key, "top", "best_score")


def _articles(n: DataFrame, key: str) -> DataFrame:
    # each is read several times, so it is written once
    texts, e = (materialize(d, "nodes") for d in measured(materialize(n, "nodes"), key))
    s = materialize(scored(e, key), "scores")
    top = containers(e, s, key)
    body = e.where("tag = 'body'").groupBy(key).agg(F.min("node").alias("body"))
    top = body.join(top, key, "left").select(key, F.coalesce("top", "body").alias("top"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
    own = e.select(key, F.col("node").alias("top"), F.col("up").alias("top_up"), F.col("tag").alias("container"), F.col("class").alias("top_class"))
    top = top.join(own, [key, "top"])
    beside = e.join(top, key).where("up = top_up").join(s.drop("path"), [key, "node"], "left")
    bonus = F.when((F.col("class") == F.col("top_class")) & (F.col("class") != ""), 0.2 * F.col("best_score")).otherwise(0.0)
    good = F.coalesce(F.col("score") + bonus >= F.greatest(F.lit(10.0), 0.2 * F.col("best_score")), F.lit(False))
    text_like = F.col("paragraph") & (((F.col("chars") > 80) & (F.col("density") < 0.25)) | (F.col("chars").between(1, 80) & (F.col("linked") == 0) & F.coalesce("stop", F.lit(False))))
    parts = beside.where((F.col("node") == F.col("top")) | good | text_like).select(key, "top", "container", "best_score", F.col("node").alias("from"), F.col("last").alias("to"))
    inside = texts.join(parts, key).where((F.col("node") >= F.col("from")) & (F.col("node") <= F.col("to")))
    lines = inside.groupBy(key, "block").agg(
        F.array_sort(F.collect_list(F.struct("node", "text"))).alias("x"), F.sum(F.length("text")).alias("chars"), F.sum(F.when(F.col("in_link"), F.length("text")).otherwise(0)).alias("linked")
    )
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.concat_ws("", F.transform("x", lambda p: p["text"])), " +", " ")))
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("x")[0]["node"].alias("at"), "line"))).alias("lines"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    count = parts.groupBy(key, "top", "container", "best_score").agg(F.count("*").alias("parts"))
    return count.join(whole, key).select(
        key, F.col("top").alias("node"), "container", F.col("best_score").alias("score"), "parts", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("content"), "chars", (F.col("linked") / F.col("chars")).alias("link_density")
    )


def article(n: DataFrame, key: str = "page_id") -> DataFrame:
    """HF3: container (node and tag), its score, how many parts were joined, content, words, reading minutes, link density and whether it reads as an article.

    Pages that have elements of unlikely names are tried without and with them: the second try holds where the first leaves under 150
    characters. n: nodes(), materialized, since it is read several times."""
    n = without(n, noise(), key)
    both = F.max(unlikely()).over(Window.partitionBy(key))
    n = n.withColumn("_both", both).withColumn("_try", F.explode(F.when(F.col("_both"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).withColumn("_page", F.struct(key, "_try"))
    d = _articles(without(n, unlikely() & (F.col("_try") == 1), "_page").drop(key, "_try", "_both"), "_page")
    late = F.when(F.col("chars") >= LEAST_ARTICLE, 0).otherwise(1) * (3 - F.col("_page._try")) + F.col("_page._try")
    d = d.groupBy(F.col("_page")[key].alias(key)).agg(F.min_by(F.struct(*[c for c in d.columns if c != "_page"]), late).alias("x")).select(key, "x.*")
    words = F.size(F.filter(F.split("content", r"\s+"), lambda w: w != "")).cast("long")
    d = d.withColumn("words", words)
    return d.withColumn("minutes", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / 200))).withColumn("readable", (F.col("words") >= 80) & (F.col("link_density") <= 0.55)).drop("chars")


#: Where a post stands, in this order, and what marks posts beside it.
POST_CARDS = ["main-feed-activity-card-with-comments", "main-feed-activity-card"]
SHARED_CARD = "feed-shared-update-v2"
RELATED = "related-posts"


def _has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split("class", r"\s+"), name), F.lit(False))


def related() -> Column:
    """Posts beside the main one."""
    return F.coalesce(F.contains(F.col("class"), F.lit(RELATED)), F.lit(False)) | F.coalesce(F.contains(F.col("attrs")["data-test-id"], F.lit("related")), F.lit(False))


def main_post(n: DataFrame, key: str = "page_id") -> DataFrame:
    """HF8: key, post (a node), post_last and rule (0 an article, 1 an activity card, 2 a shared update, 3 any article, 4 main, 5 body)."""
    apart = ~F.coalesce(F.contains(F.col("class"), F.lit(RELATED)), F.lit(False))
    rules = [(F.col("tag") == "article") & apart, _has_class(POST_CARDS[0]) | (_has_class(POST_CARDS[1]) & apart), _has_class(SHARED_CARD), F.col("tag") == "article", F.col("tag") == "main", F.col("tag") == "body"]
    rule = F.coalesce(*[F.when(c, i) for i, c in enumerate(rules)])
    d = n.withColumn("rule", rule).where("rule IS NOT NULL")
    return d.groupBy(key).agg(F.min(F.struct("rule", "node", "last")).alias("x")).select(key, F.col("x.node").alias("post"), F.col("x.last").alias("post_last"), F.col("x.rule").alias("rule"))


def in_main_post(n: DataFrame, key: str = "page_id") -> DataFrame:
    """The nodes of the main post without those of related posts, with `post` and `rule`."""
    post = main_post(n, key).withColumnRenamed(key, "_key")
    own = F.col(key).eqNullSafe(F.col("_key"))  # a page without a key has its post too
    return without(n, related(), key).join(post, own).where((F.col("node") >= F.col("post")) & (F.col("node") <= F.col("post_last"))).drop("_key")


def post_parts(n: DataFrame, key: str = "page_id") -> DataFrame:
    """key, rule, text of the main post, and its images in order without repeats."""
    d = in_main_post(n, key)
    piece = F.when(F.col("tag") == "#text", F.trim(F.regexp_replace("text", r"\s+", " ")))
    source = F.when(F.col("tag") == "img", F.coalesce(F.nullif(F.col("attrs")["src"], F.lit("")), F.col("attrs")["data-delayed-url"], F.col("attrs")["data-src"]))
    d = d.withColumn("piece", F.when(piece != "", piece)).withColumn("source", source)
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("node", "piece")))), lambda x: x["piece"])
    images = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("node", "source")))), lambda x: x["source"]))
    return d.groupBy(key, "rule").agg(F.array_join(texts, " ").alias("text"), images.alias("images"))
