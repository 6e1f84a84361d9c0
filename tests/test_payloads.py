"""Scripts and nodes of pages against plain Python, beyond what the registered queries hold against SQL."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import payload
from skein.operators import dom, tiers


def escaped(text, levels):
    for _ in range(levels):
        text = text.replace("\\", "\\\\").replace('"', '\\"')
    return text


def test_array_items_equal_a_parser(spark):
    """Nested arrays with brackets, quotes and backslashes in strings, at three levels of escapes, whole and cut anywhere."""
    r = random.Random(7)
    odd = ["]", "[", "}", "{", '"', "\\", "a,b", ":", "é😀", " "]

    def value(depth):
        kind = r.randrange(4 if depth else 2)
        if kind == 0:
            return "".join(r.choices(odd, k=r.randrange(6)))
        if kind == 1:
            return r.choice([1, None, True, -2.5])
        if kind == 2:
            return [value(depth - 1) for _ in range(r.randrange(3))]
        return {f"k{i}": value(depth - 1) for i in range(r.randrange(3))}

    rows, want = [], {}
    for i in range(120):
        items = [{"node": value(3)} for _ in range(r.randrange(4))]
        levels = i % 3
        text = 'x "outer":{"n":1,"edges":' + json.dumps(items) + "} tail ] }"
        whole = i % 4 != 3
        if not whole:
            text = text[: r.randrange(text.index('"edges":') + 8, text.index(" tail") - 2)]
        rows.append((i, escaped(text, levels)))
        # whole elements of the array, by decoding one after the other
        got, at, decoder = [], text.index('"edges":') + 8, json.JSONDecoder()
        rest = text[at + 1 :] if len(text) > at else ""
        while True:
            rest = rest.lstrip(" ,")
            try:
                v, n = decoder.raw_decode(rest)
            except ValueError:
                break
            got.append(v)
            rest = rest[n:]
        want[i] = (got, whole) if len(text) > at else None
    d = spark.createDataFrame(rows, "id long, raw string").select("id", payload.array_items(F.col("raw"), "outer", "edges").alias("x"))
    for row in d.collect():
        x = row["x"]
        assert (None if x is None else ([json.loads(i) for i in x["items"]], x["closed"])) == want[row["id"]], rows[row["id"]]


def test_each_item_of_a_carousel_is_parsed_once(spark):
    """Expressions that read another one several times must not repeat it: their number would multiply with every step."""
    d = spark.createDataFrame([(1, "x")], "id long, raw string").select(payload.carousel(F.col("raw")).alias("m"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1 and plan.count("edge_sidecar_to_children") <= 3


def test_media_of_carousels(spark):
    rows = [
        '{"node": {"is_video": true, "video_url": " https://c.example/v.mp4 ", "display_url": "d"}}', '{"node": {"is_video": true, "video_url": "  ", "display_url": "d"}}', '{"node": {"is_video": false, "video_url": "v", "display_url": "d"}}',
        '{"node": {"is_video": "yes", "display_url": " "}}', '{"node": {"video_url": "v"}}', '{"node": 7}', "null", "no json", None,
    ]
    got = spark.createDataFrame([(rows,), (None,), ([],)], "items array<string>").coalesce(1).select(payload.media_of(F.col("items")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in got] == [[("video", "https://c.example/v.mp4"), ("image", "d"), ("image", "d")], [], []]


def test_keys_at_any_depth_equal_a_walk(spark):
    def walk(v, path="$"):
        if isinstance(v, dict):
            yield from ((f"{path}.{k}", x) for k, x in v.items() if k in ("a", "b"))
        for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()):
            yield from walk(x, f"{path}.{k}" if isinstance(v, dict) else f"{path}[{k}]")

    r = random.Random(9)
    value = lambda d: r.choice([1, "x", None]) if d == 0 else ({r.choice("abcd"): value(d - 1) for _ in range(3)} if r.random() < 0.6 else [value(d - 1) for _ in range(2)])
    rows = [(i, json.dumps(value(r.randrange(1, 7)))) for i in range(60)] + [(60, "[" * 5000 + "]" * 5000), (61, '{"a": ' * 30 + "1" + "}" * 30)]
    got = spark.createDataFrame(rows, "id long, raw string").select("id", payload.find_keys(F.col("raw"), "a", "b").alias("m"), F.size(payload.find_keys(F.col("raw"), "a", depth=9)).alias("few")).collect()
    for x in got:
        if x["id"] < 60:
            assert [(m["path"], json.loads(m["value"])) for m in x["m"]] == list(walk(json.loads(rows[x["id"]][1])))
    assert {x["id"]: (len(x["m"]), x["few"]) for x in got if x["id"] >= 60} == {60: (0, 0), 61: (30, 10)}


def test_timeline_media(spark):
    page = '<script type="application/json">{broken</script><script type="application/json">{"a":[{"polaris_timeline_connection":{"edges":[{"node":{"display_uri":"https://c.example/1.jpg"}},{"node":{"image_versions2":{"candidates":[{"url":"https://c.example/2.jpg"}]}}},{"node":{"display_uri":"https://c.example/1.jpg"}},{}]}}]}</script>'
    d = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "id long, html string").select("id", payload.timeline_media(F.col("html")).alias("m"))
    assert {r["id"]: r["m"] for r in d.collect()} == {1: ["https://c.example/1.jpg", "https://c.example/2.jpg"], 2: [], 3: []}


def test_drafts_of_random_ranges(spark):
    """Marks nest, and each character has just the marks of the ranges that cover it, in UTF-16 units."""
    r = random.Random(4)
    rows = []
    for i in range(80):
        text = "".join(r.choices("ab c😀é", k=r.randrange(1, 14)))
        n = len(text.encode("utf-16-be")) // 2
        cut = [k for k in range(n + 1) if not 0xDC00 <= int.from_bytes(text.encode("utf-16-be")[2 * k : 2 * k + 2] or b"\0\0", "big") < 0xE000]
        spans = [(a, b - a, r.choice(["BOLD", "italic", "Underline"])) for a, b in (sorted(r.choices(cut, k=2)) for _ in range(r.randrange(4)))]
        rows.append((i, text, spans))
    blocks = [(i, json.dumps({"blocks": [{"type": "header-one", "text": t, "inlineStyleRanges": [{"offset": o, "length": n, "style": s} for o, n, s in x]}]})) for i, t, x in rows]
    got = {x["id"]: x["a"] for x in spark.createDataFrame(blocks, "id long, raw string").select("id", payload.draft_article(F.col("raw")).alias("a")).collect()}
    for i, text, spans in rows:
        if not text.strip():
            assert got[i]["html"] == ""
            continue
        line = got[i]["html"].removeprefix("<h2>").removesuffix("</h2>")
        open_, seen, at = [], [], 0
        while at < len(line):
            if line[at] == "<":
                end = line.index(">", at)
                tag = line[at + 1 : end]
                if tag.startswith("/"):
                    assert open_.pop() == tag[1:], line
                else:
                    open_.append(tag)
                at = end + 1
            else:
                seen.append((line[at], {*open_}))
                at += 1
        assert not open_
        unit, want = 0, []
        for c in text:
            want.append((c, {"strong" if s == "BOLD" else "em" for o, n, s in spans if o <= unit < o + n and s != "Underline"}))
            unit += len(c.encode("utf-16-be")) // 2
        assert seen == want, (text, spans, line)


def test_nodes_are_intervals(spark):
    html = "<body><div id='a'>one<p>two<b>three</b></p><br>four</div><script>x<p></script><ul><li>1<li>2</ul></body>"
    rows = dom.nodes(spark.createDataFrame([(1, html, "x"), (2, None, "y"), (3, "", "z")], "page_id long, html string, node string")).collect()
    assert {r["page_id"] for r in rows} == {1}
    by = {r["node"]: r for r in rows}
    assert sorted(by) == list(range(1, len(rows) + 1))
    for r in rows:
        below = [x["node"] for x in rows if r["node"] in x["path"]]
        assert r["last"] == max(below, default=r["node"]) and set(below) == set(range(r["node"] + 1, r["last"] + 1))
        assert r["up"] == (r["path"][-1] if r["path"] else 0)
    assert [r["text"] for r in sorted(rows, key=lambda x: x["node"]) if r["tag"] == "#text"] == ["one", "two", "three", "four", "1", "2"]


def test_article_of_no_pages(spark):
    n = dom.nodes(spark.createDataFrame([(1, "")], "page_id long, html string"))
    assert dom.article(n).count() == 0 and dom.post_parts(n).count() == 0


@pytest.mark.parametrize("shared", [True, False])
def test_rivals_lift_the_container(spark, shared):
    """Four parts of one element that score alike make that element the container; alone, the best part is."""
    text = "Rivers carry silt, sand and stones from the hills down to the sea, and they do so all year, in flood and in drought."
    part = lambda k: f"<section><div><p>{text}</p><p>{text}</p></div></section>"
    page = f"<body><div id='wrap'>{''.join(part(k) for k in range(4 if shared else 1))}<span>x</span></div></body>"
    got = dom.article(dom.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))).first()
    assert got["content"].count(text) == (8 if shared else 2)


def test_key_data_that_is_lacking(spark):
    """Title, author, text, comment, media, media expected; upvotes, comments, icon; whether the page is needed, whether the embedded view is."""
    rows = [
        ("t", "ann", "text", False, 1, False, 3, None, "i.png", False, False), ("", "ann", "text", False, 1, False, 3, 1, "i.png", True, False), ("t", "x_user1", "text", False, 1, False, 3, 1, "i.png", True, True),
        ("t", "ann", "cut off...", False, 1, False, 3, 1, "i.png", True, True), ("t", "ann", None, False, 1, False, 3, 1, "i.png", False, True), ("t", "ann", None, False, 0, False, 3, 1, "i.png", True, True),
        ("t", "ann", "text", False, 0, True, 3, 1, "i.png", True, True), (None, "ann", "text", True, 0, False, 3, 1, "i.png", False, False), ("t", None, "text", True, 0, False, 3, 1, "i.png", True, True),
        ("t", "ann", "text", False, 1, False, 0, 0, "i.png", False, True), ("t", "ann", "text", False, 1, False, 3, 1, "https://ui-avatars.com/x", False, True), ("t", "ann", "text", False, 1, False, 3, 1, None, False, True),
    ]
    d = spark.createDataFrame(rows, "t string, a string, d string, c boolean, m int, e boolean, u int, n int, i string, page boolean, embed boolean")
    c = F.col
    got = d.select("page", tiers.reddit_lacks_key_data(c("t"), c("a"), c("d"), c("c"), c("m"), c("e")).alias("p"), "embed", tiers.reddit_wants_embed(c("a"), c("d"), c("u"), c("n"), c("i"), c("c"), c("m")).alias("q")).collect()
    assert [(r["p"], r["q"]) for r in got] == [(r["page"], r["embed"]) for r in got]
    x = spark.createDataFrame([("a", 1, 2, None), ("a", 1, None, 0), ("a", 1, None, None), ("a", None, 1, 1), (None, 1, 1, 1)], "a string, l int, r int, v int")
    assert [r[0] for r in x.select(tiers.x_is_complete(c("a"), c("l"), c("r"), c("v"))).collect()] == [True, True, False, False, False]
