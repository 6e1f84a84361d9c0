"""Stored pages to metadata records: P4-P9 and the generic extraction pipeline EX0 and EX1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import classify, html, net, text, url
from skein.functions.strings import first_present, present
from skein.operators.library import addresses, newest
from skein.session import ship

PASSWORD_INPUT = r"""(?is)<input\b[^>]*\b(?:type\s*=\s*["']?password\b|name\s*=\s*["']?[^"'>\s]*pass)"""
LOGIN_FORM = r"""(?is)<form\b[^>]*\baction\s*=\s*["']?[^"'>\s]*(?:login|auth|signin)"""
CODE_BLOCK = r"""(?is)<(?:pre|code)\b|<[a-z0-9]+\b[^>]*\bclass\s*=\s*["'](?:[^"']*\s)?(?:component|grid|preview)(?:\s[^"']*)?["']"""
LOGO_MARKS = ["redditstatic.com", "snoo", "icon", "avatar"]


def _both(name: str) -> tuple[str, str]:
    return f"name={name}", f"property={name}"


def parsed(pages: DataFrame, link: str = "url", source: str = "html") -> DataFrame:
    """HF1: pages with `found`: meta tags, links, JSON-LD, plain elements and counts, and `_article`, which costs nothing where no column is made of it. Tags come from
    patterns on the JVM; only the article's nesting needs the Arrow UDF, once a page."""
    ship(pages.sparkSession)
    d = pages.withColumn("_h", html.without_comments(F.col(source)))
    d = d.withColumn("_plain", F.regexp_replace("_h", r"(?is)<(script|style)\b.*?</\1\s*>", ""))
    d = d.withColumn("_article", html.article(F.col(source)))
    count = lambda p: html.element_count(F.col("_plain"), p)
    found = F.struct(
        html.metas(F.col("_h")).alias("metas"), html.links(F.col("_h")).alias("links"), html.json_ld(F.col("_h")).alias("ld"),
        html.element_text(F.col("_h"), "title").alias("title"), html.element_text(F.col("_plain"), "h1").alias("h1"), html.first_paragraph(F.col("_plain")).alias("p"),
        html.attribute(F.regexp_extract("_plain", r"(?is)<[a-z-]+\b[^>]*\scontent-href\s*=[^>]*>", 0), "content-href").alias("content_href"),
        count(PASSWORD_INPUT).alias("passwords"), count(LOGIN_FORM).alias("login_forms"), count(r"(?i)<input\b").alias("inputs"), count(r"(?i)<article\b").alias("articles"),
        count(CODE_BLOCK).alias("code_blocks"),
    )
    return d.withColumn("found", found).drop("_h", "_plain")


def metadata(d: DataFrame, link: str = "url", source: str = "html", json_ld: bool = True) -> DataFrame:
    """P4-P9, CF1: rows of parsed() with title, description, image, logo, site, author, published_at, type, author_avatar, intent,
    words, minutes, article, link_density and blocked. Blocked pages have none of them. json_ld=False: the rendered tier's rules."""
    f, u = F.col("found"), F.col(link)
    metas, ld = f["metas"], f["ld"]
    m = lambda *names: html.meta(metas, *names)
    of_ld = lambda k: ld[k] if json_ld else F.lit(None).cast("string")
    title = text.clean_title(F.coalesce(m(*_both("twitter:title")), m("property=og:title", "name=og:title"), m(*_both("title")), of_ld("title"), f["title"], f["h1"]), paired=True)
    first_p = F.when(F.length(f["p"]) > 20, F.left(f["p"], F.lit(300)))
    description = text.clean_description(F.coalesce(m(*_both("twitter:description")), m("property=og:description", "name=og:description"), m(*_both("description")), of_ld("description"), first_p), paired=True)
    image = F.coalesce(
        m("property=og:image", "name=og:image", "property=og:image:secure_url", "name=og:image:secure_url"), m(*_both("twitter:image"), *_both("twitter:image:src")), m(*_both("image")), of_ld("image")
    )
    on_reddit = F.lower(u).contains("reddit.com")
    image = F.coalesce(F.when(on_reddit, url.resolve_url(f["content_href"], u)), url.resolve_url(image, u))
    image = F.when(~(on_reddit & F.lower(image).rlike("|".join(x.replace(".", r"\.") for x in LOGO_MARKS))), image)
    logo = F.coalesce(
        m(*_both("twitter:logo"), "name=twitter:app:icon:iphone", "name=twitter:app:icon:googleplay"), m("property=logo", "name=logo"), m("property=og:logo", "name=og:logo"),
        html.link(f["links"], "apple-touch-icon"), html.link(f["links"], "icon"), html.link(f["links"], "shortcut"),
    )
    published_meta = m("property=article:published_time")
    article_meta = (F.coalesce(m("property=og:type"), F.lit("")) == "article") | F.coalesce(of_ld("type").rlike("(?i)article|blogposting"), F.lit(False)) | published_meta.isNotNull() | m("name=article:author", "property=article:author").isNotNull()
    words = F.coalesce(F.col("_article")["words"], F.lit(0))
    d = d.withColumn("title", title).withColumn("description", description)
    wall = classify.is_login_wall(F.col("title"), F.col("description")) | (F.lower(F.coalesce("title", F.lit(""))) == "login")
    d = d.withColumn("title", F.when(~wall, F.col("title"))).withColumn("description", F.when(~wall, F.col("description")))
    d = d.withColumn("blocked", F.col(source).isNull() | text.is_access_denied(F.col("title"), F.col("description"), F.col(source)))
    kept = lambda c: F.when(~F.col("blocked"), c)
    return d.select(
        *[c for c in d.columns if c not in ("title", "description", "found", "_article", source)], kept(F.col("title")).alias("title"), kept(F.col("description")).alias("description"),
        kept(image).alias("image"), F.coalesce(kept(url.resolve_url(logo, u)), url.resolve_url(F.lit("/favicon.ico"), u)).alias("logo"), kept(m("property=og:site_name")).alias("site"),
        kept(first_present(F.coalesce(m("name=author", "property=article:author", "name=twitter:creator"), of_ld("author")))).alias("author"),
        kept(first_present(F.coalesce(published_meta, m("name=pubdate", "name=date"), of_ld("published")))).alias("published_at"),
        kept(F.coalesce(present(F.coalesce(m("property=og:type"), of_ld("type"))), F.lit("website"))).alias("type"), kept(url.resolve_url(of_ld("avatar"), u)).alias("author_avatar"),
        kept(classify.page_intent(u, f["passwords"], f["login_forms"], f["inputs"], article_meta, f["articles"], f["code_blocks"], words)).alias("intent"),
        kept(words).alias("words"), kept(F.coalesce(F.col("_article")["minutes"], F.lit(0))).alias("minutes"), kept(F.col("_article")["content"]).alias("article"),
        kept(F.coalesce(F.col("_article")["link_density"], F.lit(0.0))).alias("link_density"),
    )


RECORD = ["title", "description", "image", "logo", "site", "author", "published_at", "type", "intent", "words", "minutes", "article"]


def merged_tiers(static: DataFrame, rendered: DataFrame, link: str = "url") -> DataFrame:
    """The static record where it is usable, else the rendered one field by field before the static one."""
    r = rendered.select(F.col(link).alias("_link"), F.col("blocked").alias("_blocked"), *[F.col(c).alias(f"_{c}") for c in RECORD])
    d = static.join(r, F.col(link) == F.col("_link"), "left")
    usable = ~F.col("blocked") & F.coalesce("title", "description", "image").isNotNull()
    take = lambda c: F.when(usable | F.coalesce("_blocked", F.lit(True)), F.col(c)).otherwise(F.coalesce(f"_{c}", c))
    return d.select(*[take(c).alias(c) if c in RECORD else F.col(c) for c in static.columns])


def extract(pages: DataFrame, rendered: DataFrame | None = None, dns: DataFrame | None = None, cached: DataFrame | None = None) -> DataFrame:
    """EX0, EX1, ST6, ST7: one record for each canonical link of pages (page_id, url, html), that of the largest page_id.

    Pages without page_id give no record and stand for no link. Unsafe links give no record: internal hosts, and with a dns table (host, ip) also those without an address or with one that is not public. rendered
    (url, html) is the tier for pages whose own HTML is unusable. cached (canonical) holds links that need no new record.
    `admitted`: whether the record may be cached."""
    u = F.col("url")
    d = pages.select("page_id", u, "html").withColumn("host", url.host_of(u)).where(F.col("page_id").isNotNull() & F.col("host").isNotNull() & ~net.is_internal_host(F.col("host")) & (F.length(u) <= net.MAX_URL))
    if dns is not None:
        known = addresses(dns).where("not any_private").select("host")
        d = d.join(known, "host", "left_semi")
    d = d.withColumn("canonical", F.coalesce(F.nullif(url.canonical_url(u), F.lit("")), u))
    if cached is not None:
        d = d.join(cached.select("canonical").distinct(), "canonical", "left_anti")
    d = metadata(parsed(d))
    if rendered is not None:
        d = merged_tiers(d, metadata(parsed(rendered.select("url", "html")), json_ld=False))
    d = newest(d, ["canonical"], ["page_id"])  # records are much smaller than pages, so they are what is shuffled
    # HF3: long enough and not mostly links
    readable = (F.col("words") >= 80) & (F.col("link_density") <= 0.55)
    admitted = ~F.col("blocked") & ~text.is_access_denied(F.col("title"), F.col("description"), F.lit(None).cast("string")) & F.coalesce("title", "description").isNotNull()
    return d.select(
        "page_id", "canonical", "url", url.platform(u).alias("platform"), F.coalesce("title", url.fallback_title(u)).alias("title"), F.coalesce("description", F.lit("")).alias("description"), "image", "logo",
        url.site_name(u, F.col("site")).alias("site_name"), "author", "published_at", F.when(readable, F.lit("article")).otherwise(F.coalesce("type", F.lit("website"))).alias("type"),
        F.when(readable, F.lit("article")).otherwise(F.col("intent")).alias("page_intent"), F.col("words").cast("long").alias("word_count"), F.col("minutes").cast("long").alias("reading_time_minutes"),
        F.col("article").alias("article_content"), F.coalesce(admitted, F.lit(False)).alias("admitted"),
    )


def card(d: DataFrame) -> Column:
    """The payload of a generic record."""
    return F.struct("author", "published_at", F.col("site_name"), F.col("type"), F.col("image").alias("snapshot"), "page_intent", F.col("article_content"), "word_count", "reading_time_minutes")
