"""The library of saved links as relations: lists, look-ups, upserts, deletes, plans. Every statement is set-oriented: a request is a
row, and all requests of a batch are answered by one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.net import is_private_ip
from skein.functions.strings import first_present, let, present, wide_trim
from skein.functions.url import linkedin_post_id, url_variants


#: Up to this many bytes are sent to every task.
SEND_BYTES = 16 << 20


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`. An aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*keys, *[F.col("best")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; of several new ones the newest counts."""
    return newest(old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), keys, ["_new", *order]).drop("_new")


def updated(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Df with the non-null values of `changes` (one row a key)."""
    c = changes.select(F.col(key).alias("_key"), *[F.col(x).alias(f"_{x}") for x in changes.columns if x != key])
    return df.join(c, F.col(key) == F.col("_key"), "left").select(*[F.coalesce(F.col(f"_{x}"), F.col(x)).alias(x) if x != key and x in changes.columns else F.col(x) for x in df.columns])


def deleted(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Df without the rows whose keys are in `gone`."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_context(bookmarks: DataFrame, ai_context: DataFrame) -> DataFrame:
    """Bookmarks with the newest analysis of each."""
    one = newest(ai_context, ["bookmark_id"], ["updated_at"]).select("bookmark_id", F.struct("context", "ai_category", "ai_tags", "visual_entities", "ocr_text").alias("ai"))
    return bookmarks.join(one, bookmarks["id"] == one["bookmark_id"], "left").drop("bookmark_id")


def served(df: DataFrame) -> DataFrame:
    """Rows of with_context() as they are served: defaults for missing fields, and a status that counts any analysis."""
    ai, none = F.col("ai"), F.array().cast("array<string>")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    analysed = F.coalesce(filled(ai["context"]) | some(ai["ai_category"]) | some(ai["ai_tags"]) | filled(ai["ocr_text"]), F.lit(False))
    snapshot = F.coalesce(F.nullif("snapshot_url", F.lit("")), F.get_json_object("card_data", "$.snapshot"))
    return df.select(
        "id", "user_id", "url", F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), present(F.col("description")).alias("description"),
        F.nullif("logo_url", F.lit("")).alias("logo"), snapshot.alias("snapshot"), F.coalesce("site_name", F.lit("")).alias("site_name"),
        F.coalesce(F.nullif("type", F.lit("")), F.lit("generic")).alias("type"), F.coalesce("is_article", F.lit(False)).alias("is_article"),
        F.when(analysed, F.lit("completed")).otherwise(F.coalesce(F.nullif("ai_status", F.lit("")), F.lit("pending_manual"))).alias("ai_status"), "created_at",
        F.nullif(ai["context"], F.lit("")).alias("ai_context"), F.coalesce(ai["ai_category"], none).alias("ai_category"), F.coalesce(ai["ai_tags"], none).alias("ai_tags"),
        F.coalesce(ai["visual_entities"], none).alias("visual_entities"), F.coalesce(ai["ocr_text"], F.lit("")).alias("ocr_text"),
    )


def newest_shortlinks(bookmarks: DataFrame, mark: str = "lnkd.in", most: int = 10) -> DataFrame:
    """Each user's newest bookmarks of short links. The ranks are limited before the shuffle, so a user with many stays cheap."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return bookmarks.where(F.lower("url").contains(mark)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def inserted(old: DataFrame, records: DataFrame, at: Column) -> DataFrame:
    """Old with new rows (id and the fields of a record) in the form in which they are stored: blanks of optional fields are null."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    empty = {"logo_url": blank("logo_url"), "snapshot_url": blank("snapshot_url"), "card_data": F.when(F.col("card_data") != "{}", F.col("card_data")), "created_at": at}
    return old.unionByName(records.select(*[empty.get(c, F.col(c)).alias(c) if c in empty else F.col(c) for c in old.columns]))


def inserted_articles(old: DataFrame, bookmarks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Old with the extracted articles (bookmark_id, content_html, ...) of bookmarks that are articles."""
    owners = bookmarks.where("is_article").select(F.col("id").alias("bookmark_id"), "user_id")
    new = extracted.join(owners, "bookmark_id").withColumn("content_markdown", F.nullif("content_markdown", F.lit("")))
    return old.unionByName(new.select(*old.columns))


def requested(bookmarks: DataFrame, requests: DataFrame) -> DataFrame:
    """The bookmark of every request (request_id, id, user_id), if it is that user's."""
    return requests.join(bookmarks, ["id", "user_id"])


def article_html(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id and the article's HTML; null without an article."""
    a = articles.select(F.col("bookmark_id").alias("_id"), "content_html")
    return requests.join(a, F.col("id") == F.col("_id"), "left").select("request_id", "content_html")


def page_bounds(limit: Column, offset: Column) -> tuple[Column, Column]:
    """P20: limit 250 if it is no number, else 1 to 500; offset 0 if it is no number, at least 0."""
    number = lambda c: F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1), F.lit("")).try_cast("long")
    return F.least(F.lit(500), F.greatest(F.lit(1), F.coalesce(number(limit), F.lit(250)))), F.greatest(F.lit(0), F.coalesce(number(offset), F.lit(0)))


def list_page(bookmarks: DataFrame, user_id, limit: int = 250, offset: int = 0) -> DataFrame:
    """One user's page, newest first, ties by id."""
    return bookmarks.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def existing(requests: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """For every request (request_id, user_id, url) the newest bookmark of that user whose link is one of the
    request's variants or holds the same LinkedIn post number; null if there is none."""
    keys = lambda url, many: F.concat(F.transform(many, lambda u: F.concat(F.lit("u:"), u)), F.array_compact(F.array(F.concat(F.lit("p:"), linkedin_post_id(url)))))
    asked = requests.select("request_id", "user_id", F.explode(F.array_distinct(keys(F.col("url"), url_variants(F.col("url"))))).alias("key"))
    have = bookmarks.select(F.col("id").alias("bookmark_id"), "user_id", "created_at", F.explode(keys(F.col("url"), F.array(F.col("url")))).alias("key"))
    found = asked.join(have, ["user_id", "key"]).groupBy("request_id").agg(F.max_by("bookmark_id", F.struct("created_at", "bookmark_id")).alias("bookmark_id"))
    return requests.select("request_id", "user_id", "url").join(found, "request_id", "left")


def reusable(requests: DataFrame, bookmarks: DataFrame, key: str = "url") -> DataFrame:
    """For every requested link the newest completed bookmark of any user."""
    done = newest(bookmarks.where("ai_status = 'completed'").select(key, "created_at", "id"), [key], ["created_at", "id"]).select(key, F.col("id").alias("reuse_id"))
    return requests.join(done, key, "left")


def reader_view(articles: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Stored articles with what their bookmarks tell."""
    b = bookmarks.select(F.col("id").alias("bookmark_id"), "url", "title", "site_name", "logo_url")
    return articles.join(b, "bookmark_id", "left").select(
        "bookmark_id", "url", F.coalesce(F.nullif("title", F.lit("")), F.col("url")).alias("title"), F.coalesce("site_name", F.lit("")).alias("site_name"), "logo_url",
        "content_html", "content_markdown", "word_count", "reading_time_minutes",
    )


FREE_LIMIT, UNLIMITED = 6, 999999


def subscriptions(users: DataFrame, subs: DataFrame, now: Column, key: str = "user_id") -> DataFrame:
    """Every user's plan; a free one for users without, credits reset where the week is over."""
    s = subs.select(F.col(key).alias("_key"), "plan", "ai_credits_limit", "ai_credits_used", "credits_reset_at", "trial_ends_at", "auto_ai_context")
    d = users.select(key).join(s, F.col(key) == F.col("_key"), "left")
    over = now >= F.col("credits_reset_at")
    week = now + F.expr("interval 7 days")
    return d.select(
        key, F.coalesce("plan", F.lit("free")).alias("plan"), F.coalesce("ai_credits_limit", F.lit(FREE_LIMIT)).cast("long").alias("ai_credits_limit"),
        F.when(over, F.lit(0)).otherwise(F.coalesce("ai_credits_used", F.lit(0))).cast("long").alias("ai_credits_used"),
        F.when(over | F.col("credits_reset_at").isNull(), week).otherwise(F.col("credits_reset_at")).alias("credits_reset_at"),
        F.when(F.col("_key").isNull(), now + F.expr("interval 30 days")).otherwise(F.col("trial_ends_at")).alias("trial_ends_at"),
        F.coalesce("auto_ai_context", F.lit(True)).alias("auto_ai_context"),
    )


def plan_view(subs: DataFrame, key: str = "user_id") -> DataFrame:
    """What a user sees of the plan."""
    paid = F.col("plan") == "pro"
    left = F.when(paid, F.lit(UNLIMITED)).otherwise(F.greatest(F.lit(0), F.col("ai_credits_limit") - F.col("ai_credits_used"))).cast("long")
    return subs.select(key, "plan", paid.alias("is_paid"), left.alias("credits_remaining"), (left > 0).alias("is_eligible"), "ai_credits_limit", "ai_credits_used", "credits_reset_at", "trial_ends_at", "auto_ai_context")


def display_name(username: Column, name: Column, mail: Column) -> Column:
    """P18."""
    return F.coalesce(first_present(username, name), F.nullif(F.substring_index(mail, "@", 1), F.lit("")), F.lit("User"))


def merged(server: DataFrame, client: DataFrame, key: str) -> DataFrame:
    """P10: the client's fields win where they are set."""
    return updated(server, client, key)


def addresses(dns: DataFrame) -> DataFrame:
    """A row for each host: its greatest address, and any_private: whether one of them is private or null."""
    return dns.groupBy("host").agg(F.max("ip").alias("ip"), F.bool_or(is_private_ip(F.col("ip"))).alias("any_private"))


def safe_urls(urls: DataFrame, dns: DataFrame, host: Column, url: str = "url") -> DataFrame:
    """J8, IP4: links with the address of their host, and whether any of its addresses is private; null where it is unknown, which counts as unsafe."""
    d = addresses(dns).select(F.col("host").alias("_host"), "ip", "any_private")
    return urls.withColumn("host", host).join(d, F.col("host") == F.col("_host"), "left").drop("_host")


def with_listed_domains(mails: DataFrame, listed: DataFrame, mail: str = "mail") -> DataFrame:
    """Mails with `listed`: whether their domain or one above it is in the list (domain, wildcard)."""
    from skein.functions.net import mail_domain, parent_domains

    d = mails.withColumn("_of", mail_domain(F.col(mail)))
    rules = listed.groupBy("domain").agg(F.max("wildcard").alias("wildcard"))
    # domains are far fewer than mails; those that are listed are no more than that, and what is small is sent to every task
    few = (rules.agg(F.sum(F.octet_length("domain") + 64)).first()[0] or 0) <= SEND_BYTES
    own = d.select("_of").distinct().select("_of", F.posexplode(parent_domains(F.col("_of"))).alias("depth", "domain"))
    hit = own.join(F.broadcast(rules) if few else rules, "domain").where("depth = 0 or wildcard").select(F.col("_of").alias("_hit")).distinct()
    return d.join(hit, F.col("_of") == F.col("_hit"), "left").withColumn("listed", F.col("_hit").isNotNull()).drop("_of", "_hit")


def content_groups(urls: DataFrame, keys: Column, url: str = "url") -> DataFrame:
    """A row for each link and content key, with the least link that shares the key; links of one content are joined through
    it, so a content that a third of all rows have makes no pairs."""
    d = urls.select(F.col(url).alias("url")).where("url is not null").distinct().withColumn("key", F.explode(keys))
    return d.join(d.groupBy("key").agg(F.min("url").alias("first_url"), F.count("*").alias("n_urls")), "key")


def filled_in(a: Column, b: Column, keep: str = "first") -> Column:
    """Two tiers of a text field: the first that is set, the longest, or the second where the first is cut off."""
    from skein.functions.text import is_truncated

    if keep == "longest":
        return F.when(F.coalesce(F.length(b), F.lit(0)) > F.coalesce(F.length(a), F.lit(0)), b).otherwise(a)
    if keep == "whole":
        return F.when(present(a).isNull() | (is_truncated(a) & (F.coalesce(F.length(b), F.lit(0)) > F.length(a))), F.coalesce(b, a)).otherwise(a)
    return let(F.struct(present(a).alias("a"), present(b).alias("b")), lambda x: F.coalesce(x["a"], x["b"]))


def media_distinct(media: Column, identity: Column | None = None) -> Column:
    """Media (array<struct<type,url>>) without repeats; the first of each identity stays, with the link of its largest
    version ('width=' in the link). Identity: the link's last path segment without its query."""
    key = lambda m: F.substring_index(F.substring_index(m["url"], "?", 1), "/", -1)
    width = lambda m: F.coalesce(F.regexp_extract(m["url"], r"[?&]width=([0-9]+)", 1).try_cast("int"), F.lit(1 << 30))

    def one(k: Column) -> Column:
        same = F.filter(media, lambda m: key(m) == k)
        largest = F.element_at(F.array_sort(F.transform(same, lambda m, i: F.struct((-width(m)).alias("w"), i.alias("i"), m["url"].alias("url")))), 1)
        return F.struct(same[0]["type"].alias("type"), largest["url"].alias("url"))

    return F.transform(F.array_distinct(F.transform(F.filter(media, lambda m: present(wide_trim(m["url"])).isNotNull()), key)), one)


def post_media(media: Column) -> Column:
    """AF2: where a post has a video, only videos."""
    videos = F.filter(media, lambda m: m["type"] == "video")
    return F.when(F.size(videos) > 0, videos).otherwise(media)
