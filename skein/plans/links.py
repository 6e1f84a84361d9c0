"""Queries over links, numbers, addresses and mails."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import classify, net, numeric, url
from skein.operators import library
from skein.plans import fixtures as X
from skein.plans.sql import canonical_ctes, extract, got, lit, matches, trim, values
from skein.sources.tables import table


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionByName(X.frame(spark, X.LINKS, "url"))


LINKS_SQL = f"SELECT page_id AS id, url FROM pages UNION ALL SELECT * FROM {values(X.numbered(X.LINKS), 'id, url')}"


def url_canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("id", "url", url.canonical_url(F.col("url")).alias("canonical"))


def url_dedup_canonical(spark: SparkSession, sf: str) -> DataFrame:
    d = _links(spark, sf).select("id", "url", url.canonical_url(F.col("url")).alias("canonical"))
    return d.groupBy("canonical").agg(F.count("*").alias("n"), F.min_by("url", "id").alias("first_url"), F.max("id").alias("newest_id"))


def url_content_groups(spark: SparkSession, sf: str) -> DataFrame:
    return library.content_groups(_links(spark, sf), url.content_keys(F.col("url")))


def site_name(spark: SparkSession, sf: str) -> DataFrame:
    return _links(spark, sf).select("id", url.site_name(F.col("url"), F.lit(None).cast("string")).alias("site"), url.platform(F.col("url")).alias("platform"))


def link_ids(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return _links(spark, sf).select("id", url.linkedin_post_id(u).alias("linkedin_id"), url.is_shortlink(u).alias("shortlink"), url.tweet_id(u).alias("tweet_id"), classify.is_reel(u).alias("reel"))


def metric_parse(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.format_string("%.2f", "value"), F.when(F.col("event_id") % 3 == 0, F.lit("K")).when(F.col("event_id") % 3 == 1, F.lit("M")).otherwise(F.lit(""))).alias("raw"))
    d, c = counts.unionByName(X.frame(spark, X.COUNTS, "raw")), F.col("raw")
    return d.select("id", "raw", numeric.parse_count_floor(c).alias("floored"), numeric.parse_count_round(c).alias("rounded"), numeric.format_count(c).alias("shown"), numeric.is_count_text(c).alias("is_count"))


def metrics_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of events by type for every user as a map; those of error alone are zero."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", F.when(F.col("event_type") != "click", F.col("n")).alias("n")))).alias("m"))  # at most one entry a type
    s = numeric.sanitize_metrics(F.col("m"))
    return m.select("user_id", s.isNull().alias("empty"), F.coalesce(F.size(s), F.lit(0)).cast("long").alias("n_kept"), s["view"].alias("views"))


def private_ip(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})"), F.lit(1))).alias("pos", "ip"))
    d = found.unionByName(X.frame(spark, X.ADDRESSES, "ip").withColumn("pos", F.lit(0)))
    return d.select("id", F.col("pos").cast("long").alias("pos"), "ip", net.is_private_ip(F.col("ip")).alias("is_private"))


def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses for three of four hosts."""
    h = table(spark, sf, "pages").select(url.host_of(F.col("url")).alias("host")).distinct().withColumn("n", F.length("host")).where("n % 4 <> 0")
    return h.select("host", F.when(F.col("n") % 3 == 0, F.lit("10.0.0.")).otherwise(F.lit("93.184.216.")).alias("net"), "n").select("host", F.concat("net", F.col("n").cast("string")).alias("ip"))


def url_safety(spark: SparkSession, sf: str) -> DataFrame:
    d = library.safe_urls(_links(spark, sf), _hosts(spark, sf), url.host_of(F.col("url")))
    return d.select("id", "ip", net.is_safe_url(F.col("url"), F.col("ip"), F.col("any_private")).alias("safe"), net.url_problem(F.col("url")).alias("problem"))


def email_validate(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), F.lit(1))).alias("mail"))
    d = found.unionByName(X.frame(spark, X.MAILS, "mail"))
    listed = spark.createDataFrame(X.LISTED, "domain string, wildcard boolean").coalesce(1)
    d = library.with_listed_domains(d, listed).withColumn("r", net.validate_email(F.col("mail"), F.col("listed")))
    return d.select("id", "mail", "r.is_valid", "r.is_disposable", "r.error", "r.normalized", "r.domain")


def password_rule(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("word")).unionByName(X.frame(spark, X.PASSWORDS, "word"))
    return d.select("id", net.password_ok(F.col("word")).alias("password_ok"), net.otp_ok(F.col("word")).alias("otp_ok"))


def mime_sniff(spark: SparkSession, sf: str) -> DataFrame:
    """The bytes of whole documents, every other one behind the mark of a JPEG, and the literal signatures."""
    text = F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit("")))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("FFD8FF")), text)).otherwise(text).alias("content"))
    d = docs.unionByName(X.frame(spark, X.MAGIC, "hex").select("id", F.unhex("hex").alias("content")))
    return d.select("id", net.image_type(F.col("content")).alias("mime"))


_HOST_SQL = f"lower({got(extract('url', r'(?i)^\s*https?://([^/?#\\]+)'), url._HOST, 2)})"
_PATH_SQL = f"coalesce({got('url', r'(?i)^\s*https?://[^/?#]+(/[^?#]*)')}, '/')"
_ANY = lambda x, *parts: "(" + " OR ".join(f"contains({x}, {lit(p)})" for p in parts) + ")"

SITE_SQL = f"""
WITH src AS ({LINKS_SQL}), h AS (SELECT id, url, {_HOST_SQL} AS full_host, lower({_PATH_SQL}) AS path FROM src),
p AS (SELECT *, regexp_replace(full_host, '^www[.]', '') AS host, string_split(regexp_replace(full_host, '^www[.]', ''), '.') AS parts FROM h),
low AS (SELECT *, lower({trim("coalesce(url, '')")}) AS l FROM p),
d AS (SELECT *, lower(regexp_extract(regexp_extract(CASE WHEN starts_with(l, 'http') THEN l ELSE 'https://' || l END, {lit(r'(?i)^\s*https?://([^/?#\\]+)')}, 1), {lit(url._HOST.replace(chr(92) + 'z', '$'))}, 2)) AS dh FROM low)
SELECT id, CASE WHEN host IS NULL THEN 'Unknown Site'
 WHEN contains(host, 'github.com') THEN CASE WHEN contains(path, '/issues/') THEN 'GitHub Issue' WHEN contains(path, '/pull/') THEN 'GitHub Pull Request' ELSE 'GitHub' END
 WHEN contains(host, 'linkedin.com') THEN CASE WHEN contains(path, '/jobs/') THEN 'LinkedIn Job' WHEN contains(path, '/in/') THEN 'LinkedIn Profile'
   WHEN {_ANY('path', '/pulse/', '/article/')} THEN 'LinkedIn Article' WHEN {_ANY('path', '/posts/', '/feed/')} THEN 'LinkedIn Post' ELSE 'LinkedIn' END
 WHEN contains(host, 'reddit.com') THEN CASE WHEN contains(path, '/comments/') THEN 'Reddit Post' ELSE 'Reddit' END
 WHEN {_ANY('host', 'x.com', 'twitter.com')} THEN CASE WHEN contains(path, '/status/') THEN 'X Post' ELSE 'X' END
 WHEN {_ANY('host', 'youtube.com', 'youtu.be')} THEN CASE WHEN contains(path, '/watch') OR contains(host, 'youtu.be') THEN 'YouTube Video' ELSE 'YouTube' END
 WHEN host = 'news.ycombinator.com' THEN 'Hacker News' WHEN contains(host, 'medium.com') THEN 'Medium' WHEN host = 'dev.to' THEN 'DEV Community'
 WHEN contains(host, 'stackoverflow.com') THEN CASE WHEN contains(path, '/questions/') THEN 'Stack Overflow Question' ELSE 'Stack Overflow' END
 ELSE upper(left(label, 1)) || lower(substr(label, 2)) END AS site,
 CASE WHEN coalesce(dh, '') = '' THEN 'generic' {' '.join(f"WHEN {matches('dh', p)} THEN {lit(n)}" for n, p in url.PLATFORMS.items())} ELSE 'generic' END AS platform
FROM (SELECT *, CASE WHEN len(parts) > 2 AND parts[-2] IN ({', '.join(map(lit, url.SECOND_LEVEL))}) THEN parts[-3] WHEN len(parts) >= 2 THEN parts[-2] ELSE parts[1] END AS label FROM d)"""

_NUM = lambda x: f"try_cast({got(x, numeric.NUMBER)} AS DOUBLE)"
_COUNT_CTES = f"""
WITH src AS (SELECT event_id AS id, printf('%.2f', value) || CASE event_id % 3 WHEN 0 THEN 'K' WHEN 1 THEN 'M' ELSE '' END AS raw FROM events UNION ALL SELECT * FROM {values(X.numbered(X.COUNTS), 'id, raw')}),
a AS (SELECT *, {trim('raw')} AS t FROM src), b AS (SELECT *, {trim("upper(replace(t, ',', ''))")} AS u, lower(t) AS l FROM a)"""
METRIC_SQL = f"""{_COUNT_CTES}
SELECT id, raw,
 CAST(coalesce(floor({_NUM('u')} * CASE WHEN contains(u, 'K') OR {_ANY('t', *numeric.THOUSAND)} THEN 1e3 WHEN contains(u, 'M') THEN 1e6 WHEN contains(u, 'B') THEN 1e9
   WHEN contains(u, 'CR') OR {_ANY('t', *numeric.CRORE)} THEN 1e7 WHEN contains(u, 'L') OR {_ANY('t', *numeric.LAKH)} THEN 1e5 ELSE 1.0 END), 0) AS BIGINT) AS floored,
 CAST(coalesce(CASE WHEN ends_with(u, 'K') THEN floor({_NUM('u')} * 1e3 + 0.5) WHEN ends_with(u, 'M') THEN floor({_NUM('u')} * 1e6 + 0.5) WHEN ends_with(u, 'B') THEN floor({_NUM('u')} * 1e9 + 0.5)
   ELSE greatest(0, try_cast({got('u', '^([+-]?[0-9]+)')} AS BIGINT)) END, 0) AS BIGINT) AS rounded,
 CASE WHEN raw = '' THEN NULL WHEN {matches('t', '^[0-9.]+[KMBkmb]?$')} THEN upper(t) WHEN n IS NULL THEN t WHEN n >= 1e6 THEN CAST(CAST(floor(n / 1e6) AS BIGINT) AS VARCHAR) || 'M'
   WHEN n >= 1e3 THEN CAST(CAST(floor(n / 1e3) AS BIGINT) AS VARCHAR) || 'K' WHEN n = floor(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END AS shown,
 l = '' OR ({matches('l', '^[0-9]')} AND {_ANY('l', 'view', numeric.VIEWS, 'reaction', 'like', 'share', 'comment')}) OR {_ANY('l', numeric.VIEWS, 'views', 'reactions')}
   OR {matches('l', r'^[0-9,.]+\s*[kmb]?\s*(?:views?|reactions?|likes?)?$')} AS is_count
FROM (SELECT *, {_NUM("replace(t, ',', '')")} AS n FROM b)"""

_RANGES = " OR ".join(f"n BETWEEN {net.v4_number(a)} AND {net.v4_number(b)}" for a, b in net.V4_RANGES)
IP_SQL = f"""
WITH f AS (SELECT doc_id AS id, regexp_extract_all(text, '([0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}}[.][0-9]{{1,3}})', 1) AS l FROM documents),
src AS (SELECT id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS ip FROM f UNION ALL SELECT id, 0, ip FROM {values(X.numbered(X.ADDRESSES), 'id, ip')}),
a AS (SELECT *, regexp_replace(lower({trim('ip')}), '^::ffff:', '') AS v FROM src),
b AS (SELECT *, list_transform(string_split(v, '.'), lambda p: CASE WHEN trim(p) = '' THEN 0 WHEN regexp_matches(trim(p), '^[0-9]{{1,9}}$') THEN try_cast(trim(p) AS BIGINT) END) AS o FROM a),
c AS (SELECT *, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS n, len(o) <> 4 OR len(list_filter(o, lambda x: x IS NULL OR x > 255)) > 0 AS bad FROM b)
SELECT id, pos, ip, CASE WHEN v IN ('::', '::1') OR {' OR '.join(f"starts_with(v, {lit(p)})" for p in net.V6_PREFIXES)} THEN true
 WHEN contains(v, ':') THEN {' OR '.join(f"starts_with(v, {lit(p)})" for p in net.V6_RESERVED)} WHEN bad THEN true ELSE {_RANGES} END AS is_private FROM c"""

SAFETY_SQL = f"""
WITH src AS ({LINKS_SQL}), s AS (SELECT id, url, {_HOST_SQL} AS host FROM src),
dns AS (SELECT host, CASE WHEN length(host) % 3 = 0 THEN '10.0.0.' ELSE '93.184.216.' END || length(host) AS ip FROM (SELECT DISTINCT {_HOST_SQL} AS host FROM pages) WHERE length(host) % 4 <> 0)
SELECT id, ip, coalesce(length(url) <= 2048 AND s.host IS NOT NULL AND NOT (s.host IN ({', '.join(map(lit, net.INTERNAL_HOSTS))}) OR regexp_matches(s.host, '^(?:0x[0-9a-f]+|[0-9]+)$')
  OR {' OR '.join(f"ends_with(s.host, {lit(p)})" for p in net.INTERNAL_SUFFIXES)}) AND ip IS NOT NULL AND NOT starts_with(ip, '10.'), false) AS safe,
 CASE WHEN url IS NULL OR {trim('url')} = '' THEN 'missing' WHEN length(url) > 2048 THEN 'too_long' END AS problem
FROM s LEFT JOIN dns ON s.host = dns.host"""

MAIL_SQL = f"""
WITH src AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)', 1)) AS mail FROM documents UNION ALL SELECT * FROM {values(X.numbered(X.MAILS), 'id, mail')}),
a AS (SELECT *, lower({trim('mail')}) AS v FROM src), b AS (SELECT *, string_split(v, '@')[-1] AS dom FROM a),
c AS (SELECT *, CASE WHEN length(v) > length(dom) THEN left(v, length(v) - length(dom) - 1) ELSE '' END AS loc, string_split(dom, '.')[-1] AS tld,
  dom IN ({', '.join(lit(d) for d, _ in X.LISTED)}) OR {' OR '.join(f"ends_with(dom, {lit('.' + d)})" for d, w in X.LISTED if w)} AS listed FROM b),
d AS (SELECT *, NOT contains(v, '@') OR loc = '' OR dom = '' AS shapeless, {matches('v', net.EMAIL + '$')} AS formed, regexp_matches(tld, '^[a-z]{{2,}}$') AS tld_ok FROM c),
e AS (SELECT *, CASE WHEN mail = '' THEN {lit(net.REQUIRED)} WHEN length(v) > 254 THEN {lit(net.TOO_LONG)} WHEN shapeless THEN {lit(net.ASK)} WHEN length(loc) > 64 THEN {lit(net.LOCAL_LONG)}
  WHEN NOT formed THEN {lit(net.FORMAT)} WHEN NOT tld_ok THEN {lit(net.BAD_TLD)} WHEN listed THEN {lit(net.ASK)} END AS error FROM d)
SELECT id, mail, error IS NULL AS is_valid, mail <> '' AND NOT shapeless AND length(v) <= 254 AND length(loc) <= 64 AND formed AND tld_ok AND listed AS is_disposable, error, v AS normalized,
 CASE WHEN shapeless OR length(v) > 254 OR mail = '' THEN '' ELSE dom END AS domain FROM e"""

GROUPS_SQL = f"""
WITH {canonical_ctes(LINKS_SQL)}, d AS (SELECT DISTINCT url, {trim('url')} AS v FROM canon WHERE url IS NOT NULL), cc AS (SELECT DISTINCT {trim('url')} AS v, canonical FROM canon),
r AS (SELECT *, coalesce({got('v', url.REDDIT_POST, 2)}, {got('v', url.REDDIT_SHORT)}) AS post, coalesce({got('v', '(?i)/comment/([a-zA-Z0-9]+)')}, {got('v', r'(?i)comments/[a-zA-Z0-9]+/[^/\s]+/([a-zA-Z0-9]{6,})')}, '') AS comment FROM d),
k AS (SELECT url, 'url:' || v AS key FROM d UNION ALL SELECT url, 'canonical:' || canonical FROM d JOIN cc USING (v) WHERE canonical <> ''
 UNION ALL SELECT url, 'tweet:' || {got('v', url.TWEET, 2)} FROM d UNION ALL SELECT url, 'instagram:' || {got('v', url.IG_MEDIA, 2)} FROM d UNION ALL SELECT url, 'youtube:' || {got('v', url.YOUTUBE)} FROM d
 UNION ALL SELECT url, 'reddit:' || post || '/' || comment FROM r UNION ALL SELECT url, 'pin:' || coalesce({got('v', r'(?i)pinterest\.[a-z.]+/pin/([0-9]+)')}, {got('v', url.PIN_SHORT)}) FROM d
 UNION ALL SELECT url, 'linkedin:' || coalesce({got('v', url.LINKEDIN_ID)}, {got('v', url.LINKEDIN_ID_LOOSE)}) FROM d)
SELECT url, key, min(url) OVER (PARTITION BY key) AS first_url, count(*) OVER (PARTITION BY key) AS n_urls FROM k WHERE key IS NOT NULL"""

SQL = {
    "url_canonicalize": f"WITH {canonical_ctes(LINKS_SQL)} SELECT id, url, canonical FROM canon",
    "url_dedup_canonical": f"WITH {canonical_ctes(LINKS_SQL)} SELECT canonical, count(*) AS n, arg_min(url, id) AS first_url, max(id) AS newest_id FROM canon GROUP BY canonical",
    "url_content_groups": GROUPS_SQL,
    "site_name": SITE_SQL,
    "link_ids": f"SELECT id, coalesce({got('url', url.LINKEDIN_ID)}, {got('url', url.LINKEDIN_ID_LOOSE)}) AS linkedin_id, regexp_matches(lower({trim('url')}), {lit(url.SHORTLINKS)}) AS shortlink, {got('url', '(?i)status(?:es)?/([0-9]+)')} AS tweet_id, regexp_matches(url, '(?i)/(?:reels?|share/[rv]|videos?|watch)') AS reel FROM ({LINKS_SQL})",
    "metric_parse": METRIC_SQL,
    "metrics_sanitize": """WITH n AS (SELECT user_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END) AS n FROM events GROUP BY ALL)
SELECT user_id, coalesce(max(n) FILTER (event_type <> 'click'), 0) = 0 AS empty, CASE WHEN coalesce(max(n) FILTER (event_type <> 'click'), 0) = 0 THEN 0 ELSE count(*) FILTER (event_type <> 'click') END AS n_kept,
 CASE WHEN coalesce(max(n) FILTER (event_type <> 'click'), 0) <> 0 THEN max(n) FILTER (event_type = 'view') END AS views FROM n GROUP BY user_id""",
    "private_ip": IP_SQL,
    "url_safety": SAFETY_SQL,
    "email_validate": MAIL_SQL,
    "password_rule": f"""SELECT id, length(word) >= 8 AND regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') AND regexp_matches(word, '[0-9]') AS password_ok, regexp_matches(word, '^[0-9]{{6}}$') AS otp_ok
FROM (SELECT c_custkey AS id, c_name AS word FROM customer UNION ALL SELECT * FROM {values(X.numbered(X.PASSWORDS), 'id, word')})""",
    "mime_sniff": f"""SELECT CAST(id AS BIGINT) AS id, CASE WHEN length(h) < 8 THEN NULL WHEN starts_with(h, 'FFD8FF') THEN 'image/jpeg' WHEN starts_with(h, '89504E470D0A1A0A') THEN 'image/png' WHEN regexp_matches(h, '^47494638(?:37|39)61') THEN 'image/gif'
 WHEN regexp_matches(h, '^52494646.{{8}}57454250') THEN 'image/webp' WHEN substr(h, 9, 8) = '66747970' AND substr(h, 17, 8) IN ('61766966', '61766973', '6D696631') THEN 'image/avif' END AS mime FROM (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'FFD8FF' ELSE '' END || hex(coalesce(text, '')) AS h FROM documents UNION ALL SELECT id, h FROM {values(X.numbered(X.MAGIC), 'id, h')})""",
}

QUERIES = {f.__name__: f for f in (url_canonicalize, url_dedup_canonical, url_content_groups, site_name, link_ids, metric_parse, metrics_sanitize, private_ip, url_safety, email_validate, password_rule, mime_sniff)}
