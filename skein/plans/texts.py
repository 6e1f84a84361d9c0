"""Queries over titles, descriptions and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import classify, html, strings, text
from skein.plans import fixtures as X
from skein.plans.sql import lit, re2, sub, title_of, trim, values
from skein.sources.tables import table


def _titles(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "pages").select(F.col("page_id").alias("id"), html.element_text(F.col("html"), "title").alias("title"))
    return own.unionByName(X.frame(spark, X.TITLES, "title"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(X.frame(spark, X.DESCRIPTIONS, "text"))


def clean_title(spark: SparkSession, sf: str) -> DataFrame:
    return _titles(spark, sf).select("id", text.clean_title(F.col("title")).alias("title"))


def clean_description(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", text.clean_description(F.col("text")).alias("description"))


def word_count_reading_time(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    c = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("part"), "text")
    d = d.unionByName(c).withColumn("words", strings.word_count(F.col("text")))
    return d.select("kind", "id", "part", "words", strings.reading_minutes(F.col("words")).alias("minutes"))


def text_flags(spark: SparkSession, sf: str) -> DataFrame:
    t, none = F.col("text"), F.lit(None).cast("string")
    return _texts(spark, sf).select("id", text.is_truncated(t).alias("truncated"), text.is_access_denied(none, t, none).alias("denied"), classify.is_login_wall(none, t).alias("login_wall"))


def access_denied_pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "pages").select(F.col("page_id").alias("id"), html.element_text(F.col("html"), "title").alias("title"), "html")
    d = d.unionByName(X.frame(spark, X.TITLES, "title").withColumn("html", F.lit(None).cast("string")))
    return d.select("id", text.is_access_denied(F.col("title"), F.lit(None).cast("string"), F.col("html")).alias("denied"))


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"))


def sanitized_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", html.sanitize(F.col("html")).alias("html"))


def fallback_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    f = classify.fallback_analysis(F.lit(None).cast("string"), F.col("text"), F.col("source"), F.col("lang"), F.lit(""))
    d = d.select("doc_id", f.alias("f"))
    return d.select("doc_id", F.array_join("f.categories", ",").alias("categories"), F.array_join("f.tags", ",").alias("tags"), F.sha2("f.context", 256).alias("context_sha256"))


def social_platform(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    d = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url").unionByName(X.frame(spark, X.LINKS, "url"))
    return d.select("id", classify.social_platform(F.col("url"), none, none).alias("platform"))


def ai_response_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Model answers over the documents: each of the literal answers in turn."""
    answers = F.array(*[F.lit(a) for a in X.ANSWERS])
    d = table(spark, sf, "documents").withColumn("raw", answers[(F.col("doc_id") % len(X.ANSWERS)).cast("int")])
    f = classify.fallback_analysis(F.lit(None).cast("string"), F.col("source"), F.col("source"), F.col("lang"), F.lit(""))
    d = d.select("doc_id", classify.normalize_analysis(F.col("raw"), f).alias("a"))
    return d.select("doc_id", "a.context", F.array_join("a.categories", ",").alias("categories"), F.array_join("a.tags", ",").alias("tags"), F.array_join("a.entities", ",").alias("entities"), "a.ocr_text")


def _unescape_sql(x: str) -> str:
    for k, v in text.NAMED_ENTITIES.items():
        x = f"replace({x}, {lit(k)}, {lit(v)})"
    for k, v in text.LAST_ENTITIES.items():
        x = f"replace({x}, {lit(k)}, {lit(v)})"
    return sub(x, rf"\\+([^a-zA-Z0-9{strings.SPACES}])", "$1")


def _quotes_ctes(source: str, before: str, after: str) -> str:
    """Cleaning with the outer quotes in the middle; source has id and v."""
    wrapped = " OR ".join(f"(starts_with(q, {lit(a)}) AND ends_with(q, {lit(b)}))" for a, b in (('"', '"'), ("“", "”"), ("'", "'")))
    inner = f"CASE WHEN {wrapped} THEN {trim('substr(q, 2, greatest(length(q) - 2, 0))')} ELSE q END"
    unquoted = trim(sub(trim(sub("i", r'["”]\.?$', "")), r'^["“]', ""))
    return f"""a AS ({source}), q0 AS (SELECT id, {trim(before)} AS q FROM a), q1 AS (SELECT id, {inner} AS i FROM q0), q2 AS (SELECT id, {unquoted} AS s FROM q1),
dots AS (SELECT id, {trim(sub(sub('s', text.DOT_LINE, chr(10)), text.DOT_RUN, ' '))} AS s FROM q2), done AS (SELECT id, {after} AS s FROM dots)"""


_TITLE_SRC = f"SELECT page_id AS id, {title_of('html')} AS title FROM pages UNION ALL SELECT * FROM {values(X.numbered(X.TITLES), 'id, title')}"
_TEXT_SRC = f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM {values(X.numbered(X.DESCRIPTIONS), 'id, text')}"
_HEADERS = trim("u")
for _p in (text.COUNTS_HEADER, text.VOTES_HEADER, text.COMMENTS_HEADER, text.DATE_HEADER):
    _HEADERS = sub(_HEADERS, _p, "", "")
_LINES = f"array_to_string(list_transform(string_split({sub('replace(s, chr(13) || chr(10), chr(10))', text.MORE_BUTTON, '')}, chr(10)), lambda l: {trim('l')}), chr(10))"
_PARAGRAPHS = f"nullif({trim(sub(_LINES, chr(10) + '{3,}', chr(10) * 2))}, '')"
_MD = "coalesce(html, '')"
for _p, _new in html.MARKDOWN:
    _MD = sub(_MD, f"(?is){_p}", _new)
for _a, _b in html.MARKDOWN_ENTITIES:
    _MD = f"replace({_MD}, {lit(_a)}, {lit(_b)})"
_DENIED = lambda title, rest: f"({title} IN ({', '.join(map(lit, text.BLOCKED_TITLES))}) OR regexp_matches({rest}, 'reference{strings.WS}*#[0-9a-f.]+') OR {' OR '.join(f'contains({rest}, {lit(p)})' for p in text.BLOCKED_PARTS)})"
_T = trim("coalesce(text, '')")

SQL = {
    "clean_title": f"WITH src AS ({_TITLE_SRC}), {_quotes_ctes(f'SELECT id, {_unescape_sql("title")} AS u FROM src', sub(sub(trim('u'), text.TITLE_HEAD, '', ''), text.TITLE_TAIL, '', ''), 's')} SELECT id, nullif(s, '') AS title FROM done",
    "clean_description": f"WITH src AS ({_TEXT_SRC}), {_quotes_ctes(f'SELECT id, {_unescape_sql("text")} AS u FROM src', _HEADERS, _PARAGRAPHS)} SELECT id, s AS description FROM done",
    "word_count_reading_time": f"""WITH d AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations),
w AS (SELECT *, coalesce(len(list_filter(regexp_split_to_array(text, '{strings.WS}+'), lambda x: x <> '')), 0) AS words FROM d)
SELECT kind, id, part, words, greatest(1, CAST(ceil(words / 200) AS BIGINT)) AS minutes FROM w""",
    "text_flags": f"""SELECT id, ends_with(t, '…') OR ends_with(t, '&#8230;') OR ends_with(t, '&hellip;') OR (length(t) <= 250 AND ends_with(t, '...')) AS truncated, {_DENIED("''", "' ' || lower(t) || ' '")} AS denied,
 {' OR '.join(f"contains(lower(t), {lit(m)})" for m in classify.LOGIN_MARKS)} AS login_wall FROM (SELECT id, {_T} AS t FROM ({_TEXT_SRC}))""",
    "access_denied_pages": f"""WITH d AS (SELECT page_id AS id, {title_of('html')} AS title, html FROM pages UNION ALL SELECT id, title, NULL FROM {values(X.numbered(X.TITLES), 'id, title')}),
e AS (SELECT id, lower({trim("coalesce(title, '')")}) AS t, lower({trim("coalesce(title, '')")}) || '  ' || lower(left(coalesce(html, ''), 3000)) AS r FROM d) SELECT id, {_DENIED('t', 'r')} AS denied FROM e""",
    "html_to_markdown": f"SELECT page_id, {trim(sub(_MD, chr(10) + '{3,}', chr(10) * 2))} AS markdown FROM pages",
    "fallback_tags": rf"""WITH a AS (SELECT doc_id, text, source, lang, lower(' ' || coalesce(text, '') || ' ' || coalesce(source, '')) AS t FROM documents),
b AS (SELECT *, regexp_extract_all(t, {lit(rf"\b({classify.KEYWORDS})\b")}, 1) AS w, regexp_extract_all(t, '#([a-zA-Z0-9_]+)', 1) AS h,
 list_filter([lower(nullif(lang, '')), regexp_replace(lower(nullif(source, '')), '[^a-z0-9]', '', 'g')], lambda x: x IS NOT NULL) AS own FROM a),
c AS (SELECT *, list_concat(own, w[1:3]) AS cats, list_concat(list_concat(own, w), h) AS ts FROM b),
d AS (SELECT *, list_filter(cats, lambda x, i: list_position(cats, x) = i)[1:5] AS cat, list_filter(ts, lambda x, i: list_position(ts, x) = i)[1:10] AS tag FROM c)
SELECT doc_id, CASE WHEN len(cat) = 0 THEN 'general' ELSE array_to_string(cat, ',') END AS categories, array_to_string(tag, ',') AS tags,
 sha256(CASE WHEN coalesce(text, '') = '' AND coalesce(source, '') = '' THEN 'Saved link from .' ELSE 'Content Summary: ' || concat_ws(' | ', 'Description: ' || nullif(text, ''), 'Source: ' || nullif(source, '')) || '.' END) AS context_sha256 FROM d""",
    "social_platform": f"""SELECT id, CASE WHEN contains(u, 'twitter.com') OR contains(u, 'x.com') THEN 'twitter' WHEN contains(u, 'instagram.com') THEN 'instagram' WHEN contains(u, 'linkedin.com') THEN 'linkedin'
 WHEN contains(u, 'reddit.com') OR contains(u, 'redd.it') THEN 'reddit' END AS platform FROM (SELECT id, lower(url) AS u FROM (SELECT page_id AS id, url FROM pages UNION ALL SELECT * FROM {values(X.numbered(X.LINKS), 'id, url')}))""",
}
SQL = {k: re2(v) for k, v in SQL.items()}

QUERIES = {f.__name__: f for f in (clean_title, clean_description, word_count_reading_time, text_flags, access_denied_pages, html_to_markdown, sanitized_html, fallback_tags, social_platform, ai_response_normalize)}
