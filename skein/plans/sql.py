"""Pieces of the SQL that the queries are held against. Patterns are those of the functions, in RE2's spelling."""

from __future__ import annotations

from skein.functions import url as U
from skein.functions.strings import NOT_WS, WS


def re2(pattern: str) -> str:
    return pattern.replace(r"\z", "$")


def lit(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A derived table of literal rows."""
    cell = lambda v: lit(v) if v is None or isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def got(x: str, pattern: str, index: int = 1) -> str:
    """A capture group; null without a match."""
    return f"nullif(regexp_extract({x}, {lit(re2(pattern))}, {index}), '')"


def extract(x: str, pattern: str, index: int = 1) -> str:
    return f"regexp_extract({x}, {lit(re2(pattern))}, {index})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(re2(pattern))})"


def sub(x: str, pattern: str, new: str, flags: str = "g") -> str:
    for k in range(1, 4):
        new = new.replace(f"${k}", f"\\{k}")
    return f"regexp_replace({x}, {lit(re2(pattern))}, {lit(new)}, '{flags}')"


def form_encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def canonical_ctes(source: str) -> str:
    """CTEs up to canon(id, url, canonical) over a source of (id, url)."""
    tracking = ", ".join(map(lit, U.TRACKING))
    reddit = lambda p: f"'https://www.reddit.com/r/' || lower({extract('v', p, 1)}) || '/comments/' || {extract('v', p, 2)} || '/comment/' || {extract('v', p, 3)} || '/'"
    listed = lambda xs: ", ".join(map(lit, xs))
    return f"""
src AS ({source}),
c1 AS (SELECT id, url, {sub(trim("coalesce(url, '')"), r"^<([^>]+)>$", "$1")} AS t FROM src),
c2 AS (SELECT id, url, coalesce({got("t", r"(?i)[[].*?[]][(](https?://[^\s)]+)[)]")}, t) AS t FROM c1),
c3 AS (SELECT id, url, {trim(sub("t", U.LABEL + WS + "*", ""))} AS v FROM c2),
c4 AS (SELECT *, {extract("v", f"^({NOT_WS}+)")} AS w FROM c3),
c5 AS (SELECT *, CASE WHEN {matches("w", "(?i)^https?://")} THEN w ELSE 'https://' || w END AS u FROM c4),
c6 AS (SELECT *, {extract("u", U._PARTS, 2)} AS auth, {extract("u", U._PARTS, 3)} AS path, {extract("u", U._PARTS, 4)} AS query FROM c5),
c7 AS (SELECT *, lower({extract("auth", U._HOST, 2)}) AS host, {got("auth", U._HOST, 1)} AS usr, {got("auth", U._HOST, 3)} AS port,
  list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''),
    lambda p, i: {{'name': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'at': i, 'value': url_decode(replace({sub("p", "^[^=]*=?", "", "")}, '+', ' '))}}),
    lambda p: lower(p.name) NOT IN ({tracking}))) AS params FROM c6),
c8 AS (SELECT *, contains(host, 'facebook.com') AS fb, CASE WHEN path = '' THEN '/' ELSE path END AS path1,
  array_to_string(list_transform(params, lambda p: {form_encode("p.name")} || '=' || {form_encode("p.value")}), '&') AS q FROM c7),
c9 AS (SELECT *, 'https://' || coalesce(usr || '@', '') || CASE WHEN fb THEN 'www.facebook.com' WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END
  || CASE WHEN port IS NULL OR port IN ('80', '443') THEN '' ELSE ':' || port END
  || CASE WHEN NOT fb AND length(path1) > 1 AND ends_with(path1, '/') THEN left(path1, length(path1) - 1) ELSE path1 END
  || CASE WHEN coalesce(q, '') = '' THEN '' ELSE '?' || q END AS generic FROM c8),
canon AS (SELECT id, url, CASE WHEN v = '' THEN ''
  WHEN {matches("v", U.TWEET)} THEN 'https://x.com/' || lower({extract("v", U.TWEET, 1)}) || '/status/' || {extract("v", U.TWEET, 2)}
  WHEN {matches("v", U.IG_MEDIA)} THEN 'https://www.instagram.com/' || CASE lower({extract("v", U.IG_MEDIA, 1)}) WHEN 'reels' THEN 'reel' ELSE lower({extract("v", U.IG_MEDIA, 1)}) END || '/' || {extract("v", U.IG_MEDIA, 2)} || '/'
  WHEN {matches("v", U.IG_PROFILE)} AND lower({extract("v", U.IG_PROFILE)}) NOT IN ({listed(U.IG_RESERVED)}) THEN 'https://www.instagram.com/' || {extract("v", U.IG_PROFILE)} || '/'
  WHEN {matches("v", U.YOUTUBE)} THEN 'https://www.youtube.com/watch?v=' || {extract("v", U.YOUTUBE)} || coalesce('&t=' || {got("v", "(?i)[?&]t=([0-9a-zA-Z]+)")}, '')
  WHEN {matches("v", U.REDDIT_COMMENT)} THEN {reddit(U.REDDIT_COMMENT)}
  WHEN {matches("v", U.REDDIT_OLD)} AND lower({extract("v", U.REDDIT_OLD, 3)}) NOT IN ({listed(U.REDDIT_RESERVED)}) THEN {reddit(U.REDDIT_OLD)}
  WHEN {matches("v", U.REDDIT_POST)} THEN 'https://www.reddit.com/r/' || lower({extract("v", U.REDDIT_POST, 1)}) || '/comments/' || {extract("v", U.REDDIT_POST, 2)} || '/'
  WHEN {matches("v", U.REDDIT_SHORT)} THEN 'https://redd.it/' || {extract("v", U.REDDIT_SHORT)}
  WHEN {matches("v", U.PIN)} THEN 'https://www.pinterest.com/pin/' || {extract("v", U.PIN)} || '/'
  WHEN {matches("v", U.PIN_SHORT)} THEN 'https://pin.it/' || {extract("v", U.PIN_SHORT)}
  WHEN {matches("v", U.LINKEDIN)} THEN 'https://www.linkedin.com/' || {extract("v", U.LINKEDIN)}
  WHEN {matches("auth", U._HOST)} THEN generic ELSE v END AS canonical FROM c9)"""


def title_of(html: str) -> str:
    """Text of the title element of a stored page, which holds no tags."""
    return f"nullif({trim(decoded(extract(html, '(?is)<title[^>]*>(.*?)</title>')))}, '')"


def decoded(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, {lit(a)}, {lit(b)})"
    return x
