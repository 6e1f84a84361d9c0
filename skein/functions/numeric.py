"""Engagement counts written for people: '1.5K', '2,300', '5 lakh'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.strings import SPACES, WS, group, has_any, let, wide_trim

# ---- fixed values ----------------------------------------------------------------------------------------------------
NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
THOUSAND, CRORE, LAKH = ["వే", "हज़ार"], ["కోటి", "करोड़"], ["లక్ష", "లాఖ్", "लाख"]
VIEWS = "వీక్షణలు"
# ----------------------------------------------------------------------------------------------------------------------


def leading_number(c: Column) -> Column:
    """The number a text starts with, as double; null if it starts with none."""
    return group(c, NUMBER).try_cast("double")


def parse_count_floor(c: Column) -> Column:
    """NF1: number times the first scale whose letter or word stands anywhere, rounded down; 0 for null and for no number."""

    def run(raw: Column) -> Column:
        upper = F.upper(F.replace(raw, F.lit(","), F.lit("")))
        scale = (
            F.when(upper.contains("K") | has_any(raw, *THOUSAND), 1e3).when(upper.contains("M"), 1e6).when(upper.contains("B"), 1e9)
            .when(upper.contains("CR") | has_any(raw, *CRORE), 1e7).when(upper.contains("L") | has_any(raw, *LAKH), 1e5).otherwise(1.0)
        )
        return F.floor(leading_number(wide_trim(upper)) * scale)

    return F.coalesce(let(wide_trim(c), run), F.lit(0)).cast("long")


def parse_count_round(c: Column) -> Column:
    """NF2: K, M or B counts only as the last letter, rounded half up; plain integers are at least 0."""

    def run(v: Column) -> Column:
        scaled = [F.floor(leading_number(v) * scale + 0.5) for scale in (1e3, 1e6, 1e9)]
        plain = F.greatest(F.lit(0), group(v, r"^([+-]?[0-9]+)").try_cast("long"))
        return F.when(v.endswith("K"), scaled[0]).when(v.endswith("M"), scaled[1]).when(v.endswith("B"), scaled[2]).otherwise(plain)

    return F.coalesce(let(F.upper(wide_trim(F.replace(c, F.lit(","), F.lit("")))), run), F.lit(0)).cast("long")


def format_count(c: Column) -> Column:
    """NF3: '19,920,702' becomes '19M'; short forms stay, in capitals; text without a number stays as it is; '' is null."""

    def run(v: Column) -> Column:
        n = leading_number(F.replace(v, F.lit(","), F.lit("")))
        whole = lambda x: F.floor(x).cast("string")
        return (
            F.when(v.rlike(r"^[0-9.]+[KMBkmb]?\z"), F.upper(v)).when(n.isNull(), v)
            .when(n >= 1e6, F.concat(whole(n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(whole(n / 1e3), F.lit("K")))
            .when(n == F.floor(n), whole(n)).otherwise(n.cast("string"))
        )

    return F.when(c != "", let(wide_trim(c), run))


def is_count_text(c: Column) -> Column:
    """NF4: whether a text is a count of views, likes and the like rather than a name; true for null and ''."""

    def run(v: Column) -> Column:
        named = has_any(v, "view", VIEWS, "reaction", "like", "share", "comment")
        return (v == "") | (v.rlike("^[0-9]") & named) | has_any(v, VIEWS, "views", "reactions") | v.rlike(rf"^[0-9,.]+[{SPACES}]*[kmb]?[{SPACES}]*(?:views?|reactions?|likes?)?\z")

    return F.coalesce(let(F.lower(wide_trim(c)), run), F.lit(True))


def count_before(c: Column, word: str) -> Column:
    """NF5: the count before a word ('1.2K likes'); null without one."""
    found = group(c, rf"(?i)([0-9][0-9,.]*[KMB]?){WS}*{word}s?\b")
    return F.when(found.isNotNull(), parse_count_round(found))


def sanitize_metrics(m: Column) -> Column:
    """A map without nulls; null if nothing but zeros is left."""
    return let(F.map_filter(m, lambda k, v: v.isNotNull()), lambda x: F.when(F.exists(F.map_values(x), lambda v: (v != 0) & ~F.isnan(v)), x))
