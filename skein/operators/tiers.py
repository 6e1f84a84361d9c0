"""CF16: records that lack key data go to the next source, and only those.

Defined cases: a predicate that is null counts as lacking; a source without a row for a record leaves it as it is; of several rows of a source one that
is set for the field is taken, the greatest; a record keeps its fields once they are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.strings import present
from skein.functions.text import is_truncated
from skein.session import materialize


def odd_author(author: Column) -> Column:
    """No name, or a generated one."""
    return present(author).isNull() | F.contains(author, F.lit("_user"))


def reddit_lacks_key_data(title: Column, author: Column, description: Column, is_comment: Column, media: Column, media_expected: Column) -> Column:
    """CF16: whether a post or comment needs the rendered page. media: how many there are."""
    bare, cut = present(description).isNull(), F.coalesce(is_truncated(description), F.lit(False))
    comment = bare | cut | odd_author(author)
    post = present(title).isNull() | odd_author(author) | cut | (bare & (media == 0)) | (media_expected & (media == 0))
    return F.when(is_comment, comment).otherwise(post)


def reddit_wants_embed(author: Column, description: Column, upvotes: Column, comments: Column, icon: Column, is_comment: Column, media: Column) -> Column:
    """CF16: whether the embedded view may add something."""
    bare, cut = present(description).isNull(), F.coalesce(is_truncated(description), F.lit(False))
    uncounted = (F.coalesce(upvotes, F.lit(0)) == 0) & (F.coalesce(comments, F.lit(0)) == 0)
    return bare | cut | odd_author(author) | uncounted | present(icon).isNull() | F.contains(icon, F.lit("ui-avatars")) | (~is_comment & (media == 0))


def x_is_complete(avatar: Column, likes: Column, reposts: Column, views: Column) -> Column:
    """CF16: whether a post's own page gave enough."""
    return present(avatar).isNotNull() & likes.isNotNull() & (reposts.isNotNull() | views.isNotNull())


def escalated(records: DataFrame, key: str, fields: list[str], tiers: list[tuple[str, DataFrame, Column]], first: str = "given") -> DataFrame:
    """records with their fields filled from the tiers in order, `read` (the tiers that were asked) and `<field>_from` (who gave it).

    tiers: name, rows of the key and fields, and what a record must lack to be sent there, over the fields as they are then. A tier is
    joined with the records that lack something, so what the first tier settles is neither shuffled again nor looked up."""
    d = records.withColumns({f"{f}_from": F.when(F.col(f).isNotNull(), first) for f in fields}).withColumn("read", F.array().cast("array<string>"))
    for name, source, lacking in tiers:
        d = materialize(d.withColumn("_lacks", F.coalesce(lacking, F.lit(True))), f"tier-{name}")
        own = source.groupBy(F.col(key).alias("_key")).agg(*[F.max(f).alias(f"_{f}") for f in fields])
        asked = d.where("_lacks").join(own, F.col(key) == F.col("_key"), "left")
        given = {f"{f}_from": F.when(F.col(f).isNull() & F.col(f"_{f}").isNotNull(), name).otherwise(F.col(f"{f}_from")) for f in fields}
        filled = {f: F.coalesce(f, f"_{f}") for f in fields}
        asked = asked.withColumns(given).withColumns(filled).withColumn("read", F.array_append("read", name))
        d = d.where("NOT _lacks").unionByName(asked.select(*d.columns)).drop("_lacks")
    return d
