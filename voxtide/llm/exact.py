"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups.

The hash is computed where the row is read, and only hashes, ids and counts are grouped (with map-side combining, so
a group of any size sends one row per task). Then the texts of hashes that occur more than once, and no others, are
compared: each task keeps the least and the greatest text it saw of a hash, and a group whose least and greatest text
differ is a collision, which is grouped again by the text itself. Texts are told by a semi join with the groups, which
is a broadcast up to a number of groups and a shuffle by hash beyond it; groups with over one in `HOT_GROUPS` of all copies
are always broadcast, wherever groups are joined, so no task gets more than a small share of all rows.

Defined cases: a null text counts as empty. Null ids rank behind every other id; a group with null ids only has a
null `keep_id`. Rows that agree in id and text are one row repeated: exactly one of them is kept. Other columns are
looked at, whatever their names, only by `drop_exact_duplicates` where a row is repeated: of rows that agree in id and
text the one whose JSON form is least stays. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize

#: Groups that hold over this share (one in so many) of all copies are broadcast whatever the number of groups.
HOT_GROUPS = 100_000


def content_hash(text: Column) -> Column:
    """128 bits of MD5."""
    return F.unhex(F.md5(text))


def _hashed(docs: DataFrame, id_col: str, text_col: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("t"), hash_of(text).alias("h"))


def _groups(rows: DataFrame, keys: list[str], keep: str) -> DataFrame:
    best = (F.min if keep == "min" else F.max)("id")
    return rows.groupBy(*keys).agg(best.alias("keep_id"), F.sum("m").alias("n")).filter("n > 1")


def _hot(groups: DataFrame) -> Column:
    """Whether a group holds over this share of all copies; fewer than `HOT_GROUPS` can."""
    return F.col("n") > groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_GROUPS


def with_groups(rows: DataFrame, groups: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`rows` with the columns of their group (h, keep_id, n), null for hashes without one."""
    if groups.count() <= broadcast_rows:
        return rows.join(F.broadcast(groups), "h", "left")
    hot = _hot(groups)
    large = F.broadcast(groups.filter(hot))
    rest = rows.join(large.select("h"), "h", "left_anti").join(groups.filter(~hot).hint("merge"), "h", "left")
    return rows.join(large, "h").unionByName(rest)


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Groups of more than one row: (h, keep_id, n) for hashes that stand for one text, and (h, t, keep_id, n) for texts of hashes that stand for several."""
    rows = _hashed(docs, id_col, text_col, hash_of)
    groups = materialize(_groups(rows.select("h", "id", F.lit(1).alias("m")), ["h"], keep), "exact-groups")
    texts = rows.select("h", "t")
    if groups.count() <= broadcast_rows:
        wanted = texts.join(F.broadcast(groups.select("h")), "h", "left_semi")
    else:
        share = _hot(groups)
        hot, cold = F.broadcast(groups.filter(share).select("h")), groups.filter(~share).select("h")
        rest = texts.join(hot, "h", "left_anti").join(cold.hint("merge"), "h", "left_semi")
        wanted = texts.join(hot, "h", "left_semi").unionByName(rest)
    spread = wanted.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    collided = materialize(spread.filter("lo <> hi").select("h"), "exact-collisions")
    again = _groups(rows.join(collided, "h", "left_semi").withColumn("m", F.lit(1)), ["h", "t"], keep)
    if collided.isEmpty():
        return groups, again.limit(0)
    return groups.join(collided, "h", "left_anti"), again


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per input row: its id, `keep_id` (the id that stays of its group), `group_size`, `kept`, `text_sha256`."""
    rows = _hashed(docs, id_col, text_col, hash_of)
    groups, apart = duplicate_groups(docs, id_col, text_col, keep, hash_of, broadcast_rows)
    # rows that agree in everything that is returned are counted first and told apart again at the end
    keyed = rows.select("h", "id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"))
    counted = materialize(keyed.groupBy("h", "sha", "id").agg(F.count(F.lit(1)).alias("m")), "exact-rows")
    split = materialize(apart.select("h", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha"), "keep_id", "n"), "exact-apart")
    found = with_groups(counted, groups, broadcast_rows)
    if not split.isEmpty():
        found = found.join(split.select("h", "sha", F.col("keep_id").alias("k2"), F.col("n").alias("n2")), ["h", "sha"], "left")
    else:
        found = found.withColumns({"k2": F.lit(None).cast(found.schema["id"].dataType), "n2": F.lit(None).cast("long")})
    n = F.coalesce("n", "n2")
    keep_id = F.when(n.isNull(), F.col("id")).when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("k2"))
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("copy")
    out = found.select("id", "sha", keep_id.alias("k"), F.coalesce(n, F.lit(1)).cast("long").alias("size"), copy)
    kept = F.col("id").eqNullSafe(F.col("k")) & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id_col), F.col("k").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    hash_of: Callable[[Column], Column] = content_hash,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups, apart = duplicate_groups(docs, id_col, text_col, keep, hash_of, broadcast_rows)
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), hash_of(text).alias("h"), F.col(id_col).alias("id"), text.alias("t"))
    marked = with_groups(own, groups, broadcast_rows)
    if not apart.isEmpty():
        marked = marked.join(apart.select("h", "t", F.col("keep_id").alias("k2"), F.col("n").alias("n2")), ["h", "t"], "left")
        marked = marked.select("row", "h", "id", "t", F.when(F.col("n").isNotNull(), F.col("keep_id")).otherwise(F.col("k2")).alias("keep_id"), F.coalesce("n", "n2").alias("n"))
    single = marked.filter("n is null").select("row.*")
    # of a group, the rows with the id that stays: more than one only where a row is repeated
    best = marked.filter("n is not null and id <=> keep_id").groupBy("h", "t").agg(F.min_by("row", F.to_json("row", {"ignoreNullFields": "false"})).alias("row")).select("row.*")
    return single.unionByName(best)
