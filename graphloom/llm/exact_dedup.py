"""Exact deduplication by skew-safe combining.

Every text is reduced to its digest and normalised content, and every row is
salted.  Combining runs in three stages, and the full content is a grouping key,
so is compared, in each:

1. local: the map-side half of the salted aggregate merges equal texts inside a task;
2. salted: its reduce side merges by (digest, salt, content), so a group that
   holds a third of all rows is dealt over ``salts`` keys;
3. global: one row per salt and class is merged into the class's winner.

The winners travel back by (digest, salt), so no join key is hot.  That key names
a class only where its digest has one content; of digests with several, found
when the winners are combined, the way back compares the content too.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of, text_or_empty

#: What normalisation deletes; fixed by the definition of equality.
BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 64  #: At most 64: a class's salts travel as the bits of one number.
#: More than any id's part of a rank.
_STEP = Decimal(2**65)


def normalise(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def _rank() -> Column:
    """Orders rows by code points, then smaller id, null ids last, in one number that a hash aggregate can hold."""
    by_id = F.coalesce(F.lit(Decimal(2**63)).cast("decimal(38,0)") - F.col("doc_id"), F.lit(0))
    return (F.col("n").cast("decimal(38,0)") * F.lit(_STEP) + by_id).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    by_id = rank % F.lit(_STEP)
    return F.when(by_id > 0, (F.lit(Decimal(2**63)).cast("decimal(38,0)") - by_id).cast("long"))


def digest(content: Column) -> Column:
    return F.coalesce(F.sha2(content, 256), F.lit(""))  # never null, and so no filter repeats it


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``,
    code points ``n`` and ``row_tag``, a hash of the original text.

    The row with the most code points in its original text stays, then the one
    with the smallest id.  Null texts count as empty; a null id loses to any
    other; rows that repeat an id are all counted and share its ``kept``.  Rows
    alike in id and text share a salt: a task merges them before the shuffle.
    An empty table gives an empty result; further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        "doc_id",
        normalise(F.col("text")).alias("content"),
        F.length("text").cast("long").alias("n"),
        F.xxhash64("text").alias("row_tag"),
    ).withColumn("text_sha256", digest(F.col("content")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "row_tag"), F.lit(salts)).cast("int"))
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    # A digest has one row per salt and content by now: dealt by digest, its contents meet in one place.
    winners = salted.repartition("text_sha256").groupBy("text_sha256", "content").agg(
        F.max("best").alias("best"), F.sum("group_size").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    # Of a digest with one content, each of these is that content's.
    per_digest = winners.groupBy("text_sha256").agg(
        F.count(F.lit(1)).alias("contents"), F.max("best").alias("best"), F.max("group_size").alias("group_size"), F.bit_or("salts").alias("salts")
    )
    per_digest = materialise(per_digest)
    out = _way_back(rows.drop("content"), per_digest.filter("contents = 1"), ["text_sha256", "salt"], salts)
    several = per_digest.filter("contents > 1").select("text_sha256")
    if not several.isEmpty():
        apart = rows.join(several, "text_sha256", "left_semi")
        known = _way_back(rows.join(several, "text_sha256", "left_anti").drop("content"), per_digest, ["text_sha256", "salt"], salts)
        out = known.unionByName(_way_back(apart, winners.join(several, "text_sha256", "left_semi"), ["text_sha256", "content", "salt"], salts))
    return out


def _way_back(rows: DataFrame, winners: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Every row with its class's winner, by ``keys`` and one row of the winner for each salt that it has."""
    present = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda k: F.call_function("getbit", F.col("salts"), k) == 1)
    routes = winners.select(*[k for k in keys if k != "salt"], _ranked_id(F.col("best")).alias("keep_id"), "group_size", F.explode(present).alias("salt"))
    return rows.join(routes, keys).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n", "row_tag"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and in their form.

    Rows that repeat the id of the row that stays, in its group, leave one row.
    """
    stays = exact_groups(docs, id_col, text_col, salts).filter("kept").groupBy("doc_id", "text_sha256")
    return rows_of(docs, stays.agg(F.max(F.struct("n", "row_tag"))["row_tag"].alias("row_tag")).drop("text_sha256"), id_col, text_col)
