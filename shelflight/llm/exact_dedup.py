"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after every word-separating character is deleted.
Of equal texts the row with the most code points in the original text stays, then
the smallest doc_id. Three rounds find it:

1. each task combines the equal texts it reads (Spark's map-side aggregation);
2. their rows meet by digest and a salt, so a group that holds a third of all
   rows is merged by as many tasks as there are salts;
3. the salts' winners meet by digest.

Every round groups by the digest and the whole normalised text. Members find
their winner by digest alone where a digest belongs to one text, which the third
round knows; should a digest belong to several, the join compares the text too.

Nulls: a null text counts as empty; empty and blank texts equal each other. Null
doc_ids sort last. A row given twice counts twice in the group and comes out
twice, kept if its doc_id is the winner. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import BLANK_CLASS, only_rows, settle, text_key

SALTS = 16

_LARGEST = str(2**63 - 1)
_STEP = str(2 * 10**19)


def normalised(text: Column | str = "text") -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANK_CLASS}]+", "")


def digest(normal: Column) -> Column:
    return F.sha2(normal, 256)


def _rank(chars: Column, doc_id: Column) -> Column:
    """Orders the rows of a group as one number, which hash aggregation can keep.

    More code points first, then the smaller doc_id; the largest rank stays.
    """
    below = F.lit(_LARGEST).cast("decimal(20,0)") - doc_id.cast("decimal(20,0)")
    return (chars.cast("decimal(18,0)") * F.lit(_STEP).cast("decimal(20,0)") + below).cast(
        "decimal(38,0)"
    )


def _ranked_id(rank: Column) -> Column:
    below = rank % F.lit(_STEP).cast("decimal(38,0)")
    return (F.lit(_LARGEST).cast("decimal(38,0)") - below).cast("long")


def winners(documents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per digest and text: the doc_id that stays and the size of its group."""
    rank = _rank(F.char_length(F.coalesce("text", F.lit(""))), F.col("doc_id"))
    read = documents.select(
        normalised().alias("normal"), rank.alias("rank"), F.spark_partition_id().alias("part")
    )
    read = read.withColumn("digest", F.unhex(digest(F.col("normal"))))
    # Rounds 1 and 2: what a task has read is combined before it leaves the task.
    salted = (
        read.groupBy("digest", "normal", (F.col("part") % salts).alias("salt"))
        .agg(F.max("rank").alias("rank"), F.count("*").alias("rows"))
    )
    # Round 3.
    merged = salted.groupBy("digest", "normal").agg(
        F.max("rank").alias("rank"), F.sum("rows").alias("group_size")
    )
    return merged.select("digest", "normal", _ranked_id(F.col("rank")).alias("keep_id"), "group_size")


def exact_groups(documents: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chars, text_key."""
    found = winners(documents, salts)
    # One row per digest. A digest of several texts is marked and looked up by text.
    by_digest = settle(
        found.groupBy("digest").agg(
            F.min("keep_id").alias("keep_id"),
            F.sum("group_size").alias("group_size"),
            F.count("*").alias("texts"),
        ),
        "exact-winners",
    )
    read = documents.select(
        "doc_id",
        normalised().alias("normal"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("chars"),
        text_key().alias("text_key"),
    ).withColumn("digest", F.unhex(digest(F.col("normal"))))
    members = read.drop("normal")
    alone = members.join(by_digest.where("texts = 1"), "digest").drop("texts")
    shared = by_digest.where("texts > 1").select("digest")
    if not shared.isEmpty():
        apart = found.join(shared, "digest", "left_semi")
        rest = read.join(apart, ["digest", "normal"]).drop("normal")
        alone = alone.unionByName(rest.select(*alone.columns))
    return alone.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "chars",
        "text_key",
    )


def drop_exact_copies(documents: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents without the rows whose text another row stands for.

    Of rows that share the winner's doc_id, the one with the most code points stays.
    """
    kept = exact_groups(documents, salts).where("kept")
    first = F.max(F.struct("chars", "text_key", "doc_id")).alias("row")
    winners = kept.groupBy("text_sha256", "keep_id").agg(first)
    return only_rows(documents, winners.select("row.doc_id", "row.text_key"))
