"""Exact dedup by 128-bit content hash; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PRUNE_TEXTS, ascii_lower, settings, staged


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by a 128-bit hash of the normalised text; the smallest id
    (or the largest, with keep="max") stays. Texts that share a hash are compared
    byte by byte: inside every hash group of several rows the distinct texts are
    counted, and a group with two or more is grouped anew by the texts themselves.

    Null text is the empty text; a text of any length is hashed and compared whole. An
    empty table gives no rows. A null id is never chosen while its group has
    another; in a group of null ids alone keep_id is null and none is kept.
    Rows that repeat both id and text are one document: they carry the same
    values, and all of them are kept or none. Other columns are ignored.

    The texts are read twice and shuffled only where a hash repeats; what is
    shuffled for all rows is a hash and an id. Hot groups are aggregated before
    the shuffle, and the join back gives every row one partner, so that Spark can
    split a hot hash among tasks.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"),
    )
    keyed = staged(
        rows.select("_id", content_hash(F.col("_text")).alias("_h"), F.sha2("_text", 256).alias("text_sha256")),
        "dedup-keys",
    )
    groups = staged(keyed.groupBy("_h").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "dedup-groups")
    several = groups.filter(F.col("group_size") > 1).select("_h")
    hashed = rows.select(content_hash(F.col("_text")).alias("_h"), "_text", "_id")
    with settings(docs.sparkSession, PRUNE_TEXTS):
        collided = staged(
            hashed.groupBy("_h", "_text").agg(F.count(F.lit(1)).alias("_n"))
            .select("_h").join(several, "_h", "left_semi")
            .groupBy("_h").agg(F.count(F.lit(1)).alias("_texts"))
            .filter(F.col("_texts") > 1).select("_h"),
            "dedup-collisions",
        )
    out = keyed
    if not collided.isEmpty():
        # The text joins the key, through the only hash that tells the two apart
        # here: its own bytes' group, numbered by the group's chosen id and text.
        texts = hashed.join(collided, "_h", "left_semi")
        classes = texts.groupBy("_h", "_text").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        again = staged(
            texts.join(classes, ["_h", "_text"]).select("_id", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"),
            "dedup-classes",
        )
        out = keyed.join(collided, "_h", "left_anti").join(groups, "_h").select("_id", "text_sha256", "keep_id", "group_size").unionByName(again)
    else:
        out = keyed.join(groups, "_h")
    return out.select(
        F.col("_id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row of docs for each text, columns unchanged: that of the id which exact_dedup
    keeps. Rows are told apart by id and text, so an id that repeats with another text is
    another document. Of rows that repeat both one stays; a row with a null id stays
    where its text has no other id. Null, empty and very long texts and an empty table
    are as in exact_dedup; columns may have any names."""
    rows = exact_dedup(docs, id_col, text_col, keep)

    def key(id_: Column) -> list[Column]:
        return [F.coalesce(id_, F.lit(0).cast("long")).alias("_id"), id_.isNull().alias("_unnamed")]

    stays = rows.filter("kept or keep_id is null").select(*key(F.col(id_col)), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key(F.col(id_col).cast("long")), sha.alias("_sha"))
    return packed.join(stays, ["_id", "_unnamed", "_sha"], "left_semi").dropDuplicates(["_id", "_unnamed", "_sha"]).select("_row.*")
