"""Exact deduplication by content hash, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, free_name, stash


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are compared after lower-casing A-Z; a null text counts as empty. The
    group's row with the smallest id stays (``keep="max"``: the largest).

    Groups form on the first 128 bits of the text's SHA-256. The aggregation that
    builds them has the text itself as a second key, so Spark compares bytes, and
    each map task sends a text once however often it holds it. A hash that turns
    out to belong to several texts is rare beyond measure, but its rows would be
    grouped by text instead. Only groups of two or more are joined back to the
    rows: that join reads both sides from scans, so AQE splits a hot group.

    Null ids belong to a group but are never the row that stays, unless the whole
    group has none: then keep_id is null and no row is kept. Rows with the same id
    and text are all kept. An empty table gives an empty result. Other columns are
    not read, whatever their names.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_text")).withColumn("_sha", F.sha2("_text", 256))
    rows = rows.withColumn("_hash", F.unhex(F.substring("_sha", 1, 32)))
    texts = rows.groupBy("_hash", "_text").agg(F.count("*").alias("_n"), pick("_id").alias("_keep"))
    hashes = texts.groupBy("_hash").agg(F.sum("_n").alias("_n"), pick("_keep").alias("_keep"), F.count("*").alias("_texts"))
    groups = stash(hashes.where("_n > 1"))

    light = rows.select("_id", "_hash", "_sha")
    clashes = groups.where("_texts > 1")
    if clashes.isEmpty():
        joined = light.join(groups.drop("_texts"), "_hash", "left")
    else:
        clean = light.join(groups.drop("_texts"), "_hash", "left").join(clashes.select("_hash"), "_hash", "left_anti")
        apart = rows.join(clashes.select("_hash"), "_hash", "left_semi")
        by_text = stash(apart.groupBy("_hash", "_text").agg(F.count("*").alias("_n"), pick("_id").alias("_keep")))
        joined = clean.unionByName(apart.join(by_text, ["_hash", "_text"]).drop("_text"))
    single = F.col("_n").isNull()
    keep_id = F.when(single, F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_n"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_id") == keep_id, F.lit(False)).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    One row stays for each text, also where ids are null or rows repeat: with
    the smallest (largest) id, nulls last, and then any of the equal rows. Null
    and empty texts are one text. An empty table gives an empty result; columns
    keep their names and values, whatever they are called.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    groups = exact_groups(docs, id_col, text_col, keep).where("group_size > 1")
    extra = stash(groups.select(F.col(id_col).alias("_id"), "kept", F.unhex(F.substring("text_sha256", 1, 32)).alias("_hash"), "keep_id"))
    lost = extra.where("not kept and keep_id is not null").select("_id", "_hash").distinct()
    repeated = extra.where("kept or keep_id is null").groupBy("_id", "_hash").agg(F.count("*").alias("_copies")).where("_copies > 1")
    name = free_name("_hash", docs.columns)
    marked = docs.withColumn(name, F.unhex(F.substring(F.sha2(norm, 256), 1, 32)))
    same = lambda other: (marked[id_col].eqNullSafe(other["_id"])) & (marked[name] == other["_hash"])
    stays = marked.join(lost, same(lost), "left_anti")
    if repeated.isEmpty():
        return stays.drop(name)
    once = stays.join(repeated, same(repeated), "left_semi").dropDuplicates([id_col, name])
    return stays.join(repeated, same(repeated), "left_anti").unionByName(once).drop(name)
