"""Exact dedup by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import free_name, lower_ascii
from motorpool.session import materialise

#: A digest's rows are dealt to this many salts, so a text that fills a third of the table is
#: shared by as many tasks and leaves at most this many rows for the last combining.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(salted: DataFrame) -> DataFrame:
    """One row per digest and text, compared in full in each task, in each salted group and then
    over all salts. Dealing the winners by digest alone lets later steps by digest stay in place."""
    local = salted.groupBy("digest", "salt", "norm").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    return local.repartition("digest").groupBy("digest", "norm").agg(
        F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.collect_set("salt").alias("salts")
    )


def mark_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    Texts are equal when they are the same after lower-casing A-Z; null counts as empty. The
    largest doc_id of equal texts stays.

    1. Each task combines its own rows by (digest, salt, text) before anything moves, and
       salted groups merge by the same key.
    2. The winners of the salts combine by (digest, text): at most ``salts`` rows a text. The
       outcome, without the texts, is written to the shared folder.
    3. Winners go back to their rows by (digest, salt), so a hot text stays spread. Where step 2
       found several texts under one digest, the rows of that digest, and only they, take their
       text along and are compared in full once more.

    Rows that share doc_id and text get the same verdict, each row being returned. A null
    doc_id counts in its group, loses to any number and stays only if its whole group has none.
    An empty table gives an empty result; other columns are not read.
    """
    norm = lower_ascii(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    by_digest = _combined(salted).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
        F.array_distinct(F.flatten(F.collect_list("salts"))).alias("salts"),
    )
    winners = materialise(by_digest, "winners")
    alone = winners.filter("texts = 1").select("digest", "keep_id", "group_size", F.explode("salts").alias("salt"))
    marked = salted.select("doc_id", "digest", "salt").join(alone, ["digest", "salt"])
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    found = marked.select(columns)
    shared = winners.filter("texts > 1").select("digest")
    if not shared.isEmpty():
        rest = salted.join(shared, "digest", "left_semi")
        among = _combined(rest).select("digest", "norm", "keep_id", "group_size", F.explode("salts").alias("salt"))
        found = found.unionByName(rest.join(among, ["digest", "salt", "norm"]).select(columns))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows that ``mark_copies`` drops."""
    doc_id, digest = free_name(docs, "dropped_id"), free_name(docs, "dropped_digest")
    dropped = mark_copies(docs).filter(~F.col("kept")).select(F.col("doc_id").alias(doc_id), F.col("digest").alias(digest)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (sha256(lower_ascii(F.col("text"))) == F.col(digest))
    return docs.join(dropped, same, "left_anti")


def exact_digest(docs: DataFrame) -> DataFrame:
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
