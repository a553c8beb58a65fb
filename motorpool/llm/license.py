"""Licence scans by diagonal voting over word k-grams."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motorpool.llm.common import joined, map_texts

#: Base phrases and their labels; the first words of well-known notices, with ours.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "released under the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-2.0",
    "gnu general public license version 3": "gpl-3",
    "gnu general public license version 2": "gpl-2",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-text",
    "permission to use copy modify and or distribute this software for any purpose": "isc-text",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
K = 2
#: Diagonals at most this far apart are one reading of a template with words put in or left out.
NEAR = 2
#: Share of a notice's k-grams that a span must hold.
COVER = 0.75
#: Template k-grams up to this number go to every task; beyond it the join shuffles.
BROADCAST_GRAMS = 100_000

# Word bytes are 0-9, a-z and everything from 0x80; A-Z become a-z, the rest parts words.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TO_WORDS).split()


def grams(tokens: Sequence[bytes], known: dict[bytes, int], k: int = K) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words; ``known`` keeps the hashes of words seen before."""
    for w in tokens:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    hashes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    if len(tokens) < k:
        return np.empty(0, np.int64)
    n = len(tokens) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * _MIX[j % 4] + np.uint64(j)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


_ROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.list_(pa.int64()))])
TEMPLATES = "template string, label string, base boolean, grams int, tpos int, gram long"


def template_rows(spark: SparkSession, base: Mapping[str, str], notices: Mapping[str, str], k: int = K) -> tuple[DataFrame, int]:
    rows = []
    for is_base, texts in ((True, base), (False, notices)):
        for text, label in texts.items():
            positions = grams(words(text), {}, k)
            if not len(positions):
                raise ValueError(f"a template needs at least {k} words: {text!r}")
            rows += [(text, label, is_base, len(positions), i, int(g)) for i, g in enumerate(positions)]
    return spark.createDataFrame(rows, TEMPLATES), len(rows)


def scan(docs: DataFrame, base: Mapping[str, str] = PHRASES, notices: Mapping[str, str] = NOTICES, k: int = K, near: int = NEAR, cover: float = COVER) -> DataFrame:
    """Spans of templates in ``docs(doc_id, text)``, one row per document with its spans.

    Every rolling k-gram of every document is joined to the template positions that hold it;
    the matches vote for ``(document, template, position - template position)``. Diagonals
    within ``near`` of each other merge, the votes of one template position counting once. A
    notice is found where a merged band covers ``cover`` of its k-grams in their order. A base
    phrase is found at each single diagonal that holds all its k-grams, hence all its words.

    Rows without a match stay as one row until the last grouping, so the text is read once.
    Texts that are null or have too few words have no spans; a null doc_id is kept; each
    repeated row counts as a document of its own; other columns are not read.
    """
    known: dict[bytes, int] = {}

    def rows(columns: list[list]) -> Iterable[tuple]:
        if len(known) > 500_000:
            known.clear()
        for doc_id, text in zip(*columns):
            tokens = words(text)
            yield doc_id, len(tokens), grams(tokens, known, k)

    templates, n_rows = template_rows(docs.sparkSession, base, notices, k)
    read = map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, _ROW)
    places = read.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "doc_id", "n_words", F.posexplode_outer("grams").alias("pos", "gram")
    )
    votes = (
        places.join(F.broadcast(templates) if n_rows <= BROADCAST_GRAMS else templates, "gram", "left")
        .filter(F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
        .groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"))
        .agg(F.collect_list("tpos").alias("at"))
    )
    in_order = W.partitionBy("row", "template").orderBy("diagonal")
    new_band = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > near, F.lit(True)) | F.col("base")
    bands = votes.withColumn("band", F.sum(new_band.cast("int")).over(in_order))
    merged = bands.groupBy("row", "doc_id", "n_words", "template", "label", "base", "grams", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("held"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("start"),
        F.max(F.col("diagonal") + F.array_max("at") + k).alias("end"),
    )
    share = F.col("held") / F.col("grams")
    in_shape = F.col("end") - F.col("start") <= F.col("grams") + k - 1 + near * 2
    verified = F.when(F.col("base"), F.col("held") == F.col("grams")).otherwise((share >= cover) & in_shape)
    span = F.struct(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        "label", "template", "base", share.alias("share"),
    )
    found = merged.groupBy("row", "doc_id", "n_words").agg(
        F.sort_array(F.collect_list(F.when(F.coalesce(verified, F.lit(False)), span))).alias("spans"),
        F.coalesce(F.max(F.when(in_shape, share)), F.lit(0.0)).alias("score"),
    )

    def best(s: Column) -> Column:
        """A notice inside a better reading of the same words is not a second licence."""
        better = F.exists("spans", lambda o: (o["share"] > s["share"]) & (o["start"] <= s["start"]) & (o["end"] >= s["end"]))
        return s["base"] | ~better

    return found.withColumn("spans", F.filter("spans", best)).drop("row")


def license_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = [joined(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"])))) for x in (base, F.col("spans"))]
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast(T.LongType()).alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels[0].alias("base_labels"),
        labels[1].alias("labels"),
        F.least(F.col("score"), F.lit(1.0)).alias("score"),
    )
