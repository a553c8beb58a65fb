"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts, text_key, without_texts
from motorpool.llm.near import WORDS, Shingler
from motorpool.session import materialise

#: A document holds an item when it has at least this share of the item's shingles.
PERCENT = 80
#: Bins per shingle of the largest document in a size partition, a power of two: with 4, a shared
#: shingle is its bin's least in the document at least 88 times in 100, so an item of 8 shingles,
#: of which 7 are shared, is missed three times in ten million.
BINS = 4
#: Items of fewer shingles are looked up by all of them, as too few bins would speak for them.
FEW = 8
#: Sketch values of all items, up to this number, go to every task to leave out documents that
#: meet none; beyond it every document's sketch is joined to them by a shuffle.
BROADCAST_VALUES = 4_000_000

_ITEM = pa.schema([("item_id", pa.int64()), ("n_item", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_SKETCH = pa.schema([("item_id", pa.int64()), ("part", pa.int32()), ("value", pa.int64())])
_HITS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("hits", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
#: The partition that stands for every size, for items of few shingles.
ANY = -1


def part_of(n: int) -> int:
    """Partition p has the documents of more than 2^(p-1) and up to 2^p shingles."""
    return max(0, (n - 1).bit_length())


def sketch(shingles: np.ndarray, part: int, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash: the least hash of every bin that has any. Hashes come sorted and
    a bin is given by their top bits, so the least is the first of its bin."""
    bits = part + bins.bit_length() - 1
    if not bits:
        return shingles[:1]
    bin_of = shingles >> np.uint64(64 - bits)
    return shingles[np.concatenate([[True], bin_of[1:] != bin_of[:-1]])] if len(shingles) else shingles


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, words: int = WORDS, bins: int = BINS, few: int = FEW, most: int = BROADCAST_VALUES) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)`` for every document of
    ``docs(doc_id, text)`` that holds an item of ``items(item_id, text)``.

    Documents are partitioned by the size of their shingle set and sketched with as many bins
    as their partition's largest set calls for; an item is sketched once for each partition
    that can hold it. A bin in which both have the same least shingle makes a candidate, and
    candidates count only if the item's shingles are in the document's full set.

    Words and shingles are those of the near-duplicates. Items or documents of null, or without
    words, hold and match nothing; rows without an id are left out; rows that repeat an id are
    one document (or item) with the shingles of all; an empty table gives an empty result;
    other columns are not read.
    """
    shingler = Shingler(words)

    def item_rows(columns: list[list]) -> Iterable[tuple]:
        for item_id, text in zip(*columns):
            s = shingler.set(text)
            yield item_id, len(s), s.view(np.int64)

    chosen = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    known = materialise(map_texts(chosen, item_rows, _ITEM).filter("n_item > 0"), "items")

    def item_sketches(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for item_id, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles.values.to_numpy(zero_copy_only=False).view(np.uint64)
                parts = [ANY] if len(s) < few else range(part_of(-(-percent * len(s) // 100)), 40)
                for p in parts:
                    values = s if p == ANY else sketch(s, p, bins)
                    columns = [pa.array([item_id] * len(values), pa.int64()), pa.array([p] * len(values), pa.int32()), pa.array(values.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, schema=_SKETCH)

    sketches = materialise(known.select("item_id", "shingles").mapInArrow(item_sketches, "item_id long, part int, value long"), "sketches")
    values = sketches.select("part", "value").distinct()
    sought = None
    if values.count() <= most:
        table = values.toArrow()
        by_part = table.column("part").to_numpy(), table.column("value").to_numpy().view(np.uint64)
        sought = docs.sparkSession.sparkContext.broadcast({int(p): np.sort(by_part[1][by_part[0] == p]) for p in np.unique(by_part[0])})

    def doc_rows(columns: list[list]) -> Iterable[tuple]:
        wanted = sought.value if sought else None
        for doc_id, text in zip(*columns):
            s = shingler.set(text)
            part = part_of(len(s))
            least = sketch(s, part, bins)
            full = s
            if wanted is not None:
                least = np.intersect1d(least, wanted.get(part, s[:0]), assume_unique=True)
                full = np.intersect1d(s, wanted.get(ANY, s[:0]), assume_unique=True)
            found = [(p, v) for p, v in ((part, least), (ANY, full)) if len(v)]
            for n, (p, v) in enumerate(found):
                yield doc_id, p, v.view(np.int64), s.view(np.int64) if n == 0 else None

    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = materialise(map_texts(texts, doc_rows, _HITS), "hits")
    candidates = hits.select("doc_id", "part", F.explode("hits").alias("value")).join(sketches, ["part", "value"]).select("doc_id", "item_id").distinct()
    held = hits.select("doc_id", F.explode("shingles").alias("shingle")).distinct()
    wanted = known.select("item_id", F.explode("shingles").alias("shingle")).distinct()
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    shared = held.join(wanted, "shingle").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    verified = shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    return verified.filter(100 * F.col("n_shared") >= percent * F.col("n_item")).select(
        "doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` with all its columns, without the rows whose text holds an item. A row is judged by
    its own text, whatever its id: rows without an id go too, and others of an id stay."""
    keyed = docs.select(text_key(F.col("text")).alias("doc_id"), "text")
    return without_texts(docs, contained(keyed, items).select("doc_id"))
