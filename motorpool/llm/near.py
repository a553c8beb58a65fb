"""Near-duplicates by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motorpool.llm.common import free_name, map_texts, text_key
from motorpool.session import materialise

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: 26 bands of 5 coordinates miss a pair at 0.85 once in four million.
BANDS, ROWS = 26, 5
#: A bucket of up to this many sets has its pairs checked at once; a larger one goes by centres.
SMALL_BUCKET, CENTRES = 64, 32

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_COLUMNS = 1024


class Shingler:
    """Sets of shingle hashes; keeps the hashes of words seen before, up to a bound."""

    def __init__(self, words: int = WORDS, known: int = 100_000):
        self.words, self.most, self.known = words, known, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """A 64-bit hash of every run of ``words`` words, or of the whole sequence if shorter.

        A-Z are lower-cased; words are parted by blanks, tabs and line ends.
        """
        tokens = (text or "").encode().lower().split()
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in tokens:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(self.words, len(tokens))
        if not k:
            return codes
        n = len(tokens) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = (out ^ codes[j : j + n]) * _MIX[j % len(_MIX)]
            out ^= out >> np.uint64(31)
        return out

    def set(self, text: str | None) -> np.ndarray:
        return np.unique(self.hashes(text))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A fixed permutation of the 32-bit numbers, in place."""
    tmp = np.empty_like(x)
    for shift, factor in ((16, first), (13, second), (16, None)):
        x ^= np.right_shift(x, shift, out=tmp)
        if factor is not None:
            x *= np.uint32(factor)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Coordinate k is the least of ``p(s(i) - k)`` over the set: one permutation ``s`` breaks
    structure in the set, and circular shifts of the one permutation ``p`` give all coordinates."""
    x = _permute((shingles >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for first in range(0, len(x), _COLUMNS):
        block = _permute(x[None, first : first + _COLUMNS] - shifts, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(least, block.min(axis=1), out=least)
    return least


def bands(least: np.ndarray, n: int, rows: int) -> list[int]:
    """One 64-bit key per band, different bands never sharing a key on purpose."""
    data = least.reshape(n, rows)
    return [xxhash.xxh3_64_intdigest(data[i].tobytes(), seed=i) - (1 << 63) for i in range(n)]


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
_COMPARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("ref_n", pa.int64()), ("missing", pa.list_(pa.int64()))])
#: What a set lacks of its bucket's centre is told up to this share of the centre.
LACKING = 0.4


def sets_of(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, words: int = WORDS) -> DataFrame:
    """Size, digest and band keys of each document's shingle set; whole texts, nothing shuffled."""
    shingler = Shingler(words)

    def run(columns: list[list]) -> Iterable[tuple]:
        for doc_id, text in zip(*columns):
            s = shingler.set(text)
            keys = bands(signature(s, n_bands * rows), n_bands, rows) if len(s) else []
            yield doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, keys

    return map_texts(docs, run, _SETS)


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes in ``links(a, b)``: the smallest node each can reach.

    Each round takes the least label among neighbours and then the label of that label, so
    distances halve; rounds are written to the shared folder, and only a count of changed
    labels comes to the driver.
    """
    edges = materialise(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(),
        "edges",
    )
    labels = materialise(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("v"), F.col("label")), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("u").alias("mid"), F.col("label").alias("far"))
        moved = hooked.join(jump, "mid").select("u", F.least("mid", "far").alias("label"), (F.least("mid", "far") < F.col("old")).alias("moved"))
        moved = materialise(moved, "labels")
        labels = moved.select("u", "label")
        if moved.filter("moved").isEmpty():
            return labels.select(F.col("u").alias("node"), F.col("label").alias("component"))


def compared(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs with whether their full shingle sets are as similar as asked, the size of a's set
    and, unless it is much, what b lacks of it. Both texts travel once to each pair; rows
    arrive by ``a``, whose set is kept while it repeats."""
    shingler = Shingler(words)
    last: list = [None, None]

    def run(columns: list[list]) -> Iterable[tuple]:
        for a, b, text_a, text_b in zip(*columns):
            if last[0] != (a, text_a):
                last[:] = [(a, text_a), shingler.set(text_a)]
            one, other = last[1], shingler.set(text_b)
            missing = np.setdiff1d(one, other, assume_unique=True)
            both = len(one) - len(missing)
            linked = 100 * both >= percent * (len(one) + len(other) - both)
            yield a, b, linked, len(one), missing.view(np.int64) if len(missing) <= LACKING * len(one) else None

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    full = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return map_texts(full.select("a", "b", "text_a", "text_b"), run, _COMPARED, text=3)


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    return compared(pairs, texts, percent, words).filter("linked").select("a", "b")


_SHINGLES = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shared_sizes(texts: DataFrame, words: int) -> DataFrame:
    """``(node, alone)``: how many of a node's shingles no other node has.

    They cannot be in an intersection, which bounds what a node can be linked to without
    looking at pairs. A node of several texts has no bound.
    """
    shingler = Shingler(words)

    def run(columns: list[list]) -> Iterable[tuple]:
        for node, text in zip(*columns):
            yield node, shingler.set(text).view(np.int64)

    held = map_texts(texts, run, _SHINGLES).select("node", F.explode("shingles").alias("shingle"))
    once = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("node")).filter("nodes = 1")
    several = texts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return once.groupBy("node").agg(F.count(F.lit(1)).alias("alone")).join(several, "node", "left_anti")


def may_link(n: str, shared: str, m: str, other: str, percent: int) -> Column:
    """Whether sets of sizes ``n`` and ``m``, of which ``shared`` and ``other`` shingles are anywhere
    else, can be as similar as asked: the intersection has no more than the lesser of the two."""
    return (100 + percent) * F.least(shared, other) >= percent * (F.col(n) + F.col(m))


def _linkable(members: DataFrame, percent: int) -> DataFrame:
    """Members that could link with the smallest set of their bucket, in buckets of two or more,
    and the bucket's centre: the set with the fewest shingles of its own, from which the others
    of a group of near-copies are likely to come."""
    least = members.groupBy("key").agg(F.min("n").alias("least"))
    able = members.join(least, "key").filter((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("least"))).drop("least")
    own = F.struct(F.col("n") - F.col("shared"), "node")
    met = able.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", own).alias("centre")).filter("size > 1")
    return able.join(met, "key")


def _pairs(members: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components whose sizes allow a link, each once: from the
    first of the buckets in which both meet, and in order where the other is ``chosen`` too. A
    node is in as many buckets as there are bands at most.

    Two sets share no more than what neither lacks of their bucket's centre, and of what is
    shared outside of it the lesser amount; that leaves out most pairs of a group of copies
    that differ from one text in different places."""

    def with_keys(side: DataFrame) -> DataFrame:
        return side.join(side.groupBy("node").agg(F.sort_array(F.collect_set("key")).alias("keys")), "node")

    x, y = with_keys(members).alias("x"), with_keys(others).alias("y")
    apart = F.col("x.component") != F.col("y.component")
    first = F.col("x.key") == F.array_intersect("x.keys", "y.keys")[0]
    once = (~F.col("y.chosen") | (F.col("x.node") < F.col("y.node"))) & first
    common = F.col("x.ref_n") - F.size(F.array_union("x.missing", "y.missing")) + F.least("x.extra", "y.extra")
    told = (F.col("x.ref") == F.col("y.ref")) & F.col("x.missing").isNotNull() & F.col("y.missing").isNotNull()
    alike = ~told | ((100 + percent) * common >= percent * (F.col("x.n") + F.col("y.n")))
    wanted = (F.col("x.key") == F.col("y.key")) & apart & may_link("x.n", "x.shared", "y.n", "y.shared", percent) & alike & once
    return x.join(y, wanted).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def linked_in_buckets(buckets: DataFrame, texts: DataFrame, alone: DataFrame, percent: int, words: int, small: int = SMALL_BUCKET, centres: int = CENTRES) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` that connect all nodes with a link inside a bucket, and their components.

    ``buckets(key, node, n)`` are nodes that may link and the sizes of their sets, ``texts(node,
    text)`` what they are verified on, ``alone(node, alone)`` how many of a node's shingles no
    other node has, as far as that is known.

    1. Each set is checked with the centre of its bucket, a star.
    2. In a bucket that still holds several components, small ones have all pairs across
       components checked; in larger ones some centres are checked with all members of other
       components and then leave, until one component or a small bucket is left.
    """
    bounded = buckets.join(alone, "node", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    able = materialise(_linkable(bounded.filter(100 * F.col("shared") >= percent * F.col("n")), percent), "able")

    sizes = able.select(F.col("node").alias("centre"), F.col("n").alias("m"), F.col("shared").alias("other")).distinct()
    star = able.filter("centre != node").select("centre", "node", "n", "shared").distinct().join(sizes, "centre")
    star = star.filter(may_link("n", "shared", "m", "other", percent)).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    stars = materialise(compared(star, texts, percent, words), "links")
    checked = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stars.filter("linked").select("a", "b")
    own = F.col("node") == F.col("centre")
    told = stars.select(F.col("a").alias("centre"), F.col("b").alias("node"), "ref_n", "missing")
    told = able.select("key", "node", "n", "shared", "centre").join(told, ["centre", "node"], "left").select(
        "key", "node", F.col("centre").alias("ref"), *against_ref(own)
    )
    return connect(able, told, ["key", "node"], texts, links, checked, percent, words, small, centres)


def against_ref(own: Column) -> list[Column]:
    """What a node lacks of the set it was compared with, and the most that it may share with
    others outside of it; ``own`` tells that the set is its own."""
    ref_n = F.when(own, F.col("n")).otherwise(F.col("ref_n"))
    missing = F.when(own, F.array().cast("array<bigint>")).otherwise(F.col("missing"))
    return [ref_n.alias("ref_n"), missing.alias("missing"), (F.col("shared") - (ref_n - F.size(missing))).alias("extra")]


def connect(able: DataFrame, told: DataFrame, on: list[str], texts: DataFrame, links: DataFrame, checked: DataFrame, percent: int, words: int, small: int, centres: int) -> tuple[DataFrame, DataFrame]:
    """``links`` and those that are still missing between the components of a bucket of
    ``able(key, node, n, shared)``, and the components. ``told`` says by ``on`` what a node lacks of
    a set ``ref``; ``checked(a, b)`` are pairs that need no second look."""
    components = connected_components(links)
    columns = ["key", "node", "n", "shared"]
    left = able.select(columns)
    while True:
        members = left.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        among = members.join(mixed.filter("low < high").select("key", "size"), "key")
        open_ = materialise(among.join(told, on, "left"), "open")
        if open_.isEmpty():
            break
        few, many = open_.filter(F.col("size") <= small), open_.filter(F.col("size") > small)
        # Members of the smallest components first: once they have left, one component may be all.
        alike = many.groupBy("key", "component").agg(F.count(F.lit(1)).alias("alike"))
        turn = W.partitionBy("key").orderBy("alike", F.xxhash64("node", "key"), "node")
        chosen = many.join(alike, ["key", "component"]).withColumn("turn", F.row_number().over(turn))
        chosen = materialise(chosen.filter(F.col("turn") <= centres).drop("turn", "alike"), "centres")
        few = few.withColumn("chosen", F.lit(True))
        marks = chosen.select("key", "node", F.lit(True).alias("chosen"))
        others = many.join(marks, ["key", "node"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
        todo = _pairs(few, few, percent).unionByName(_pairs(chosen, others, percent)).distinct()
        pairs = materialise(todo.join(checked, ["a", "b"], "left_anti"), "pairs")
        more = materialise(_verified(pairs, texts, percent, words), "links")
        if not more.isEmpty():
            links = links.unionByName(more)
            components = connected_components(links)
        checked = checked.unionByName(pairs)
        rest = many.select(columns).join(chosen.select("key", "node"), ["key", "node"], "left_anti")
        left = _linkable(rest, percent).select(columns)
    return links, components


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n_bands: int = BANDS, rows: int = ROWS, words: int = WORDS, small: int = SMALL_BUCKET, centres: int = CENTRES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: n_shingles, component_id, kept.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of ``words``-word
    shingles; component_id is the smallest doc_id reachable, and that document is kept.

    Equal sets are one class, found by digest, and only its smallest doc_id goes on. Classes
    that share a band key meet in a bucket. A set's shingles that no other set has bound what it
    can link to, which takes most sets without a partner out before pairs are made. Every link
    between sets of one bucket is found, yet never all pairs of a large one:

    1. each set is checked with the centre of its bucket, a star;
    2. in a bucket that still holds several components, small ones have all pairs across
       components checked; in larger ones some centres are checked with all members of other
       components and then leave, until one component or a small bucket is left.

    Only a bucket of many sets that are not alike takes many rounds. Texts of null, or without
    words, have an empty set and stand alone; so does a null doc_id, whose component is null and
    which is kept. Rows that repeat a doc_id are one document with several texts. An empty table
    gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(sets_of(docs, n_bands, rows, words), "sets")
    linked = sets.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = linked.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands"))
    keys = classes.select("node", "n", F.explode("bands").alias("key"))
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = materialise(keys.join(met, "key").select("key", "node", "n"), "buckets")
    nodes = buckets.select("node").distinct()
    texts = materialise(docs.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
    alone = materialise(shared_sizes(texts, words), "alone")
    _, components = linked_in_buckets(buckets, texts, alone, percent, words, small, centres)
    named = classes.select("digest", "node").join(components, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    found = sets.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with all its columns; one document of each group stays.

    Rows are grouped by their own texts, whatever their ids. Of a group the row with the smallest
    doc_id stays, one without an id only if none has one; rows that repeat it, in id and text,
    stay with it. Texts without words are in no group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key")).distinct()
    grouped = near_duplicates(docs.select(text_key(F.col("text")).alias("doc_id"), "text"), percent).filter("n_shingles > 0")
    members = rows.join(grouped.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = members.groupBy("component_id").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    doc_id, key = free_name(docs, "dropped_id"), free_name(docs, "dropped_key")
    dropped = members.join(first, "component_id").filter(place != F.col("first")).select(F.col("doc_id").alias(doc_id), F.col("key").alias(key))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc_id)) & (text_key(F.col("text")) == F.col(key))
    return docs.join(dropped, same, "left_anti")
