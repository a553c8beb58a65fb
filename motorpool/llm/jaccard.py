"""N-gram Jaccard join by grouped prefixes: groups of equal prefix and size, expanded and verified."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts, maybe_among
from motorpool.llm.near import Shingler, against_ref, compared, connect, connected_components, may_link
from motorpool.session import materialise

WORDS, PERCENT = 4, 85
#: Under a shingle with up to this many members all pairs across components are looked at in one
#: round; of more, so many members a round. Bounds leave few to verify, so rounds are the cost.
SMALL_BUCKET, CENTRES = 2048, 1024

#: Shingles whose hash is among the least of this share judge which sets can have a link at all.
SHARE = 0.25

_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
_SAMPLE = pa.schema([("node", pa.int64()), ("sample", pa.list_(pa.int64()))])
_HELD = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("text", pa.string())])
_SHINGLES = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _number(shingles: np.ndarray) -> int | None:
    """What a set is called: a 64-bit hash of its shingles, so that equal sets are one node."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63) if len(shingles) else None


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """Size and number of each document's set."""
    shingler = Shingler(words)

    def rows(columns: list[list]) -> Iterable[tuple]:
        for doc_id, text in zip(*columns):
            s = shingler.set(text)
            yield doc_id, len(s), _number(s) if doc_id is not None else None

    return map_texts(docs, rows, _SETS)


def _able(docs: DataFrame, sets: DataFrame, percent: int, words: int, share: float) -> DataFrame:
    """``(node, doc_id)`` of the sets that can have a link, with the least id that holds each.

    A set's link shares all but ``100 - percent`` in a hundred of its shingles. Shingles are
    sampled by their hash, alike in every set, so as many of a sample at most may be alone.
    """
    shingler, end = Shingler(words), np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))

    def rows(columns: list[list]) -> Iterable[tuple]:
        for _, text in zip(*columns):
            s = shingler.set(text)
            yield _number(s), s[: np.searchsorted(s, end)].view(np.int64)

    held = map_texts(docs.filter("doc_id IS NOT NULL"), rows, _SAMPLE).select("node", F.explode("sample").alias("shingle"))
    # Alone means in no other set; copies of one set are one.
    once = held.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other")
    alone = once.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    classes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    few = 100 * F.coalesce("alone", F.lit(0)) <= (100 - percent) * F.col("n")
    return classes.join(alone, "node", "left").filter(few).select("node", "doc_id")


def _texts(docs: DataFrame, able: DataFrame, words: int) -> DataFrame:
    """``(node, text)``: one text of each set that can have a link."""
    shingler = Shingler(words)

    def rows(columns: list[list]) -> Iterable[tuple]:
        for doc_id, text in zip(*columns):
            yield doc_id, _number(shingler.set(text)), text

    # An id may stand for several texts, of which only those of the sought set count.
    ids = able.select("doc_id").distinct()
    found = map_texts(maybe_among(docs, "doc_id", ids).join(ids, "doc_id", "left_semi"), rows, _HELD)
    return found.join(able, ["doc_id", "node"], "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _groups(texts: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """``(node, n, alone, group, prefix)`` of sets with a prefix that others can share.

    Shingles are ordered by the number of sets that hold them, then by hash; of two linked sets
    each has the other's company in its first ``n - ceil(percent * n / 100) + 1``. Those that no
    other set holds come first and match nothing, so what is left of that is the prefix. Sets
    of one prefix and size are a group.
    """
    shingler = Shingler(words)

    def rows(columns: list[list]) -> Iterable[tuple]:
        for node, text in zip(*columns):
            s = shingler.set(text)
            yield node, len(s), s.view(np.int64)

    sets = materialise(map_texts(texts, rows, _SHINGLES), "shingles")
    counts = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("often"), F.min("node").alias("node"))
    alone = counts.filter("often = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    few = 100 * F.col("alone") <= (100 - percent) * F.col("n")
    able = sets.join(alone, "node", "left").withColumn("alone", F.coalesce("alone", F.lit(0))).filter(few)
    able = materialise(able, "few-alone")
    often = counts.filter("often > 1").select("shingle", "often")
    in_order = F.sort_array(F.collect_list(F.struct("often", "shingle")))
    ordered = able.select("node", F.explode("shingles").alias("shingle")).join(often, "shingle").groupBy("node").agg(in_order.alias("ordered"))
    with_alone = able.select("node", "n", "alone").join(ordered, "node")
    # n - ceil(percent * n / 100) = floor((100 - percent) * n / 100)
    room = F.floor((100 - percent) * F.col("n") / 100) + 1 - F.col("alone")
    prefixed = with_alone.filter(room > 0).withColumn("prefix", F.slice("ordered.shingle", F.lit(1), room.cast("int")))
    prefixed = materialise(prefixed.select("node", "n", "alone", "prefix"), "prefixes")
    groups = prefixed.groupBy("n", "prefix").agg(F.min("node").alias("group"), F.count(F.lit(1)).alias("members"))
    return prefixed, groups


def _postings(groups: DataFrame) -> DataFrame:
    """``(key, group)``: which groups meet under a shingle of their prefixes.

    Shingles under which the same groups meet give the same pairs, so one of them stands for
    all. Only shingles of two members or more count.
    """
    postings = groups.select(F.explode("prefix").alias("key"), "group", "members")
    met = postings.groupBy("key").agg(
        F.sum("members").alias("all"), F.count(F.lit(1)).alias("several"), F.min("group").alias("low"),
        F.bit_xor(F.xxhash64("group")).alias("x"), F.bit_xor(F.xxhash64("group", F.lit(1))).alias("y"),
    )
    kept = met.filter(F.col("all") > 1).groupBy("several", "low", "x", "y").agg(F.min("key").alias("key"))
    return postings.join(kept.select("key"), "key", "left_semi").select("key", "group")


def _with_hubs(members: DataFrame, texts: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """``(hub, node, n, shared)``, the hub being the set with the fewest shingles of its own where most
    sets meet with the node, and the comparisons of the nodes with their hubs."""
    own = F.struct(F.col("n") - F.col("shared"), "node")
    met = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min_by("node", own).alias("hub"))
    most = members.select("key", "node", "n", "shared").join(met, "key").groupBy("node", "n", "shared")
    hubs = materialise(most.agg(F.max_by("hub", F.struct("size", "key")).alias("hub")), "hubs")
    sizes = hubs.select(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("shared").alias("other"))
    star = hubs.filter("hub != node").join(sizes, "hub").filter(may_link("n", "shared", "m", "other", percent))
    return hubs, materialise(compared(star.select(F.col("hub").alias("a"), F.col("node").alias("b")), texts, percent, words), "star")


def jaccard_join(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, share: float = SHARE, small: int = SMALL_BUCKET, centres: int = CENTRES) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` on their sets of ``words``-word
    shingles; component_id is the smallest doc_id that links reach. The join is exact up to
    64-bit hashes of shingles and sets.

    1. Equal sets are one node. A node with too many shingles that no other has cannot have a
       link and goes, judged by a share of the shingles.
    2. The rest is ordered by how many hold a shingle. Nodes whose prefixes and sizes are equal
       collapse into groups, and an index from the prefixes' shingles to groups tells which
       groups meet; a hot shingle has one row for each group, not for each document.
    3. Groups that meet are expanded to their members. Each member is verified with one hub on full
       sets; what it lacks of the hub bounds what it can share with others of that hub. Pairs
       that this, sizes and shared shingles allow are then verified across components only, so
       that many near-copies do not make all their pairs.

    Null texts, or those without words, have an empty set and stand alone, as does a null
    doc_id, whose component is null. Rows that repeat a doc_id are one document with several
    texts, linked by each of them. An empty table gives an empty result; other columns are not
    read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = materialise(_sets(docs, words), "sets")
    able = materialise(_able(docs, sets, percent, words, share), "able")
    texts = materialise(_texts(docs, able, words), "texts")
    prefixed, groups = _groups(texts, percent, words)
    groups = materialise(groups, "groups")
    members = prefixed.join(groups, ["n", "prefix"]).select("group", "node", "n", (F.col("n") - F.col("alone")).alias("shared"))
    members = materialise(_postings(groups).join(members, "group").select("key", "node", "n", "shared"), "members")
    hubs, star = _with_hubs(members, texts, percent, words)
    told = hubs.join(star.select(F.col("b").alias("node"), "ref_n", "missing"), "node", "left")
    told = told.select("node", F.col("hub").alias("ref"), *against_ref(F.col("hub") == F.col("node")))
    links = star.filter("linked").select("a", "b")
    checked = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links, components = connect(members, told, ["node"], texts, links, checked, percent, words, small, centres)
    by_id = sets.filter("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("other")).filter("a < other")
    same_id = sets.select("doc_id", F.col("node").alias("b")).join(by_id, "doc_id").filter("a < b").select("a", "b")
    if not same_id.isEmpty():
        components = connected_components(links.unionByName(same_id))
    named = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(components, "node", "left")
    named = named.select("node", F.coalesce("component", "node").alias("component"), "doc_id")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = sets.select("doc_id", "n_shingles", "node").join(named.join(least, "component").select("node", "component_id"), "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
