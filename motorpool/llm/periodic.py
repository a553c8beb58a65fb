"""Periodic runs of words: Lyndon arrays by Baier's grouping, roots extended through LCE."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts

#: A run has at least this many words, and at least two periods.
LEAST = 12

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each position.

    This is the first phase of Baier's suffix sorting. Positions are grouped by a common
    prefix, at first by their code, and groups are taken from the greatest down. Each position
    of a group points to the nearest one before it in a lower group; that one's prefix goes on
    with the group's, once for each pointer, so it moves up into a group of its own kind. When
    a group's turn comes, its prefix is the longest Lyndon word at each of its positions.
    """
    kinds = sorted(set(codes))
    number = {code: g for g, code in enumerate(kinds)}
    group = [number[code] for code in codes]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    size, below = [1] * len(kinds), list(range(-1, len(kinds) - 1))
    above = list(range(1, len(kinds) + 1))
    before, lengths = [-1] * len(codes), [0] * len(codes)
    top = len(kinds) - 1
    while top >= 0:
        width, pointers = size[top], []
        for i in members[top]:
            if group[i] == top:
                # Positions that have had their turn, and those of this group, have a length.
                lengths[i], j = width, i - 1
                while j >= 0 and lengths[j]:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointers.append(j)
        # Pointers come in order of position, so equal ones are neighbours.
        moved: dict[tuple[int, int], list[int]] = {}
        for j, same in groupby(pointers):
            moved.setdefault((group[j], sum(1 for _ in same)), []).append(j)
        last = -1
        for old, times in sorted(moved):
            # Right above the group they come from; more repeats are greater.
            lower = len(members) - 1 if old == last else old
            new, upper, last = len(members), above[lower], old
            for j in moved[old, times]:
                group[j] = new
            members.append(moved[old, times])
            size.append(size[old] + times * width)
            below.append(lower)
            above.append(upper)
            above[lower] = new
            if upper < len(below):
                below[upper] = new
        top = below[top]
    return lengths


class Blocks:
    """Names of the blocks of 1, 2, 4 ... codes at each position; equal names are equal blocks."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names, n = [np.unique(codes, return_inverse=True)[1]], len(codes)
        while 2 << len(self.names) - 1 <= longest:
            half, last = 1 << len(self.names) - 1, self.names[-1]
            pairs = last[: n - 2 * half + 1] * (n + 1) + last[half : n - half + 1]
            self.names.append(np.unique(pairs, return_inverse=True)[1])

    def common(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many codes are alike from ``x < y`` on, or, going back, before them."""
        length = np.zeros(len(x), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, step = self.names[k], 1 << k
            i, j = (x + length, y + length) if forward else (x - length - step, y - length - step)
            inside = np.flatnonzero((i >= 0) & (j < len(names)))
            alike = inside[names[i[inside]] == names[j[inside]]]
            length[alike] += step
        return length


def runs_in(stretches: list[list[int]], least: int = LEAST) -> list[tuple[int, int, int, int]]:
    """``(stretch, start, length, period)`` of every run of at least ``least`` codes, in order.

    Every run holds a Lyndon word under one of the two orders as its root, which is the longest
    Lyndon word where it starts. So each position and order has one candidate root, and what
    continues it to either side gives the run.
    """
    sizes = np.array([len(s) for s in stretches], np.int64)
    if not len(sizes):
        return []
    ends = np.cumsum(sizes + 1)
    codes = np.empty(ends[-1], np.int64)
    codes[ends - 1] = -1 - np.arange(len(ends))  # between stretches there is a code of its own
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False
    codes[inner] = np.fromiter(chain.from_iterable(stretches), np.int64, int(sizes.sum()))
    place = np.flatnonzero(inner)
    found = []
    blocks = Blocks(codes, int(sizes.max()))
    for sign in (1, -1):
        period = np.fromiter(chain.from_iterable(lyndon_array([sign * c for c in s]) for s in stretches), np.int64, len(place))
        stop = np.repeat(ends - 1, sizes)
        fits = place + period < stop
        x, p = place[fits], period[fits]
        goes_on = (codes[x] == codes[x + p]) | ((x > 0) & (codes[x - 1] == codes[x + p - 1]))
        x, p = x[goes_on], p[goes_on]
        left, right = blocks.common(x, x + p, False), blocks.common(x, x + p, True)
        length = left + p + right
        whole = length >= np.maximum(least, 2 * p)
        found.append(np.stack([(x - left)[whole], length[whole], p[whole]], 1))
    unique = np.unique(np.concatenate(found), axis=0)
    stretch = np.searchsorted(ends, unique[:, 0], "right")
    starts = unique[:, 0] - (ends - sizes - 1)[stretch]
    return list(zip(stretch.tolist(), starts.tolist(), unique[:, 1].tolist(), unique[:, 2].tolist()))


def repeated_stretches(codes: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int]]:
    """``(first, end)`` of the stretches covered by windows of ``width`` words that occur again in
    the same document. Windows are compared by hash, so a stretch may be there in vain, but
    none is missing."""
    n = len(codes) - width + 1
    if n <= 0:
        return []
    hashes = doc[:n].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(width):
        hashes = (hashes ^ codes[k : k + n].astype(np.uint64)) * _MIX
        hashes ^= hashes >> np.uint64(32)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    order = whole[np.argsort(hashes[whole], kind="stable")]
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(codes) + 1, np.int64)
    starts = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(order) else order
    np.add.at(again, starts, 1)
    np.add.at(again, starts + width, -1)
    covered = np.cumsum(again)[:-1] > 0
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = (covered[1:] != covered[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.flatnonzero(edge)
    return [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if covered[a]]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(doc_id, runs, collapsed)`` of every row of ``docs(doc_id, text)``.

    ``runs`` are all maximal stretches of words with a smallest period q that have at least
    ``least`` words and two periods, as ``(start, length, period)`` by start, then period; words
    are parted by blanks, tabs and line ends and numbered from 0. ``collapsed`` is the text
    without the words that lie in a run after its first q words, joined by single blanks.

    Any run repeats at least ``least / 2`` words in place, so only stretches covered by windows of
    that many words which occur again in their document are searched; all others cannot hold a
    run. Documents are worked on where they are read, nothing is shuffled, and a stretch takes
    about linear time, whatever its period.

    Null and empty texts have no runs and an empty collapsed text; a null doc_id stays null;
    repeated rows give repeated rows; an empty table gives an empty result; other columns are
    not read.
    """
    width = (least + 1) // 2

    def rows(columns: list[list]) -> Iterable[tuple]:
        words = [(text or "").encode().split() for text in columns[1]]
        known: dict[bytes, int] = {}
        for word in chain.from_iterable(words):
            if word not in known:
                known[word] = len(known)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(sizes) - sizes
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(words)), sizes)
        stretches = [s for s in repeated_stretches(codes, doc, width) if s[1] - s[0] >= least]
        runs: dict[int, list[tuple[int, int, int]]] = {}
        for number, start, length, period in runs_in([codes[a:b].tolist() for a, b in stretches], least):
            at = stretches[number][0]
            d = int(doc[at])
            runs.setdefault(d, []).append((at + start - int(first[d]), length, period))
        for d, (doc_id, tokens) in enumerate(zip(columns[0], words)):
            own = sorted(runs.get(d, ()), key=lambda r: (r[0], r[2]))
            if own:
                keep = np.ones(len(tokens), bool)
                for start, length, period in own:
                    keep[start + period : start + length] = False
                tokens = [tokens[i] for i in np.flatnonzero(keep).tolist()]
            yield doc_id, [dict(zip(("start", "length", "period"), r)) for r in own], b" ".join(tokens).decode()

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, _FOUND)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where a tenth of the texts, by crc32 of the id, goes over to repeating
    some words from a place on: each word ``i >= a`` becomes word ``a + (i - a) % p``."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    g = F.floor(h / 10)
    n = F.when(F.size("words") > 0, F.size("words"))

    def planted(words: Column, a: Column, p: Column) -> Column:
        place = F.sequence(F.lit(0), F.size(words) - 1)
        return F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))

    with_words = docs.select("doc_id", "text", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("words"))
    with_place = with_words.withColumn("a", g % n).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    return with_place.select(
        "doc_id",
        F.when(n > 0, F.array_join(planted(F.col("words"), F.col("a"), F.col("p")), " ")).otherwise(F.col("text")).alias("text"),
    )


def runs_digest(docs: DataFrame) -> DataFrame:
    """The runs of documents with planted ones, as numbers and digests."""
    found = periodic_runs(with_planted_runs(docs))
    listed = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    # Of equally long runs the first one, and then the one of the least period.
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = found.withColumn("best", F.array_max(ranked))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
