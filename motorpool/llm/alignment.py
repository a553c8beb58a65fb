"""Alignment of two tokenizers: fragments of byte ranges that compose, and links counted corpus-wide."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from motorpool.llm.common import gather, slices
from motorpool.session import materialise

#: Texts of more bytes are cut into ranges of about this size, which are dealt to tasks.
RANGE_BYTES = 64 << 10
#: So many neighbouring fragments are composed by a task in one round.
FAN_IN = 8
#: Links of a chunk of documents, the unit in which pairs are counted; a longer document alone.
CHUNK_LINKS = 1_000_000
#: Vocabularies go to every task; this bounds each file.
MOST_BYTES = 64 << 20


@dataclass
class Tokens:
    """Ids of both tokenizers in order, and the byte offsets where they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("a", "a_ends", "b", "b_ends")))

    def split(self, start: int, end: int) -> tuple[Tokens, Tokens, Tokens]:
        """The tokens that end up to ``start``, up to ``end``, and behind it."""
        i, j = np.searchsorted(self.a_ends, [start, end], "right")
        k, m = np.searchsorted(self.b_ends, [start, end], "right")
        cuts = ((0, i, 0, k), (i, j, k, m), (j, None, m, None))
        return tuple(Tokens(self.a[p:q], self.a_ends[p:q], self.b[r:s], self.b_ends[r:s]) for p, q, r, s in cuts)


NOTHING = Tokens(*(np.empty(0, np.int32), np.empty(0, np.int64)) * 2)


@dataclass
class Fragment:
    """What a byte range knows of its document's groups.

    ``prefix`` holds the tokens up to the first place where tokens of both end, whose group may
    have begun before the range; ``closed`` the groups between the first such place and the
    last one; ``suffix`` the tokens behind it. A range without such a place is all prefix.
    ``whole`` is false when the bytes of the tokens are not those of the text.
    """

    prefix: Tokens
    closed: Tokens
    suffix: Tokens
    closes: bool
    whole: bool = True

    @staticmethod
    def of(tokens: Tokens, whole: bool = True) -> Fragment:
        both = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
        if not len(both):
            return Fragment(tokens, NOTHING, NOTHING, False, whole)
        prefix, closed, suffix = tokens.split(both[0], both[-1])
        return Fragment(prefix, closed, suffix, True, whole)

    def __add__(self, other: Fragment) -> Fragment:
        """The fragment of both ranges; associative, and neutral where a range has no tokens.

        What is open between them may close at places that neither range could see, as the two
        tokenizers need not be cut at the same byte.
        """
        whole = self.whole and other.whole
        if not self.closes:
            middle = Fragment.of(self.prefix + other.prefix)
            if not other.closes:
                return Fragment(middle.prefix, middle.closed, middle.suffix, middle.closes, whole)
            # The first place of the other range ends the middle at the latest.
            return Fragment(middle.prefix, middle.closed + other.closed, other.suffix, True, whole)
        middle = Fragment.of(self.suffix + other.prefix)
        if not middle.closes:
            return Fragment(self.prefix, self.closed, middle.prefix, True, whole)
        closed = self.closed + middle.prefix + middle.closed
        if not other.closes:
            return Fragment(self.prefix, closed, middle.suffix, True, whole)
        return Fragment(self.prefix, closed + other.closed, other.suffix, True, whole)


EMPTY = Fragment(NOTHING, NOTHING, NOTHING, False)


def compose(fragments: Iterable[Fragment]) -> Fragment:
    """Fragments in order, as a balanced tree, so that no token is copied more often than that is high."""
    level = list(fragments) or [EMPTY]
    while len(level) > 1:
        level = [level[i] + level[i + 1] if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class Tokenizers:
    """A byte-level BPE from a JSON file (A) and a piece model (B)."""

    def __init__(self, json_data: bytes, model: bytes, pattern: str):
        file = json.loads(json_data)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        byte_of = {c: b for b, c in byte_letters().items()}
        special = {t["id"] for t in file["added_tokens"]}
        tokens = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if i not in special}
        # Ids must follow the order of the merges, then ranks alone tell which merge comes first.
        made = [vocabulary[left + right] for left, right in merges]
        if made != sorted(made):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        self.encode_a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=tokens, special_tokens={}).encode_ordinary
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        single = [self.pieces.is_byte(i) for i in range(len(names))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if one else p.replace("▁", " ").encode() for p, one in zip(names, single)]
        self.bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes_a[i] = token
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # If a blank stands only at the head of pieces, no piece goes on over the start of blanks.
        self.cuts = not any("▁" in p.lstrip("▁") for p, one in zip(names, single) if not one)

    def tokens(self, a: list[int], b: list[int], a_data: bytes, b_data: bytes, a_start: int = 0, b_start: int = 0) -> tuple[Tokens, bool]:
        """Tokens with their ends, and whether their bytes are those they were made from."""
        whole = b"".join(map(self.bytes_a.__getitem__, a)) == a_data and b"".join(map(self.bytes_b.__getitem__, b)) == b_data
        a_ids, b_ids = np.array(a, np.int32), np.array(b, np.int32)
        return Tokens(a_ids, a_start + np.cumsum(self.size_a[a_ids]), b_ids, b_start + np.cumsum(self.size_b[b_ids])), whole

    def spells(self, a: list[int], b: list[int], data: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == data == b"".join([self.bytes_b[i] for i in b])

    def align_each(self, texts: list[str]) -> Iterator[tuple[Fragment, tuple[int, str] | None]]:
        """The complete fragment of each text, and its groups as text. Where no token of either goes
        on over a blank, words are fragments of their own, and each distinct one is done once."""
        known: dict[str, int] = {}
        codes = [[known.setdefault(w, len(known)) for w in (_WORD.split(" " + text) if self.cuts else [" " + text])] if text else [] for text in texts]
        words = list(known)
        a_ids, b_ids = [self.encode_a(w) for w in words], self.pieces.encode([w[1:] for w in words], num_threads=1)
        whole = [self.spells(a, b, w.encode()) for a, b, w in zip(a_ids, b_ids, words)]
        a_ids, b_ids = ([ids if right else [] for ids, right in zip(side, whole)] for side in (a_ids, b_ids))
        flat = [np.fromiter(chain.from_iterable(side), np.int32) for side in (a_ids, b_ids)]
        lengths = [np.fromiter(map(len, side), np.int64, len(side)) for side in (a_ids, b_ids)]
        starts = [np.cumsum(n) - n for n in lengths]
        a_ends, b_ends = np.cumsum(self.size_a[flat[0]]), np.cumsum(self.size_b[flat[1]])
        counts, told = groups_of_words(Tokens(flat[0], a_ends, flat[1], b_ends), np.concatenate([[0], a_ends])[np.cumsum(lengths[0])])
        for own in codes:
            if not own or not all([whole[c] for c in own]):
                yield EMPTY, None
                continue
            at = np.array(own, np.int64)
            a, b = (gather(f, s[at], n[at]) for f, s, n in zip(flat, starts, lengths))
            tokens = Tokens(a, np.cumsum(self.size_a[a]), b, np.cumsum(self.size_b[b]))
            yield Fragment(tokens, NOTHING, NOTHING, True), (int(counts[at].sum()), ";".join([told[c] for c in own]))


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself where it is printed
    in Latin-1, and otherwise the next letter from U+0100 on."""
    printed = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}


def shared_tokenizers(spark: SparkSession, json_path: str, model_path: str, pattern: str) -> Broadcast:
    """Both vocabularies for every task. The files are read here, by the driver, and are bounded;
    they travel as they are, and a worker builds the rest once, by :func:`built`."""
    files = []
    for path in (json_path, model_path):
        with open(path, "rb") as file:
            files.append(file.read(MOST_BYTES + 1))
        if len(files[-1]) > MOST_BYTES:
            raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast({"files": (*files, pattern)})


def built(shared: Broadcast) -> Tokenizers:
    known = shared.value
    if "tokenizers" not in known:
        known["tokenizers"] = Tokenizers(*known["files"])
    return known["tokenizers"]


#: A merge of neither tokenizer goes over a blank behind anything but white space; that of A
#: needs a word right behind the blank, as it sees several blanks as a token of their own, and that
#: of B something, as it puts no blank before an empty text.
_CUT_A, _CUT_B = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?s)(?<=[^ ]) (?=.)")
_WORD = re.compile(r"(?<=\S)(?= \S)")


def ranges(text: str, size: int, cuts: bool) -> list[tuple[int, int, str, str]]:
    """``(a_start, b_start, a_text, b_text)`` of a text's byte ranges, for each tokenizer cut at its
    next place at or behind each multiple of ``size``; blank before the text counted as byte 0.
    A text that offers no place is one range."""
    data, starts = " " + text, []
    step = max(1, size)
    for cut in (_CUT_A, _CUT_B):
        found, at = [0], 0
        for nominal in range(step, len(data), step) if cuts else ():
            place = cut.search(data, max(nominal, at + 1))
            at = place.start() if place else len(data)
            found.append(at)
        starts.append([*found, len(data)])
    out, a_byte, b_byte = [], 0, 0
    for (a, a_next), (b, b_next) in zip(zip(starts[0], starts[0][1:]), zip(starts[1], starts[1][1:])):
        out.append((a_byte, b_byte, data[a:a_next], data[b:b_next]))
        a_byte, b_byte = a_byte + len(data[a:a_next].encode()), b_byte + len(data[b:b_next].encode())
    return out


_CUT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("a_start", pa.int64()), ("b_start", pa.int64()), ("a_text", pa.string()), ("b_text", pa.string())])
_TOKENS = pa.struct([("a", pa.list_(pa.int32())), ("a_ends", pa.list_(pa.int64())), ("b", pa.list_(pa.int32())), ("b_ends", pa.list_(pa.int64()))])
_FRAGMENT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("prefix", _TOKENS), ("closed", _TOKENS), ("suffix", _TOKENS), ("closes", pa.bool_()), ("whole", pa.bool_())])
_PARTS = ("a", "a_ends", "b", "b_ends")


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _fragment_rows(row: int, doc_id: int | None, k: int, n: int, f: Fragment) -> pa.RecordBatch:
    tokens = [{p: getattr(t, p) for p in _PARTS} for t in (f.prefix, f.closed, f.suffix)]
    return _batch([[row, doc_id, k, n, *tokens, f.closes, f.whole]], _FRAGMENT)


def _read_fragment(columns: list[pa.Array], i: int) -> Fragment:
    def read(column: pa.Array) -> Tokens:
        value = column[i]
        return Tokens(*(value[p].values.to_numpy(zero_copy_only=False) for p in _PARTS))

    return Fragment(*map(read, columns[:3]), columns[3][i].as_py(), columns[4][i].as_py())


def links(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pairs of tokens whose byte ranges overlap. Between two neighbouring ends of any
    tokens there is one token of each, and each overlapping pair has exactly one such place."""
    ends = np.union1d(tokens.a_ends, tokens.b_ends)
    return tokens.a[np.searchsorted(tokens.a_ends, ends)], tokens.b[np.searchsorted(tokens.b_ends, ends)]


def groups_of_words(tokens: Tokens, word_ends: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """The number of groups of each word, and ``a1,a2|b1;a3|b2`` over them. Words end at the given
    bytes, where tokens of both end; those without tokens end where the word before does."""
    both = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    upto = np.searchsorted(both, word_ends, "right")
    counts = np.diff(upto, prepend=0)
    group = np.concatenate([np.searchsorted(both, tokens.a_ends) * 2, np.searchsorted(both, tokens.b_ends) * 2 + 1])
    order = np.argsort(group, kind="stable")
    side = group[order]
    last = np.append(side[1:] != side[:-1], True) if len(side) else np.empty(0, bool)
    behind = np.where(last, np.where(side % 2, 2, 1), 0)
    closing = np.zeros(len(both) + 1, bool)
    closing[upto[counts > 0] - 1] = True
    behind[last & (side % 2 == 1) & closing[side // 2]] = 3
    letters = np.array([",", "|", ";", "\n"])[behind].tolist()
    ids = np.concatenate([tokens.a, tokens.b])[order].tolist()
    found = iter("".join(chain.from_iterable(zip(map(str, ids), letters))).split("\n"))
    return counts, [next(found) if n else "" for n in counts.tolist()]


def groups_text(tokens: Tokens) -> tuple[int, str]:
    """The number of groups of a text, and the groups."""
    counts, told = groups_of_words(tokens, tokens.a_ends[-1:])
    return int(counts[0]), told[0]


_DOC = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
_CHUNK = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(_DOC)), ("codes", pa.binary()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))])


class Chunks:
    """Gathers aligned documents until they have so many links, and lays them out: the documents,
    their links as codes of the chunk's distinct pairs, and how often each pair occurs."""

    def __init__(self, kind: int, most: int):
        self.next, self.most = (kind << 62) | (TaskContext.get().partitionId() << 32), most
        self.docs, self.links, self.size = [], [], 0

    def add(self, doc_id: int | None, fragment: Fragment, told: tuple[int, str] | None = None) -> Iterator[pa.RecordBatch]:
        tokens = fragment.prefix + fragment.closed + fragment.suffix if len(fragment.closed.a) else fragment.prefix
        n_a, n_b = len(tokens.a), len(tokens.b)
        if fragment.whole and n_a and n_b:
            n, text = told or groups_text(tokens)
            a, b = links(tokens)
            self.docs.append((doc_id, n_a, n_b, n, len(a), hashlib.sha256(text.encode()).hexdigest()))
            self.links.append((a.astype(np.int64) << 32) | b)
            self.size += len(a)
        else:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
        if self.size + len(self.docs) >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        pairs, codes, counts = np.unique(np.concatenate([np.empty(0, np.int64), *self.links]), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        planes = np.ascontiguousarray(rank[codes].view(np.uint8).reshape(-1, 4).T).tobytes()
        pairs, names = pairs[order], [f.name for f in _DOC]
        row = [
            self.next, [dict(zip(names, d)) for d in self.docs], zstandard.ZstdCompressor(level=3).compress(planes),
            (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), counts[order],
        ]
        self.next, self.docs, self.links, self.size = self.next + 1, [], [], 0
        return _batch([row], _CHUNK)


def _align_short(shared: Broadcast, most: int) -> Callable:
    """Documents of one range: their fragment is complete, and goes into a chunk at once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, chunks = built(shared), Chunks(0, most)
        for doc_ids, texts in slices(batches):
            for doc_id, (fragment, told) in zip(doc_ids, t.align_each([text or "" for text in texts])):
                yield from chunks.add(doc_id, fragment, told)
        if chunks.docs:
            yield chunks.flush()

    return run


def _cut_long(shared: Broadcast, size: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = built(shared).cuts
        for rows, doc_ids, texts in slices(batches, text=2):
            for row, doc_id, text in zip(rows, doc_ids, texts):
                found = ranges(text, size, cuts)
                for k, (a_start, b_start, a_text, b_text) in enumerate(found):
                    yield _batch([[row, doc_id, k, len(found), a_start, b_start, a_text, b_text]], _CUT)

    return run


def _align_ranges(shared: Broadcast) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = built(shared)
        for columns in slices(batches, text=6):
            for row, doc_id, k, n, a_start, b_start, a_text, b_text in zip(*columns):
                # A range of B begins with the blank that the model puts before its text.
                b = t.pieces.encode(b_text[1:], num_threads=1) if b_text else []
                tokens, whole = t.tokens(t.encode_a(a_text), b, a_text.encode(), b_text.encode(), a_start, b_start)
                yield _fragment_rows(row, doc_id, k, n, Fragment.of(tokens, whole))

    return run


def _compose_neighbours(fan_in: int) -> Callable:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("k").combine_chunks()
        columns = [rows.column(name).chunk(0) for name in ("prefix", "closed", "suffix", "closes", "whole")]
        row, doc_id, k, n = (rows.column(name)[0].as_py() for name in ("row", "doc_id", "k", "n"))
        composed = compose(_read_fragment(columns, i) for i in range(rows.num_rows))
        return pa.Table.from_batches([_fragment_rows(row, doc_id, k // fan_in, -(-n // fan_in), composed)])

    return run


def _chunk_long(most: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks(1, most)
        for batch in batches:
            for i in range(batch.num_rows):
                fragment = _read_fragment([batch.column(name) for name in ("prefix", "closed", "suffix", "closes", "whole")], i)
                yield from chunks.add(batch.column("doc_id")[i].as_py(), fragment)
        if chunks.docs:
            yield chunks.flush()

    return run


_ALIGNED = pa.schema([*_DOC, ("n_best", pa.int64()), ("count_sum", pa.int64())])


def _put_together(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one chunk, with what the corpus-wide counts of their links come to."""
    own = docs.column("docs")[0].as_py()
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(docs.column("codes")[0].as_py()), np.uint8)
    codes = np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(-1)
    totals, best = np.zeros((2, pairs.num_rows), np.int64)
    at = pairs.column("code").to_numpy()
    totals[at], best[at] = pairs.column("total").to_numpy(), pairs.column("best").to_numpy()
    ends = np.cumsum([0, *(d["n_links"] for d in own)])
    sums = [np.concatenate([[0], np.cumsum(x[codes])])[ends] for x in (best, totals)]
    columns = [pa.array([d[f.name] for d in own], f.type) for f in _DOC] + [pa.array(np.diff(s), pa.int64()) for s in sums]
    return pa.Table.from_arrays(columns, schema=_ALIGNED)


def align(docs: DataFrame, json_path: str, model_path: str, pattern: str, range_bytes: int = RANGE_BYTES, fan_in: int = FAN_IN, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256.

    A is the byte-level BPE in ``json_path`` over a blank and the text, B the piece model in
    ``model_path`` over the text, before which it puts a blank. Byte offsets where tokens of both
    end cut them into groups; a link is a pair of tokens whose bytes overlap.

    1. Texts of one range are aligned where they are read. Longer ones are cut into byte ranges,
       which are dealt to tasks, tokenized and made fragments: an open prefix, closed groups, an
       open suffix. Fragments compose, so neighbours are put together in rounds, ``fan_in`` at
       a time by tasks of their own, until each document is one.
    2. Documents gather in chunks, where a pair of ids is counted once. Spark adds the counts
       of the chunks up by pair, finds the highest of each B id, and joins them back by pair, so
       that a frequent pair takes one row a chunk.
    3. A chunk's documents add up the counts of their links.

    Null and empty texts, and texts that the tokens of either do not spell, have no tokens: zeros
    and an empty digest. A null doc_id stays null; repeated rows give repeated rows and all count;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    shared = shared_tokenizers(spark, json_path, model_path, pattern)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_text = F.coalesce(F.octet_length("text") > range_bytes, F.lit(False))
    short = chosen.filter(~long_text).mapInArrow(_align_short(shared, chunk_links), from_arrow_schema(_CHUNK))
    # Written, so that a row's number and its ranges cannot change.
    numbered = chosen.filter(long_text).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    cut = materialise(numbered.mapInArrow(_cut_long(shared, range_bytes), from_arrow_schema(_CUT)), "ranges")
    # Each step is written, so that no task feeds one Python worker from another and holds both.
    fragments = materialise(cut.repartition("row", "k").mapInArrow(_align_ranges(shared), from_arrow_schema(_FRAGMENT)), "fragments")
    most = cut.agg(F.max("n")).first()[0] or 1
    while most > 1:
        near = fragments.groupBy("row", F.floor(F.col("k") / fan_in).alias("to"))
        composed = near.applyInArrow(_compose_neighbours(fan_in), from_arrow_schema(_FRAGMENT))
        fragments, most = materialise(composed, "fragments"), -(-most // fan_in)
    long = fragments.mapInArrow(_chunk_long(chunk_links), from_arrow_schema(_CHUNK))
    chunks = materialise(short.unionByName(long), "chunks")

    pairs = chunks.select(F.col("chunk").alias("of"), F.posexplode(F.arrays_zip("a", "b", "count"))).select("of", F.col("pos").alias("code"), "col.*")
    totals = pairs.groupBy("a", "b").agg(F.sum("count").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    scored = totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).cast("long").alias("best"))
    counted = pairs.join(scored, ["a", "b"]).select("of", "code", "total", "best")
    grouped = chunks.select("chunk", "docs", "codes").groupBy("chunk").cogroup(counted.groupBy("of"))
    aligned = grouped.applyInArrow(_put_together, from_arrow_schema(_ALIGNED))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
