"""Byte-level BPE over a corpus: each distinct word is encoded once, whoever uses it."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from motorpool.llm.common import gather, slices

#: Tokens of a chunk, the unit in which documents are taken apart and put together again. A
#: chunk ends with the document that passes this; a longer document is a chunk of its own.
CHUNK_TOKENS = 6_000_000
#: Distinct words are dealt by hash to this many buckets; a bucket's words must fit a worker.
BUCKETS = 256
#: A vocabulary goes to every task; this bounds its file.
MOST_BYTES = 64 << 20
#: Words, or ids, that a worker puts together at once; a longer document alone.
PIECE = 500_000


class Vocabulary:
    """The ranks of a tiktoken file, and the byte string of every id laid end to end. It travels as
    the file; a worker builds each part once, when it first asks for it, and only the parts that
    its step uses: taking apart needs the pattern, encoding the ranks, decoding the bytes."""

    def __init__(self, data: bytes, pattern: str):
        self.data, self.pattern = data, pattern

    def _ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, self.data.splitlines())}

    def splitter(self) -> Vocabulary:
        if "split" not in self.__dict__:
            self.split = regex.compile(self.pattern).findall
        return self

    def encoder(self) -> Vocabulary:
        if "encode" not in self.__dict__:
            self.encode = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self._ranks(), special_tokens={}).encode_ordinary
        return self

    def decoder(self) -> Vocabulary:
        if "bytes" not in self.__dict__:
            by_id = {rank: token for token, rank in self._ranks().items()}
            tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
            self.known = np.array([i in by_id for i in range(len(tokens))])
            self.lengths = np.array([len(t) for t in tokens], np.int64)
            self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
            self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        return self

    def build(self) -> Vocabulary:
        return self.splitter().encoder().decoder()


def shared_vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """A vocabulary for every task. The file is read here, by the driver, and is bounded."""
    with open(path, "rb") as file:
        data = file.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is larger than {MOST_BYTES} bytes")
    return spark.sparkContext.broadcast(Vocabulary(data, pattern))


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative 32-bit numbers, compressed byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


#: Ranks below this are a byte of their own; the others are told by their number of bits.
_FREQUENT = 192


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Ranks by frequency. A rank's byte, the rank itself or the size of what is above it, is
    compressed; the bits within a size are near to random and are laid out as they are."""
    over = np.maximum(ranks.astype(np.int64) - _FREQUENT + 1, 1)
    bits = np.frexp(over.astype(np.float64))[1] - 1
    symbols = zstandard.ZstdCompressor(level=3).compress(np.where(ranks < _FREQUENT, ranks, _FREQUENT + bits).astype(np.uint8).tobytes())
    parts = [len(symbols).to_bytes(4, "little"), symbols]
    rare = ranks >= _FREQUENT
    for n in range(1, 32):
        rest = (over[rare & (bits == n)] - (1 << n)).astype(np.uint32)
        if len(rest):
            parts.append(np.packbits(((rest[:, None] >> np.arange(n, dtype=np.uint32)) & 1).astype(np.uint8)).tobytes())
    return b"".join(parts)


def unpack_ranks(data: bytes) -> np.ndarray:
    at = 4 + int.from_bytes(data[:4], "little")
    ranks = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:at]), np.uint8).astype(np.int64)
    symbols = ranks.copy()
    for n in range(32):
        place = np.flatnonzero(symbols == _FREQUENT + n)
        if len(place):
            size = -(-len(place) * n // 8)
            laid = np.unpackbits(np.frombuffer(data[at : at + size], np.uint8))[: len(place) * n].reshape(len(place), n)
            ranks[place] = (laid.astype(np.int64) << np.arange(n)).sum(1) + (1 << n) - 1 + _FREQUENT
            at += size
    return ranks


def pack_words(words: list[bytes]) -> bytes:
    """Words in order, each as the length of what it shares with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for w in words:
        n = len(commonprefix((last, w)))
        shared.append(n)
        rest.append(w[n:])
        last = w
    sizes = pack(np.array([shared, [len(r) for r in rest]], np.uint32).reshape(-1))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(level=3).compress(b"".join(rest))


def unpack_words(data: bytes) -> list[bytes]:
    cut = 4 + int.from_bytes(data[:4], "little")
    text, sizes = zstandard.ZstdDecompressor().decompress(data[cut:]), unpack(data[4:cut]).tolist()
    half, words, last, at = len(sizes) // 2, [], b"", 0
    for n, more in zip(sizes[:half], sizes[half:]):
        last = last[:n] + text[at : at + more]
        at += more
        words.append(last)
    return words


#: What a chunk's own row holds, next to which there is a row for each bucket of its words.
_CHUNK = [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("codes", pa.binary()), ("places", pa.binary())]
_APART = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("words", pa.binary()), *_CHUNK])
_ENCODED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary()), *_CHUNK])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _chunk(place: tuple[int, int], doc_ids: list, lengths: list[int], codes: array, known: dict[str, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """A chunk as rows: each document's length and the words' positions as local codes, the more
    frequent the smaller; and the distinct words by bucket, ``places`` being their codes in the
    order of the buckets. The chunk is named by what it holds, so that rows of two different
    readings of the input cannot be taken for one."""
    numbers = np.frombuffer(codes, np.int32)
    order = np.argsort(-np.bincount(numbers, minlength=len(known)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    words = [w.encode() for w in known]
    dealt = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), np.int32, len(words))
    in_order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    by_bucket = in_order[np.argsort(dealt[in_order], kind="stable")]
    packed = pack_ranks(rank[numbers])
    chunk = xxhash.xxh3_64_intdigest(repr(place).encode() + packed + b"".join(words)) >> 1
    yield _rows([[chunk % buckets, chunk, None, doc_ids, pack(np.array(lengths, np.uint32)), packed, pack(rank[by_bucket])]], _APART)
    cuts = np.flatnonzero(np.diff(dealt[by_bucket])) + 1
    groups = [g for g in np.split(by_bucket, cuts) if len(g)]
    if groups:
        yield _rows([[int(dealt[g[0]]), chunk, pack_words([words[i] for i in g]), None, None, None, None] for g in groups], _APART)


def _take_apart(vocabulary: Broadcast, chunk_tokens: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, task, number = vocabulary.value.splitter().split, TaskContext.get().partitionId(), 0
        doc_ids, lengths, codes, known = [], [], array("i"), {}
        for columns in slices(batches):
            for doc_id, text in zip(*columns):
                words = split(text or "")
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                codes.extend(map(known.__getitem__, words))
                doc_ids.append(doc_id)
                lengths.append(len(words))
                if len(codes) + len(doc_ids) >= chunk_tokens:
                    yield from _chunk((task, number), doc_ids, lengths, codes, known, buckets)
                    number += 1
                    doc_ids, lengths, codes, known = [], [], array("i"), {}
        if doc_ids:
            yield from _chunk((task, number), doc_ids, lengths, codes, known, buckets)

    return run


def _encode_buckets(vocabulary: Broadcast):
    """Rows come by bucket, so that a word of many chunks is encoded when it is first seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, known = vocabulary.value.encoder().encode, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, chunk, packed, *own = (c[i].as_py() for c in batch.columns)
                if packed is None:
                    yield _rows([[bucket, chunk, None, None, *own]], _ENCODED)
                    continue
                if bucket != last:
                    last, known = bucket, {}
                found = []
                for w in unpack_words(packed):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = array("i", encode(w.decode()))
                    found.append(ids)
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.frombuffer(b"".join(ids.tobytes() for ids in found), np.int32)
                yield _rows([[bucket, chunk, pack(counts), pack(flat), *own]], _ENCODED)

    return run


def _put_together(rows: pa.Table) -> pa.Table:
    """The documents of one chunk from its own row and the ids of its words."""
    found = rows.select(["bucket", "counts", "ids", *(name for name, _ in _CHUNK)]).to_pylist()
    own = [r for r in found if r["counts"] is None]
    parts = sorted(((r["bucket"], r["counts"], r["ids"]) for r in found if r["counts"] is not None), key=lambda p: p[0])
    counts = np.concatenate([unpack(p[1]) for p in parts] or [np.empty(0, np.uint32)]).astype(np.int64)
    if len(own) != 1 or len(places := unpack(own[0]["places"])) != len(counts):
        raise ValueError("a chunk's rows come from different readings of the input; write the input to a table first")
    flat = np.concatenate([unpack(p[2]) for p in parts] or [np.empty(0, np.uint32)]).astype(np.int32)
    by_code, starts = np.empty_like(counts), np.empty_like(counts)
    by_code[places], starts[places] = counts, np.cumsum(counts) - counts
    codes, doc_ids = unpack_ranks(own[0]["codes"]), own[0]["doc_ids"]
    ends = np.concatenate([[0], np.cumsum(unpack(own[0]["lengths"]).astype(np.int64))])
    pieces, first = [], 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        part = codes[ends[first] : ends[last]]
        per_word = by_code[part]
        at = np.concatenate([[0], np.cumsum(per_word)])[ends[first : last + 1] - ends[first]]
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(gather(flat, starts[part], per_word), pa.int32()))
        pieces.append(pa.RecordBatch.from_arrays([pa.array(doc_ids[first:last], pa.int64()), lists], schema=_IDS))
        first = last
    return pa.Table.from_batches(pieces, schema=_IDS)


def encode(docs: DataFrame, path: str, pattern: str, chunk_tokens: int = CHUNK_TOKENS, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, ids)`` of every row of ``docs(doc_id, text)``, as tiktoken encodes each match of
    ``pattern`` by the ranks in ``path``, without special tokens.

    1. Texts are taken apart into words and their positions, in chunks of documents. Within a
       chunk a word appears once.
    2. Distinct words are dealt by hash, so that all chunks' copies of a word meet, and each word
       is encoded once. However frequent a word, a chunk brings it once. The positions go along
       as a row of their own chunk.
    3. Ids go back to their chunks, and documents are put together by position.

    A chunk is made of rows as they are read. If a part of the input is read again, after an
    executor was lost, and its rows come in another order, as a shuffle may give them, the
    mismatch is an error and never a wrong result; tables in files are read alike each time.

    Null and empty texts have no ids; a null doc_id stays null; repeated rows give repeated
    rows; an empty table gives an empty result; other columns are not read.
    """
    shared = shared_vocabulary(docs.sparkSession, path, pattern)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    apart = chosen.mapInArrow(_take_apart(shared, chunk_tokens, buckets), from_arrow_schema(_APART))
    dealt = apart.repartition("bucket").sortWithinPartitions("bucket")
    encoded = dealt.mapInArrow(_encode_buckets(shared), from_arrow_schema(_ENCODED))
    return encoded.groupBy("chunk").applyInArrow(_put_together, from_arrow_schema(_IDS))


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids in place of ``ids``; other columns pass through.

    Every id is joined to its row of the token-byte table, which is as large as the vocabulary
    and so goes to every task; the bytes are laid out in the ids' order. Null ids give no
    bytes; an id without a token is an error, and so is a ``name`` that another column has.
    """
    if name.lower() in {c.lower() for c in encoded.columns if c != ids}:
        raise ValueError(f"{name} is a column already")
    shared = shared_vocabulary(encoded.sparkSession, path, pattern)
    others = [c for c in encoded.columns if c != ids]
    ordered = encoded.select(*others, ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value.decoder()
        for batch in batches:
            lists = batch.column(len(others))
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + PIECE, "right")))
                part = batch.slice(first, last - first)
                column = part.column(len(others))
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and not (flat.min() >= 0 and flat.max() < len(v.known) and v.known[flat].all()):
                    raise ValueError("an id has no token in the vocabulary")
                lengths = v.lengths[flat]
                data = gather(v.bytes, v.starts[flat], lengths).tobytes()
                at = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends[first:last] - done])].tolist()
                decoded = pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], decoded], names=[*others, name])
                first = last

    schema = ordered.drop(ids).schema.add(name, "binary")
    return ordered.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    encoded = encode(docs, path, pattern)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    digested = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), "ids")
    return decode(digested, path, pattern).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
