"""The Jaccard join, periodic runs and the alignment of tokenizers against brute force."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motorpool.llm import alignment, jaccard, periodic
from motorpool.llm.queries import BYTE_BPE, ORACLES, PIECES, QUERIES
from public_tokenizers import PATTERN
from tests.conftest import SMALL
from tests.llm.conftest import canonical
from tests.llm.test_dedup import shingles, variants

# Jaccard join


def brute_join(rows, percent=85, k=4):
    """Links of rows, components over documents, which may have several rows."""
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (x, (i, _)), (y, (j, _)) in itertools.combinations(enumerate(rows), 2):
        if i is None or j is None or not sets[x] or not sets[y]:
            continue
        if 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted(((i, len(s), find(i)) for (i, _), s in zip(rows, sets)), key=str)


def joined(df, **options):
    return sorted(map(tuple, jaccard.jaccard_join(df, **options).collect()), key=str)


def test_join_against_brute_force(make_docs):
    texts = [t for seed in range(12) for t in variants(seed, 40 + 20 * seed, 9, 4)]
    texts += [None, "", " \t\n", "one two", "ONE  two", "one two three four", "One two three  four", "a b c d e f " * 4000]
    rnd = random.Random(5)
    rows = list(zip(rnd.sample(range(10_000), len(texts)), texts)) + [(-7, texts[0]), (-7, texts[20])]
    assert joined(make_docs(rows, clashing=True), small=4, centres=2) == brute_join(rows)


def test_join_of_a_large_group_without_its_source(make_docs):
    """A hundred variants of one text, most linked only through others."""
    rows = list(enumerate(list(variants(3, 90, 100, 7)), 1))
    found = brute_join(rows)
    assert 1 < len({c for _, _, c in found}) < 100
    assert joined(make_docs(rows), small=8, centres=3) == found


def test_join_at_the_threshold(make_docs):
    """85 of 100 shingles are a link and 84 of 100 are not: sets of single words, by words=1."""
    common = [f"c{i}" for i in range(85)]
    link = [(1, " ".join(common)), (2, " ".join(common + [f"x{i}" for i in range(15)])), (3, " ".join(common[:84]))]
    found = joined(make_docs(link), words=1)
    assert found == brute_join(link, k=1) and found[2][2] == 1
    below = [(1, " ".join(common[:84])), (2, " ".join(common[:84] + [f"x{i}" for i in range(16)]))]
    assert joined(make_docs(below), words=1) == [(1, 84, 1), (2, 100, 2)]


def test_join_of_null_ids_repeats_and_nothing(make_docs):
    same = "a b c d e f g"
    rows = [(None, same), (None, same), (3, same), (3, same), (2, same.upper()), (9, None)]
    assert joined(make_docs(rows)) == sorted([(None, 4, None)] * 2 + [(3, 4, 2)] * 2 + [(2, 4, 2), (9, 0, 9)], key=str)
    assert joined(make_docs([])) == []


def test_an_id_of_two_texts_links_both(make_docs):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, other), (2, other + " c"), (3, one + " c")]
    assert joined(make_docs(rows)) == brute_join(rows)
    assert {r[2] for r in joined(make_docs(rows))} == {1}


def test_join_agrees_with_sql(spark, sql):
    df = QUERIES["op11_ngram_jaccard_join"](spark, SMALL)
    assert canonical(df) == sql({"documents": f"{SMALL}/documents.parquet"}, ORACLES["op11_ngram_jaccard_join"])


# Periodic runs


def brute_lyndon(s):
    return [max(m for m in range(1, len(s) - i + 1) if all(s[i : i + m] < s[i + k : i + m] for k in range(1, m))) for i in range(len(s))]


def brute_runs(s, least=12):
    """Stretches of equal words q apart, which are as long as they can be; q must be the smallest."""
    found = []
    for q in range(1, len(s)):
        i = 0
        while i + q < len(s):
            start = i
            while i + q < len(s) and s[i] == s[i + q]:
                i += 1
            length = i - start + q
            part = s[start : start + length]
            if i > start and length >= max(least, 2 * q) and not any(part[r:] == part[: length - r] for r in range(1, q)):
                found.append((start, length, q))
            i = max(i, start + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return b" ".join(w for i, w in enumerate(words) if i not in dropped)


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return doc_id, len(runs), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(brute_collapsed(words, runs)).hexdigest()


def test_lyndon_arrays_under_both_orders():
    rnd = random.Random(1)
    for _ in range(600):
        s = [rnd.randrange(rnd.randrange(1, 4)) for _ in range(rnd.randrange(1, 24))]
        assert periodic.lyndon_array(s) == brute_lyndon(s)
        assert periodic.lyndon_array([-c for c in s]) == brute_lyndon([-c for c in s])
    assert periodic.lyndon_array([]) == []


@pytest.mark.parametrize("least", [2, 6, 12])
def test_runs_of_stretches(least):
    rnd = random.Random(least)
    for _ in range(150):
        stretches = []
        for _ in range(rnd.randrange(4)):
            s = [rnd.randrange(rnd.randrange(1, 5)) for _ in range(rnd.randrange(1, 40))]
            stretches.append(s + (s[: rnd.randrange(1, 9)] * 5)[: rnd.randrange(30)] + s[:5])
        expected = [(k, *r) for k, s in enumerate(stretches) for r in brute_runs(s, least)]
        assert periodic.runs_in(stretches, least) == expected


def periodic_texts():
    rnd = random.Random(8)
    for _ in range(150):
        base = [f"w{rnd.randrange(rnd.choice((2, 5, 300)))}" for _ in range(rnd.randrange(1, 80))]
        for _ in range(rnd.randrange(3)):
            at, p = rnd.randrange(len(base)), rnd.randrange(1, 12)
            base[at:at] = (base[at : at + p] * 20)[: rnd.randrange(5, 60)]
        yield " \n\t"[rnd.randrange(3)].join(base)


def test_runs_against_brute_force(make_docs):
    rows = list(enumerate(periodic_texts())) + [
        (None, "a b " * 20), (500, None), (500, None), (501, ""), (502, " \n "), (503, "x " * 30_000), (504, "no break " * 15), (30, "é " * 11), (31, "é " * 12),
        (505, " ".join(str(i) for i in range(20_000))), (-3, "one"),
    ]
    found = periodic.runs_digest(make_docs(rows, clashing=True))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    # A quadratic search is too slow for the long texts of one word; those are known.
    expected = [brute_digest(i, t) for i, t in rows if i not in (503, 505)]
    got = sorted(map(tuple, found.collect()), key=str)
    assert [r for r in got if r[0] not in (503, 505)] == sorted(expected, key=str)
    one, none = (next(r for r in got if r[0] == i) for i in (503, 505))
    assert zlib.crc32(b"503") % 10 and one[:6] == (503, 1, 0, 30_000, 1, 30_000_000) and one[7] == hashlib.sha256(b"x").hexdigest()
    assert zlib.crc32(b"505") % 10 and none[1:6] == (0, None, None, None, None)
    assert periodic.runs_digest(make_docs([])).collect() == []


def test_runs_and_collapsed_texts(make_docs):
    text = "start " + "go on " * 6 + "a " * 5 + "b c d e f g " * 2 + "end"
    [(doc_id, runs, collapsed)] = periodic.periodic_runs(make_docs([(4, text)])).collect()
    assert (doc_id, [tuple(r) for r in runs]) == (4, [(1, 12, 2), (18, 12, 6)])
    assert collapsed == "start go on a a a a a b c d e f g end"


def test_planted_repeats_are_runs(spark):
    """Over the smallest table: whole query against brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in rows if len(t or "") < 4000]
    found = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    assert len(found) == len(rows) and any(r[1] for r in found.values())
    assert [found[i] for i, _ in short] == [brute_digest(i, t) for i, t in short]


# Alignment of tokenizers


@pytest.fixture(scope="module")
def brute_align():
    """Rows by the tokenizers' own libraries, groups and links by plain loops."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(BYTE_BPE), SentencePieceProcessor(model_file=PIECES)
    first.encode_special_tokens = True
    byte_of = {c: b for b, c in alignment.byte_letters().items()}

    def spelled(text):
        a = [(i, bytes(byte_of[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
        data = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == data == b"".join(t for _, t in b) else ([], [])

    def placed(tokens):
        ends = list(itertools.accumulate(len(t) for _, t in tokens))
        return [(i, e - len(t), e) for (i, t), e in zip(tokens, ends)]

    def run(rows):
        found, counts = [], Counter()
        for doc_id, text in rows:
            a, b = map(placed, spelled(text) if text else ([], []))
            linked = [(i, j) for i, s, e in a for j, p, q in b if s < q and p < e]
            counts.update(linked)
            groups, x, y = [], [], []
            for end in sorted({e for _, _, e in a} & {e for _, _, e in b}):
                x = [str(i) for i, s, e in a if e <= end and s >= (groups[-1][2] if groups else 0)]
                y = [str(i) for i, s, e in b if e <= end and s >= (groups[-1][2] if groups else 0)]
                groups.append((x, y, end))
            told = ";".join(",".join(x) + "|" + ",".join(y) for x, y, _ in groups)
            found.append((doc_id, len(a), len(b), len(groups), linked, hashlib.sha256(told.encode()).hexdigest() if a else ""))
        highest = {}
        for (_, j), n in counts.items():
            highest[j] = max(highest.get(j, 0), n)
        return sorted(
            ((d, na, nb, ng, len(ls), sum(counts[p] == highest[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for d, na, nb, ng, ls, sha in found), key=str
        )

    return run


TEXTS = [
    None, "", " ", "a", "Hello world", "  two  blanks   three\n\n  lines \t tab", "<|endoftext|> and <s> </s> <unk> <0x41> are text", "the mark ▁ itself", "naïve café — déjà vu…",
    "日本語のテキスト and 🙂🙃 smileys", "x" * 400, "ab" * 300 + " " + "cd" * 100, "it's we'll they've I'm 'sorry'", "1234567 89,001.50", "trailing   ", "\x00 nul", "é combining ﬁ",
    "a b c d", "word " * 200, "\n" * 40, " " * 50 + "x" + " " * 50, "UPPER lower " * 30, "ﬁ ½ ™ Å ", "\r\n windows \r\n lines",
]
OWN = dict(json_path=BYTE_BPE, model_path=PIECES, pattern=PATTERN)


def aligned(df, **options):
    return sorted(map(tuple, alignment.align(df, **OWN, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"range_bytes": 7, "fan_in": 2, "chunk_links": 50}, {"range_bytes": 40, "fan_in": 3, "chunk_links": 1}])
def test_alignment_against_brute_force(make_docs, brute_align, options):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "Hello world"), (None, None)]
    assert aligned(make_docs(rows, clashing=True), **options) == brute_align(rows)


def test_alignment_of_the_smallest_table(spark, brute_align):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.length("text") < 3000)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = brute_align(rows)
    assert aligned(docs) == expected
    assert aligned(docs, range_bytes=300, fan_in=2) == expected


def test_alignment_of_nothing_and_of_one_long_word(make_docs):
    assert aligned(make_docs([])) == []
    rows = [(1, "abc" * 60_000), (2, "many words " * 20_000)]
    found = aligned(make_docs(rows))
    assert found == aligned(make_docs(rows), range_bytes=1 << 30)
    assert all(r[4] == r[1] + r[2] - r[3] > 0 for r in found)


def test_fragments_compose_in_any_order():
    """Random tokens, cut for each tokenizer at places of its own; every bracketing gives the whole."""
    import numpy as np

    rnd = random.Random(2)

    def equal(x, y):
        parts = lambda f: [getattr(t, p).tolist() for t in (f.prefix, f.closed, f.suffix) for p in ("a", "a_ends", "b", "b_ends")]
        return parts(x) == parts(y) and x.closes == y.closes

    for _ in range(300):
        total = rnd.randrange(1, 40)
        sides = []
        for _ in range(2):
            ends = sorted({total, *(rnd.randrange(1, total + 1) for _ in range(rnd.randrange(20)))})
            cuts = sorted(rnd.randrange(len(ends) + 1) for _ in range(4))
            sides.append((ends, [0, *cuts, len(ends)]))
        (a, ca), (b, cb) = sides
        whole = alignment.Tokens(*(np.array(x) for x in (range(len(a)), a, range(len(b)), b)))
        parts = [alignment.Tokens(whole.a[i:j], whole.a_ends[i:j], whole.b[k:m], whole.b_ends[k:m]) for i, j, k, m in zip(ca, ca[1:], cb, cb[1:])]
        fragments = [alignment.Fragment.of(p) for p in parts]
        v, w, x, y, z = fragments
        assert equal(((v + w) + x) + (y + z), v + (w + (x + (y + z)))) and equal((v + (w + x)) + (y + z), alignment.compose(fragments))
        assert equal(alignment.compose(fragments), alignment.Fragment.of(whole)) and equal(alignment.EMPTY + v, v) and equal(v + alignment.EMPTY, v)
