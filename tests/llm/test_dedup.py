"""Exact and near dedup against brute force."""

import hashlib
import itertools
import random

from pyspark.sql import functions as F

from motorpool.llm import exact, near
from motorpool.llm.queries import ORACLES
from tests.conftest import SMALL
from tests.llm.conftest import canonical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "ÀB"), (6, "Àb"), (7, "àb"), (8, "x" * 300_000), (10, "X" * 300_000), (None, "same text"), (None, "lone")]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        norm = (t or "").translate(LOWER)
        ids = [x for x in groups[norm] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_against_brute_force(make_docs):
    rows = ROWS + [(100 + i, "hot") for i in range(500)] + [(2, "same text")]
    found = exact.exact_digest(make_docs(rows, clashing=True)).collect()
    assert sorted(map(tuple, found), key=str) == brute_exact(rows)


def test_exact_compares_texts_where_digests_collide(make_docs):
    weak = lambda text: F.encode(F.length(text).cast("string"), "utf-8")
    rows = [(i, random.Random(i % 7).choice("abc") + str(i % 7)) for i in range(60)]
    found = exact.mark_copies(make_docs(rows), digest=weak, salts=4).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == sorted((r[:4] for r in brute_exact(rows)), key=str)


def test_exact_of_nothing_and_stage_keeps_columns(make_docs):
    assert exact.exact_digest(make_docs([])).collect() == []
    kept = exact.drop_copies(make_docs(ROWS, clashing=True))
    assert kept.columns == make_docs(ROWS, clashing=True).columns
    assert {r["doc_id"] for r in kept.collect()} == {9, 4, 6, 7, 10, None}


def test_exact_agrees_with_sql(spark, sql):
    df = exact.exact_digest(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert canonical(df) == sql({"documents": f"{SMALL}/documents.parquet"}, ORACLES["op3_exact_dedup"])


def shingles(text, k=5):
    tokens = (text or "").translate(LOWER).encode().split()
    if not tokens:
        return set()
    return {tuple(tokens[i : i + k]) for i in range(max(1, len(tokens) - k + 1))}


def brute_near(rows, percent):
    sets = [shingles(t) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (x, (i, _)), (y, (j, _)) in itertools.combinations(enumerate(rows), 2):
        if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for (i, _), s in zip(rows, sets))


def variants(seed, base_words, n, changes):
    """A text and variants of it that differ in a few words."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(base_words)]
    for _ in range(n):
        other = list(base)
        for _ in range(rnd.randrange(changes + 1)):
            other[rnd.randrange(len(other))] = f"v{rnd.randrange(10_000)}"
        yield " ".join(other)


def test_near_against_brute_force(make_docs):
    texts = [t for seed in range(12) for t in variants(seed, 60 + 15 * seed, 9, 3)]
    texts += [None, "", " \t\n", "one two", "ONE  two", "one two three four five", "a b c d e f " * 4000]
    rnd = random.Random(5)
    rows = list(zip(rnd.sample(range(10_000), len(texts)), texts))
    found = near.near_duplicates(make_docs(rows, clashing=True), small=4, centres=2)
    assert sorted(map(tuple, found.collect())) == brute_near(rows, 85)


def test_near_loses_no_link_in_a_large_bucket(make_docs):
    """Two hundred variants of one text and as many of another with the same half: stars alone
    do not reach them all."""
    rnd = random.Random(3)
    half = [f"w{rnd.randrange(300)}" for _ in range(150)]
    texts = []
    for seed in (1, 2):
        rest = [f"q{seed}{rnd.randrange(300)}" for _ in range(60)]
        for _ in range(70):
            other = half + rest
            for _ in range(rnd.randrange(7)):
                other[rnd.randrange(len(other))] = f"v{rnd.randrange(10_000)}"
            texts.append(" ".join(other))
    rows = list(enumerate(texts, 1))
    found = near.near_duplicates(make_docs(rows), small=8, centres=4)
    assert sorted(map(tuple, found.collect())) == brute_near(rows, 85)


def test_near_null_ids_repeats_and_nothing(make_docs):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (2, "a b c d e f g")]
    found = sorted(map(tuple, near.near_duplicates(make_docs(rows)).collect()), key=str)
    assert found == sorted([(None, 3, None, True)] * 2 + [(3, 3, 2, False)] * 2 + [(2, 3, 2, True)], key=str)
    assert near.near_duplicates(make_docs([])).collect() == []


def test_near_links_both_texts_of_an_id(make_docs):
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, other), (2, other + " c"), (3, one + " c")]
    assert {r["component_id"] for r in near.near_duplicates(make_docs(rows)).collect()} == {1}


def test_near_drop_goes_by_rows(make_docs):
    """Rows without an id, repeated rows, two texts of an id, and columns of the names inside."""
    one, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(None, one), (None, one + " c"), (3, one), (3, one), (2, one + " d"), (2, other), (None, other + " c"), (None, "alone " * 9), (5, ""), (6, None), (7, "")]
    docs = make_docs(rows, clashing=True)
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    expected = [(2, one + " d"), (2, other), (None, "alone " * 9), (5, ""), (6, None), (7, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(expected, key=str)
    assert near.drop_near_duplicates(make_docs([])).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 90) if i % 30], "a long, b long")
    found = {r["node"]: r["component"] for r in near.connected_components(links).collect()}
    assert found == {i: (i - 1) // 30 * 30 + 1 for i in range(1, 91)}
