"""Personal data, licences, BPE and decontamination against brute force."""

import base64
import hashlib
import random
import re

import public_tokenizers
import numpy as np
import pytest
import tiktoken

from motorpool.llm import bpe, contamination, license, pii
from motorpool.llm.queries import ORACLES, VOCABULARY
from tests.conftest import SMALL
from tests.llm.conftest import canonical
from tests.llm.test_dedup import LOWER, shingles

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        n = int(c) * (1 + i % 2)
        total += n if n < 10 else n - 9
    return total % 10 == 0


VALID = {
    "email": lambda s: True,
    "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
    "card": lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s)),
    "phone": lambda s: 8 <= len(digits(s)) <= 15,
}


def base_spans(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if VALID[k](m[0])]


def noise(rnd, n):
    pieces = ["a@b.c", "@", "x.y@z", "@d.e", "1.2.3.4", "256.1.1.1", "1.2.3", ".5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "4111 1111 1111 1112", "+1 (555) 010-9999", "+49-30.123456", "+1((((", "é", " ", "\n", "-", ".", "007", "9" * 25, "mail me", "+12345678", "%_+"]
    return "".join(rnd.choice(pieces) for _ in range(n))


def test_base_spans_are_those_of_the_patterns():
    rnd = random.Random(1)
    for _ in range(3000):
        text = noise(rnd, rnd.randrange(25))
        assert [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["base"]] == base_spans(text), text


def test_pii_query_and_edges(make_docs):
    rnd = random.Random(2)
    rows = [(i, noise(rnd, 30)) for i in range(60)] + [(1, None), (None, ""), (70, "x" * 200_000 + "1" * 50_000), (71, "😀 a@b.c"), (71, "😀 a@b.c")]
    found = pii.pii_digest(make_docs(rows, clashing=True)).collect()
    expected = []
    for i, t in rows:
        spans = base_spans(t)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((i, *(sum(k == x for x, *_ in spans) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(expected, key=str)
    assert pii.pii_digest(make_docs([])).collect() == []


def test_added_spans_do_not_overlap_base_ones_and_scores_are_returned(make_docs):
    rnd = random.Random(5)
    pieces = ["a@b.c", "4111 1111 1111 1111", "378282246310005", "card", "token=0123456789abcdef0", "+1 555 123 4567", "1.2.3.4", "219-09-9999", "ssn", " ", ", "]
    for _ in range(200):
        text = "".join(rnd.choice(pieces) for _ in range(25))
        base = base_spans(text)
        expected = [(k, a, b) for k, a, b in base]
        for kind in pii.KINDS[len(pii.BASE) :]:
            sure = [(a, b) for a, b in pii.PROPOSE[kind](text) if pii.score(text, kind, a, b) >= pii.ENOUGH]
            expected += [(kind, a, b) for a, b in sure if not any(s < b and a < e for _, s, e in base)]
        assert [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text)] == expected
    many = "mail ann@example.org or token=0123456789abcdef0 " * 5_000
    found = {r["doc_id"]: r for r in pii.pii_digest(make_docs([(1, "mail a@b.c"), (2, many), (3, None)])).collect()}
    assert found[1]["scores"] == "1.0" and found[3]["scores"] == ""
    assert found[2]["n_email"] == 5_000 and len(found[2]["scores"].split(",")) == 10_000


def test_added_kinds_need_their_checks():
    kinds = lambda t: [(s["kind"], t[s["start"] : s["end"]]) for s in pii.spans_of(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 AND more") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00") == []
    assert kinds("amex card 378282246310005") == [("short_card", "378282246310005")]
    assert kinds("number 378282246310005") == []
    assert kinds("social security 219-09-9999") == [("ssn", "219-09-9999")]
    assert kinds('token = "0123456789abcdef0123"') == [("secret", "0123456789abcdef0123")]
    near, far = pii.spans_of("mail a@b.c")[0], pii.spans_of("order a@b.c")[0]
    assert near["score"] > far["score"] and far["base"]
    assert pii.redact("mail a@b.c!", pii.spans_of("mail a@b.c!")) == "mail [email]!"


def naive_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def naive_base(text):
    ws, out = naive_words(text), []
    for phrase, label in license.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    return len(ws), sorted(out)


def test_licences_against_brute_force(make_docs):
    rnd = random.Random(3)
    pieces = ["mit", "license", "MIT License", "apache", "general public license", "general", "public", "ünder", "the", ",", "\n", "released under the", "\x7f", "x1"]
    rows = [(i, " ".join(rnd.choice(pieces) for _ in range(rnd.randrange(40)))) for i in range(150)]
    rows += [(None, "mit license"), (3, None), (5, ""), (6, "mit"), (7, "word " * 20_000 + "apache license"), (8, "mit license"), (8, "mit license")]
    found = license.license_digest(make_docs(rows, clashing=True)).collect()
    expected = []
    for i, t in rows:
        n, places = naive_base(t)
        starts = [p for p, _ in places] or [None]
        expected.append((i, n, len(places), min(starts), max(starts), ",".join(sorted({x for _, x in places}))))
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted(expected, key=str)
    for r in found:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license.license_digest(make_docs([])).collect() == []


def test_notices_bear_gaps_and_the_better_reading_wins(make_docs):
    rows = [
        (1, "Permission is hereby granted, free of any charge, to any person obtaining a copy of this software"),
        (2, "Licensed under CC BY-NC 4.0"),
        (3, "to any person a copy of the charge is free"),
    ]
    labels = {r["doc_id"]: r["labels"] for r in license.license_digest(make_docs(rows)).collect()}
    assert labels == {1: "mit-text", 2: "cc-by-nc-4.0", 3: ""}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest_rows(rows, encoding):
    out = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_bpe_against_tiktoken(spark, make_docs, tiktoken_encoding):
    rnd = random.Random(4)
    alphabet = "ab  \n\t'sé語😀1²_-<|endoftext|>  Ω"
    rows = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60)))) for i in range(300)]
    rows += [(None, "null id"), (5, None), (6, ""), (7, "word " * 50_000), (8, "z" * 100_000), (8, "z" * 100_000)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(100).collect()]
    encoded = bpe.encode(make_docs(rows, clashing=True), VOCABULARY, public_tokenizers.PATTERN, chunk_tokens=900, buckets=7)
    ids = sorted(((r["doc_id"], r["ids"]) for r in encoded.collect()), key=str)
    assert ids == sorted(((i, tiktoken_encoding.encode_ordinary(t or "")) for i, t in rows), key=str)
    found = bpe.bpe_digest(make_docs(rows), VOCABULARY, public_tokenizers.PATTERN)
    assert sorted(map(tuple, found.collect()), key=str) == digest_rows(rows, tiktoken_encoding)


def test_bpe_of_nothing_and_unknown_ids(spark, make_docs):
    assert bpe.bpe_digest(make_docs([]), VOCABULARY, public_tokenizers.PATTERN).collect() == []
    given = spark.createDataFrame([(1, [72, 105]), (2, None), (3, [])], "doc_id long, ids array<int>")
    found = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(given, VOCABULARY, public_tokenizers.PATTERN).collect()}
    assert found[2] == found[3] == b"" and len(found[1]) >= 2
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([(1, [60_000])], "doc_id long, ids array<int>"), VOCABULARY, public_tokenizers.PATTERN).collect()


def test_packing_round_trips():
    import numpy as np

    for values in ([], [0], [1, 2**32 - 1, 7]):
        assert bpe.unpack(bpe.pack(np.array(values, np.uint32))).tolist() == values
    ranks = [0, 191, 192, 193, 194, 195, 199, 200, 5_000_000, 2**31 - 1, 1] * 3
    assert bpe.unpack_ranks(bpe.pack_ranks(np.array(ranks, np.int32))).tolist() == ranks
    assert bpe.unpack_ranks(bpe.pack_ranks(np.array([], np.int32))).tolist() == []
    for words in ([], [b"", b"\n", b"a", b"ab", b"abc", b"b"]):
        assert bpe.unpack_words(bpe.pack_words(words)) == words


ITEMS = "item_id long, text string, kept string"


def brute_contained(rows, items, percent=80):
    out = []
    for i, t in items:
        s = shingles(t)
        for d, text in rows:
            both = len(s & shingles(text))
            if s and i is not None and d is not None and 100 * both >= percent * len(s):
                out.append((d, i, len(s), both, both / len(s)))
    return sorted(out)


@pytest.mark.parametrize("most", [contamination.BROADCAST_VALUES, 0])
def test_contamination_against_brute_force(spark, make_docs, most):
    """With and without the items' sketches going to every task."""
    rnd = random.Random(6)
    word = lambda: f"w{rnd.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 5, 7, 12, 13, 30, 80])))) for i in range(40)] + [(None, "a b c d e f g"), (90, None), (91, "")]
    rows = []
    for i in range(80):
        text = [word() for _ in range(rnd.choice([0, 40, 400, 6000]))]
        for _ in range(rnd.randrange(3)):
            passage = items[rnd.randrange(40)][1].split()
            for _ in range(rnd.randrange(3)):
                passage[rnd.randrange(len(passage))] = word()
            at = rnd.randrange(len(text) + 1)
            text[at:at] = passage
        rows.append((i, " ".join(text)))
    rows += [(200, items[2][1].upper()), (201, None), (202, ""), (None, items[7][1])]
    found = contamination.contained(make_docs(rows, clashing=True), spark.createDataFrame([(*x, "x") for x in items], ITEMS), most=most)
    assert sorted(map(tuple, found.collect())) == brute_contained(rows, items)


def test_contamination_of_nothing_and_sql(spark, make_docs, sql):
    none = spark.createDataFrame([], ITEMS)
    assert contamination.contained(make_docs([(1, "a b c d e")]), none).collect() == []
    assert contamination.contained(make_docs([]), spark.createDataFrame([(1, "a b", "")], ITEMS)).collect() == []
    tables = {t: f"{SMALL}/{t}.parquet" for t in ("documents", "benchmark")}
    df = contamination.contained(*(spark.read.parquet(p) for p in tables.values()))
    assert canonical(df) == sql(tables, ORACLES["op7_decontamination"])


def test_contaminated_rows_go_by_their_text(make_docs, spark):
    """Rows without an id, and several texts of an id."""
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(None, "so " + item), (None, "clean text of its own here"), (4, "x " + item), (4, "another clean text of it"), (5, None)]
    docs = make_docs(rows, clashing=True)
    kept = contamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)


def test_decoding_refuses_a_name_that_is_taken(spark):
    given = spark.createDataFrame([(1, [5], "x")], "doc_id long, ids array<int>, decoded string")
    with pytest.raises(ValueError, match="column already"):
        bpe.decode(given, VOCABULARY, public_tokenizers.PATTERN)


def test_bpe_vocabulary_builds_only_what_a_step_uses():
    """Taking apart needs the pattern alone; ranks and token bytes stay unbuilt in its workers."""
    with open(VOCABULARY, "rb") as file:
        v = bpe.Vocabulary(file.read(), public_tokenizers.PATTERN)
    assert v.splitter().split("ab cd") == ["ab", " cd"]
    assert not {"encode", "bytes", "known"} & set(vars(v))
    assert v.encoder().encode("ab cd") == tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v._ranks(), special_tokens={}).encode_ordinary("ab cd")
    assert "bytes" not in vars(v) and v.decoder().bytes.size > 0


def test_bpe_ranks_round_trip_in_32_bits():
    ranks = np.array([0, 191, 192, 193, 255, 1 << 15, (1 << 20) + 7, (1 << 31) - 1, 3], np.int64)
    assert (bpe.unpack_ranks(bpe.pack_ranks(ranks)) == ranks).all()
