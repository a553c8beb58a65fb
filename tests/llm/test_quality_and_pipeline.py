"""The classifier on held-out labels, and the pipeline against the operators' brute force."""

import base64

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from motorpool.llm import quality
from motorpool.llm.queries import QUERIES, VOCABULARY
from tests.conftest import SMALL
from tests.llm.test_dedup import LOWER, brute_near, shingles
from tests.llm.test_text import brute_contained

SMALL_001 = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.8, 0.7])
    truth = rng.random(20_000) < 0.8
    gives = rng.random((20_000, 4)) < 0.7
    hits = rng.random((20_000, 4)) < right
    said = np.where(~gives, 1, np.where(hits == truth[:, None], 2, 0))
    patterns, counts = np.unique(said, axis=0, return_counts=True)
    named = {"".join(map(str, p)): int(c) for p, c in zip(patterns, counts)}
    posterior, table = quality.estimate(named)
    found = quality.accuracies(table, truth.mean())
    assert np.abs(found - right).max() < 0.03
    guessed = np.array([posterior["".join(map(str, r))] > 0.5 for r in said])
    assert (guessed == truth).mean() > 0.9


def test_held_out_accuracy(spark):
    """Fitted with half of the labels, judged by the other half."""
    docs, labels = (spark.read.parquet(f"{SMALL_001}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0
    found = quality.classify(docs, labels.filter(half)).join(labels.filter(~half), "doc_id")
    counts = {(r["quality"], r["toxic"], r["kept"]): r["count"] for r in found.groupBy("quality", "toxic", "kept").count().collect()}
    total = lambda **w: sum(n for (q, t, k), n in counts.items() if w.get("q", q) == q and w.get("t", t) == t and w.get("k", k) == k)
    assert total(q=1, t=0, k=True) >= 0.97 * total(q=1, t=0)
    assert total(q=0, k=False) >= 0.95 * total(q=0)
    # Few toxic texts are labelled here, so insults of the smaller languages cannot be learnt.
    assert total(q=1, t=1, k=False) >= 0.6 * total(q=1, t=1)


def test_without_labels_junk_is_still_found(spark):
    docs, labels = (spark.read.parquet(f"{SMALL_001}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.classify(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    shares = {r["quality"]: r["share"] for r in kept.collect()}
    assert shares[0] < 0.1 and shares[1] > 0.8


def test_rare_words_of_toxic_texts_are_mined_from_all_annotated(spark):
    """A word in one of 1,400 toxic texts, five texts of 7,000, beside 53,000 others."""
    toxic = F.col("id") < 7000
    text = F.when(toxic, F.concat(F.lit("a"), "id", F.lit(" rare"), F.col("id") % 1400, F.lit(" b"), "id")).otherwise(F.concat(F.lit("plain c"), "id"))
    rows = spark.range(60_000)
    docs = rows.select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = rows.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), toxic.cast("int").alias("toxic"))
    assert quality.mine(docs, labels) == {f"rare{i}".encode() for i in range(1400)}
    copies = docs.withColumn("text", F.when(F.col("doc_id") < 7000, "one text often repeated").otherwise(F.col("text")))
    assert quality.mine(copies, labels) == frozenset()


def test_joined_words_give_what_words_in_every_task_give(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SMALL_001}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    expected = sorted(map(tuple, quality.classify(docs, labels).collect()))
    monkeypatch.setattr(quality, "MINED_BYTES", 0)
    assert not isinstance(quality.mine(docs, labels), frozenset)
    assert sorted(map(tuple, quality.classify(docs, labels).collect())) == expected


def test_sample_of_rows_without_an_id_and_of_equal_rows(spark):
    n = F.col("id")
    doc_id = F.when(n % 4 == 0, None).when(n % 4 == 1, F.lit(7)).otherwise(n)
    docs = spark.range(40_000).select(doc_id.cast("long").alias("doc_id"), F.when(n % 8 < 2, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    found = quality.sampled(docs, 1000, 40_000).collect()
    assert len(found) < 1000 and 850 < sum(r["copies"] for r in found) < 1150
    assert {r["doc_id"]: r["copies"] for r in found if r["text"] == "same"} == {None: pytest.approx(125, abs=1), 7: pytest.approx(125, abs=1)}
    for same_id in (None, 7):
        assert 80 < sum(r["doc_id"] == same_id and r["text"] != "same" for r in found) < 170


def test_classifier_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "a text"), (3, "!!! ### $$$ " * 50_000), (4, "it is the same"), (4, "it is the same")]
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1), (1, 1, 0), (1, 1, 0), (99, 0, 0)], LABELS)
    found = quality.classify(make_docs(rows, clashing=True), labels).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    assert quality.classify(make_docs([]), labels).collect() == []
    assert quality.classify(make_docs([]), spark.createDataFrame([], LABELS)).collect() == []


def test_rejected_rows_go_by_their_text(spark, make_docs):
    good = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL_001}/documents.parquet").filter("doc_id < 300").select("doc_id", "text").collect()]
    labels = spark.read.parquet(f"{SMALL_001}/labels.parquet")
    junk = "### $$$ !!! %% && " * 40
    rows = good + [(None, junk), (good[0][0], junk), *((None, t) for _, t in good[1:30])]
    docs = make_docs(rows, clashing=True)
    kept = quality.drop_rejected(docs, labels)
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    judged = {r["doc_id"]: r["kept"] for r in quality.classify(make_docs(rows), labels).filter("doc_id IS NOT NULL").collect() if r["doc_id"] != good[0][0]}
    assert kept.columns == docs.columns and not any(t == junk for _, t in found) and good[0] in found
    unnamed = sorted(t for i, t in found if i is None)
    assert unnamed == sorted(t for i, t in good[1:30] if judged[i]) and unnamed
    assert {i for i, _ in found} - {None, good[0][0]} == {i for i, k in judged.items() if k}


def test_words_that_toxic_texts_share_with_others_are_counted_in_all(spark, monkeypatch):
    """The same words whether the sought ones go to every task or not."""
    docs, labels = (spark.read.parquet(f"{SMALL_001}/{t}.parquet") for t in ("documents", "labels"))
    expected = sorted(bytes(r["word"]) for r in quality.telling_words(docs, labels).collect())
    monkeypatch.setattr(quality, "MINED_BYTES", 0)
    assert expected and sorted(bytes(r["word"]) for r in quality.telling_words(docs, labels).collect()) == expected


def test_stages_over_the_smallest_tables(spark):
    """Each stage against brute force on what the one before it kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("kept", F.lit("clash"))
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "near dedup", "benchmark decontamination", "byte-level BPE"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    judged = stages["quality classifier"](spark, docs, SMALL)
    before = texts(judged)
    assert judged.columns == docs.columns and 0 < len(before) < docs.count()
    exact = stages["exact dedup"](spark, judged, SMALL)
    best = {}
    for i, t in before.items():
        norm = t.translate(LOWER)
        best[norm] = max(best.get(norm, i), i)
    assert exact.columns == docs.columns and set(texts(exact)) == set(best.values())
    rows = sorted(texts(exact).items())
    near = stages["near dedup"](spark, exact, SMALL)
    assert near.columns == docs.columns and set(texts(near)) == {i for i, _, _, kept in brute_near(rows, 80) if kept}
    rows = sorted(texts(near).items())
    clean = stages["benchmark decontamination"](spark, near, SMALL)
    hit = {d for d, *_ in brute_contained(rows, benchmark)}
    assert clean.columns == docs.columns and set(texts(clean)) == {i for i, _ in rows} - hit
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = texts(clean)
    coded = stages["byte-level BPE"](spark, clean, SMALL).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids"], r["text"]) for r in coded} == {
        i: (len(ids), ids, t) for i, t in kept.items() for ids in [encoding.encode_ordinary(t)]
    }


def test_run_is_the_stages_one_after_another(spark):
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == ["doc_id", "n_tokens", "ids", "text"] and found.count() > 0


@pytest.mark.parametrize("n", range(1, 14))
def test_every_operator_has_one_query(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1


def test_shingles_of_short_texts():
    assert shingles("a b") == {(b"a", b"b")} and shingles("") == set()
