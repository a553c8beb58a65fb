"""A quality classifier from weak labels: heuristic labellers, their accuracies by expectation-
maximisation, and a hashed linear scorer trained on the posterior labels.

A text is bad for one of two reasons, each with its own overlapping labellers: it is junk, or it
is toxic. The two are estimated apart, since the labellers of one say nothing of the other."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool.llm.common import map_texts, maybe_among, text_key, without_texts
from motorpool.llm.license import words as plain_words
from motorpool.session import materialise

#: Documents, picked by a hash of id and text, that the scorer is trained on (about; a sample).
TRAIN_ROWS = 12_000
#: A mined word's share of toxic texts is this many times that of others, and so large a share of the
#: texts that hold it is toxic by chance this rarely. A text counts there only as far as the word
#: stands between other neighbours, so that copies of one text count once.
MINED_LIFT, MINED_CHANCE = 20, 1e-3
#: Mined words, and words that may be, of up to this many bytes, ``WORD_BYTES`` more for each, go to
#: every task; more are joined.
MINED_BYTES, WORD_BYTES = 8 << 20, 64
#: Hashed features, a power of two; the weights go to every task.
FEATURES = 1 << 18
EM_ROUNDS, FIT_ROUNDS, RATE, SHRINK, WORD = 60, 150, 0.1, 2e-5, 0.3
#: Documents scored below this are rejected.
KEEP = 0.5

#: Function words of the languages at hand, and insults; fixed values.
FUNCTION_WORDS = frozenset(w.encode() for w in (
    "the and of to a in is it that for on with as was at by be this from are or an not have has he she they his her its we you "
    "der die das und ist in den von zu mit im auf für nicht ein eine als auch es an dem des sich bei "
    "le la les de des et un une en du est que qui dans pour par sur au avec ne pas plus "
    "el los las y una por con se del al su para es lo como más"
).split())
INSULTS = frozenset(w.encode() for w in (
    "idiot idiots moron morons stupid worthless pathetic clown clowns loser losers scum trash garbage imbecile imbeciles dumb fool "
    "fools disgusting filth filthy vermin hate ugly jerk jerks creep freak freaks coward liar lunatic dimwit halfwit bastard crap "
    "dummkopf trottel abschaum versager blöd dumm imbécile crétin abruti ordure minable estúpido idiota imbécil basura inútil"
).split())
_SYMBOLS = "#$%&*|~^<>=_{}[]\\@"
_RUN = re.compile(r"[!?#$%&*~^=@]{2,}")
_LONE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)")
_ASCII_UPPER = bytes(range(65, 91))
_ASCII_LETTERS = _ASCII_UPPER + bytes(range(97, 123))

BAD, NONE, GOOD = 0, 1, 2
#: Each heuristic: against the text from (or up to) the first number, for it up to (or from) the
#: second, and otherwise no vote. Those from ``insults`` on judge toxicity, the others junk.
RULES = {
    "symbols": (0.10, 0.03),
    "shouting": (0.50, 0.20),
    "stutter": (0.20, 0.05),
    "loops": (0.40, 0.10),
    "runs": (0.20, 0.02),
    "lone": (0.20, 0.03),
    "function": (0.05, 0.15),
    "insults": (0.004, 0.0),
    "mined": (0.004, 0.0),
    "variety": (2, 0),
}
JUNK = list(RULES).index("insults")
#: Texts of fewer words give no vote on repetition and function words.
SHORT = 20
#: The annotators vote on both; their votes come last, on quality and then on toxicity.
ANNOTATORS = ("annotated quality", "annotated toxicity")
CONCERNS = (*range(JUNK), len(RULES)), (*range(JUNK, len(RULES)), len(RULES) + 1)


def signals(text: str | None, mined: frozenset = frozenset()) -> tuple[list[float], list[bytes]]:
    """The numbers that the rules judge, in their order, and the plain words."""
    text = text or ""
    raw, tokens = text.split(), plain_words(text)
    data = text.encode()
    letters = len(data) - len(data.translate(None, _ASCII_LETTERS))
    upper = len(data) - len(data.translate(None, _ASCII_UPPER))
    solid = sum(map(len, raw)) or 1
    n, r = len(tokens), len(raw) or 1
    long_enough = n >= SHORT
    distinct = set(tokens)
    insults, telling = distinct & INSULTS, distinct & mined
    mined_rate = sum(map(telling.__contains__, tokens)) / n if telling else 0.0
    # A single mined word in a text that is not tiny may be chance.
    if len(telling) == 1 and mined_rate < 0.03:
        telling, mined_rate = telling & insults, 0.0
    return [
        sum(map(text.count, _SYMBOLS)) / solid,
        upper / letters if letters >= 40 else 0.1,
        sum(map(operator.eq, tokens, tokens[1:])) / n if long_enough else 0.0,
        1 - len(set(zip(tokens, tokens[1:], tokens[2:]))) / (n - 2) if long_enough else 0.0,
        len(_RUN.findall(text)) / r,
        len(_LONE.findall(text)) / r,
        sum(map(FUNCTION_WORDS.__contains__, tokens)) / n if long_enough else 0.1,
        sum(map(insults.__contains__, tokens)) / n if insults else 0.0,
        mined_rate,
        len(insults | telling),
    ], tokens


def votes(values: list[float]) -> str:
    """A digit per rule: 0 against the text, 2 for it, 1 no vote."""
    out = []
    for value, (name, (bad, good)) in zip(values, RULES.items(), strict=True):
        if name == "function":
            out.append(BAD if value <= bad else GOOD if value >= good else NONE)
        else:
            out.append(BAD if value >= bad else GOOD if value <= good else NONE)
    return "".join(map(str, out))


class Hasher:
    """Feature numbers of a text: its distinct words and the level of each signal."""

    def __init__(self, size: int = FEATURES, known: int = 100_000):
        self.size, self.most, self.known = size, known, {}

    def number(self, feature: bytes) -> int:
        n = self.known.get(feature)
        if n is None:
            if len(self.known) >= self.most:
                self.known.clear()
            n = self.known[feature] = xxhash.xxh3_64_intdigest(feature) & (self.size - 1)
        return n

    def features(self, values: list[float], tokens: list[bytes]) -> np.ndarray:
        """Words first, each weighing ``WORD``; then one feature per signal, weighing 1."""
        numbers = np.unique(np.fromiter(map(self.number, set(tokens)), np.int32))
        levels = [self.number(f"{name}:{min(12, int(24 * value ** 0.5))}".encode() + b"\0") for name, value in zip(RULES, values)]
        return np.concatenate([numbers, np.array(levels, np.int32)])


def estimate(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], np.ndarray]:
    """Expectation-maximisation over vote patterns and their counts: how often each labeller gives
    each vote on good and on bad texts. Returns each pattern's probability of being good, and
    the table ``[labeller, class, vote]`` (class 1 is good)."""
    names = sorted(patterns)
    seen = np.array([[int(v) for v in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    onehot = np.eye(3)[seen]
    # To begin with, one vote against outweighs a few in favour.
    good = 1 / (1 + np.exp(2.0 * (seen == BAD).sum(1) - 0.5 * (seen == GOOD).sum(1)))
    for _ in range(rounds):
        by_class = np.stack([weight * (1 - good), weight * good])
        prior = (by_class.sum(1) + 1) / (weight.sum() + 2)
        table = np.einsum("cp,plv->lcv", by_class, onehot) + 0.1
        table /= table.sum(2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,lcv->cp", onehot, np.log(table))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
    return dict(zip(names, good.tolist())), table


def accuracies(table: np.ndarray, prior_good: float) -> np.ndarray:
    """Each labeller's share of right votes among the votes it gives."""
    right = prior_good * table[:, 1, GOOD] + (1 - prior_good) * table[:, 0, BAD]
    wrong = prior_good * table[:, 1, BAD] + (1 - prior_good) * table[:, 0, GOOD]
    return right / (right + wrong)


def fit(features: np.ndarray, lengths: np.ndarray, target: np.ndarray, copies: np.ndarray, size: int = FEATURES, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Weights of a logistic scorer, the last one its offset, by Adam on the whole sample: the
    texts' features one after another, how many each has, and how often each text counts."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    used, at = np.unique(features, return_inverse=True)
    at, row = at.astype(np.int32), np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    x = np.full(len(at), WORD, np.float32)
    for signal in range(1, len(RULES) + 1):
        x[ends - signal] = 1
    # Both classes weigh the same, whatever their shares.
    share = np.clip(np.average(target, weights=copies), 1e-6, 1 - 1e-6)
    weight = copies * (target * 0.5 / share + (1 - target) * 0.5 / (1 - share))
    w = np.zeros(len(used) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = np.add.reduceat(w[at] * x, starts) + w[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - target) / copies.sum()
        g = np.append(np.bincount(at, error[row] * x, len(used)) + SHRINK * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    full = np.zeros(size + 1, np.float32)
    full[used], full[-1] = w[:-1], w[-1]
    return full


_WORDS = pa.schema([("word", pa.binary()), ("place", pa.int64()), ("n", pa.int64())])
_HELD = pa.schema([("digest", pa.string()), ("word", pa.binary())])
_NUMBERS = pa.schema([("doc_id", pa.int64()), ("numbers", pa.list_(pa.int64()))])
_NUMBERED = pa.schema([("word", pa.binary()), ("number", pa.int64())])
_VOTES = pa.schema([("doc_id", pa.int64()), ("votes", pa.string())])
_SAMPLE = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32())), ("copies", pa.int64())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("score", pa.float64())])


def _by_document(labels: DataFrame) -> DataFrame:
    """One row per named document: the worst that any of its labels says, as votes."""
    toxic, quality = F.max(F.coalesce("toxic", F.lit(0))), F.min(F.coalesce("quality", F.lit(1)))
    said = [F.when(c, str(BAD)).otherwise(str(GOOD)) for c in (quality < 1, toxic > 0)]
    named = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return named.agg(F.concat(*said).alias("said"), toxic.cast("long").alias("toxic"))


def _annotated(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    silent = F.lit(str(NONE) * 2)
    if labels is None:
        return df.withColumn("votes", F.concat("votes", silent))
    said = _by_document(labels).select("doc_id", "said")
    return df.join(said, "doc_id", "left").withColumn("votes", F.concat("votes", F.coalesce("said", silent))).drop("said")


def sampled(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """``(doc_id, text, copies)``: about ``rows`` of the ``total`` rows, picked by a hash of id and
    text. Equal rows are one row that says how many of them are picked, at the same rate as others.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    lot = F.pmod(F.col("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor(F.count(F.lit(1)) * min(1.0, rows / max(1, total)) + lot)
    # These are about ``rows`` at most, whatever the table.
    chosen = keyed.groupBy("key").agg(copies.alias("copies")).filter("copies > 0")
    one = keyed.join(F.broadcast(chosen), "key").groupBy("key", "copies")
    return one.agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).select("doc_id", "text", "copies")


def telling_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(word)``: words that mark toxic texts, by their counts in all annotated documents.

    Words are counted in the toxic texts first, which are few. Those that could tell if no
    other text had them are looked up in all other annotated texts; no text of these is
    shuffled, only the numbers of the words that each holds.
    """
    named = _by_document(labels).select("doc_id", "toxic")
    totals = {r["toxic"]: r["count"] for r in named.groupBy("toxic").count().collect()}
    toxic, others = totals.get(1, 0), totals.get(0, 0)

    def places(columns: list[list]) -> Iterable[tuple]:
        counts: Counter = Counter()
        for _, text in zip(*columns):
            tokens = plain_words(text)
            around = [b"", *tokens, b""]
            counts.update({(w, xxhash.xxh3_64_intdigest(a + b" " + b) >> 1) for a, w, b in zip(around, tokens, around[2:])})
            counts.update((w, -1) for w in set(tokens))
        return ((w, place, n) for (w, place), n in counts.items())

    def among(toxicity: int) -> DataFrame:
        ids = named.filter(F.col("toxic") == toxicity).select("doc_id")
        return maybe_among(docs, "doc_id", ids).select("doc_id", "text")

    texts = among(1).join(named.filter("toxic = 1"), "doc_id").select("doc_id", "text")
    placed = map_texts(texts, places, _WORDS).groupBy("word", "place").agg(F.sum("n").alias("n"))
    counts = placed.groupBy("word").agg(
        F.count_if(F.col("place") >= 0).alias("places"), F.sum(F.when(F.col("place") == -1, F.col("n")).otherwise(0)).alias("t")
    )
    base = min(max(toxic / max(1, toxic + others), 1e-9), 1 - 1e-9)

    def telling(c: Column) -> Column:
        lift = (F.col("t") / (toxic + 1)) / ((c + 0.5) / (others + 1))
        # Chernoff's bound on the chance of so many toxic texts among those with the word.
        hits = F.least("places", "t")
        share = hits / (hits + c)
        away = F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
        chance = F.exp(-(hits * F.log(share / base) + away))
        return (hits > 0) & (share > base) & (lift >= MINED_LIFT) & (chance <= MINED_CHANCE)

    sought = materialise(counts.filter(telling(F.lit(0))), "sought-words")
    size = sought.agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("size")).first()["size"] or 0
    known = None if size > MINED_BYTES else frozenset(_word_number(bytes(r["word"])) for r in sought.select("word").collect())

    def held(columns: list[list]) -> Iterable[tuple]:
        for doc_id, text in zip(*columns):
            numbers = set(map(_word_number, plain_words(text)))
            yield doc_id, list(numbers if known is None else numbers & known)

    clean = map_texts(among(0), held, _NUMBERS).join(named.filter("toxic = 0").select("doc_id"), "doc_id")
    with_word = clean.select(F.explode("numbers").alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("c"))
    numbered = map_texts(sought.select("word"), lambda columns: ((w, _word_number(w)) for w in columns[0]), _NUMBERED, text=0)
    counted = sought.join(numbered, "word").join(with_word, "number", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return counted.filter(telling(F.col("c"))).select("word")


def _word_number(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def mine(docs: DataFrame, labels: DataFrame) -> frozenset | DataFrame:
    """The telling words: a set where it is small enough for every task, or else a table."""
    words = materialise(telling_words(docs, labels), "mined-words")
    size = words.agg(F.sum(F.octet_length("word") + WORD_BYTES).alias("size")).first()["size"] or 0
    return words if size > MINED_BYTES else frozenset(bytes(r["word"]) for r in words.collect())


def _with_mined(docs: DataFrame, mined: frozenset | DataFrame, *more: str) -> DataFrame:
    """``docs(doc_id, text)`` and ``more``, and where the mined words are a table those that each text holds."""
    docs = docs.select("doc_id", "text", *more)
    if isinstance(mined, frozenset):
        return docs

    def held(columns: list[list]) -> Iterable[tuple]:
        for digest, text in zip(*columns):
            yield from ((digest, w) for w in set(plain_words(text)))

    keyed = docs.withColumn("digest", F.coalesce(F.sha2("text", 256), F.lit("")))
    hits = map_texts(keyed.select("digest", "text"), held, _HELD).join(mined, "word").groupBy("digest").agg(F.collect_set("word").alias("held"))
    return keyed.join(hits, "digest", "left").select("doc_id", "text", *more, F.coalesce("held", F.array().cast("array<binary>")).alias("held"))


def _judged(columns: list[list], mined: frozenset) -> Iterable[tuple]:
    """Each text's id, signals and plain words."""
    for doc_id, text, *held in zip(*columns):
        yield doc_id, *signals(text, frozenset(held[0]) if held else mined)


class Model:
    """What scoring needs: mined words and the scorer's weights; and the labellers' accuracies."""

    def __init__(self, mined: frozenset | DataFrame = frozenset(), weights: np.ndarray | None = None, accuracy: dict[str, float] | None = None):
        self.mined, self.accuracy = mined, accuracy or {}
        self.weights = np.zeros(FEATURES + 1, np.float32) if weights is None else weights


def train(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """The labellers vote on every document; what comes to the driver is the count of each
    pattern of votes, of which there are at most 3 to the number of labellers at any size. The
    scorer is then fitted on about ``train_rows`` documents, picked by a hash of id and text.
    """
    mined = mine(docs, labels) if labels is not None else frozenset()
    everywhere = mined if isinstance(mined, frozenset) else frozenset()

    def vote_rows(columns: list[list]) -> Iterable[tuple]:
        for doc_id, values, _ in _judged(columns, everywhere):
            yield doc_id, votes(values)

    counted = _annotated(map_texts(_with_mined(docs, mined), vote_rows, _VOTES), labels).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in counted)
    good, accuracy = dict.fromkeys((r["votes"] for r in counted), 1.0), {}
    for concern in CONCERNS:
        patterns: dict[str, int] = {}
        for r in counted:
            part = "".join(r["votes"][i] for i in concern)
            patterns[part] = patterns.get(part, 0) + r["n"]
        if patterns:
            posterior, table = estimate(patterns)
            prior = sum(posterior[p] * n for p, n in patterns.items()) / total
            names = [*RULES, *ANNOTATORS]
            right = accuracies(table, prior)
            if right.mean() < 0.5:  # the classes have changed names on the way
                posterior, right = {p: 1 - g for p, g in posterior.items()}, accuracies(table[:, ::-1], 1 - prior)
            accuracy |= dict(zip((names[i] for i in concern), right.round(4).tolist()))
            for pattern in good:
                good[pattern] *= posterior["".join(pattern[i] for i in concern)]
    hasher = Hasher()

    def sample_rows(columns: list[list]) -> Iterable[tuple]:
        doc_ids, texts, copies, *held = columns
        for n, (doc_id, values, tokens) in zip(copies, _judged([doc_ids, texts, *held], everywhere)):
            yield doc_id, votes(values), hasher.features(values, tokens), n

    chosen = _with_mined(sampled(docs, train_rows, total), mined, "copies")
    sample = _annotated(map_texts(chosen, sample_rows, _SAMPLE), labels).toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    if not sample.num_rows:
        return Model(mined, accuracy=accuracy)
    lists = sample.column("features").combine_chunks()
    target = np.array([good.get(p, 0.5) for p in sample.column("votes").to_pylist()])
    return Model(mined, fit(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(), target, sample.column("copies").to_numpy()), accuracy)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, votes, score)``; score is the scorer's probability that the text is good."""
    everywhere = model.mined if isinstance(model.mined, frozenset) else frozenset()
    shared, hasher = docs.sparkSession.sparkContext.broadcast((everywhere, model.weights)), Hasher()

    def rows(columns: list[list]) -> Iterable[tuple]:
        mined, w = shared.value
        for doc_id, values, tokens in _judged(columns, mined):
            at = hasher.features(values, tokens)
            z = WORD * float(w[at[: -len(RULES)]].sum()) + float(w[at[-len(RULES) :]].sum()) + float(w[-1])
            yield doc_id, votes(values), round(float(1 / (1 + np.exp(-np.clip(z, -60, 60)))), 6)

    return map_texts(_with_mined(docs, model.mined), rows, _SCORED)


def classify(docs: DataFrame, labels: DataFrame | None = None, train_rows: int = TRAIN_ROWS, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, votes, score, kept.

    ``labels(doc_id, quality, toxic)``, where given, are one more labeller for each concern, silent
    on documents they do not name, and words of toxic texts are mined from them. Null and empty texts are judged like any other, by their lack of signals;
    a null doc_id stays null; repeated rows are judged alike and returned each; an empty table
    gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score_documents(docs, train(docs, labels, train_rows)).withColumn("kept", F.col("score") >= keep)


def drop_rejected(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``docs`` with all its columns, without the rows whose text the classifier rejects. The score
    is that of the text alone, so rows without an id go too, and others of an id stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keyed = rows.select(text_key(F.col("text")).alias("doc_id"), "text")
    return without_texts(docs, score_documents(keyed, train(rows, labels)).filter(F.col("score") < KEEP).select("doc_id"))
