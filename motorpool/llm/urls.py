"""URL filters: association rules mined by FP-growth, matched by an inverted index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm.common import lower_ascii
from motorpool.session import materialise

#: Rules set by hand: host, path, verdict. A rule holds for its host and all subdomains.
BASE_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: A mined rule holds for this share of the labelled pages, and this many, and is right this often.
SUPPORT, LEAST_PAGES, CONFIDENCE = 0.002, 10, 0.5
DEFAULT = "allow"
#: Rules, base and mined, that go to every task; beyond this the join shuffles.
BROADCAST_RULES = 20_000

_RULES = "rule string, key string, antecedent array<string>, path string, verdict string, base boolean, confidence double, support double"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for null and where there is no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Scheme, host with each of its parent domains, path words, file ending, query fields and
    fragment. Numbers are left out: they name pages, not kinds of pages."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -i, i), ".")))
    words = F.transform(F.split(path, "/"), lambda w: F.concat(F.lit("path:"), F.regexp_replace(w, r"\.[A-Za-z]+$", "")))
    ending = F.concat(F.lit("ending:"), F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    after = F.regexp_extract(url, r"\?([^#]*)", 1)
    fields = F.transform(F.split(after, "&"), lambda q: F.concat(F.lit("query:"), q))
    scheme = F.concat(F.lit("scheme:"), lower_ascii(F.regexp_extract(url, "^([^:]*)://", 1)))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(F.array(scheme, ending), domains, words, fields, mark)
    useful = F.filter(tokens, lambda t: ~t.rlike(r"^(?!fragment)[a-z]+:$") & ~t.rlike(r"^[a-z]+:[0-9]+$"))
    return F.coalesce(F.array_distinct(useful), F.array().cast("array<string>"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(tokens, label)`` of the pages whose document has a label. The first number that is a
    whole word of the path names the document; of several labels the worst counts."""
    bad = (F.max(F.coalesce("toxic", F.lit(0))) > 0) | (F.min(F.coalesce("quality", F.lit(1))) < 1)
    given = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("named")).agg(F.when(bad, "block").otherwise("allow").alias("label"))
    host, path = url_parts(F.col("url"))
    named = F.regexp_extract(path, r"/([0-9]{1,18})(?:[/.]|$)", 1).try_cast("long")
    return pages.select(url_tokens(F.col("url"), host, path).alias("tokens"), named.alias("named")).join(given, "named").select("tokens", "label")


def alike_tokens(examples: DataFrame, least: float) -> DataFrame:
    """``(item, alike, n)``: tokens of at least ``least`` examples, those that always occur together
    as one item under the first of them. Occurrences are compared by their number and two sums of hashes."""
    seen = examples.select("row", F.explode("tokens").alias("token"))
    sums = (F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2))
    tokens = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *sums).filter(F.col("n") >= least)
    alike = F.sort_array(F.collect_list("token"))
    return tokens.groupBy("n", "sum1", "sum2").agg(alike.alias("alike")).select(F.col("alike")[0].alias("item"), "alike", "n")


def mine_rules(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_PAGES) -> DataFrame:
    """Rules ``antecedent -> verdict`` from ``examples(tokens, label)``: frequent sets of tokens and a
    label by FP-growth, kept where frequent and right enough, and better than every rule that
    has one token less, down to the label's share of all.

    Tokens that always occur together are one item: a rule with two of them is no better than
    with one, so none is kept, and without this their subsets would all be frequent. ``alike``
    lists, for each token of the antecedent, those that stand for it as well.
    """
    examples = materialise(examples.select(F.monotonically_increasing_id().alias("row"), "tokens", "label"), "examples")
    total = examples.count()
    if not total:
        return examples.sparkSession.createDataFrame([], f"{_RULES}, alike array<array<string>>")
    share = min(1.0, max(support, least / total))
    items = materialise(alike_tokens(examples, share * total - 1e-6), "items")
    held = examples.select("row", F.explode("tokens").alias("item")).join(items.select("item"), "item").groupBy("row").agg(F.collect_list("item").alias("held"))
    label = F.array(F.concat(F.lit("label="), F.col("label")))
    baskets = examples.select("row", "label").join(held, "row", "left").select(F.coalesce(F.concat("held", label), label).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].startswith("label=")).select(
        F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 7, 100).alias("verdict"), "confidence", "support"
    )
    rules = materialise(found.filter(~F.exists("antecedent", lambda t: t.startswith("label="))), "rules")
    shares = examples.groupBy("label").agg((F.count(F.lit(1)) / total).alias("parent"))
    shares = shares.select(F.array().cast("array<string>").alias("less"), F.col("label").alias("verdict"), "parent")
    parents = rules.select(F.col("antecedent").alias("less"), "verdict", F.col("confidence").alias("parent")).unionByName(shares)
    fewer = rules.select("*", F.explode("antecedent").alias("out")).withColumn("less", F.array_remove("antecedent", F.col("out")))
    beaten = fewer.join(parents, ["less", "verdict"]).filter(F.col("parent") >= F.col("confidence")).select("antecedent", "verdict").distinct()
    kept = rules.join(beaten, ["antecedent", "verdict"], "left_anti")
    told = kept.select("antecedent", "verdict", F.posexplode("antecedent").alias("at", "item")).join(items, "item").groupBy("antecedent", "verdict")
    told = told.agg(F.min(F.struct("n", "item"))["item"].alias("key"), F.sort_array(F.collect_list(F.struct("at", "alike")))["alike"].alias("alike"))
    return kept.join(told, ["antecedent", "verdict"]).select(
        F.array_join("antecedent", " ").alias("rule"), "key", "antecedent", F.lit("").alias("path"), "verdict", F.lit(False).alias("base"),
        "confidence", "support", "alike",
    )


def base_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = [(host + path, f"host:{host}", [f"host:{host}"], path, verdict, True, 1.0, 1.0) for host, path, verdict in rules]
    return spark.createDataFrame(rows, _RULES)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: host, path, base rule and verdict, and the mined
    rule that would decide.

    The index lists each rule under its rarest token, so a page meets a rule only where it has
    that token; the rest of the rule is checked then. Of the base rules that
    fit the longest wins; without one the surest mined rule decides, then the more frequent
    one, then the one of more tokens; without any, ``default``. Where rules have ``alike``, any
    token listed there serves for its place in the antecedent, and the rule is listed under each
    that serves for its key.

    A url of null, or without ``://``, has empty host and path, and fits no rule. Each repeated
    row is returned; a null page_id is kept; an empty table gives an empty result; other columns
    are not read.
    """
    host, path = url_parts(F.col("url"))
    read = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    tokens = F.when(F.col("url").contains("://"), url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    told = read.select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path", tokens.alias("tokens"))
    alone = F.transform("antecedent", lambda t: F.array(t))
    alike = F.coalesce(F.col("alike"), alone) if "alike" in rules.columns else alone
    keys = F.flatten(F.filter("serve", lambda tokens: F.array_contains(tokens, F.col("key"))))
    index = materialise(rules.withColumn("serve", alike).withColumn("key", F.explode(keys)), "index").select(
        "key", "serve", F.col("path").alias("prefix"), "base",
        F.struct(
            F.when(F.col("base"), F.length("rule")).otherwise(0).alias("length"), "confidence", "support",
            F.size("antecedent").alias("tokens"), "rule", "verdict",
        ).alias("choice"),
    )
    if index.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = told.select("*", F.posexplode_outer("tokens").alias("at", "key")).join(index, "key", "left")
    fits = F.coalesce(F.forall("serve", lambda t: F.arrays_overlap("tokens", t)) & F.col("path").startswith(F.col("prefix")), F.lit(False))
    best = met.filter(fits | (F.coalesce("at", F.lit(0)) == 0)).groupBy("row", "page_id", "host", "path").agg(
        F.max(F.when(fits & F.col("base"), F.col("choice"))).alias("set"), F.max(F.when(fits & ~F.col("base"), F.col("choice"))).alias("mined")
    )
    verdict = F.coalesce(F.col("set.verdict"), F.col("mined.verdict"), F.lit(default))
    return best.select("page_id", "host", "path", F.col("set.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.rule").alias("mined_rule"), F.col("mined.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> DataFrame:
    mined = mine_rules(labelled(pages, labels))
    return judge(pages, base_rules(pages.sparkSession, rules).unionByName(mined, allowMissingColumns=True))
