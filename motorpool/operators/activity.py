"""Workflows, notes, chat sessions and cards made from operational tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorpool import values
from motorpool.functions.scalars import case_map, ellipsis, headline_words, parse_steps
from motorpool.operators.filters import filter_since
from motorpool.operators.joins import top_n_per_key
from motorpool.schemas import STEPS
from motorpool.sources.tables import union_all


TITLE_WIDTH = 100


def default_chain() -> Column:
    """The steps told by the workflow's own columns; the last only when it names an entity type."""
    kind = F.coalesce("entity_type", F.lit(""))
    outputs = [
        F.coalesce("trigger_source", F.lit("monitor")),
        F.left(F.coalesce("summary", F.lit("")), F.lit(100)),
        F.coalesce("entity_id", F.lit("")),
    ]
    names = [F.lit(""), F.lit(""), kind]
    steps = F.array(
        *[
            F.struct(
                F.lit(i).alias("step"),
                F.lit(tool).alias("tool"),
                F.concat(F.lit(label), name).alias("label"),
                output.alias("output"),
                F.lit("completed").alias("status"),
            )
            for i, ((tool, label), name, output) in enumerate(zip(values.CHAIN_STEPS, names, outputs), start=1)
        ]
    ).cast(STEPS)
    return F.slice(steps, F.lit(1), F.when(kind != "", 3).otherwise(2))


def enrich_workflows(df: DataFrame, headlines: Mapping[str, str] = values.WORKFLOW_HEADLINES) -> DataFrame:
    """Fill headline and summary where empty, and parse the reasoning chain or build one."""
    entity = F.btrim(F.concat_ws(" ", F.coalesce("entity_type", F.lit("")), F.coalesce("entity_id", F.lit(""))))
    prepared = df.withColumns({"__entity": F.nullif(entity, F.lit("")), "__chain": parse_steps("reasoning_chain")})
    lead = case_map("workflow_type", headlines)
    words = headline_words("workflow_type")
    built = F.coalesce(
        F.concat(lead, F.coalesce("__entity", F.lit(values.HEADLINE_FALLBACK_ENTITY))),
        F.concat(words, F.lit(": "), "__entity"),
        words,
    )
    return prepared.withColumns(
        {
            "headline": F.coalesce(F.nullif("headline", F.lit("")), built),
            "enriched_summary": F.coalesce(F.nullif("enriched_summary", F.lit("")), F.col("summary")),
            "reasoning_chain": F.when(F.size("__chain") > 0, F.col("__chain")).otherwise(default_chain()),
        }
    ).drop("__entity", "__chain")


def entity_notes(notes: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    """Notes of one entity, newest first."""
    mine = (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)
    return notes.filter(mine).orderBy(F.col("created_at").desc(), F.col("note_id").desc())


@dataclass(frozen=True)
class CardSource:
    """How the rows of one table become cards; ``title`` is a lead text and a column."""

    table: str
    card_type: str
    id_col: str
    title: tuple[str, str]
    details: Mapping[str, str] = field(default_factory=dict)


def recent_cards(tables: Mapping[str, DataFrame], sources: Sequence[CardSource], as_of, minutes: int = 3, n: int = 3) -> DataFrame:
    """The newest ``n`` rows of each table within the lookback, as cards."""
    cards = []
    for s in sources:
        fresh = filter_since(tables[s.table], "created_at", as_of, minutes=minutes)
        newest = fresh.orderBy(F.col("created_at").desc(), F.col(s.id_col).desc()).limit(n)
        pairs = [
            part
            for shown, name in s.details.items()
            for part in (F.lit(shown), F.coalesce(F.col(name).cast("string"), F.lit("")))
        ]
        lead, column = s.title
        cards.append(
            newest.select(
                F.lit(s.card_type).alias("card_type"),
                F.col(s.id_col).cast("string").alias("entity_id"),
                F.concat(F.lit(lead), F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("title"),
                F.create_map(*pairs).alias("details"),
            )
        )
    return union_all(*cards)


def supply_workflows(df: DataFrame, width: int = 80) -> DataFrame:
    """Supply-chain workflows with a headline by type, with and without an entity, or else the
    start of the summary; the reasoning chain is parsed, and empty where it is no list."""
    entity = F.nullif("entity_id", F.lit(""))
    headline = F.left(F.coalesce("summary", F.lit("")), F.lit(width))
    for kind, (named, bare) in values.SUPPLY_HEADLINES.items():
        headline = F.when(F.col("workflow_type") == kind, F.coalesce(F.concat(F.lit(named), entity), F.lit(bare))).otherwise(headline)
    chain = F.coalesce(parse_steps("reasoning_chain"), F.array().cast(STEPS))
    return df.withColumns({"headline": headline, "reasoning_chain": chain})


def session_index(messages: DataFrame, session: str, order: str, role: str, content: str, n: int | None = None) -> DataFrame:
    """Per session its title, from the first user text, and its last activity; with ``n``, the
    newest sessions in order."""
    # One character past the cut is enough to tell whether the title was cut.
    start = F.left(F.col(content), F.lit(TITLE_WIDTH + 1))
    first = F.min_by(start, F.when(F.col(role) == "user", F.col(order)))
    index = messages.groupBy(session).agg(
        first.alias("__first"), F.max(order).alias("last_activity"), F.count(F.lit(1)).alias("messages")
    )
    titled = index.select(
        session,
        F.coalesce(ellipsis("__first", TITLE_WIDTH), F.lit(values.NEW_SESSION_TITLE)).alias("title"),
        "last_activity",
        "messages",
    )
    if n is None:
        return titled
    return titled.orderBy(F.col("last_activity").desc(), F.col(session)).limit(n)


def session_history(messages: DataFrame, session: str, order: str, wanted=None) -> DataFrame:
    """Messages in order, of one session or of all."""
    if wanted is not None:
        messages = messages.filter(F.col(session) == F.lit(wanted))
    return messages.orderBy(session, order)


def context_window(messages: DataFrame, session: str, order: str, n: int = 10) -> DataFrame:
    """The last ``n`` messages of every session."""
    return top_n_per_key(messages, session, [F.col(order).desc()], n, "age")


def followups_by_keyword(df: DataFrame, key: str, tool: str, rules=values.FOLLOWUPS, n: int = 3) -> DataFrame:
    """Suggestions for the tools each key has used: one per rule with a keyword in a tool name."""
    name = F.lower(F.col(tool))

    def mentions(words):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        return hit

    used = df.groupBy(key).agg(
        *[F.coalesce(F.bool_or(mentions(words)), F.lit(False)).alias(f"__r{i}") for i, (words, _, _) in enumerate(rules)]
    )
    offers = F.array(
        *[
            F.when(F.col(f"__r{i}"), F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(prompt).alias("prompt")))
            for i, (_, label, prompt) in enumerate(rules)
        ]
    )
    kept = F.slice(F.array_compact(offers), 1, n)
    return used.select(key, F.posexplode(kept).alias("position", "offer")).select(
        key, "position", "offer.label", "offer.prompt"
    )
