"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. A cell's weight is its share of all tokens;
raking scales the weights in turn until every margin is within ``TOLERANCE`` of its targets, which leaves
the associations within the corpus as they are. A document is then kept with probability
``keep * fitted share / present share`` of its cell, by a hash of its own id and text. ``keep`` is the
largest factor with which no cell needs more than it has, so no probability is cut off, nothing is
repeated, and the sample meets all targets at once, as well as the draw lets it.

Cells are counted over the whole corpus before anything is joined, so a hot source reaches the fit as
one row per language and topic, and the rounds shuffle cell tables only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesight.plans.shared import stored

#: Where no targets are given, values aim at shares in proportion to their tokens to this power, which tempers large ones.
TEMPER = 0.9
#: Languages that have cells of their own; all others are ``other``.
LANGUAGES = ("en", "de", "fr", "es")
#: Topics in order, each the first whose pattern the text holds; the rest is ``general``.
TOPICS = (
    ("legal", "[Ll]icen[sc]e|[Cc]opyright|[Ww]arranty"), ("contact", "[a-z0-9]@[a-z]"), ("web", "https?://|www[.]"),
    ("code", "[{};]{2}|</?[a-z]+>|[a-z]_[a-z]+[(=]"), ("numeric", "[0-9]{4}"), ("question", "[?]"),
)
#: Largest margin error at the end, rounds between looks at it, and rounds at most.
TOLERANCE, LOOK, ROUNDS = 1e-8, 4, 64
CELL = ("source_cell", "lang_cell", "topic_cell")


def topic(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """The first topic whose pattern a text holds, else ``general``; a null text is ``general``."""
    found = F.lit("general")
    for name, pattern in reversed(topics):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def cell(languages: Sequence[str] = LANGUAGES, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    """Struct of the cell columns, tokens and draw of a document row (doc_id, text, lang, source).

    A null source is ``unknown``, a null language ``other``. Tokens are a fourth of the code points,
    rounded up, at least 1. The draw, from 0 to 1, depends on id and text, so equal rows share it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    draw = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return F.struct(
        F.coalesce(F.col("source"), F.lit("unknown")).alias("source_cell"),
        F.when(F.col("lang").isin(*languages), F.col("lang")).otherwise("other").alias("lang_cell"),
        topic(text, topics).alias("topic_cell"),
        F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long").alias("tokens"),
        draw.alias("draw"),
    )


Targets = Mapping[str, Mapping[str, float]]


def raked(cells: DataFrame, targets: Targets | None = None, temper: float = TEMPER) -> DataFrame:
    """``cells`` (cell columns, tokens) with ``present`` and ``fitted`` shares, raked until the margins fit.

    ``targets`` names the wanted shares of values of a cell column and must cover those that occur; those of
    other values are left out and the rest scaled to one. A column without targets aims at tempered shares.
    Targets that contradict each other, as where two values occur only together and aim at different shares,
    leave the last round's compromise; ``margins`` shows how far off it is. No cells give no rows.
    """
    targets = targets or {}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    state = cells.withColumn("present", F.col("tokens") / F.lit(total)).withColumn("fitted", F.col("present"))
    for column in CELL:
        margin = cells.groupBy(column).agg((F.sum("tokens") / F.lit(total)).alias("share"))
        goal = F.pow("share", F.lit(temper))
        if column in targets:
            there = {r[0] for r in margin.select(column).collect()}  # as many as there are targets, or an error
            if there - set(targets[column]):
                raise ValueError(f"no target share for {sorted(there - set(targets[column]))} of {column}")
            goal = F.element_at(F.create_map(*[F.lit(x) for k, v in targets[column].items() for x in (k, float(v))]), F.col(column))
        goals = margin.select(column, goal.alias(f"goal_{column}"))
        whole = goals.agg(F.sum(f"goal_{column}")).first()[0] or 1.0
        state = state.join(goals.withColumn(f"goal_{column}", F.col(f"goal_{column}") / F.lit(whole)), column)
    state = stored(state, "cells")
    for turn in range(1, ROUNDS + 1):
        for column in CELL:
            share = F.sum("fitted").over(Window.partitionBy(column))
            state = state.withColumn("fitted", F.when(share > 0, F.col("fitted") * (F.col(f"goal_{column}") / share)).otherwise(0.0))
        if turn % LOOK == 0:
            state = stored(state, "cells")
            gaps = [state.groupBy(c).agg(F.abs(F.sum("fitted") - F.first(f"goal_{c}")).alias("gap")).select("gap") for c in CELL]
            worst = gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.max("gap")).first()[0] or 0.0
            if worst <= TOLERANCE:
                break
    return state.select(*CELL, "tokens", "present", "fitted")


def _chances(cells: DataFrame, targets: Targets | None, odds: str) -> DataFrame:
    """Of ``cells`` (cell columns, tokens; counted): ``at``, a struct of the cell columns, and the probability that keeps its documents."""
    fitted = raked(stored(cells, "cells"), targets).where("fitted > 0")
    keep = float(fitted.agg(F.min(F.col("present") / F.col("fitted"))).first()[0] or 1.0)
    chance = F.round(F.least(F.lit(1.0), F.lit(keep) * F.col("fitted") / F.col("present")), 9)
    return fitted.select(F.struct(*CELL).alias("at"), chance.alias(odds))


def _counted(rows: DataFrame, mark: str) -> DataFrame:
    return rows.groupBy(*[F.col(f"{mark}.{x}").alias(x) for x in CELL]).agg(F.sum(f"{mark}.tokens").alias("tokens"))


def _with_odds(rows: DataFrame, mark: str, named: DataFrame, odds: str) -> DataFrame:
    joined = rows.join(named, F.struct(*[F.col(f"{mark}.{x}").alias(x) for x in CELL]) == F.col("at"), "left").drop("at")
    return joined.withColumn(odds, F.coalesce(F.col(odds), F.lit(0.0)))


def mixture(docs: DataFrame, languages: Sequence[str] = LANGUAGES, topics: Sequence[tuple[str, str]] = TOPICS, targets: Targets | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic (of its cell), tokens, probability and whether it is kept.

    Repeated rows are kept or left together. Columns other than doc_id, text, lang and source are not read.
    """
    # texts are read once: what is kept of a document is narrow
    rows = stored(docs.select("doc_id", cell(languages, topics).alias("of")), "document-cells")
    named = _chances(_counted(rows, "of"), targets, "odds")
    of = F.col("of")
    return _with_odds(rows, "of", named, "odds").select(
        "doc_id", of["source_cell"].alias("source"), of["lang_cell"].alias("lang"), of["topic_cell"].alias("topic"),
        of["tokens"].alias("tokens"), F.round("odds", 6).alias("probability"), (of["draw"] < F.col("odds")).alias("kept"),
    )


def sample_mixture(docs: DataFrame, languages: Sequence[str] = LANGUAGES, topics: Sequence[tuple[str, str]] = TOPICS, targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs`` that the draw keeps, with their columns as they are."""
    mark, odds = (next(n for i in range(len(docs.columns) + 1) if (n := f"{base}_{i}") not in docs.columns) for base in ("cell", "odds"))
    named = _chances(_counted(docs.select(cell(languages, topics).alias(mark)), mark), targets, odds)
    marked = _with_odds(docs.withColumn(mark, cell(languages, topics)), mark, named, odds)
    return marked.where(F.col(mark)["draw"] < F.col(odds)).select(*[F.col(f"`{c}`") for c in docs.columns])


def margins(mixed: DataFrame, temper: float = TEMPER) -> DataFrame:
    """Of the rows of ``mixture``: margin, value, target share, and ``kept``, the share of the kept tokens; targets tempered."""
    tokens, kept = F.sum("tokens"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0))
    parts = [mixed.groupBy(c).agg(tokens.alias("all"), kept.alias("some")).select(F.lit(c).alias("margin"), F.col(c).alias("value"), "all", "some") for c in ("source", "lang", "topic")]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    of = Window.partitionBy("margin")
    share = F.pow(F.col("all") / F.sum("all").over(of), F.lit(temper))
    shared = every.withColumn("goal", share)
    return shared.select("margin", "value", (F.col("goal") / F.sum("goal").over(of)).alias("target"), (F.col("some") / F.sum("some").over(of)).alias("kept"))


def oracle(rounds: int = 24) -> str:
    """DuckDB SQL for ``mixture`` of ``documents`` with the settings above; ``rounds`` are enough for six digits."""
    topics = " ".join(f"when regexp_matches(body, '{p}') then '{n}'" for n, p in TOPICS)
    steps, last = [], "goals"
    for turn in range(rounds):
        for column in CELL:
            name = f"fit_{turn}_{column}"
            steps.append(
                f"{name} as materialized (select * replace (fitted * (goal_{column} / sum(fitted) over (partition by {column})) as fitted) from {last})"
            )
            last = name
    powers = ",\n        ".join(
        f"goal_of_{c} as (select {c}, pow(sum(present), {TEMPER}) / sum(pow(sum(present), {TEMPER})) over () as goal_{c} from shares group by 1)" for c in CELL
    )
    return f"""
        with bodies as (select doc_id, lang, source, coalesce(text, '') as body from documents),
        marked as materialized (
            select doc_id, coalesce(source, 'unknown') as source_cell,
                   case when lang in ({", ".join(f"'{k}'" for k in LANGUAGES)}) then lang else 'other' end as lang_cell,
                   case {topics} else 'general' end as topic_cell,
                   greatest(1, cast(ceil(length(body) / 4) as bigint)) as tokens,
                   cast(cast('0x' || substr(sha256(coalesce(cast(doc_id as varchar), '') || ':' || body), 1, 12) as bigint) as double) / {float(1 << 48)} as draw
            from bodies),
        cells as materialized (select source_cell, lang_cell, topic_cell, sum(tokens) as tokens from marked group by all),
        shares as materialized (select *, tokens / sum(tokens) over () as present from cells),
        {powers},
        goals as materialized (
            select *, present as fitted from shares join goal_of_source_cell using (source_cell)
            join goal_of_lang_cell using (lang_cell) join goal_of_topic_cell using (topic_cell)),
        {", ".join(steps)},
        odds as (select source_cell, lang_cell, topic_cell,
                        round(least(1.0, (select min(present / fitted) from {last}) * fitted / present), 9) as chance from {last})
        select doc_id, source_cell as source, lang_cell as lang, topic_cell as topic, tokens,
               round(chance, 6) as probability, draw < chance as kept
        from marked join odds using (source_cell, lang_cell, topic_cell)"""
