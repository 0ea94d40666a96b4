"""Mixing to target weights: iterative proportional fitting over source, language and topic, in DataFrame functions only."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, whole_rows

DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-4
#: A cycle that leaves more than this share of the worst difference from a target makes no progress: the targets contradict each other.
STALLED = 0.999
#: Target shares are the natural ones to this power, made to sum to 1: large groups give way to small ones.
TEMPER = 0.7
#: Share of all tokens that the sample should have.
BUDGET = 0.9
#: Rows up to which cells and marginals are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
_NONE = "(none)"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def topic_of(text: Column, n_tokens: Column) -> Column:
    """A coarse topic from the text's form: empty, tables, listings (many short lines), notes (under 100 words) or prose."""
    t = F.coalesce(text, F.lit(""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    lines = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1
    return F.when(n_tokens == 0, "empty").when(bars * 20 >= n_tokens, "table").when(lines * 6 >= n_tokens, "listing").when(n_tokens < 100, "note").otherwise("prose")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def natural_targets(cells: DataFrame, temper: float = TEMPER) -> dict[str, DataFrame]:
    """Per dimension a table (value, target) of tempered natural token shares."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("x"))
        total = sums.agg(F.sum("x")).first()[0] or 1.0
        out[d] = sums.select("value", (F.col("x") / total).alias("target"))
    return out


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with `weight`: token shares fitted to the target marginals in turn.

    cells is materialised by the caller. Values without a target keep their share; targets without tokens have no effect. Ends
    when every marginal is within tolerance of its target; there is no bound on the cycles. Where a cycle brings the worst
    difference no further down, no weights meet all targets: that is warned of, and the weights are those of the last cycle.
    Cells are as many as there are combinations of values, so the loop's cost does not follow the number of documents.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for d in DIMENSIONS:
        t = targets[d].select(F.col("value").alias(d), F.col("target").alias(f"target_{d}"))
        state = state.join(_small(t, t.count()), d, "left")
    state = materialise(state, "cells")
    rows, last = state.count(), None
    while True:
        off, before = F.lit(0.0), state
        for d in DIMENSIONS:
            sums = state.groupBy(d).agg(F.sum("weight").alias("_sum"))
            state = state.join(_small(sums, rows), d)
            ratio = F.when(F.col("_sum") > 0, F.coalesce(F.col(f"target_{d}") / F.col("_sum"), F.lit(1.0))).otherwise(1.0)
            off = F.greatest(off, F.abs(F.col(f"target_{d}") - F.col("_sum")))
            state = state.select(*[c for c in state.columns if c not in ("_sum", "weight", "_off")], (F.col("weight") * ratio).alias("weight"), off.alias("_off"))
            off = F.coalesce(F.col("_off"), F.lit(0.0))
        state = materialise(state.coalesce(max(1, rows // 100_000)), "cells")
        discard(before)
        worst = state.agg(F.max("_off")).first()[0]
        state = state.drop("_off")
        if worst is None or worst <= tolerance:
            break
        if last is not None and worst > STALLED * last:
            warnings.warn(f"no weights meet all targets: one is missed by {worst:.4g}", stacklevel=2)
            break
        last = worst
    norm = state.agg(F.sum("weight")).first()[0] or 1.0
    return state.select(*DIMENSIONS, "tokens", (F.col("weight") / norm).alias("weight"))


def probabilities(cells: DataFrame, budget: float = BUDGET, max_steps: int = 50) -> DataFrame:
    """cells with `rate` (wanted copies of each document) and `probability` = min(1, rate).

    rate = c * weight / natural share, with c such that the expected tokens are the budget's share of all: cells at
    probability 1 give their excess to the others. Each step is one sum over the cells.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor = F.when(F.col("tokens") > 0, F.col("weight") * total / F.col("tokens")).otherwise(1.0)
    c = min(max(budget, 0.0), 1.0)
    want = c * total
    for _ in range(max_steps):
        full = factor * c >= 1
        s = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(factor * F.col("tokens"))).alias("rest")).first()
        if not s["rest"] or s["rest"] <= 0:
            break
        new = (want - float(s["full"])) / s["rest"]
        if new <= c * (1 + 1e-9):
            break
        c = new
    return cells.withColumn("rate", factor * c).withColumn("probability", F.least(F.lit(1.0), F.col("rate")))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the id (for a null id: the text) and seed."""
    h = F.when(doc_id.isNull(), F.xxhash64(text, F.lit(seed))).otherwise(F.xxhash64(doc_id, F.lit(seed)))
    return F.shiftrightunsigned(h, 11).cast("double") / float(2**53)


def plan_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(one row per document: row (all its columns), source, lang, topic, n_tokens and u; cells with docs and probabilities)."""
    marked = docs.select(whole_rows(docs), "text", "doc_id", "source", "lang", token_count(F.col("text")).alias("n_tokens"))
    marked = marked.select(
        "row", F.coalesce("source", F.lit(_NONE)).alias("source"), F.coalesce("lang", F.lit(_NONE)).alias("lang"), topic_of(F.col("text"), F.col("n_tokens")).alias("topic"),
        "n_tokens", uniform(F.col("doc_id"), F.col("text"), seed).alias("u"),
    )
    cells = materialise(marked.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "cells")
    raked = rake(cells.drop("docs"), targets or natural_targets(cells))
    raked = raked.join(_small(cells.drop("tokens"), cells.count()), list(DIMENSIONS))
    out = materialise(probabilities(raked, budget), "cells")
    discard(cells)
    return marked, out


def copies_of(rate: Column, n_tokens: Column, u: Column) -> Column:
    """How often a document is in the sample: its rate, rounded up or down by u, so that the expected number is the rate.

    Texts without tokens add nothing to any share and come once at most.
    """
    copies = F.floor(rate) + (u < rate - F.floor(rate)).cast("bigint")
    return F.when(n_tokens > 0, copies).otherwise(F.least(copies, F.lit(1).cast("bigint")))


def _with_rates(marked: DataFrame, cells: DataFrame) -> DataFrame:
    return marked.join(_small(cells.select(*DIMENSIONS, "rate", "probability"), cells.count()), list(DIMENSIONS))


def mix_weights(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 7) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, rate, probability, kept, copies.

    copies realises rate, also above 1: weighted by it, token shares meet the targets in expectation. kept is copies > 0; on its
    own it cannot raise a cell beyond its natural tokens, so that shares of the kept rows stay near the natural ones where one
    group dominates.

    A null source or language is the value "(none)" with a share of its own; null and empty texts have topic "empty" and no
    tokens, and are kept with probability min(1, rate). Rows with equal ids are kept or dropped together. An empty table gives
    no rows; other columns are not read.
    """
    marked, cells = plan_mix(docs.select("doc_id", "text", "source", "lang"), targets, budget, seed)
    kept, copies = (F.col("u") < F.col("probability")).alias("kept"), copies_of(F.col("rate"), F.col("n_tokens"), F.col("u")).alias("copies")
    return _with_rates(marked, cells).select("row.doc_id", *DIMENSIONS, "n_tokens", "rate", "probability", kept, copies)


_ROWS = """A null source or language is the value "(none)" with a share of its own; null and empty texts have no tokens, add to no
    share and come once at most. Rows are drawn by their id (without one: by their text), so that equal ones fare alike. An
    empty table gives no rows. Columns of any other name pass through."""


def sample_mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 7) -> DataFrame:
    marked, cells = plan_mix(docs, targets, budget, seed)
    return _with_rates(marked, cells).where("u < probability").select("row.*")


sample_mix.__doc__ = f"""The sampled rows of docs, each once, all columns.

    {_ROWS}
    """


def sample_copies(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float = BUDGET, seed: int = 7) -> DataFrame:
    marked, cells = plan_mix(docs, targets, seed=seed)
    s = cells.agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("rate")).alias("wanted")).first()
    scale = share * s["docs"] / s["wanted"] if s["wanted"] else 0.0
    copies = copies_of(F.col("rate") * F.lit(scale), F.col("n_tokens"), F.col("u")).cast("int").alias("copies")
    rows = _with_rates(marked, cells).select("row", copies).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


sample_copies.__doc__ = f"""The rows of docs to the raked weights, all columns: rows wanted more than once come in copies, so that the targets are met.

    The expected number of rows is `share` of those of docs. {_ROWS}
    """
