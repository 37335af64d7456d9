"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens raised to an exponent, normalised. The exponent is bisected: to the
least one (the flattest mixture) that keeps the most repeated source within a limit, or to the one whose mixture
has a target entropy. The budget is the least in which every document is seen once, or a given number of tokens.
The mixture is realised as blocks of equal budget: each source's documents are taken in a pseudo-random
permutation, one permutation per repetition, and cut by running token sums so that every block holds each source
in its weight, up to a document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.columns import unused
from cadenza.llm.prefix import running
from cadenza.llm.workspace import Workspace

#: Levels of the bisection that one aggregation decides (it evaluates all their midpoints).
LEVELS, PASSES = 4, 10


def word_tokens(text: str) -> Column:
    """Words parted by white space, plus one for the end of a document; a null text has the end only."""
    return (F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)) + 1).cast("long")


def bisect_exponent(sources: DataFrame, total: int, largest: int, repeats: float | None, entropy: float | None, budget: float | None) -> float:
    """The exponent in [0, 1] for ``sources(tokens)``.

    ``repeats``: the least exponent at which no source is repeated more often; ``entropy``: the one whose mixture
    has this entropy in nats (the nearest end if none has). Sources stay in Spark: a pass evaluates the 15
    midpoints of the next four levels of the bisection in one aggregation.
    """
    share = F.col("tokens") / F.lit(float(total))

    def measured(points: list[float]) -> list[float]:
        aggs = []
        for i, a in enumerate(points):
            w = F.pow(share, F.lit(a))
            aggs += [F.sum(w).alias(f"s{i}"), F.sum(w * F.log(w)).alias(f"e{i}"), F.max(w / F.col("tokens")).alias(f"r{i}")]
        row = sources.agg(*aggs).first()
        out = []
        for i, a in enumerate(points):
            s = row[f"s{i}"]
            if entropy is not None:
                out.append(math.log(s) - row[f"e{i}"] / s - entropy)
            else:
                spent = budget if budget is not None else largest * s / (largest / total) ** a
                out.append(row[f"r{i}"] / s * spent - repeats)
        return out

    lo, hi = 0.0, 1.0
    for _ in range(PASSES):
        n = 1 << LEVELS
        points = [lo + (hi - lo) * k / n for k in range(n + 1)]
        over = measured(points)
        # both measures fall as the exponent grows: lo stays above the target, hi at or below it
        if over[0] <= 0:
            return points[0]
        if over[-1] > 0:
            return points[-1]
        k = next(i for i, v in enumerate(over) if v <= 0)
        lo, hi = points[k - 1], points[k]
    return hi


def plan(units: DataFrame, ws: Workspace, repeats: float | None, entropy: float | None, budget: int | None) -> tuple[DataFrame, float, float]:
    """(source, tokens, weight, spend: tokens of the budget), the exponent and the budget, from ``units(source, n_tokens)``."""
    sources = ws.table("sources", units.groupBy("source").agg(F.sum("n_tokens").cast("long").alias("tokens")))
    known = sources.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("largest")).first()
    if not known.total:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("spend")), 1.0, 0.0
    a = bisect_exponent(sources, known.total, known.largest, repeats, entropy, budget)
    s = sources.agg(F.sum(F.pow(F.col("tokens") / F.lit(float(known.total)), F.lit(a)))).first()[0]
    spent = float(budget) if budget is not None else known.largest * s / (known.largest / known.total) ** a
    weight = F.pow(F.col("tokens") / F.lit(float(known.total)), F.lit(a)) / F.lit(s)
    spend = weight * F.lit(spent)
    if budget is None:
        spend = F.greatest(spend, F.col("tokens").cast("double"))  # rounding takes no document
    return ws.table("plan", sources.select("source", "tokens", weight.alias("weight"), spend.alias("spend"))), a, spent


def _taken(docs: DataFrame, ws: Workspace, repeats, entropy, budget, seed, doc_id, source, text, n_tokens) -> tuple[DataFrame, float]:
    """The units of the mixture (doc_id, source, n_tokens, epoch, order, progress, spend), and its budget.

    ``order`` is a unit's place in its source's permutation of that epoch.
    """
    if (repeats is None) == (entropy is None):
        raise ValueError("give repeats or entropy")
    units = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (n_tokens if n_tokens is not None else word_tokens(text)).cast("long").alias("n_tokens"))
    units = ws.table("units", units.groupBy("doc_id", "source").agg(F.sum("n_tokens").alias("n_tokens")))
    p, _, spent = plan(units, ws, repeats, entropy, budget)
    joined = units.join(p.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    copies = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("spend") / F.col("tokens") - 1e-9).cast("int") - 1, F.lit(0)))))
    keyed = copies.withColumn("_source", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).withColumn("order", _order(seed, F.col("doc_id"), F.col("source"), F.col("epoch")))
    cut, _ = running(keyed, ["_source", "epoch"], F.col("order"), F.col("n_tokens"), "before", max(1, units.count()), ws, "sums")
    progress = F.col("epoch") * F.col("tokens") + F.col("before")
    return cut.withColumn("progress", progress).where(F.col("progress") < F.col("spend") - 1e-6), spent


def _order(seed: int, doc_id: Column, source: Column, epoch: Column) -> Column:
    """A unit's place in the permutation of its source: equal units of one id and source have one place."""
    return F.xxhash64(F.lit(seed), doc_id, F.coalesce(source, F.lit("")), source, epoch.cast("int"))


def mix(docs: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, block_tokens: int = 1 << 20, seed: int = 1, doc_id: str = "doc_id", source: str = "source", text: str = "text", n_tokens: Column | None = None) -> DataFrame:
    """The mixture in order: doc_id, source, epoch (repetition from 0), block, position in the block, n_tokens.

    Exactly one of ``repeats`` and ``entropy`` is given. ``n_tokens`` is a column of token counts of at least 1; without
    it a document's tokens are its words and one. Without ``budget`` no document is left out. Rows of one id and source
    are one unit, taken together; a null id is an id like others. A null source is a source of its own; null and empty
    texts count one token; a text longer than a block is taken whole. Units of equal hash (ties of the permutation) stand
    in the order of id, source and epoch within a block. Other columns of any name are ignored. An empty table gives no
    rows.
    """
    ws = Workspace(docs.sparkSession, "mix")
    kept, spent = _taken(docs, ws, repeats, entropy, budget, seed, doc_id, source, text, n_tokens)
    blocks = max(1, round(spent / block_tokens))
    block = F.least(F.floor(F.col("progress") / F.col("spend") * blocks), F.lit(blocks - 1)).cast("long")
    placed = kept.withColumn("block", block)
    inside = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "source", "epoch"), "doc_id", "source", "epoch")
    return placed.withColumn("position", F.row_number().over(inside) - 1).select("doc_id", "source", "epoch", "block", "position", "n_tokens")


def copies_of(docs: DataFrame, repeats: float | None = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 1, doc_id: str = "doc_id", source: str = "source", text: str = "text", counted: DataFrame | None = None) -> DataFrame:
    """``docs`` with every row as often as the mixture takes it; columns as they were, whatever their names.

    ``counted(doc_id, source, n_tokens)`` has the token counts of at least 1 of every row; without it words are counted.
    A source's units are taken whole for some epochs and, in the last one, up to a place of its permutation. So a row per
    source (epochs, place) tells every document its copies, and texts are joined with that small table only.
    """
    ws = Workspace(docs.sparkSession, "copies")
    if counted is None:
        kept, _ = _taken(docs, ws, repeats, entropy, budget, seed, doc_id, source, text, None)
    else:
        kept, _ = _taken(counted, ws, repeats, entropy, budget, seed, "doc_id", "source", "", F.col("n_tokens"))
    of, whole, cut, n = unused(docs, "source_of_mixture", "whole_epochs", "last_place", "copies")
    ends = kept.groupBy("source").agg(F.max(F.struct("epoch", "order")).alias("end"))
    ends = ws.table("ends", ends.select(F.col("source").alias(of), F.col("end.epoch").alias(whole), F.col("end.order").alias(cut)))
    joined = docs.join(ends, F.col(source).eqNullSafe(F.col(of)))
    last = (_order(seed, F.col(doc_id), F.col(source), F.col(whole)) <= F.col(cut)).cast("int")
    counted = joined.withColumn(n, F.col(whole) + last).where(F.col(n) > 0)
    return counted.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*(f"`{c}`" for c in docs.columns))
