"""Mixing sources to target weights by balanced (cube-method) sampling.

A source's target divided by its size is the number of times its documents are read; the fraction of it is an inclusion
probability. The flight phase moves these probabilities through the null space of two constraints, words and documents, so
that both totals of a source stay what they were while ever more probabilities reach 0 or 1. It runs in blocks of bounded
size, keyed by source and a hash: at most two units a block stay fractional and go on to the next level, whose blocks are
fewer by three orders of magnitude. Over a source's last block the flight stops at ten units, and the landing settles these.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passages.llm.common import WORD, ship, small, written

#: Units in a block of the flight phase: what one task holds at a time.
BLOCK = 4096
#: Units of a source that the flight leaves to the landing, which looks at every choice among them.
LANDING = 10
_EPS = 1e-9


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """Adds weight and target to rows (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. Targets share the sum of all sizes by weight; none exceeds
    cap times its source's size, the excess being shared by weight among the others. Sources fill up in the order of
    cap * size / weight, so a running sum over that order finds the level at which the rest is shared. All sources meet in one task for it, each as
    two numbers: one task sorts millions of them with spilling.
    """
    everything = Window.partitionBy()
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    rows = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
    rows = rows.withColumn("limit", cap * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    rows = rows.withColumn("share", F.min_by(F.when(~F.col("full"), F.col("level")), F.when(~F.col("full"), F.col("limit") / F.col("weight"))).over(everything))
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("share") * F.col("weight")))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _move(p: np.ndarray, direction: np.ndarray, draw: float) -> np.ndarray:
    """Moves p along the direction to a face of the cube, forward or backward so that its expectation is kept."""
    up, down = direction > 0, direction < 0
    rise, fall = (1 - p[up]) / direction[up], p[down] / -direction[down]
    ahead = min(rise.min(initial=math.inf), fall.min(initial=math.inf))
    back = min((p[up] / direction[up]).min(initial=math.inf), ((1 - p[down]) / -direction[down]).min(initial=math.inf))
    p = p + (ahead if draw * (ahead + back) < back else -back) * direction
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    return p


def _direction(sizes: np.ndarray) -> np.ndarray:
    """The first unit's axis projected on the null space of the two constraints, words and documents."""
    x = sizes - sizes.mean()
    spread = float(x @ x)
    out = np.full(len(x), -1.0 / len(x)) - (x * (x[0] / spread) if spread > 0 else 0.0)
    out[0] += 1.0
    out[np.abs(out) < 1e-12] = 0.0
    return out


def flight(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator, leave: int = 2, window: int = 64) -> np.ndarray:
    """Probabilities after the flight: sums of p and of size * p unchanged, at most `leave` (2 or more) still fractional.

    Sizes come in descending order. Each step turns to the longest text that is still open and moves it against a window of
    others, so that what stays open at the end is short.
    """
    p = p.astype(float).copy()
    inside = (p > _EPS) & (p < 1 - _EPS)
    p[~inside] = np.round(p[~inside])
    waiting = list(np.flatnonzero(inside)[::-1])
    active = np.array([], dtype=int)
    while True:
        fresh = [waiting.pop() for _ in range(min(window - len(active), len(waiting)))]
        active = np.append(active, np.array(fresh, dtype=int))
        if len(active) <= leave:
            return p
        turn = active
        direction = _direction(sizes[turn])
        while not direction.any():  # the first text alone cannot move: turn to the next
            turn = np.roll(turn, -1)
            direction = _direction(sizes[turn])
        p[turn] = _move(p[turn], direction, rng.random())
        active = active[(p[active] > 0) & (p[active] < 1)]


def landing(sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Settles the at most LANDING units that a flight over a source left: the whole choice with the least error in words, then in documents."""
    p = p.copy()
    rest = np.flatnonzero((p > 0) & (p < 1))
    choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
    words = np.abs(choices @ sizes[rest] - p[rest] @ sizes[rest]).round(6)
    documents = np.abs(choices.sum(axis=1) - p[rest].sum()).round(6)
    p[rest] = choices[np.lexsort((documents, words))[0]]
    return p


def _fly(units: DataFrame, blocks: Column, seed: int, level: int, last: bool) -> DataFrame:
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng(int(pdf["seed"].iloc[0]) & (2**63 - 1))
        sizes = pdf["size"].to_numpy().astype(float)
        p = flight(sizes, pdf["p"].to_numpy(), rng, LANDING if last else 2)
        pdf["p"] = landing(sizes, p) if last else p
        return pdf.drop(columns=["block", "seed"])

    schema = units.schema
    keyed = units.withColumn("block", F.pmod(F.xxhash64("draw", F.lit(level)), blocks))
    keyed = keyed.withColumn("seed", F.xxhash64("source", "block", F.lit(seed), F.lit(level)))
    return keyed.groupBy("source", "block").applyInPandas(block, schema)


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 17) -> DataFrame:
    """Rows (id, source, size, source_size, target, taken), one per input row, repeated ids included.

    size is the number of words, 0 for null texts; taken is size times the number of times the mix reads the document, at
    most cap (a whole number). Null sources form a source of their own. The same rows and seed give the same mix, however
    they are partitioned. A hot source only has more blocks: no task sees more than a block of it.
    """
    ship(docs.sparkSession)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size")), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    totals = written(totals, "totals")
    goal = targets(totals.select("source", "source_size"), weights, cap).join(totals.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    goal = written(goal.withColumn("ratio", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    key = [F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key")]
    units = sizes.select("*", *key).join(small(goal.select(*key, "source_size", "target", "n_docs", "ratio")), ["no_source", "source_key"])
    whole = F.floor(F.col("ratio") + _EPS)
    units = units.select("id", "source", "size", "source_size", "target", "n_docs", whole.cast("long").alias("whole"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("p"), F.xxhash64(F.lit(seed), "id", "size").alias("draw"))
    fractional = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    done = units.where(~fractional)
    left, most, level = units.where(fractional), goal.agg(F.max("n_docs")).first()[0] or 0, 0
    per_source = F.col("n_docs")
    while True:
        last = most <= BLOCK
        blocks = F.ceil(per_source / BLOCK).cast("long")
        out = written(_fly(left, F.greatest(blocks, F.lit(1)), seed, level, last), f"flight-{level}")
        done = done.unionByName(out.where(~fractional))
        if last:
            break
        left, per_source, most, level = out.where(fractional), 2 * blocks, 2 * math.ceil(most / BLOCK), level + 1
    taken = ((F.col("whole") + F.round("p").cast("long")) * F.col("size")).alias("taken")
    return done.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", taken)
