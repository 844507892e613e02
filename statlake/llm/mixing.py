"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statlake.llm.common import fresh, materialize, word_count

#: Production limit: no source is repeated more often than this (the largest is used once).
MAX_REPEATS = 2.0
#: Documents in one block of a permutation, about; halvings of the exponent's interval in one job, and jobs.
BLOCK_DOCS, HALVINGS, JOBS = 512, 5, 5
SEED = 20


def _label(source: Column) -> Column:
    """A source's key: its name, with a null source as one of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def _order(pass_no: Column, doc_id: Column) -> Column:
    """A document's place in a pass's permutation, from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), pass_no.cast("long"), doc_id), 11) / F.lit(float(1 << 53))


def token_table(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mix_key, n_tokens) of every row; tokens are words."""
    return docs.select("doc_id", "source", _label(F.col("source")).alias("mix_key"), word_count("text").alias("n_tokens"))


def _sources(tokens: DataFrame) -> DataFrame:
    """(mix_key, tokens, docs, share): share of all tokens; a source without tokens counts as one token."""
    own = tokens.groupBy("mix_key").agg(F.greatest(F.sum("n_tokens"), F.lit(1)).cast("double").alias("tokens"),
                                        F.count(F.lit(1)).alias("docs"))
    own = materialize(own, "mix-sources")
    total = own.agg(F.sum("tokens")).first()[0]
    return own.withColumn("share", F.col("tokens") / F.lit(float(total or 1.0)))


def _at_exponents(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy (nats) of the weights and largest repetition over the smallest, for each exponent: one small job."""
    at = F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")
    rows = (sources.select("share", at)
            .select("a", F.pow("share", F.col("a")).alias("p"), F.log("share").alias("log_share"),
                    F.pow("share", F.col("a") - 1).alias("use"))
            .groupBy("a").agg(F.sum("p").alias("z"), F.sum(F.col("p") * F.col("log_share")).alias("l"),
                              F.max("use").alias("most"), F.min("use").alias("least")).collect())
    return {r.a: (math.log(r.z) - r.a * r.l / r.z, r.most / r.least) for r in rows}


def bisect_exponent(sources: DataFrame, max_repeats: float | None, target_entropy: float | None) -> float:
    """The exponent in [0, 1] nearest to 0 whose repetition is within ``max_repeats``, or whose entropy is ``target_entropy``.

    Both fall as the exponent rises. With both given the larger exponent
    holds (the repetition limit is never passed). Each job evaluates all
    midpoints of the next halvings, so the interval is cut by bisection with a
    few jobs over one row a source.
    """
    def search(met) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(JOBS):
            step = (hi - lo) / 2 ** HALVINGS
            seen = _at_exponents(sources, [lo + i * step for i in range(2 ** HALVINGS + 1)])
            points = sorted(seen)
            if not points or met(seen[points[0]]):
                return lo
            a, b = 0, len(points) - 1
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if met(seen[points[mid]]) else (mid, b)
            lo, hi = points[a], points[b]
        return hi

    limits = []
    if max_repeats is not None:
        limits.append(search(lambda x: x[1] <= max_repeats * (1 + 1e-12)))
    if target_entropy is not None:
        limits.append(search(lambda x: x[0] <= target_entropy))
    return max(limits, default=1.0)


def mixing_plan(tokens: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
                budget_tokens: float | None = None) -> DataFrame:
    """(mix_key, weight, quota, full, last_pass, cut, blocks) per source.

    weight: normalised share ** exponent. quota: tokens to draw, the weight of
    the budget (by default the least budget that uses every source whole).
    ``full`` passes take every document, pass ``last_pass`` those whose place
    in its permutation is at most ``cut`` (-1: none): the shortest prefix that
    meets the quota, found from sums of blocks and then inside one block, so
    no source is sorted as a whole.
    """
    sources = _sources(tokens)
    exponent = bisect_exponent(sources, max_repeats, target_entropy)
    p = F.pow("share", F.lit(exponent))
    z, scarce, every = sources.agg(F.sum(p), F.max(F.col("share") / p), F.sum("tokens")).first()
    if budget_tokens is None:
        budget_tokens = (every or 0.0) * (scarce or 0.0) * (z or 0.0)
    weight = p / F.lit(float(z or 1.0))
    per = sources.select("mix_key", "tokens", weight.alias("weight"), (weight * F.lit(float(budget_tokens))).alias("quota"),
                         F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks"))
    passes = F.col("quota") / F.col("tokens")
    full = F.floor(passes + 1e-6)
    per = per.select("*", full.alias("full"), (full + 1).alias("last_pass"),
                     F.greatest(F.col("quota") - full * F.col("tokens"), F.lit(0.0)).alias("rest"))
    per = materialize(per, "mix-quota")
    partial = per.where(F.col("rest") >= 1e-6 * F.col("tokens")).select("mix_key", "last_pass", "rest", "blocks")
    placed = (tokens.join(partial, "mix_key").withColumn("place", _order(F.col("last_pass"), F.col("doc_id")))
              .withColumn("block", F.floor(F.col("place") * F.col("blocks")))
              .select("mix_key", "block", "place", "n_tokens", "rest"))
    before = W.partitionBy("mix_key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    edge = (placed.groupBy("mix_key", "block", "rest").agg(F.sum("n_tokens").alias("t"))
            .withColumn("ahead", F.coalesce(F.sum("t").over(before), F.lit(0)))
            .where("ahead < rest").groupBy("mix_key", "rest")
            .agg(F.max_by(F.struct("block", "ahead"), "block").alias("e")).select("mix_key", "rest", "e.block", "e.ahead"))
    inside = W.partitionBy("mix_key").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    cut = (placed.drop("rest").join(edge, ["mix_key", "block"])
           .groupBy("mix_key", "rest", "ahead", "place").agg(F.sum("n_tokens").alias("n_tokens"))
           .withColumn("run", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
           .where("run < rest").groupBy("mix_key").agg(F.max("place").alias("cut")))
    return per.join(cut, "mix_key", "left").select(
        "mix_key", "weight", "quota", "full", "last_pass", F.coalesce("cut", F.lit(-1.0)).alias("cut"), "blocks")


def mixed_draws(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
                budget_tokens: float | None = None) -> DataFrame:
    """One row per drawn document: (doc_id, source, pass, block, position, n_tokens, weight, schedule).

    A source's stream is its passes one after the other; a pass is a
    pseudo-random permutation of its documents in blocks, ``position`` counts
    inside the block. Sorting by ``schedule`` (the block's place in its
    source's stream, 0 to 1) interleaves the sources' blocks in proportion to
    their weights. Null source: a source of its own; null text: no token, drawn
    like any other. Rows with one doc_id (null ones too) share a place and are
    drawn together. Other columns are ignored; an empty table gives no rows.
    """
    tokens = materialize(token_table(docs), "mix-tokens")
    plan = materialize(mixing_plan(tokens, max_repeats, target_entropy, budget_tokens), "mix-plan")
    drawn = (tokens.join(plan, "mix_key")
             .withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("last_pass"))))
             .withColumn("place", _order(F.col("pass"), F.col("doc_id")))
             .where((F.col("pass") <= F.col("full")) | (F.col("place") <= F.col("cut")))
             .withColumn("block", F.floor(F.col("place") * F.col("blocks"))))
    in_block = W.partitionBy("mix_key", "pass", "block").orderBy("place", "doc_id", "n_tokens")
    stream = F.col("full") + F.greatest("cut", F.lit(0.0))
    return drawn.select("doc_id", "source", "pass", "block", F.row_number().over(in_block).cast("long").alias("position"), "n_tokens", "weight",
                        ((F.col("pass") - 1 + F.col("block") / F.col("blocks")) / F.greatest(stream, F.lit(1e-9))).alias("schedule"))


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, target_entropy: float | None = None,
        budget_tokens: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as it is drawn; all columns stay. The texts are not shuffled."""
    tokens = materialize(token_table(docs), "mix-tokens")
    plan = mixing_plan(tokens, max_repeats, target_entropy, budget_tokens)
    key, full, last, cut = (fresh(docs, c) for c in ("mix_key", "mix_full", "mix_last", "mix_cut"))
    plan = materialize(plan.select(F.col("mix_key").alias(key), F.col("full").alias(full),
                                   F.col("last_pass").alias(last), F.col("cut").alias(cut)), "mix-plan")
    joined = docs.withColumn(key, _label(F.col("source"))).join(plan, key)
    times = F.col(full) + F.when(_order(F.col(last), F.col("doc_id")) <= F.col(cut), 1).otherwise(0)
    n = fresh(joined, "mix_pass")
    return (joined.where(times >= 1).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
            .select(*docs.columns))
