"""Quality rules: base counts, then robust multivariate outliers per language and source (minimum covariance determinant)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from statlake.llm.common import binary_column, materialize, sliced

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WINDOW_WORDS, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FEATURES = ("f_len", "f_word", "f_symbol", "f_dup", "f_repeat")
#: Added to the variances of the transformed statistics (logarithm of the words, of the word length, symbols a word,
#: logarithm of the repeated lines, share of repeated words): most texts have no symbol and no repeated line or window at
#: all, so the plain variance is near zero there, and one repeated line or some symbols would count as an outlier.
FLOORS = (0.10, 0.0025, 0.0025, 0.25, 0.01)
#: Share of a group's rows that the estimate rests on; most concentration steps, and the fall of the logarithm of every
#: determinant under which they have settled.
SUPPORT, STEPS, SETTLED = 0.5, 12, 1e-3
#: Last, the rows within this squared distance (chi-square quantile at 0.975) are estimated from once more.
REWEIGHT, REWEIGHT_SHARE = 12.83, 0.975
#: Bins a square root of a feature's floor, for medians.
_BINS_PER_FLOOR = 32
#: Greatest squared Mahalanobis distance kept: the chi-square quantile (5 degrees of freedom) at 1 - 1e-6.
CUTOFF = 37.33
#: A group of n rows is judged by its own estimate with weight n / (n + SHRINK), the rest from its language's, which is
#: drawn to that of all rows likewise.
SHRINK = 50
_BINS_PER_OCTAVE = 16
#: Parts of a group that join its estimate apart, where estimates are too many to be sent to every task (about 400 bytes each).
SALTS, SENT_ESTIMATES = 32, 20_000


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, SPACES).decode("utf-8", "replace"))
    symbols = sum(text.count(SYMBOLS[i: i + 1]) for i in range(len(SYMBOLS)))
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur twice or more; windows are compared exactly, by doubling ranks."""
    n = len(words) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    rank = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    span = 1
    while span < WINDOW_WORDS:  # rank of the span-word window at each place -> of the 2 * span-word window
        left, right = rank[:-span], rank[span:]
        values, rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)
        span *= 2
        if len(values) == len(rank):
            return 0
    twice = np.bincount(rank)[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW_WORDS, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def with_base_counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and the five counts of every row (whole texts, read in Arrow batches)."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [f"{c} long" for c in _COUNTS])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            counts = np.array([base_counts(t) for t in binary_column(batch, "__text")], np.int64).reshape(-1, len(_COUNTS))
            yield pa.record_batch([*(batch.column(c) for c in carry), *(pa.array(counts[:, i]) for i in range(len(_COUNTS)))],
                                  names=[*carry, *_COUNTS])

    return docs.select(*carry, F.col("text").cast("string").alias("__text")).mapInArrow(scan, schema)


def _features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log1p(F.col("n_words").cast("double")).alias("f_len"),
            F.log1p(F.col("word_chars") / n).alias("f_word"), (F.col("n_symbols") / n).alias("f_symbol"),
            F.log1p(F.col("n_dup_lines").cast("double")).alias("f_dup"), (F.col("n_repeat_words") / n).alias("f_repeat")]


def _estimate(rows: DataFrame, weight: str) -> DataFrame:
    """Location and scatter per group from the rows with ``weight``: one partial aggregate, exact at any size."""
    w = F.col(weight)
    sums = [F.sum(w).alias("m")]
    sums += [F.sum(w * F.col(a)).alias(f"s_{a}") for a in _FEATURES]
    sums += [F.sum(w * F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for i, a in enumerate(_FEATURES) for b in _FEATURES[i:]]
    return rows.groupBy("grp", "start").agg(*sums)


def _inverse(sums: DataFrame, scale: float) -> DataFrame:
    """(grp, start, mean, inverse of the floored scatter, logarithm of its determinant) from sums; one small matrix per group and start."""
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, inverses, dets = [], [], []
            for r in batch.to_pylist():
                mean, cov = _moments(r)
                cov = scale * cov + np.diag(FLOORS)
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield _estimates(batch.column("grp"), batch.column("start"), means, inverses, dets)

    return sums.mapInArrow(invert, _ESTIMATE.format(dict(sums.dtypes)["grp"]))


_ESTIMATE = "grp {}, start int, mean array<double>, inv array<double>, logdet double"


def _estimates(grp: pa.Array, start: pa.Array, means: list, inverses: list, dets: list) -> pa.RecordBatch:
    return pa.record_batch([grp, start, pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64())),
                            pa.array(dets, pa.float64())], names=["grp", "start", "mean", "inv", "logdet"])


def _moments(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from one row of :func:`_estimate`."""
    k, m = len(_FEATURES), max(r["m"], 1.0)
    mean = np.array([r[f"s_{a}"] / m for a in _FEATURES])
    cov = np.zeros((k, k))
    for i, a in enumerate(_FEATURES):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = r[f"p_{a}_{_FEATURES[j]}"] / m - mean[i] * mean[j]
    return mean, cov


def _medians(rows: DataFrame) -> DataFrame:
    """(grp, med, dev): each feature's median and floored scale (median absolute deviation) per group, from counts of bins."""
    width = [f ** 0.5 / _BINS_PER_FLOOR for f in FLOORS]
    bins = [F.floor(F.col(a) / w).cast("long") for a, w in zip(_FEATURES, width)]
    counts = materialize(rows.select("grp", F.posexplode(F.array(*bins)).alias("pos", "bin"))
                         .groupBy("grp", "pos", "bin").agg(F.count(F.lit(1)).alias("c")), "mcd-bins")

    def middle(table: DataFrame, value: str) -> DataFrame:
        each = W.partitionBy("grp", "pos")
        return (table.withColumn("upto", F.sum("c").over(each.orderBy(value))).withColumn("n", F.sum("c").over(each))
                .where(2 * F.col("upto") >= F.col("n")).groupBy("grp", "pos").agg(F.min(value).alias("middle")))

    med = middle(counts, "bin")
    away = counts.join(med, ["grp", "pos"]).withColumn("away", F.abs(F.col("bin") - F.col("middle")))
    dev = middle(away.groupBy("grp", "pos", "away").agg(F.sum("c").alias("c")), "away").withColumnRenamed("middle", "dev")
    both = med.join(dev, ["grp", "pos"])
    per = [F.max(F.when(F.col("pos") == i, F.struct("middle", "dev"))) for i in range(len(_FEATURES))]
    found = both.groupBy("grp").agg(*[p.alias(f"x{i}") for i, p in enumerate(per)])
    return materialize(found.select(
        "grp", F.array(*[(F.col(f"x{i}.middle") + 0.5) * w for i, w in enumerate(width)]).alias("med"),
        F.array(*[F.sqrt(F.pow(1.4826 * w * F.col(f"x{i}.dev"), 2) + f) for i, (w, f) in enumerate(zip(width, FLOORS))]).alias("dev")),
        "mcd-medians")


def _robust_starts(salted: DataFrame, send: bool) -> DataFrame:
    """Estimates around the medians: 1 the scales alone, 2 with the correlation of tanh, 3 with that of spatial signs."""
    k, medians = len(_FEATURES), _medians(salted)
    z = [f"z{i}" for i in range(k)]
    rows = _beside(salted, medians, send).withColumns(
        {z[i]: (F.col(a) - F.col("med")[i]) / F.col("dev")[i] for i, a in enumerate(_FEATURES)})
    norm = F.greatest(F.sqrt(sum((F.col(c) * F.col(c) for c in z[1:]), F.col(z[0]) * F.col(z[0]))), F.lit(1e-12))
    kinds = [(1, lambda c: c), (2, F.tanh), (3, lambda c: c / norm)]
    shapes = rows.select("grp", "one", F.inline(F.array(*[
        F.struct(F.lit(s).alias("start"), *[f(F.col(c)).alias(a) for c, a in zip(z, _FEATURES)]) for s, f in kinds])))

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means, inverses, dets = [], [], []
            for r in batch.to_pylist():
                mean, cov = _moments(r)
                if r["start"] == 3:
                    cov = cov + np.outer(mean, mean)  # signs are taken around the medians
                spread = np.sqrt(np.maximum(np.diag(cov), 0))
                shape = np.eye(k)
                if r["start"] > 1:
                    held = spread > 1e-9
                    shape[np.ix_(held, held)] = cov[np.ix_(held, held)] / np.outer(spread[held], spread[held])
                cov = (shape + 1e-6 * np.eye(k)) * np.outer(r["dev"], r["dev"])
                means.append(r["med"])
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            yield _estimates(batch.column("grp"), batch.column("start"), means, inverses, dets)

    sums = _estimate(shapes, "one").join(medians, "grp")
    return sums.mapInArrow(starts, _ESTIMATE.format(dict(sums.dtypes)["grp"]))


def _distance() -> Column:
    k, total = len(_FEATURES), F.lit(0.0)
    d = [F.col(a) - F.col("mean")[i] for i, a in enumerate(_FEATURES)]
    for i in range(k):
        for j in range(i, k):
            total = total + (1.0 if i == j else 2.0) * d[i] * d[j] * F.col("inv")[i * k + j]
    return F.greatest(total, F.lit(0.0))


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(distance + 1e-6) * _BINS_PER_OCTAVE).cast("long")


def minimum_covariance_determinant(rows: DataFrame, groups: int, steps: int = STEPS, support: float = SUPPORT) -> DataFrame:
    """(grp, mean, cov, steps) per group of (grp, features), of which there are ``groups``: concentration steps over all rows.

    Each step takes the rows nearest to the current estimate (at least
    ``support`` of the group) and re-estimates from them. The nearest rows
    come from per-group counts of logarithmic distance bins, so no group is
    sorted or gathered: a step is two partial aggregates however large a group
    is. As for a deterministic MCD there are several starts (all rows, and
    three around the medians); each is stepped until it settles, and the one
    of the least determinant is kept. Last, the rows near it are estimated
    from once more. The scatter has the variance floors in it. A column says
    how many steps were taken; ``steps`` of them end the search unsettled.
    """
    send = groups * 4 <= SENT_ESTIMATES
    salted = rows.withColumn("one", F.lit(1.0)).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    every = _inverse(_estimate(salted.withColumn("start", F.lit(0)), "one"), 1.0)
    estimate = materialize(every.unionByName(_robust_starts(salted, send)), "mcd")
    consistency = _consistency(support)
    for step in range(steps):
        binned = _beside(salted, estimate, send).withColumn("bin", _bin(_distance()))
        each = W.partitionBy("grp", "start")
        cut = (binned.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).alias("c"))
               .withColumn("before", F.sum("c").over(each.orderBy("bin")) - F.col("c"))
               .withColumn("n", F.sum("c").over(each))
               .where(F.col("before") < support * F.col("n"))
               .groupBy("grp", "start").agg(F.max("bin").alias("last")))
        near = _beside(salted, estimate.join(cut, ["grp", "start"]), send).withColumn(
            "one", F.when(_bin(_distance()) <= F.col("last"), 1.0).otherwise(0.0))
        last, estimate = estimate, materialize(_inverse(_estimate(near, "one"), consistency), "mcd")
        # the starts' own determinants are of another scale
        if step and estimate.join(last.select("grp", "start", F.col("logdet").alias("was")), ["grp", "start"]).where(
                F.col("was") - F.col("logdet") > SETTLED).isEmpty():
            break
    best = estimate.groupBy("grp").agg(F.min_by(F.struct("start", "mean", "inv"), F.struct("logdet", "start")).alias("b")).select("grp", "b.*")
    near = _beside(salted, materialize(best, "mcd-best"), send).withColumn("one", F.when(_distance() <= REWEIGHT, 1.0).otherwise(0.0))
    sums = _estimate(near, "one").withColumn("steps", F.lit(step + 1 if steps else 0))
    return materialize(_scatter(sums, _consistency(REWEIGHT_SHARE)), "mcd")


def _scatter(sums: DataFrame, scale: float) -> DataFrame:
    """(grp, mean, floored scatter, steps) from sums."""
    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moments = [_moments(r) for r in batch.to_pylist()]
            yield pa.record_batch([batch.column("grp"), pa.array([m.tolist() for m, _ in moments], pa.list_(pa.float64())),
                                   pa.array([(scale * c + np.diag(FLOORS)).ravel().tolist() for _, c in moments], pa.list_(pa.float64())),
                                   batch.column("steps")], names=["grp", "mean", "cov", "steps"])

    return sums.mapInArrow(scatter, f"grp {dict(sums.dtypes)['grp']}, mean array<double>, cov array<double>, steps int")


def _beside(salted: DataFrame, per_group: DataFrame, send: bool) -> DataFrame:
    """Rows with their group's one-row figures (at most SENT_ESTIMATES rows if they are to be sent to every task).

    Otherwise both are shuffled; the figures are repeated per salt, so a large group's rows stay in several tasks.
    """
    if send:
        return salted.join(F.broadcast(per_group), "grp")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return salted.join(per_group.withColumn("salt", salts), ["grp", "salt"])


def _consistency(support: float) -> float:
    """Factor that makes the scatter of the nearest ``support`` share of normal rows consistent (5 dimensions)."""
    grid = np.linspace(1e-4, 60, 200_001)
    density = grid ** 1.5 * np.exp(-grid / 2)
    share = np.cumsum(density) / density.sum()
    quantile = grid[np.searchsorted(share, support)]
    wider = grid ** 2.5 * np.exp(-grid / 2)
    return support / float(wider[: np.searchsorted(share, support)].sum() / wider.sum())


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def fit_groups(counts: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """(g_lang, g_source, mean, inv, own_weight): what each language and source of (lang, source, counts) is judged by.

    Every group has its own robust estimate, whatever its size. It is drawn
    to its language's, and this to that of all rows, by n / (n + shrink): few
    rows say little about their scatter. own_weight is that share.
    """
    passed = counts.where(~_failed()).select("lang", "source", *_features())
    # three levels of groups in one table: (lang, source), (lang), all; null languages and sources are groups of their own
    level = lambda *c: F.struct(*[F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("-")).alias(a)
                                  if x else F.lit("").alias(a) for a, x in zip(("lang", "source"), c)])
    own, lang, every = level("lang", "source"), level("lang", None), level(None, None)
    sized = passed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    sized = sized.select("lang", "source", "n", F.sum("n").over(W.partitionBy("lang")).alias("n_lang"), own.alias("own"), lang.alias("up"), every.alias("top"))
    sized = materialize(sized, "mcd-groups")
    groups = 2 * sized.count() + 1  # as many languages as groups, at most
    member = passed.select(*_FEATURES, F.explode(F.array(own, lang, every)).alias("grp"))
    estimate = minimum_covariance_determinant(member.select("grp", *_FEATURES), groups).drop("steps")
    joined = sized
    for name in ("own", "up", "top"):
        joined = joined.join(estimate.select(F.col("grp").alias(name), F.col("mean").alias(f"mean_{name}"), F.col("cov").alias(f"cov_{name}")), name)

    def blend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(_FEATURES)
        for batch in batches:
            means, inverses, weights = [], [], []
            for r in batch.to_pylist():
                w, up = r["n"] / (r["n"] + shrink), r["n_lang"] / (r["n_lang"] + shrink)
                mean, cov = (w * np.array(r[f"{x}_own"]) + (1 - w) * (up * np.array(r[f"{x}_up"]) + (1 - up) * np.array(r[f"{x}_top"]))
                             for x in ("mean", "cov"))
                means.append(mean.tolist())
                inverses.append(np.linalg.inv(cov.reshape(k, k)).ravel().tolist())
                weights.append(w)
            yield pa.record_batch([batch.column("lang"), batch.column("source"), pa.array(means, pa.list_(pa.float64())),
                                   pa.array(inverses, pa.list_(pa.float64())), pa.array(weights, pa.float64())],
                                  names=["g_lang", "g_source", "mean", "inv", "own_weight"])

    kinds = dict(counts.dtypes)
    return materialize(joined.mapInArrow(blend, f"g_lang {kinds['lang']}, g_source {kinds['source']}, mean array<double>, inv array<double>, "
                                                "own_weight double").coalesce(4), "mcd-fitted")


def judge(rows: DataFrame, fitted: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds base_failed, distance (squared Mahalanobis; null if base_failed) and kept to rows with lang, source and counts."""
    rows = rows.select("*", _failed().alias("base_failed"), *_features())
    judged = rows.join(fitted, rows["lang"].eqNullSafe(F.col("g_lang")) & rows["source"].eqNullSafe(F.col("g_source")), "left")
    distance = F.when(~F.col("base_failed") & F.col("mean").isNotNull(), _distance())
    return judged.withColumn("distance", distance).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff)).drop(
        "g_lang", "g_source", "mean", "inv", "own_weight", *_FEATURES)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, shrink: float = SHRINK) -> DataFrame:
    """One row per document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept).

    A text fails the base rules with under 20 words or with over 30 % of its
    words in 8-word windows that occur twice. The other texts' statistics
    (logarithms of the words and of the word length, symbols a word, logarithm
    of the repeated lines, share of repeated words) are judged by their
    Mahalanobis distance from a robust estimate of their (language, source)
    group, drawn to its language's and the whole table's as if these had
    ``shrink`` rows (:func:`fit_groups`).
    Null text: all counts 0, base_failed. Null language or source: a group of
    its own. Rows with equal ids are judged each; other columns are ignored;
    an empty table gives no rows.
    """
    counts = materialize(with_base_counts(docs, ["doc_id", "lang", "source"]), "quality-counts")
    return judge(counts, fit_groups(counts, shrink), cutoff).select("doc_id", *_COUNTS, "base_failed", "distance", "kept")


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, shrink: float = SHRINK) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, all columns as they are.

    The counts are taken again from the rows themselves and joined with the
    small table of estimates, so the texts are not shuffled and repeated or
    null doc_ids do not matter.
    """
    fitted = fit_groups(materialize(with_base_counts(docs, ["lang", "source"]), "quality-counts"), shrink)

    @F.pandas_udf(", ".join(f"{c} long" for c in _COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([base_counts(None if t is None else bytes(t)) for t in texts], columns=list(_COUNTS), dtype="int64")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"), "lang", "source",
                       counted(F.encode(F.col("text").cast("string"), "utf-8")).alias("c"))
    return judge(rows.select("kept_row", "lang", "source", "c.*"), fitted, cutoff).where("kept").select("kept_row.*")
