"""Quality of pairs and cut-offs: evaluation, threshold sweeps, review order and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.operators.prefix import with_running
from glyphweave.workdir import Work


def _pairs(df: DataFrame, i: str, j: str, ordered: bool) -> DataFrame:
    a, b = F.col(i), F.col(j)
    return (df.select(a.alias("i"), b.alias("j")) if ordered else df.select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))).where("i is not null and j is not null").distinct()


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def _f(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2 * p * r / (p + r))


def _overlap(predicted: DataFrame, truth: DataFrame, i: str, j: str, ordered: bool) -> DataFrame:
    """Different pairs of either table, once each: pairs are shuffled once and aggregated, not sorted to be joined."""
    a, b = (_pairs(d, i, j, ordered).select("i", "j", lit(p).alias("predicted"), lit(not p).alias("truth")) for d, p in ((predicted, True), (truth, False)))
    return a.unionByName(b).groupBy("i", "j").agg(F.max("predicted").alias("predicted"), F.max("truth").alias("truth")).select("predicted", "truth", lit(1).alias("n"))


def _counts(counted: DataFrame) -> DataFrame:
    p, t = (F.coalesce(c, lit(False)) for c in ("predicted", "truth"))
    return counted.agg(*[F.coalesce(F.sum(F.when(c, F.col("n"))), lit(0)).cast("long").alias(n) for n, c in (("tp", p & t), ("fp", p & ~t), ("fn", ~p & t))])


def linkage_eval_counts(counted: DataFrame, n_pairs: int | None = None) -> DataFrame:
    """``linkage_eval`` of rows that stand for n different pairs each, all of them predicted or not, and true or not."""
    out = _counts(counted)
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("f_measure", _f(F.col("precision"), F.col("recall")))
    if n_pairs is None:
        return out
    out = out.withColumn("tn", lit(n_pairs) - F.col("tp") - F.col("fp") - F.col("fn"))
    return out.withColumn("specificity", _ratio(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("accuracy", (F.col("tp") + F.col("tn")) / n_pairs)


def linkage_eval(predicted: DataFrame, truth: DataFrame, i: str = "x_id", j: str = "y_id", n_pairs: int | None = None, ordered: bool = True) -> DataFrame:
    """tp, fp, fn, precision, recall and F of the different pairs; of ``n_pairs`` possible ones also tn, specificity and accuracy."""
    return linkage_eval_counts(_overlap(predicted, truth, i, j, ordered), n_pairs)


def blocking_eval_counts(counted: DataFrame, n_1: int, n_2: int | None = None) -> DataFrame:
    """``blocking_eval`` of rows that stand for n different pairs each, all of them candidates (predicted) or not, and true or not."""
    possible = n_1 * n_2 if n_2 is not None else n_1 * (n_1 - 1) // 2
    out = _counts(counted).withColumn("n_candidates", F.col("tp") + F.col("fp")).withColumn("n_truth", F.col("tp") + F.col("fn"))
    out = out.withColumn("reduction_ratio", 1 - F.col("n_candidates") / possible if possible else lit(None).cast("double"))
    out = out.withColumn("pairs_completeness", _ratio(F.col("tp"), F.col("n_truth"))).withColumn("pairs_quality", _ratio(F.col("tp"), F.col("n_candidates")))
    return out.withColumn("f_measure", _f(F.col("reduction_ratio"), F.col("pairs_completeness"))).drop("fp", "fn")


def blocking_eval(candidates: DataFrame, truth: DataFrame, n_1: int, n_2: int | None = None, i: str = "x_id", j: str = "y_id") -> DataFrame:
    """How many of all possible pairs blocking spares, and how many true ones it keeps; within one table pairs have no order."""
    return blocking_eval_counts(_overlap(candidates, truth, i, j, n_2 is not None), n_1, n_2)


def _second(df: DataFrame, end: str) -> DataFrame:
    """Highest and second highest value of each record; only two rows a record and task are shuffled."""
    order = Window.partitionBy(end).orderBy(F.desc("v"), "o")
    two = df.select(end, "v", "o", F.row_number().over(order).alias("k")).where("k <= 2")
    return two.groupBy(end).agg(F.max("v").alias(f"top_{end}"), F.max(F.when(F.col("k") == 2, F.col("v"))).alias(f"next_{end}"))


def threshold_sweep(
    pairs: DataFrame, score: str, i: str = "x_id", j: str = "y_id", thresholds: Sequence[float] | None = None, probability: str | None = None, truth: DataFrame | None = None,
    lower: bool = False, ordered: bool = True,
) -> DataFrame:
    """For each cut-off: pairs, linked records of both sides, one-to-one pairs, records with conflicts, and quality estimates.

    A pair is one-to-one from its own score on, until a second pair of one of its records comes in. Each
    pair and record thus changes the counts at one or two scores; the changes are summed by score and
    then run up, so no task holds all pairs. ``lower``: small scores are matches. Without thresholds, all scores.
    """
    a, b = F.col(i), F.col(j)
    own = pairs.select((a if ordered else F.least(a, b)).alias("i"), (b if ordered else F.greatest(a, b)).alias("j"), (-F.col(score) if lower else F.col(score)).cast("double").alias("v"), (F.col(probability) if probability else lit(None)).cast("double").alias("p"))
    own = Work(pairs.sparkSession, "sweep").write(own.where("v is not null").withColumn("o", F.xxhash64("i", "j")), "pairs")
    ends = {e: _second(own, e) for e in ("i", "j")}
    marked = own.join(ends["i"], "i").join(ends["j"], "j")
    later = F.greatest("next_i", "next_j")  # of known ones
    single = marked.where("v = top_i and v = top_j").where(later.isNull() | (later < F.col("v")))
    names = ["n_pairs", "n_linked_1", "n_linked_2", "n_one_to_one", "n_conflict_1", "n_conflict_2", "est_tp", "est_fp", "tp"]

    def change(df: DataFrame, at: Column, **by: Column | int) -> DataFrame:
        return df.select(at.alias("v"), *[(lit(by[n]) if isinstance(by.get(n), int) else by.get(n, lit(0))).cast("double").alias(n) for n in names])

    changes = change(own, F.col("v"), n_pairs=1, est_tp=F.coalesce("p", lit(0.0)), est_fp=1 - F.coalesce("p", lit(1.0)))
    for e, k in (("i", 1), ("j", 2)):
        changes = changes.unionByName(change(ends[e], F.col(f"top_{e}"), **{f"n_linked_{k}": 1}))
        changes = changes.unionByName(change(ends[e].where(f"next_{e} is not null"), F.col(f"next_{e}"), **{f"n_conflict_{k}": 1}))
    changes = changes.unionByName(change(single, F.col("v"), n_one_to_one=1)).unionByName(change(single.where(later.isNotNull()), later, n_one_to_one=-1))
    n_truth = None
    if truth is not None:
        known = _pairs(truth, i, j, ordered)
        n_truth = known.count()
        changes = changes.unionByName(change(own.join(known, ["i", "j"], "left_semi"), F.col("v"), tp=1))
    if thresholds is None:
        summed = changes.groupBy("v").agg(*[F.sum(n).alias(n) for n in names])
        run = with_running(summed.select("v", *[F.col(n).alias(f"d_{n}") for n in names]), "v", {n: f"d_{n}" for n in names}, descending=True)
        out = run.select((-F.col("v") if lower else F.col("v")).alias("threshold"), *names)
    else:
        cuts = sorted({-t if lower else t for t in thresholds}, reverse=True)
        place = lit(None).cast("int")
        for k, cut in reversed(list(enumerate(cuts))):
            place = F.when(F.col("v") >= cut, k).otherwise(place)
        by_cut = changes.groupBy(place.alias("k")).agg(*[F.sum(n).alias(n) for n in names]).where("k is not null")
        told = pairs.sparkSession.createDataFrame([(k, float(-c if lower else c)) for k, c in enumerate(cuts)], "k int, threshold double")
        up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # one row a threshold
        out = F.broadcast(told).join(by_cut, "k", "left").select("threshold", *[F.sum(F.coalesce(n, lit(0.0))).over(up).alias(n) for n in names])
    out = out.select("threshold", *[F.round(F.col(n)).cast("long").alias(n) for n in names[:6]], *names[6:])
    if probability:
        total = own.agg(F.coalesce(F.sum("p"), lit(0.0))).first()[0]
        out = out.withColumn("est_fn", lit(float(total)) - F.col("est_tp")).withColumn("est_precision", _ratio(F.col("est_tp"), F.col("est_tp") + F.col("est_fp")))
        out = out.withColumn("est_recall", _ratio(F.col("est_tp"), lit(float(total)))).withColumn("est_f_measure", _f(F.col("est_precision"), F.col("est_recall")))
    else:
        out = out.drop("est_tp", "est_fp")
    if truth is None:
        return out.drop("tp")
    out = out.withColumn("tp", F.col("tp").cast("long")).withColumn("fp", F.col("n_pairs") - F.col("tp")).withColumn("fn", lit(n_truth) - F.col("tp"))
    out = out.withColumn("precision", _ratio(F.col("tp"), F.col("n_pairs"))).withColumn("recall", _ratio(F.col("tp"), lit(n_truth)))
    return out.withColumn("f_measure", _f(F.col("precision"), F.col("recall")))


def suggest_cut(sweep: DataFrame) -> float | None:
    """The last cut, from the highest on, at which more one-to-one pairs come in than records get conflicts. Sweeps over given thresholds only."""
    rows = sweep.select("threshold", "n_one_to_one", (F.col("n_conflict_1") + F.col("n_conflict_2")).alias("conflicts")).orderBy(F.desc("threshold")).collect()
    found, before = None, (0, 0)
    for r in rows:
        if r["n_one_to_one"] - before[0] > r["conflicts"] - before[1]:
            found = r["threshold"]
        before = r["n_one_to_one"], r["conflicts"]
    return found


def wilson(hits: int, n: int, z: float = 1.959963984540054) -> tuple[float, float]:
    """Interval of a share at 95 percent."""
    if not n:
        return 0.0, 1.0
    p, d = hits / n, 1 + z * z / n
    middle, half = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return (middle - half) / d, (middle + half) / d


def review_order(pairs: DataFrame, score: str, threshold: float = 0.5, na_last: bool = True) -> DataFrame:
    """Pairs by how near they are to the threshold, of equally near ones the higher first."""
    near = F.abs(F.col(score) - threshold)
    return pairs.orderBy(near.asc_nulls_last() if na_last else near.asc_nulls_first(), F.col(score).desc())


def summary_pairs(pairs: DataFrame, scores: Sequence[str], i: str = "x_id", j: str = "y_id", n_1: int | None = None, n_2: int | None = None) -> DataFrame:
    """One row a score: n, missing, quantiles, how many have the least and the largest, records reached, reduction."""
    base = pairs.agg(F.count(lit(1)).alias("n_pairs"), F.countDistinct(i).alias("n_records_1"), F.countDistinct(j).alias("n_records_2"))
    long = pairs.select(F.explode(F.array(*[F.struct(lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in scores])).alias("x")).select("x.*")
    ends = long.groupBy("score").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    out = long.join(F.broadcast(ends), "score").groupBy("score").agg(
        F.count(F.when(F.col("v").isNull(), 1)).alias("n_missing"), *[F.percentile("v", lit(q)).alias(f"q{int(100 * q)}") for q in (0, 0.25, 0.5, 0.75, 1)],
        F.count(F.when(F.col("v") == F.col("low"), 1)).alias("n_at_min"), F.count(F.when(F.col("v") == F.col("high"), 1)).alias("n_at_max"),
    )
    possible = None if n_1 is None else n_1 * n_2 if n_2 is not None else n_1 * (n_1 - 1) // 2
    reduction = (1 - F.col("n_pairs") / possible) if possible else lit(None).cast("double")
    return out.crossJoin(F.broadcast(base)).withColumn("reduction_ratio", reduction)  # one row


def score_histogram(pairs: DataFrame, score: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, low, n) of equal bins: what a plot shows."""
    k = F.least(F.floor((F.col(score) - low) / (high - low) * bins), lit(bins - 1)).cast("int")
    return pairs.where(F.col(score).between(low, high)).groupBy(k.alias("bin")).agg(F.count(lit(1)).alias("n")).withColumn("low", lit(low) + F.col("bin") * (high - low) / bins)
