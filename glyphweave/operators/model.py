"""The linkage model: patterns of agreement, estimation, weights, value frequencies and greedy assignment."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.compare import compare_levels, tf_adjust
from glyphweave.functions.udf import ColumnLike, col
from glyphweave.workdir import Work, dealt

#: Pairs that a task of an assignment orders, about.
ROWS = 1 << 20
#: Breaks of scores from 0 to 1 when none are given.
BREAKS = (0.8, 0.92, 1.0)


@dataclass
class LinkageModel:
    """Chance of each level of each field among matches (m) and others (u), and the share of matches."""

    m: dict[str, list[float]]
    u: dict[str, list[float]]
    share: float
    iterations: int = 0
    converged: bool = True
    loglik: float = 0.0
    breaks: dict[str, list[float]] = field(default_factory=dict)
    decreasing: dict[str, bool] = field(default_factory=dict)

    def weights(self, name: str) -> list[float]:
        return [float(np.log2(a / b)) for a, b in zip(self.m[name], self.u[name], strict=True)]


def agreement_patterns(levels: DataFrame, fields: Sequence[str], count: str | None = None) -> DataFrame:
    """Every combination of levels (null is one) and how often it stands there; rows stand for one pair, or for ``count`` pairs."""
    n = F.count(lit(1)) if count is None else F.sum(count)
    return levels.groupBy(*fields).agg(n.alias("n")).where("n > 0").orderBy(*fields)


def em_linkage(
    patterns: DataFrame, fields: Sequence[str], n_levels: dict[str, int] | None = None, share: float = 0.1, m_init: dict[str, Sequence[float]] | None = None,
    u_init: dict[str, Sequence[float]] | None = None, max_iter: int = 500, tol: float = 1e-8, min_prob: float = 1e-10,
) -> LinkageModel:
    """Fit both classes by expectation and maximisation on the table of patterns.

    There are at most as many patterns as combinations of levels, whatever the number of pairs, so the
    table comes to the driver. A field that is missing in a pattern says nothing there.
    """
    rows = patterns.select(*fields, "n").collect()
    if not rows:
        raise ValueError("there are no patterns")
    n = np.array([r["n"] for r in rows], float)
    level = np.array([[-1 if r[f] is None else r[f] for f in fields] for r in rows])
    sizes = [n_levels[f] if n_levels else int(level[:, k].max()) + 1 for k, f in enumerate(fields)]

    def start(given: dict | None, top: float) -> list[np.ndarray]:
        out = []
        for f, size in zip(fields, sizes, strict=True):
            p = np.full(size, (1 - top) / max(size - 1, 1))
            p[-1] = top if size > 1 else 1.0
            out.append(np.clip(np.array(given[f], float) if given and f in given else p, min_prob, 1 - min_prob))
        return out

    m, u, converged, step = start(m_init, 0.9), start(u_init, 0.1), False, 0

    def posterior() -> tuple[np.ndarray, float]:
        a, b = np.full(len(n), np.log(share)), np.full(len(n), np.log1p(-share))
        for k in range(len(fields)):
            seen = level[:, k] >= 0
            a[seen] += np.log(m[k][level[seen, k]])
            b[seen] += np.log(u[k][level[seen, k]])
        whole = np.logaddexp(a, b)
        return np.exp(a - whole), float((n * whole).sum())

    for step in range(1, max_iter + 1):
        g, _ = posterior()
        new = float(np.clip((n * g).sum() / n.sum(), min_prob, 1 - min_prob))
        shift, share = abs(new - share), new
        for k, size in enumerate(sizes):
            seen = level[:, k] >= 0
            for table, w in ((m, n * g), (u, n * (1 - g))):
                total = w[seen].sum()
                p = np.bincount(level[seen, k], w[seen], size) / total if total > 0 else table[k]
                p = np.clip(p, min_prob, 1 - min_prob)
                shift = max(shift, float(np.abs(p - table[k]).max()))
                table[k] = p
        if shift < tol:
            converged = True
            break
    if not converged:
        warnings.warn(f"no convergence in {max_iter} steps", stacklevel=2)
    loglik = posterior()[1]
    return LinkageModel({f: m[k].tolist() for k, f in enumerate(fields)}, {f: u[k].tolist() for k, f in enumerate(fields)}, share, step, converged, loglik)


def _weight(model: LinkageModel, name: str, level: Column) -> Column:
    out = F.when(level.isNull(), lit(0.0))
    for k, w in enumerate(model.weights(name)):
        out = out.when(level == k, lit(w))
    return out  # a level that the model has not seen gives null


def probability(weight: Column, share: float) -> Column:
    return 1 / (1 + (1 - share) / share * F.pow(lit(2.0), -weight))


def match_weights(df: DataFrame, model: LinkageModel, columns: dict[str, ColumnLike] | None = None) -> DataFrame:
    """``df`` with weight (sum of log2(m / u)) and probability; a missing level counts 0, an unknown one gives null."""
    weight = sum((_weight(model, f, col(columns[f] if columns else f)) for f in model.m), lit(0.0))
    return df.withColumn("weight", weight).withColumn("probability", probability(F.col("weight"), model.share))


def value_frequency(df: DataFrame, value: str, pool: DataFrame | None = None, pool_value: str | None = None, na_strings: Sequence[str] = ("",), name: str = "frequency") -> DataFrame:
    """``df`` with the share that a row's value has among all known ones (of the pool's rows too)."""
    kind = dict(df.dtypes)[value]
    known = F.when(~col(value).isin(*na_strings), col(value)) if kind == "string" and na_strings else col(value)
    values = df.select(known.alias("__v"))
    if pool is not None:
        other = pool.select(F.col(pool_value or value).alias("__v"))
        values = values.unionByName(other.where(~F.col("__v").isin(*na_strings)) if kind == "string" and na_strings else other)
    counts = values.where("__v is not null").groupBy("__v").agg(F.count(lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__t"))
    share = counts.crossJoin(F.broadcast(total)).select("__v", (F.col("__n") / F.col("__t")).alias(name))  # one row
    return df.join(share, known == F.col("__v"), "left").drop("__v")


def auto_breaks(df: DataFrame, score: str) -> list[float]:
    """Midpoints between up to four different values, else 0.8, 0.92 and 1 for scores from 0 to 1."""
    values = sorted(r[0] for r in df.select(F.col(score).cast("double")).where(F.col(score).isNotNull()).distinct().limit(5).collect())
    if len(values) <= 4:
        if len(values) < 2:
            raise ValueError(f"{score} has one value")
        return [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
    low, high = df.agg(F.min(score), F.max(score)).first()
    if low < 0 or high > 1:
        raise ValueError(f"give the breaks of {score}")
    return list(BREAKS)


def rlink_weights(
    pairs: DataFrame, scores: Sequence[str], levels: dict[str, Sequence[float]] | None = None, tf: dict[str, tuple[str, str]] | None = None, model: LinkageModel | None = None,
    share: float = 0.1, weight_power: float = 1, decreasing: Sequence[str] = (), ids: tuple[str, str] = ("id_1", "id_2"), counted: DataFrame | None = None, **em: object,
) -> tuple[DataFrame, LinkageModel]:
    """Scored pairs with weight and probability, and the model; fitted on these pairs unless one is given.

    ``tf`` names for a score the two columns that it compared: where they agree fully, the weight is
    corrected by how frequent the value is among the records of the pairs. ``counted`` are the scores of
    all pairs with the number n of pairs that have them: breaks and model then come from it, so ``pairs`` may be rows that stand for several.
    """
    if counted is not None and model is None:  # read for each score's breaks, and for the model
        counted = Work(pairs.sparkSession, "counted").write(counted.where("n > 0"), "scores")
    fitted = pairs if counted is None else counted
    breaks = {s: list((levels or {}).get(s) or (model.breaks.get(s) if model else None) or auto_breaks(fitted, s)) for s in scores}
    down = {s: s in decreasing for s in scores}
    with_levels = lambda df: df.select("*", *[compare_levels(F.col(s).cast("double"), breaks[s], down[s]).alias(f"__{s}") for s in scores])
    leveled = with_levels(pairs)
    names = {s: f"__{s}" for s in scores}
    if model is None:
        own = [F.col(f"__{s}").alias(s) for s in scores]
        patterns = agreement_patterns(leveled.select(*own), scores) if counted is None else agreement_patterns(with_levels(counted).select(*own, "n"), scores, "n")
        model = em_linkage(patterns, scores, {s: len(breaks[s]) + 1 for s in scores}, share, **em)
        model.breaks, model.decreasing = breaks, down
    out = match_weights(leveled, model, names)
    for s, (c1, c2) in (tf or {}).items():
        pool = None
        for c, i in ((c1, ids[0]), (c2, ids[1])):
            own = out.select(F.col(i).alias("i"), F.nullif(F.upper(F.col(c)), lit("")).alias("v")).distinct().select("v")
            pool = own if pool is None else pool.unionByName(own)
        counts = pool.where("v is not null").groupBy("v").agg(F.count(lit(1)).alias("n"))
        total, squares = counts.agg(F.sum("n"), F.sum(F.col("n").cast("double") ** 2)).first()
        reference = squares / total**2 if total else 0.0
        if 0 < reference < 1:
            rate = counts.select("v", (F.col("n") / total).alias("__f"))
            out = out.join(rate, F.upper(F.col(c1)) == F.col("v"), "left").drop("v")
            full = (F.col(f"__{s}") == len(breaks[s])) & F.col("__f").isNotNull()
            out = out.withColumn("weight", F.when(full, tf_adjust("weight", float(reference), "__f", lit(1.0), weight_power)).otherwise(F.col("weight"))).drop("__f")
    out = out.withColumn("probability", probability(F.col("weight"), model.share)) if tf else out
    return out.drop(*names.values()), model


def select_greedy(pairs: DataFrame, i: str, j: str, weight: str, order: str, n: int = 1, m: int = 1, name: str = "selected") -> DataFrame:
    """``pairs`` with a flag: the highest weight first, a pair is kept while its left record has under n links and its right one under m.

    Equal weights go by ``order``, a column whose values differ. In each round the pairs that are among the
    first of both their records' open pairs, as far as these have room, are safe, as nothing before them can
    fill it; then records without room close their pairs. The best open pair is always safe, so rounds come to an
    end; a chain of falling weights takes as many as half its pairs. Pairs without a record or weight get null.
    """
    work = Work(pairs.sparkSession, "greedy")
    base = pairs.select(F.col(i).alias("i"), F.col(j).alias("j"), F.col(weight).alias("w"), F.col(order).alias("o")).where("i is not null and j is not null and w is not null")
    with dealt(pairs.sparkSession, 0, ROWS):
        left = work.write(base.withColumn("ri", lit(n)).withColumn("rj", lit(m)), "open")
    safe_tables = []
    while open_pairs := left.count():
        best = []  # at most n or m pairs a record: only these meet, not all pairs
        for end, most in (("i", n), ("j", m)):
            first = Window.partitionBy(end).orderBy(F.desc("w"), "o")
            best.append(left.select("i", "j", "o", f"r{end}", F.row_number().over(first).alias("k")).where(F.col("k") <= most).where(F.col("k") <= F.col(f"r{end}")))
        with dealt(pairs.sparkSession, open_pairs, ROWS):
            safe = work.write(best[0].select("i", "j", "o").join(best[1].select("o"), "o").select("i", "j", "o"), "safe")
            safe_tables.append(work.made[-1])
            used_i, used_j = (safe.groupBy(e).agg(F.count(lit(1)).alias(f"u{e}")) for e in "ij")
            rest = left.join(safe.select("o"), "o", "left_anti").join(used_i, "i", "left").join(used_j, "j", "left")
            rest = rest.select("i", "j", "w", "o", (F.col("ri") - F.coalesce("ui", lit(0))).cast("int").alias("ri"), (F.col("rj") - F.coalesce("uj", lit(0))).cast("int").alias("rj"))
            left = work.write(rest.where("ri > 0 and rj > 0"), "open")
    good = F.col(i).isNotNull() & F.col(j).isNotNull() & F.col(weight).isNotNull()
    if not safe_tables:
        return pairs.withColumn(name, F.when(good, lit(False)))
    marks = pairs.sparkSession.read.schema(safe.schema).parquet(*safe_tables).select(F.col("o").alias("__o"), lit(True).alias("__kept"))
    return pairs.join(marks, F.col(order) == F.col("__o"), "left").withColumn(name, F.when(good, F.coalesce("__kept", lit(False)))).drop("__o", "__kept")
