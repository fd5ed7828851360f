"""Near-duplicate vectors by a pivot-permutation index.

Pivots are reference vectors, drawn from a bounded sample and thinned: of vectors that are nearly linked
one is taken, so a group of near copies has about one pivot, however large it and the table are, and its members
do not choose among many alike. Every vector is described by its nearest pivots
in order, and entered in the inverted list of each of them. Two vectors are candidates if their
descriptions share enough pivots; candidates are verified by cosine in double precision. Lists are cut in
blocks, and each pair of blocks of a list is one piece of work, so a list that holds a third of all rows
is many tasks. A pair that shares several pivots is counted in the list of its first shared pivot only.
A block pair reports numbers of links and a spanning forest of them, not all pairs.

The number of pivots follows the number of vectors (its square root), so lists grow with the square root
as well. All rows are indexed; the recall against brute force is measured in the tests.

Defined results: vectors that are null, empty, zero, of another length than most or that hold null or
non-finite components are linked with nothing and name themselves; equal vectors of different ids are linked
like others; repeated rows (same id, equal vector) are one vector; if one id has several vectors, it is linked
with what any of them is linked with, its links are counted for each of them, and links among them do not count;
rows without an id are linked with nothing; an empty table gives an empty result. Of the input only the id
and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.operators.components import connected_components
from glyphweave.workdir import Work

#: Nearest pivots in a description, and how many two descriptions must share.
NEAREST, SHARED = 12, 2
#: Vectors in a block of a list, and how many of them are multiplied at a time.
DEALT, BLOCK = 8192, 1024
#: Pivots at most; they are broadcast, so this bounds them. So many times more rows are drawn before thinning.
MOST_PIVOTS, DRAWN = 4096, 2
#: Pairs of vectors that are compared one by one at a time; where more have the cosine, pivots are compared by matrix product.
PAIRS = 1 << 14


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the good rows in double precision, and which rows they are."""
    good, rows = [], []
    if not len(column):
        return np.zeros((0, dim)), np.zeros(0, np.int64)
    sizes = column.value_lengths().fill_null(-1).to_numpy()
    rows = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        scale = np.abs(values).max(1, initial=0.0)
        values = values / scale[:, None]
        norm = np.sqrt((values * values).sum(1))
        values = values / norm[:, None]
    good = np.isfinite(values).all(1) & (scale > 0) & np.isfinite(scale)
    return values[good], rows[good]


def _describe(pivots: np.ndarray, nearest: int):
    dim, own = pivots.shape[1], min(nearest, len(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, rows = _vectors(batch.column(1), dim)
                if not len(rows):
                    continue
                dots = x @ pivots.T
                top = np.argpartition(-dots, own - 1, axis=1)[:, :own]
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(dots, top, 1), axis=1, kind="stable"), 1)
                kept = batch.take(pa.array(rows))
                flat = lambda a, t: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), t))
                yield pa.RecordBatch.from_arrays([kept.column(0), flat(top.astype(np.int32), pa.int32()), kept.column(1)], ["row", "pivots", "vector"])

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by minimum labels and jumps."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sharing(a: np.ndarray, b: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """For each two descriptions, whether they share enough pivots and none before ``pivot``."""
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    place = place.reshape(-1, a.shape[1])
    has = np.zeros((len(place), len(names)), np.float32)
    has[np.arange(len(place))[:, None], place] = 1
    one, other, before = has[: len(a)], has[len(a) :], int(np.searchsorted(names, pivot))
    return (one @ other.T >= shared) & (one[:, :before] @ other[:, :before].T == 0)


def _links(cosine: float, shared: int, dim: int):
    """From the two blocks of each piece of work: (u, null, links of u) and the edges of a forest (u, v, 0)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        pivot, low, high = (k.as_py() for k in key)
        table = table.combine_chunks().sort_by("row")
        ids, block = table["row"].to_numpy(), table["block"].to_numpy()
        marks = table["pivots"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = _vectors(table["vector"].combine_chunks(), dim)[0]
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found_a, found_b = [], []
        for at in range(0, len(left), BLOCK):
            i = left[at : at + BLOCK]
            for to in range(0, len(right), BLOCK):
                j = right[to : to + BLOCK]
                if low == high and j[-1] <= i[0]:
                    continue
                near = (x[i] @ x[j].T >= cosine - 1e-12) & (ids[i][:, None] != ids[j])
                if np.count_nonzero(near) > PAIRS:
                    near &= _sharing(marks[i], marks[j], pivot, shared)
                p, q = np.nonzero(near)
                p, q = i[p], j[q]
                if low == high:
                    p, q = p[p < q], q[p < q]
                for start in range(0, len(p), PAIRS):
                    a, b = p[start : start + PAIRS], q[start : start + PAIRS]
                    common = (marks[a][:, :, None] == marks[b][:, None, :]).any(2)
                    first = np.where(common, marks[a], np.iinfo(np.int32).max).min(1)
                    keep = (np.einsum("ij,ij->i", x[a], x[b]) >= cosine) & (common.sum(1) >= shared) & (first == pivot)
                    found_a.append(a[keep])
                    found_b.append(b[keep])
        a, b = (np.concatenate(y) if y else np.zeros(0, np.int64) for y in (found_a, found_b))
        count = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        some = np.flatnonzero(count)
        root = _roots(len(ids), a, b)
        tree = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({
            "u": np.concatenate([ids[some], ids[tree]]), "v": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[root[tree]], pa.int64())]), "links": np.concatenate([count[some], np.zeros(len(tree), np.int64)]),
        })

    return run


def _thin(x: np.ndarray, most: int, apart: float) -> np.ndarray:
    """The first vectors, ``most`` at most, that have a cosine below ``apart`` to all taken before."""
    taken, n = np.empty((min(most, len(x)), x.shape[1])), 0
    for one in x:
        if n == len(taken):
            break
        if not n or (taken[:n] @ one).max() < apart:
            taken[n], n = one, n + 1
    return taken[:n]


def fit_pivots(vectors: DataFrame, n: int, dim: int, seed: int = 7, apart: float = 0.8) -> np.ndarray:
    """At most ``n`` vectors of the table, those whose hashed row comes first, without those near one before: a bounded sample, the same at every run."""
    picked = vectors.orderBy(F.xxhash64("row", F.lit(seed)), "row").limit(DRAWN * n).toArrow()
    x, _ = _vectors(picked["vector"].combine_chunks(), dim)
    return _thin(x, n, apart)


def embedding_dedup(
    spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9,
    nearest: int = NEAREST, shared: int = SHARED, pivots: int | None = None,
) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept."""
    work = Work(spark, "pivots")
    kind = "float" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "double"
    table = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    usual = table.where("size(vector) > 0").groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not usual:
        return work.write(table.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), "result")
    dim, n = usual[0]["dim"], table.count()
    rows = table.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").alias("row"), "vector")
    twice = work.write(rows.groupBy("row").count().where("count > 1").select("row"), "twice")
    if not twice.isEmpty():
        rows = rows.join(twice, "row", "left_anti").unionByName(rows.join(twice, "row", "left_semi").distinct())
    wanted = pivots or max(16, min(MOST_PIVOTS, math.isqrt(n) * 2))
    chosen = fit_pivots(rows, wanted, dim, apart=max(2 * cosine - 1, cosine / 2))
    if not len(chosen):
        return work.write(table.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), "result")
    described = work.write(rows.mapInArrow(_describe(chosen, nearest), f"row bigint, pivots array<int>, vector array<{kind}>"), "described")
    lists = described.select(F.explode("pivots").alias("pivot"), "row", "pivots", "vector")
    sizes = described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("blocks"))
    lists = lists.join(F.broadcast(sizes), "pivot").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high")))).alias("pair")
    pieces = lists.select("pivot", "row", "pivots", "vector", "block", pair).select("pivot", "pair.low", "pair.high", "row", "pivots", "vector", "block")
    linked = work.write(pieces.groupBy("pivot", "low", "high").applyInArrow(_links(cosine, min(shared, len(chosen)), dim), "u bigint, v bigint, links bigint"), "links")
    counts = linked.where("v is null").groupBy("u").agg(F.sum("links").alias("n_links"))
    parts = connected_components(spark, linked.where("v is not null").select("u", "v"), work)
    out = table.select("vec_id").join(counts.withColumnRenamed("u", "vec_id"), "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return work.write(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "result")


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a, n b WHERE a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) >= 0.9 * a.n * b.n),
c AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT c.node, l.b FROM c JOIN l ON c.seen = l.a),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY 1), d AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON node = vec_id LEFT JOIN d ON a = vec_id
"""
