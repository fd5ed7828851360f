"""Similarity joins and best-match lookup of one table's texts in another's.

All take (queries, table) with the names of their id and text columns and work on the different texts first,
so repeated texts are compared once. Results carry ``query_id`` and ``table_id``; ties go to the smaller table id.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions import similarity as sim
from glyphweave.functions.fuzz import fuzz_cpdist
from glyphweave.functions.udf import each

EDITS = {"levenshtein": sim.levenshtein, "osa": sim.osa_distance, "damerau_levenshtein": sim.damerau_levenshtein}


def _named(df: DataFrame, id_col: str, text_col: str, prefix: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{prefix}_id"), F.col(text_col).alias(f"{prefix}_text"))


def _best(scored: DataFrame, query: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """From scored different texts to the n best rows of the table for every query row.

    A table text's first n ids are enough, and each query text keeps n texts before rows are joined.
    """
    order = Window.partitionBy("query_text").orderBy(F.desc("score"), "first_id")
    few = Window.partitionBy("table_text").orderBy("table_id")
    rows = table.withColumn("k", F.row_number().over(few)).where(F.col("k") <= n).drop("k")
    firsts = table.groupBy("table_text").agg(F.min("table_id").alias("first_id"))
    kept = scored.join(firsts, "table_text").withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k", "first_id")
    ids = kept.join(rows, "table_text").withColumn("rank", F.row_number().over(Window.partitionBy("query_text").orderBy(F.desc("score"), "table_id"))).where(F.col("rank") <= n)
    return query.join(ids, "query_text").select("query_id", "table_id", "query_text", "table_text", "score", "rank")


def fuzzy_top_n(
    queries: DataFrame, table: DataFrame, query_id: str, query_text: str, table_id: str, table_text: str, method: str = "jaro_winkler", top_n: int = 5,
    p: float = 0.1, min_score: float = 0, max_distance: float | None = None, match_na: bool = False, use_bytes: bool = False,
) -> DataFrame:
    """The best rows of the table for every query by a similarity from 0 to 1.

    With a largest number of edits up to 3, candidates come from the index of ``fuzzy_within``; else every different query
    is compared with every different text of the table that lengths do not rule out. ``match_na`` lets nulls
    match nulls.
    """
    q, t = _named(queries, query_id, query_text, "query"), _named(table, table_id, table_text, "table")
    left, right = q.where("query_text is not null").select("query_text").distinct(), t.where("table_text is not null").select("table_text").distinct()
    x, y = sim.units("query_text", use_bytes), sim.units("table_text", use_bytes)
    long, short = F.greatest(F.char_length(x), F.char_length(y)), F.least(F.char_length(x), F.char_length(y))
    if method == "jaro_winkler":
        if max_distance is not None:
            raise ValueError("max_distance goes with edit distances")
        bound = F.when(long == 0, lit(1.0)).otherwise((2 + short / long) / 3)  # of Jaro with all of the shorter text matched
        scored = left.crossJoin(right).where(bound + 4 * p * (1 - bound) >= min_score).withColumn("score", sim.jaro_winkler("query_text", "table_text", p, use_bytes))
    else:
        if max_distance is not None and max_distance <= 3:
            near = _within(left, right, int(max_distance), 7, use_bytes)
        else:
            near = left.crossJoin(right).where((long - short <= (max_distance if max_distance is not None else 1 << 30)) & (F.when(long == 0, lit(1.0)).otherwise(short / long) >= min_score))
        near = near.withColumn("distance", EDITS[method]("query_text", "table_text", use_bytes))
        if max_distance is not None:
            near = near.where(F.col("distance") <= max_distance)
        scored = near.withColumn("score", F.when(long == 0, lit(1.0)).otherwise(F.greatest(lit(0.0), 1 - F.col("distance") / long))).drop("distance")
    out = _best(scored.where(F.col("score") >= min_score), q, t, top_n)
    if match_na:
        none = q.where("query_text is null").withColumn("table_text", lit(None).cast("string"))
        few = t.where("table_text is null").select("table_id").orderBy("table_id").limit(top_n).withColumn("rank", F.row_number().over(Window.orderBy("table_id")))
        out = out.unionByName(none.crossJoin(F.broadcast(few)).withColumn("score", lit(1.0)))  # at most top_n rows
    return out


def fuzzy_match(queries: DataFrame, table: DataFrame, query_id: str, query_text: str, table_id: str, table_text: str, **options: object) -> DataFrame:
    """(query_id, table_id, score) of the best match, nulls where there is none."""
    best = fuzzy_top_n(queries, table, query_id, query_text, table_id, table_text, top_n=1, **options).select("query_id", "table_id", "score")
    return queries.select(F.col(query_id).alias("query_id")).join(best, "query_id", "left")


def deletions(text: str, most: int, prefix: int) -> list[str]:
    """The prefix of a text and all that deleting up to ``most`` of its characters leaves."""
    head = text[:prefix]
    return list({"".join(kept) for n in range(min(most, len(head)) + 1) for kept in combinations(head, len(head) - n)})


def _within(left: DataFrame, right: DataFrame, most: int, prefix: int, use_bytes: bool) -> DataFrame:
    """Pairs of texts that share a prefix after deletions; every pair within ``most`` edits is among them."""
    variants = each("array<string>", deletions, most, prefix)
    a = left.select("query_text", F.explode(variants(sim.units("query_text", use_bytes))).alias("key"))
    b = right.select("table_text", F.explode(variants(sim.units("table_text", use_bytes))).alias("key"))
    sized = F.abs(F.char_length(sim.units("query_text", use_bytes)) - F.char_length(sim.units("table_text", use_bytes))) <= most
    return a.join(b, "key").where(sized).select("query_text", "table_text").distinct()


def fuzzy_within(
    queries: DataFrame, table: DataFrame, query_id: str, query_text: str, table_id: str, table_text: str,
    max_distance: int = 1, method: str = "osa", prefix_length: int = 7, use_bytes: bool = False,
) -> DataFrame:
    """(query_id, table_id, distance) of all pairs within so many edits, by an index of deletions."""
    if not 0 <= max_distance <= 8 or prefix_length <= max_distance:
        raise ValueError("up to 8 edits, and prefixes longer than that")
    q, t = _named(queries, query_id, query_text, "query"), _named(table, table_id, table_text, "table")
    near = _within(q.select("query_text").distinct(), t.select("table_text").distinct(), max_distance, prefix_length, use_bytes)
    if method == "levenshtein":
        near = near.withColumn("distance", F.levenshtein(sim.units("query_text", use_bytes), sim.units("table_text", use_bytes), max_distance)).where("distance >= 0")
    else:
        near = near.withColumn("distance", EDITS[method]("query_text", "table_text", use_bytes)).where(F.col("distance") <= max_distance)
    return near.join(q, "query_text").join(t, "table_text").select("query_id", "table_id", F.col("distance").cast("int").alias("distance"))


def _gram_counts(df: DataFrame, text: str, q: int, use_bytes: bool) -> DataFrame:
    """(text, gram, n); a text shorter than a gram is one."""
    x = sim.units(text, use_bytes)
    own = F.when(F.char_length(x) < q, F.array(x)).otherwise(sim.grams(x, q))
    return df.select(text, F.explode(F.filter(own, lambda g: g != "")).alias("gram")).groupBy(text, "gram").agg(F.count(lit(1)).alias("n"))


def tfidf_top_n(
    queries: DataFrame, table: DataFrame, query_id: str, query_text: str, table_id: str, table_text: str, top_n: int = 5, q: int = 3, min_score: float = 0, use_bytes: bool = False,
) -> DataFrame:
    """Best rows by the cosine of character grams weighted by ln((1 + N) / (1 + df)) + 1 over the table's rows."""
    left, right = _named(queries, query_id, query_text, "query"), _named(table, table_id, table_text, "table").where("table_text is not null")
    times = right.groupBy("table_text").agg(F.count(lit(1)).alias("times"))
    held = _gram_counts(times, "table_text", q, use_bytes)
    seen = held.join(times, "table_text").groupBy("gram").agg(F.sum("times").alias("df"))
    rows = times.agg(F.coalesce(F.sum("times"), lit(0)).alias("rows"))
    weights = seen.crossJoin(F.broadcast(rows)).select("gram", (F.log((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    asked = _gram_counts(left.where("query_text is not null").select("query_text").distinct(), "query_text", q, use_bytes)
    unknown = F.log(lit(1.0) + F.col("rows")) + 1
    asked = asked.join(weights, "gram", "left").crossJoin(F.broadcast(rows)).select("query_text", "gram", (F.col("n") * F.coalesce("idf", unknown)).alias("w"))
    held = held.join(weights, "gram").select("table_text", "gram", (F.col("n") * F.col("idf")).alias("v"))
    norm_a, norm_b = asked.groupBy("query_text").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("nw")), held.groupBy("table_text").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("nv"))
    dot = asked.join(held, "gram").groupBy("query_text", "table_text").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dot.join(norm_a, "query_text").join(norm_b, "table_text").select("query_text", "table_text", F.least(lit(1.0), F.col("dot") / (F.col("nw") * F.col("nv"))).alias("score"))
    scored = scored.withColumn("score", F.round("score", 12))  # sums come in any order
    return _best(scored.where(F.col("score") >= min_score), left, right, top_n)


def tfidf_match(queries: DataFrame, table: DataFrame, query_id: str, query_text: str, table_id: str, table_text: str, **options: object) -> DataFrame:
    """(query_id, table_id, score) of the best match, nulls where no gram is shared."""
    best = tfidf_top_n(queries, table, query_id, query_text, table_id, table_text, top_n=1, **options).select("query_id", "table_id", "score")
    return queries.select(F.col(query_id).alias("query_id")).join(best, "query_id", "left")


def fuzz_extract(
    queries: DataFrame, choices: DataFrame, query_id: str, query_text: str, choice_id: str, choice_text: str, scorer: str = "wratio", limit: int = 5, full_process: bool = True, score_cutoff: float = 0,
) -> DataFrame:
    """The best choices of every query by a score from 0 to 100."""
    q, t = _named(queries, query_id, query_text, "query"), _named(choices, choice_id, choice_text, "table").where("table_text is not null")
    left, right = q.where("query_text is not null").select("query_text").distinct(), t.select("table_text").distinct()
    scored = left.crossJoin(right).withColumn("score", fuzz_cpdist("query_text", "table_text", scorer, full_process, score_cutoff))
    found = _best(scored.where(F.col("score") >= score_cutoff), q, t, limit)
    return found.select("query_id", F.col("table_id").alias("choice_id"), F.col("table_text").alias("choice"), "score", "rank")


def fuzz_extract_one(queries: DataFrame, choices: DataFrame, query_id: str, query_text: str, choice_id: str, choice_text: str, **options: object) -> DataFrame:
    """The best choice of every query, nulls where there is none."""
    best = fuzz_extract(queries, choices, query_id, query_text, choice_id, choice_text, limit=1, **options).drop("rank")
    return queries.select(F.col(query_id).alias("query_id")).join(best, "query_id", "left")


def fuzz_cdist(queries: DataFrame, choices: DataFrame, query_id: str, query_text: str, choice_id: str, choice_text: str, scorer: str = "ratio", full_process: bool = True, score_cutoff: float = 0) -> DataFrame:
    """All scores in long form: row_id, col_id, score."""
    return sim.matrix(lambda a, b: fuzz_cpdist(a, b, scorer, full_process, score_cutoff), queries, choices, query_id, query_text, choice_id, choice_text)


def _chance(bands: int, rows: int, low: float, high: float, miss: bool) -> float:
    """Area, between two similarities, of the chance to be (or not to be) a candidate."""
    n = 1000
    step = (high - low) / n
    each_ = ((1 - (1 - (low + (i + 0.5) * step) ** rows) ** bands) for i in range(n))
    return sum((1 - c if miss else c) for c in each_) * step


def banding(threshold: float, n_hash: int = 128, weights: tuple[float, float] = (0.5, 0.5)) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of false candidates and misses."""
    best, found = math.inf, (1, 1)
    for b in range(1, n_hash + 1):
        for r in range(1, n_hash // b + 1):
            cost = weights[0] * _chance(b, r, 0, threshold, False) + weights[1] * _chance(b, r, threshold, 1, True)
            if cost < best - 1e-12:
                best, found = cost, (b, r)
    return found


def _signatures(df: DataFrame, text: str, q: int, bands: int, rows: int, seed: int, use_bytes: bool) -> DataFrame:
    """(text, band key) of every different text: minima of seeded hashes, and the hash of each band of minima."""
    x = sim.units(text, use_bytes)
    own = F.when(F.char_length(x) < q, F.array(x)).otherwise(F.array_distinct(sim.grams(x, q)))
    seeds = F.sequence(lit(0), lit(bands * rows - 1))
    minima = F.transform(seeds, lambda s: F.array_min(F.transform(F.col("grams"), lambda g: F.xxhash64(g, s + seed * 1000003))))
    held = df.select(text, own.alias("grams")).where(F.size("grams") > 0).select(text, minima.alias("minima"))
    keys = F.transform(F.sequence(lit(0), lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(F.col("minima"), b * rows + 1, lit(rows))))
    return held.select(text, F.explode(keys).alias("key"))


def _jaccard(a: str, b: str, q: int, use_bytes: bool) -> Column:
    x, y = sim.units(a, use_bytes), sim.units(b, use_bytes)
    sets = [F.when(F.char_length(c) < q, F.array(c)).otherwise(F.array_distinct(sim.grams(c, q))) for c in (x, y)]
    return F.size(F.array_intersect(*sets)) / F.size(F.array_union(*sets))


def _bands(threshold: float, n_hash: int, bands: int | None, weights: tuple[float, float]) -> tuple[int, int]:
    return (bands, n_hash // bands) if bands else banding(threshold, n_hash, weights)


def minhash_pairs(
    x: DataFrame, id_col: str, text_col: str, y: DataFrame | None = None, threshold: float = 0.5, q: int = 3, n_hash: int = 128, bands: int | None = None,
    weights: tuple[float, float] = (0.5, 0.5), seed: int = 1, verify: bool = True, use_bytes: bool = False,
) -> DataFrame:
    """(x_id, y_id, similarity) of likely pairs of gram sets with this Jaccard index; verified, those that have it.

    Rows of one table are paired with the smaller id first. Equal texts are one node until ids are joined.
    """
    b, r = _bands(threshold, n_hash, bands, weights)
    left = x.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("x_id"), F.col(text_col).alias("x_text"))
    right = left.select(F.col("x_id").alias("y_id"), F.col("x_text").alias("y_text")) if y is None else y.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("y_id"), F.col(text_col).alias("y_text"))
    keys_x = _signatures(left.select("x_text").distinct(), "x_text", q, b, r, seed, use_bytes)
    keys_y = _signatures(right.select("y_text").distinct(), "y_text", q, b, r, seed, use_bytes)
    near = keys_x.join(keys_y, "key")
    if y is None:
        near = near.where("x_text <= y_text")
    near = near.select("x_text", "y_text").distinct().withColumn("similarity", _jaccard("x_text", "y_text", q, use_bytes))
    if verify:
        near = near.where(F.col("similarity") >= threshold)
    if y is None:
        near = near.unionByName(near.where("x_text <> y_text").select(F.col("y_text").alias("x_text"), F.col("x_text").alias("y_text"), "similarity"))
    found = near.join(left, "x_text").join(right, "y_text")
    return (found.where("x_id < y_id") if y is None else found).select("x_id", "y_id", "similarity")

