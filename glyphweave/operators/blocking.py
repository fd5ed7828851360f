"""Candidate pairs by agreement on keys. Rows are named by an id column; pairs come as x_id, y_id and pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import lit

from glyphweave.functions.udf import ColumnLike, col
from glyphweave.operators.components import connected_components
from glyphweave.operators.prefix import with_running

Key = ColumnLike | Sequence[ColumnLike]
#: Records of a side that meet those of the other in one row, about.
CHUNK = 1024


def key_of(key: Key) -> Column:
    """One column of a key's terms; null if any of them is."""
    if isinstance(key, (str, Column)):
        return col(key)
    terms = [col(k) for k in key]
    known = reduce(lambda a, b: a & b, [t.isNotNull() for t in terms])
    return F.when(known, F.struct(*[t.alias(f"t{i}") for i, t in enumerate(terms)]))


def _keyed(df: DataFrame, id_col: str, key: Key, name: str) -> DataFrame:
    return df.select(F.col(id_col).alias(name), key_of(key).alias("key")).where("key is not null")


def block_sizes(x: DataFrame, id_x: str, key_x: Key, y: DataFrame | None = None, id_y: str | None = None, key_y: Key | None = None) -> DataFrame:
    """(key, n_1, n_2, pairs) of every key that makes a pair. Records are counted before anything is joined."""
    a = _keyed(x, id_x, key_x, "id").groupBy("key").agg(F.count(lit(1)).alias("n_1"))
    if y is None:
        return a.where("n_1 > 1").select("key", "n_1", lit(0).cast("long").alias("n_2"), F.expr("n_1 * (n_1 - 1) div 2").alias("pairs"))
    b = _keyed(y, id_y or id_x, key_x if key_y is None else key_y, "id").groupBy("key").agg(F.count(lit(1)).alias("n_2"))
    return a.join(b, "key").withColumn("pairs", F.col("n_1") * F.col("n_2"))


def _sided(df: DataFrame, id_col: str, keys: Sequence[Key], name: str, carry: Mapping[str, Column], most: Sequence[DataFrame] | None) -> DataFrame:
    """Ids, all keys k1, k2, ... and carried values of one table; keys of too large blocks become null."""
    out = df.select(F.col(id_col).alias(name), *[key_of(k).alias(f"__k{i}") for i, k in enumerate(keys, 1)], *[v.alias(n) for n, v in carry.items()])
    for i, large in enumerate(most or [], 1):
        marked = out.join(large.select(F.col("key").alias(f"__k{i}"), lit(True).alias("__large")), f"__k{i}", "left")
        out = marked.withColumn(f"__k{i}", F.when(F.col("__large").isNull(), F.col(f"__k{i}"))).drop("__large").select(*out.columns)
    return out


def shares(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``rows`` with the number of parts of about ``CHUNK`` records that the rows alike in ``by`` make.

    Joined is a table of the larger groups only: at most one row for ``CHUNK`` rows.
    """
    group = F.struct(*by)
    large = rows.groupBy(group.alias("__group")).agg(F.count(lit(1)).alias("__n")).where(F.col("__n") > CHUNK)
    parts = F.coalesce(F.ceil(F.col("__n") / CHUNK), lit(1)).alias(name)
    return rows.join(large, group == F.col("__group"), "left").select(*rows.columns, parts)


def _streamed(array: str) -> Column:
    """The same array out of an expression that has no generated code: what explodes it then hands on row by row.

    Generated code holds all rows that it makes of one row: of nested arrays in one loop, those of all their pairs.
    """
    return F.transform(array, lambda v: v)


def _packs(side: DataFrame, id_col: str, own_id: str, pass_: int, carry: Sequence[str], within: bool) -> DataFrame:
    """Rows of one side as packs: key, pack number and an array of classes (ids, earlier keys and carried values; all names begin with the side's)."""
    earlier = [f"__k{j}" for j in range(1, pass_)]
    rows = side.select(F.col(id_col).alias(own_id), F.col(f"__k{pass_}").alias("__key"), F.struct(lit(0).alias("__none"), *earlier, *carry).alias("__class")).where("__key is not null")
    rows = rows.where(F.col(own_id).isNotNull()) if within else rows  # an id that is null is not below another
    rows = shares(shares(rows, ["__key", "__class"], "__of_class"), ["__key"], "__of_key")
    share = F.when(F.col("__of_class") > 1, F.pmod(F.xxhash64(own_id), F.col("__of_class"))).otherwise(lit(0).cast("long")).alias("__share")
    rows = rows.select("*", share).select("*", F.pmod(F.xxhash64("__class", "__share"), F.col("__of_key")).alias("__pack"))
    ids = F.collect_list(own_id)
    if not within:
        ids = F.concat(ids, F.array_repeat(lit(None).cast(side.schema[id_col].dataType), (F.count(lit(1)) - F.count(own_id)).cast("int")))
    classes = rows.groupBy("__key", "__pack", "__class", "__share").agg(ids.alias("__ids"))
    s = f"__{own_id[0]}"
    members = F.collect_list(F.struct(F.col("__ids").alias(f"{s}_ids"), *[F.col(f"__class.{c}").alias(f"{s}_{c}") for c in (*earlier, *carry)]))
    return classes.groupBy(F.col("__key"), F.col("__pack").alias(f"{s}_pack")).agg(members.alias(f"{s}_members"))


def class_pairs(
    x: DataFrame, keys: Sequence[Key], id_x: str, y: DataFrame | None = None, keys_y: Sequence[Key] | None = None, id_y: str | None = None, max_block_size: float | None = None,
    carry: Mapping[str, Column] | None = None, carry_y: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``block_pairs`` before it names pairs of records: x_ids and y_ids, arrays, of records alike in the keys and carried values, and pass.

    What depends on carried values alone is computed here, once for all records that share them; ``expand`` then
    makes the pairs. Classes of a key are dealt to packs of about ``CHUNK`` records, packs meet, and the pairs of packs are dealt to
    all tasks, so that neither a common key nor a common value makes a long task, and no array is much longer than a pack.
    """
    other, own_y, carry, carry_y = keys if keys_y is None else keys_y, id_y or id_x, carry or {}, carry_y or {}
    large, spark = None, x.sparkSession
    if max_block_size is not None:
        large = [block_sizes(x, id_x, kx, y, own_y, ky).where(F.col("n_1") + F.col("n_2") > max_block_size).select("key") for kx, ky in zip(keys, other, strict=True)]
    a = _sided(x, id_x, keys, "x_id", carry, large)
    b = _sided(x if y is None else y, own_y, other, "y_id", carry_y, large)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    passes = []
    for i in range(1, len(keys) + 1):
        left, right = (_packs(d, e, e, i, list(c), y is None) for d, e, c in ((a, "x_id", carry), (b, "y_id", carry_y)))
        met = left.join(right, "__key").repartition(tasks, F.xxhash64("__key", "__x_pack", "__y_pack"))
        # inline, as fields of exploded structs can be lost between filters in Spark 4.1
        found = met.select(F.inline(_streamed("__x_members")), "__y_members").select("*", F.inline("__y_members"))
        for j in range(1, i):
            found = found.where(~F.coalesce(F.col(f"__x___k{j}") == F.col(f"__y___k{j}"), lit(False)))
        passes.append(found.select(F.col("__x_ids").alias("x_ids"), F.col("__y_ids").alias("y_ids"), lit(i).alias("pass"), *[F.col(f"__x_{c}").alias(c) for c in carry], *[F.col(f"__y_{c}").alias(c) for c in carry_y]))
    return reduce(DataFrame.unionByName, passes)


def expand(classes: DataFrame, within: bool = True) -> DataFrame:
    """x_id, y_id and the other columns of every pair of records of class pairs; within one table x_id < y_id."""
    rest = [c for c in classes.columns if c not in ("x_ids", "y_ids")]
    found = classes.select(F.explode(_streamed("x_ids")).alias("x_id"), "y_ids", *rest).select("x_id", F.explode("y_ids").alias("y_id"), *rest)
    return found.where("x_id < y_id") if within else found


def spanning(classes: DataFrame) -> DataFrame:
    """Pairs x_id, y_id of one table that connect what all pairs of these class pairs connect, about one a record and one a pair of classes.

    For conditions that hold in both orders: then all records of two classes that meet, and of a class that meets another
    or, with several records, itself, are connected.
    """
    least = classes.select("x_ids", F.array_min("x_ids").alias("x_id"), F.array_min("y_ids").alias("y_id")).where((F.col("x_id") != F.col("y_id")) | (F.size("x_ids") > 1))
    own = least.groupBy("x_id").agg(F.first("x_ids").alias("x_ids")).select("x_id", F.explode("x_ids").alias("y_id"))
    return least.where("x_id < y_id").select("x_id", "y_id").unionByName(own.where("x_id < y_id"))


def block_pairs(
    x: DataFrame, keys: Sequence[Key], id_x: str, y: DataFrame | None = None, keys_y: Sequence[Key] | None = None, id_y: str | None = None, max_block_size: float | None = None,
    carry: Mapping[str, Column] | None = None, carry_y: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Pairs that agree on any of the keys, with the first pass that finds them; within one table x_id < y_id.

    Each pass is one equi-join that carries all keys, and leaves out pairs that agree on an earlier one; so pairs
    are never shuffled to be united. ``carry`` and ``carry_y`` name values of both tables that go along. A null in any
    term of a key matches nothing; ids are different. Blocks of more records (of both tables) than
    ``max_block_size`` are passed over: that is this parameter's purpose, and its default is no limit.
    """
    return expand(class_pairs(x, keys, id_x, y, keys_y, id_y, max_block_size, carry, carry_y), y is None)


def ranked(values: DataFrame, name: str = "key") -> DataFrame:
    """(key, rank) of the different values of a table's column in their order.

    Values are counted in ranges first, so that no task orders all of them.
    """
    keys = values.select(F.col(name)).where(F.col(name).isNotNull()).distinct().withColumn("one", lit(1))
    return with_running(keys, name, {"rank": "one"}).select(name, "rank")


def sorted_neighbourhood(x: DataFrame, keys: Sequence[Key], id_x: str, y: DataFrame | None = None, keys_y: Sequence[Key] | None = None, id_y: str | None = None, window: int = 3) -> DataFrame:
    """Pairs whose keys are at most (window - 1) / 2 places apart among the different keys of both tables in order."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the window is odd")
    half, other, passes = (window - 1) // 2, keys if keys_y is None else keys_y, []
    for i, (kx, ky) in enumerate(zip(keys, other, strict=True), 1):
        a = _keyed(x, id_x, kx, "x_id")
        b = a.withColumnRenamed("x_id", "y_id") if y is None else _keyed(y, id_y or id_x, ky, "y_id")
        places = ranked(a.select("key") if y is None else a.select("key").unionByName(b.select("key")))
        near = a.join(places, "key").select("x_id", F.explode(F.sequence(F.col("rank") - half, F.col("rank") + half)).alias("rank"))
        found = near.join(b.join(places, "key").select("y_id", "rank"), "rank")
        passes.append((found.where("x_id < y_id") if y is None else found).select("x_id", "y_id", lit(i).alias("pass")))
    return reduce(DataFrame.unionByName, passes).groupBy("x_id", "y_id").agg(F.min("pass").alias("pass"))


def blocking_report(x: DataFrame, keys: Sequence[Key], id_x: str, y: DataFrame | None = None, keys_y: Sequence[Key] | None = None, id_y: str | None = None, max_block_size: float | None = None) -> DataFrame:
    """Per pass: records without a key, different keys, largest block, blocks passed over, expected pairs."""
    other, rows = keys if keys_y is None else keys_y, []
    for i, (kx, ky) in enumerate(zip(keys, other, strict=True), 1):
        a = x.agg(F.count(F.when(key_of(kx).isNull(), 1)).alias("missing_1"), F.countDistinct(key_of(kx)).alias("distinct_1"))
        b = None if y is None else y.agg(F.count(F.when(key_of(ky).isNull(), 1)).alias("missing_2"))
        size = F.col("n_1") + F.col("n_2")
        over = lit(False) if max_block_size is None else size > max_block_size
        told = block_sizes(x, id_x, kx, y, id_y, ky).agg(
            F.coalesce(F.max(size), lit(0)).alias("largest"), F.count(F.when(over, 1)).alias("skipped"), F.coalesce(F.sum(F.when(~over, F.col("pairs"))), lit(0)).alias("expected_pairs")
        )
        row = a.crossJoin(told) if b is None else a.crossJoin(told).crossJoin(b)  # one row each
        rows.append(row.select(lit(i).alias("pass"), "missing_1", (lit(0).cast("long") if b is None else F.col("missing_2")).alias("missing_2"), "distinct_1", "largest", "skipped", "expected_pairs"))
    return reduce(DataFrame.unionByName, rows)


def largest_blocks(x: DataFrame, key: Key, id_x: str, y: DataFrame | None = None, key_y: Key | None = None, id_y: str | None = None, n: int = 5) -> DataFrame:
    """The keys that make most pairs."""
    return block_sizes(x, id_x, key, y, id_y, key_y).orderBy(F.desc("pairs"), "key").limit(n)


def cluster_pairs(pairs: DataFrame, i: str = "x_id", j: str = "y_id", records: DataFrame | None = None, id_col: str | None = None) -> DataFrame:
    """(id, component, cluster) of every linked record and, with ``records``, of all: component is the smallest id, clusters count from 1 in its order."""
    linked = connected_components(pairs.sparkSession, pairs.select(i, j)).select(F.col("node").alias("id"), "component")
    alone = None if records is None else records.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    if alone is not None:
        linked = alone.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    else:
        loops = pairs.select(F.explode(F.array(i, j)).alias("id")).distinct()
        linked = loops.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return linked.join(ranked(linked, "component").withColumnRenamed("rank", "cluster"), "component").select("id", "component", "cluster")


def unmatched(records: DataFrame, id_col: str, pairs: DataFrame, side: str = "x_id") -> DataFrame:
    """Records of one side that no pair reaches."""
    return records.join(pairs.select(F.col(side).alias("__reached")).distinct(), F.col(id_col) == F.col("__reached"), "left_anti")
