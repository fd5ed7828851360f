"""URL filter: rules first, then the ratio of two character language models.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest rule
that fits decides. URLs that a rule decides train two variable-order Markov models, one of accepted and one
of rejected URLs: counts of each context of up to ``ORDER`` characters and the character behind it, smoothed
by interpolation with shorter contexts (Witten-Bell). A URL without a rule is judged by the difference of its
log-likelihoods under both models, divided by its length, against a threshold calibrated on a fold of
decided URLs that the models have not seen.

The models are tables that grow with the different n-grams of the input: each row is a context with the
character behind it, exactly, as a number of ``BITS`` bits a character, and its counts. Those of shorter
contexts are sums over longer ones. Nothing of them is collected or broadcast: URLs lie in chunks of at most
``ROWS``, and each chunk is joined with the n-grams that it holds.

Defined results: a null url, and one without ``://``, has an empty host and path and fits no rule; a text
without characters says nothing for either model and is allowed, as are all URLs while no rule has decided
any on both sides; ties at the threshold are allowed; repeated rows are judged each by itself; an empty
table gives an empty result. Of the input only the id and the url are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphweave.llm.text import slices, utf8, with_distinct
from glyphweave.workdir import Work

ORDER = 4
#: Bits of a character in an n-gram: a byte and one more, 0 for none. Rows of a chunk, as bits.
BITS, ROWS = 9, 11
#: Bytes of a url that a task holds at a time, and steps of the calibration.
CHUNK, STEPS = 1 << 18, 2001
SPAN = 4.0

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path; both empty if there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. Rules are few, so they are part of the plan."""
    out = None
    for verdict, name, begin in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block")):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(begin)
        value = F.struct(F.lit(name + begin).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return none if out is None else out.otherwise(none)


def _grams(body: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number of the ``order`` characters before it and itself, the last in the lowest bits."""
    place = np.arange(len(body)) - np.repeat(offsets[:-1], np.diff(offsets))
    value, out = body.astype(np.int64) + 1, np.zeros(len(body), np.int64)
    for k in range(min(order, len(body) - 1) + 1):
        out[k:] |= np.where(place[k:] >= k, value[: len(body) - k], 0) << (BITS * k)
    return out


def _uses(order: int):
    """From (chunk, url, side): the different n-grams of each chunk, and how often sides 0 and 1 hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, "url", CHUNK)):
            body, offsets = utf8(batch.column(1))
            if not len(body):
                continue
            many = lambda i: np.repeat(batch.column(i).to_numpy(), np.diff(offsets))  # noqa: B023, E731
            # the side goes below the n-gram, so one sort counts both; parts of a chunk in several slices are summed later
            chunk, both, n = with_distinct(many(0), (_grams(body, offsets, order) << 2) | many(2))
            side = both & 3
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(both >> 2), pa.array(np.where(side == 0, n, 0)), pa.array(np.where(side == 1, n, 0))], ["chunk", "gram", "n0", "n1"])

    return run


def _odds(work: Work, grams: DataFrame, order: int) -> DataFrame:
    """From (gram, n0, n1): log-probability of each n-gram's last character on side 0, less that on side 1.

    Each n-gram meets that without its first character, and those with its context; both are at most 257 rows a key.
    """
    tables = [grams]
    for k in range(order, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        tables.append(work.write(tables[-1].groupBy(low.alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams"))
    shorter = None
    for k, table in enumerate(reversed(tables)):
        context = Window.partitionBy(F.shiftright("gram", BITS))
        table = table.withColumns({f"{name}{s}": of.over(context) for s in (0, 1) for name, of in (("c", F.sum(f"n{s}")), ("kinds", F.count_if(F.col(f"n{s}") > 0)))})
        if k:
            low = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
            table = table.withColumn("low", low).join(shorter.select(F.col("gram").alias("low"), "p0", "p1"), "low")
        for s in (0, 1):
            before, n = F.col(f"p{s}") if k else F.lit(1 / 256), F.col(f"c{s}")
            kinds = F.col(f"kinds{s}")
            smoothed = (F.col(f"n{s}") + kinds * before) / (n + kinds)
            table = table.withColumn(f"p{s}", F.when(n > 0, smoothed).otherwise(before if k else F.lit(1e-12)))
        shorter = work.write(table.select("gram", "p0", "p1"), "chances")
    return shorter.select("gram", (F.log("p0") - F.log("p1")).alias("odds"))


def _score(order: int):
    """Rows of a chunk with the mean odds of their bytes; 0 without bytes."""

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        body, offsets = utf8(rows["url"])
        total = np.zeros(rows.num_rows)
        if len(body):
            known = known.sort_by("gram")
            odds = known["odds"].to_numpy()[np.searchsorted(known["gram"].to_numpy(), _grams(body, offsets, order))]
            total = np.bincount(np.repeat(np.arange(rows.num_rows), np.diff(offsets)), odds, rows.num_rows)
        return rows.drop_columns(["chunk"]).append_column("score", pa.array(total / np.maximum(np.diff(offsets), 1)))

    return run


def url_filter(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, score (accepted less rejected, per character)."""
    if not 0 <= order <= 5:
        raise ValueError("order must be from 0 to 5")  # so many characters fit a bigint
    work = Work(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules))
    rows = rows.select("page_id", "url", "host", "path", "found.rule", F.col("found.verdict").alias("ruled"), F.shiftright(F.monotonically_increasing_id(), ROWS).alias("chunk"))
    rows = work.write(rows, "rows")
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    side = F.when(F.col("ruled").isNull() | held, 2).otherwise((F.col("ruled") == "block").cast("int")).cast("bigint")  # 2 is not learnt from
    uses = rows.where("url is not null").select("chunk", "url", side.alias("side")).mapInArrow(_uses(order), "chunk bigint, gram bigint, n0 bigint, n1 bigint")
    uses = work.write(uses.groupBy("chunk", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "uses")
    grams = work.write(uses.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    learnt = grams.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
    known = uses.select("chunk", "gram").join(_odds(work, grams, order), "gram")
    kinds = "page_id bigint, url string, host string, path string, rule string, ruled string, score double"
    scored = work.write(rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(order), kinds), "scored")
    threshold = -np.inf
    if learnt["n0"] and learnt["n1"]:
        step = F.least(F.greatest(F.round((F.col("score") + SPAN) / (2 * SPAN) * (STEPS - 1)), F.lit(0)), F.lit(STEPS - 1)).cast("int").alias("step")
        decided = scored.where(F.col("ruled").isNotNull() & held)
        found = decided.groupBy((F.col("ruled") == "block").cast("int").alias("side"), step).count().collect()  # at most 2 * STEPS rows
        tally = np.zeros((2, STEPS), np.int64)
        for r in found:
            tally[r["side"], r["step"]] = r["count"]
        if tally.sum(1).all():
            kept = np.cumsum(tally[0][::-1])[::-1] / tally[0].sum()
            gone = np.concatenate([[0], np.cumsum(tally[1])[:-1]]) / tally[1].sum()
            best = np.flatnonzero(kept + gone == (kept + gone).max())
            threshold = best[len(best) // 2] / (STEPS - 1) * 2 * SPAN - SPAN
        else:
            threshold = 0.0
    allowed = (F.col("score") >= float(threshold)) | (F.length(F.coalesce("url", F.lit(""))) == 0)
    return work.write(scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(allowed, "allow").otherwise("block")).alias("verdict"), "score"), "result")
