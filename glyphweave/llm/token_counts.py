"""Token counts of a corpus as an exact histogram of encoded lengths.

Documents are aggregated by encoded length; sums over the longer lengths then answer totals, quantiles
and truncated totals for every context limit, without another look at the texts.

Defined results: null and empty texts have length 0 and form a row of their own; repeated rows count each
time; an empty table gives an empty histogram. Of the input only the text is read. Prefix sums run over
blocks of lengths, so no task sees more than one block of lengths or the list of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphweave.llm.bpe import MEMORY, chunks, load_ranks
from glyphweave.llm.text import slices
from glyphweave.workdir import Work

#: Lengths in a block of the prefix sums.
BLOCK = 4096


class _Counts(dict):
    """Chunk -> number of tokens."""

    def __init__(self, path: str, pattern: str):
        self.encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})

    def __missing__(self, chunk: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[chunk] = n = len(self.encoder.encode_ordinary(chunk))
        return n


_COUNTS: dict[tuple[str, str], _Counts] = {}


def token_lengths(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(n_tokens) of every row, in no order."""
    key = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTS:
            _COUNTS[key] = _Counts(*key)
        get = _COUNTS[key].__getitem__
        for batch in (x for b in batches for x in slices(b)):
            n = [sum(map(get, chunks(text or ""))) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "n_tokens bigint")


def length_histogram(counts: DataFrame) -> DataFrame:
    """From (n_tokens, n_docs), one row a length: n_tokens, n_docs, docs_at_least, tokens_at_least, docs_up_to, truncated_total.

    ``*_at_least`` are sums over this and all longer lengths; ``truncated_total`` is the number of tokens
    that are left when each document is cut to this length; ``docs_up_to`` over all documents gives quantiles.
    """
    counts = counts.withColumn("tokens", F.col("n_docs") * F.col("n_tokens"))
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    whole, above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("block_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("block_docs").over(whole).alias("docs_all"), F.sum("block_tokens").over(whole).alias("tokens_all"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(blocks, "block")
    out = out.withColumn("docs_at_least", F.col("d") + F.col("docs_above")).withColumn("tokens_at_least", F.col("t") + F.col("tokens_above"))
    return out.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least",
        (F.col("docs_all") - F.col("docs_at_least") + F.col("n_docs")).alias("docs_up_to"),
        (F.col("tokens_all") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_total"),
    )


def token_counts(docs: DataFrame, text_col: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """The histogram of the encoded lengths of all texts."""
    work = Work(docs.sparkSession, "lengths")
    counted = token_lengths(docs, text_col, ranks, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    return length_histogram(work.write(counted, "counts"))


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context, total, n_cut): tokens that are left when each document is cut to a limit, and how many are cut. Limits need not be lengths that occur."""
    over = F.col("n_tokens") > F.col("context")
    told = histogram.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context bigint")
    each = histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(limits))])).alias("context"))
    sums = each.groupBy("context").agg(F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("total"), F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("n_cut"))
    return F.broadcast(told).join(sums, "context", "left").select("context", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n_cut", F.lit(0)).alias("n_cut"))


def quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of all documents do not exceed; none where there is no document."""
    told = histogram.sparkSession.createDataFrame([(float(x),) for x in sorted(set(shares))], "share double")
    each = histogram.select("n_tokens", "docs_up_to", (F.col("docs_up_to") - F.col("n_docs") + F.col("docs_at_least")).alias("docs"), F.explode(F.array(*[F.lit(float(x)) for x in sorted(set(shares))])).alias("share"))
    found = each.where(F.col("docs_up_to") >= F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("docs")))).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
    return F.broadcast(told).join(found, "share", "left")
