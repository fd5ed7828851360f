"""Language identification by Bayesian evidence fusion.

Evidence is multiplied for each language: the likelihood of the text's letters under a byte-trigram model,
the likelihood of the declared markup language, and a prior of the address. The prior is the share of the
language that the text alone suggests for the host's other documents, smoothed with the share in the address
suffix, and this with the share in the whole table; so an unknown host has the prior of its suffix. Shares
come from grouped aggregation over all documents, and a document's own vote is taken out of them.

Trigram models are fitted on at most ``SAMPLE`` declared documents of each language, those whose hashed
ids come first. Trigrams are hashed to ``SLOTS`` places, so models have a fixed size. A document is rejected
if its text has no letters, if its letters fit even the best language worse than ``MARGIN`` (and ``SPREAD`` for
short texts) below what all but a share of ``TAIL`` of the whole table reach, or if no language has a posterior of
``LEAST``. That bound comes from all documents of the table whose declared language is not at odds with their text.

Defined results: null and empty texts, and texts without letters, have no language of the text, get a
prediction from the other evidence and are rejected; null or unknown declarations, suffixes and hosts say
nothing; ties go to the language first in the alphabet; repeated rows are judged each by itself, and vote
each; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm.text import slices, utf8
from glyphweave.workdir import Work

LANGUAGES = ("de", "en", "es", "fr")
SLOTS, SAMPLE = 1 << 16, 2000
#: Neighbouring trigrams overlap, so each counts as this share of an independent observation.
SHARE = 0.2
MARGIN, LEAST, TAIL = 1.3, 0.5, 0.005
#: Trigrams of a text that counts for that bound.
ENOUGH = 100
#: Short texts may fit worse, by this over the square root of their trigrams.
SPREAD = 8.0
#: Weight of the wider group when the shares of a narrower one are smoothed, in documents.
SMOOTH = 10.0

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every trigram of letters and single spaces between them."""
    body, offsets = utf8(column)
    m = len(offsets) - 1
    letters = _LETTER[body]
    if len(body) > 1:
        lead = (body[:-1] == 0xC3) & (body[1:] >= 0x80) & (body[1:] <= 0x9E) & (body[1:] != 0x97)
        letters[1:][lead] += 32
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(m), np.diff(offsets))
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    good = (row[:-2] == row[2:]) & ~((b == 32) & ((a == 32) | (c == 32))) & ((a != 32) | (c != 32))
    code = (a.astype(np.uint32) << 16) | (b.astype(np.uint32) << 8) | c
    slot = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    return row[:-2][good], slot[good]


def _counts(languages: tuple[str, ...]):
    """From (text, side): trigram counts of each side, summed over the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), SLOTS), np.int64)
        for batch in (x for b in batches for x in slices(b)):
            row, slot = _trigrams(batch.column(0))
            total += np.bincount(batch.column(1).to_numpy()[row] * SLOTS + slot, minlength=total.size).reshape(total.shape)
        side, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(slot.astype(np.int32)), pa.array(total[side, slot])], ["side", "slot", "n"])

    return run


def _evidence(model):
    """From (key, text): number of trigrams and mean log-likelihood of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = model.value
        for batch in (x for b in batches for x in slices(b)):
            text = batch.column(batch.schema.get_field_index("text"))
            row, slot = _trigrams(text)
            body, offsets = utf8(text)
            letters = np.concatenate([[0], np.cumsum(_LETTER[body] != 32)])
            n = np.bincount(row, minlength=batch.num_rows)
            mean = np.stack([np.bincount(row, one[slot], minlength=batch.num_rows) for one in logs], 1) / np.maximum(n, 1)[:, None]
            keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(logs), pa.int32()), pa.array(mean.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(np.diff(letters[offsets])), pa.array(n.astype(np.int64)), lists], [*(batch.schema.names[i] for i in keep), "letters", "n", "means"])

    return run


class LanguageModel:
    """Log-probabilities of trigram slots for each language."""

    def __init__(self, languages: tuple[str, ...], logs: np.ndarray):
        self.languages, self.logs = languages, logs


def train(spark: SparkSession, docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of documents with a declared language."""
    languages = tuple(sorted(languages))
    side = F.array_position(F.array(*map(F.lit, languages)), F.col(lang_col)).cast("int") - 1
    named = docs.select(F.col(id_col).alias("id"), side.alias("side"))
    picked = None
    for k in range(len(languages)):
        own = named.where(F.col("side") == k).where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
        picked = own if picked is None else picked.unionByName(own)
    picked = F.broadcast(picked.dropDuplicates(["id"]))  # at most sample rows a language
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    told = texts.select("text", "side").mapInArrow(_counts(languages), "side int, slot int, n bigint").groupBy("side", "slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), SLOTS))
    counts[told["side"].to_numpy(), told["slot"].to_numpy()] = told["n"].to_numpy()
    logs = np.log((counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * SLOTS))
    return LanguageModel(languages, logs)


def identify(
    spark: SparkSession, rows: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | str | None = "lang",
    host: Column | str | None = "source", suffix: Column | str | None = None,
) -> DataFrame:
    """One row a document: its id, language, confidence, text_language (null without letters) and kept."""
    work, languages = Work(spark, "language"), model.languages
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else F.col(c) if isinstance(c, str) else c
    logs = spark.sparkContext.broadcast(model.logs)
    table = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), pick(declared).alias("declared"), pick(host).alias("host"), pick(suffix).alias("suffix"))
    seen = table.mapInArrow(_evidence(logs), "id bigint, declared string, host string, suffix string, letters bigint, n bigint, means array<double>")
    best = F.when(F.col("n") > 0, F.array_position("means", F.array_max("means")).cast("int") - 1)
    seen = work.write(seen.withColumn("vote", best), "evidence")
    votes = [F.count(F.when(F.col("vote") == i, 1)).cast("double").alias(f"v{i}") for i in range(len(languages))]
    names = [f"v{i}" for i in range(len(languages))]
    says = F.array_position(F.array(*map(F.lit, languages)), F.col("declared")).cast("int") - 1
    usual = (F.col("n") >= ENOUGH) & F.coalesce((says < 0) | (says == F.col("vote")), F.lit(True))
    whole = seen.agg(*votes, F.percentile_approx(F.when(usual, F.array_max("means")), TAIL, 10_000).alias("usual")).first()
    bound = -1e300 if whole["usual"] is None else whole["usual"] - MARGIN
    overall = np.array([whole[n] for n in names]) + 1.0
    overall = overall / overall.sum()
    number = lambda x: F.lit(float(x))
    # how often each language's documents declare which of the languages, or have which suffix
    declared_as = seen.where("vote is not null and declared is not null").groupBy(F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise("?").alias("declared"), "vote").count().collect()
    told = np.full((len(languages), len(languages) + 1), 0.5)
    for r in declared_as:  # at most (languages + 1) * languages rows
        told[r["vote"], languages.index(r["declared"]) if r["declared"] in languages else -1] += r["count"]
    told = np.log(told / told.sum(1, keepdims=True))
    at_suffix = seen.groupBy("suffix").agg(*votes).select(F.col("suffix").alias("s"), *[F.col(n).alias(f"s{n}") for n in names])
    by_suffix = work.write(at_suffix.where("s is not null"), "suffixes")
    by_host = seen.where("host is not null").groupBy("host", "suffix").agg(*votes).select(F.col("host").alias("h"), F.col("suffix").alias("hs"), *[F.col(n).alias(f"h{n}") for n in names])
    by_host = work.write(by_host, "hosts")
    found = seen.join(by_host, (F.col("host") == F.col("h")) & F.col("suffix").eqNullSafe(F.col("hs")), "left").join(by_suffix, F.col("suffix") == F.col("s"), "left")
    logit = []
    for i in range(len(languages)):
        mine = F.when(F.col("vote") == i, 1.0).otherwise(0.0)
        any_ = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
        sums = {x: sum((F.coalesce(F.col(f"{x}{n}"), number(0)) for n in names), number(0)) for x in "hs"}
        own = lambda x, i=i: F.greatest(F.coalesce(F.col(f"{x}v{i}"), number(0)) - F.when(F.col(f"{x}v0").isNotNull(), mine).otherwise(0.0), number(0))
        others = lambda x: F.greatest(sums[x] - F.when(F.col(f"{x}v0").isNotNull(), any_).otherwise(0.0), number(0))  # noqa: B023, E731
        wide = (own("s") + SMOOTH * float(overall[i])) / (others("s") + SMOOTH)
        prior = (own("h") + SMOOTH * wide) / (others("h") + SMOOTH)
        says = number(0)
        for j, name in enumerate(languages):
            says = F.when(F.col("declared") == name, number(told[i, j])).otherwise(says)
        logit.append(F.log(prior) + says + F.col("n") * SHARE * F.col("means")[i])
    found = found.withColumn("logit", F.array(*logit)).withColumn("top", F.array_max("logit"))
    odds = F.aggregate("logit", number(0), lambda acc, x: acc + F.exp(x - F.col("top")))
    out = found.select("id", "letters", "n", "vote", F.array_max("means").alias("fit"), (F.array_position("logit", F.col("top")) - 1).cast("int").alias("k"), (1 / odds).alias("confidence"))
    name = lambda c: F.element_at(F.array(*map(F.lit, languages)), c + 1)
    out = out.select(
        F.col("id").alias(id_col), name(F.col("k")).alias("language"), "confidence", F.when(F.col("vote").isNotNull(), name(F.col("vote"))).alias("text_language"),
        ((F.col("letters") > 0) & (F.col("confidence") >= LEAST) & (F.col("vote").isNull() | (F.col("fit") >= bound - SPREAD / F.sqrt("n")))).alias("kept"),
    )
    return work.write(out, "result")


def page_text(html: Column) -> Column:
    """Text of a web page, without tags, scripts, styles and comments."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z#0-9]+;", " ")


def page_language(html: Column) -> Column:
    """The language that the page's html element declares, without its region."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    return F.when(found != "", found)
