"""Near-duplicate groups by b-bit MinHash.

Each document's set of word shingles is reduced to ``BANDS * ROWS`` minima. Bands of whole minima give
candidates; of every minimum the low two bits stay in a packed signature, and the bits in which two
signatures agree, corrected for chance, estimate their similarity before the full sets are compared.

Within a band's bucket the members are first compared with one leader only, and what is linked becomes
one component. Only buckets that still hold several components then compare members across components.
So large groups of copies cost as many comparisons as they have members, and no link between different
components of a bucket is left untested. Documents with equal sets are one node.

Before texts are read again, a second packed signature bounds the difference of two sets from below: each
shingle flips one of ``PARITY`` bits, so two sets differ in at least as many shingles as bits. The bound
loses no link, and it spares near copies just under the threshold a comparison with each other.

At a similarity of 0.8 a pair shares no band with probability (1 - 0.8 ** 6) ** 42 < 3e-6, and one that
does is lost by its estimate with probability < 1e-6; links are confirmed on the full sets.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a text of fewer
words than a shingle is one shingle; repeated rows (same id, same text) get equal results; if one id has
several texts, it is linked with what any of them is linked with, and its rows are in one component; rows without
an id are linked with nothing and name themselves; an empty table gives an empty result. Of the input only the
id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm.text import mix, slices, utf8, windows, with_distinct, words
from glyphweave.operators.components import connected_components
from glyphweave.workdir import Work

BANDS, ROWS, LOW_BITS = 42, 6, 2
N_HASH = BANDS * ROWS
#: Members that one task compares with a leader at a time, and members of a bucket that it compares with all others.
SALT, BLOCK = 256, 512
_RNG = np.random.default_rng(0xB17)
_A, _B = _RNG.integers(0, 2**31, N_HASH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), _RNG.integers(0, 2**32, N_HASH, dtype=np.uint32)
_SCAN = "doc_id bigint, n_shingles bigint, s1 bigint, s2 bigint, bands array<bigint>, sketch array<bigint>, parity array<bigint>"
#: Bits of the signature that bounds differences.
PARITY = 1024


def shingle_sets(batch: pa.RecordBatch, column: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle, in order of both."""
    body, offsets = utf8(batch.column(column))
    hashes, rows = words(body, offsets, fold=True)[2:]
    n, runs = np.diff(rows), windows(hashes, shingle)
    row = np.repeat(np.arange(len(n)), n)
    inside = row[: len(runs)] == row[shingle - 1 :] if len(runs) else np.zeros(0, bool)
    keys, values = row[: len(runs)][inside], runs[inside]
    for i in np.flatnonzero((n > 0) & (n < shingle)):
        keys = np.append(keys, i)
        values = np.append(values, windows(hashes[rows[i] : rows[i + 1]], int(n[i])))
    return with_distinct(keys, values)[:2]


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minima of all hash functions over each set; sets lie one behind the other and are not empty."""
    x, out = (values >> np.uint64(32)).astype(np.uint32), np.empty((len(starts), N_HASH), np.uint32)
    y = np.empty_like(x)
    for i in range(N_HASH):
        np.multiply(x, _A[i], out=y)
        y += _B[i]
        out[:, i] = np.minimum.reduceat(y, starts)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(minima), BANDS)).copy()
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, j::ROWS].astype(np.uint64))
    return key


def pack_low_bits(minima: np.ndarray) -> np.ndarray:
    """The low two bits of all minima, 32 to a word of 64 bits."""
    words_ = -(-N_HASH // 32)
    low = np.zeros((len(minima), words_ * 32), np.uint64)
    low[:, :N_HASH] = minima & 3
    return (low.reshape(len(minima), words_, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def parities(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Of each of n sets, which of ``PARITY`` bits an odd number of its members falls on, 64 to a word."""
    odd = (np.bincount(keys * PARITY + (values & np.uint64(PARITY - 1)).astype(np.int64), minlength=n * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, PARITY), axis=1).view(np.uint64)


def _scan(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            m = batch.num_rows
            keys, values = shingle_sets(batch, 1, shingle)
            counts = np.bincount(keys, minlength=m)
            s1, s2 = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
            some = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[some]
            if len(some):
                s1[some], s2[some] = np.add.reduceat(mix(values ^ np.uint64(0x1234567)), starts), np.add.reduceat(mix(values + np.uint64(0xABCDEF)), starts)
                minima = signatures(values, starts)
                bands, low, odd = band_keys(minima), pack_low_bits(minima), parities(keys, values, m)[some]
            else:
                bands, low, odd = (np.zeros((0, 1), np.uint64) for _ in range(3))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts > 0)]) * x.shape[1], pa.int32()), pa.array(x.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists(bands), lists(low), lists(odd)], ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch", "parity"])

    return run


def alike(a: str, b: str, similarity: float) -> Column:
    """Whether two signatures agree as often as sets of this similarity do, but for five standard deviations."""
    agree = similarity + (1 - similarity) / 4
    least = N_HASH * agree - 5 * (N_HASH * agree * (1 - agree)) ** 0.5
    apart = "0"
    for i in range(-(-N_HASH // 32)):
        z = f"({a}[{i}] ^ {b}[{i}])"
        apart += f" + bit_count(({z} | shiftrightunsigned({z}, 1)) & 6148914691236517205L)"
    return F.expr(f"{N_HASH} - ({apart})") >= least


def may_link(percent: int) -> Column:
    """What must hold of sizes and signatures of ``lead`` and ``doc_id`` if they are linked: similarity s means a difference of at most (1 - s) / (1 + s) of both sizes together."""
    differ = " + ".join(f"bit_count(parity_lead[{i}] ^ parity_doc_id[{i}])" for i in range(PARITY // 64))
    sized = f"100 * least(n_lead, n_doc_id) >= {percent} * greatest(n_lead, n_doc_id)"
    return F.expr(sized) & F.expr(f"{100 + percent} * ({differ}) <= {100 - percent} * (n_lead + n_doc_id)") & alike("sketch_lead", "sketch_doc_id", percent / 100)


def _verify(shingle: int, percent: int):
    """From (lead, doc_id, text), each leader before its members: the pairs that are near enough. A leader may have several texts."""

    def near(own: np.ndarray, base: np.ndarray) -> bool:
        if not len(own) or not len(base):
            return False
        both = int((base[np.minimum(np.searchsorted(base, own), len(base) - 1)] == own).sum())
        return 100 * both >= percent * (len(own) + len(base) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, bases = None, []
        for batch in (x for b in batches for x in slices(b)):
            keys, values = shingle_sets(batch, 2, shingle)
            at = np.searchsorted(keys, np.arange(batch.num_rows + 1))
            found: list[tuple[int, int]] = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = values[at[i] : at[i + 1]]
                if a == b:
                    if a != lead:
                        lead, bases = a, []
                    bases.append(own)
                    continue
                assert a == lead, "a leader is missing"
                if any(near(own, base) for base in bases):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _confirmed(work: Work, batch: DataFrame, pairs: DataFrame, shingle: int, percent: int, name: str, how: str | None = None) -> DataFrame:
    """Those of the distinct ``pairs`` (lead, doc_id) whose full sets are near enough."""
    many = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    salted = pairs.join(many, "lead").select("lead", "doc_id", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"))
    leaders = many.select("lead", F.col("lead").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    ids = work.write(salted.unionByName(leaders), f"{name}ids")
    rows = (ids.hint(how) if how else ids).join(batch, "doc_id").select("lead", "doc_id", "text", "salt")
    dealt = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("doc_id") != F.col("lead"))
    return work.write(dealt.select("lead", "doc_id", "text").mapInArrow(_verify(shingle, percent), "u bigint, v bigint"), name)


def near_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept. Links need 100 * both >= percent * either."""
    work = Work(spark, "minhash")
    batch = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    scan = work.write(batch.mapInArrow(_scan(shingle), _SCAN), "scan")
    batch, same = batch.where("doc_id is not null"), ["s1", "s2", "n_shingles"]
    classes = work.write(scan.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    nodes = work.write(scan.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"]), "nodes")
    several = scan.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b")).where("a <> b").select("doc_id")
    joint = work.write(scan.join(several, "doc_id").join(classes, same).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "joint")
    sketches = nodes.select("doc_id", "n_shingles", "sketch", "parity")
    members = nodes.select(F.explode("bands").alias("key"), "doc_id")
    leads = members.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    buckets = work.write(members.join(leads, "key"), "buckets")
    stars = buckets.where("doc_id <> lead").select("lead", "doc_id").distinct()
    a, b = (sketches.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"), F.col("parity").alias(f"parity_{k}")) for k in ("lead", "doc_id"))
    stars = stars.join(a.hint("merge"), "lead").join(b.hint("merge"), "doc_id").where(may_link(percent)).select("lead", "doc_id")
    stars = work.write(stars, "stars")
    edges = _confirmed(work, batch, stars, shingle, percent, "edges", "merge").unionByName(joint)
    linked = connected_components(spark, edges, work)
    placed = buckets.join(linked.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    left = work.write(placed.join(mixed, "key", "left_semi").join(sketches, "doc_id"), "mixed")
    blocks = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    left = left.join(blocks, "key")
    x = left.select("key", F.col("doc_id").alias("lead"), F.col("component").alias("c_lead"), F.col("n_shingles").alias("n_lead"), F.col("sketch").alias("sketch_lead"), F.col("parity").alias("parity_lead"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = left.select("key", "doc_id", F.col("component").alias("c_doc_id"), F.col("n_shingles").alias("n_doc_id"), F.col("sketch").alias("sketch_doc_id"), F.col("parity").alias("parity_doc_id"), F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"))
    across = x.join(y, (x["key"] == y["key"]) & (x["block"] == y["block"]) & F.expr("lead < doc_id and c_lead <> c_doc_id") & may_link(percent))
    across = work.write(across.select("lead", "doc_id").distinct().join(stars, ["lead", "doc_id"], "left_anti"), "across")
    if not across.isEmpty():
        edges = edges.unionByName(_confirmed(work, batch, across, shingle, percent, "more"))
        linked = connected_components(spark, edges, work)
    named = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    out = scan.select("doc_id", *same).join(named, same, "left").select(
        "doc_id", "n_shingles", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id")).alias("component_id")
    )
    return work.write(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "result")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT c.node, l.b FROM c JOIN l ON c.seen = l.a),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(m.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""
