"""Substring deduplication by a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words. Each window has a fingerprint: the least hash of the runs of
``SHINGLE`` words in it, so equal windows have equal fingerprints, and about one in eight runs of words is
one. A batch's fingerprints are dealt in ranges and sorted once: that is its run of the index, in which a fingerprint
that occurs twice has its like beside it, so nothing is joined or counted within a batch; with the older
runs it is merge-joined. Only windows whose fingerprint occurs twice are hashed in full, by two
independent hashes of 96 bits together (a second hash verifies, not the words themselves), dealt by them
and sorted; of equal windows the first one stays and every other one removes its words. The batch's run is
named once its result stands; runs are merged when there are many.

Every step is one written table whose shuffle files go with the statement, so disk holds one step's shuffle at a time.

Copies of a whole word sequence are told by a digest and take no part in the window stage: each of their
windows starts in the first copy as well.

Defined results: null and empty texts have no words; texts of fewer words than a window lose nothing;
repeated rows (same id, same text) get equal results; if one id has several texts, a place that is removed
in one of them is removed in all; rows without an id are neither earlier nor later than others: they lose
nothing, and nothing is removed on their account; empty tables give empty results.
Of the input only the id and the text are read. Equal windows are reduced to the first one within each
slice of ``SLICE`` bytes before they are shuffled, so a passage that stands in a large part of the documents
sends one row a slice, not one a document; these rows are sorted on disk and read as a stream.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.llm.text import CHUNK, mix, ragged, slices, utf8, windows, with_distinct, words
from glyphweave.workdir import Work, delete, tidy

WINDOW, SHINGLE = 20, 6
#: Ages of windows: of the history, of the batch, and removals that are certain.
OLD, NEW, GONE = 0, 1, 2
#: Bytes of text within which equal windows are reduced before they are shuffled.
SLICE = 4 * CHUNK
_SCAN = "doc_id bigint, text_hash bigint, n_words bigint, kept_sha256 string, prints array<bigint>"
_SAME = ["text_hash", "n_words", "kept_sha256"]
_WINDOWS = "h1 bigint, h2 int, age tinyint, doc_id bigint, start int, length int"


def _slide(x: np.ndarray, n: int, low: bool) -> np.ndarray:
    """Minimum or maximum of each run of n values."""
    pick, width = np.minimum if low else np.maximum, 1
    while 2 * width <= n:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _window_prints(hashes: np.ndarray, rows: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint of each window, whether it lies in one row, hashes of all runs of ``shingle`` words)."""
    runs = windows(hashes, shingle)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, bool), runs
    least = _slide(runs, window - shingle + 1, True)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    return least, row[: len(least)] == row[window - 1 :], runs


def _prints_of_rows(hashes: np.ndarray, rows: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) in order; one that stands at several places of a row comes twice."""
    least, inside, runs = _window_prints(hashes, rows, window, shingle)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = window - shingle + 1
    held = np.zeros(len(least) + 2 * (n - 1), np.uint64)
    held[n - 1 : n - 1 + len(least)] = np.where(inside, least, 0)
    place = np.flatnonzero(_slide(held, n, False)[: len(runs)] == runs)
    row = np.searchsorted(rows, place, "right") - 1
    keys, values, counts = with_distinct(row, runs[place])
    twice = np.minimum(counts, 2)
    return np.repeat(keys, twice), np.repeat(values, twice)


def _scan(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            body, offsets = utf8(batch.column(1))
            starts, ends, hashes, rows = words(body, offsets)
            n = np.diff(rows)
            row, prints = _prints_of_rows(hashes, rows, window, shingle)
            item, place = ragged(n)
            whole = np.zeros(len(n), np.uint64)
            np.add.at(whole, item, mix(hashes + mix(place.astype(np.uint64))))
            raw = body.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[offsets[i] : offsets[i + 1]].split())).hexdigest() for i in range(len(n))]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(n) + 1)), pa.int32()), pa.array(prints.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(sha), lists], ["doc_id", "text_hash", "n_words", "kept_sha256", "prints"])

    return run


def _candidates(window: int, shingle: int):
    """From (age, doc_id, text, prints): the windows with one of these prints, and removals that show already (age ``GONE``, dealt by their document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, most=SLICE)):
            hashes, rows = words(*utf8(batch.column(2)))[2:]
            least, inside, _ = _window_prints(hashes, rows, window, shingle)
            row = np.repeat(np.arange(batch.num_rows), np.diff(rows))[: len(least)]
            lists = batch.column(3)
            wanted = lists.flatten().to_numpy().view(np.uint64) + mix(np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy()).astype(np.uint64))
            at = np.flatnonzero(inside & np.isin(least + mix(row.astype(np.uint64)), wanted))
            if not len(at):
                continue
            h1, h2 = windows(hashes, window)[at], (windows(hashes, window, 1)[at] >> np.uint64(33)).astype(np.int32)
            age, ids = batch.column(0).to_numpy()[row[at]], batch.column(1).to_numpy()[row[at]]
            start = (at - rows[row[at]]).astype(np.int32)
            order = np.lexsort((start, ids, age, h2, h1))
            h1, h2, age, ids, start = h1[order], h2[order], age[order], ids[order], start[order]
            first, later = _split(h1, h2, age, ids, start)
            later = later[np.lexsort((start[later], ids[later]))]
            fresh = np.ones(len(later), bool)
            fresh[1:] = (ids[later][1:] != ids[later][:-1]) | (start[later][1:] > start[later][:-1] + 1)
            begin = np.flatnonzero(fresh)
            spans, ends = later[begin], later[np.append(begin[1:], len(later))[: len(begin)] - 1]
            k = first[np.lexsort((start[first], ids[first]))]  # neighbours in a text stay neighbours: they compress
            both = np.concatenate([k, spans])
            dealt = np.concatenate([h1[k], mix(ids[spans].astype(np.uint64))]).view(np.int64)
            columns = [
                pa.array(dealt), pa.array(np.concatenate([h2[k], np.zeros(len(spans), np.int32)])), pa.array(np.concatenate([age[k], np.full(len(spans), GONE, age.dtype)]), pa.int8()),
                pa.array(ids[both]), pa.array(start[both]), pa.array(np.concatenate([np.ones(len(k), np.int32), start[ends] - start[spans] + 1]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "age", "doc_id", "start", "length"])

    return run


def _split(h1: np.ndarray, h2: np.ndarray, age: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in order of hash, age, document and place: places of the first of equal ones, and of later ones of this batch at another place."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    at = np.flatnonzero(new)
    first = at[np.cumsum(new) - 1]
    moved = (ids != ids[first]) | (start != start[first]) | (age[first] == OLD)
    return at, np.flatnonzero(~new & moved & (age == NEW))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From windows in order of hash, age, document and place: removals. The first of a group is carried from batch to batch."""
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [batch.column(i).to_numpy() for i in range(6)]
        gone = np.flatnonzero(own[2] == GONE)
        kept = np.flatnonzero(own[2] != GONE)
        h1, h2, age, ids, start = (x[kept] if held is None else np.concatenate([h, x[kept]]) for h, x in zip(held or own, own[:5], strict=False))
        first, later = _split(h1, h2, age, ids, start)
        if len(first):
            held = [x[first[-1] :][:1] for x in (h1, h2, age, ids, start)]
        length = np.concatenate([np.ones(len(later), np.int32), own[5][gone]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[later], own[3][gone]])), pa.array(np.concatenate([start[later], own[4][gone]])), pa.array(length)], ["doc_id", "start", "length"])


def _kept(text: str | None, starts: np.ndarray, lengths: np.ndarray, window: int) -> tuple[bytes, int, int]:
    """What runs of removed windows leave of a text, its number of words and how many of them go."""
    own = (text or "").encode().split()
    change = np.zeros(len(own) + 1, np.int64)
    np.add.at(change, np.minimum(starts, len(own)), 1)
    np.add.at(change, np.minimum(starts + lengths + window - 1, len(own)), -1)
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join([w for w, g in zip(own, gone.tolist(), strict=True) if not g]), len(own), int(gone.sum())


def _cuts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[bytes, int, int]]:
    named = lambda name: batch.column(batch.schema.get_field_index(name))
    for text, starts, lengths in zip(named("text").to_pylist(), named("starts"), named("lengths"), strict=True):
        yield _kept(text, starts.values.to_numpy(), lengths.values.to_numpy(), window)


def _digests(window: int):
    """From (doc_id, text, starts, lengths of runs of removed windows): counts and a digest of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for kept, n, gone in _cuts(batch, window)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _texts(window: int):
    """From (row, text, copy, starts, lengths): the row and what is left of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            left = batch.column(1).to_pylist()
            for i in np.flatnonzero(batch.column(2).to_numpy(zero_copy_only=False)).tolist():
                left[i] = ""
            cut = np.flatnonzero(batch.column(3).is_valid().to_numpy(zero_copy_only=False))
            for i, (kept, _, _) in zip(cut.tolist(), _cuts(batch.take(pa.array(cut)), window), strict=True):
                left[i] = kept.decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.string())], ["row", "left_text"])

    return run


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (print, doc_id) in order: each once, and whether the print may stand at another place.

    A print goes on in the next partition only if it is the last one of its own, so ends of partitions are marked.
    """
    print_, ids, many = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        first = not len(print_)
        print_, ids = (np.concatenate([x, y.to_numpy()]) for x, y in ((print_, batch.column(0)), (ids, batch.column(1))))
        many = np.concatenate([many, np.zeros(batch.num_rows, bool)])
        same = print_[1:] == print_[:-1]
        many[1:] |= same
        many[:-1] |= same
        many[0] |= first
        keep = np.append(True, ~same | (ids[1:] != ids[:-1]))
        print_, ids, many = print_[keep], ids[keep], many[keep]
        yield pa.RecordBatch.from_arrays([pa.array(print_[:-1]), pa.array(ids[:-1]), pa.array(many[:-1])], ["print", "doc_id", "many"])
        print_, ids, many = print_[-1:], ids[-1:], many[-1:]
    if len(print_):
        yield pa.RecordBatch.from_arrays([pa.array(print_), pa.array(ids), pa.array([True])], ["print", "doc_id", "many"])


class FingerprintIndex:
    """Sorted, immutable runs of (print, doc_id) under ``path``, one for each batch.

    Runs are split by print and id, so a print of very many documents is in several files. A run is written under
    a name that nobody reads and gets its own when the batch's result stands: after a failure the batch can be
    run again. Batches have names; one that is there already (and not merged yet) is not compared with itself as history.
    The words of old documents are not kept here; they are read from the table that the caller keeps.
    """

    def __init__(self, spark: SparkSession, path: str, most_runs: int = 8):
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, but: str | None = None) -> list[str]:
        """Folders of the runs, oldest first; a merged run stands for those that its name counts."""
        path, fs = self._files()
        if not fs.exists(path(self.path)):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(path(self.path)))
        found = [x for x in names if x.startswith("run-") and (but is None or x.split("-", 2)[2] != but)]
        merged = [x for x in names if x.startswith("merged-")][-1:]
        last = int(merged[0][-8:]) if merged else 0
        return [f"{self.path}/{x}" for x in merged + [x for x in found if int(x[4:12]) > last]]

    def prints(self, but: str | None = None) -> DataFrame | None:
        runs = self.runs(but)
        return self.spark.read.schema("print bigint, doc_id bigint, many boolean").parquet(*runs).select("print", "doc_id") if runs else None

    def stage(self, prints: DataFrame) -> str:
        """Write the run of a batch, from one row a print and place; returns its folder, which ``commit`` takes."""
        at = f"{self.path}/open-{uuid.uuid4().hex}"
        dealt = prints.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "doc_id")
        with tidy(self.spark):
            dealt.mapInArrow(_mark, "print bigint, doc_id bigint, many boolean").write.option("compression", "zstd").parquet(at)
        return at

    def commit(self, at: str, batch: str) -> None:
        path, fs = self._files()
        names = [x.getPath().getName() for x in fs.listStatus(path(self.path))]
        if any(x.startswith("run-") and x.split("-", 2)[2] == batch for x in names):
            fs.delete(path(at), True)
            return
        number = 1 + max([0, *(int(x.split("-")[1]) for x in names if x.startswith(("run-", "merged-")))])
        fs.rename(path(at), path(f"{self.path}/run-{number:08d}-{batch}"))
        if len(self.runs()) > self.most_runs:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one; the old ones go once it stands under its name."""
        old = self.runs()
        if len(old) < 2:
            return
        path, fs = self._files()
        at = self.stage(self.prints())
        fs.rename(path(at), path(f"{self.path}/merged-{int(old[-1].rsplit('/', 1)[-1].split('-')[1]):08d}"))
        for x in old:
            fs.delete(path(x), True)


def removals(
    spark: SparkSession, docs: DataFrame, work: Work, index: FingerprintIndex | None = None, history: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, batch: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    """What goes: (scan of all rows, ids of later copies of whole texts, runs of removed windows of each other id, the batch's run)."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    full = work.write(texts.mapInArrow(_scan(window, shingle), _SCAN), "prints")
    scan = work.write(full.drop("prints"), "scan")
    long = scan.where(f"n_words >= {window} and doc_id is not null")
    firsts = long.groupBy(*_SAME).agg(F.min("doc_id").alias("doc_id"))
    copies = work.write(long.select("doc_id").join(firsts, "doc_id", "left_anti").distinct(), "copies")
    own = index or FingerprintIndex(spark, f"{work.path}/index")
    exploded = full.where("doc_id is not null").select("doc_id", "prints").join(copies, "doc_id", "left_anti").select(F.explode("prints").alias("print"), "doc_id")
    at = own.stage(exploded)
    work.drop("prints")
    run, old = spark.read.parquet(at), index.prints(batch) if index is not None else None
    shared = run.where("many").select("print", "doc_id")
    if old is not None:
        shared = shared.unionByName(run.where("not many").select("print", "doc_id").join(old.select("print"), "print", "left_semi"))
    found = work.write(shared.groupBy("doc_id").agg(F.collect_list("print").alias("prints")), "found")
    if index is None:
        delete(spark, at)
    wanted = texts.join(found, "doc_id").select(F.lit(NEW).cast("tinyint").alias("age"), "doc_id", "text", "prints")
    if old is not None and history is not None:
        past = old.join(run.select("print").distinct(), "print", "left_semi").groupBy("doc_id").agg(F.collect_set("print").alias("prints"))
        before = history.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).join(past, "doc_id")
        wanted = wanted.unionByName(before.select(F.lit(OLD).cast("tinyint").alias("age"), "doc_id", "text", "prints"))
    places = work.write(wanted.mapInArrow(_candidates(window, shingle), _WINDOWS), "windows")
    work.drop("found")
    later = places.repartition("h1").sortWithinPartitions("h1", "h2", "age", "doc_id", "start").mapInArrow(_later, "doc_id bigint, start int, length int")
    gone = work.write(later.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths")), "gone")
    work.drop("windows")
    return scan, copies, gone, at


def substring_dedup(
    spark: SparkSession, docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None,
    id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, batch: str | None = None,
) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256.

    With an ``index`` and the ``history`` that it describes (same columns), windows that start in the
    history are removed as well; the batch then becomes a new run, named ``batch``. Run again under the
    same name, a batch gives the same result and is not entered twice.
    """
    work, batch = Work(spark, "substring"), batch or uuid.uuid4().hex
    scan, copies, gone, run = removals(spark, docs, work, index, history, id_col, text_col, window, shingle, batch)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    cut = texts.join(gone, "doc_id").select("doc_id", "text", "starts", "lengths").mapInArrow(_digests(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    whole = scan.join(gone.select("doc_id"), "doc_id", "left_anti").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left")
    rest = whole.select("doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).alias("n_removed"), F.when(F.col("copy"), nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    out = work.write(cut.unionByName(rest), "result")
    if index is not None:
        index.commit(run, batch)
    return out


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """All rows and columns of ``docs``; texts that lose words become their kept words joined by one space, others stay as they are."""
    work = Work(spark, "substring")
    _, copies, gone, _ = removals(spark, docs, work, None, None, id_col, text_col, window, shingle)
    schema = docs.schema
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("__id"))
    rows = rows.join(gone.withColumnRenamed("doc_id", "__id"), "__id", "left").join(copies.select(F.col("doc_id").alias("__id"), F.lit(True).alias("copy")), "__id", "left")
    rows = rows.select("row", F.col("row").getField(text_col).alias("text"), F.coalesce("copy", F.lit(False)).alias("copy"), "starts", "lengths")
    both = rows.mapInArrow(_texts(window), f"row {rows.schema['row'].dataType.simpleString()}, left_text string")
    return both.select(*[F.col("left_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in schema.names])


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k FROM s),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT DISTINCT doc_id, s + o AS p FROM r, range(20) t(o) WHERE n > 1),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w),
l AS (SELECT p.doc_id, count(*) AS n_removed FROM g p GROUP BY 1),
t AS (SELECT p.doc_id, string_agg(ws[p.p], ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN l USING (doc_id) LEFT JOIN t USING (doc_id)
"""
