"""Best-fit packing of token sequences, certified by lower bounds.

Documents are tokenised (Latin words by prefix dynamic programming over the tokenizer's merges, all different
ones of a slice together; other words by the library), documents over the capacity are cut into pieces of the full capacity, and pieces
are packed by best-fit decreasing in partitions of bounded size. Dual-feasible functions give each
partition a lower bound of its number of bins. Where bins and bound agree the partition is done; else its
full bins are done, and the documents in the others go to new partitions, shared with those of other
partitions, and are packed again.

Defined results: a null or empty text is one document of the end token alone; pieces of one document stay
in their order but may lie in different sequences; repeated rows are packed each by itself; an empty table
gives no rows. Of the input only the id and the text are read. No row is dropped or shortened.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphweave.llm.bpe import DIGIT, LATIN, ODD, SIGNS, kinds_of
from glyphweave.llm.prefix import PrefixTable
from glyphweave.llm.text import slices, span_hashes, spread, utf8, words
from glyphweave.workdir import Work

#: Words outside Latin letters, digits and marks that a worker remembers at most.
MEMORY = 300_000
#: Bytes of text whose different words are encoded together.
SLICE = 1 << 23
#: Pieces in a partition, about.
PART = 20_000
ROUNDS = 6

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint, done boolean"


_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words whose normal form is their lower case, and their parts by the pattern above.
_LATIN = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
#: Of the symbols of a part, the last one is told from others by this.
_END = 256
_SUFFIX = "</w>"


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in vocabularies: itself if it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in seen}
    names.update((chr(256 + k), b) for k, b in enumerate(sorted(set(range(256)) - set(seen))))
    return names


def _prefix_table(path: str) -> PrefixTable | None:
    """The file's merges, if it lower-cases, splits and merges as ``_Words`` does; else none."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    before = (told.get("normalizer") or {}).get("normalizers", [])
    first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    model = told["model"]
    known = [x["type"] for x in before] == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": _SPLIT} and all("<|" in x["content"] for x in told["added_tokens"])
    options = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
    if not known or model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or any(model.get(x) for x in options):
        return None
    vocabulary, names = model["vocab"], _byte_names()
    spelt: dict[str, tuple[int, ...]] = {}
    for name, b in names.items():
        spelt[name], spelt[name + _SUFFIX] = (b,), (b + _END,)
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    for a, b in pairs:
        spelt[a + b] = spelt[a] + spelt[b]
    merges = tuple(np.array([vocabulary[x] for x in xs], np.int64) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
    in_order = len(merges[2]) and (np.diff(merges[2]) > 0).all() and merges[2][0] >= 2 * len(names)
    return PrefixTable({x: vocabulary[name] for name, x in spelt.items()}, merges) if in_order else None


class _Words:
    """Ids of words without white space of ASCII. White space always parts tokens, so a text's ids are those of its words."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.table = _prefix_table(path)
        self.odd: dict[bytes, list[int]] = {}

    def _encode(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(words), 4096):
            out += [x.ids for x in self.tokenizer.encode_batch_fast(words[at : at + 4096], add_special_tokens=False)]
        return out

    def _learn(self, need: list[bytes]) -> list[list[int]]:
        """Ids of words by the library."""
        new = [x for x in dict.fromkeys(need) if x not in self.odd]
        if len(self.odd) + len(new) > MEMORY:
            self.odd.clear()
            new = list(dict.fromkeys(need))
        self.odd.update(zip(new, self._encode([x.decode() for x in new]), strict=True))
        return [self.odd[x] for x in need]

    def encode(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, number of ids) of words that lie one behind the other."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw, kind = body.tobytes(), kinds_of(body)
        odd = kind == ODD
        odd[:-1] |= (body[:-1] == ord("<")) & (body[1:] == ord("|"))
        odd = np.add.reduceat(odd, starts) > 0
        if self.table is None:
            odd[:] = True
        some = np.flatnonzero(odd)
        strange, split = [], []
        for k, i, n in zip(some.tolist(), starts[some].tolist(), sizes[some].tolist(), strict=True):
            word = raw[i : i + n]
            text = word.decode()
            if self.table is not None and _LATIN.fullmatch(text) and "<|" not in text:
                split += [(k, x.encode()) for x in _PARTS.findall(text.lower())]
            else:
                strange.append((k, word))
        lower = body.copy()
        lower[(body >= 65) & (body <= 90)] += 32
        second = np.flatnonzero(body == LATIN) + 1
        second = second[(body[second] < 0x9F) & (body[second] != SIGNS[0])]
        lower[second] += 32
        head = np.zeros(len(body), bool)
        head[starts] = True
        head[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(head)
        size, word = np.diff(np.append(at, len(body))), np.repeat(np.arange(len(starts)), np.add.reduceat(head, starts))
        plain = ~odd[word]
        more = np.fromiter((len(x) for _, x in split), np.int64, len(split))
        at, size = np.concatenate([at[plain], len(body) + np.cumsum(more) - more]), np.concatenate([size[plain], more])
        word = np.concatenate([word[plain], np.array([k for k, _ in split], np.int64)])
        lower = np.concatenate([lower, np.frombuffer(b"".join(x for _, x in split), np.uint8)])
        ids, counts = self._parts(lower, at, size)
        if strange:
            found = self._learn([x for _, x in strange])
            own = np.fromiter(map(len, found), np.int64, len(found))
            ids, counts = np.concatenate([ids, np.array([i for x in found for i in x], np.int64)]), np.concatenate([counts, own])
            word = np.concatenate([word, np.array([k for k, _ in strange], np.int64)])
        order = np.argsort(word, kind="stable")
        flat = spread(ids, (np.cumsum(counts) - counts)[order], counts[order])
        return flat, np.bincount(word, weights=counts, minlength=len(starts)).astype(np.int64)

    def _parts(self, body: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, each different one encoded once."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        _, first, which = np.unique(span_hashes(body, at, at + size), return_index=True, return_inverse=True)
        at, size = at[first], size[first]
        symbols = spread(body, at, size).astype(np.int64)
        ends = np.cumsum(size)
        symbols[ends - 1] += _END
        ids, counts = self.table.encode(symbols, ends - size, size)
        return spread(ids, (np.cumsum(counts) - counts)[which], counts[which]), counts[which]

    def texts(self, column: pa.Array, end: bytes) -> Iterator[bytes]:
        """Ids of each text and ``end``, as bytes. Each different word of the texts is encoded once."""
        body, offsets = utf8(column)
        starts, ends, hashes, rows = words(body, offsets)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        own = (ends - starts)[first]
        flat, size = self.encode(spread(body, starts[first], own), np.cumsum(own) - own, own)
        n = size[which]
        total = np.append(0, np.cumsum(n))
        ids = spread(flat.astype("<u4"), (np.cumsum(size) - size)[which], n).tobytes()
        limits = (4 * total[rows]).tolist()
        for i, j in zip(limits, limits[1:], strict=False):
            yield ids[i:j] + end


_WORDS: dict[str, _Words] = {}


def tokenized(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _WORDS:
            _WORDS[path] = _Words(path)
        table, end = _WORDS[path], np.array([end_id], "<u4").tobytes()
        for batch in (x for b in batches for x in slices(b, most=SLICE)):
            rows: list[list] = [[] for _ in names]
            for doc_id, ids in zip(batch.column(0).to_pylist(), table.texts(batch.column(1), end), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    values = [doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)]
                    for column, value in zip(rows, values + [np.frombuffer(own, "<u4").tolist()] * with_ids, strict=True):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of every item and the room left in every bin; of bins that fit best, the latest is taken."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, left = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    rooms: list[int] = []  # sizes of room that some bin has
    by_room: dict[int, list[int]] = {}
    for i in order.tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            own = by_room[room]
            b = own.pop()
            if not own:
                del rooms[at]
        else:
            b, room = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left[b] = rest = room - size
        if rest:
            own = by_room.setdefault(rest, [])
            if not own:
                insort(rooms, rest)
            own.append(b)
    return bins, offsets, np.array(left, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most that the dual-feasible functions of two families prove: so many bins any packing needs.

    The first counts items over capacity - k as whole, drops items under k and takes the others as they
    are; the second rounds multiples of sizes, floor((p + 1) * size / capacity) / p.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    number, total = np.cumsum(counts), np.cumsum(counts * sizes)
    k = np.arange(1, capacity // 2 + 1)
    large = number[-1] - number[capacity - k]
    middle = total[capacity - k] - total[k - 1]
    best = max(best, int((large + -(-middle // capacity)).max()))
    for p in range(1, 101):
        scaled = (p + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * p, scaled // capacity * capacity)  # times capacity * p
        best = max(best, -(-int((counts * value).sum()) // (capacity * p)))
    return best


def _pack(capacity: int, round_: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])  # the same again if the task is run again
        lengths = table["length"].to_numpy()
        bins, offsets, left = best_fit_decreasing(lengths, capacity)
        done = np.ones(len(left), bool) if last or len(left) == lower_bound(lengths, capacity) else left == 0
        base = (round_ << 56) | (TaskContext.get().partitionId() << 32)
        for name, values in (("sequence_id", bins + base), ("offset", offsets), ("done", done[bins])):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=50_000)

    return run


def pack_pieces(spark: SparkSession, pieces: DataFrame, capacity: int = 2048, part: int = PART, rounds: int = ROUNDS, work: Work | None = None) -> DataFrame:
    """Give each piece (doc_id, piece, start, length, ids_crc32) its sequence_id and offset.

    A partition holds about ``part`` pieces whatever the input; each round packs the pieces in bins that
    the bound of their partition does not certify. The last round keeps its bins as they are.
    """
    work = work or Work(spark, "packing")
    rest, out = pieces, []
    for k in range(rounds):
        n = rest.count()
        if not n:
            break
        last = k == rounds - 1 or n <= part
        dealt = rest.repartition(max(1, round(n / part)), F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(k)))
        placed = work.write(dealt.mapInArrow(_pack(capacity, k, last), PLACED), "placed")
        out.append(placed.where("done").drop("done"))
        if last:
            break
        rest = placed.where("not done").drop("sequence_id", "offset", "done")
    if not out:
        return pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


def pack(spark: SparkSession, docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Work(spark, "packing")
    pieces = work.write(tokenized(docs, capacity, id_col, text_col, tokenizer, end_id), "pieces")
    return pack_pieces(spark, pieces, capacity, work=work)
