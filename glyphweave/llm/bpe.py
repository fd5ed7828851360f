"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a text piece has exactly one token that can stand last in its encoding, so an array
of last tokens describes the encodings of all prefixes at once. A token fits behind a prefix if it and
the last token before it would not merge otherwise. Appending bytes extends the array; an edit keeps what
stands before it. The array gives the same ids as merging by rank, which the tests hold against tiktoken.

Of the texts of a slice each different piece is encoded once, all of them together as columns of one matrix of
last tokens (``PrefixTable``); ``PrefixText`` keeps the array of one text that grows or changes.

Defined results: null and empty texts have no tokens; any bytes can be encoded, as every byte has a token.
Documents are read whole. What a worker remembers of odd pieces is bounded by ``MEMORY``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphweave.llm.prefix import PrefixTable
from glyphweave.llm.text import slices, span_hashes, spread, utf8

#: White space as Unicode has it; some libraries count four separators of ASCII as well.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space behind white space: there a text cannot be cut at the space.
_RUN = re.compile(f"[{_SPACE}] ")
_GROUPS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+\\Z")
#: Pieces that a worker remembers at most.
MEMORY = 300_000
#: Bytes of text whose different pieces are encoded together.
SLICE = 1 << 23

#: Kinds of bytes. Neighbours of one kind from LETTER to MARK are one piece; ODD ones need the pattern.
SPACE, LETTER, DIGIT, MARK, ODD = range(5)
KINDS = np.full(256, ODD, np.int8)
KINDS[33:127] = MARK
KINDS[32], KINDS[ord("'")] = SPACE, ODD
KINDS[48:58], KINDS[65:91], KINDS[97:123] = DIGIT, LETTER, LETTER
#: The first byte of letters of Latin, and the second bytes of the signs among them.
LATIN, SIGNS = 0xC3, (0x97, 0xB7)
_GRAPH = (np.arange(256) > 32) & (np.arange(256) < 127)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that no white space starts with; white space of Unicode starts with 0xC2, 0xE1, 0xE2 or 0xE3.
_SOLID = _GRAPH | (np.arange(256) >= LATIN) & ~np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])


def plain_pattern(pattern: str) -> str:
    """The pattern with white space spelt out."""
    return pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")


def chunks(text: str) -> list[str]:
    """Parts of a text that no piece reaches across: white space and the word behind it."""
    if not text:
        return []
    if _RUN.search(text) is None:
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first:
            out.insert(0, first)
        return out
    return _GROUPS.findall(text)


def chunk_starts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The same for the bytes of many texts: where parts start that no piece reaches across.

    Behind a solid character white space starts a piece, and so does a space before a solid one.
    """
    cut = np.zeros(len(body) + 1, bool)
    if len(body):
        before_solid = np.append(_SOLID[body[1:]], False)
        before_solid[offsets[1:][offsets[1:] > 0] - 1] = False
        cut[:-1] = (body == 32) & before_solid
        cut[1:-1] |= _BLANK[body[1:]] & _GRAPH[body[:-1]]
    cut[offsets] = True
    return np.flatnonzero(cut[:-1])


def kinds_of(body: np.ndarray) -> np.ndarray:
    """The kind of every byte; letters of Latin are told by their first byte."""
    kind = KINDS[body]
    first = np.flatnonzero(body == LATIN)
    if len(first):
        letter = ~np.isin(body[first + 1], SIGNS)
        kind[first[letter]] = kind[first[letter] + 1] = LETTER
    return kind


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixEncoder:
    """Ids of byte strings, by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def halves_of(self, token: int) -> tuple[int, int]:
        """The two tokens that merge last when ``token`` is made; twice itself for a single byte."""
        found = self.halves.get(token)
        if found is None:
            whole = self.bytes[token]
            parts = [self.ranks[whole[i : i + 1]] for i in range(len(whole))]
            while len(parts) > 2:
                best = min((self.ranks.get(self.bytes[parts[i]] + self.bytes[parts[i + 1]], 1 << 60), i) for i in range(len(parts) - 1))
                if best[0] >= token:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            found = self.halves[token] = (parts[0], parts[1]) if len(parts) == 2 else (token, token)
        return found

    def fits(self, left: int, right: int) -> bool:
        """``stay_apart``, remembered."""
        found = self.apart.get((left, right))
        if found is None:
            if len(self.apart) >= MEMORY:
                self.apart.clear()
            found = self.apart[left, right] = self.stay_apart(left, right)
        return found

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their bytes are encoded together."""
        names, ranks, limit = self.bytes, self.ranks, 1 << 60
        while True:
            if ranks.get(names[left] + names[right], limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves_of(left)[1]
                if left == limit:
                    limit, right = right + 1, self.halves_of(right)[0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves_of(right)[0]
                if right + 1 == limit:
                    limit, left = left, self.halves_of(left)[1]
                    if left == limit:
                        return True

    def extend(self, whole: bytes, last: list[int]) -> list[int]:
        """``last`` holds the last token of each prefix of ``whole`` as far as it goes; fill in the rest."""
        get, apart = self.ranks.get, self.apart.get
        for end in range(len(last) + 1, len(whole) + 1):
            for start in range(max(0, end - self.longest), end):
                token = get(whole[start:end])
                if token is not None:
                    if not start:
                        break
                    fit = apart((last[start - 1], token))
                    if self.fits(last[start - 1], token) if fit is None else fit:
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
        return last

    @staticmethod
    def walk(last: list[int], names: dict[int, bytes]) -> list[int]:
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(names[last[at - 1]])
        return out[::-1]

    def encode(self, whole: bytes) -> list[int]:
        known = self.ranks.get(whole)
        if known is not None:
            return [known]
        return self.walk(self.extend(whole, []), self.bytes)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class PrefixText:
    """A byte string that can grow and change, with the encodings of all its prefixes."""

    def __init__(self, encoder: PrefixEncoder, whole: bytes = b""):
        self.encoder, self.whole, self.last = encoder, whole, encoder.extend(whole, [])

    def append(self, more: bytes) -> None:
        self.whole += more
        self.encoder.extend(self.whole, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in the place of the bytes from ``start`` to ``end``.

        Prefixes up to ``start`` stay. Behind the edit, prefixes are encoded again until they agree with
        the old ones over the length of the longest token; from there the old tokens hold.
        """
        old, shift = self.last[end:], len(new) - (end - start)
        self.whole = self.whole[:start] + new + self.whole[end:]
        self.last, same, reach = self.last[:start], 0, start + len(new)
        while len(self.last) < len(self.whole):
            self.encoder.extend(self.whole[: len(self.last) + 1], self.last)
            at = len(self.last) - 1
            same = same + 1 if at >= reach and self.last[at] == old[at - reach] and len(self.encoder.bytes[self.last[at]]) <= at - reach + 1 else 0
            if same >= self.encoder.longest:
                self.last += old[at - reach + 1 :]
                break
        assert len(self.last) == len(self.whole), shift

    def ids(self, length: int | None = None) -> list[int]:
        """Ids of the first ``length`` bytes, of all by default."""
        return self.encoder.walk(self.last[: len(self.whole) if length is None else length], self.encoder.bytes)


class _Strings:
    """Byte strings of ids, one behind the other in one array."""

    def __init__(self, ids: Iterable[int], strings: Iterable[bytes]):
        own = dict(zip(ids, strings, strict=True))
        known = [own.get(i, b"") for i in range(max(own) + 1)]
        self.body, self.sizes = np.frombuffer(b"".join(known), np.uint8), np.fromiter(map(len, known), np.int64, len(known))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def runs(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The strings of each run of ids, joined."""
        raw = spread(self.body, self.starts[ids], self.sizes[ids]).tobytes()
        limits = np.append(0, np.cumsum(self.sizes[ids]))[np.append(0, ends)].tolist()
        return [raw[i:j] for i, j in zip(limits, limits[1:], strict=False)]


class _Known:
    """The vocabulary in arrays, and the pieces of parts that only the pattern can split."""

    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.table = PrefixTable(ranks)
        self.pieces = regex.compile(plain_pattern(pattern))
        self.bytes, self.spelt = _Strings(ranks.values(), ranks), _Strings(ranks.values(), [b"%d," % i for i in ranks.values()])
        self.split: dict[bytes, list[bytes]] = {}

    def split_odd(self, chunk: bytes) -> list[bytes]:
        found = self.split.get(chunk)
        if found is None:
            if len(self.split) >= MEMORY:
                self.split.clear()
            found = self.split[chunk] = [x.encode() for x in self.pieces.findall(chunk.decode())]
        return found

    def _pieces(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, starts, sizes, chunk) of the pieces of all chunks, in order; chunks lie one behind the other."""
        kind = kinds_of(body)
        head = np.zeros(len(body) + 1, bool)
        head[starts] = True
        odd = kind == ODD
        odd |= (kind == SPACE) & ~head[:-1]
        odd = np.add.reduceat(odd, starts) > 0
        odd |= (sizes == 1) & (kind[starts] == SPACE)
        new = head[:-1].copy()
        new[1:] |= (kind[1:] != kind[:-1]) & ~(head[:-2] & (kind[:-1] == SPACE))
        at = np.flatnonzero(new)
        chunk = np.repeat(np.arange(len(starts)), np.add.reduceat(new, starts))
        size = np.diff(np.append(at, len(body)))
        plain = ~odd[chunk]
        at, size, chunk = at[plain], size[plain], chunk[plain]
        some = np.flatnonzero(odd)
        if len(some):
            raw = body.tobytes()
            lists = [self.split_odd(raw[i : i + n]) for i, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
            more = [x for own in lists for x in own]
            own = np.fromiter(map(len, more), np.int64, len(more))
            at = np.concatenate([at, len(body) + np.cumsum(own) - own])
            size = np.concatenate([size, own])
            chunk = np.concatenate([chunk, np.repeat(some, [len(x) for x in lists])])
            body = np.concatenate([body, np.frombuffer(b"".join(more), np.uint8)])
        return body, at, size, chunk

    def chunks(self, body: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, number of ids) of chunks that lie one behind the other."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        body, at, size, chunk = self._pieces(body, starts, sizes)
        _, first, which = np.unique(span_hashes(body, at, at + size), return_index=True, return_inverse=True)
        ids, counts = self.table.encode(body, at[first], size[first])
        order = np.argsort(chunk, kind="stable")
        own = counts[which]
        flat = spread(ids, (np.cumsum(counts) - counts)[which[order]], own[order])
        return flat, np.bincount(chunk, weights=own, minlength=len(starts)).astype(np.int64)

    def texts(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(chunk of each place, ids of the different chunks one behind the other, their ends, first place of each text, tokens of each place)."""
        body, offsets = utf8(column)
        starts = chunk_starts(body, offsets)
        sizes = np.diff(np.append(starts, len(body)))
        _, first, which = np.unique(span_hashes(body, starts, starts + sizes), return_index=True, return_inverse=True)
        own = sizes[first]
        ids, counts = self.chunks(spread(body, starts[first], own), np.cumsum(own) - own, own)
        return which, ids, np.cumsum(counts), np.searchsorted(starts, offsets), counts[which]


_KNOWN: dict[tuple[str, str], _Known] = {}


def known(path: str, pattern: str) -> _Known:
    if (path, pattern) not in _KNOWN:
        _KNOWN[path, pattern] = _Known(path, pattern)
    return _KNOWN[path, pattern]


def encode_texts(column: pa.Array, path: str, pattern: str) -> list[list[int]]:
    """Ids of each text."""
    which, ids, ends, rows, counts = known(path, pattern).texts(column)
    flat = spread(ids, ends[which] - counts, counts)
    total = np.append(0, np.cumsum(counts))[rows]
    return [flat[i:j].tolist() for i, j in zip(total.tolist(), total[1:].tolist(), strict=False)]


def byte_bpe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    One pass without a shuffle; each row is encoded by itself, so neither skew nor a lost executor matters.
    """
    path, pattern = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known(path, pattern)
        for batch in (x for b in batches for x in slices(b, most=SLICE)):
            which, ids, ends, rows, counts = table.texts(batch.column(1))
            total, of = np.append(0, np.cumsum(counts))[rows], np.empty((2, len(ends)), object)
            of[0], of[1] = table.spelt.runs(ids, ends), table.bytes.runs(ids, ends)
            digests: list[list[str]] = [[], []]
            for i, j in zip(rows.tolist(), rows[1:].tolist(), strict=False):
                digests[0].append(hashlib.sha256(b"".join(of[0][which[i:j]].tolist())[:-1]).hexdigest())
                digests[1].append(hashlib.sha256(b"".join(of[1][which[i:j]].tolist())).hexdigest())
            columns = [batch.column(0), pa.array(np.diff(total)), pa.array(digests[0], pa.string()), pa.array(digests[1], pa.string())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(spread(ids, ends[which] - counts, counts).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
