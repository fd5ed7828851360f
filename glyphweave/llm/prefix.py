"""Prefix dynamic programming of byte-pair encodings, for many pieces of text in one array operation.

Every prefix of a piece has exactly one token that can stand last in its encoding: the longest one that fits
behind the last token of what precedes it. ``last_tokens`` fills a matrix of these tokens, one row a prefix
length and one column a piece; start by start all pieces walk the trie of the vocabulary, and of the
tokens found those that would not merge with what stands before them are entered. A token is an id; the
smaller of two ids is merged first. Symbols are small numbers, bytes for instance.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from glyphweave.llm.text import spread

#: Larger than any id.
NEVER = 1 << 30
#: Pieces that are encoded at a time, and symbols in the longest one of them.
BLOCK, LONGEST = 1 << 16, 48
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Lookup:
    """From pairs of ids to numbers, in arrays; each pair stands within a few slots of its place."""

    def __init__(self, a: np.ndarray, b: np.ndarray, values: np.ndarray, missing: int):
        bits = max(4, int(4 * len(a)).bit_length())
        self.shift, self.mask, self.missing = np.uint64(64 - bits), (1 << bits) - 1, missing
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, missing, np.int64)
        key, left = self._key(a, b), np.arange(len(a))
        at, self.reach = self._place(key), 1
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = key[free]  # of several with one place one stays
            won = free[self.keys[at[free]] == key[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != key[left]]
            at[left] = (at[left] + 1) & self.mask
            self.reach += bool(len(left))

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 20) | b

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _ODD) >> self.shift).astype(np.int64)

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = self._key(a, b)
        at = self._place(key)
        held = self.keys[at]
        out = np.where(held == key, self.values[at], self.missing)
        open_ = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.reach - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            held = self.keys[at[open_]]
            same = held == key[open_]
            out[open_[same]] = self.values[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return out


class PrefixTable:
    """A vocabulary for ``encode``.

    ``tokens`` maps sequences of symbols to ids. ``merges`` (left, right, made) names the pairs that merge; without
    it all pairs do whose symbols together are a token. Tokens that no merges make are never used.
    """

    def __init__(self, tokens: dict[Sequence[int], int], merges: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        names = sorted(tokens, key=len)
        self.size = np.zeros(max(tokens.values()) + 1, np.int64)
        ids, sizes = np.array([tokens[x] for x in names], np.int64), np.array([len(x) for x in names], np.int64)
        self.size[ids] = sizes
        spelt = np.full((len(names), sizes[-1]), -1, np.int64)
        spelt[np.arange(sizes[-1]) < sizes[:, None]] = np.concatenate([np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.array(x) for x in names])
        self._trie(spelt, sizes, ids)
        if merges is None:
            merges = self._splits(spelt, sizes, ids)
            self.pairs = Lookup(*merges, NEVER)
            merges = self._halve(*merges)
        else:
            self.pairs = Lookup(*merges, NEVER)
            merges = self._halve(*merges)
        self.usable = np.zeros(len(self.size), bool)
        self.usable[ids[sizes == 1]] = True
        self.usable[merges[2]] = True
        self.token = np.where((self.token >= 0) & self.usable[self.token], self.token, -1)

    def _trie(self, spelt: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        node, made = np.zeros(len(ids), np.int64), 1
        parents, symbols, children, self.token = [], [], [], np.full(int(sizes.sum()) + 1, -1, np.int64)
        for depth in range(spelt.shape[1]):
            alive = np.flatnonzero(sizes > depth)
            keys, which = np.unique((node[alive] << 20) | spelt[alive, depth], return_inverse=True)
            node[alive] = made + which
            parents.append(keys >> 20)
            symbols.append(keys & 0xFFFFF)
            children.append(np.arange(made, made + len(keys)))
            made += len(keys)
            ends = alive[sizes[alive] == depth + 1]
            self.token[node[ends]] = ids[ends]
        self.steps = Lookup(np.concatenate(parents), np.concatenate(symbols), np.concatenate(children), 0)
        self.token = self.token[:made]

    def _splits(self, spelt: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ways to make a token of two."""
        before, node = np.full((len(ids), spelt.shape[1] + 1), -1, np.int64), np.zeros(len(ids), np.int64)
        for depth in range(spelt.shape[1]):
            alive = np.flatnonzero(sizes > depth)
            node[alive] = self.steps.get(node[alive], spelt[alive, depth])
            before[alive, depth + 1] = self.token[node[alive]]
        found = []
        for cut in range(1, spelt.shape[1]):
            rows = np.flatnonzero((sizes > cut) & (before[:, cut] >= 0))
            node = np.zeros(len(rows), np.int64)
            for depth in range(cut, spelt.shape[1]):
                ends = sizes[rows] == depth
                hit = rows[ends], self.token[node[ends]]
                found.append((before[hit[0], cut], hit[1], ids[hit[0]]))
                node, rows = node[~ends], rows[~ends]
                node = self.steps.get(node, spelt[rows, depth])
                node, rows = node[node > 0], rows[node > 0]
            found.append((before[rows, cut], self.token[node], ids[rows]))
        left, right, made = (np.concatenate(x) for x in zip(*found, strict=True))
        good = right >= 0
        return left[good], right[good], made[good]

    def _halve(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that do make their token, entered as its halves; short tokens first, as longer ones rest on them."""
        self.left = np.arange(len(self.size))
        self.right = self.left.copy()
        usable, kept = self.size == 1, []
        for n in np.unique(self.size[made]):
            own = np.flatnonzero((self.size[made] == n) & usable[left] & usable[right])
            own = own[self.apart(left[own], right[own], made[own])]
            self.left[made[own]], self.right[made[own]], usable[made[own]] = left[own], right[own], True
            kept.append(own)
        own = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        return left[own], right[own], made[own]

    def apart(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether two neighbours stay apart when their symbols are encoded together, up to the merge ``limit``.

        Merges are undone from the last one back, on the side where it happened; if at some time the tokens
        at the border had a merge that was due earlier, the two are not apart.
        """
        out, at = np.zeros(len(left), bool), np.arange(len(left))
        limit = np.full(len(left), NEVER) if limit is None else limit
        while len(at):
            go = np.flatnonzero(self.pairs.get(left, right) >= limit)
            at, left, right = at[go], left[go], right[go]
            undo = left > right
            whole = np.where(undo, left, right)
            limit = np.where(undo, left, right + 1)
            new = np.where(undo, self.right[left], self.left[right])
            done = new == whole  # a single symbol: nothing is left to undo, as the other is single too
            out[at[done]] = True
            go = np.flatnonzero(~done)
            left, right = np.where(undo, new, left)[go], np.where(undo, right, new)[go]
            at, limit = at[go], limit[go]
        return out

    def last_tokens(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """From a matrix of symbols (place, piece), the longest pieces first: the last token of each prefix (length, piece), -1 beyond a piece."""
        last = np.full((len(symbols) + 1, len(sizes)), -1, np.int64)
        longer = np.searchsorted(-sizes, -np.arange(len(symbols) + 1), "left")  # pieces of more than so many symbols
        for start in range(len(symbols)):
            rows = np.arange(longer[start])
            node = np.zeros(len(rows), np.int64)
            for end in range(start + 1, len(symbols) + 1):
                rows = rows[: np.searchsorted(rows, longer[end - 1])]
                node = self.steps.get(node[: len(rows)], symbols[end - 1, rows])
                on = np.flatnonzero(node)
                if not len(on):
                    break
                node, rows = node[on], rows[on]
                token = self.token[node]
                found = np.flatnonzero((token >= 0) & (last[end, rows] < 0))
                if start:
                    found = found[self.apart(last[start, rows[found]], token[found])]
                last[end, rows[found]] = token[found]
        return last

    def encode(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one behind the other, number of ids of each). Pieces of no symbols have none."""
        order = np.argsort(-sizes, kind="stable")
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(order), BLOCK):
            own = order[at : at + BLOCK]
            n, most = sizes[own], int(sizes[own[0]])
            if most > LONGEST and len(own) > 1:  # few are long: each by itself, so short ones need no wide matrix
                few = int(np.searchsorted(-n, -LONGEST, "left"))
                for k in range(few):
                    found = self._encode(symbols, starts[own[k : k + 1]], n[k : k + 1])
                    ids.append(found[0])
                    counts.append(found[1])
                own, n = own[few:], n[few:]
            found = self._encode(symbols, starts[own], n)
            ids.append(found[0])
            counts.append(found[1])
        flat, number = np.concatenate(ids), np.concatenate(counts)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return spread(flat, (np.cumsum(number) - number)[back], number[back]), number[back]

    def _encode(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sizes) or not sizes[0]:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        place = np.arange(sizes[0])[:, None]
        inside = place < sizes
        last = self.last_tokens(np.where(inside, symbols[np.where(inside, starts + place, 0)], 0).astype(np.int64), sizes)
        rows, at, steps = np.arange(len(sizes)), sizes.copy(), []
        while len(rows := rows[at[rows] > 0]):
            token = last[at[rows], rows]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a symbol")
            steps.append((rows, token))
            at[rows] -= self.size[token]
        counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=len(sizes))
        ends, out = np.cumsum(counts), np.empty(int(counts.sum()), np.int64)
        for k, (r, token) in enumerate(steps):
            out[ends[r] - 1 - k] = token
        return out, counts
