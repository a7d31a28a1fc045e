"""Word multisets, their parity fingerprints and a vantage-point self-join over them.

A text is the multiset of its words; the k-th occurrence of a word is a term of its own, so that the
words two texts have in common, counted with repetition, are the terms they share. A fingerprint
has 128 bits; a term flips the bit its hash names. Sets of terms that differ in d terms have fingerprints
that differ in at most d bits, so a search within that Hamming distance misses no pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from versemill.llm.textform import word_lists

MIN_WORDS, SHARE = 10, 7  # words that take part at all; tenths of the longer text's words
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def term_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, terms): the terms of row i, ascending, are terms[offsets[i]:offsets[i + 1]].

    Null and empty texts have no terms.
    """
    lists = word_lists(texts)
    words = lists.flatten().dictionary_encode()
    names = words.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh64_intdigest(w.encode()) if w else 0 for w in names], np.uint64)
    flat = hashes[words.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.uint64)
    counts = np.nan_to_num(np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), counts)
    keep = flat != 0
    row, flat = row[keep], flat[keep]
    order = np.lexsort((flat, row))
    row, flat = row[order], flat[order]
    same = np.zeros(len(flat), bool)
    same[1:] = (flat[1:] == flat[:-1]) & (row[1:] == row[:-1])
    at = np.arange(len(flat))
    nth = at - np.maximum.accumulate(np.where(same, 0, at))  # 0 for the first occurrence in its row
    terms = np.where(nth == 0, flat, mix(flat + nth.astype(np.uint64) * _ODD))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int64)
    return offsets, terms


def _sums(values: np.ndarray, offsets: np.ndarray, ufunc) -> np.ndarray:
    """ufunc.reduce of each row's values; 0 for empty rows."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full])
    return out


def signatures(offsets: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are equal for equal multisets."""
    a, b = mix(terms), mix(terms ^ _ODD)
    return _sums(a, offsets, np.add), _sums(b, offsets, np.add)


def short_hashes(terms: np.ndarray) -> np.ndarray:
    """16 bits of each term; the last seven name the bit of the fingerprint that the term flips."""
    return (mix(terms + np.uint64(77)) >> np.uint64(48)).astype(np.uint16)


def prefix_parities(short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parities, as low and high 64 bits, of the first 0, 1, 2, ... terms of short_hashes(); those of a
    stretch are the exclusive or of the two at its ends."""
    one = np.left_shift(np.uint64(1), (short & np.uint16(63)).astype(np.uint64))
    upper = (short & np.uint16(64)) != 0
    none = np.zeros(1, np.uint64)
    return tuple(np.concatenate([none, np.bitwise_xor.accumulate(np.where(half, one, np.uint64(0)))]) if len(short) else none for half in (~upper, upper))


def needed(n: np.ndarray) -> np.ndarray:
    """Terms that a text must share with any partner not longer than itself."""
    return (SHARE * n + 9) // 10


def farthest(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The greatest Hamming distance of near-duplicates with n and m words; negative if there are none."""
    big, small = np.maximum(n, m), np.minimum(n, m)
    return np.where(needed(big) > small, -1, n + m - 2 * needed(big))


class Balls:
    """Records of one shard as balls in the Hamming space of their fingerprints, and the search for
    pairs of balls that meet.

    The words of a record stand in the order of the tree's vantage points, rarest first. A shard holds
    the records within n - 1 of its vantage points, the fingerprints of single words, that is those that
    have the word (the others are n + 1 away). `low` and `high` are the parities of the words after the shard's
    last one (low and high 64 bits) and `spent` are the words of the record before it that a partner lacks, if the shard's words
    are the first that both have. The radius of a ball is what is left of n - needed(n) then. By the
    triangle inequality a pair whose radii do not add up to the distance of its prints is no
    near-duplicate.

    `tail` holds the short_hashes of the words after the shard's last one up to the place where a record
    that met DEPTH further vantage points would have spent its radius; None if they are more than TAIL.
    """

    LEAF, DEPTH, TAIL, ROWS = 32, 2, 24, 2_000_000

    def __init__(self, low: np.ndarray, high: np.ndarray, n: np.ndarray, spent: np.ndarray, tail: list[bytes | None] | None = None):
        self.low, self.high, self.n, self.spent = low, high, n.astype(np.int64), spent.astype(np.int64)
        self.compared = self.splits = 0
        tail = tail if tail is not None else [None] * len(n)
        self.tailed = np.array([t is not None for t in tail], bool)
        self.words = np.frombuffer(b"".join(t or b"" for t in tail), np.uint16)
        self.begin = np.concatenate([[0], np.cumsum([len(t or b"") // 2 for t in tail])]).astype(np.int64)
        self.flipped = prefix_parities(self.words)

    def after(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prints of `rows` without the words of their tails up to the places `at`."""
        begin = self.begin[rows]
        return tuple(p[rows] ^ f[at + 1] ^ f[begin] for p, f in ((self.low, self.flipped[0]), (self.high, self.flipped[1])))

    def _matrix(self, i: np.ndarray, j: np.ndarray, same: bool):
        """All pairs of one of i and one of j (or of i alone, if same) whose balls meet."""
        if not i.size or not j.size:
            return
        reach = (self.n[i] - needed(self.n[i]) - self.spent[i]).max() + (self.n[j] - needed(self.n[j]) - self.spent[j]).max()
        step = max(1, self.ROWS // j.size)
        if same:
            step = min(step, max(32, j.size // 8))  # so that few pairs are looked at from both sides
        for s in range(0, i.size, step):
            other = j[s:] if same else j
            a = i[s : s + step]
            self.compared += a.size * other.size
            d = np.bitwise_count(self.low[a][:, None] ^ self.low[other][None, :])
            d += np.bitwise_count(self.high[a][:, None] ^ self.high[other][None, :])
            p, q = np.nonzero(d <= reach)
            if same:
                later = q > p
                p, q = p[later], q[later]
            x, y = a[p], other[q]
            keep = d[p, q] <= farthest(self.n[x], self.n[y]) - self.spent[x] - self.spent[y]
            yield x[keep], y[keep]

    def _groups(self, rows: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray, spent: np.ndarray):
        """The pairs within groups (ascending) whose balls meet."""
        lag = 1
        at = np.arange(len(rows))
        while True:
            at = at[: np.searchsorted(at, len(rows) - lag)]
            at = at[group[at] == group[at + lag]]
            if not at.size:
                return
            x, y = rows[at], rows[at + lag]
            self.compared += len(x)
            d = np.bitwise_count(low[at] ^ low[at + lag]) + np.bitwise_count(high[at] ^ high[at + lag])
            ok = d <= farthest(self.n[x], self.n[y]) - spent[at] - spent[at + lag]
            if ok.any():
                yield x[ok], y[ok]
            lag += 1

    def pairs(self, which: np.ndarray):
        """The pairs (arrays x, y; some more than once) among `which` that can be near-duplicates.

        A node is parted by the next vantage points, the words that its records have: a record goes to
        the branch of each of its words until its radius is spent, as its ball reaches over the
        boundaries of all of these. Branches of up to LEAF records, and nodes that would not save a
        tenth of the comparisons (large groups of copies), are compared pair by pair.
        """
        if which.size <= self.LEAF:
            yield from self._matrix(which, which, True)
            return
        bare, rows = which[~self.tailed[which]], which[self.tailed[which]]
        yield from self._matrix(bare, bare, True)
        yield from self._matrix(bare, rows, False)
        node = np.zeros(len(rows), np.int64)
        place, spent = self.begin[rows] - 1, self.spent[rows]
        for depth in range(1, self.DEPTH + 1):
            if not rows.size:
                return
            last = self.begin[rows + 1] - (self.DEPTH - depth)
            count = np.maximum(last - place - 1, 0)
            of = np.repeat(np.arange(len(rows)), count)
            at = np.arange(int(count.sum())) - (np.cumsum(count) - count)[of] + place[of] + 1
            key = node[of] << 16 | self.words[at].astype(np.int64)
            order = np.argsort(key, kind="stable")
            of, at, key = of[order], at[order], key[order]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            branch = np.cumsum(first) - 1
            size = np.bincount(branch).astype(np.int64)
            old = np.bincount(node)
            cost = np.bincount(node[of][first], size * size, minlength=len(old))
            split = cost < 0.9 * old * old
            self.splits += int(split.sum())
            for k in np.flatnonzero(~split & (old > 1)).tolist():  # a node that stays whole
                yield from self._whole(rows[node == k], spent[node == k], place[node == k])
            keep = split[node[of]]
            leaf = keep & (size[branch] <= self.LEAF if depth < self.DEPTH else True)
            use = spent[of] + at - place[of] - 1
            x = np.flatnonzero(leaf)
            yield from self._groups(rows[of[x]], branch[x], *self.after(rows[of[x]], at[x]), use[x])
            x = np.flatnonzero(keep & ~leaf)
            node = np.unique(branch[x], return_inverse=True)[1] if x.size else np.zeros(0, np.int64)
            rows, place, spent = rows[of[x]], at[x], use[x]

    def _whole(self, rows: np.ndarray, spent: np.ndarray, place: np.ndarray):
        held = Balls(*self.after(rows, place), self.n[rows], spent)
        for x, y in held._matrix(np.arange(len(rows)), np.arange(len(rows)), True):
            yield rows[x], rows[y]
        self.compared += held.compared

    def pairs_across(self, i: np.ndarray, j: np.ndarray):
        """The pairs of one of i and one of j whose balls meet."""
        yield from self._matrix(i, j, False)

    def met(self, p: int, others: np.ndarray) -> np.ndarray:
        """True for those of `others` whose balls meet that of p."""
        self.compared += len(others)
        d = np.bitwise_count(self.low[p] ^ self.low[others]) + np.bitwise_count(self.high[p] ^ self.high[others])
        return d <= farthest(self.n[p], self.n[others]) - self.spent[p] - self.spent[others]


def forest(n: int, edges, dense: int = 8, neighbours=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of `edges` (an iterator of array pairs) over 0..n-1, as two arrays.

    When there are more than `dense` edges a point, the rest is searched point by point with
    `neighbours(point, candidates)`, which never holds more than one row of the graph.
    """
    parent, a, b, seen = list(range(n)), [], [], 0

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in edges:
        seen += len(x)
        if seen > dense * n + 1000 and neighbours is not None:
            break
        for p, q in zip(x.tolist(), y.tolist()):
            r, s = root(p), root(q)
            if r != s:
                parent[max(r, s)] = min(r, s)
                a.append(p)
                b.append(q)
    else:
        return np.array(a, np.int64), np.array(b, np.int64)
    a, b, left = [], [], np.arange(n)
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            p = queue.pop()
            hit = neighbours(p, left)
            found, left = left[hit], left[~hit]
            a += [p] * found.size
            b += found.tolist()
            queue += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)
