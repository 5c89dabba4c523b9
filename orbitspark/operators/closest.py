"""The best candidate of each probe in one cell of profiles, in numpy: bounds first, the exact measure for what they leave.

Names are compared by one of two measures. `gestalt` is 2 M / (|a| + |b|) with M characters in matching blocks, `edit` is
1 - distance / longer length; two empty names are alike. No pair is left out that could be the best:

* Of the numbered characters of a name (first e, second e) those that the other name lacks are counted by 128 bits. Characters that
  share a bit can only make the count smaller, so it bounds M from above and the distance from below.
* M is at most the longest common subsequence, which bit strings give for many pairs at once.
* Characters that are alike at the same place bound the distance from above: a probe's best is at least that good.
* The measure itself goes to a probe's likeliest pair first, then to those that may still be as good.

Scores are compared at `places` decimal places, half up, so that no rounding of doubles decides between equal ones; then the smaller id wins.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are looked at in one step, about; pairs whose names are compared in one step; pairs of names that a worker remembers.
TILE, CHUNK, KEPT = 1 << 20, 1 << 14, 1 << 20
#: More than doubles of 32 bits lose in a bound.
SLACK = 1e-5
_kept: dict[tuple[str, str], int] = {}


def rounded(x, places: int):
    return np.floor(x * 10**places + 0.5) / 10**places


class _Names:
    """Different names of both sides as rows of character codes; codes below 2 fill the rows up and equal nothing on the other side."""

    def __init__(self, p: list[str], c: list[str]):
        self.p, self.c, n = p, c, len(p)
        both = np.array(p + c)
        chars = both.view(np.uint32).reshape(len(both), -1)
        lens = np.fromiter(map(len, p + c), np.int32, len(both))
        real = np.arange(chars.shape[1]) < lens[:, None]
        alphabet, codes = np.unique(chars[real], return_inverse=True)
        self.size = len(alphabet) + 2
        rows = np.repeat((np.arange(len(both)) >= n).astype(np.min_scalar_type(self.size)), chars.shape[1]).reshape(chars.shape)
        rows[real] = codes + 2
        marks = _signatures(rows, real, self.size)
        self.pa, self.ca, self.pl, self.cl, self.pm, self.cm = rows[:n], rows[n:], lens[:n], lens[n:], marks[:n], marks[n:]

    def lacking(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters of p that c lacks and of c that p lacks, at least, for p's names lo to hi and all of c's."""
        a, b = self.pm[lo:hi, None, :], self.cm[None, :, :]
        of_p = sum(np.bitwise_count(a[..., w] & ~b[..., w]).astype(np.int16) for w in (0, 1))
        of_c = sum(np.bitwise_count(~a[..., w] & b[..., w]).astype(np.int16) for w in (0, 1))
        return of_p, of_c

    def in_place(self, lo: int, hi: int) -> np.ndarray:
        """Characters that are alike at the same place."""
        out = np.zeros((hi - lo, len(self.c)), np.int16)
        for x in range(self.pa.shape[1]):
            out += self.pa[lo:hi, None, x] == self.ca[None, :, x]
        return out

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common subsequence of names a and b, pair by pair; the shorter length where a has more than 64 characters."""
        out = np.minimum(self.pl[a], self.cl[b])
        short = np.flatnonzero(self.pl[a] <= 64)
        names, at = np.unique(a[short], return_inverse=True)
        masks = np.zeros((len(names), self.size), np.uint64)
        for x in range(min(64, self.pa.shape[1])):
            code = self.pa[names, x]
            masks[np.arange(len(names)), code] |= np.where(code >= 2, np.uint64(1 << x), np.uint64(0))
        for k in range(0, len(short), CHUNK):
            s, m = short[k : k + CHUNK], at[k : k + CHUNK]
            text, v = self.ca[b[s]], np.full(len(s), ~np.uint64(0))
            for x in range(int(self.cl[b[s]].max(initial=0))):
                u = v & masks[m, text[:, x]]
                v = (v + u) | (v - u)
            out[s] = np.bitwise_count(~v)
        return out

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Edit distance of names a and b, pair by pair. Row i of the usual table holds D[i, j] - j, so that its running minimum is the row."""
        out = np.empty(len(a), np.int32)
        step = max(1, CHUNK * 32 // max(32, self.pa.shape[1]))
        kind = np.int8 if self.pa.shape[1] < 60 else np.int32
        for k in range(0, len(a), step):
            x, y = a[k : k + step], b[k : k + step]
            la, lb = self.pl[x], self.cl[y]
            s, t = np.ascontiguousarray(self.pa[x].T), np.ascontiguousarray(self.ca[y].T)[: int(lb.max(initial=0))]
            row, done = np.zeros((len(t) + 1, len(x)), kind), lb.astype(np.int32)
            for i in range(int(la.max(initial=0))):
                new = np.empty_like(row)
                new[0] = i + 1
                np.minimum(row[:-1] + (t != s[i]) - kind(1), row[1:] + kind(1), out=new[1:])
                for j in range(len(t)):
                    np.minimum(new[j], new[j + 1], out=new[j + 1])
                row = new
                ends = np.flatnonzero(la == i + 1)
                done[ends] = row[lb[ends], ends] + lb[ends]
            out[k : k + step] = done
        return out

    def gestalt(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Characters in matching blocks, pair by pair; pairs that this worker has met lately are remembered."""
        m, out, last = SequenceMatcher(None), np.empty(len(a), np.int32), None
        for k in np.argsort(b, kind="stable"):
            pair = self.p[a[k]], self.c[b[k]]
            n = _kept.get(pair)
            if n is None:
                if b[k] != last:
                    m.set_seq2(pair[1])
                    last = b[k]
                m.set_seq1(pair[0])
                n = sum(x.size for x in m.get_matching_blocks())
                if len(_kept) >= KEPT:
                    _kept.clear()
                _kept[pair] = n
            out[k] = n
        return out


def _signatures(rows: np.ndarray, real: np.ndarray, size: int) -> np.ndarray:
    """Two words of bits for each row's numbered characters."""
    n, length = rows.shape
    s = np.sort(np.where(real, rows, size).astype(np.int64), axis=1)
    at = np.broadcast_to(np.arange(length), s.shape)
    starts = np.ones(s.shape, bool)
    starts[:, 1:] = s[:, 1:] != s[:, :-1]
    bit = (s - 2 + (size - 2) * (at - np.maximum.accumulate(np.where(starts, at, 0), axis=1))) % 128
    out, every = np.zeros((n, 2), np.uint64), np.arange(n)
    for x in range(length):
        out[every, bit[:, x] >> 6] |= np.where(s[:, x] < size, np.left_shift(np.uint64(1), (bit[:, x] & 63).astype(np.uint64)), np.uint64(0))
    return out


def _coded(p: pa.Table, c: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column's values, the same on both sides; null is 0."""
    both = pa.chunked_array([*p[name].chunks, *c[name].chunks], p[name].type).combine_chunks()
    codes = pc.fill_null(pc.add(both.dictionary_encode().indices, 1), 0).to_numpy(zero_copy_only=False)
    return codes[: len(p)], codes[len(p) :]


def _names_of(t: pa.Table) -> tuple[np.ndarray, list[str]]:
    d = t["norm"].combine_chunks().dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()


def best_of_cell(p: pa.Table, c: pa.Table, measure: str, weights: dict[str, float], window: int, low: float | None, places: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """p(norm, day, regime, country) and c(satellite_id, ...), of which either all or none have a day on both sides → rows of p that have
    a candidate, each with the row of its best one, the names' similarity and the score; and c, to which these rows belong."""
    c = c.sort_by("satellite_id")
    pi, p_names = _names_of(p)
    order = np.argsort(pi, kind="stable")
    p = p.take(pa.array(order))
    pi, (ci, c_names) = pi[order], _names_of(c)
    names = _Names(p_names, c_names)
    dated = p["day"].null_count + c["day"].null_count == 0
    days = [t["day"].to_numpy() for t in (p, c)] if dated else None
    regimes, countries = _coded(p, c, "regime"), _coded(p, c, "country")
    found = []
    step = max(1, TILE // len(c))
    for first in range(0, len(p), step):
        found.append(_best_of_tile(slice(first, min(len(p), first + step)), names, pi, ci, days, regimes, countries, measure, weights, window, low, places))
    rows, cols, sims, scores = (np.concatenate(x) for x in zip(*found, strict=True))
    return order[rows], cols, sims, scores, c


def _best_of_tile(at: slice, names: _Names, pi, ci, days, regimes, countries, measure, weights, window, low, places):
    lo, hi = int(pi[at.start]), int(pi[at.stop - 1]) + 1
    ni, n = pi[at] - lo, len(names.c)
    pl, cl = names.pl[lo:hi, None], names.cl[None, :]
    of_p, of_c = names.lacking(lo, hi)
    if measure == "gestalt":
        part, whole = 2 * np.minimum(pl - of_p, cl - of_c), pl + cl
    else:
        whole = np.maximum(pl, cl)
        part = whole - np.maximum(np.maximum(of_p, of_c), np.abs(pl - cl))
    over = np.where(whole == 0, np.float32(1), part / np.maximum(whole, 1).astype(np.float32))
    by_row, by_col = hi - lo < len(ni), not np.array_equal(ci, np.arange(n))
    each = lambda x: (lambda y: y[:, ci] if by_col else y)(x[ni] if by_row else x)

    def gates(i, j):
        """Of rows and columns that broadcast: whether the gates let them through, what the other signals give, what all weigh, and days."""
        open_, got, total = True, 0.0, weights["name"]
        if regimes[0].any() and regimes[1].any():
            a, b = regimes[0][at][i], regimes[1][j]
            both = (a > 0) & (b > 0)
            open_, got, total = ~both | (a == b), weights["regime"] * both, weights["name"] + weights["regime"] * both
        if countries[0].any() and countries[1].any():
            x, y = countries[0][at][i], countries[1][j]
            open_ = open_ & ((x == 0) | (y == 0) | (x == y))
        if days is not None:
            apart = np.abs(days[0][at][i] - days[1][j])
            open_ = open_ & (apart <= window)
            got, total = got + weights["launch"] * (1.0 - apart / window), total + weights["launch"]
        shape = np.broadcast_shapes(i.shape, j.shape)
        return tuple(np.broadcast_to(x, shape) for x in (open_, got, total))

    every = (np.arange(at.stop - at.start)[:, None], np.arange(len(ci))[None, :])
    open_, got, total = gates(*every)
    got, total = np.float32(got), np.float32(total)
    half = 0.5 / 10**places + SLACK
    least = np.full(at.stop - at.start, -np.inf if low is None else low - half, np.float32)
    score = lambda sim: (np.float32(weights["name"]) * sim + got) / total
    if measure == "edit":
        under = np.where(whole == 0, np.float32(1), names.in_place(lo, hi) / np.maximum(whole, 1).astype(np.float32))
        least = np.maximum(least, np.where(open_, score(each(under)), -np.inf).max(axis=1, initial=-np.inf) - 2 * half)
    i, j = np.nonzero(open_ & (score(each(over)) >= least[:, None]))
    _, got, total = gates(i, j)
    key = ni[i].astype(np.int64) * n + ci[j]
    whole = whole.reshape(-1)

    def exact(sims):
        return rounded((weights["name"] * sims + got) / total, places)

    def sims_of(part, key):
        """Similarities from characters alike (gestalt) or the distance, as the measure counts them."""
        size = whole[key]
        safe = np.maximum(size, 1)
        return np.where(size == 0, 1.0, 2.0 * part / safe if measure == "gestalt" else 1.0 - part / safe)

    def once(of, keys):
        """of each different pair of names, once."""
        seen = np.zeros(len(whole), bool)
        seen[keys] = True
        pairs = np.flatnonzero(seen)
        return pairs, of(pairs // n + lo, pairs % n)

    table = np.zeros(len(whole), np.int32)
    pairs, counts = once(names.common if measure == "gestalt" else names.distance, key)
    table[pairs] = counts
    if measure == "gestalt":
        may = exact(sims_of(table[key], key)) >= least[i]
        i, j, key, got, total = (x[may] for x in (i, j, key, got, total))
        known, tries = np.zeros(len(whole), bool), 1
        while True:  # scores of pairs that are known, bounds of the others
            s, sure = exact(sims_of(table[key], key)), known[key]
            best = np.full(at.stop - at.start, -np.inf if low is None else rounded(low, places))
            np.maximum.at(best, i[sure], s[sure])
            keep = s >= best[i]
            i, j, key, got, total, s, sure = (x[keep] for x in (i, j, key, got, total, s, sure))
            open_ = np.flatnonzero(~sure)
            if not len(open_):
                break
            ordered = open_[np.lexsort((-s[open_], i[open_]))]
            starts = np.flatnonzero(np.diff(i[ordered], prepend=-1))
            rank = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))
            pairs, counts = once(names.gestalt, key[ordered[rank < tries]])
            table[pairs], known[pairs], tries = counts, True, tries * 2
    sims = sims_of(table[key], key)
    s = exact(sims)
    best = np.full(at.stop - at.start, -np.inf)
    np.maximum.at(best, i, s)
    good = s >= best[i] if low is None else (s >= best[i]) & (s >= rounded(low, places))
    i, j, sims, s = i[good], j[good], sims[good], s[good]
    one = np.flatnonzero(np.diff(i, prepend=-1))  # pairs lie by row, then by id
    return at.start + i[one], j[one], sims[one], s[one]
