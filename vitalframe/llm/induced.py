"""Suffix sorting by recursive induction with common-prefix values.

The suffixes that begin at local minima are sorted first: their substrings are named in order, and the string of
names is sorted by the same method unless all names differ. Induction then gives every other suffix its place. A
queue hands out suffixes by first symbol and, of equal symbols, by arrival, which is the order of what follows them;
each suffix handed out enters the one that begins before it. With it travels its common prefix with the
predecessor in its bucket: one more than the least value between the two that induced them. The queues are files
that are read back whole, and memory holds several arrays of the text's length: texts are to be small (shards of about
1 MB). Equal symbols leave in whole batches.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Common prefixes are told apart up to here.
CAP = 200


def _queue(n: int, kind) -> np.ndarray:
    """An array in an unnamed scratch file that ends with the task."""
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,)) if n else np.zeros(0, kind)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... of all ranges one after the other."""
    total = int(count.sum())
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)


class _LeastBetween:
    """Minima of ranges of one batch."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum of values[low:high] per pair; ranges are not empty."""
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(low), np.int16)
        for k in np.unique(level):
            at = level == k
            row = self.rows[k]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(k))])
        return out


def _induce(symbol, is_kind, run, seeds, seed_lcp):
    """Order all suffixes of one kind from the sorted ``seeds``.

    ``symbol`` is ascending in the direction of the scan, and a suffix of the kind enters a bucket that is not
    before the one of the suffix behind it. Returns (suffixes, common prefix with the one before) by bucket.
    """
    width = int(symbol.max()) + 1
    size = np.bincount(symbol[is_kind], minlength=width)
    begin = np.concatenate([[0], np.cumsum(size)])
    seed_size = np.bincount(symbol[seeds], minlength=width)
    seed_begin = np.concatenate([[0], np.cumsum(seed_size)])
    suffixes, prefixes = _queue(int(begin[-1]), np.int32), _queue(int(begin[-1]), np.int16)
    filled = np.zeros(width, np.int64)
    least = np.full(width, CAP, np.int16)  # since the last entry of each bucket

    def hand_out(items: np.ndarray, lcp: np.ndarray) -> None:
        """Enter what begins before ``items``; lcp: with the item scanned before."""
        before = items - 1
        at = np.flatnonzero((items > 0) & is_kind[before])
        down = np.minimum.accumulate(lcp)
        if len(at):
            to = symbol[before[at]]
            order = np.argsort(to, kind="stable")
            at, to = at[order], to[order]
            fresh = np.ones(len(at), bool)
            fresh[1:] = to[1:] != to[:-1]
            heads = np.flatnonzero(fresh)
            group = np.cumsum(fresh) - 1
            slot = begin[to] + filled[to] + np.arange(len(at)) - heads[group]
            value = np.empty(len(at), np.int16)
            value[heads] = np.minimum(least[to[heads]], down[at[heads]])
            rest = np.flatnonzero(~fresh)
            if len(rest):
                value[rest] = _LeastBetween(lcp)(at[rest - 1] + 1, at[rest] + 1)
            value = np.minimum(value + 1, CAP)
            value[heads[filled[to[heads]] == 0]] = 0
            suffixes[slot] = before[at]
            prefixes[slot] = value
            filled[to[heads]] += np.diff(np.append(heads, len(at)))
        np.minimum(least, down[-1], out=least)
        if len(at):
            tails = np.append(heads[1:], len(at)) - 1
            up = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.int16(CAP))
            least[to[tails]] = up[at[tails] + 1]

    def seeds_of(low: int, high: int):
        part = slice(seed_begin[low], seed_begin[high])
        items, lcp = seeds[part], seed_lcp[part].copy()
        heads = seed_begin[low:high][seed_size[low:high] > 0] - seed_begin[low]
        buckets = np.arange(low, high)[seed_size[low:high] > 0]
        lcp[heads] = 0
        met = filled[buckets] > 0
        last = suffixes[begin[buckets[met]] + filled[buckets[met]] - 1]
        lcp[heads[met]] = np.minimum(np.minimum(run[last], run[items[heads[met]]]), CAP)
        return items, lcp

    bucket, step = 0, 1
    while bucket < width:
        high = min(bucket + step, width)
        if high - bucket > 1:
            # several buckets at once, unless one enters another
            parts = _ranges(begin[bucket:high], filled[bucket:high])
            mine, own = np.asarray(suffixes[parts]), np.asarray(prefixes[parts])
            items, lcp = seeds_of(bucket, high)
            both = np.concatenate([mine, items])
            before = both[both > 0] - 1
            to = symbol[before[is_kind[before]]]
            if len(to) and to.min() < high:
                step = max(1, int(to.min()) - bucket)
                if step > 1:
                    continue
                high = bucket + 1
            else:
                if len(both):
                    place = np.argsort(symbol[both], kind="stable")  # a bucket's entries stay before its seeds
                    hand_out(both[place], np.concatenate([own, lcp])[place])
                bucket, step = high, step * 2
                continue
        seen = 0
        while seen < filled[bucket]:  # entries may enter their own bucket
            part = slice(begin[bucket] + seen, begin[bucket] + filled[bucket])
            seen = int(filled[bucket])
            hand_out(np.array(suffixes[part]), np.array(prefixes[part]))
        items, lcp = seeds_of(bucket, bucket + 1)
        if len(items):
            hand_out(items, lcp)
        bucket, step = bucket + 1, 2
    return suffixes, prefixes, begin


def _names(text: np.ndarray, rising: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings from each minimum to the next, both included."""
    length = np.append(np.diff(minima) + 1, 1)
    key = text.astype(np.int64) * 2 + rising + 1
    bits = int(key.max()).bit_length()
    per = max(1, 62 // bits)
    rank = np.zeros(len(minima), np.int64)
    open_ = np.arange(len(minima))
    done = 0
    while len(open_):
        chunk = np.zeros(len(open_), np.int64)
        for k in range(done, done + per):
            here = np.minimum(minima[open_] + k, len(text) - 1)
            chunk = (chunk << bits) | np.where(k < length[open_], key[here], 0)
        order = np.lexsort((chunk, rank[open_]))
        r, c = rank[open_][order], chunk[order]
        # a rank is the number of substrings before its group, so that groups split in place
        new = np.ones(len(order), bool)
        new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
        base = np.ones(len(order), bool)
        base[1:] = r[1:] != r[:-1]
        at = np.arange(len(order))
        rank[open_[order]] = r + (np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(base, at, 0)))
        done += per
        alone = new & np.append(new[1:], True)
        open_ = open_[order[~alone]]
        open_ = open_[length[open_] > done]
    return np.unique(rank, return_inverse=True)[1]


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, up to CAP) of a text whose last symbol, 0,
    occurs once."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int16)
    text = text.astype(np.int32)
    slope = np.sign(np.diff(text))
    at = np.where(slope != 0, np.arange(n - 1), n - 1)
    turn = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal symbols ends
    rising = np.ones(n, bool)
    rising[:-1] = slope[np.minimum(turn, n - 2)] > 0
    run = np.append(turn - np.arange(n - 1) + 1, 1)
    least = np.zeros(n, bool)
    least[1:] = rising[1:] & ~rising[:-1]
    minima = np.flatnonzero(least)
    names = _names(text, rising, minima)
    m = len(minima)
    if names.max() + 1 == m:
        order, same = np.argsort(names), np.zeros(m, np.int16)
    else:
        order, same = suffix_array(names)
    lcp = np.zeros(m, np.int16)
    if m > 1:
        # common names, then the symbols of the first names that differ
        a, b, h = order[:-1].astype(np.int64), order[1:].astype(np.int64), same[1:].astype(np.int64)
        x, y = minima[np.minimum(a + h, m - 1)], minima[np.minimum(b + h, m - 1)]
        value = x - minima[a]
        live = np.flatnonzero((value < CAP) & (h < CAP))
        while len(live):
            k = value[live] - (x[live] - minima[a[live]])
            more = text[x[live] + k] == text[y[live] + k]
            value[live[more]] += 1
            live = live[more]
            live = live[value[live] < CAP]
        value[h >= CAP] = CAP
        lcp[1:] = np.minimum(value, CAP)
    falling, falling_lcp, low = _induce(text, ~rising, run, minima[order], lcp)
    # the second pass runs from the largest symbol down; its seeds are the falling suffixes, largest first
    top = int(text.max())
    seed_lcp = np.zeros(len(falling), np.int16)
    seed_lcp[1:] = falling_lcp[::-1][:-1]
    kind = rising.copy()
    kind[-1] = False
    up, up_lcp, high = _induce(top - text, kind, run, np.asarray(falling[::-1]), seed_lcp)
    # per symbol: the falling suffixes, then the rising ones
    up, up_lcp = np.asarray(up)[::-1], np.append(np.asarray(up_lcp)[::-1], 0)
    count_low, count_up = np.diff(low), np.diff(high)[::-1]
    out, out_lcp = np.empty(n, np.int32), np.zeros(n, np.int16)
    out[0] = n - 1
    begin = 1 + np.concatenate([[0], np.cumsum(count_low + count_up)])
    place_low = _ranges(begin[:-1], count_low)
    place_up = _ranges(begin[:-1] + count_low, count_up)
    out[place_low], out_lcp[place_low] = falling, falling_lcp
    out[place_up], out_lcp[place_up] = up, up_lcp[:-1]
    # a rising suffix's value is with the one behind it in the downward scan: shift to the one before
    first_up = np.concatenate([[0], np.cumsum(count_up)])[:-1]
    shifted = np.empty(len(up), np.int16)
    shifted[1:] = up_lcp[:-2]
    shifted[first_up[count_up > 0]] = 0
    out_lcp[place_up] = shifted
    both = np.flatnonzero((count_low > 0) & (count_up > 0))
    edge = begin[both] + count_low[both]
    out_lcp[edge] = np.minimum(np.minimum(run[out[edge]], run[out[edge - 1]]), CAP)
    return out, out_lcp
