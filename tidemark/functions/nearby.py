"""Near digests among the rows that one task holds: NumPy over packed digests (see functions.digest).

Within distance d at most d of the 128 two-bit values differ, so of d + 1 windows one is equal. Rows are sorted by each
window in turn and only rows with an equal window are compared: first their heads, which exceed the distance for most,
then the planes of those left. No pair within the distance is missed, and a pair's first equal window alone gives it.
"""

from __future__ import annotations

import numpy as np

#: Candidates that are compared at a time.
CHUNK = 1 << 20
#: Upper and lower plane of the first 64 values and of the others.
HALVES = (0, 2), (1, 3)
#: Pairs of queries and rows that are compared at a time, so that they stay in a core's cache, and queries among them.
TILE, TOGETHER = 1 << 17, 128
#: More than any distance.
FAR = 1 << 14
#: The value of a hex digit by its byte, and of a digit's two values the upper and the lower bits.
DIGITS = np.zeros(256, np.uint8)
DIGITS[np.frombuffer(b"0123456789ABCDEF", np.uint8)] = np.arange(16)
UPPER_BITS, LOWER_BITS = (np.array([(n >> (x + 1) & 2) | (n >> x & 1) for n in range(16)], np.uint8) for x in (1, 0))


def ring(a: np.ndarray, b: np.ndarray, m: int) -> np.ndarray:
    d = np.abs(a - b)
    return np.minimum(d, m - d)


def head_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """digest.head_distance of int32 arrays."""
    r = ring(a >> 8 & 255, b >> 8 & 255, 256)
    out = (a >> 16 != b >> 16) + np.where(r > 1, 12 * r, r)
    for s in (4, 0):
        q = ring(a >> s & 15, b >> s & 15, 16)
        out += np.maximum(q, 12 * q - 12)
    return out


def _half(ah, al, bh, bl) -> np.ndarray:
    """The distance of 64 values."""
    high, low = ah ^ bh, al ^ bl
    both = high & low
    three = both & (ah & al | bh & bl)
    return np.bitwise_count(low).astype(np.int32) + 2 * np.bitwise_count(high ^ both).astype(np.int32) + 5 * np.bitwise_count(three).astype(np.int32)


#: The shares of two length values and of two bytes of ratios in the distance.
LENGTHS, RATIOS = (head_distance(x[:, None], x).astype(np.int16) for x in (np.arange(256, dtype=np.int32) << 8, np.arange(256, dtype=np.int32)))


def plane_distance(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The distance of the 128 values. a, b: h0, h1, l0, l1 as uint64."""
    return sum(_half(a[h], a[l], b[h], b[l]) for h, l in HALVES)


def _bits(planes: list[np.ndarray], start: int, n: int) -> np.ndarray:
    """Bits start..start+n-1 of a plane of 128 bits, the first one highest."""
    i, off = divmod(start, 64)
    mask = np.uint64((1 << n) - 1)
    if off + n <= 64:
        return planes[i] >> np.uint64(64 - off - n) & mask
    lo = off + n - 64
    return (planes[i] << np.uint64(lo) | planes[i + 1] >> np.uint64(64 - lo)) & mask


def windows(planes: list[np.ndarray], n: int) -> list[np.ndarray]:
    """The values of n windows as one integer each."""
    cuts = [128 * i // n for i in range(n + 1)]
    return [_bits(planes[:2], a, b - a) << np.uint64(b - a) | _bits(planes[2:], a, b - a) for a, b in zip(cuts, cuts[1:])]


def _expanded(order: np.ndarray, begin: np.ndarray, end: np.ndarray):
    """Blocks of (i, j): row order[t] with each of order[begin[t]:end[t]], about CHUNK pairs a block."""
    counts = np.maximum(end - begin, 0)
    some = np.flatnonzero(counts)
    counts, begin = counts[some], begin[some]
    total = np.cumsum(counts)
    a = 0
    while a < len(some):
        before = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, before + CHUNK, "right")))
        n = counts[a:b]
        right = np.arange(int(total[b - 1] - before)) + np.repeat(begin[a:b] - (total[a:b] - n - before), n)
        yield order[np.repeat(some[a:b], n)], order[right]
        a = b


def _near(head, planes, i, j, within):
    """Of pairs i, j those within the distance, with it."""
    d = head_distance(head[i], head[j])
    ok = np.flatnonzero(d <= within)
    i, j, d = i[ok], j[ok], d[ok]
    d = d + plane_distance([p[i] for p in planes], [p[j] for p in planes])
    ok = np.flatnonzero(d <= within)
    return i[ok], j[ok], d[ok].astype(np.int32)


def near_pairs(head: np.ndarray, planes: list[np.ndarray], own: np.ndarray, within: int):
    """Blocks of (i, j, distance): all pairs of rows within the distance of which one is own, each once."""
    keys = windows(planes, within + 1)
    for w, key in enumerate(keys):
        order = np.argsort(key, kind="stable")
        at = key[order]
        for i, j in _expanded(order, np.arange(1, len(at) + 1), np.searchsorted(at, at, "right")):
            for v in keys[:w]:  # a pair with an earlier equal window came there
                ok = np.flatnonzero(v[i] != v[j])
                i, j = i[ok], j[ok]
            ok = np.flatnonzero(own[i] | own[j])
            i, j, d = _near(head, planes, i[ok], j[ok], within)
            if len(i):
                yield i, j, d


def _joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its set) after the sets of i and j were made one."""
    while True:
        a, b = label[i], label[j]
        ok = np.flatnonzero(a != b)
        if not len(ok):
            return label
        i, j, a, b = i[ok], j[ok], a[ok], b[ok]
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up, up[up]):
            up = up[up]
        label = up[label]


def near_sets(head: np.ndarray, planes: list[np.ndarray], within: int, label: np.ndarray | None = None) -> np.ndarray:
    """Per row the least row that it reaches over pairs within the distance. label: sets known to hang together.

    Rows next to each other are compared first, which joins what is dense; then only rows of different sets are, so
    a mass of like digests does not cost its square.
    """
    label = np.arange(len(head)) if label is None else label
    keys = windows(planes, within + 1)
    for key in keys:
        order = np.argsort(key, kind="stable")
        ok = np.flatnonzero(key[order][1:] == key[order][:-1])
        i, j, _ = _near(head, planes, order[ok], order[ok + 1], within)
        label = _joined(label, i, j)
    for key in keys:
        order = np.lexsort((label, key))
        at, of = key[order], label[order]
        last = np.searchsorted(at, at, "right")
        cut = np.flatnonzero(np.r_[(at[1:] != at[:-1]) | (of[1:] != of[:-1]), True]) + 1  # ends of runs of one key and set
        for i, j in _expanded(order, cut[np.searchsorted(cut, np.arange(len(at)), "right")], last):
            ok = np.flatnonzero(label[i] != label[j])
            i, j, _ = _near(head, planes, i[ok], j[ok], within)
            label = _joined(label, i, j)
    return label


def near_first(head: np.ndarray, planes: list[np.ndarray], rank: np.ndarray, within: int) -> np.ndarray:
    """Per row the row of least rank within the distance, itself included.

    A window's equal rows are met in the order of rank, a few at a time, so a row stops at the first that is near.
    """
    best = rank.copy()
    of = np.empty(len(rank), np.int64)
    of[rank] = np.arange(len(rank))
    for key in windows(planes, within + 1):
        order = np.lexsort((rank, key))
        at = key[order]
        begin, own = np.searchsorted(at, at), np.arange(len(at))
        width = 4
        while len(own):
            # own: places in order that still look; begin: where they go on. Candidates are those before themselves.
            end = np.minimum(begin + width, own)
            full_b, full_e = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            full_b[own], full_e[own] = begin, end
            for i, j in _expanded(order, full_b, full_e):
                ok = np.flatnonzero(rank[j] < best[i])
                i, j, _ = _near(head, planes, i[ok], j[ok], within)
                np.minimum.at(best, i, rank[j])
            more = end < own
            more[more] = rank[order[end[more]]] < best[order[own[more]]]
            own, begin, width = own[more], end[more], width * 2
    return of[best]


def _pack(digits: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    n = digits[:, :6].astype(np.int32)
    head = n[:, 0] << 20 | n[:, 1] << 16 | n[:, 3] << 12 | n[:, 2] << 8 | n[:, 4] << 4 | n[:, 5]
    planes = []
    for bits in (UPPER_BITS, LOWER_BITS):
        c = bits[digits[:, 6:]]
        c = c[:, ::4] << 6 | c[:, 1::4] << 4 | c[:, 2::4] << 2 | c[:, 3::4]
        planes += list(np.ascontiguousarray(c.view(">u8").astype(np.uint64).T))
    return head, planes


def pack(digests) -> tuple[np.ndarray, list[np.ndarray]]:
    """head and planes of an Arrow array of digests of 70 hex digits, as from digest.pack."""
    return _pack(DIGITS[np.array(digests.to_pylist(), "S70").view(np.uint8).reshape(-1, 70)])


def pack_bytes(digests) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of an Arrow array of digests of 35 bytes."""
    b = np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 35)
    return _pack(np.stack([b >> 4, b & 15], axis=2).reshape(-1, 70))


def _places(edge: list[int], first: int, last: int) -> list[tuple[int, int]]:
    """Where the rows of length values first..last are, on the ring of 256; some that have rows."""
    if last < first:
        return []
    a, b = first & 255, last & 255
    return [(x, y) for x, y in ([(edge[a], edge[b + 1])] if a <= b else [(edge[a], edge[256]), (0, edge[b + 1])]) if x < y]


def nearest(q_head: np.ndarray, q_planes: list[np.ndarray], head: np.ndarray, planes: list[np.ndarray], itself: dict[int, int], within: int | None = None):
    """Of each query the least distance to a row and all rows at that distance. itself: rows that are no answer, by query.

    Rows of like length values are met first; they give a bound beyond which no length value is looked at. Length value
    and ratios, then the first half of the values, are lower bounds too: rows whose bound exceeds the best so far are left
    out. within: the bound to begin with, for callers to whom a query with no row within it is one without an answer.
    Returns the queries with an answer, distances, arrays of rows.
    """
    order = np.argsort(head & 0xFFFF, kind="stable")  # by length value, then ratios
    s_head, s_planes = head[order], [p[order] for p in planes]
    lengths, ratios, checksums = (s_head >> 8 & 255).astype(np.intp), (s_head & 255).astype(np.intp), s_head >> 16
    edge = np.searchsorted(lengths, np.arange(257)).tolist()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which, least, rows = [], [], []
    for i in range(len(q_head)):
        best, at = FAR if within is None else within, []
        q, own = [p[i] for p in q_planes], int(q_head[i]) >> 8 & 255
        of_length, of_ratios = LENGTHS[own], RATIOS[q_head[i] & 255]
        skip = place[itself[i]] if i in itself else -1
        seen, step = -1, 0
        while seen < 128:
            # All steps that the bound leaves; as long as there is none, twice as many each time.
            step = min(128, best // 12 if best >= 24 else min(best, 1)) if best < FAR else min(128, 2 * step or seen + 1)
            if step <= seen:
                break
            left, right = (own - min(step, 127), own - seen - 1), (own + max(seen + 1, 1), own + step)
            seen = step
            for a, b in _places(edge, *left) + _places(edge, *right):
                d = of_length[lengths[a:b]] + of_ratios[ratios[a:b]]
                ok = np.flatnonzero(d <= best)
                j = ok + a
                d = d[ok] + (checksums[j] != q_head[i] >> 16)
                if best == FAR and len(j) > 4096:  # a first bound from those of like heads
                    few = np.argpartition(d, 4096)[:4096]
                    few = few[j[few] != skip]
                    bound = int((d[few] + plane_distance([p[j[few]] for p in s_planes], q)).min())
                    ok = d <= bound
                    j, d = j[ok], d[ok]
                for h, l in HALVES:
                    d = d + _half(s_planes[h][j], s_planes[l][j], q[h], q[l])
                    ok = np.flatnonzero(d <= best)
                    j, d = j[ok], d[ok]
                if skip >= 0:
                    ok = j != skip
                    j, d = j[ok], d[ok]
                if not len(j):
                    continue
                m = int(d.min())
                if m < best:
                    best, at = m, []
                if m == best:
                    at.append(j[d == m])
        if at:
            which.append(i)
            least.append(best)
            rows.append(order[np.concatenate(at)])
    return which, least, rows


def _groups(kinds: np.ndarray):
    """Places of queries that are compared together, of equal length value and first ratio. kinds: 16 bits of their heads."""
    order = np.argsort(kinds, kind="stable")
    of = kinds[order]
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
    a = 0
    for b in ends.tolist():
        # Second ratios are taken together as long as there are few queries.
        if b - a < TOGETHER // 8 and b < len(of) and of[b] >> 4 == of[a] >> 4:
            continue
        for x in range(a, b, TOGETHER):
            yield order[x : min(b, x + TOGETHER)]
        a = b


def least(q_head: np.ndarray, q_planes: list[np.ndarray], head: np.ndarray, planes: list[np.ndarray], skip: np.ndarray, within: int) -> np.ndarray:
    """Of each query the least distance to a row if it is at most within, else within + 1. skip: by query a row that is no answer, or -1.

    Queries of like heads go together. Of all rows whose length value and ratios are within the distance of one of them,
    nearest first, the lower bits are compared: each that differs is 1 at least. Whole distances are of what is left.
    """
    order = np.argsort(head & 0xFFFF, kind="stable")
    head, planes = head[order], [p[order] for p in planes]
    cells, first = np.unique(head & 0xFFFF, return_index=True)
    count = np.diff(np.append(first, len(head)))
    best = np.full(len(q_head), within + 1, np.int32)
    for mine in _groups(q_head & 0xFFFF):
        kinds = np.unique(q_head[mine] & 0xFFFF)
        cost = LENGTHS[kinds[0] >> 8, cells >> 8] + RATIOS[(kinds & 255)[:, None], cells & 255].min(axis=0)
        ok = np.argsort(cost, kind="stable")
        ok = ok[: np.count_nonzero(cost <= within)]
        n = count[ok]
        at = np.arange(n.sum()) + np.repeat(first[ok] - (np.cumsum(n) - n), n)
        cost = np.repeat(cost[ok], n)
        q = [p[mine][:, None] for p in q_planes[2:]]
        step = max(1, TILE // len(mine))
        for a in range(0, len(at), step):
            most = best[mine].max() - 1  # of use to one of these
            b = min(a + step, int(np.searchsorted(cost, most, "right")))
            if b <= a:
                break
            j = at[a:b]
            d = np.bitwise_count(planes[2][j] ^ q[0])
            d += np.bitwise_count(planes[3][j] ^ q[1])
            near = np.flatnonzero(d <= np.minimum(most - cost[a:b], 128).astype(np.uint8))
            i, j = np.divmod(near, b - a)
            d = d.ravel()[near] + cost[a + j]
            i, j = mine[i], at[a + j]
            ok = np.flatnonzero(d < best[i])
            i, j = i[ok], j[ok]
            d = head_distance(q_head[i], head[j])
            ok = np.flatnonzero(d < best[i])
            i, j = i[ok], j[ok]
            d = d[ok] + plane_distance([p[i] for p in q_planes], [p[j] for p in planes])
            ok = np.flatnonzero((d < best[i]) & (order[j] != skip[i]))
            np.minimum.at(best, i[ok], d[ok])
    return best
