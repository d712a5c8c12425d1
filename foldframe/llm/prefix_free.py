"""Prefix-free parsing of byte strings and the corpus order of their suffixes.

A trigger is a position whose 8-byte window hashes below a level, about one in ``PERIOD``; it depends on these
bytes alone.  Phrases run from one trigger to the end of the next trigger's window, so no phrase suffix longer
than a window is a prefix of another one.  ``repeated_windows`` sorts the suffixes of the distinct
phrases (the dictionary) and the suffixes of the phrase sequences (the parse); a text position has the order
of its phrase suffix and, among equal ones, that of the parse after its phrase.  In this order equal
windows are neighbours, and neighbours are compared byte by byte.
"""

from __future__ import annotations

import numpy as np

GRAM, PERIOD = 8, 40
_LEVEL = np.uint64((1 << 64) // PERIOD)


def grams(data: bytes, pad: int = 0) -> np.ndarray:
    """Big-endian integers of the 8 bytes at each position; ``pad`` zero bytes follow the data."""
    b = np.frombuffer(data + bytes(pad + GRAM - 1), np.uint8).astype(np.uint64)
    two = (b[:-1] << np.uint64(8)) | b[1:]
    four = (two[:-2] << np.uint64(16)) | two[2:]
    return (four[:-4] << np.uint64(32)) | four[4:]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def triggers(data: bytes, block: int = 1 << 21) -> np.ndarray:
    """Trigger positions of one string, in blocks of bounded memory."""
    out = []
    for at in range(0, max(0, len(data) - GRAM + 1), block):
        part = data[at:at + block + GRAM - 1]
        out.append(np.flatnonzero(mix(grams(part)[:len(part) - GRAM + 1]) < _LEVEL) + at)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def triggers_of_many(texts: list[bytes], block: int = 1 << 20) -> list[np.ndarray]:
    """``triggers`` of each text; short ones are hashed together."""
    out: list = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        if not group:
            return
        found = triggers(b"".join(texts[i] for i in group))
        lens = np.array([len(texts[i]) for i in group])
        starts = np.cumsum(lens) - lens
        cut = np.searchsorted(found, np.append(starts, lens.sum()))
        for n, i in enumerate(group):
            own = found[cut[n]:cut[n + 1]] - starts[n]
            out[i] = own[own + GRAM <= lens[n]]
        group.clear()

    for i, t in enumerate(texts):
        if len(t) >= block:
            out[i] = triggers(t)
            continue
        if size + len(t) > block:
            flush()
            size = 0
        group.append(i)
        size += len(t)
    flush()
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` numbers."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def _ranks(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank: how many are smaller, positions whose value occurs again)."""
    order = np.argsort(a)
    return _regroup(a[order], order, np.zeros(len(a), np.int64), None)


def _regroup(key: np.ndarray, where: np.ndarray, rank: np.ndarray, old: np.ndarray | None):
    """Ranks of the positions ``where``, sorted by ``key``; ``old`` is the rank of the group each was in."""
    index = np.arange(len(key))
    new = np.append(True, key[1:] != key[:-1]) if len(key) else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(new, index, 0))
    if old is None:
        rank[where] = first
    else:
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), index, 0))
        rank[where] = old + first - group
    again = ~(new & np.append(new[1:], True))
    return rank, where[again]


def _prefix_ranks(value: np.ndarray, rest: np.ndarray, width: int, until: int) -> np.ndarray:
    """Prefix doubling: the order of prefixes of ``width`` grows to at least ``until``; ``rest`` is what each
    suffix holds, and nothing sorts before anything.  Only what is still equal is sorted again."""
    rank, equal = _ranks(value)
    n = len(value)
    while width < until and len(equal):
        ahead = np.zeros(len(equal), np.int64)
        has = rest[equal] > width
        ahead[has] = rank[equal[has] + width] + 1
        key = rank[equal] * (n + 1) + ahead
        order = np.argsort(key)
        where = equal[order]
        rank, equal = _regroup(key[order], where, rank.copy(), rank[where])
        width *= 2
    return rank


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string the (first, end) ranges of positions whose window occurs elsewhere in the strings."""
    lens = np.array([len(s) for s in strings], np.int64)
    data = b"".join(strings)
    start = np.cumsum(lens) - lens
    x = grams(data, pad=window + GRAM)
    n = len(data)
    cuts = triggers_of_many(strings)
    # parse: phrase starts, the string of each, and the end of its text
    begin = np.concatenate([np.unique(np.append(c, 0)) + s for c, s in zip(cuts, start)])
    counts = np.array([len(np.unique(np.append(c, 0))) for c in cuts])
    owner = np.repeat(np.arange(len(strings)), counts)
    nxt = np.append(begin[1:], n)
    last = np.append(owner[1:] != owner[:-1], True)
    stop = np.where(last, (start + lens)[owner], nxt + GRAM)
    # dictionary
    ids: dict[bytes, int] = {}
    phrase = np.array([ids.setdefault(data[a:b], len(ids)) for a, b in zip(begin.tolist(), stop.tolist())], np.int64)
    words = list(ids)
    wlen = np.array([len(w) for w in words], np.int64)
    wstart = np.cumsum(wlen) - wlen
    wx = grams(b"".join(words))
    rest = np.repeat(wstart + wlen, wlen) - np.arange(wlen.sum())
    short = np.flatnonzero(rest < GRAM)
    wx[short] &= ~((np.uint64(1) << (np.uint64(8) * (GRAM - rest[short]).astype(np.uint64))) - np.uint64(1))
    suffix = _prefix_ranks(_ranks(wx)[0] * (GRAM + 1) + np.minimum(rest, GRAM), rest, GRAM, window)  # suffix array order of the dictionary
    # parse suffixes: deep enough that a window, however short its phrases, lies within
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(begin))
    order = _prefix_ranks(suffix[wstart[phrase]] * (int(wlen.max()) + 1) + wlen[phrase], left, 1, window)
    after = np.zeros(len(begin), np.int64)
    after[~last] = order[np.flatnonzero(~last) + 1] + 1
    # corpus order of the positions that hold a whole window
    pos = np.concatenate([np.arange(a, a + max(0, m - window + 1)) for a, m in zip(start.tolist(), lens.tolist())])
    at = np.searchsorted(begin, pos, side="right") - 1
    key = suffix[wstart[phrase[at]] + pos - begin[at]].astype(np.int64) * (int(after.max()) + 1) + after[at]
    by = pos[np.argsort(key)]
    alive = np.arange(len(by) - 1)
    for step in [*range(0, window - GRAM, GRAM), window - GRAM]:
        alive = alive[x[by[alive] + step] == x[by[alive + 1] + step]]
    dup = np.zeros(n + 1, bool)
    dup[by[alive]] = dup[by[alive + 1]] = True
    out = []
    for s, m in zip(start.tolist(), lens.tolist()):
        own = np.diff(np.concatenate([[0], dup[s:s + max(0, m - window + 1)].astype(np.int8), [0]]))
        out.append(np.stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1)], axis=1))
    return out
