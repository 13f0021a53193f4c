"""Suffix array and common-prefix values of a shard by induced sorting with disk-backed queues.

Suffixes are typed (L: larger than their successor, S: smaller); the leftmost S of each run, the S* suffixes, are named by
the strings up to the next S* and sorted on these names; L suffixes are induced from S*, S suffixes from L. The queues
carry suffix tuples (position, rank of the suffix that induced it). A common-prefix value of two neighbours is one more
than the least value between the suffixes that induced them.

The queues are monotone: all tuples of the least first symbol leave together, in order of rank. So every step is an array
operation on a whole symbol, and blocks that are not due yet go to a file that has no name. The reduced string of names is
sorted by doubling, as its alphabet is too large for steps of a symbol each; both stop at the depth asked for.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Bytes of tuples that a queue keeps in memory.
QUEUE_BYTES = 4 << 20


class DiskQueue:
    """Tuples (position, rank) by first symbol; what is pushed for a symbol leaves in the order of pushing."""

    def __init__(self, symbols: int, most: int = QUEUE_BYTES):
        self.blocks: list[list] = [[] for _ in range(symbols)]
        self.most, self.held, self.file = most, 0, None

    def push(self, symbols: np.ndarray, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(symbols):
            return
        order = np.argsort(symbols, kind="stable")
        symbols, rows = symbols[order], np.stack([positions[order], ranks[order]])
        cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
        for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(symbols)], strict=True):
            self.blocks[symbols[start]].append(rows[:, start:stop])
        self.held += rows.nbytes
        if self.held > self.most:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for blocks in self.blocks:
            for k, block in enumerate(blocks):
                if isinstance(block, np.ndarray):
                    at = self.file.seek(0, 2)
                    self.file.write(np.ascontiguousarray(block).tobytes())
                    blocks[k] = (at, block.shape[1], block.dtype)
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for block in self.blocks[symbol]:
            if isinstance(block, tuple):
                at, n, kind = block
                self.file.seek(at)
                block = np.frombuffer(self.file.read(2 * n * kind.itemsize), kind).reshape(2, n)
            else:
                self.held -= block.nbytes
            parts.append(block)
        self.blocks[symbol] = []
        rows = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.int32)
        return rows[0], rows[1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Of the suffixes a[k] and b[k], as far as `most`."""
    out = np.zeros(len(a), np.int32)
    left, n = np.arange(len(a)), len(text)
    for depth in range(most):
        x, y = a[left] + depth, b[left] + depth
        inside = (x < n) & (y < n)
        left, x, y = left[inside], x[inside], y[inside]
        left = left[text[x] == text[y]]
        if not len(left):
            break
        out[left] = depth + 1
    return out


def least_between(lcp: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For ascending ranks: the least of lcp over (ranks[k], ranks[k + 1]]."""
    if len(ranks) < 2:
        return np.empty(0, lcp.dtype)
    return np.minimum.reduceat(lcp[: ranks[-1] + 1], ranks[:-1] + 1)


def induce(text: np.ndarray, small: np.ndarray, stars: np.ndarray, star_lcp: np.ndarray | None, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, from the S* suffixes in order; with common-prefix values if the S* suffixes have them."""
    with_lcp = star_lcp is not None
    n = len(text)
    star_cuts = np.searchsorted(text[stars], np.arange(symbols + 1))
    # L suffixes, symbols ascending
    larger = int(n - small.sum())
    merged, merged_lcp = np.empty(larger + len(stars), np.int32), np.zeros(larger + len(stars), np.int32) if with_lcp else None
    queue, at, bounds = DiskQueue(symbols), 0, np.zeros((symbols, 2), np.int64)

    def append(positions: np.ndarray, lcps: np.ndarray | None) -> np.ndarray:
        nonlocal at
        merged[at : at + len(positions)] = positions
        if lcps is not None:
            merged_lcp[at : at + len(positions)] = lcps
        ranks = np.arange(at, at + len(positions), dtype=np.int32)
        at += len(positions)
        return ranks

    for symbol in range(symbols):
        positions, sources = queue.pop(symbol)
        bounds[symbol, 0] = at
        previous = -1
        while len(positions):
            lcps = None
            if with_lcp:
                chain = sources if previous < 0 else np.r_[np.int32(previous), sources]
                lcps = 1 + least_between(merged_lcp, chain)
                lcps = lcps if previous >= 0 else np.r_[np.int32(0), lcps]
                previous = sources[-1]
            ranks = append(positions, lcps)
            keep = positions > 0
            before, ranks = positions[keep] - 1, ranks[keep]
            keep = ~small[before]
            before, ranks = before[keep], ranks[keep]
            first = text[before]
            same = first == symbol
            queue.push(first[~same], before[~same], ranks[~same])
            positions, sources = before[same], ranks[same]
        bounds[symbol, 1] = at
        seeds = stars[star_cuts[symbol] : star_cuts[symbol + 1]]
        if len(seeds):
            lcps = None
            if with_lcp:
                lcps = star_lcp[star_cuts[symbol] : star_cuts[symbol + 1]].copy()
                lcps[0] = common_prefix(text, merged[at - 1 : at], seeds[:1], depth)[0] if at > bounds[symbol, 0] else 0
            ranks = append(seeds, lcps)
            keep = seeds > 0
            queue.push(text[seeds[keep] - 1], seeds[keep] - 1, ranks[keep])
    queue.close()
    # S suffixes, symbols descending; down[k] and its common prefix with down[k - 1]
    down, down_lcp = np.empty(n, np.int32), np.zeros(n, np.int32) if with_lcp else None
    queue, top = DiskQueue(symbols), 0

    def put(positions: np.ndarray, lcps: np.ndarray | None, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Appends, and pushes the S suffixes before them; returns those of the same symbol."""
        nonlocal top
        down[top : top + len(positions)] = positions
        if lcps is not None:
            down_lcp[top : top + len(positions)] = lcps
        ranks = np.arange(top, top + len(positions), dtype=np.int32)
        top += len(positions)
        keep = positions > 0
        before, ranks = positions[keep] - 1, ranks[keep]
        keep = small[before]
        before, ranks = before[keep], ranks[keep]
        first = text[before]
        same = first == symbol
        queue.push(first[~same], before[~same], ranks[~same])
        return before[same], ranks[same]

    for symbol in range(symbols - 1, -1, -1):
        positions, sources = queue.pop(symbol)
        begin, previous = top, -1
        if symbol == 0 and small[n - 1]:  # the end of the text: nothing induces it
            positions, sources = np.array([n - 1], np.int32), np.zeros(1, np.int32)
        while len(positions):
            lcps = None
            if with_lcp:
                chain = sources if previous < 0 else np.r_[np.int32(previous), sources]
                lcps = 1 + least_between(down_lcp, chain)
                lcps = lcps if previous >= 0 else np.r_[np.int32(0), lcps]
                previous = sources[-1]
            positions, sources = put(positions, lcps, symbol)
        low, high = bounds[symbol]
        if high > low:
            positions, lcps = merged[low:high][::-1], None
            if with_lcp:
                first = common_prefix(text, down[top - 1 : top], positions[:1], depth) if top > begin else np.zeros(1, np.int32)
                lcps = np.r_[first, merged_lcp[low + 1 : high][::-1]]
            put(positions, lcps, symbol)
    queue.close()
    order = down[::-1]
    return order, np.r_[np.int32(0), down_lcp[1:][::-1]] if with_lcp else None


def sort_names(names: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of the reduced string in order of their first `depth` names, by doubling; ranks by depths 1, 2, 4, ...

    A rank is the place of the first suffix of those that are equal so far; only places that equal ones share are sorted on.
    """
    n, width = len(names), 1
    order = np.argsort(names)  # equal ones may come in any order, so sorts need not be stable
    key, at, shared, rank, levels = names[order], order, np.arange(n), np.empty(n, np.int32), []
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(head, shared, 0))
        levels.append(rank)
        shared = shared[~(head & np.r_[head[1:], True])]
        if width >= depth or not len(shared):
            return order, levels
        at = order[shared]
        key = rank[at].astype(np.int64) * (n + 1)
        inside = at + width < n
        key[inside] += rank[at[inside] + width] + 1
        turn = np.argsort(key)
        key, at = key[turn], at[turn]
        order[shared] = at
        width *= 2


def suffix_order(text: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix values. text ends with a 0 that it has nowhere else.

    Suffixes that agree on `depth` symbols may come in any order, and values may be lower than the true ones only beyond `depth`.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16))).astype(np.int8)
    # the type of a run of equal symbols is that of its end
    index = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    index = np.minimum.accumulate(index[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.r_[step, np.int8(1)][index] > 0
    del step, index  # here and below: what isn't needed any more goes before the next large arrays come
    star = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(star):
        star = np.array([n - 1], np.int32)
    # S* substrings in order, then named
    rough, _ = induce(text, small, star[np.argsort(text[star], kind="stable")], None, symbols, depth)
    is_star = np.zeros(n, bool)
    is_star[star] = True
    ordered = rough[is_star[rough]]
    del rough, is_star
    place = np.full(n, 0, np.int32)
    place[star] = np.arange(len(star))
    after = np.r_[star[1:], n - 1].astype(np.int32)
    length = (after - star + 1)[place[ordered]]
    a, b = ordered[:-1], ordered[1:]
    same = length[:-1] == length[1:]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        left = left[k < length[left]]
        unlike = text[a[left] + k] != text[b[left] + k]
        same[left[unlike]] = False
        left = left[~unlike]
        k += 1
    names = np.empty(len(star), np.int64)
    names[place[ordered]] = np.cumsum(np.r_[0, ~same])
    del ordered, place, after, length, a, b, same, left
    # the reduced string; an S* substring advances by one symbol at least
    order, levels = sort_names(names, depth // 2 + 1)  # S* suffixes are two symbols apart at least
    sorted_stars = star[order]
    # common prefixes of neighbours: equal names first, the rest symbol by symbol
    i, j = order[:-1].copy(), order[1:].copy()
    for level in range(len(levels) - 1, -1, -1):
        rank, width = levels[level], 1 << level
        inside = np.flatnonzero((i + width <= len(star) - 1) & (j + width <= len(star) - 1))
        hit = inside[rank[i[inside]] == rank[j[inside]]]
        i[hit] += width
        j[hit] += width
    known = (star[i] - star[order[:-1]]).astype(np.int32)
    del levels, rank, inside, hit
    lcp = np.r_[np.int32(0), known + common_prefix(text, star[i], star[j], depth)].astype(np.int32)
    del i, j, known, order, names, star
    return induce(text, small, sorted_stars, lcp, symbols, depth)


def repeated_windows(spans: list[bytes], window: int) -> list[np.ndarray]:
    """For each span, for each start of a window of so many bytes: whether the window occurs twice or more in the spans."""
    total = sum(map(len, spans)) + len(spans) + 1
    text, owner_at, at = np.zeros(total, np.uint16), [], 0
    for span in spans:
        text[at : at + len(span)] = np.frombuffer(span, np.uint8)
        text[at : at + len(span)] += 2
        text[at + len(span)] = 1  # ends a span; 0 ends the text
        owner_at.append(at)
        at += len(span) + 1
    order, lcp = suffix_order(text, 258, window + 1)
    deep = lcp >= window
    twice = np.zeros(total, bool)
    twice[order[deep]] = True
    twice[order[np.flatnonzero(deep) - 1]] = True
    return [twice[at : at + max(0, len(s) - window + 1)] for at, s in zip(owner_at, spans, strict=True)]
