"""Bin completion over a histogram of lengths: branch and bound to as few bins as possible.

A branch takes the largest length left and enumerates, lazily and fullest first,
the undominated fillings of the rest of its bin.  A filling is dominated if some
of its items can be exchanged for one larger item that is left and still fits
(one item as large as several of them counts as larger).  Each filling is then
used for as many bins as its lengths last, and on the way back for fewer, down
to one; other fillings for the same largest length leave it out, so every
solution but dominated ones is met once.

Bounds: the waste that a better solution can have in all, (incumbent - 1) bins
less the volume, limits the waste of each bin and with it the fillings that are
enumerated at all; and bins so far plus the lower bound of what is left must
stay below the incumbent.  The first incumbent is best-fit decreasing; better
descents replace it.  The search ends with the lower bound reached, with nothing
left to try (either way the result is proven), or after `nodes` steps, and then
Packing.gap says by how much the result may be off.

Sets of sums are held as bits of an integer, so what room a set of lengths can
fill exactly, with their multiplicities, costs a few shifts for each length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

Plan = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, copies) largest first, bins)


@dataclass(frozen=True)
class Packing:
    plan: Plan
    bins: int
    gap: int  # bins above what is proven to be needed; 0: as few as possible


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's, over all their cuts."""
    sizes = np.array(sorted(counts), np.int64)
    if not len(sizes):
        return 0
    return _bound(sizes, np.array([counts[int(s)] for s in sizes], np.int64), capacity)


def _bound(sizes: np.ndarray, n: np.ndarray, capacity: int) -> int:
    number, volume = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])

    def between(low, high) -> tuple[np.ndarray, np.ndarray]:
        """Items, and their volume, of sizes from low up to and with high."""
        a, b = np.searchsorted(sizes, low), np.searchsorted(sizes, high, "right")
        b = np.maximum(a, b)
        return number[b] - number[a], volume[b] - volume[a]

    cuts = np.append(0, sizes[2 * sizes <= capacity])
    huge, _ = between(capacity - cuts + 1, capacity)
    large, large_volume = between(capacity // 2 + 1, capacity - cuts)
    _, small = between(cuts, capacity // 2)
    rest = np.maximum(0, -(-(small - (large * capacity - large_volume)) // capacity))
    return max(-(-int(volume[-1]) // capacity), int((huge + large + rest).max()))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, equal bins at once."""
    bins: dict[int, Counter] = {}  # room left -> fillings and how many bins have them

    def put(room: int, filling: tuple, n: int) -> None:
        bins.setdefault(room, Counter())[filling] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                if left >= each:
                    put(capacity - each * size, ((size, each),), left // each)
                if left % each:
                    put(capacity - left % each * size, ((size, left % each),), 1)
                break
            filling, n = next(iter(bins[room].items()))
            take = min(n, left)
            bins[room][filling] -= take
            if not bins[room][filling]:
                del bins[room][filling]
            if not bins[room]:
                del bins[room]
            more = Counter(dict(filling))
            more[size] += 1
            put(room - size, tuple(sorted(more.items(), reverse=True)), take)
            left -= take
    return [(f, n) for group in bins.values() for f, n in group.items()]


def _add(sums: int, size: int, copies: int, mask: int) -> int:
    """The sums that up to `copies` more items of that size reach."""
    part = 1
    while copies > 0:
        take = min(part, copies)
        sums |= sums << size * take & mask
        copies -= take
        part *= 2
    return sums


def dominated(filling: tuple[int, ...], room: int, left: dict[int, int]) -> bool:
    """Whether one larger item that is left (beside those of the filling) can take the place of some of its items."""
    slack, own, spare = room - sum(filling), Counter(filling), 0
    for size, n in left.items():
        if n > own[size] and size <= room:
            spare |= 1 << size
    ones, several, wide = 0, 0, (1 << slack + 1) - 1  # for none: any that fits
    for size in filling:
        several |= (ones | several) << size
        ones |= 1 << size
        wide |= (1 << slack) - 1 << size + 1  # for one item: 1 to `slack` longer
    reach = 1
    while reach <= slack:  # for several: as long, or up to `slack` longer
        step = min(reach, slack + 1 - reach)
        several |= several << step
        reach += step
    return bool(spare & (wide | several))


def fillings(left: dict[int, int], room: int, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` that waste at most `waste`, fullest first, each with its items largest first; None after each dominated one."""
    sizes = [s for s in sorted(left, reverse=True) if left[s] > 0 and s <= room]
    if room in left and left[room] > 0:
        yield (room,)
        return
    mask = (1 << room + 1) - 1
    reach = [1]
    for s in reversed(sizes):
        reach.append(_add(reach[-1], s, min(left[s], room // s), mask))
    reach.reverse()  # reach[k]: sums of sizes[k:]

    def exact(k: int, target: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not target:
            yield chosen
            return
        for j in range(k, len(sizes)):
            if not reach[j] >> target & 1:
                return
            s = sizes[j]
            for copies in range(min(left[s], target // s), 0, -1):
                if reach[j + 1] >> target - copies * s & 1:
                    yield from exact(j + 1, target - copies * s, chosen + (s,) * copies)

    for total in range(room, max(room - waste, 0) - 1, -1):
        if reach[0] >> total & 1:
            for f in exact(0, total, ()):
                yield None if dominated(f, room, left) else f


class _Search:
    def __init__(self, counts: dict[int, int], capacity: int, nodes: int):
        self.left, self.capacity, self.nodes = dict(counts), capacity, nodes
        self.sizes = np.array(sorted(counts), np.int64)
        self.volume = sum(s * n for s, n in counts.items())
        self.best = best_fit_decreasing(counts, capacity)
        self.fewest, self.bound = sum(n for _, n in self.best), lower_bound(counts, capacity)

    def spare(self, used: int, volume: int) -> int:
        """The waste that a better solution has left."""
        return (self.fewest - 1 - used) * self.capacity - volume

    def run(self) -> bool:
        """Whether the best plan is proven to be so."""
        if self.fewest == self.bound:
            return True
        left, capacity = self.left, self.capacity
        used, volume, path = 0, self.volume, []
        frames = []  # [largest length, its fillings, those left out, filling in use, bins of it]

        def enter(out: frozenset) -> None:
            top = max(s for s, n in left.items() if n)
            left[top] -= 1
            rest = {s: n for s, n in left.items() if n}
            left[top] += 1
            frames.append([top, fillings(rest, capacity - top, max(self.spare(used, volume), 0)), out, None, 0])

        enter(frozenset())
        while frames:
            frame = frames[-1]
            top, options, out, filling, bins = frame
            if filling is not None:  # back from below: one bin less of it
                items = Counter((top, *filling))
                for s, k in items.items():
                    left[s] += k * bins
                volume += bins * sum(s * k for s, k in items.items())
                used -= bins
                path.pop()
                frame[4] = bins = bins - 1
                if not bins:
                    frame[2] = out = out | {filling}
                    frame[3] = filling = None
            if filling is None:
                self.nodes -= 1
                if self.nodes < 0:
                    return False
                found = next(options, 0)
                if found == 0:
                    frames.pop()
                    continue
                if found is None or found in out:
                    continue
                filling = found
                bins = min(left[s] // k for s, k in Counter((top, *filling)).items())
            items = Counter((top, *filling))
            waste = capacity - sum(s * k for s, k in items.items())
            spare = self.spare(used, volume)
            if waste > spare:  # what follows wastes as much or more
                frame[3] = None
                frames.pop()
                continue
            bins = min(bins, spare // waste) if waste else bins
            frame[3], frame[4] = filling, bins
            for s, k in items.items():
                left[s] -= k * bins
            volume -= bins * (capacity - waste)
            used += bins
            path.append((tuple(sorted(items.items(), reverse=True)), bins))
            if not volume:
                if used < self.fewest:
                    self.best, self.fewest = list(path), used
                    if used == self.bound:
                        return True
            elif used - (-volume // capacity) < self.fewest:
                n = np.array([left[int(s)] for s in self.sizes], np.int64)
                if used + _bound(self.sizes[n > 0], n[n > 0], capacity) < self.fewest:
                    # a filling left out stays so as long as its largest length is the largest
                    enter(frame[2] | {filling} if left[top] else frozenset())
        return True


def pack(counts: dict[int, int], capacity: int, nodes: int = 20_000) -> Packing:
    """Fillings and their numbers of bins that use every length as often as counts says."""
    counts = {s: n for s, n in counts.items() if n > 0}
    if any(s > capacity or s <= 0 for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    search = _Search(counts, capacity, nodes)
    proven = search.run()
    return Packing(search.best, search.fewest, 0 if proven else search.fewest - search.bound)
