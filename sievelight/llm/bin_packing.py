"""Bin completion on a histogram of lengths.

Items of equal length are alike, so a packing is a list of *patterns* (which lengths fill a bin) with multiplicities. The
histogram has at most ``capacity`` entries whatever the number of items.

The first incumbent is best-fit decreasing. If it needs more bins than the lower bound, bins are completed around the largest
item that is left: the fillings of its remaining space are enumerated, the fullest first, and the search branches over them.
Fillings are enumerated lazily and completely, but for dominated ones: where a filling has room for an item that is left, or
for a longer item in place of a shorter one, the filling with that exchange is at least as good and comes up by itself. A
branch ends when what it has wasted exceeds what a packing with one bin less than the incumbent's may waste, when the lower bound of
its rest says so, or when the same rest was reached before with no more bins. On the way down best-fit decreasing closes the
rest; a better packing becomes the incumbent at once. So does the end of each way down itself.

A filling that recurs is first used as often as the counts allow (so that large histograms are packed in a few levels), then
less often, down to once: branches over multiplicities are part of the search.

Memory: the counts that are left are held once, whatever the depth of the search, and each step holds its pattern alone.

The exact way: without ``seconds`` the search ends at the lower bound or when it is exhausted, so its result is optimal. Bin
packing is NP-hard, so ``seconds`` bounds the time instead; what is returned then is the best packing found, always a
complete one, and ``Result.proven`` says whether it is known to be optimal.
"""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from hashlib import blake2b
from itertools import islice
from typing import NamedTuple

Pattern = tuple[tuple[int, int], ...]
Packing = list[tuple[int, Pattern]]


#: Histograms with more lengths than FEW are looked at whole only every SELDOM levels.
FEW, SELDOM = 100, 1000
#: How many rests are remembered, and how many steps keep the state of their enumeration. Both bound the driver's memory only:
#: a rest that is not remembered is searched again, an enumeration that was given up is begun again.
REMEMBERED, OPEN = 200_000, 200


class Path(NamedTuple):
    """A packing so far: the way to it and its last step."""

    before: Path | None
    step: tuple[int, Pattern]

    def all(self) -> Packing:
        steps, at = [], self
        while at is not None:
            steps.append(at.step)
            at = at.before
        return steps[::-1]


class Result(NamedTuple):
    """A packing, its bins, the lower bound, and whether no packing has fewer bins."""

    packing: Packing
    bins: int
    bound: int
    proven: bool


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's L2 bound."""
    lengths = sorted(counts)
    volume = sum(n * c for n, c in counts.items())
    best = -(-volume // capacity)
    large = [n for n in lengths if 2 * n > capacity]
    mid = [n for n in lengths if 2 * n <= capacity]
    # For a threshold k: items over capacity - k stand alone; the space beside the other large ones takes items >= k.
    n_large, sum_large = sum(counts[n] for n in large), sum(n * counts[n] for n in large)
    alone = alone_sum = 0
    j = len(large)
    items = sum(n * counts[n] for n in mid)
    for k in [0, *mid]:
        while j and large[j - 1] > capacity - k:
            j -= 1
            alone += counts[large[j]]
            alone_sum += large[j] * counts[large[j]]
        beside = (n_large - alone) * capacity - (sum_large - alone_sum)
        best = max(best, n_large + max(0, -(-(items - beside) // capacity)))
        if k:
            items -= k * counts[k]
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Packing:
    """Each item, largest first, goes to the fullest bin that it fits."""
    open_bins: dict[int, list[list]] = {}  # space left -> [pattern, bins]
    spaces: list[int] = []  # ascending keys of open_bins

    def put(space: int, pattern: Pattern, bins: int) -> None:
        if space not in open_bins:
            open_bins[space] = []
            insort(spaces, space)
        open_bins[space].append([pattern, bins])

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            i = bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                group = open_bins[space]
                pattern, bins = group[-1]
            else:
                space, group, pattern, bins = capacity, None, (), left
            fit = space // n
            full = min(bins, left // fit)
            if full:
                put(space - fit * n, (*pattern, (n, fit)), full)
                left -= full * fit
            rest = min(left, fit - 1) if bins > full else 0
            if rest:
                put(space - rest * n, (*pattern, (n, rest)), 1)
                left -= rest
            if group is not None:
                group[-1][1] -= full + bool(rest)
                if not group[-1][1]:
                    group.pop()
                    if not group:
                        del open_bins[space]
                        spaces.remove(space)
    return [(bins, pattern) for group in open_bins.values() for pattern, bins in group]


class OutOfTime(Exception):
    """The search has used its seconds."""


def fillings(counts: dict[int, int], order: list[int], first: int, space: int, most_waste: int, until: float | None = None) -> Iterator[tuple[int, Pattern]]:
    """All undominated fillings of ``space`` beside one item ``first`` that waste ``most_waste`` at most, least waste first, as
    (waste, pattern). ``order`` has the lengths in ``counts``, ascending. Both are read as they are, not copied: they may change
    in between, but must be as before whenever the next filling is asked for."""
    # volume[i]: of all items below place i, as far as it matters; a filling that cannot reach its fill with them is not begun.
    volume = [0]
    for n in order:
        if volume[-1] >= space:
            break
        volume.append(volume[-1] + n * (counts[n] - (n == first)))
    dead: set[tuple[int, int]] = set()  # (place, space) that no items below fill exactly

    def exactly(top: int, left: int, picked: tuple[tuple[int, int], ...]) -> Iterator[Pattern]:
        """Fillings of ``left`` by lengths below place ``top``; the depth is that of the lengths picked."""
        if not left:
            yield picked
            return
        if until is not None and time.monotonic() > until:
            raise OutOfTime
        begun = top = bisect_right(order, left, 0, top)
        any_found = False
        while top and (top >= len(volume) or volume[top] >= left) and (top, left) not in dead:
            n = order[top - 1]
            for k in range(min(counts[n] - (n == first), left // n), 0, -1):
                for found in exactly(top - 1, left - k * n, (*picked, (n, k))):
                    any_found = True
                    yield found
            top -= 1
        if not any_found:
            dead.add((begun, left))

    def dominated(pattern: Pattern, waste: int) -> bool:
        """Whether an item that is left could take the place of a shorter one, or of nothing, and fill more."""
        used = dict(pattern)
        return any(used.get(n, 0) < counts[n] - (n == first) and (n <= waste or any(m < n <= m + waste for m in used)) for n in order[: bisect_right(order, space)])

    for waste in range(min(most_waste, space) + 1):
        for pattern in exactly(len(order), space - waste, ()):
            if not waste or not dominated(pattern, waste):
                yield waste, pattern


class Step:
    """A step of the way down: what it used, what had been used before it, and the branches from there."""

    __slots__ = ("bins", "branches", "done", "pattern", "times", "tried", "waste")

    def __init__(self, pattern: Pattern, times: int, bins: int, waste: int, done: Path | None):
        self.pattern, self.times, self.bins, self.waste, self.done = pattern, times, bins, waste, done
        self.branches: Iterator[tuple[int, Pattern, int]] | None = None
        self.tried = 0


def solve(counts: dict[int, int], capacity: int, seconds: float | None = None) -> Result:
    """The best packing of ``counts`` (length -> items) found within ``seconds``; without these, an optimal one."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is not within the capacity")
    bound = lower_bound(counts, capacity)
    incumbent = best_fit_decreasing(counts, capacity)
    best = sum(b for b, _ in incumbent)
    if best <= bound:
        return Result(incumbent, best, bound, True)
    until = None if seconds is None else time.monotonic() + seconds
    volume = sum(n * c for n, c in counts.items())
    seen: dict[bytes, int] = {}  # digest of what is left -> fewest bins with which it was reached
    # What is left is held once, changed on the way down and restored on the way back: memory is that of the steps alone.
    left, order = dict(counts), sorted(counts)

    def use(pattern: Pattern, times: int) -> None:
        for m, k in pattern:
            left[m] -= times * k
            if not left[m]:
                del left[m], order[bisect_left(order, m)]

    def give_back(pattern: Pattern, times: int) -> None:
        for m, k in pattern:
            if m not in left:
                left[m] = 0
                insort(order, m)
            left[m] += times * k

    def children(waste: int) -> Iterator[tuple[int, Pattern, int]]:
        """(times, pattern, waste of one bin) around the largest item that is left."""
        n = order[-1]
        for w, pattern in fillings(left, order, n, capacity - n, (best - 1) * capacity - volume - waste, until):
            if pattern and pattern[0][0] == n:
                used = ((n, pattern[0][1] + 1), *pattern[1:])
            else:
                used = ((n, 1), *pattern)
            for times in range(min(left[m] // k for m, k in used), 0, -1):
                yield times, used, w

    # A stack of steps: no recursion however deep.
    stack = [Step((), 0, 0, 0, None)]
    while stack and best > bound:
        at = stack[-1]
        try:
            if until is not None and time.monotonic() > until:
                raise OutOfTime
            if at.branches is None:  # begun, or given up for its memory and begun again where it stood
                at.branches = islice(children(at.waste), at.tried, None)
            branch = next(at.branches, None)
        except OutOfTime:
            return Result(incumbent, best, bound, False)
        if branch is None:
            give_back(at.pattern, at.times)
            stack.pop()
            continue
        at.tried += 1
        times, pattern, w = branch
        now = Step(pattern, times, at.bins + times, at.waste + times * w, Path(at.done, (times, pattern)))
        if now.waste > (best - 1) * capacity - volume or now.bins >= best:
            continue
        use(pattern, times)
        if not left:
            incumbent, best = now.done.all(), now.bins
            give_back(pattern, times)
            continue
        # Bounds, memory and closings cost a look at all lengths: on the way down a long histogram only now and then.
        if len(order) <= FEW or len(stack) % SELDOM == 0:
            hopeless = now.bins + lower_bound(left, capacity) >= best
            if not hopeless:
                key = blake2b(repr([(n, left[n]) for n in order]).encode(), digest_size=16).digest()
                hopeless = seen.get(key, now.bins + 1) <= now.bins
            if hopeless:
                give_back(pattern, times)
                continue
            if len(seen) < REMEMBERED or key in seen:  # what is not remembered is searched again
                seen[key] = now.bins
            closed = best_fit_decreasing(left, capacity)
            if now.bins + sum(b for b, _ in closed) < best:
                incumbent, best = now.done.all() + closed, now.bins + sum(b for b, _ in closed)
        stack.append(now)
        if len(stack) > OPEN:
            stack[-OPEN - 1].branches = None
    return Result(incumbent, best, bound, True)


def pack(counts: dict[int, int], capacity: int, seconds: float | None = None) -> Packing:
    """[(number of bins, ((length, items), ...)), ...] that holds every item of ``counts`` (length -> items)."""
    return solve(counts, capacity, seconds).packing
