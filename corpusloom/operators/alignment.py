"""FZ9: which rows of two ordered lists stand for each other.

The longest run of equal rows is taken first (of equal ones the first on the left, then on the right), then the same on both sides of it.
Taking runs from all over the lists in the order of their length does the same, so the runs are not looked for again in each part:
`blocks` lists all maximal runs once, keeps them in a heap, and shortens a run to what is left of it when a longer one has
parted the lists.

Rows that occur once on both sides are anchors, each with one run. Rows that recur have as many pairs as their counts' product. Where
that is over PAIRS, only the runs with an anchor are listed that are longer than any without one can be; they part the lists, and
the parts have fewer pairs. A part without such a run is searched by a suffix automaton, in time linear in its rows."""

import heapq
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: Pairs of equal rows that are listed at once.
PAIRS = 1 << 18

Part = tuple[int, int, int, int]
Block = tuple[int, int, int]


def _numbered(a: Sequence, b: Sequence) -> tuple[list[int], list[int]]:
    """Equal rows as equal numbers."""
    known: dict = {}
    number = lambda rows: [known.setdefault(x, len(known)) for x in rows]
    return number(a), number(b)


def _runs(a: list[int], b: list[int], part: Part, starts: Iterator[tuple[int, int]]) -> list[Block]:
    """The maximal runs through pairs of equal rows, each once."""
    low, high, left, right = part
    found, until = [], {}
    for i, j in sorted(starts):
        if until.get(j - i, -1) >= i:
            continue
        first, last = i, i + 1
        while first > low and first - i + j > left and a[first - 1] == b[first - 1 - i + j]:
            first -= 1
        while last < high and last - i + j < right and a[last] == b[last - i + j]:
            last += 1
        until[j - i] = last - 1
        found.append((first, first - i + j, last - first))
    return found


def _taken(runs: list[Block], part: Part, least: int = 1) -> tuple[list[Block], list[Part]]:
    """The runs of `least` rows or more that are taken, longest first, and the parts that are left between them."""
    heap = [(-n, i, j) for i, j, n in runs if n >= least]
    heapq.heapify(heap)
    parts, done = [part], []
    while heap:
        n, i, j = heapq.heappop(heap)
        shift, at = j - i, max(0, bisect_right(parts, (i, len(parts) and 1 << 60)) - 1)
        pieces = []
        for low, high, left, right in parts[at:]:
            if low >= i - n:
                break
            x, y = max(i, low, left - shift), min(i - n, high, right - shift)
            if x < y:
                pieces.append((x, y))
        if pieces == [(i, i - n)]:
            at = bisect_right(parts, (i, 1 << 60)) - 1
            low, high, left, right = parts.pop(at)
            done.append((i, j, -n))
            for rest in ((low, i, left, j), (i - n, high, j - n, right)):
                if rest[0] < rest[1] or rest[2] < rest[3]:
                    insort(parts, rest)
        else:
            for x, y in pieces:
                if y - x >= least:
                    heapq.heappush(heap, (x - y, x, x + shift))
    return done, parts


def _longest(a: list[int], b: list[int], part: Part) -> Block | None:
    """The longest common run by a suffix automaton of the right side, through which the left side runs once."""
    low, high, left, right = part
    step: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for j in range(left, right):
        x, new = b[j], len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        first.append(j)
        p = last
        while p >= 0 and x not in step[p]:
            step[p][x] = new
            p = link[p]
        if p >= 0:
            q = step[p][x]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and step[p].get(x) == q:
                    step[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    best, state, n = (0, 0, 0), 0, 0
    for i in range(low, high):
        while state and a[i] not in step[state]:
            state = link[state]
            n = length[state]
        if a[i] in step[state]:
            state, n = step[state][a[i]], n + 1
        if n > best[0]:
            best = n, i, state
    n, i, state = best
    return (i - n + 1, first[state] - n + 1, n) if n else None


def blocks(left: Sequence, right: Sequence) -> list[Block]:
    """(i, j, n): runs of equal rows left[i:i + n] and right[j:j + n] in order, neighbouring ones joined."""
    a, b = _numbered(left, right)
    found: list[Block] = []
    todo: list[Part] = [(0, len(a), 0, len(b))]
    while todo:
        part = todo.pop()
        low, high, first, last = part
        if low >= high or first >= last:
            continue
        ours, theirs = Counter(a[low:high]), Counter(b[first:last])
        if sum(n * theirs[x] for x, n in ours.items() if x in theirs) <= PAIRS:
            places = defaultdict(list)
            for j in range(first, last):
                places[b[j]].append(j)
            found += _taken(_runs(a, b, part, ((i, j) for i in range(low, high) for j in places.get(a[i], ()))), part)[0]
            continue
        anchors = {b[j]: j for j in range(first, last) if theirs[b[j]] == 1 and ours.get(b[j]) == 1}
        # No run without an anchor is longer than the longest stretch without one.
        stretch, longest = 0, 0
        for i in range(low, high):
            stretch = 0 if a[i] in anchors else stretch + 1
            longest = max(longest, stretch)
        done, parts = _taken(_runs(a, b, part, ((i, anchors[a[i]]) for i in range(low, high) if a[i] in anchors)), part, longest + 1)
        if not done:
            one = _longest(a, b, part)
            if one is None:
                continue
            i, j, n = one
            done, parts = [one], [(low, i, first, j), (i + n, high, j + n, last)]
        found += done
        todo += parts
    joined: list[Block] = []
    for i, j, n in sorted(found):
        if joined and joined[-1][0] + joined[-1][2] == i and joined[-1][1] + joined[-1][2] == j:
            i, j, n = joined[-1][0], joined[-1][1], joined.pop()[2] + n
        joined.append((i, j, n))
    return joined


def gaps(found: list[Block], sizes: tuple[int, int]) -> Iterator[Part]:
    """What is between the blocks, as (from, to) on both sides."""
    i = j = 0
    for x, y, n in [*found, (*sizes, 0)]:
        if x > i or y > j:
            yield i, x, j, y
        i, j = x + n, y + n


def paired(left: Sequence, right: Sequence) -> list[tuple[int | None, int | None, str]]:
    """(place left, place right, equal | changed | removed | added): a gap with as many rows on either side holds changed rows."""
    found = blocks(left, right) if left != right else [(0, 0, len(left))]
    rows: list = [(i + k, j + k, "equal") for i, j, n in found for k in range(n)]
    for i, x, j, y in gaps(found, (len(left), len(right))):
        if x - i == y - j:
            rows += [(i + k, j + k, "changed") for k in range(x - i)]
        else:
            rows += [(k, None, "removed") for k in range(i, x)] + [(None, k, "added") for k in range(j, y)]
    return rows


def align(docs: DataFrame, key: str) -> DataFrame:
    """Of (key, base, side: arrays of digests) the pairs of rows that stand for each other, in Arrow batches without a shuffle. A null
    side has no rows; null digests equal each other; repeated keys are aligned on their own."""
    kind = dict(docs.dtypes)[key]

    def batches(it):
        for pdf in it:
            rows = [(r[0], *x) for r in pdf.itertuples(index=False) for x in paired(*(list(s) if s is not None else [] for s in r[1:3]))]
            out = pd.DataFrame(rows, columns=[key, "base_idx", "side_idx", "op"])
            yield out.astype({"base_idx": "Int32", "side_idx": "Int32"})

    return docs.select(key, "base", "side").mapInPandas(batches, f"{key} {kind}, base_idx int, side_idx int, op string")
