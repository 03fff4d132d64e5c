import difflib
import random
import time

import pytest

from corpusloom.operators import alignment as al


def expected(a, b):
    return [tuple(x) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if x.size]


def pairs(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        rows = r.choice([2, 3, 10, 1000])
        a = [r.randrange(rows) for _ in range(r.randrange(40))]
        b = [x for x in a if r.random() < 0.8] if r.random() < 0.7 else [r.randrange(rows) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(b) + 1)
            b[at:at] = r.choice([[r.randrange(rows)], b[:5], [-1]])
        yield a, b


@pytest.mark.parametrize("limit", [al.PAIRS, 6, 0])
def test_blocks_equal_a_search_part_by_part(limit, monkeypatch):
    """With all pairs at once, with anchors first, and with the automaton."""
    monkeypatch.setattr(al, "PAIRS", limit)
    for a, b in pairs(1000, limit):
        assert al.blocks(a, b) == expected(a, b)


def test_rows_that_stand_for_each_other():
    assert al.paired("abcd", "abXd") == [(0, 0, "equal"), (1, 1, "equal"), (3, 3, "equal"), (2, 2, "changed")]
    assert al.paired("abc", "ac") == [(0, 0, "equal"), (2, 1, "equal"), (1, None, "removed")]
    assert al.paired([], ["x"]) == [(None, 0, "added")] and al.paired([], []) == []


def test_long_lists():
    """Time follows the number of rows, whether every second row is new, a fifth of the rows recur, or nearly all are the same."""
    r = random.Random(1)
    for change in (lambda i: -i if i % 2 else i, lambda i: 0 if r.random() < 0.2 else i, lambda i: 0 if i % 50 else i):
        took = []
        for n in (5000, 20_000):
            a = [change(i) for i in range(1, n)]
            b = [x if r.random() < 0.95 else r.randrange(10**9) for x in (change(i) for i in range(1, n))]
            began = time.process_time()
            found = al.blocks(a, b)
            took.append(time.process_time() - began)
            assert sum(n for *_, n in found) > 0.3 * n
        assert took[1] < 12 * took[0] + 1


def test_frames(spark):
    rows = [(1, ["a", "b"], ["a", "c"]), (1, ["a"], ["a"]), (2, None, ["x"]), (3, [], None), (4, [None, "a"], [None])]
    found = al.align(spark.createDataFrame(rows, "k long, base array<string>, side array<string>"), "k").collect()
    assert sorted(map(str, ((r.k, r.base_idx, r.side_idx, r.op) for r in found))) == sorted(map(str, [(1, 0, 0, "equal"), (1, 1, 1, "changed"), (1, 0, 0, "equal"), (2, None, 0, "added"), (4, 0, 0, "equal"), (4, 1, None, "removed")]))
