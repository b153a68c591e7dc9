from collections import Counter, defaultdict

import pytest

from labelloom.llm.packing import CapacityTree, best_fit_decreasing, pack
from tests.llm import brute


def naive(lengths, capacity):
    """Remaining capacities after best-fit decreasing, one piece at a time."""
    rest = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rest if r >= x]
        if fits:
            rest.remove(min(fits))
            rest.append(min(fits) - x)
        else:
            rest.append(capacity - x)
    return sorted(rest)


@pytest.mark.parametrize("lengths", [[], [5], [64] * 3, [1] * 200, [33, 31, 30, 20, 20, 20, 9, 9, 9, 9, 3, 3, 1, 1, 1], [(i * 37) % 64 + 1 for i in range(500)]])
def test_plan_is_best_fit_decreasing(lengths):
    plan = best_fit_decreasing(Counter(lengths).items(), 64)
    held, ends = defaultdict(list), Counter(lengths)
    runs = sorted(plan.rows)
    for (length, first, each, sequence, offset), following in zip(runs, runs[1:] + [None]):
        last = following[1] if following and following[0] == length else ends[length]
        for k in range(last - first):
            held[sequence + k // each].append((offset + k % each * length, length))
    assert sum(map(len, held.values())) == len(lengths) and len(held) == plan.sequences
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(64 - sum(x for _, x in p) for p in held.values()) == naive(lengths, 64)


def test_tree():
    tree = CapacityTree(10)
    assert tree.tightest(1) is None
    tree.add(7, 2), tree.add(3, 1)
    assert (tree.tightest(1), tree.tightest(4), tree.tightest(7), tree.tightest(8)) == (3, 7, 7, None)


def test_pieces(docs):
    rows = pack(docs, with_ids=True).collect()
    want = docs.select("doc_id", "text").collect()
    ids = brute.token_ids([r["text"] for r in want])
    expected = Counter((r["doc_id"], s, len(i[s : s + 2048]), brute.crc(i[s : s + 2048]), len(i)) for r, i in zip(want, ids) for s in range(0, len(i), 2048))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    assert all(brute.crc(r["ids"]) == r["ids_crc32"] for r in rows)
    windows = defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(windows) * 2048 < sum(map(len, ids)) * 1.02 + 2048


def test_empty(empty):
    assert pack(empty).count() == 0
