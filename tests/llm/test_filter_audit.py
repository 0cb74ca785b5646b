"""The filter audit against counting every order row by row."""
import random
import re
from itertools import permutations
from math import factorial

import pytest

from tracesieve.llm import filter_audit as fa


@pytest.mark.parametrize("n", range(1, 6))
def test_adjacent_swaps_visit_every_order(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in fa.adjacent_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.add(tuple(order))
    assert len(seen) == factorial(n) and sum(1 for _ in fa.adjacent_swaps(n)) == factorial(n) - 1


def plain(masks, filters):
    """{(order, step): counts} from the list of (mask, good, toxic) of all rows of a part."""
    out, shapley = {}, dict.fromkeys(range(filters), 0)
    for order in permutations(range(filters)):
        left = masks
        for at, f in enumerate(order, 1):
            gone = [m for m in left if m[0] >> f & 1]
            left = [m for m in left if not m[0] >> f & 1]
            fails = sum(m[0] >> f & 1 for m in masks)
            shapley[f] += len(gone)
            out[order, at] = [len(left), len(gone), fails - len(gone), sum(m[0] == 1 << f for m in masks), sum(m[1] for m in gone), sum(m[2] for m in gone)]
    return {k: (*v, shapley[k[0][k[1] - 1]]) for k, v in out.items()}


@pytest.mark.parametrize("filters, rows, seed", [(5, 300, 1), (5, 3, 2), (5, 0, 3), (4, 60, 4), (2, 9, 5), (1, 4, 6)])
def test_diagram_counts_like_the_plain_way(filters, rows, seed):
    rng = random.Random(seed)
    masks = [(rng.choice([0, rng.randrange(1 << filters)]), rng.randint(0, 1), rng.randint(0, 1)) for _ in range(rows)]
    counts = [(sum(m[0] == k for m in masks), sum(m[1] for m in masks if m[0] == k), sum(m[2] for m in masks if m[0] == k)) for k in range(1 << filters)]
    got = {(order, at): tuple(rest) for order, at, _, *rest in fa.audit_part(counts, filters)}
    assert got == plain(masks, filters)


def test_swaps_keep_the_diagram_reduced():
    rng = random.Random(8)
    d = fa.Diagram([(rng.randint(0, 2),) for _ in range(32)], 5)
    for k in fa.adjacent_swaps(5):
        d.swap(k)
        for level, below in zip(d.levels, d.levels[1:]):
            assert len({(id(n.low), id(n.high)) for n in level}) == len(level)
            assert {id(c) for n in level for c in (n.low, n.high)} == {id(n) for n in below}
            assert all(n.counts[0] == n.low.counts[0] + n.high.counts[0] for n in level)


def word_list(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_audit(docs, rows, labels, shipped):
    """Null and repeated ids, null parts and texts, empty and long texts, copies across parts, two labels of one document."""
    extra = [(90, "copy " * 60, None, None, 0, "x", 1, "y", 2, "z"), (91, "copy " * 60, None, "s0", 0, "x", 1, "y", 2, "z"), (90, "copy " * 60, None, "s1", 0, "x", 1, "y", 2, "z"),
             (None, "copy " * 60, None, "s1", 0, "x", 1, "y", 2, "z"), (17, "A# B", None, "", 0, "x", 1, "y", 2, "z")]
    whole = docs.union(shipped.createDataFrame(extra, docs.schema))
    data = [(r.doc_id, r.text or "", r.source or "") for r in whole.collect()]
    marks = {}
    for r in labels.collect():
        g, t = marks.get(r.doc_id, (0, 0))
        marks[r.doc_id] = (max(g, int(r.quality == 1)), max(t, int(r.toxic == 1)))
    least = {}
    for k, t, _ in data:
        if k is not None:
            least[t] = min(k, least.get(t, k))
    parts = {}
    for k, t, p in data:
        w = word_list(t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)),
                 k is not None and k > least[t]]
        parts.setdefault(p, []).append((sum(f << i for i, f in enumerate(fails)), *marks.get(k, (0, 0))))
    want = {(p, "".join("ABCDE"[f] for f in order), at): v for p, m in parts.items() for (order, at), v in plain(m, 5).items()}
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in fa.audit(whole, labels).collect()}
    assert got == want and "" in parts


def test_audit_of_empty_tables(docs, nothing, labels, no_labels):
    assert fa.audit(nothing, labels).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in fa.audit(docs, no_labels).collect())
