"""Toxicity by nearest examples: the index against comparing with every example, frequencies against plain counts, held-out accuracy."""
import math
import random
import re
import zlib

import numpy as np
import pytest

from tracesieve.llm import toxicity as tox


def random_vectors(rng, n, terms):
    out = []
    for _ in range(n):
        t = np.array(sorted(rng.sample(range(terms), rng.choice([0, 1, 1, 2, 5, 9]))), np.int64)
        w = np.array([rng.choice([1.0, 1.0, 2.0, 3.5]) for _ in t])
        out.append((t, w / np.sqrt(w @ w) if len(t) else w))
    return out


def cosine(a, b):
    x = dict(zip(a[0].tolist(), a[1].tolist()))
    return math.fsum(x.get(t, 0) * w for t, w in zip(b[0].tolist(), b[1].tolist()))


@pytest.mark.parametrize("seed, n", [(1, 3000), (2, 64), (3, 1), (4, 0)])
def test_block_max_search_is_exact(seed, n):
    """Same neighbours as a full comparison, ties and the left-out example included, while most blocks stay closed."""
    rng = random.Random(seed)
    vectors = random_vectors(rng, n, 40)
    keys, labels = rng.sample(range(10_000), n), [rng.randrange(2) for _ in range(n)]
    index = tox.BlockMaxIndex(keys, labels, vectors, 40)
    entries = {}
    for k, y, v in zip(keys, labels, vectors):
        if len(v[0]):
            entries.setdefault((*v[0].tolist(), *v[1].tolist()), (v, []))[1].append((k, y))
    assert sorted(map(tuple, index.counts.tolist())) == sorted((sum(y == 0 for _, y in e), sum(y for _, y in e)) for _, e in entries.values())
    opened = []
    for q in random_vectors(rng, 60, 40) + vectors[:20]:
        leave = keys[0] if n and rng.random() < 0.5 else None
        numbers, found, blocks = index.nearest(*q, k=5, leave_out=leave)
        opened.append(blocks)
        every = sorted((-round(cosine(q, v), 12), min(e)[0]) for v, e in entries.values() if [k for k, _ in e] != [leave] and cosine(q, v) > 0)[:5]
        assert index.keys[numbers].tolist() == [k for _, k in every] and np.allclose(found, [-s for s, _ in every])
    assert n < 3000 or np.mean(opened) < 0.5 * index.blocks


def test_terms_and_levels():
    names = set(tox.term_names("Rotten rotten ROTTENLY rot, r0t 日本 x"))
    assert {"rotten", "rotten#2", "rotte*#3", "rott*#3", "rotten*", "rottenly", "rot", "r", "t", "日本", "x"} <= names
    assert not names & {"rott*#5", "rot#2", "rotten#3", "rot*"}
    encoder = tox.Encoder({"rott*": 0, "rott*#3": 1, "rotten#2": 2, "absent": 3})
    assert encoder.counts("Rotten rotten ROTTENLY rot") == {0: 3, 1: 1, 2: 1}
    terms, weights = encoder.vector("nothing here", np.ones(4))
    assert len(terms) == len(weights) == 0


def test_critical_chi_square():
    assert tox.critical_chi_square(0.05) == pytest.approx(3.841459, abs=1e-5) and tox.critical_chi_square(1e-6) == pytest.approx(23.92813, abs=1e-4)


def test_fit_curve():
    x = np.array([-3.0, -2, -1, 0, 1, 2, 3, 0.5])
    y = np.array([0.0, 0, 1, 0, 1, 0, 1, 1])
    a, b = tox.fit_curve(x, y, np.ones(8))

    def loss(a, b):
        s = a * x + b
        return float((np.logaddexp(0, s) - y * s).sum()) + ((a - 1) ** 2 + b * b) / 200
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-12 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def corpus(rng, n):
    words = [a + b + c for a in ("ba", "do", "ki", "mu") for b in ("ran", "lis", "tov", "pel", "gor") for c in ("a", "en", "is", "o")]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                text.insert(rng.randrange(len(text)), rng.choice(["grubscum", "Vilest", "vilester", "zotface"]))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_held_out_accuracy_and_plain_scores(shipped):
    data = corpus(random.Random(6), 900)
    docs = shipped.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in data], "doc_id long, text string, lang string, source string, label int")
    labels = shipped.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tox.rate(docs, labels).collect()}
    held = {i for i, _, _ in data if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r.held_out} == held
    right = [got[i].predicted == y for i, _, y in data if i in held]
    assert sum(right) / len(right) > 0.97
    for r in got.values():
        ids = [int(e.split(":")[0]) for e in r.evidence.split(",") if e]
        assert r.doc_id not in ids and not held & set(ids) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1
    # plain TF-IDF: document frequencies over all documents, the same vocabulary
    model = tox.learn(docs, labels)
    names = {t: [set(tox.term_names(text)) for _, text, _ in data] for t in ["x"]}["x"]
    for t, k in list(model.vocabulary.items())[:12]:
        assert model.idf[k] == pytest.approx(math.log((1 + len(data)) / (1 + sum(t in s for s in names))) + 1)
    assert {"grubscum", "vile*#2"} <= set(model.vocabulary) and not any(re.match("baran", t) for t in model.vocabulary)
    # labels of held-out documents play no part
    flipped = shipped.createDataFrame([(i, 0, 1 - y if i in held else y) for i, _, y in data], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.score for r in tox.rate(docs, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_edges(docs, rows, labels, no_labels, nothing):
    got = tox.rate(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert {(r.score, r.predicted, r.evidence) for r in tox.rate(docs, no_labels).collect()} == {(0.0, 0, "")}
    assert tox.rate(nothing, labels).collect() == [] and tox.rate(nothing, no_labels).collect() == []
