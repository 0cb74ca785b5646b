"""Language-model scores, the quality classifier, near duplicates and the pipeline against plain versions."""
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tracesieve.llm import masked_lm, near_dedup, packing, pii, quality_classifier, quality_rules
from tracesieve.llm.frames import read

FOLDER = "/root/testdata/sf0.001"


def test_scores_are_log_probabilities(docs, rows):
    words, w = masked_lm.fit(docs)
    vocabulary = masked_lm.Vocabulary(words)

    def log_probability(ids, i):
        x = w.b.astype(float).copy()
        for k, o in enumerate(masked_lm.OFFSETS):
            x += w.E[k][ids[i + o] if 0 <= i + o < len(ids) else masked_lm.PAD]
        h = np.tanh(x)
        top = np.exp(h @ w.A + w.a)
        c, inside = divmod(ids[i], masked_lm.CLUSTER)
        low = np.exp(h @ w.B[c] + w.c[c])
        return np.log(top[c] / top.sum()) + np.log(low[inside] / low.sum())
    want = defaultdict(list)
    for k, t in rows:
        ids = vocabulary.ids((t or "")[:4000] if k == 4 else t or "")
        want[k].append((len(ids), sum(log_probability(ids, i) for i in range(len(ids)))))
    got = masked_lm.score(docs, fitted=(words, w)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id != 4:
            assert any(r.n_tokens == n and r.log_prob == pytest.approx(s, abs=1e-2) for n, s in want[r.doc_id])
            assert (r.mean_log_prob is None) == (r.n_tokens == 0)


def test_training_learns_context():
    rng = np.random.default_rng(0)
    documents = [[int(x) for x in np.tile(rng.permutation(40)[:4], 30)] for _ in range(60)]
    ids, at = masked_lm.stream_of(documents)
    w = masked_lm.first_weights()
    memory = masked_lm.Weights(*(np.full_like(v, 1e-4) for v in w))
    before = masked_lm.log_probabilities(w, ids, at).mean()
    for _ in range(12):
        masked_lm.train(w, ids, at, memory)
    assert before < -6 and masked_lm.log_probabilities(w, ids, at).mean() > -3


def _trained(documents):
    ids, at = masked_lm.stream_of(documents)
    w = masked_lm.first_weights()
    memory = masked_lm.Weights(*(np.full_like(v, 1e-4) for v in w))
    return ids, at, w, memory


def test_training_is_plain_adagrad():
    """Batches of one position and more, with clusters that have none, one or many rows, against sums written out."""
    rng = np.random.default_rng(1)
    documents = [np.minimum(rng.zipf(1.3, n) - 1, masked_lm.TOKENS - 1) for n in (1, 700, 340)]
    ids, at, w, memory = _trained(documents)
    want, sums = ([v.astype(float) for v in x] for x in (w, memory))
    masked_lm.train(w, ids, at, memory)
    for s in range(0, len(at), masked_lm.BATCH):
        part = at[s:s + masked_lm.BATCH]
        E, b, A, a, B, c = want
        grads = [np.zeros_like(v) for v in want]
        for i in part:
            h = np.tanh(b + sum(E[k][ids[i + o]] for k, o in enumerate(masked_lm.OFFSETS)))
            k, inside = divmod(ids[i], masked_lm.CLUSTER)
            top, low = np.exp(h @ A + a), np.exp(h @ B[k] + c[k])
            top, low = top / top.sum(), low / low.sum()
            top[k] -= 1
            low[inside] -= 1
            dx = (A @ top + B[k] @ low) * (1 - h * h)
            grads[1] += dx
            grads[2] += np.outer(h, top)
            grads[3] += top
            grads[4][k] += np.outer(h, low)
            grads[5][k] += low
            for j, o in enumerate(masked_lm.OFFSETS):
                grads[0][j][ids[i + o]] += dx
        for v, m, g in zip(want, sums, grads):
            g /= len(part)
            m += g * g
            v -= masked_lm.RATE * g / (np.sqrt(m) + 1e-6)
    for got, v in zip((*w, *memory), (*want, *sums)):
        assert np.abs(got - v).max() < 2e-5


def test_logits_far_apart():
    """Rows whose logits share no shift that keeps them all in the range of float32."""
    x = np.array([[0, 1, -300], [500, 500, 200], [-900, -901, -1000]], np.float32)
    want = x.astype(float) - x.max(1, keepdims=True)
    want -= np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(masked_lm._softmax(x.copy()), np.exp(want), atol=1e-6)
    assert np.allclose(masked_lm._log_softmax_at(x.copy(), np.array([2, 0, 1])), want[[0, 1, 2], [2, 0, 1]], atol=1e-3)


def test_words_are_encoded_alike():
    vocabulary = masked_lm.Vocabulary(["the", "straße", "日本"])
    words = "the of x straße 日本 日本語 😀 the ab cab the".split()
    ids, rare = vocabulary.encode(words)
    assert ids.tolist() == vocabulary.of(words) == vocabulary.ids(" ".join(words)) and rare == [w for w in words if w not in vocabulary.known]
    assert masked_lm.cells_of(rare).tolist() == [masked_lm.cell_of(w) for w in rare]
    assert vocabulary.encode([])[0].tolist() == masked_lm.cells_of([]).tolist() == []


def test_a_step_costs_little_more_than_its_products():
    """Per-call work in a step of training stays small: seconds against those of the exponentials and products of as many rows (before biases were
    joined and lanes added by a product: 7.0 to 7.4 times, since: 4.9 to 5.1)."""
    rng = np.random.default_rng(2)
    documents = [np.minimum(rng.zipf(1.2, 512) - 1, masked_lm.TOKENS - 1) for _ in range(60)]
    h, A = (rng.normal(size=s).astype(np.float32) for s in ((masked_lm.BATCH, masked_lm.WIDTH), (masked_lm.WIDTH, masked_lm.CLUSTERS)))
    ours, plain = [], []
    for _ in range(7):
        ids, at, w, memory = _trained(documents)
        start = time.thread_time()
        masked_lm.train(w, ids, at, memory)
        ours.append(time.thread_time() - start)
        start = time.thread_time()
        for _ in range(len(at) // masked_lm.BATCH):
            np.tanh(h)
            for _ in range(2):
                x = h @ A
                np.exp(x)
                x @ A.T
                h.T @ x
        plain.append(time.thread_time() - start)
    assert min(ours) < 6 * min(plain), (min(ours), min(plain))


def test_rare_words_have_their_own_probability(docs, rows, shipped):
    """Words outside the vocabulary score as their cell's share of the bucket; no two words of these documents share a cell."""
    fitted = masked_lm.fit(docs)
    vocabulary, counts = masked_lm.Vocabulary(fitted[0]), Counter(w for _, t in rows for w in (t or "").lower().split())
    other = {w: i for w in counts if (i := vocabulary.ids(w)[0]) >= masked_lm.WORDS}
    total = Counter()
    for w, i in other.items():
        total[i] += counts[w]
    want = set((k, sum(np.log(counts[w] / total[other[w]]) for w in (t or "").lower().split() if w in other)) for k, t in rows)
    plain = {r.doc_id: r.log_prob for r in masked_lm.score(docs, fitted=fitted).where("doc_id IS NOT NULL").collect()}
    assert len(set(other.values())) < len(other) and min(s for _, s in want) < -10
    found = masked_lm.word_counts(docs)
    cells = Counter()
    for w, n in counts.items():
        cells[masked_lm.cell_of(w)] += n
    assert {int(c): int(found.cells[c]) for c in np.flatnonzero(found.cells)} == dict(cells) and len(cells) == len(counts)
    got = masked_lm.score(docs, fitted=fitted, counts=found).where("doc_id IS NOT NULL").collect()
    assert all(any(k == r.doc_id and abs(r.log_prob - plain[k] - s) < 0.05 for k, s in want) for r in got)
    assert fitted[0] == [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:masked_lm.WORDS]]
    same = " ".join(f"w{i}" for i in range(800)) + " "
    texts = [(i, same * 2 + ("reading" if i else "qqxzing") + " w1 w2") for i in range(6)]
    score = {r.doc_id: r.log_prob for r in masked_lm.score(shipped.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert score[1] - score[0] == pytest.approx(np.log(5), abs=1e-2)


def test_every_position_is_a_target(shipped):
    """The words that stand at places 2 to 15 of every document are learned as well."""
    words = "a b c d e f g h i j k l m n o p".split()
    texts = shipped.createDataFrame([(i, " ".join(words)) for i in range(1500)], "doc_id long, text string").coalesce(1)
    found, w = masked_lm.fit(texts)
    ids, at = masked_lm.stream_of([masked_lm.Vocabulary(found).ids(" ".join(words))])
    assert masked_lm.log_probabilities(w, ids, at)[2:].mean() > -3


def test_gradients():
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, quality_classifier.FEATURES)) * 0.3 for n in (1, 4, 2)]
    m = quality_classifier.Model(*(rng.normal(size=s) * 0.3 for s in ((quality_classifier.FEATURES, 5), 5, (5, 4), (5, 4), 4, 5, 1)))
    x, starts, y = np.concatenate(bags), np.array([0, 1, 5]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        p = m.forward(x, starts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    for name, g in zip(m._fields, quality_classifier.gradients(m, x, starts, y)):
        at = tuple(rng.integers(0, n) for n in g.shape)
        step = np.zeros_like(getattr(m, name))
        step[at] = 1e-5
        slope = (loss(m._replace(**{name: getattr(m, name) + step})) - loss(m._replace(**{name: getattr(m, name) - step}))) / 2e-5
        assert g[at] == pytest.approx(slope, rel=1e-3, abs=1e-8), name


def test_classifier_on_held_out_documents(shipped):
    docs, labels = read(shipped, "/root/testdata/sf0.01", "documents"), read(shipped, "/root/testdata/sf0.01", "labels")
    rows = quality_classifier.rate(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    # held-out labels teach nothing
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.learn(docs, labels), quality_classifier.learn(docs, flipped)
    assert all((p == q).all() for p, q in zip(a, b))


def test_classifier_edges(docs, rows, labels, no_labels, nothing):
    got = quality_classifier.rate(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {True}
    assert {r.score for r in quality_classifier.rate(docs, no_labels).collect()} == {0.5}
    assert quality_classifier.rate(nothing, labels).collect() == masked_lm.score(nothing).collect() == []
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)


def plain_simhash(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Class number of each fingerprint, by all pairs."""
    u = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1:] ^ u[i]) <= 4):
            parent[find(i)] = find(i + 1 + int(j))
    return {int(f): find(i) for i, f in enumerate(u)}


def held_against(rows, got):
    prints = [(k, plain_simhash(t)) for k, t in rows]
    group = plain_groups([f for _, f in prints])
    least = {}
    for k, f in prints:
        if k is not None:
            least[group[f]] = min(k, least.get(group[f], k))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((k, f"{f:016x}", least.get(group[f])) for k, f in prints)


def test_near_groups(shipped, docs, rows, nothing):
    held_against(rows, near_dedup.near_groups(docs).collect())
    table = read(shipped, FOLDER, "documents")
    held_against([(r.doc_id, r.text) for r in table.collect()], near_dedup.near_groups(table).collect())
    assert near_dedup.near_groups(nothing).collect() == near_dedup.one_of_each(nothing).collect() == []


def test_one_of_each(docs, rows):
    groups = {(r.doc_id, r.component_id) for r in near_dedup.near_groups(docs).collect()}
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({k: 1 for k, c in groups if k is not None and k == c}) + Counter(k for k, _ in rows if k is None)


def test_repeated_ids_with_different_texts(shipped):
    """A repeated id is two documents if the texts differ: one stays although the other is a copy of a smaller id, or both stay."""
    a, b, c = (" ".join(f"{w}{j * j}" for j in range(80)) for w in ("first", "second", "third"))
    table = shipped.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, c), (4, "some other text of its own"), (4, c)], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dedup.one_of_each(table).collect()) == sorted([(1, a), (2, b), (4, c), (4, "some other text of its own")])


def test_dense_cluster_of_distinct_fingerprints(shipped, monkeypatch):
    """A large ball of near copies, a chain and strangers: the same classes as by all pairs, through hubs, tiles and pivots."""
    rng, prints = random.Random(1), set()
    centre = rng.getrandbits(64)
    while len(prints) < 1500:
        x = centre
        for b in rng.sample(range(64), rng.randint(1, 8)):
            x ^= 1 << b
        prints.add(x)
    x = rng.getrandbits(64)
    for k in range(0, 60, 4):
        prints.add(x)
        x ^= 0b1111 << k
    prints |= {rng.getrandbits(64) for _ in range(500)}
    prints = list(prints)
    table = shipped.createDataFrame([(i, near_dedup._signed(f)) for i, f in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(near_dedup, "TILE", 128)
    monkeypatch.setattr(near_dedup, "fingerprints", lambda docs, words=4: table)
    got = near_dedup.near_groups(table.selectExpr("doc_id", "'' AS text")).collect()
    group, least = plain_groups(prints), {}
    for i, f in enumerate(prints):
        least[group[f]] = min(i, least.get(group[f], i))
    assert {(r.doc_id, r.component_id) for r in got} == {(i, least[group[f]]) for i, f in enumerate(prints)}


def test_pivots_discard_no_link():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.concatenate([fps, fps ^ np.uint64(0b10110001)])
    i, j = np.triu_indices(len(fps), 1)
    a, b = near_dedup.linked(fps, near_dedup.pivot_table(fps), i, j)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    assert set(zip(a, b)) == set(zip(i[near], j[near])) and len(a) >= 400


def test_pipeline(shipped):
    """Each stage against its operator's own report, and the whole against the last one."""
    docs, labels = read(shipped, FOLDER, "documents"), read(shipped, FOLDER, "labels")
    stage = [f for _, f in corpus_pipeline.STAGES]
    assert len(stage) == 5
    verdict = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    one = quality_rules.cut_lineage(stage[0](shipped, docs, FOLDER))
    assert {r.doc_id for r in one.collect()} == verdict and one.columns == docs.columns
    two = quality_rules.cut_lineage(stage[1](shipped, one, FOLDER))
    assert {r.doc_id for r in two.collect()} == {r.doc_id for r in quality_classifier.rate(one, labels).where("predicted = 1").collect()}
    three = quality_rules.cut_lineage(stage[2](shipped, two, FOLDER))
    groups = plain_groups([plain_simhash(r.text) for r in two.collect()])
    least = {}
    for r in two.collect():
        g = groups[plain_simhash(r.text)]
        least[g] = min(r.doc_id, least.get(g, r.doc_id))
    assert sorted(r.doc_id for r in three.collect()) == sorted(least.values())
    four = quality_rules.cut_lineage(stage[3](shipped, three, FOLDER))
    m, before = pii.model(), {r.doc_id: r.text for r in three.collect()}
    assert {r.doc_id: r.text for r in four.collect()} == {k: pii.redact(t, pii.find(t, m)) for k, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in four.collect()) and four.columns == docs.columns
    got = Counter(tuple(r)[:5] for r in corpus_pipeline.run(shipped, FOLDER).collect())
    assert got == Counter(tuple(r)[:5] for r in packing.pack(four).collect())
