"""The language model against plain recomputation: base, probabilities, features, trees, growth, held-out gain."""

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import lm

TEXTS = [
    (1, "the cat sat on the mat and the dog sat on the cat"), (2, None), (3, ""), (4, "the dog saw the Cat. The cat saw the dog."), (5, "one two three"), (None, "the cat"), (7, "the cat"), (7, "the cat"),
    (8, "a rare wordé stands here"), (9, "unseen tokens only qqq zzz"), (10, "the " * 3000), (12, "dog cat the mat"), (13, "on the mat the dog sat"), (14, " \t\n"), (15, "sat sat sat sat"),
]


def _train(doc_id) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def _fitted(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lm.with_held(frame)
    counts = lm.token_counts(held).cache()
    n = sum(r["c"] for r in counts.collect())
    sizes, ranked = lm.Sizes(n), lm.frequent_words(counts)
    words = lm.Shared(spark, (ranked, sizes), lm.Words)
    model, room = lm.fit(lm.looked_up(held, words), counts, words, sizes)
    return frame, lm.Words(ranked, sizes), model, room


def _log10(tokens, table, model, room):
    """log10 of each token's probability, by loops over the weights."""
    s, tree = model.sizes, model.trees
    history, out = [s.begin] * lm.SKIPS, []
    for word in tokens:
        u = int(table.units(table.codes([word])[0])[0])
        rows = [0, *(1 + (d - 1) * s.units + history[-d] for d in range(1, 5))]
        pair = (history[-2] * s.units + history[-1]) * 0x9E3779B97F4A7C15 % 2**64
        rows.append(1 + 4 * s.units + (pair >> 40) % s.pairs)
        z = [sum(float(model.w[r, c]) for r in rows) for c in range(s.classes)]
        top = max(z)
        log_p = z[model.of_unit[u]] - top - math.log(sum(math.exp(x - top) for x in z))
        for k in range(tree.starts[u], tree.starts[u + 1]):
            fork = tree.forks[k]
            x = sum(float(model.f[r, fork]) for r in (0, 1 + model.head[history[-1]], 1 + s.heads + model.head[history[-2]]))
            log_p -= math.log1p(math.exp(-x if tree.right[k] else x))
        out.append(log_p / math.log(10) - room[u])
        history.append(u)
    return out


def test_scores_recomputed(spark):
    """All columns from counts, and from the weights by plain loops; the model's probabilities sum to one."""
    frame, table, model, room = _fitted(spark, TEXTS)
    count = Counter()
    for doc_id, text in TEXTS:
        if _train(doc_id):
            count.update(lm.tokens_of(text))
    n, v = sum(count.values()), len(count)
    out = Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 2)) for r in lm.score(frame).collect())
    want = Counter()
    for doc_id, text in TEXTS:
        tokens = lm.tokens_of(text)
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        score = sum(math.log10(count[t] + 1) for t in tokens) + sum(_log10(tokens, table, model, room))
        want[(doc_id, not _train(doc_id), len(tokens), sum(count[t] > 0 for t in tokens), n, round(base, 4), round(score, 2))] += 1
    assert out == want
    for history in ([], [b"the"], [b"sat", b"on", b"the"], [b"zzz", lm.END]):
        total, rooms = 0.0, {}
        for t in {*count, lm.END}:
            unit = int(table.units(table.codes([t])[0])[0])
            p = 10 ** (_log10([*history, t], table, model, room)[-1]) * (count[t] + 1)
            total += p
            rooms[unit] = p / (count[t] + 1) * 10 ** room[unit]
        spare = sum(p / 10 ** room[u] for u, p in rooms.items() if model.sizes.own <= u < model.sizes.begin)  # unknown words of seen endings
        assert total + spare <= 1 + 1e-6
    units = np.arange(model.sizes.units)
    u = np.concatenate([np.full(4, model.sizes.begin), np.array([3, 5, 0, 7])]).astype(np.int32)
    p = 0.0
    for x in units[units != model.sizes.begin]:
        p += math.exp(model.log_model(np.append(u, np.int32(x)), np.array([len(u)]))[0])
    assert abs(p - 1) < 1e-4


def test_words_of_a_class_depend_on_the_history(spark):
    """Where only the word before tells two words of one class apart, the model learns it."""
    rows = [(i, "red apple red apple " * 10 if i % 2 else "blue stone blue stone " * 10) for i in range(300)]
    frame, table, model, room = _fitted(spark, rows)
    after = {(h, w): _log10([h, w], table, model, room)[-1] for h in (b"red", b"blue") for w in (b"apple", b"stone")}
    assert after[b"red", b"apple"] > after[b"red", b"stone"] + 0.5 and after[b"blue", b"stone"] > after[b"blue", b"apple"] + 0.5
    model.of_unit[:] = 0  # one class for all: the forks alone must tell
    only = lm.Model(model.sizes, model.of_unit, np.where(np.arange(model.sizes.units) < 4, 100, 0))
    held = lm.with_held(frame)
    counts = lm.token_counts(held)
    words = lm.Shared(spark, (lm.frequent_words(counts), model.sizes), lm.Words)
    tokens = lm.looked_up(held, words)
    for turn in range(lm.ROUNDS):
        lm.train_round(tokens.where(f"not held_out and turn = {turn}"), words, only)
    after = {(h, w): _log10([h, w], table, only, room)[-1] for h in (b"red", b"blue") for w in (b"apple", b"stone")}
    assert after[b"red", b"apple"] > after[b"red", b"stone"] + 0.3 and after[b"blue", b"stone"] > after[b"blue", b"apple"] + 0.3


def test_trees_are_huffman_trees():
    sizes = lm.Sizes(0)
    r = np.random.default_rng(4)
    of_unit, counts = r.integers(0, sizes.classes, sizes.units).astype(np.int32), r.integers(0, 1000, sizes.units)
    trees = lm.Trees(of_unit, counts, sizes)
    lengths = np.diff(trees.starts)
    for c in range(sizes.classes):
        units = [u for u in np.flatnonzero(of_unit == c).tolist() if u != sizes.begin]
        assert len({tuple(zip(trees.forks[trees.starts[u] : trees.starts[u + 1]].tolist(), trees.right[trees.starts[u] : trees.starts[u + 1]].tolist(), strict=True)) for u in units}) == len(units)
        heap, cost = [int(counts[u]) + 1 for u in units], 0
        heapq.heapify(heap)
        while len(heap) > 1:
            x = heapq.heappop(heap) + heapq.heappop(heap)
            cost += x
            heapq.heappush(heap, x)
        assert sum(int(lengths[u]) * (int(counts[u]) + 1) for u in units) == cost


def test_history_and_company(spark):
    """A word four places back changes the features, and classes see the company within two places."""
    sizes = lm.Sizes(0)
    model = lm.Model(sizes, np.zeros(sizes.units, np.int32), np.ones(sizes.units))
    u = np.arange(20, 40, dtype=np.int32)
    for d in (1, 2, 3, 4):
        other = u.copy()
        other[10 - d] = 5
        assert (model.features(u, np.array([10])) != model.features(other, np.array([10]))).any()
    frequent = [(b"a", 1), (b"b", 1), (b"c", 1), (lm.END, 1)]
    words = lm.Shared(spark, (frequent, sizes), lm.Words)
    tokens = lm.looked_up(lm.with_held(spark.createDataFrame([(None, "a b c")], "doc_id long, text string")), words)
    profile, table = lm.company(tokens, words, sizes), lm.Words(frequent, sizes)
    units = table.units(table.codes([b"a", b"b", b"c", lm.END])[0]).astype(np.int64)
    place = [int((x * 2654435761 >> 7) % lm.PLACES) for x in [*units, sizes.begin]]
    want = Counter([place[1], place[2], place[4], place[4]])
    assert {i: int(n) for i, n in enumerate(profile[units[0]]) if n} == want


def test_the_model_grows_with_the_corpus():
    small, large = lm.Sizes(10**7), lm.Sizes(10**10)
    assert small.own == 1024 and small.classes == 24 and small.pairs == 8192
    for name in ("own", "endings", "classes", "pairs", "units", "rows"):
        assert getattr(large, name) > 1.3 * getattr(small, name)
    huge = lm.Sizes(2 * 10**13)  # about 100 TB of text
    assert 4 * (huge.rows * huge.classes + huge.fork_rows * huge.units) < 160e6


@pytest.mark.parametrize(("sf", "gain"), [("sf0.01", 0.15), ("sf0.1", 0.35)])
def test_held_out_texts_are_likelier_than_by_the_base(spark, sf, gain):
    held = lm.score(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print(held[0] / held[2], held[1] / held[2])
    assert (held[0] - held[1]) / held[2] > gain


def test_log_probabilities_without_a_table_of_all_classes():
    """log_model equals the classes' whole softmax plus each way down the tree; `odds` is that softmax but for its sum."""
    rng, sizes = np.random.default_rng(5), lm.Sizes(0)
    model = lm.Model(sizes, rng.integers(0, sizes.classes, sizes.units).astype(np.int32), rng.integers(1, 90, sizes.units))
    model.w += rng.normal(size=model.w.shape).astype(np.float32)
    model.f += rng.normal(size=model.f.shape).astype(np.float32) * 9
    u = rng.integers(0, sizes.begin, 300).astype(np.int32)
    at = np.arange(lm.SKIPS, len(u))
    rows = model.features(u, at)
    z = model.w[0].astype(float) + model.w[rows].astype(float).sum(axis=1)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(model.log_classes(rows), z, atol=1e-4) and model.odds(rows).max() == 0
    token, places, right = model.forks(u, at)
    way = sum(model.f.reshape(-1)[p].astype(float) for p in places)
    expected = z[np.arange(len(at)), model.of_unit[u[at]]] - np.bincount(token, np.logaddexp(0, np.where(right, -way, way)), len(at))
    assert np.allclose(model.log_model(u, at), expected, atol=1e-3)
