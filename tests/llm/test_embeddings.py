"""Binary codes, their estimates and bounds, and links of vectors against brute force."""

import math

import numpy as np
import pytest

from lodestone.llm import embedding_dedup as e

RNG = np.random.default_rng


def _pairs(cosine: float, n: int, dim: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = RNG(seed)
    a = e.unit_vectors(r.standard_normal((n, dim)))
    b = r.standard_normal((n, dim))
    b = e.unit_vectors(b - (a * b).sum(axis=1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine**2) * b


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=1).astype(int)


@pytest.mark.parametrize("dim", [16, 64, 300])
def test_estimate_is_unbiased_and_bounded_at_the_threshold(dim):
    a, b = _pairs(e.THRESHOLD, 4000, dim)
    bits = 512
    (ca, fa), (cb, fb) = e.encode(a, bits), e.encode(b, bits)
    factor, differ = (fa + fb) / 2, _differ(ca, cb)
    angles = math.pi * differ / bits / factor
    assert abs(angles.mean() / math.acos(e.THRESHOLD) - 1) < (0.02 if dim < 50 else 0.01)  # few coordinates are not quite normal
    assert abs(e.estimate(differ, factor, bits).mean() - e.THRESHOLD) < 0.004
    assert (differ <= e.most_differing(factor, bits)).all()
    # The factors take part of the error away.
    assert angles.std() <= (math.pi * differ / bits).std() * 1.001


def test_share_of_pairs_that_are_computed_exactly():
    for cosine, share in ((0.5, 0.0), (0.7, 0.001), (0.8, 0.01), (0.99, 1.0)):
        a, b = _pairs(cosine, 4000, 64)
        (ca, fa), (cb, fb) = e.encode(a, 512), e.encode(b, 512)
        exact = (_differ(ca, cb) <= e.most_differing((fa + fb) / 2, 512)).mean()
        assert exact <= share if cosine < 0.9 else exact == share


def test_recall_of_the_tables_at_the_threshold():
    """Of pairs just at the threshold none of 20,000 shares no bucket, for a label of 2,000 vectors and one of a million."""
    a, b = _pairs(0.9801, 20_000, 64)
    for n in (2_000, 1_000_000):
        n_bits, tables, bits = e.plan_tables(n)
        x, y = (e.buckets(e.encode(v, bits)[0], n_bits, tables) for v in (a, b))
        assert (x == y).any(axis=1).all()


def _brute(rows) -> dict:
    """(links, component) of each row by all pairs."""
    good = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for p, i in enumerate(good):
        for j in good[p + 1 :]:
            (_, v, label), (_, w, other) = rows[i], rows[j]
            if label == other and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= e.THRESHOLD:
                    links[i] += 1
                    links[j] += 1
                    up[find(i)] = find(j)
    ids: dict = {}
    for i, (vec_id, _, _) in enumerate(rows):
        if vec_id is not None:
            ids[find(i)] = min(ids.get(find(i), vec_id), vec_id)
    return {i: (links[i], ids.get(find(i))) for i in links}


def test_links_equal_brute_force(spark, monkeypatch):
    r = RNG(3)
    base = r.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + 0.05 * r.standard_normal(16)], i % 3) for i in range(400)]
    rows += [(900 + i, rows[0][1], 0) for i in range(5)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None], 0), (1004, rows[0][1], None), (1005, rows[0][1][:8], 0), (1006, [], 0), (1007, [float("inf")] * 16, 1)]
    lone = [float(x) for x in base[1] + 0.01 * r.standard_normal(16)]  # equal vectors without any id still count
    rows += [(None, rows[0][1], 0), (None, lone, 1), (None, lone, 1), (1010, [-x for x in rows[0][1]], 0), (1011, [2 * x for x in rows[0][1]], 0), (1012, [0.0] + rows[0][1][1:], 0), (1012, [-0.0] + rows[0][1][1:], 0)]
    want = _brute(rows)
    expected = sorted(((v, *want[i], v == want[i][1]) for i, (v, _, _) in enumerate(rows)), key=repr)
    frame = spark.createDataFrame([(v, x, label, "a", 1, 2) for v, x, label in rows], "vec_id long, embedding array<double>, label int, node string, size int, code int").repartition(3)
    for block in (512, 16):  # whole buckets, and pairs of blocks
        monkeypatch.setattr(e, "BLOCK", block)
        assert sorted((tuple(x) for x in e.find_links(frame).collect()), key=repr) == expected


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_test_table_equals_brute_force(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = [(x["vec_id"], x["embedding"], x["label"]) for x in frame.collect()]
    v, label = np.array([x for _, x, _ in rows], float), np.array([x for _, _, x in rows])
    u = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
    near = (u @ u.T >= e.THRESHOLD) & (label[:, None] == label[None, :])
    n = near.sum(axis=1) - 1
    root = np.arange(len(rows))
    while True:
        low = np.array([root[near[i]].min() for i in range(len(rows))])
        if (low == root).all():
            break
        root = low
    ids = np.array([x for x, _, _ in rows])
    first = {r: ids[root == r].min() for r in set(root.tolist())}
    assert {(x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in e.find_links(frame).collect()} == {(int(i), int(k), int(first[r]), bool(i == first[r])) for i, k, r in zip(ids, n, root, strict=True)}
