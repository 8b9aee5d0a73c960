"""Aggregators against plain numpy versions of their rules, and on rounds with clear outliers."""

import hashlib
import math
import tracemalloc
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rondo.operators import aggregators as A
from rondo.operators import layers as L
from rondo.operators import matrix as X
from rondo.operators import metrics as E
from rondo.operators import partitioners as P
from rondo.operators import perturbations as M
from rondo.operators import training as R

LAYOUT = [(0, "a", 0, 6, 2, "weight"), (1, "b", 6, 2, 1, "bias"), (2, "c", 8, 8, 2, "weight"), (3, "d", 16, 4, 1, "bias")]
LAYERS = [(start, size, ndim) for _, _, start, size, ndim, _ in LAYOUT]
N, D = 9, 20


@pytest.fixture(scope="module")
def rounds():
    """Two rounds of ordinary clients."""
    r = np.random.default_rng(3)
    return [r.normal(0.1, 1, (N, D)) for _ in range(2)]


def frame(spark, rounds, bad=2, **more):
    rows = [(k, c, "attacker" if c < bad else "benign", v.tolist(), *[x[k].tolist() for x in more.values()]) for k, m in enumerate(rounds) for c, v in enumerate(m)]
    return spark.createDataFrame(rows, "round int, client_id int, role string, vec array<double>" + "".join(f", {n} array<double>" for n in more))


def vectors(df):
    out = {}
    for x in df.collect():
        out.setdefault(x["round"], {})[x["coord"]] = x["value"]
    return [np.array([out[k][c] for c in sorted(out[k])]) for k in sorted(out)]


def lower_median(x):
    return np.sort(x)[(len(x) - 1) // 2]


def lasa_by_numpy(u, sparsity):
    norm = np.linalg.norm(u, axis=1)
    clipped = u / (norm[:, None] + 1e-12) * np.minimum(norm, np.median(norm))[:, None]
    sparse = u.copy()
    matrices = [range(start, start + size) for start, size, ndim in LAYERS if ndim in (2, 4)]
    for i in range(len(u)):
        every = sorted((abs(u[i, c]) for own in matrices for c in own), reverse=True)
        limit = every[max(1, int(len(every) * (1 - sparsity))) - 1]
        for own in matrices:
            for c in own:
                if sparsity and abs(u[i, c]) <= limit:
                    sparse[i, c] = 0
    out = np.zeros(u.shape[1])
    for start, size, _ in LAYERS:
        own = sparse[:, start : start + size]
        scores = [np.linalg.norm(own, axis=1), 0.5 * np.sign(own).sum(1) / (np.abs(np.sign(own)).sum(1) + 1e-12) * (1 - sparsity)]
        good = [i for i in range(len(u)) if all(abs(s[i] - lower_median(s)) / (s.std() + 1e-12) < bound for s, bound in zip(scores, (2.0, 1.0)))]
        out[start : start + size] = clipped[good or range(len(u)), start : start + size].mean(0)
    return out


@pytest.mark.parametrize("sparsity", [0.3, 0.6, 0.0])
def test_lasa(spark, rounds, sparsity):
    layout = spark.createDataFrame(LAYOUT, "ord int, layer string, start int, len int, ndim int, kind string")
    got = vectors(L.lasa(frame(spark, rounds), layout, sparsity=sparsity))
    for own, u in zip(got, rounds):
        assert np.allclose(own, lasa_by_numpy(u, sparsity))
    for own, u in zip(got, rounds):
        assert np.allclose(X.layer_filtered(u, LAYERS, sparsity=sparsity), own)


def test_fools_gold(spark, rounds):
    """Four classes of two features at 8, their biases at 16; the mask has the larger weight of half the classes' count."""
    models = [np.random.default_rng(k).normal(size=D) for k in range(2)]
    model = spark.createDataFrame([(k, c, float(x)) for k, m in enumerate(models) for c, x in enumerate(m)], "round int, coord int, value double")
    u = [m.copy() for m in rounds]
    u[0][:3] = u[0][0] + 0.01 * np.arange(3)[:, None]
    u[1][:3] = u[1][0]
    got = {(x["round"], x.client_id): x.weight for x in L.fools_gold_weights(frame(spark, u), model, 8, 4, 2, 0.25).collect()}
    total, eps = np.zeros((N, D)), 1e-6
    sums = vectors(L.fools_gold(frame(spark, u), model, start=8, classes=4, width=2, share=0.25))
    for k in range(2):
        own = u[k] / np.maximum(np.linalg.norm(u[k], axis=1), 1)[:, None]
        total = total + own
        mask = []
        for c in range(4):
            at = np.argmax(models[k][8 + 2 * c : 10 + 2 * c])
            mask.append(8 + 2 * c + at + 4)
        x = total[:, sorted(mask)]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        cs = x @ x.T - np.eye(N)
        np.fill_diagonal(cs, 0)
        most = cs.max(1) + eps
        for i in range(N):
            for j in range(N):
                if i != j and most[i] < most[j]:
                    cs[i, j] *= most[i] / most[j]
        w = np.clip(1 - cs.max(1), 0, 1)
        w = w / (w.max() + eps)
        w[w == 1] = 0.99
        w = np.clip(np.log(w / (1 - w) + eps) + 0.5, 0, 1)
        assert np.allclose([got[k, i] for i in range(N)], w)
        assert np.allclose(sums[k], (own * w[:, None]).sum(0))


@pytest.fixture(scope="module")
def outliers():
    """Twelve clients near one another, three far off in one direction."""
    r = np.random.default_rng(8)
    m = 1 + 0.05 * r.normal(size=(15, 24))
    m[:3] = -4 + 0.05 * r.normal(size=(3, 24))
    return m


def test_outliers_are_left_out(spark, outliers):
    u = frame(spark, [outliers], bad=3, model=[np.full(24, 0.01)])
    layers, kept = [(0, 12, 2), (12, 12, 1)], outliers[3:]
    near = lambda df, want: np.allclose(vectors(df)[0], want, atol=1e-3)
    middle = np.median(np.linalg.norm(outliers, axis=1))
    clipped = (kept * np.minimum(1, middle / (np.linalg.norm(kept, axis=1) + 1e-6))[:, None]).mean(0)
    assert near(X.simple_clustering(u, eps=1.0), kept.mean(0))
    assert near(X.simple_clustering(u, method="kmeans", dims=8), kept.mean(0))
    flame = vectors(X.flame(u, layers=layers))[0]
    assert np.abs(flame - clipped).max() < 0.05
    assert near(X.auror(u, start=12), kept.mean(0))
    assert np.abs(vectors(X.bulyan(u, f=3))[0] - 1).max() < 0.1
    guard = vectors(X.sign_guard(u, share=0.5))[0]
    assert np.abs(guard - 1).max() < 0.1
    defended = vectors(X.my_defense(u, f=3, layers=layers))[0]
    assert np.abs(defended - 1).max() < 0.1
    sight = vectors(X.deep_sight(u, start=8, classes=4, width=3))[0]
    assert np.isfinite(sight).all() and len(sight) == 24
    fang = vectors(X.fang(u))[0]
    f, benign = 3, outliers[3:]
    assert X.krum_choice(X.distances(np.concatenate([np.repeat(fang[None], f, 0), benign])), f) < f or np.abs(fang).max() <= 1e-4
    assert set(np.sign(fang)) <= {1.0, 0.0}  # against the attackers' own sign


def test_auror_keeps_its_coordinates(spark):
    """Coordinate 3 tells in the first two rounds only, coordinate 2 later on."""
    r = np.random.default_rng(2)
    rounds = [0.0001 * r.normal(size=(8, 4)) for _ in range(4)]
    for k, m in enumerate(rounds):
        m[:3, 3 if k < 2 else 2] += 1
    rounds[3][:2, 3] += 1
    got = vectors(X.auror(frame(spark, rounds), start=1, threshold=0.5, find=2))
    assert np.allclose(got[0], rounds[0][3:].mean(0)) and np.allclose(got[1], rounds[1][3:].mean(0))
    assert np.allclose(got[3], rounds[3][2:].mean(0))  # split by coordinate 3, though 2 tells as well


def test_distances_in_blocks(monkeypatch):
    m = np.random.default_rng(1).normal(size=(7, 50))
    whole = np.sqrt(((m[:, None] - m[None]) ** 2).sum(-1))
    monkeypatch.setattr(X, "_BLOCK", 100)
    assert np.allclose(X.distances(m), whole) and np.allclose(X.distances(m[:2], m), whole[:2])
    assert X.projected(m, 64) is m and X.projected(m, 10).shape == (7, 10)


def test_counts_come_from_the_round(spark, rounds):
    u = frame(spark, [rounds[0], rounds[1][:6]])
    out = {x["round"] for x in A.multi_krum(u, f=1, share=0.4).collect()}
    assert out == {0, 1}
    with pytest.raises(Exception, match="selects no client"):
        A.multi_krum(u, f=1, share=0.1).collect()
    mask = [(x["round"], x.client_id, x.coord) for x in L.top_k_mask(u, 0.2).collect()]
    want = [(k, c, int(i)) for k, m in enumerate([rounds[0], rounds[1][:6]]) for c, v in enumerate(m) for i in np.argsort(-np.abs(v), kind="stable")[:4]]
    assert sorted(mask) == sorted(want)
    moved = M.little_is_enough(u).where("role = 'attacker'").count()
    assert moved == 2 * 2 * D


def test_least_moved_and_balls(spark, rounds):
    u = frame(spark, rounds[:1])
    cells = {(x.client_id, x.coord): x.value for x in M.least_moved(u, 0.2, 0.5).collect()}
    v = rounds[0][1]
    kept = np.argsort(np.abs(v), kind="stable")[:4]
    want = np.zeros(D)
    want[kept] = v[kept] * min(1, 0.5 / (np.linalg.norm(v[kept]) + 1e-6))
    assert np.allclose([cells[1, c] for c in range(D)], want) and np.allclose([cells[5, c] for c in range(D)], rounds[0][5])
    box = {(x.client_id, x.coord): x.value for x in M.box_projection(u).collect()}
    assert np.allclose([box[0, c] for c in range(D)], np.clip(rounds[0][0], -0.25, 0.25))
    zero = M.ball_projection(frame(spark, [np.zeros((3, 4))])).collect()
    assert {x.value for x in zero} == {0.0}


def test_dirichlet_shares(spark):
    rows = P.dirichlet_shares(spark, 4, 5, 0.3).collect()
    assert len(rows) == 20 and all(x.frac >= 0 for x in rows)
    for k in range(4):
        assert sum(x.frac for x in rows if x.label == k) == pytest.approx(1)
    samples = spark.createDataFrame([(i, i % 4) for i in range(100)], "sample_id long, label int")
    assert P.split(samples, "dirichlet", shares=P.dirichlet_shares(spark, 4, 5, 0.3)).count() == 100
    assert P.split(samples, "class-imbalanced", clients=5, gamma=0.5).count() < 100


@pytest.mark.parametrize(("batch", "epochs"), [(0, 1), (0, 3), (5, 1), (20, 2)])
def test_local_updates(spark, batch, epochs):
    r = np.random.default_rng(4)
    x, y, start = r.normal(size=(40, 3)), r.integers(0, 2, 40), r.normal(size=(2, 4))
    rows = spark.createDataFrame([(i % 3, i, int(y[i]), x[i].tolist()) for i in range(40)], "client_id int, sample_id long, label int, features array<double>").repartition(4)
    place = lambda i: (int(hashlib.md5(f"loader:{i}".encode()).hexdigest()[:8], 16), i)
    first = R.local_updates(rows, start, 0.5, 2, batch, 2, epochs, 0.9)
    second = {u.client_id: u.vec for u in R.local_updates(rows, start, 0.25, 2, batch, 3, epochs, 0.9, first).collect()}
    first = {u.client_id: u.vec for u in first.collect()}
    for c in range(3):
        own = sorted([i for i in range(40) if i % 3 == c], key=place)
        velocity, turn = 0.0, 2 * epochs
        for got, rate in ((first, 0.5), (second, 0.25)):
            w = start.copy()
            for _ in range(epochs):
                some = [own[(turn * batch + k) % len(own)] for k in range(min(batch, len(own)))] if batch else own
                z = np.column_stack([x[some], np.ones(len(some))])
                p = np.exp(z @ w.T)
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(some)), y[some]] -= 1
                velocity = 0.9 * velocity + p.T @ z / len(some)
                w, turn = w - rate * velocity, turn + 1
            assert np.allclose(got[c], (w - start).reshape(-1))


def test_gradients_of_a_client_in_slices(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = spark.createDataFrame([(int(i > 50), i, int(i) % 2, r.normal(size=3).tolist()) for i in range(60)], "client_id int, sample_id long, label int, features array<double>")
    start = r.normal(size=(2, 4))
    whole = {u.client_id: u.vec for u in R.local_updates(rows, start, 0.5, 2).collect()}
    monkeypatch.setattr(R, "_GROUP_ROWS", 4)
    assert all(np.allclose(u.vec, whole[u.client_id]) for u in R.local_updates(rows, start, 0.5, 2).collect())


def test_trusted_root_leads(spark):
    """Clients that go the root's way count by their cosine, those against it not at all; lengths are the root's."""
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 6))
    samples = spark.createDataFrame([(i, 9 if v[0] > 0 else 0, v.tolist()) for i, v in enumerate(x)], "sample_id long, label int, features array<double>")
    models = spark.createDataFrame([(k, [0.1 * k] * 6) for k in range(2)], "round int, model array<double>")
    root = {u["round"]: np.array(u.vec) for u in R.root_updates(samples, models, 0.5, 100).collect()}
    chosen = [i.sample_id for i in P.stratified_sample(samples, 100).collect()]
    for k, got in root.items():
        z = x[chosen] @ np.full(6, 0.1 * k)
        assert np.allclose(got, -0.5 * ((1 / (1 + np.exp(-z)) - (x[chosen][:, 0] > 0)) @ x[chosen]) / len(chosen))
    m = [np.stack([3 * root[k], -root[k], 2 * root[k] + r.normal(size=6), np.zeros(6)]) for k in range(2)]
    u = frame(spark, m)
    got = vectors(A.fl_trust(u, spark.createDataFrame([(k, v.tolist()) for k, v in root.items()], "round int, vec array<double>")))
    for k in range(2):
        norm = np.linalg.norm(m[k], axis=1)
        trust = np.maximum(0, np.divide(m[k] @ root[k], norm * np.linalg.norm(root[k]), out=np.zeros(4), where=norm > 0))
        assert np.allclose(got[k], (trust / trust.sum() / (norm + 1e-9)) @ m[k] * np.linalg.norm(root[k]), atol=1e-6)


def test_bound_is_the_quantile_of_fair_coins(spark):
    for d in (1, 7, 64, 1000):
        total, k = Fraction(0), -1
        while total < Fraction(99, 100):
            k += 1
            total += Fraction(math.comb(d, k), 2**d)
        models = spark.createDataFrame([(0, i, 0.0) for i in range(d)], "round int, coord int, value double")
        assert M.binomial_bound(models).head().bound == k
    large = spark.range(139_960).select(F.lit(0).alias("round"), F.col("id").alias("coord"), F.lit(0.0).alias("value"))
    assert M.binomial_bound(large).head().bound == 70_415


def test_factor_decays_to_its_floor(spark):
    """The model moves against the fixed signs, so each check fails."""
    sign = [r.s for r in spark.range(30).select(F.col("id").cast("int").alias("coord")).select(M._sign("coord").alias("s")).collect()]
    models = spark.createDataFrame([(k, c, -float(k) * s) for k in range(25) for c, s in enumerate(sign)], "round int, coord int, value double")
    rows = {r["round"]: r for r in M.residual_scale(models, every=2, factor=2.0).collect()}
    assert min(rows) == 1 and rows[1].factor == 2.0 and rows[2].aligned == 0 and rows[3].aligned is None
    assert abs(rows[2].factor - 1.4) < 1e-12 and abs(rows[24].factor - 2 * 0.7**3) < 1e-12  # a fourth step would be below a half
    assert abs(rows[5].history - math.sqrt(30)) < 1e-9 and abs(rows[5].length - rows[5].factor * rows[5].history) < 1e-9


@pytest.mark.parametrize("window", [1, 2, 5, 6])
def test_trend_of_half_windows(spark, window):
    r = np.random.default_rng(6)
    series = {c: r.integers(0, 4, 12).astype(float).tolist() for c in range(4)}
    rows = spark.createDataFrame([(k, c, v) for c, own in series.items() for k, v in enumerate(own)], "round int, c int, v double")
    for x in E.half_window_trend(rows, "v", window, "c").collect():
        own = series[x.c][max(0, x["round"] - window + 1) : x["round"] + 1]
        if len(own) < window:
            assert x.trend is None
            continue
        a, b = own[: window // 2], own[window // 2 :]
        want = "stable"
        if a and np.mean(b) > np.mean(a) and own[-1] > own[0]:
            want = "up"
        if a and np.mean(b) < np.mean(a) and own[-1] < own[0]:
            want = "down"
        assert x.trend == want


def test_auror_counts_rounds_as_they_come(spark):
    r = np.random.default_rng(2)
    rounds = [0.0001 * r.normal(size=(8, 4)) for _ in range(4)]
    for k, m in enumerate(rounds):
        m[:3, 3 if k < 2 else 2] += 1
    rounds[3][:2, 3] += 1
    plain = vectors(X.auror(frame(spark, rounds), start=1, threshold=0.5, find=2))
    gaps = frame(spark, rounds).withColumn("round", F.col("round") * 3 + 100)
    later = {(r["round"], r.coord): r.value for r in X.auror(gaps, start=1, threshold=0.5, find=2).collect()}
    assert all(np.allclose([later[100 + 3 * k, c] for c in range(4)], plain[k]) for k in range(4))


def _plain_dnc(m, number, f, share=0.2, iterations=5, seed=42):
    r, good = np.random.default_rng((seed, number)), set(range(len(m)))
    for _ in range(iterations):
        cols = r.choice(m.shape[1], max(1, int(share * m.shape[1])), replace=False)
        x = m[:, cols] - m[:, cols].mean(0)
        values, vectors_ = np.linalg.eigh(x.T @ x)  # the direction of most variance
        score = (x @ vectors_[:, -1]) ** 2
        good &= set(sorted(range(len(m)), key=lambda i: score[i])[: len(m) - f])
    return m[sorted(good)].mean(0)


def test_divide_and_conquer_by_eigenvectors(spark, rounds):
    m = [x.copy() for x in rounds]
    for x in m:
        x[:2] += 6
    got = vectors(X.dnc(frame(spark, m), f=2))
    for k in range(2):
        assert np.allclose(got[k], _plain_dnc(m[k], k, 2), atol=1e-9)
        assert np.abs(got[k] - m[k][2:].mean(0)).max() < np.abs(got[k] - m[k][:2].mean(0)).max()


@pytest.mark.parametrize("hidden", [None, (0, 3, 4)])
def test_deep_sight_leaves_out_the_cluster_of_suspects(spark, hidden):
    """Six clients put the energy of their output layer on one class; the rest, clipped to the median norm, are averaged."""
    r = np.random.default_rng(4)
    base = np.concatenate([r.normal(0, 1, 15), r.choice([-1.0, 1.0], 12), np.ones(4)])
    m = base + r.normal(0, 0.001, (20, len(base)))
    m[:6, 18:27] *= 0.01
    m[:6, 28:] *= 0.01
    m[:6, :12] *= -1
    got = vectors(X.deep_sight(frame(spark, [m], bad=6), start=15, classes=4, width=3, samples=2000, hidden=hidden))[0]
    norm = np.linalg.norm(m, axis=1)
    want = (m * np.minimum(1, np.median(norm) / (norm + 1e-6))[:, None])[6:].mean(0)
    assert np.allclose(got, want)


def test_deep_sight_holds_no_number_per_client_and_input(monkeypatch):
    monkeypatch.setattr(X, "per_round", lambda updates, f, schema, extra=None: f)
    m, bad = np.random.default_rng(4).normal(0, 1, (50, 64)), np.arange(50) < 10
    run = X.deep_sight(None, samples=2000)
    run(m, None, bad, 0)
    tracemalloc.start()
    run(m, None, bad, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1000 * 50 * 4 * 8  # a chunk's scores of all clients
