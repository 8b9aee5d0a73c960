"""Operators on a toy matrix with expected values, and properties; see FIXTURES.md."""

import numpy as np
import pytest

from rondo.functions import vectors as V
from rondo.operators import aggregators as A
from rondo.operators import matrix as X
from rondo.operators import partitioners as P
from rondo.operators import perturbations as M
from rondo.sources import fixtures as S

TOY = [[1, 2, 0], [1, 1, 1], [2, 2, 1], [0, 1, 1], [1, 3, 0], [10, -10, 5]]


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(0, i, "attacker" if i == 5 else "benign", [float(x) for x in v]) for i, v in enumerate(TOY)]
    return spark.createDataFrame(rows, "round int, client_id int, role string, vec array<double>")


def vector(df):
    return [r.value for r in df.orderBy("coord").collect()]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (A.mean, (2.5, -0.166667, 1.333333)),
        (lambda u: A.mean_norm(u, 1), (0.968118, 1.031739, 0.58988)),
        (A.median, (1, 1, 1)),
        (lambda u: A.median(u, True), (1, 1.5, 1)),
        (lambda u: A.trimmed_mean(u, 0.2), (1.25, 1.5, 0.75)),
        (lambda u: A.krum(u, 1), (1, 2, 0)),
        (lambda u: A.multi_krum(u, 1, 0.5), (1.333333, 1.666667, 0.666667)),
        (lambda u: X.bulyan(u, 1), (1, 1.5, 0.75)),
        (A.rfa, (1.108303, 1.381654, 0.785014)),
        (A.norm_clipping, (1.158114, 1.141008, 0.666667)),
        (lambda u: A.centered_clipping(u, 3.0), (1.158114, 1.141008, 0.666667)),
        (X.min_max, (0.358757, 0.645763, 0.215254)),
        (X.min_sum, (0.374462, 0.674032, 0.224677)),
    ],
)
def test_expected_vectors(toy, f, want):
    assert vector(f(toy)) == pytest.approx(want, abs=2e-5)


def test_krum_scores(toy):
    got = [r.score for r in A.krum_scores(toy, 1).orderBy("client_id").collect()]
    assert got == pytest.approx([5.560478, 6.064495, 6.796546, 7.417609, 7.417609, 60.937645], abs=1e-6)


def test_attacks(toy):
    one = lambda df: [r.value for r in df.where("client_id = 5").orderBy("coord").collect()]
    assert one(M.inner_product(toy, 0.5)) == pytest.approx((-0.5, -0.9, -0.3))
    assert one(M.little_is_enough(toy)) == pytest.approx((0.839769, 1.610412, 0.475886), abs=1e-6)
    assert one(M.sign_flip(toy)) == [-10, 10, -5]


def test_spectral_scores():
    got = X.spectral_scores(np.array(TOY, float))
    assert got == pytest.approx([8.442232, 3.434622, 4.161838, 5.907325, 13.46569, 166.382792], abs=1e-5)


def test_clusters():
    r = np.random.default_rng(0)
    m = np.concatenate([r.normal(0, 0.1, (30, 4)), r.normal(5, 0.1, (12, 4))])
    for label in (X.dbscan(X.distances(m), 1.0, 3), X.two_means(m), X.mean_shift(m), X.hdbscan(X.distances(m), 5)):
        assert len(set(label[:30])) == len(set(label[30:])) == 1 and label[0] != label[-1]
    assert (X.dbscan(X.distances(m), 1e-9, 3) == -1).all() and X.largest(np.full(3, -1)).all()
    one = X.hdbscan(X.distances(m), 25, True)  # the root is the one cluster: who stays in it to its end
    assert (one[:30] == 0).sum() >= 25 and (one[30:] == -1).all()


def test_properties(spark, toy):
    shuffled = toy.orderBy("vec")
    for f in (A.mean, A.median, A.trimmed_mean):
        assert vector(f(shuffled)) == pytest.approx(vector(f(toy)))
    assert vector(A.trimmed_mean(toy, 0.0)) == pytest.approx(vector(A.mean(toy)))
    assert vector(A.multi_krum(toy, 1, 1.0)) == pytest.approx(vector(A.mean(toy)))
    with pytest.raises(ValueError):
        A.trimmed_mean(toy, 0.5)
    with pytest.raises(Exception, match="selects no client"):
        A.multi_krum(toy, 1, 0.1).collect()
    with pytest.raises(ValueError):
        P.split(toy, "pat")


def test_partition_is_disjoint_and_complete(spark):
    samples = spark.createDataFrame([(i, i % 3, [0.0]) for i in range(47)], "sample_id long, label int, features array<double>")
    rows = P.iid(samples, 4).collect()
    assert sorted(r.sample_id for r in rows) == list(range(47)) and {r.client_id for r in rows} == {0, 1, 2, 3}


def test_median_resists_noise(spark):
    r = np.random.default_rng(1)
    rows = [(0, i, "attacker" if i < 10 else "benign", [float(x) for x in r.normal(1, 0.1, 16)]) for i in range(50)]
    u = spark.createDataFrame(rows, "round int, client_id int, role string, vec array<double>")
    noisy = S.to_wide(M.gaussian_noise(u, 0, 30.0))
    error = lambda f: np.abs(np.array(vector(f(noisy))) - 1).max()
    assert error(A.median) < error(A.mean)


def test_helpers():
    assert V.count_or_share(0.2, 50) == 10 and V.count_or_share(7, 50) == 7


def test_my_defense_drops_a_client_poisoned_in_one_layer(spark):
    r = np.random.default_rng(4)
    m = np.abs(r.normal(1, 0.05, (12, 64)))
    m[:, 60:] = r.normal(0.5, 0.01, (12, 4))
    m[5, 60:] = -0.5  # small beside the whole vector
    rows = [(0, c, "benign", m[c].tolist()) for c in range(12)]
    one = spark.createDataFrame(rows, "round int, client_id int, role string, vec array<double>")
    for mode in ("topk", "mad"):
        got = np.array([x["value"] for x in X.my_defense(one, 0, mode).orderBy("coord").collect()])
        assert got.shape == (64,) and abs(got[60:] - 0.5).max() < 0.02
    norm = np.linalg.norm(m, axis=1)
    clipped = m * np.minimum(1, np.median(norm) / norm)[:, None]
    kept = X.voted(m, 3, "topk", np.random.default_rng(1))
    assert 8 <= len(kept) <= 9
    assert len(X.voted(m, 11, "topk", np.random.default_rng(1))) >= 8  # 0.6 of 12 clients at least
    whole = X.layer_filtered(m, [(0, 60, 1), (60, 4, 1)], 1e9, 1e9)
    assert np.allclose(whole, clipped.mean(0))
    sign = 0.35 * np.sign(m[:, 60:]).sum(1) / 4
    good = np.abs(sign - np.sort(sign)[5]) / sign.std() < 1
    assert not good[5] and np.allclose(X.layer_filtered(m, [(0, 60, 1), (60, 4, 1)], 1e9, 1)[60:], clipped[good, 60:].mean(0))
