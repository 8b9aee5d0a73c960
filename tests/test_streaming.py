import datetime

import numpy as np
import pytest

from rondo.operators import aggregators as A
from rondo.streaming import keyed as Y
from rondo.streaming import rounds as T


def test_running_centre_over_batches(spark, tmp_path):
    r = np.random.default_rng(3)
    m = r.normal(0, 1, (4, 6, 5))
    schema = "role string, round int, client_id int, vec array<double>"
    for k in range(4):
        spark.createDataFrame([("benign", k, c, m[k, c].tolist()) for c in range(6)], schema).coalesce(1).write.parquet(str(tmp_path / "in.parquet" / f"round={k}x"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in.parquet"))
    got = {(x["round"], x["coord"]): x["value"] for x in T.centred_clipping(stream, 1.0).collect()}
    centre, seen = np.zeros(5), sorted({k for k, _ in got})
    assert seen == [0, 1, 2, 3]
    first = m[0] * np.minimum(1, 1 / np.linalg.norm(m[0], axis=1))[:, None]
    centre = first.mean(0)
    assert np.allclose([got[0, c] for c in range(5)], centre)
    for k in range(1, 4):
        gap = m[k] - centre
        centre = centre + (gap * np.minimum(1, 1 / np.linalg.norm(gap, axis=1))[:, None]).mean(0)
        assert np.allclose([got[k, c] for c in range(5)], centre)
    centre = first.mean(0)
    one = spark.createDataFrame([(0, c, "benign", m[0, c].tolist()) for c in range(6)], "round int, client_id int, role string, vec array<double>")
    assert np.allclose([x["value"] for x in A.centered_clipping(one, 1.0).orderBy("coord").collect()], centre)


def test_detector_drops_erratic_clients(spark, tmp_path):
    r = np.random.default_rng(5)
    base = r.normal(0, 1, 8)
    rows = []
    for k in range(9):
        for c in range(20):
            v = base * (1 - 0.05 * k) + r.normal(0, 0.01, 8) if c >= 4 else r.normal(0, 5, 8)
            rows.append(("benign", k, c, v.tolist()))
    schema = "role string, round int, client_id int, vec array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in.parquet"))
    last = [x["value"] for x in T.detector(stream).where("round = 8").orderBy("coord").collect()]
    assert np.abs(np.array(last) - base * 0.6).max() < 0.05


def test_curvature_of_a_quadratic():
    h = np.diag([1.0, 2.0, 3.0])
    w = np.eye(3)
    assert np.allclose(T.curvature_product(w, w @ h, np.array([1.0, 1.0, 1.0])), [1, 2, 3])


UPDATE = "round int, client_id int, role string, vec array<double>"


def files(spark, folder, *parts):
    for k, rows in enumerate(parts):
        spark.createDataFrame([(r, c, "benign", v) for r, c, v in rows], UPDATE).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")


def stream_of(spark, folder):
    return spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def test_round_in_two_batches_is_stepped_once(spark, tmp_path):
    files(spark, tmp_path / "in", [(0, 0, [0.0]), (0, 1, [1.0])], [(0, 2, [2.0]), (0, 3, [3.0]), (1, 0, [1.5])])
    for options in ({}, {"clients": 4}):
        got = T.centred_clipping(stream_of(spark, tmp_path / "in"), 100.0, **options)
        assert got.columns == ["round", "coord", "value"] and sorted(map(tuple, got.collect())) == [(0, 0, 1.5), (1, 0, 1.5)]
    waiting = T.centred_clipping(stream_of(spark, tmp_path / "in"), 100.0, clients=4, finish=False)
    assert [tuple(r) for r in waiting.collect()] == [(0, 0, 1.5)]


def noisy(rounds, clients, size=5):
    r = np.random.default_rng(8)
    base = r.normal(0, 1, size)
    return [[(k, c, (base * (1 - 0.05 * k) + r.normal(0, 5 if c == 0 else 0.01, size)).tolist()) for c in range(clients)] for k in range(rounds)]


@pytest.mark.parametrize("make", [T.centred_clipping, T.detector])
def test_stopped_stream_goes_on(spark, tmp_path, make, monkeypatch):
    files(spark, tmp_path / "in", *noisy(7, 6))
    whole = {(r.round, r.coord): r.value for r in make(stream_of(spark, tmp_path / "in")).collect()}
    write, left = T.Rounds.write, [4]

    def killed(self, rows, name, number):
        if name == "out" and left[0] == 0:
            raise RuntimeError("killed")
        left[0] -= name == "out"
        write(self, rows, name, number)

    folder = str(tmp_path / "state")
    with monkeypatch.context() as m:
        m.setattr(T.Rounds, "write", killed)
        with pytest.raises(Exception, match="killed"):
            make(stream_of(spark, tmp_path / "in"), folder=folder)
    assert left == [0]
    again = {(r.round, r.coord): r.value for r in make(stream_of(spark, tmp_path / "in"), folder=folder).collect()}
    assert again.keys() == whole.keys() and all(abs(again[k] - whole[k]) < 1e-9 for k in whole)


def test_keyed_history_goes_on_from_its_state(spark, tmp_path):
    rows = noisy(4, 3, 7)
    files(spark, tmp_path / "in", *rows[:2])
    folder = str(tmp_path / "state")
    Y.client_history(stream_of(spark, tmp_path / "in"), folder, 3).awaitTermination()
    for k, part in enumerate(rows[2:], 2):
        late = [(0, 1, [9.0] * 7)] if k == 3 else []
        spark.createDataFrame([(r, c, "benign", v) for r, c, v in part + late], UPDATE).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    Y.client_history(stream_of(spark, tmp_path / "in"), folder, 3).awaitTermination()
    got = {(r.round, r.client_id): r for r in Y.history(spark, folder).collect()}
    m = np.array([[v for _, _, v in part] for part in rows])
    assert len(got) == 12
    for (k, c), r in got.items():
        assert abs(r.norm - np.linalg.norm(m[k, c])) < 1e-9 and abs(r.travelled - np.linalg.norm(m[: k + 1, c].sum(0))) < 1e-9
        assert r.cosine is None if k == 0 else abs(r.cosine - m[k, c] @ m[k - 1, c] / np.linalg.norm(m[k, c]) / np.linalg.norm(m[k - 1, c])) < 1e-9


@pytest.mark.parametrize("make", [T.event_windows, T.event_rounds])
def test_late_rows_are_dropped(spark, tmp_path, make):
    schema = "ts timestamp, user_id long, event_type string, value double"
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    first = [(day(1), 1, "a", 1.0), (day(2), 1, "a", 1.0), (day(12), 1, "a", 1.0)]
    for k, rows in enumerate([first, [(day(3), 1, "a", 7.0), (day(20), 1, "a", 1.0)]]):
        path = str(tmp_path / "in" / str(k))
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = T.drained(make(stream), "append").collect()
    assert sorted((r.start.day, r.n, r.total) for r in got) == [(1, 1, 1.0), (2, 1, 1.0), (12, 1, 1.0)]


@pytest.mark.parametrize(("make", "tau"), [(T.centred_clipping, 0.3), (T.centred_clipping, 100.0), (T.detector, None)])
def test_rounds_of_a_batch_are_stepped_together(spark, tmp_path, make, tau, monkeypatch):
    rows = noisy(12, 8)
    files(spark, tmp_path / "in", [x for part in rows for x in part])
    written, write = [], T.Rounds.write
    monkeypatch.setattr(T.Rounds, "write", lambda self, rows, name, number: (written.append(name), write(self, rows, name, number)))
    options = {} if tau is None else {"tau": tau}
    once = {(r.round, r.coord): r.value for r in make(stream_of(spark, tmp_path / "in"), **options).collect()}
    assert written.count("out") == 2  # the rounds before the last, and the last at the end
    monkeypatch.setattr(T, "_SEGMENT", 3 * 8 * 5, raising=False)  # three rounds a segment
    cut = {(r.round, r.coord): r.value for r in make(stream_of(spark, tmp_path / "in"), **options).collect()}
    assert once.keys() == cut.keys() == {(k, c) for k in range(12) for c in range(5)} and all(abs(once[k] - cut[k]) < 1e-9 for k in once)
    if tau:
        centre = np.zeros(5)
        for k, part in enumerate(rows):
            gap = np.array([v for _, _, v in part]) - centre
            centre = centre + (gap * np.minimum(1, tau / np.linalg.norm(gap, axis=1))[:, None]).mean(0)
            assert np.allclose([cut[k, c] for c in range(5)], centre)


def test_gap_statistic_draws_once_for_equally_many_scores(monkeypatch):
    moved, best = [], T._best
    monkeypatch.setattr(T, "_best", lambda x, centres: (moved.append(len(x)), best(x, centres))[1])
    r = np.random.default_rng(2)
    two = [np.concatenate([r.normal(0, 0.01, 11), r.normal(1, 0.01, 12)]) for _ in range(40)]
    assert [T.gap_clusters(x, 2) for x in two] == [2] * 40
    assert sum(moved) <= 2 * 40 + 2 * 20  # uniform numbers are clustered for the first scores only
    one = r.random(23)
    drawn = T.gap_clusters(one, 10)
    getattr(T._drawn, "cache_clear", lambda: None)()
    assert T.gap_clusters(one, 10) == drawn
