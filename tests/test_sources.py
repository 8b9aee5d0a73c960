import numpy as np

from rondo.operators import aggregators as A
from rondo.operators import training as R
from rondo.sources import images as I


def test_folder_scan_and_split(spark, tmp_path):
    for name, n in (("b", 5), ("a", 10)):
        (tmp_path / name).mkdir()
        for k in range(n):
            (tmp_path / name / f"{k}.png").write_bytes(bytes([k]))
    rows = I.stratified_split(I.folder(spark, str(tmp_path))).collect()
    assert {(r["class"], r.label) for r in rows} == {("a", 0), ("b", 1)}
    assert sum(r.part == "train" for r in rows if r.label == 0) == 8 and sum(r.part == "train" for r in rows if r.label == 1) == 4


def test_listed_and_delimited(spark, tmp_path):
    (tmp_path / "names").write_text("n2\nn1\n")
    (tmp_path / "table").write_text("x.jpg\tn1\t0\ny.jpg\tn2\t0\n")
    assert {(r.file, r.label) for r in I.listed(spark, str(tmp_path / "names"), str(tmp_path / "table")).collect()} == {("x.jpg", 1), ("y.jpg", 0)}
    (tmp_path / "f.csv").write_text("1,2\n3,4\n")
    (tmp_path / "l.csv").write_text("0,1,0\n1,0,0\n")
    assert [tuple(r) for r in I.delimited(spark, str(tmp_path / "f.csv"), str(tmp_path / "l.csv"), 2, 3).orderBy("sample_id").collect()] == [(1, 1, [1.0, 2.0]), (2, 0, [3.0, 4.0])]


def test_training_learns(spark):
    r = np.random.default_rng(0)
    x, y = r.normal(0, 1, (200, 4)), np.arange(200) % 2
    x[:, 0] += np.where(y == 1, 2, -2)
    rows = spark.createDataFrame([(i % 5, i, int(y[i]), x[i].tolist()) for i in range(200)], "client_id int, sample_id long, label int, features array<double>")
    weights = R.train(rows, A.mean, 3, 1.0, 2, 4)
    assert R.evaluated(rows, weights, 2).where("pred = label").count() > 180
    assert R.learning_rate(1.0, 80, "step") == 0.5 and R.learning_rate(1.0, 0, "cosine") == 1.0
