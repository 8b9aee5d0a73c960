import struct
import zlib

import numpy as np
import pytest

from rondo.operators import layers as L
from rondo.operators import partitioners as P
from rondo.sources import configs as C
from rondo.sources import images as I
from rondo.sources import png


def file_of(rows, width, height, depth, colour, palette=None):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    body = zlib.compress(rows)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    return out + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


def filtered(image, kinds):
    """Rows of (height, width, channels) by the filter of each, byte by byte."""
    height, width, channels = image.shape
    flat = image.reshape(height, -1).astype(int)
    out = b""
    for y, kind in enumerate(kinds):
        row = []
        for x, v in enumerate(flat[y]):
            a = flat[y][x - channels] if x >= channels else 0
            b = flat[y - 1][x] if y else 0
            c = flat[y - 1][x - channels] if y and x >= channels else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out += bytes([kind, *row])
    return out


@pytest.mark.parametrize(("channels", "colour"), [(1, 0), (2, 4), (3, 2), (4, 6)])
def test_all_row_filters(channels, colour):
    image = np.random.default_rng(channels).integers(0, 256, (10, 7, channels)).astype(np.uint8)
    assert (png.decode(file_of(filtered(image, [0, 1, 2, 3, 4] * 2), 7, 10, 8, colour)) == image).all()
    assert (png.decode(png.encode(image)) == image).all()


def test_palettes_and_other_depths():
    palette = bytes(range(12))
    got = png.decode(file_of(b"\x00\x1b\x00\xe4", 4, 2, 2, 3, palette))
    assert got[:, :, 0].tolist() == [[0, 3, 6, 9], [9, 6, 3, 0]] and got.shape == (2, 4, 3)
    assert png.decode(file_of(b"\x00\xa0", 3, 1, 1, 0))[0, :, 0].tolist() == [255, 0, 255]
    assert png.decode(file_of(b"\x00\x12\x34\xff\x00", 2, 1, 16, 0))[0, :, 0].tolist() == [0x12, 0xFF]
    with pytest.raises(ValueError, match="not a PNG"):
        png.decode(b"jpeg")


def test_folder_is_decoded_once(spark, tmp_path):
    r = np.random.default_rng(1)
    images = {}
    for name in ("cat", "dog"):
        (tmp_path / "in" / name).mkdir(parents=True)
        for k in range(3):
            images[name, k] = r.integers(0, 256, (4 + k, 5, 3)).astype(np.uint8)
            (tmp_path / "in" / name / f"{k}.png").write_bytes(png.encode(images[name, k]))
    for turn in range(2):
        rows = I.image_folder(spark, str(tmp_path / "in"), str(tmp_path / "cache"), "*.png").collect()
        assert len(rows) == 6
        for x in rows:
            image = images[x["class"], int(x.path[-5])]
            assert (x.height, x.width, x.channels) == image.shape and x.label == (x["class"] == "dog") and np.allclose(x.features, image.reshape(-1) / 255)
        if not turn:  # the second run reads the cache
            for p in (tmp_path / "in").rglob("*.png"):
                p.write_bytes(b"gone")
    loose = I.image_folder(spark, str(tmp_path / "in"), strict=False).collect()
    assert len(loose) == 6 and all(x.features is None and x.height is None for x in loose)
    with pytest.raises(Exception, match="not a PNG"):
        I.image_folder(spark, str(tmp_path / "in")).collect()


@pytest.mark.parametrize(("size", "new", "channels"), [((4, 6), (8, 9), 1), ((7, 5), (3, 2), 3), ((3, 3), (3, 3), 2), ((1, 1), (2, 4), 1)])
def test_resize(spark, size, new, channels):
    image = np.random.default_rng(2).random((*size, channels))

    def axis(old, to):
        w = np.array([[max(0, 1 - abs(i + 0.5 - (o + 0.5) * old / to) / max(1, old / to)) for i in range(old)] for o in range(to)])
        return w / w.sum(1, keepdims=True)

    want = np.einsum("ay,bx,yxc->abc", axis(size[0], new[0]), axis(size[1], new[1]), image)
    rows = spark.createDataFrame([(image.reshape(-1).tolist(),)], "features array<double>")
    assert np.allclose(rows.select(P.resized("features", size, new, channels)).head()[0], want.reshape(-1))


def test_nested_layers(spark):
    v = np.arange(24 + 6 + 3.0)
    u = spark.createDataFrame([(0, 1, "benign", v.tolist())], "round int, client_id int, role string, vec array<double>")
    shapes = [("conv", 0, (2, 3, 2, 2)), ("weight", 24, (3, 2)), ("bias", 30, (3,))]
    row = L.restored(u, shapes)
    got = row.head()
    assert np.array_equal(got.conv, v[:24].reshape(2, 3, 2, 2)) and np.array_equal(got.weight, v[24:30].reshape(3, 2)) and got.bias == v[30:].tolist()
    assert row.select(L.flat([("conv", 4), ("weight", 2), ("bias", 1)])).head()[0] == v.tolist()


YAML = """# settings
seed: 42 # for all
rate: 5.0e-4
name: 'a # b'
empty:
gpu: [0, 1]
nested:
  one: {x: 1, "y": [2, 3]}
  two:
    - a
    - key: v
      other: "w: x"
    -
      deep: true
    - - p
      - q
  three: ~
list:
- 1
- [2, 3]
last: 10:30
"""


def test_settings_as_rows(spark, tmp_path):
    want = {
        "seed": "42", "rate": "5.0e-4", "name": "a # b", "empty": None, "gpu.0": "0", "gpu.1": "1", "nested.one.x": "1", "nested.one.y.0": "2", "nested.one.y.1": "3", "nested.two.0": "a", "nested.two.1.key": "v",
        "nested.two.1.other": "w: x", "nested.two.2.deep": "true", "nested.two.3.0": "p", "nested.two.3.1": "q", "nested.three": None, "list.0": "1", "list.1.0": "2", "list.1.1": "3", "last": "10:30",
    }
    assert dict(C.scalars(YAML)) == want and C.scalars("") == []
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.yaml").write_text(YAML)
    (tmp_path / "s" / "b.yaml").write_text("only: 1\n")
    rows = C.settings_table(spark, str(tmp_path / "s")).collect()
    assert {(r.file, r.path): r.value for r in rows} == {("a.yaml", k): v for k, v in want.items()} | {("b.yaml", "only"): "1"}
    with pytest.raises(ValueError, match="line 2"):
        C.scalars("a: 1\nnonsense\n")


def test_statistics_join_the_samples(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("grey:\n  mean: (0.5,)\n  std: '(0.25,)'\n  epochs: 3\nrgb:\n  mean: [0.1, 0.2, 0.3]\n  std: (1, 2.0, 4e0)\n")
    table = C.statistics(C.settings_table(spark, str(tmp_path / "c.yaml")))
    assert {r.dataset: (r.mean, r.sd) for r in table.collect()} == {"grey": ([0.5], [0.25]), "rgb": ([0.1, 0.2, 0.3], [1.0, 2.0, 4.0])}
    rows = spark.createDataFrame([(1, "grey", [1.0, 0.5]), (2, "rgb", [0.1, 0.2, 0.3, 1.1, 2.2, 4.3]), (3, "none", [1.0])], "sample_id int, dataset string, features array<double>")
    got = {r.sample_id: r.features for r in P.normalised_by(rows, table).collect()}
    assert got[1] == [2.0, 0.0] and np.allclose(got[2], [0, 0, 0, 1, 1, 1]) and got[3] is None


def test_image_trigger_is_grey_and_resized(spark):
    image = np.random.default_rng(5).integers(0, 256, (4, 4, 3)).astype(np.uint8)
    file = spark.createDataFrame([(1, bytearray(png.encode(image)))], "id int, content binary")
    trigger = P.image_trigger(I.decoded(file), 2, 4, 4, 3, 0.5, 0.25)
    grey = (image / 255) @ [0.299, 0.587, 0.114]
    axis = np.array([[max(0, 1 - abs(i + 0.5 - (o + 0.5) * 2) / 2) for i in range(4)] for o in range(2)])
    axis /= axis.sum(1, keepdims=True)
    want = (axis @ grey @ axis.T - 0.5) / 0.25
    rows = spark.createDataFrame([(0, [0.0] * 25)], "sample_id int, features array<double>")
    got = np.array(P.with_image(rows, trigger, 5).head().features).reshape(5, 5)
    assert np.allclose(got[3:, 3:], want) and (got[:3] == 0).all() and (got[:, :3] == 0).all()
