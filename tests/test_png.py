"""PNG files in and out: all filters and colour types, partitions by bytes, tasks that are killed or repeated."""

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import raster
from inkveil.sources import images, png

RNG = np.random.default_rng(1)


def encoded(a, colour, filters, extra=b""):
    """A PNG of the samples ``a`` (height, width, samples), its rows filtered in turn by each of ``filters``."""
    height, width, step = a.shape
    flat, rows = a.reshape(height, -1).astype(int), []
    for y in range(height):
        kind = filters[y % len(filters)]
        left = np.concatenate((np.zeros(step, int), flat[y][:-step])) if width > 1 else np.zeros(step, int)
        up = flat[y - 1] if y else np.zeros_like(flat[y])
        corner = np.concatenate((np.zeros(step, int), up[:-step])) if width > 1 else np.zeros(step, int)
        p = left + up - corner
        distances = np.stack((abs(p - left), abs(p - up), abs(p - corner)))
        paeth = np.choose(distances.argmin(axis=0), (left, up, corner))
        rows.append(bytes([kind]) + ((flat[y] - (0, left, up, (left + up) // 2, paeth)[kind]) % 256).astype(np.uint8).tobytes())
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(b"".join(rows))
    return png.SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + extra + part(b"IDAT", body[:9]) + part(b"IDAT", body[9:]) + part(b"IEND", b"")


@pytest.mark.parametrize("filters", [(0,), (1,), (2,), (3,), (4,), (4, 1, 3, 2, 0)])
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_filters_and_colour_types(filters, colour):
    a = RNG.integers(0, 256, (7, 5, png.SAMPLES[colour]), dtype=np.uint8)
    got = png.decode_png(encoded(a, colour, filters))
    grey = colour in (0, 4)
    assert (got[..., :3] == (a[..., :1] if grey else a[..., :3])).all()
    assert (got[..., 3] == (a[..., -1] if colour in (4, 6) else 255)).all()


def test_palette_and_unusable_files():
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0" * 4
    a = np.array([[[0], [2]], [[1], [0]]], np.uint8)
    got = png.decode_png(encoded(a, 3, (0, 2), part(b"PLTE", bytes([9, 8, 7, 1, 2, 3, 4, 5, 6])) + part(b"tRNS", bytes([0, 50]))))
    assert got.tolist() == [[[9, 8, 7, 0], [4, 5, 6, 255]], [[1, 2, 3, 50], [9, 8, 7, 0]]]
    for bad in (b"", b"GIF89a", png.SIGNATURE, raster.png(np.zeros((2, 2, 4), np.uint8))[:40]):
        with pytest.raises(Exception):  # noqa: B017
            png.decode_png(bad)


def pictures(spark, n):
    rows = [(f"/in/{k % 3}/im{k}.jpg", bytearray(raster.png(np.full((4, 3, 4), k, np.uint8)))) for k in range(n)]
    return spark.createDataFrame(rows, "path string, data binary").repartition(3)


def files_of(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_files_are_named_after_their_images_and_read_back(spark, tmp_path):
    out = str(tmp_path / "out")
    images.write_images(pictures(spark, 10), out)
    names = [f.split("/")[-1] for f in files_of(out)]
    assert sorted(names) == sorted([f"im{k}_redacted.png" for k in range(10)] + ["_SUCCESS"])
    (tmp_path / "out" / "broken.png").write_bytes(b"none")
    got = images.read_png(spark, out, 150)
    rows = {r.path.split("/")[-1]: r for r in got.collect()}
    assert got.rdd.getNumPartitions() > 3 and images.read_png(spark, out).rdd.getNumPartitions() == 1
    assert len(rows) == 11 and rows["broken.png"].error and rows["broken.png"].data is None
    assert all(bytes(rows[f"im{k}_redacted.png"].data) == bytes([k]) * 48 and rows[f"im{k}_redacted.png"].width == 3 for k in range(10))
    # Written again: the files of the last time go.
    images.write_images(pictures(spark, 2), out)
    assert [f.split("/")[-1] for f in files_of(out) if "part-" in f and f.endswith("png")] != [] and sum("redacted" in f for f in files_of(out)) == 2
    same = spark.createDataFrame([(f"/{k}/a.png", bytearray(b"x")) for k in range(3)], "path string, data binary").coalesce(1)
    images.write_images(same, str(tmp_path / "same"))
    assert [f.split("/")[-1] for f in files_of(tmp_path / "same")][1:] == ["a_redacted (2).png", "a_redacted (3).png", "a_redacted.png"]
    assert images.read_png(spark, str(tmp_path / "none")).count() == 0 if (tmp_path / "none").mkdir() is None else True


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    images.write_images(pictures(spark, 2), out)
    before = files_of(out)

    @F.udf("binary")
    def dies(path, data):
        if path.endswith("im7.jpg"):
            raise RuntimeError("killed")
        return data

    broken = pictures(spark, 10).withColumn("data", dies("path", "data"))
    with pytest.raises(Exception, match="killed"):
        images.write_images(broken, out)
    assert files_of(out) == before  # not even a part of what the other tasks wrote


def test_an_attempt_that_is_not_committed_is_not_shown(tmp_path):
    """A repeated task: the files of its first attempt, one cut short, stay aside and go with the commit."""
    from pyspark.sql import Row

    writer = png.PngWriter({"path": str(tmp_path / "out")}, True)

    def cut_short():
        yield Row(output_name="a_redacted.png", data=b"whole")
        raise OSError("gone")

    with pytest.raises(OSError):
        writer.write(cut_short())
    done = writer.write(iter([Row(output_name="a_redacted.png", data=b"whole"), Row(output_name="b_redacted.png", data=b"b")]))
    assert not [f for f in files_of(tmp_path / "out") if not f.startswith("_writing")]
    writer.commit([done, None, writer.write(iter([]))])
    assert [f.split("/")[-1] for f in files_of(tmp_path / "out")] == ["_SUCCESS", "a_redacted.png", "b_redacted.png"]
