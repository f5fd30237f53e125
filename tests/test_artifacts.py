"""Files with a commit: seen whole or not at all; images that cannot be read."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenspan.sources import artifacts, files

SCHEMA = "frame long, name string, content binary, clash string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data], SCHEMA)


def test_a_write_replaces_the_one_before(spark, tmp_path):
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        assert artifacts.listed(spark, path).count() == 0
        first = [(f, f"{n}.bin", bytes([f, n]) * n) for f in range(5) for n in range(4)]
        artifacts.write(rows(spark, first).repartition(3), path)
        assert sorted(map(tuple, artifacts.read(spark, path).collect())) == first
        artifacts.write(rows(spark, [(9, "only.bin", None)]), path)
        assert [tuple(r) for r in artifacts.read(spark, path).collect()] == [(9, "only.bin", b"")]
        artifacts.write(rows(spark, []), path)
        assert artifacts.listed(spark, path).count() == 0


@pytest.mark.parametrize("bad", [(None, "a", b""), (1, "../a", b""), (1, "_a", b""), (1, None, b""), (0, "0.bin", b"twice")])
def test_a_failed_task_leaves_no_part(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    good = [(f, f"{n}.bin", b"old") for f in range(8) for n in range(2)]
    artifacts.write(rows(spark, good), path)
    with pytest.raises(Exception, match="no file can be named|has two files"):
        artifacts.write(rows(spark, [(f, n, b"new") for f, n, _ in good] + [bad]), path)
    assert sorted(map(tuple, artifacts.read(spark, path).collect())) == good
    assert len(glob.glob(f"{path}/job-*")) == 1  # the failed job's folder is gone


def test_a_task_that_is_tried_again_counts_once(spark, tmp_path):
    """Files of an attempt that failed are in no list."""
    path = str(tmp_path / "out")
    writer = artifacts.ArtifactWriter(path)
    with pytest.raises(ValueError, match="no file"):
        writer.write(iter([{"frame": 1, "name": "a", "content": b"1"}, {"frame": 1, "name": "/", "content": b""}]))
    again = writer.write(iter([{"frame": 1, "name": "a", "content": b"1"}]))
    writer.commit([again, None])
    assert [tuple(r) for r in artifacts.read(spark, path).collect()] == [(1, "a", b"1")]
    assert sum(len(x) for _, _, x in os.walk(path)) > 3  # the lost attempt's file stays unseen


def test_changed_bytes_are_an_error(spark, tmp_path):
    path = str(tmp_path / "out")
    artifacts.write(rows(spark, [(1, "a.bin", b"good")]), path)
    with open(artifacts.listed(spark, path).first()["file"], "wb") as f:
        f.write(b"bad!")
    with pytest.raises(Exception, match="was changed"):
        artifacts.read(spark, path).collect()


def test_unreadable_images_are_rows(spark):
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    good = files.png_bytes(image)
    data = [("a", good), ("b", b"no image"), ("c", good[:40]), ("d", None), ("e", b""), ("f", good.replace(b"IDAT", b"IDAX"))]
    got = {r.path: r for r in files.decode_images(spark.createDataFrame(data, "path string, content binary")).collect()}
    assert (got["a"].height, got["a"].width, got["a"].channels, got["a"].error) == (2, 4, 3, None) and got["a"].pixels == image.tobytes()
    assert all(got[p].pixels is None and got[p].height is None and got[p].error for p in "bcdef")
    assert F.lit(1) is not None


def test_small_files_are_written_by_all_tasks(spark, tmp_path):
    """Their few bytes were joined into one task before."""
    path = str(tmp_path / "out")
    artifacts.write(rows(spark, [(f, "a.bin", b"x") for f in range(64)]), path)
    told = json.loads((tmp_path / "out" / artifacts.COMMITTED).read_text())
    assert told["files"] == 64 and len(told["listings"]) == 4
    assert artifacts.read(spark, path).count() == 64


def test_files_from_runs():
    """A run, a pixel with a depth, and no run at all."""
    from lumenspan.plans.artifacts import _content, _pixels

    one = lambda *x: [np.array([i]) for i in x]
    none = [np.array([], np.int64)] * 4
    for name in ("a.png", "a_overlay.png", "a.json"):
        assert _pixels(name, _content(name, *one(23, 28, 31, 0.0))) == 4 and _pixels(name, _content(name, *none)) == 0
    assert _pixels("a.npy", _content("a.npy", *one(23, 31, 31, 2.5))) == 1 and _pixels("a.npy", _content("a.npy", *none)) == 0
