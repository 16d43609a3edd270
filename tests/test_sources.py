"""NumPy files in pieces, and backups restored in dependency order."""

import os

import numpy as np
import pytest

from velum.sources import formats, npy


@pytest.mark.parametrize(("dtype", "order"), [("f4", "C"), ("f2", "F"), ("i1", "C"), (">f8", "F"), ("u2", "C")])
def test_npy_in_pieces(spark, tmp_path, dtype, order, monkeypatch):
    x = np.random.default_rng(1).integers(-100, 100, (1000, 7)).clip(0 if "u" in dtype else -100).astype(dtype)
    np.save(tmp_path / "a.npy", np.asarray(x, order=order))
    df = npy.npy_rows(spark, str(tmp_path / "a.npy"), 7 * x.dtype.itemsize * 64)
    assert df.rdd.getNumPartitions() == 16
    assert [r.vector for r in df.orderBy("index").collect()] == x.astype(float).tolist()


def test_npy_folders_and_odd_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(5, dtype="f4"))
    np.save(tmp_path / "b.npy", np.zeros((0, 3)))
    os.mkdir(tmp_path / "more")
    np.save(tmp_path / "more" / "c.npy", np.ones((2, 2)))
    (tmp_path / "readme.txt").write_text("x")
    rows = sorted((os.path.basename(r.path), r["index"], list(r.vector)) for r in npy.npy_rows(spark, str(tmp_path)).collect())
    assert rows == [("a.npy", i, [float(i)]) for i in range(5)] + [("c.npy", i, [1.0, 1.0]) for i in range(2)]
    os.mkdir(tmp_path / "none")
    assert npy.npy_rows(spark, str(tmp_path / "none")).count() == 0
    np.save(tmp_path / "d.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="one or two dimensions"):
        npy.npy_rows(spark, str(tmp_path / "d.npy")).count()


def test_restore_in_dependency_order(spark, tmp_path):
    relations = {"nodes": [("profile_id", "profiles")], "edges": [("source_id", "nodes"), ("target_id", "nodes")], "notes": [("above", "notes")]}
    assert formats.dependency_order(["edges", "notes", "nodes", "profiles"], relations) == ["notes", "profiles", "nodes", "edges"]
    with pytest.raises(ValueError, match="refer to each other"):
        formats.dependency_order(["a", "b"], {"a": [("x", "b")], "b": [("y", "a")]})
    tables = {
        "profiles": spark.createDataFrame([(1, "work")], "id long, name string"),
        "nodes": spark.createDataFrame([(11, 1, "2024-01-03"), (12, 9, "2024-01-02"), (13, None, "2024-01-01"), (14, 1, None)], "id long, profile_id long, created_at string"),
        "edges": spark.createDataFrame([(21, 11, 13), (22, 11, 12), (23, 14, None)], "id long, source_id long, target_id long"),
        "notes": spark.createDataFrame([(1, 2), (2, None), (3, 99)], "id long, above long"),
    }
    formats.backup(tables, str(tmp_path / "b"))
    held = {n: t.limit(0) for n, t in tables.items()} | {"nodes": spark.createDataFrame([(11, 5, "mine")], tables["nodes"].schema)}
    with pytest.raises(ValueError, match="isn't empty"):
        formats.restored(spark, str(tmp_path / "b"), held, relations=relations)
    out = formats.restored(spark, str(tmp_path / "b"), held, True, relations)
    ids = lambda n: sorted(r.id for r in out[n].collect())
    assert (ids("nodes"), ids("edges"), ids("notes")) == ([11, 13, 14], [21, 23], [1, 2, 3])
    assert out["nodes"].where("id = 11").first().created_at == "mine"
    order = [r.id for r in spark.read.json(str(tmp_path / "b" / "nodes")).coalesce(1).collect()]
    assert sorted(order) == [11, 12, 13, 14]
