"""The .h5ad source by row ranges. Where h5py is not installed, a stand-in with the part of its
interface that the source uses serves files written here: a folder of .npy arrays and attributes."""

from __future__ import annotations

import importlib.util
import json
import os
import sys

import numpy as np
import pytest

STAND_IN = '''
import json, os
import numpy as np

class Node:
    def __init__(self, path):
        self.path = path
        own = os.path.join(path, "attrs.json") if os.path.isdir(path) else path + ".json"
        self.attrs = json.load(open(own)) if os.path.exists(own) else {}

class Dataset(Node):
    def __init__(self, path):
        super().__init__(path)
        self.values = np.load(path + ".npy", mmap_mode="r")
        self.shape = self.values.shape
    def __getitem__(self, at):
        got = self.values[at]
        return got.astype(object) if got.dtype.kind == "S" else np.array(got)

class Group(Node):
    def keys(self):
        return {n.split(".")[0] for n in os.listdir(self.path)} - {"attrs"}
    def __getitem__(self, name):
        at = os.path.join(self.path, name)
        return Group(at) if os.path.isdir(at) else Dataset(at)

class File(Group):
    def __init__(self, path, mode="r"):
        super().__init__(path)
        with open(os.path.join(path, "opened"), "a") as log:
            log.write(f"{os.getpid()}\\n")
    def __enter__(self):
        return self
    def __exit__(self, *why):
        return False
'''


@pytest.fixture(scope="module")
def stand_in(spark, tmp_path_factory):
    if importlib.util.find_spec("h5py"):
        yield None
        return
    at = tmp_path_factory.mktemp("module") / "h5py.py"
    at.write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(at))
    sys.path.insert(0, str(at.parent))
    yield "stand-in"
    sys.path.remove(str(at.parent))
    sys.modules.pop("h5py", None)


def write(path, tree: dict, stand_in) -> str:
    """tree: name -> array, or (array or None for a group, attributes)."""
    if stand_in is None:
        import h5py

        with h5py.File(path, "w") as f:
            for name, v in tree.items():
                v, attrs = v if isinstance(v, tuple) else (v, {})
                node = f.require_group(name) if v is None else f.create_dataset(name, data=v)
                node.attrs.update(attrs)
        return str(path)
    for name, v in tree.items():
        v, attrs = v if isinstance(v, tuple) else (v, {})
        at = path / name
        os.makedirs(at if v is None else at.parent, exist_ok=True)
        if v is not None:
            np.save(f"{at}.npy", v)
        if attrs:
            (at / "attrs.json" if v is None else at.with_suffix(".json")).write_text(json.dumps(attrs))
    return str(path)


def tree(dense: np.ndarray, kind: str) -> dict:
    n, g = dense.shape
    out = {
        "obs": (None, {"_index": "name"}),
        "obs/name": np.array([f"c{i}" for i in range(n)], "S8"),
        "obs/area": np.arange(n) * 0.5,
        "obs/batch": (None, {}),
        "obs/batch/codes": (np.arange(n) % 3 - 1).astype(np.int8),
        "obs/batch/categories": np.array(["left", "right"], "S8"),
        "var": (None, {"_index": "_index"}),
        "var/_index": np.array([f"g{j}" for j in range(g)], "S8"),
        "obsm/spatial": np.column_stack([np.arange(n), np.arange(n) * 2.0]),
        "obsm/X_nmf": np.arange(n * 3).reshape(n, 3) / 4,
    }
    if kind == "dense":
        return out | {"X": dense}
    m = dense if kind == "csr" else dense.T
    i, j = np.nonzero(m)
    ends = np.concatenate([[0], np.bincount(i, minlength=len(m)).cumsum()])
    return out | {"X": (None, {"encoding-type": f"{kind}_matrix"}), "X/indptr": ends, "X/indices": j, "X/data": m[i, j]}


@pytest.mark.parametrize("kind", ["csr", "csc", "dense"])
def test_tables_by_ranges(spark, stand_in, tmp_path, kind):
    from mosaicell.sources.tables import read_h5ad

    rng = np.random.default_rng(3)
    dense = rng.poisson(0.4, (57, 11)).astype(float)
    dense[5] = 0  # an empty row
    dense[20:25] = 3  # full ones
    path = write(tmp_path / "m", tree(dense, kind), stand_in)
    t = read_h5ad(spark, path, reps=("X_nmf",), columns=("batch", "area"), values=40)
    i, j = np.nonzero(dense)
    want = sorted((f"c{a}", f"g{b}", dense[a, b]) for a, b in zip(i, j, strict=True))
    assert sorted(map(tuple, t["expression"].collect())) == want
    assert sorted(map(tuple, t["points"].collect())) == sorted((f"c{a}", float(a), 2.0 * a) for a in range(57))
    assert {r.cell_id: r.vec for r in t["rep_X_nmf"].collect()}["c7"] == [21 / 4, 22 / 4, 23 / 4]
    batch = {r.cell_id: r.value for r in t["obs_batch"].collect()}
    assert len(batch) == 57 and [batch["c0"], batch["c1"], batch["c2"]] == [None, "left", "right"]
    assert {r.cell_id: float(r.value) for r in t["obs_area"].collect()}["c3"] == 1.5
    if kind != "csc":
        assert t["expression"].rdd.getNumPartitions() > 3
    if stand_in:  # tasks open the file, not the driver alone
        assert set((tmp_path / "m" / "opened").read_text().split()) - {str(os.getpid())}


def test_empty_matrix_and_unknown_table(spark, stand_in, tmp_path):
    from mosaicell.sources.h5ad import H5adSource
    from mosaicell.sources.tables import read_h5ad

    path = write(tmp_path / "m", tree(np.zeros((0, 4)), "csr"), stand_in)
    t = read_h5ad(spark, path)
    assert t["expression"].count() == t["points"].count() == 0
    with pytest.raises(ValueError):
        H5adSource({"table": "nothing"}).schema()


def test_ranges_are_whole_and_balanced():
    from mosaicell.sources.h5ad import sparse_ranges

    rng = np.random.default_rng(1)
    for n, values in ((1, 10), (100, 50), (1000, 300), (1000, 10**9)):
        sizes = rng.integers(0, 20, n)
        ends = np.concatenate([[0], sizes.cumsum()])
        got = sparse_ranges(ends, n, values)
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
        assert all(ends[b] - ends[a] <= values + 20 * max(1, n // 8) for a, b in got)
    assert sparse_ranges(np.zeros(1, int), 0, 10) == []
