"""A Spark data source over annotated HDF5 matrices (.h5ad), read by ranges of rows.

`spark.dataSource.register(H5adSource)`, then `spark.read.format("h5ad").option("table", ...).load(path)`:

* `expression`: cell_id, gene, value of `X`, or of the layer that option `layer` names; zeros stay implicit
* `entries`: pos, gene, value, where pos is the cell's place; for matrices stored by column
* `cells`: pos, cell_id
* `points`: cell_id, x, y of `obsm/spatial`
* `rep`: cell_id, vec of the `obsm` entry that option `rep` names
* `obs`: cell_id, value as text of the `obs` column that option `column` names (categories included)

The driver reads shapes and every so-manieth row end only. Each task opens the file itself and yields
Arrow batches of its own range, of about `values` entries. The path must be the same on all machines.

Defined results: a null category is null; an empty matrix gives no rows; repeated names stay repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Entries of a range, unless option `values` says otherwise, and of one Arrow batch.
VALUES, BATCH = 4_000_000, 250_000

SCHEMAS = {
    "expression": "cell_id string, gene string, value double",
    "entries": "pos long, gene string, value double",
    "cells": "pos long, cell_id string",
    "points": "cell_id string, x double, y double",
    "rep": "cell_id string, vec array<double>",
    "obs": "cell_id string, value string",
}


def h5():
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .h5ad needs h5py on all machines; otherwise give the tables as Parquet") from e
    return h5py


def texts(values) -> list:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


def names(group, a: int | None = None, b: int | None = None) -> list:
    """The index of `obs` or `var`, from a to b."""
    return texts(group[group.attrs.get("_index", "_index")][a:b])


def matrix(f, layer: str | None):
    return f[f"layers/{layer}"] if layer else f["X"]


def layout(x) -> str:
    """csr, csc or dense."""
    if "indptr" not in (x.keys() if hasattr(x, "keys") else ()):
        return "dense"
    kind = x.attrs.get("encoding-type", x.attrs.get("h5sparse_format", "csr"))
    return "csc" if "csc" in (kind.decode() if isinstance(kind, bytes) else str(kind)) else "csr"


def sparse_ranges(ends, n: int, values: int) -> list[tuple[int, int]]:
    """Runs of whole rows of about `values` entries: row ends are read at every `step`-th row."""
    total = int(ends[n]) - int(ends[0]) if n else 0
    step = max(1, int(n * values / max(1, total) / 8))
    at = [*range(0, n, step), n] if n else [0]
    sums = np.asarray(ends[0 : n + 1 : step], np.int64).tolist()
    sums = sums if len(sums) == len(at) else [*sums, int(ends[n])]
    out, start = [], 0
    for i in range(1, len(at)):
        if i == len(at) - 1 or sums[i + 1] - sums[start] > values:
            out.append((at[start], at[i]))
            start = i
    return out


@dataclass
class Rows(InputPartition):
    start: int
    end: int


class H5adReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "expression")
        self.layer, self.rep, self.column = options.get("layer"), options.get("rep", "spatial"), options.get("column")
        self.values = int(options.get("values", VALUES))

    def partitions(self):
        with h5().File(self.path, "r") as f:
            n = f["obs"][f["obs"].attrs.get("_index", "_index")].shape[0]
            if self.table in ("expression", "entries"):
                x = matrix(f, self.layer)
                kind = layout(x)
                if kind == "csc" and self.table == "expression":
                    raise ValueError("the matrix is stored by column: read `entries` and join `cells`, as read_h5ad does")
                if kind != "dense":
                    ends = x["indptr"]
                    return [Rows(*r) for r in sparse_ranges(ends, ends.shape[0] - 1, self.values)]
                width = max(1, x.shape[1])
            else:
                width = f[f"obsm/{self.rep}"].shape[1] if self.table == "rep" else 2
        step = max(1, self.values // width)
        return [Rows(a, min(n, a + step)) for a in range(0, n, step)]

    def read(self, rows: Rows | None):
        if rows is None:  # Spark asks once if there are no ranges
            return
        with h5().File(self.path, "r") as f:
            a, b = rows.start, rows.end
            if self.table in ("expression", "entries"):
                yield from self._entries(f, a, b)
                return
            ids = names(f["obs"], a, b)
            if self.table == "cells":
                yield pa.record_batch({"pos": pa.array(np.arange(a, b)), "cell_id": pa.array(ids, pa.string())})
            elif self.table == "points":
                xy = np.asarray(f["obsm/spatial"][a:b], float)
                yield pa.record_batch({"cell_id": pa.array(ids, pa.string()), "x": pa.array(xy[:, 0]), "y": pa.array(xy[:, 1])})
            elif self.table == "rep":
                v = np.asarray(f[f"obsm/{self.rep}"][a:b], float)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.record_batch({"cell_id": pa.array(ids, pa.string()), "vec": flat})
            else:
                c = f[f"obs/{self.column}"]
                if hasattr(c, "keys"):
                    kinds = np.array([*texts(c["categories"][:]), None], object)
                    values = kinds[np.asarray(c["codes"][a:b], np.int64)].tolist()  # code -1 is null
                else:
                    values = texts(c[a:b])
                yield pa.record_batch({"cell_id": pa.array(ids, pa.string()), "value": pa.array(values, pa.string())})

    def _entries(self, f, a: int, b: int):
        x, genes = matrix(f, self.layer), np.array(names(f["var"]), object)
        kind = layout(x)
        if kind == "dense":
            step = max(1, BATCH // max(1, len(genes)))
            for s in range(a, b, step):
                part = np.asarray(x[s : min(b, s + step)], float)
                i, j = np.nonzero(part)
                yield self._batch(f, s, min(b, s + step), i + s, genes[j], part[i, j])
            return
        ends = np.asarray(x["indptr"][a : b + 1], np.int64)
        for s in range(int(ends[0]), int(ends[-1]), BATCH):
            e = min(int(ends[-1]), s + BATCH)
            major = a + np.searchsorted(ends, np.arange(s, e), "right") - 1
            minor, value = np.asarray(x["indices"][s:e], np.int64), np.asarray(x["data"][s:e], float)
            held = value != 0
            major, minor, value = major[held], minor[held], value[held]
            if not len(value):
                continue
            if kind == "csc":
                yield self._batch(f, 0, 0, minor, genes[major], value)
            else:
                yield self._batch(f, int(major[0]), int(major[-1]) + 1, major, genes[minor], value)

    def _batch(self, f, first: int, end: int, pos, gene, value):
        named = {"gene": pa.array(gene, pa.string()), "value": pa.array(value, pa.float64())}
        if self.table == "entries":
            return pa.record_batch({"pos": pa.array(pos, pa.int64())} | named)
        ids = np.array(names(f["obs"], first, end), object)
        return pa.record_batch({"cell_id": pa.array(ids[pos - first], pa.string())} | named)


class H5adSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "h5ad"

    def schema(self) -> str:
        table = self.options.get("table", "expression")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table!r}; there are {sorted(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> DataSourceReader:
        return H5adReader(dict(self.options))
