"""A Spark data source over folders of .npy arrays, or one .npz archive.

    spark.dataSource.register(NumpyStore)
    spark.read.format("numpy_store").option("part", "mean").load(folder)

Every task reads its own range of rows: files are mapped into memory, members of an
archive are read as a stream up to the end of the range.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REQUIRED = ("X_mean", "y_mean", "domain_mean", "example_index_mean")
ROWS_PER_BATCH = 1024


def array_names(folder: Path) -> list[str]:
    """Array names from the manifest, or all .npy files by name; each must exist."""
    described = folder / "manifest.json"
    if folder.suffix == ".npz":
        with zipfile.ZipFile(folder) as archive:
            names = [n.removesuffix(".npy") for n in archive.namelist()]
    elif described.exists():
        names = list(json.loads(described.read_text()).get("arrays", {}))
    else:
        names = [p.stem for p in sorted(folder.glob("*.npy"))]
    if not names:
        raise ValueError(f"{folder} holds no .npy file")
    for name in names:
        if folder.is_dir() and not (folder / f"{name}.npy").exists():
            raise FileNotFoundError(folder / f"{name}.npy")
    missing = sorted(set(REQUIRED) - set(names))
    if missing:
        raise KeyError(f"the store lacks the arrays {missing}")
    return names


class RowRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class NumpyStore(DataSource):
    """Options: part (mean or token), rows_per_partition."""

    @classmethod
    def name(cls) -> str:
        return "numpy_store"

    def schema(self) -> str:
        extra = ", token_position int" if self.options.get("part", "mean") == "token" else ""
        return f"example_id long, domain string, y int{extra}, x array<float>"

    def reader(self, schema) -> "NumpyReader":
        return NumpyReader(dict(self.options))


class NumpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = Path(options["path"].removeprefix("file:"))
        self.part = options.get("part", "mean")
        self.rows = int(options.get("rows_per_partition", 65_536))

    def _member(self, name: str) -> str:
        return f"{name}.npy" if name == "token_position" else f"{name}_{self.part}.npy"

    def _blocks(self, name: str, start: int, end: int) -> Iterator[np.ndarray]:
        """Rows start..end of one array, a batch at a time."""
        if self.folder.is_dir():
            whole = np.load(self.folder / self._member(name), allow_pickle=False, mmap_mode="r")
            for at in range(start, end, ROWS_PER_BATCH):
                yield np.asarray(whole[at:min(at + ROWS_PER_BATCH, end)])
            return
        with zipfile.ZipFile(self.folder) as archive, archive.open(self._member(name)) as stream:
            shape, dtype = _read_header(stream)
            row_bytes = dtype.itemsize * int(np.prod(shape[1:]))
            stream.seek(start * row_bytes, 1)
            for at in range(start, end, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, end - at)
                yield np.frombuffer(stream.read(n * row_bytes), dtype=dtype).reshape(n, *shape[1:])

    def _length(self) -> int:
        if self.folder.is_dir():
            return len(np.load(self.folder / self._member("example_index"), allow_pickle=False, mmap_mode="r"))
        with zipfile.ZipFile(self.folder) as archive, archive.open(self._member("example_index")) as stream:
            return _read_header(stream)[0][0]

    def partitions(self) -> list[RowRange]:
        array_names(self.folder)
        n = self._length()
        return [RowRange(s, min(s + self.rows, n)) for s in range(0, max(n, 1), self.rows)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        wanted = ["X", "y", "domain", "example_index"] + (["token_position"] if self.part == "token" else [])
        for x, y, domain, ids, *position in zip(
                *(self._blocks(n, partition.start, partition.end) for n in wanted), strict=True):
            block = np.asarray(x, dtype=np.float32)
            offsets = np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]
            columns = [pa.array(ids.astype(np.int64)), pa.array([str(d) for d in domain]),
                       pa.array(y.astype(np.int32))]
            names = ["example_id", "domain", "y"]
            if position:
                columns.append(pa.array(position[0].astype(np.int32)))
                names.append("token_position")
            columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(block.ravel())))
            yield pa.RecordBatch.from_arrays(columns, names + ["x"])


def _read_header(stream) -> tuple[tuple[int, ...], np.dtype]:
    """Shape and type of a .npy member; the stream is left at its first row."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(stream)
    if by_column or dtype.hasobject:
        raise ValueError("arrays must be stored by row and without Python objects")
    return shape, dtype
