"""Matrices in .npy files, read and written row range by row range.

Tasks seek to the rows they are asked for, so no file passes through one process whole, and
rows that nobody asks for are not read. Files are opened with Arrow's file systems (local
paths, hdfs, viewfs, s3 and gs addresses), as Spark's own readers take no byte ranges of
binary files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types of files, and what Spark calls them.
TYPES = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "bigint"}
#: Bytes of rows read at once, and rows of a written file.
BLOCK, FILE_ROWS = 8 << 20, 65_536


def _located(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def _header(f) -> tuple[int, int, np.dtype, int]:
    """Rows, width, element type and first byte of the data of an open file."""
    version = np.lib.format.read_magic(f)
    if version not in ((1, 0), (2, 0)):
        raise ValueError(f"unknown version of the matrix format: {version}")
    shape, turned, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if len(shape) != 2 or (turned and min(shape) > 1) or dtype.str not in TYPES:
        raise ValueError(f"not a matrix of {', '.join(TYPES)} stored by rows: {shape}, {dtype.str}")
    return shape[0], shape[1], dtype, f.tell()


def _fetched(places: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, vector) of places (key, file, row), whose partitions are sorted by file and row: neighbouring rows are one read of at most BLOCK bytes."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = opened = None
        try:
            for b in batches:
                files, rows = b.column(1).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
                first = 0
                while first < len(rows):
                    if files[first] != path:
                        if opened:
                            opened.close()
                        path = files[first]
                        store, name = _located(path)
                        opened = store.open_input_file(name)
                        n, width, dtype, start = _header(opened)
                    size = width * dtype.itemsize
                    end, most = first + 1, max(1, BLOCK // max(1, size))
                    while end < len(rows) and end - first < most and files[end] == path and rows[end] == rows[end - 1] + 1:
                        end += 1
                    if not 0 <= rows[first] <= rows[end - 1] < n:
                        raise ValueError(f"{path} has {n} rows, not row {rows[end - 1]}")
                    opened.seek(start + int(rows[first]) * size)
                    data = np.frombuffer(opened.read((end - first) * size), dtype)
                    offsets = pa.array(np.arange(end - first + 1) * width, pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.ListArray.from_arrays(offsets, pa.array(data))], names=[key, "vector"])
                    first = end
        finally:
            if opened:
                opened.close()

    return places.select(key, "file", "row").mapInArrow(fetch, f"`{key}` {dict(places.dtypes)[key]}, vector array<{kind}>")


def read_matrix(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """(row, vector) of one .npy file, rows counted from 0; only those of `rows` (a column row), if given.

    Repeated rows are returned once; nulls and rows that the file lacks are not returned.
    The driver reads the header only.
    """
    store, name = _located(path)
    with store.open_input_file(name) as f:
        n, width, dtype, _ = _header(f)
    if rows is None:
        tasks = max(1, -(-n * width * dtype.itemsize // (8 * BLOCK)))
        wanted = spark.range(0, n, 1, tasks).withColumnRenamed("id", "row")
    else:
        wanted = rows.select(F.col("row").cast("long")).where((F.col("row") >= 0) & (F.col("row") < n)).distinct().repartitionByRange("row").sortWithinPartitions("row")
    return _fetched(wanted.select(F.col("row").alias("key"), F.lit(path).alias("file"), "row"), "key", TYPES[dtype.str]).withColumnRenamed("key", "row")


def write_matrix(df: DataFrame, path: str, ident: str, vector: str) -> None:
    """Vectors (arrays of one width, without nulls) as .npy files in order of `ident`, beside `ids`, the place (file, row) of each, and a JSON manifest of files.

    A task holds one file of at most FILE_ROWS rows at a time. A file appears under its name
    when it is whole, so a task that is run again replaces its own files with the same rows.
    """
    names = {kind: dtype for dtype, kind in TYPES.items()}
    kind = dict(df.dtypes)[vector].removeprefix("array<").removesuffix(">")
    if kind not in names:
        raise ValueError(f"{vector} is no array of {', '.join(names)}")
    dtype, most = np.dtype(names[kind]), FILE_ROWS

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        store, folder = _located(path)
        store.create_dir(f"{folder}/data", recursive=True)
        kept: list[pa.RecordBatch] = []
        files = 0

        def flush() -> pa.RecordBatch:
            nonlocal files, kept
            table = pa.Table.from_batches(kept)
            lists = table.column(1).combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
            widths = np.diff(lists.offsets.to_numpy())
            if lists.null_count or len(set(widths.tolist())) > 1 or lists.flatten().null_count:
                raise ValueError("vectors are null, hold nulls or differ in width")
            matrix = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(lists), int(widths[0]))
            name = f"part-{TaskContext.get().partitionId():05d}-{files:05d}.npy"
            part = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(part) as out:
                np.lib.format.write_array_header_1_0(out, {"descr": dtype.str, "fortran_order": False, "shape": matrix.shape})
                out.write(matrix.tobytes())
            store.move(part, f"{folder}/data/{name}")
            files, kept = files + 1, []
            ids = table.column(0).combine_chunks()
            n = len(lists)
            return pa.RecordBatch.from_arrays([ids if isinstance(ids, pa.Array) else ids.chunk(0), pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(np.full(n, widths[0]), pa.int32())], names=[ident, "file", "row", "width"])

        held = 0
        for b in batches:
            while b.num_rows:
                own = b.slice(0, most - held)
                kept.append(own)
                held, b = held + own.num_rows, b.slice(own.num_rows)
                if held == most:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    ordered = df.select(ident, vector).repartitionByRange(ident).sortWithinPartitions(ident)
    ordered.mapInArrow(save, f"`{ident}` {dict(df.dtypes)[ident]}, file string, row long, width int").write.parquet(f"{path}/ids")
    ids = df.sparkSession.read.parquet(f"{path}/ids")
    ids.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.max("width").alias("width"), F.lit(dtype.str).alias("dtype")).coalesce(1).write.json(f"{path}/manifest")


def read_saved(spark: SparkSession, path: str, ident: str, wanted: DataFrame | None = None) -> DataFrame:
    """(ident, vector) of what `write_matrix` wrote; only the idents of `wanted`, if given, and then only their bytes are read."""
    ids = spark.read.parquet(f"{path}/ids")
    kinds = spark.read.schema("dtype string").json(f"{path}/manifest").limit(1).collect()
    if wanted is not None:
        ids = ids.join(wanted.select(ident).distinct(), ident, "left_semi")
    places = ids.select(ident, F.concat(F.lit(f"{path}/data/"), "file").alias("file"), "row").repartitionByRange("file", "row").sortWithinPartitions("file", "row")
    return _fetched(places, ident, TYPES[kinds[0].dtype] if kinds else "float")
