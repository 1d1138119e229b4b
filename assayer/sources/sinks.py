"""Writers of results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The columns in order; arrays, maps and structs as JSON text, for formats without them."""
    names = list(columns or rows.columns)
    kinds = dict(rows.dtypes)
    return rows.select(*(F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in names))


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task's file: its objects with the array's brackets and commas, batch by batch."""
    begun = False
    for batch in batches:
        lines = [f"{',' if begun or i else '['}{x}" for i, x in enumerate(batch.column("value").to_pylist())]
        if lines:
            begun = True
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(["]"], pa.string())], names=["value"])


def write(rows: DataFrame, path: str, kind: str = "parquet", columns: Sequence[str] | None = None, mode: str = "error") -> None:
    """parquet, json (one object a line), json_array (each file one array of objects) or csv (header, fixed columns)."""
    if kind == "json_array":
        own = rows.select(F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
        own.mapInArrow(_as_arrays, "value string").write.mode(mode).text(path)
    elif kind == "csv":
        flat(rows, columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        (rows.select(*columns) if columns else rows).write.mode(mode).format(kind).save(path)


def write_judged(rows: DataFrame, path: str) -> None:
    """Judged rows by judge and prompt version; only the partitions at hand are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("judge_model", "prompt_version").parquet(path)


#: What a stored judgement is found by: a source whose content has changed has another digest, and is judged again.
REQUEST = ("judge_model", "prompt_version", "source_file", "source_sha256")


def store_judged(rows: DataFrame, table: str, path: str | None = None, buckets: int = 64, key: Sequence[str] = REQUEST) -> None:
    """Appends judged rows to a table in buckets by request, which later runs join without shuffling it. path: where the table's files are kept."""
    writer = rows.write.mode("append").format("parquet").bucketBy(buckets, *key).sortBy(*key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def write_named(rows: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """A file for each row, by its name under the folder (which may hold further folders), and how many there are. A rerun task writes the same files."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for own, text in zip(names, batch.column("content").to_pylist(), strict=True):
                path = f"{base}/{own}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                temporary = f"{path}.{uuid.uuid4().hex}"
                with system.open_output_stream(temporary, compression=None) as out:
                    out.write((text or "").encode())
                system.move(temporary, path)
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], names=["n"])

    done = rows.select(F.col(name).alias("name"), F.col(content).alias("content")).mapInArrow(save, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
