"""Parquet datasets: reading, existence, newest partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

NO_DATA_FILES = "UNABLE_TO_INFER_SCHEMA"


def read_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def find_dataset(spark: SparkSession, path: str) -> DataFrame | None:
    """The dataset, or None if the folder is missing or holds no Parquet.

    Other failures (permissions, network) are raised: taking them for "missing"
    would let a full load overwrite good data.
    """
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == NO_DATA_FILES:
            return None
        raise


def dataset_exists(spark: SparkSession, path: str) -> bool:
    return find_dataset(spark, path) is not None


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether the folder holds data, found without listing all of it."""
    if newest_partitions(spark, path, ("year", "month", "day"), 1):
        return True
    return dataset_exists(spark, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if there is none."""
    file, fs = _folder(spark, path)
    if not fs.exists(file):
        return None
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file: written beside it, then renamed."""
    file, fs = _folder(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(file, False)
    if not fs.rename(draft, file):
        raise OSError(f"cannot write {path}")


def folder_exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)


def move_folder(spark: SparkSession, path: str, target: str) -> None:
    """Put a folder in the place of another; nothing if there is none (any more)."""
    folder, fs = _folder(spark, path)
    if not fs.exists(folder):
        return
    place, _ = _folder(spark, target)
    fs.delete(place, True)
    fs.mkdirs(place.getParent())
    if not fs.rename(folder, place):
        raise OSError(f"cannot move {path} to {target}")


def _folder(spark: SparkSession, path: str):
    """Hadoop path and file system of ``path``."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def newest_partitions(
    spark: SparkSession, path: str, columns: tuple[str, ...], limit: int
) -> list[str]:
    """Newest ``limit`` leaf folders of integer partitions, newest first.

    Lists one folder per level instead of every file of the dataset.
    """
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return []

    def descend(folder, remaining: tuple[str, ...]) -> Iterator[str]:
        entries = list(fs.listStatus(folder))
        if not remaining:
            if any(e.isFile() and not e.getPath().getName().startswith(("_", ".")) for e in entries):
                yield folder.toString()
            return
        prefix = f"{remaining[0]}="
        found = []
        for entry in entries:
            name = entry.getPath().getName()
            if entry.isDirectory() and name.startswith(prefix) and name[len(prefix):].isdigit():
                found.append((int(name[len(prefix):]), entry.getPath()))
        for _, child in sorted(found, key=lambda pair: pair[0], reverse=True):
            yield from descend(child, remaining[1:])

    leaves = []
    for leaf in descend(root, tuple(columns)):
        leaves.append(leaf)
        if len(leaves) == limit:
            break
    return leaves
