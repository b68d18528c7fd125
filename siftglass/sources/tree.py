"""File trees as a Spark source, and safe writing back to them.

Spark's own binary source leaves out names that begin with a dot or an underscore; this one lists a tree
by its own rules.  It reads folders that every machine sees at the same path.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from siftglass.operators.artifacts import MAX_BYTES

# Folders that are never walked.
SKIPPED = frozenset(
    (
        ".git", ".hg", ".svn", "node_modules", ".gradle", "build", "out", "dist", ".venv", "venv", "__pycache__",
        ".mypy_cache", ".pytest_cache", ".idea", "DerivedData", ".build",
    )
)
SCHEMA = "path string, size_bytes long, data binary, error string"
#: Files of one partition, and bytes after which one is full.
PART_FILES, PART_BYTES = 1000, 64 << 20


def walk(root: str, follow_links: bool = False) -> Iterator[str]:
    """The regular files below a folder (or the file itself); unreadable folders and links are passed over."""
    if os.path.isfile(root):
        yield root
        return
    for folder, folders, files in os.walk(root, followlinks=follow_links):
        folders[:] = [f for f in folders if f not in SKIPPED]
        for name in files:
            path = os.path.join(folder, name)
            if os.path.isfile(path) and (follow_links or not os.path.islink(path)):
                yield path


class Files(InputPartition):
    """Some paths."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, roots: list[str], most: int) -> None:
        self.roots, self.most = roots, most

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        some: list[str] = []
        held = 0
        for path in sorted(p for r in self.roots for p in walk(r)):
            some.append(path)
            held += min(self.most, _size(path) or 0)
            if len(some) >= PART_FILES or held >= PART_BYTES:
                out.append(Files(some))
                some, held = [], 0
        return [*out, Files(some)] if some or not out else out

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int | None, bytes | None, str | None]]:
        assert isinstance(partition, Files)
        for path in partition.paths:
            size = _size(path)
            if size is None:
                yield path, None, None, f"cannot stat {path}"
            elif size > self.most:
                yield path, size, None, f"{path} is {size} bytes, above the {self.most} byte limit"
            else:
                try:
                    with open(path, "rb") as f:
                        yield path, size, f.read(), None
                except OSError as problem:
                    yield path, size, None, f"cannot read {path}: {problem}"


def _size(path: str) -> int | None:
    try:
        return os.stat(path).st_size
    except OSError:
        return None


class ArtifactTree(DataSource):
    """``spark.read.format("artifact_tree").option("max_bytes", n).load(path)``; several paths parted by line feeds."""

    @classmethod
    def name(cls) -> str:
        return "artifact_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].split("\n"), int(self.options.get("max_bytes", MAX_BYTES)))


def read_tree(spark: SparkSession, paths: list[str], max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, size_bytes, data, error`` of all files below some paths, without removing repetitions."""
    if missing := [p for p in paths if not os.path.exists(p)]:
        raise FileNotFoundError(f"no such path: {missing[0]}")
    spark.dataSource.register(ArtifactTree)
    return spark.read.format("artifact_tree").option("max_bytes", str(max_bytes)).load("\n".join(paths))


class UnsafeWrite(Exception):
    """A file that must not be written."""


def safe_write(path: str, data: bytes, backup: bool = False) -> None:
    """Replace a file in one step: never through a link, never into a missing folder, with a copy if wanted."""
    folder = os.path.dirname(os.path.abspath(path))
    if os.path.islink(path):
        raise UnsafeWrite(f"refusing to write through a symlink: {path}")
    if not os.path.isdir(folder):
        raise UnsafeWrite(f"no such folder: {folder}")
    if backup and os.path.exists(path):
        with open(path, "rb") as old:
            safe_write(f"{path}.bak", old.read())
    handle, draft = tempfile.mkstemp(prefix=".draft-", dir=folder)
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(path):
            os.chmod(draft, os.stat(path).st_mode & 0o777)
        os.replace(draft, path)
    except BaseException:
        if os.path.exists(draft):
            os.unlink(draft)
        raise


def write_back(outputs: DataFrame, backup: bool = False) -> DataFrame:
    """Write accepted outputs that differ to their paths (``path, data, output, accepted``): ``path, error`` of what failed.

    Each file is replaced as a whole, so a task that runs again writes the same bytes again.
    """

    def write(frames: Iterator) -> Iterator:  # type: ignore[type-arg]
        for frame in frames:
            errors = []
            for path, data in zip(frame["path"], frame["output"], strict=True):
                try:
                    safe_write(path, data, backup)
                    errors.append(None)
                except (UnsafeWrite, OSError) as problem:
                    errors.append(str(problem))
            frame["error"] = errors
            yield frame[frame["error"].notna()][["path", "error"]]

    return outputs.where("accepted AND output <> data").select("path", "output").mapInPandas(write, "path string, error string")
