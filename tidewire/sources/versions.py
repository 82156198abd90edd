"""Tables that are replaced as a whole, on any store: versioned folders and a small pointer.

A table is a folder with data folders ``v-…`` and pointers ``_pointer.N``, files of one line that name
one of them. A write fills a new data folder first and then makes the next pointer, which either is there in full or
isn't; nothing is renamed. Readers follow the newest complete pointer, so wherever a write stops they find the
old table or the new one, whole. The version before the newest is kept for readers that are under way.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = re.compile(r"^_pointer\.(\d+)$")
KEPT = 2    # versions that stay


class _Folder:
    """The few file operations needed, on whatever store the path lies."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        context = spark.sparkContext
        self.jvm, self.path = context._jvm, path.rstrip("/")
        self._path = self.jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        root = self._path(self.path)
        if not self.files.exists(root) or not self.files.getFileStatus(root).isDirectory():
            return []
        return [s.getPath().getName() for s in self.files.listStatus(root)]

    def read(self, name: str) -> str:
        stream = self.files.open(self.at(name))
        try:
            return bytes(stream.readNBytes(1024)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there, as when another write took the same number."""
        stream = self.files.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def pointers(self) -> list[tuple[int, str]]:
        """(number, version) of the complete pointers, newest first."""
        numbers = sorted((int(m[1]) for m in map(POINTER.match, self.names()) if m), reverse=True)
        found = ((n, self.read(f"_pointer.{n}")) for n in numbers)
        return [(n, text[:-1]) for n, text in found if text.startswith("v-") and text.endswith("\n")]


def current_folder(spark: SparkSession, path: str) -> str:
    """Where the data of a table lies: the version its pointer names, or ``path`` for a plain folder."""
    if any(c in path for c in "*?[{"):
        return path
    pointers = _Folder(spark, path).pointers()
    return f"{path.rstrip('/')}/{pointers[0][1]}" if pointers else path


def write_versioned(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options: object
) -> str:
    """Replace the table at ``path`` by ``df`` and give back the new version's folder.

    ``df`` may be read from the table itself. Of two writes at once one fails and leaves its data folder, which
    nothing points to.
    """
    folder = _Folder(df.sparkSession, path)
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(f"{folder.path}/{version}")
    pointers = folder.pointers()
    taken = [int(m[1]) for m in map(POINTER.match, folder.names()) if m]
    folder.create(f"_pointer.{max(taken, default=0) + 1}", f"{version}\n")
    _remove_old(folder, pointers)
    return f"{folder.path}/{version}"


def _remove_old(folder: _Folder, before: list[tuple[int, str]]) -> None:
    """Pointers and data older than the kept ones; what came in since ``before`` was listed stays."""
    for number, version in before[KEPT - 1:]:
        folder.files.delete(folder.at(f"_pointer.{number}"), False)
        folder.files.delete(folder.at(version), True)
