"""Versioned folders: what belongs to a store is named by a manifest, and a change is one new manifest.

Files are written under fresh names first; readers see them only once a manifest names them, so a job that dies in between leaves the
version before it as it was. A manifest is written aside and renamed to the next free number; of two writers that start from
one version the second fails and can begin again from the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Versions:
    """The manifests of a store under a folder that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self._conf)

    def latest(self) -> int:
        """The number of the newest version; 0 if there is none."""
        folder = self._path("_versions")
        if not self._files().exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files().listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, number: int | None = None) -> dict:
        """The manifest of a version (the newest one), {} if there is none."""
        number = self.latest() if number is None else number
        if not number:
            return {}
        stream = self._files().open(self._path(f"_versions/{number:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, manifest: dict, after: int) -> int:
        """Make manifest the version that follows after; Conflict if that one exists already."""
        aside = self._path(f"_versions/.{uuid.uuid4().hex}")
        stream = self._files().create(aside)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        files = self._files()
        target = files.makeQualified(self._path(f"_versions/{after + 1:012d}.json"))
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(files.makeQualified(aside), target, options)
        except Exception as e:
            files.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {after + 1} of {self.root} exists") from e
            raise
        return after + 1

    def fresh(self, name: str) -> str:
        """A path under the store that nothing uses yet."""
        return f"{self.root}/{name}-{uuid.uuid4().hex}"

    def drop_unnamed(self, keep: int = 2) -> None:
        """Delete old manifests but the last keep, and the top folders that none of these names."""
        newest, files = self.latest(), self._files()
        named = " ".join(json.dumps(self.read(n)) for n in range(max(1, newest - keep + 1), newest + 1))
        for s in files.listStatus(self._path("")):
            name = s.getPath().getName()
            if name != "_versions" and name not in named:
                files.delete(s.getPath(), True)
        for n in range(1, newest - keep + 1):
            files.delete(self._path(f"_versions/{n:012d}.json"), False)
