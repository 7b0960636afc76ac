"""Folders of any store that the session reads, and the working folder of intermediate cubes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import OutOfRange, need

#: A working folder is deleted only if it holds this file.
MARK = "_made_by_this_engine"


class Folder:
    """A path of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, *below: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return place, place.getFileSystem(self._conf)

    def exists(self, *below: str) -> bool:
        place, store = self._at(*below)
        return store.exists(place)

    def touch(self, name: str) -> None:
        place, store = self._at(name)
        store.create(place, True).close()

    def delete(self) -> None:
        place, store = self._at()
        store.delete(place, True)

    def copy(self, target: str) -> None:
        """Copies the folder to a path that does not exist yet."""
        place, store = self._at()
        there, other = Folder(self.spark, target)._at()
        other.mkdirs(there.getParent())
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(store, place, other, there, False, self._conf)


class Workspace:
    """A shared folder for intermediate cubes, removed as a whole when they are no longer read.

    By default it lies in the folder that ``spark.checkpoint.dir`` names, which
    driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        if path is None:
            shared = spark.conf.get("spark.checkpoint.dir", None)
            need(bool(shared), OutOfRange, "name a folder, or set spark.checkpoint.dir")
            path = f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"
        self.folder = Folder(spark, path)
        taken = self.folder.exists() and not self.folder.exists(MARK)
        need(not taken, OutOfRange, f"{path} holds other files")
        self.folder.touch(MARK)

    def path(self, name: str) -> str:
        """A new path for something called ``name``."""
        return f"{self.folder.path}/{name}-{uuid.uuid4().hex}"

    def destroy(self) -> None:
        """Deletes the folder, which must be one that a workspace made."""
        need(self.folder.exists(MARK), OutOfRange, f"{self.folder.path} is no working folder")
        self.folder.delete()

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.destroy()
