"""Numbers and turns that concurrent writers must not share.

Both rest on one thing: a small file comes into being once. On a local (or
mounted) folder that is a hard link, elsewhere a rename to a name that must be
free, which HDFS does atomically. Only the driver makes such files.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

LEASE = 600.0  # seconds after which a turn that was never given back is over


class Claims:
    """Claims under one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _local(self, path: str) -> str | None:
        uri = self._fs.makeQualified(self._path(path)).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def create_once(self, path: str, text: str = "") -> bool:
        """Makes the file with this text; False if it is there already."""
        parent, name = path.rsplit("/", 1)
        self._fs.mkdirs(self._path(parent))
        trial = f"{parent}/.{name}.{uuid.uuid4().hex}"
        local = self._local(trial)
        if local is not None:
            with open(local, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(local, self._local(path))
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(local)
        out = self._fs.create(self._path(trial), False)
        out.write(text.encode())
        out.close()
        made = self._fs.rename(self._path(trial), self._path(path))
        if not made:
            self._fs.delete(self._path(trial), False)
        return made

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if it is not there."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(x for x in (s.getPath().getName() for s in self._fs.listStatus(path)) if not x.startswith("."))

    def text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def take(self, name: str, least: int, count: int = 1) -> int:
        """The first of ``count`` numbers that nobody else gets, at ``least``
        or above, right behind those taken so far."""
        folder = f"{self.root}/{name}"
        while True:
            taken = self.names(folder)
            first = least
            if taken:
                first = max(least, int(taken[-1]) + int(self.text(f"{folder}/{taken[-1]}")))
            if self.create_once(f"{folder}/{first:018d}", str(count)):
                return first

    def forget(self, name: str) -> None:
        """Numbers start again."""
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    @contextmanager
    def turn(self, name: str, lease: float = LEASE) -> Iterator[None]:
        """One writer at a time. A turn that is not given back within
        ``lease`` seconds is taken over."""
        path, mine, wait = f"{self.root}/turns/{name}", uuid.uuid4().hex, 0.02
        while not self.create_once(path, mine):
            try:
                age = time.time() - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000
                if age > lease:
                    old = f"{self.root}/turns/.{name}.{uuid.uuid4().hex}"
                    if self._fs.rename(self._path(path), self._path(old)):
                        self._fs.delete(self._path(old), False)
            except Exception as e:  # given back meanwhile
                if "FileNotFound" not in str(e):
                    raise
            time.sleep(wait)
            wait = min(1.0, wait * 1.5)
        try:
            yield
        finally:
            if mine == (self.text(path) if self._fs.exists(self._path(path)) else ""):
                self._fs.delete(self._path(path), False)
