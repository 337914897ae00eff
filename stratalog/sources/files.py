"""Files of a log through Hadoop's file systems: local folders, HDFS, object stores alike."""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid

from pyspark.sql import SparkSession

from ..errors import IoError, LockedError, ManifestError


#: File systems whose renames are atomic; elsewhere (object stores) a file appears when it is closed.
RENAMES = ("file", "hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")
#: Seconds after which the lock of a writer that doesn't renew it counts as left behind (off local disks).
LEASE = 600


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._lock: object = None
        self.owner, self.renewed = uuid.uuid4().hex, 0.0

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def local(self) -> str | None:
        """The folder's name on this machine, if the log is in the local file system."""
        uri = self._path("").toUri()
        return uri.getPath() if self.fs.getScheme() == "file" else None

    def mkdirs(self, name: str = "") -> None:
        if not self.fs.mkdirs(self._path(name)):
            raise IoError(f"can't make {self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def bytes_of(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def write_new(self, name: str, value: object) -> None:
        """Writes JSON under a name that must not exist; appears whole or not at all (written aside, then renamed; on object
        stores created on condition that it isn't there)."""
        if self.exists(name):
            raise ManifestError(f"{name} exists: another writer?")
        if self.fs.getScheme() not in RENAMES:
            self._write(name, value, False)
            return
        aside = f"{name}.tmp"
        self._write(aside, value, True)
        if not self.fs.rename(self._path(aside), self._path(name)):
            raise IoError(f"can't rename {aside}")

    def _write(self, name: str, value: object, overwrite: bool) -> None:
        out = self.fs.create(self._path(name), overwrite)
        try:
            out.write(bytearray(json.dumps(value).encode()))
            if self.fs.getScheme() in RENAMES:
                out.hsync()
        finally:
            out.close()

    def read(self, name: str) -> object:
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError as e:
            raise ManifestError(f"{name}: {e}") from None
        finally:
            stream.close()

    def lock(self) -> None:
        """One writer a log: an OS lock on a local folder (gone with its process); else a file that only one can create, and
        that must be renewed: one whose lease has run out was left by a writer that died, and is taken over."""
        if folder := self.local():
            handle = open(os.path.join(folder, "LOCK"), "a+")  # noqa: SIM115
            try:
                fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                handle.close()
                raise LockedError(f"{self.root} is open in another writer") from None
            self._lock = handle
            return
        if self.exists("LOCK"):
            held = self._holder()
            if held is None or held["until"] > time.time():
                raise LockedError(f"{self.root} is open in another writer")
            self.delete("LOCK")
        try:
            self._write("LOCK", {"owner": self.owner, "until": time.time() + LEASE}, False)
        except Exception as e:
            raise LockedError(f"{self.root} is open in another writer") from e
        if (self._holder() or {}).get("owner") != self.owner:
            raise LockedError(f"{self.root} is open in another writer")
        self.renewed = time.time()

    def _holder(self) -> dict | None:
        try:
            return self.read("LOCK")
        except Exception:  # it is being written
            return None

    def renew(self) -> None:
        """Before something is published: the lock must still be this writer's; it is renewed after a third of its lease."""
        if self.local() is not None or time.time() - self.renewed < LEASE / 3:
            return
        if (self._holder() or {}).get("owner") != self.owner:
            raise LockedError(f"{self.root} was taken over by another writer")
        self._write("LOCK", {"owner": self.owner, "until": time.time() + LEASE}, True)
        self.renewed = time.time()

    def unlock(self) -> None:
        if self._lock is not None:
            self._lock.close()
            self._lock = None
        elif self.local() is None and (self._holder() or {}).get("owner") == self.owner:
            self.delete("LOCK")
