"""Small files of the commit log, on any file system that Spark can open."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession

from strata.errors import CommitConflict, Internal, NotFound


def open_store(spark: SparkSession, root: str) -> LocalStore | HadoopStore:
    parsed = urlparse(root)
    if parsed.scheme in ("", "file"):
        return LocalStore(unquote(parsed.path) if parsed.scheme else os.path.abspath(root))
    return HadoopStore(spark, root)


class LocalStore:
    """Local and mounted folders; a file appears whole or not at all, and once."""

    def __init__(self, root: str):
        self.root = root

    def uri(self, path: str) -> str:
        return f"file://{self.root}/{path}"

    def _at(self, path: str) -> str:
        return f"{self.root}/{path}"

    def list(self, path: str) -> list[str]:
        try:
            return sorted(os.listdir(self._at(path)))
        except FileNotFoundError:
            return []

    def exists(self, path: str) -> bool:
        return os.path.exists(self._at(path))

    def read(self, path: str) -> bytes:
        try:
            with open(self._at(path), "rb") as f:
                return f.read()
        except FileNotFoundError:
            raise NotFound(path) from None

    def create(self, path: str, data: bytes) -> None:
        """Fails if the file exists."""
        at = self._at(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        temporary = f"{at}.{uuid.uuid4().hex}.tmp"
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(temporary, at)
        except FileExistsError:
            raise CommitConflict(path) from None
        finally:
            os.unlink(temporary)

    def rename(self, old: str, new: str) -> None:
        os.makedirs(os.path.dirname(self._at(new)), exist_ok=True)
        os.rename(self._at(old), self._at(new))

    def delete(self, path: str) -> None:
        import shutil

        at = self._at(path)
        if os.path.isdir(at):
            shutil.rmtree(at, ignore_errors=True)
        elif os.path.exists(at):
            os.unlink(at)
            checksum = f"{os.path.dirname(at)}/.{os.path.basename(at)}.crc"
            if os.path.exists(checksum):
                os.unlink(checksum)

    def walk(self, path: str) -> list[tuple[str, float]]:
        """Files below, with their modification times in seconds."""
        top = self._at(path)
        return sorted((os.path.relpath(f"{d}/{f}", self.root), os.path.getmtime(f"{d}/{f}")) for d, _, names in os.walk(top) for f in names)


class HadoopStore:
    """By Spark's Hadoop client; its file system must rename without overwriting in one step (HDFS and the like)."""

    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self.jvm, self.root, configuration = sc._jvm, root.rstrip("/"), sc._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(configuration)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), configuration)
        self.keep = sc._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def uri(self, path: str) -> str:
        return f"{self.root}/{path}"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def list(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def read(self, path: str) -> bytes:
        at = self._path(path)
        if not self.fs.exists(at):
            raise NotFound(path)
        stream = self.fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """Fails if the file exists. It is written under another name, so it appears whole or not at all."""
        at = self._path(path)
        if self.fs.exists(at):
            raise CommitConflict(path)
        temporary = self._path(f"{path}.{uuid.uuid4().hex}.tmp")
        try:
            stream = self.fs.create(temporary, False)
            stream.write(data)
            stream.close()
            try:
                self.context.rename(temporary, at, self.keep)
            except Exception as e:
                if self.fs.exists(at):
                    raise CommitConflict(path) from e
                raise
        finally:
            if self.fs.exists(temporary):
                self.fs.delete(temporary, False)

    def rename(self, old: str, new: str) -> None:
        target = self._path(new)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self._path(old), target):
            raise Internal(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)

    def walk(self, path: str) -> list[tuple[str, float]]:
        at, out = self._path(path), []
        if self.fs.exists(at):
            found = self.fs.listFiles(at, True)
            base = self.fs.makeQualified(self._path("")).toString().rstrip("/") + "/"
            while found.hasNext():
                s = found.next()
                out.append((s.getPath().toString().removeprefix(base), s.getModificationTime() / 1000))
        return sorted(out)
