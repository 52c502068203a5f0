"""Small files with an atomic put-if-absent, on a local folder or any Hadoop file system."""

from __future__ import annotations

import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import LogError


class LocalStore:
    """A folder: a file is written aside, then linked under its name, which fails if that exists."""

    def __init__(self, root: str):
        self.root = root

    def put_if_absent(self, name: str, data: bytes) -> bool:
        path = f"{self.root}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(aside, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)

    def put(self, name: str, data: bytes) -> None:
        """Replaces what is there."""
        path = f"{self.root}/{name}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        aside = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(aside, "wb") as f:
            f.write(data)
        os.replace(aside, path)

    def get(self, name: str) -> bytes | None:
        try:
            with open(f"{self.root}/{name}", "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def names(self, folder: str) -> list[str]:
        try:
            return sorted(n for n in os.listdir(f"{self.root}/{folder}") if not n.startswith("."))
        except FileNotFoundError:
            return []

    def size(self, name: str) -> int:
        path = f"{self.root}/{name}"
        if os.path.isfile(path):
            return os.path.getsize(path)
        return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(path) for f in files)

    def delete(self, name: str) -> bool:
        path = f"{self.root}/{name}"
        if not os.path.exists(path):
            return False
        shutil.rmtree(path) if os.path.isdir(path) else os.unlink(path)
        return True


class HadoopStore:
    """The same over Hadoop's FileContext, whose rename without overwriting is atomic on HDFS. Stores
    without such a rename fail verify_store and must not be used."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def put_if_absent(self, name: str, data: bytes) -> bool:
        path = self._path(name)
        self.fs.mkdirs(path.getParent())
        aside = self.jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(data))
        out.close()
        try:
            none = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            options[0] = none
            self.context.rename(aside, path, options)
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(aside, False)

    def put(self, name: str, data: bytes) -> None:
        """Replaces what is there. The name exists throughout; its content may be read half written."""
        out = self.fs.create(self._path(name), True)
        out.write(bytearray(data))
        out.close()

    def get(self, name: str) -> bytes | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return sorted(n for s in self.fs.listStatus(path) if not (n := s.getPath().getName()).startswith("."))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)


class S3Store(HadoopStore):
    """The same over S3, where a rename isn't atomic but a put may be conditional: the object is created
    only if there is none. A file system that doesn't know the condition refuses it, so this fails closed."""

    CONDITION = "fs.option.create.conditional.overwrite"

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root, spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def put_if_absent(self, name: str, data: bytes) -> bool:
        try:
            out = self.fs.createFile(self._path(name)).overwrite(False).recursive().must(self.CONDITION, True).build()
            out.write(bytearray(data))
            out.close()
            return True
        except Py4JJavaError as e:
            # the condition is checked when the object is completed; a lost race is one of these
            said = f"{e.java_exception.getClass().getName()} {e.java_exception.getMessage()}"
            if "FileAlreadyExists" in said or "RemoteFileChanged" in said or "PreconditionFailed" in said or "412" in said:
                return False
            raise


def open_store(spark: SparkSession, root: str):
    url = urlparse(root)
    if url.scheme in ("", "file"):
        return LocalStore(url.path.rstrip("/"))
    return (S3Store if url.scheme in ("s3", "s3a") else HadoopStore)(spark, root.rstrip("/"))


RACERS = 8


def verify_store(store) -> None:
    """Raises unless put-if-absent takes the first, refuses the second and keeps the first's content."""
    name = f"verify/{uuid.uuid4().hex}"
    try:
        if not store.put_if_absent(name, b"first"):
            raise LogError("a new file was refused")
        if store.put_if_absent(name, b"second"):
            raise LogError("an existing file was replaced")
        if store.get(name) != b"first":
            raise LogError("a file doesn't read as written")
        # of several at once one succeeds, and its content stays
        with ThreadPoolExecutor(RACERS) as pool:
            won = list(pool.map(lambda i: store.put_if_absent(f"{name}-next", b"%d" % i), range(RACERS)))
        if won.count(True) != 1 or store.get(f"{name}-next") != b"%d" % won.index(True):
            raise LogError("of several writers at once not exactly one succeeds")
    finally:
        store.delete(name)
        store.delete(f"{name}-next")
