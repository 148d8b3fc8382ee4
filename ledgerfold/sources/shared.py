"""Small files in a folder that the driver shares with whoever takes over from it.

A folder is a path or URI.  Local ones are used directly; all others through the
Hadoop file systems of the Spark session, so that what Spark can read and write
can also hold manifests and control state.  Two operations carry everything above:
``create`` makes a file with its whole content or reports that the name is taken,
``replace`` puts a whole file in the place of another.
"""

from __future__ import annotations

import os
import shutil
import uuid


class LocalFolder:
    def __init__(self, folder: str):
        self.folder = "/" + folder[5:].lstrip("/") if folder.startswith("file:") else folder
        os.makedirs(self.folder, exist_ok=True)

    def path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def read(self, name: str) -> bytes | None:
        try:
            with open(self.path(name), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None

    def _written(self, name: str, data: bytes) -> str:
        os.makedirs(os.path.dirname(self.path(name)), exist_ok=True)
        temporary = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        with open(temporary, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return temporary

    def create(self, name: str, data: bytes) -> bool:
        temporary = self._written(name, data)
        try:
            os.link(temporary, self.path(name))  # fails if there is one
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(temporary)

    def replace(self, name: str, data: bytes) -> None:
        os.replace(self._written(name, data), self.path(name))

    def names(self, inner: str = "") -> list[str]:
        try:
            return sorted(n for n in os.listdir(self.path(inner)) if not n.endswith(".tmp"))
        except (FileNotFoundError, NotADirectoryError):
            return []

    def delete(self, name: str) -> None:
        path = self.path(name)
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.exists(path):
            os.remove(path)


class HadoopFolder:
    """The same over a file system of the session's Hadoop configuration."""

    def __init__(self, spark, folder: str):
        self.folder, self._jvm = folder.rstrip("/"), spark.sparkContext._jvm
        hadoop, conf = self._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: hadoop.Path(self.path(name)) if name else hadoop.Path(self.folder)
        self._fs = self._path("").getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._path("").toUri(), conf)
        self._rename = hadoop.Options.Rename
        self._fs.mkdirs(self._path(""))

    def path(self, *parts: str) -> str:
        return "/".join((self.folder, *parts))

    def read(self, name: str) -> bytes | None:
        if not self._fs.exists(self._path(name)):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _moved(self, name: str, data: bytes, how) -> None:
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(temporary), False)
        out.write(bytearray(data))
        out.close()
        options = self._jvm.java.lang.reflect.Array.newInstance(how.getClass(), 1)
        options[0] = how
        try:
            self._context.rename(self._path(temporary), self._path(name), options)
        finally:
            self._fs.delete(self._path(temporary), False)

    def create(self, name: str, data: bytes) -> bool:
        from py4j.protocol import Py4JJavaError

        try:
            self._moved(name, data, self._rename.NONE)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or self._fs.exists(self._path(name)):
                return False
            raise

    def replace(self, name: str, data: bytes) -> None:
        self._moved(name, data, self._rename.OVERWRITE)

    def names(self, inner: str = "") -> list[str]:
        if not self._fs.exists(self._path(inner)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(inner))]
        return sorted(n for n in found if not n.endswith(".tmp") and not n.endswith(".crc"))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


def shared_folder(folder: str, spark=None):
    """Local folders need no session."""
    if "://" not in folder or folder.startswith("file:"):
        return LocalFolder(folder)
    from pyspark.sql import SparkSession

    return HadoopFolder(spark or SparkSession.getActiveSession(), folder)


def open_file(uri: str, mode: str = "rb"):
    """A file to read (seekable) or write from a task, where there is no JVM."""
    if "://" not in uri or uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_output_stream(path) if "w" in mode else store.open_input_file(path)


def publish(temporary: str, final: str) -> None:
    """Rename a finished file of a task into place; a second attempt of the task
    puts the same bytes there."""
    if "://" not in temporary or temporary.startswith("file:"):
        strip = lambda u: "/" + u[5:].lstrip("/") if u.startswith("file:") else u
        os.replace(strip(temporary), strip(final))
        return
    from pyarrow import fs

    store, a = fs.FileSystem.from_uri(temporary)
    _, b = fs.FileSystem.from_uri(final)
    if store.get_file_info(b).type != fs.FileType.NotFound:
        store.delete_file(b)
    store.move(a, b)


def list_files(uri: str) -> list[tuple[str, int]]:
    """(URI, size) of the files in a folder, from a task or the driver."""
    if "://" not in uri or uri.startswith("file:"):
        path = "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri
        out = []
        for n in os.listdir(path):
            try:
                out.append((os.path.join(path, n), os.path.getsize(os.path.join(path, n))))
            except FileNotFoundError:  # renamed or pruned since
                pass
        return out
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    scheme = uri[: uri.index("://") + 3]
    found = store.get_file_info(fs.FileSelector(path))
    head = uri.rstrip("/")
    return [(f"{head}/{os.path.basename(f.path)}" if scheme else f.path, f.size) for f in found if f.type == fs.FileType.File]
