"""Small files and folders of a workspace, through the Hadoop file system.

Every path is resolved as Spark resolves it, so that pointers lie beside the data on whatever file system the
shared folder is on. Only metadata goes through here; rows never do."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def qualified(self, path: str) -> str:
        p, fs = self._path(path)
        return fs.makeQualified(p).toString()

    def of_uri(self, uri: str) -> str:
        """The path of a URI as Spark shows it in ``_metadata.file_path`` (percent-encoded)."""
        return self.qualified(self._jvm.org.apache.hadoop.fs.Path(self._jvm.java.net.URI(uri)).toString())

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """A new file with all of ``text``, or nothing: written aside, then renamed. False if ``path`` is there already."""
        p, fs = self._path(path)
        aside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf)
        no_overwrite = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(aside), fs.makeQualified(p), no_overwrite)
            return True
        except Py4JJavaError:
            fs.delete(aside, False)
            if fs.exists(p):
                return False
            raise

    def children(self, path: str) -> list[str]:
        """Names in a folder, none if it is not there."""
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def data_files(self, path: str) -> list[str]:
        """The files below a folder, or the file itself, without names that begin with ``_`` or ``.``."""
        p, fs = self._path(path)
        if not fs.exists(p):
            return []
        out, found = [], fs.listFiles(p, True)
        while found.hasNext():
            f = found.next().getPath()
            if f.getName()[0] not in "_.":
                out.append(fs.makeQualified(f).toString())
        return sorted(out)

    def delete(self, path: str) -> None:
        p, fs = self._path(path)
        fs.delete(p, True)

    def join(self, target: str, head: str, parts: list[str]) -> None:
        """A new file of ``head`` and the bytes of ``parts`` in order. A file system that can concatenate does so without
        copying; elsewhere the bytes are streamed through a small buffer."""
        p, fs = self._path(target)
        paths = [self._path(x)[0] for x in parts]
        out = fs.create(p, False)
        out.write(bytearray(head.encode("utf-8")))
        out.close()
        try:
            array = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Path, len(paths))
            for k, x in enumerate(paths):
                array[k] = fs.makeQualified(x)
            fs.concat(fs.makeQualified(p), array)
            return
        except (Py4JJavaError, UnsupportedOperationException):
            fs.delete(p, False)
        out = fs.create(p, False)
        out.write(bytearray(head.encode("utf-8")))
        for x in paths:
            stream = fs.open(x)
            self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
        out.close()
