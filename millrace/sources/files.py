"""Small files on whatever file system Spark reaches, through Hadoop's API."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Reads and writes small text files below one root.

    A file is written once, under a name that no other file has or had: that is
    what every file system can do without a moment in which the file is half
    there or missing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark._jvm
        self._jvm, self._gateway = jvm, spark.sparkContext._gateway
        self.root = root.rstrip("/")
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.at(*parts)))

    def read(self, *parts: str) -> Any:
        """The JSON value of a file; None if there is none."""
        path = self._path(self.at(*parts))
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, value: Any, *parts: str) -> bool:
        """Writes a JSON value as a new, complete file; False if there is one already.

        Of several writers exactly one gets True: on a local disk by a hard
        link, elsewhere by a rename that never replaces; where a rename is a
        copy (object stores), by a create that never replaces.
        """
        target = self._path(self.at(*parts))
        self._fs.mkdirs(target.getParent())
        data = bytearray(json.dumps(value, sort_keys=True).encode())
        scheme = self._fs.getUri().getScheme()
        if scheme not in ("file", "hdfs", "viewfs"):
            return self._put(target, data, False)
        beside = self._path(f"{target.getParent()}/.{uuid.uuid4().hex}")
        self._put(beside, data, True)
        try:
            if scheme == "file":
                os.link(beside.toUri().getPath(), target.toUri().getPath())
            else:
                rename = self._jvm.org.apache.hadoop.fs.Options.Rename
                options = self._gateway.new_array(rename, 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(beside, target, options)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self._fs.delete(beside, False)

    def _put(self, path: Any, data: bytearray, replace: bool) -> bool:
        try:
            stream = self._fs.create(path, replace)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        try:
            stream.write(data)
        finally:
            stream.close()
        return True

    def names(self, *parts: str) -> list[str]:
        """Names of the files and folders in a folder."""
        path = self._path(self.at(*parts))
        if not self._fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path) if not s.getPath().getName().startswith("."))

    def delete(self, *parts: str) -> bool:
        return self._fs.delete(self._path(self.at(*parts)), True)
