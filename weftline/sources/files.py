"""Small files through the file system that holds them: read whole, listed, and put in place once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A folder by its path, in any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def fs(self):
        return self.at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str = "") -> bool:
        return self.fs().exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """Names in the folder, sorted; none if there is no such folder."""
        fs, at = self.fs(), self.at(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, name: str) -> dict | None:
        """The JSON of a file, or nothing if it is not there or goes meanwhile."""
        fs, at = self.fs(), self.at(name)
        try:
            src = fs.open(at)
        except Py4JJavaError as error:
            if fs.exists(at):
                raise error
            return None
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(src)))
        finally:
            src.close()

    def _written(self, content: dict):
        made = self.at(f"_made/{uuid.uuid4().hex}.json")
        out = self.fs().create(made, False)
        out.write(json.dumps(content).encode())
        out.close()
        return made

    def _moved(self, made, name: str, *options) -> None:
        jvm, fs = self.spark._jvm, self.fs()
        fs.mkdirs(self.at(name).getParent())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, len(options))
        for k, x in enumerate(options):
            how[k] = x
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), self.spark._jsc.hadoopConfiguration()).rename(made, self.at(name), how)

    def claim(self, name: str, content: dict) -> bool:
        """Put a whole file in place unless one is there: the move fails where its target exists. Of several writers one wins."""
        made = self._written(content)
        try:
            self._moved(made, name)
            return True
        except Py4JJavaError as error:
            if not self.exists(name):
                raise error
            self.fs().delete(made, False)
            return False

    def replace(self, name: str, content: dict) -> None:
        """Put a whole file in place of what is there: readers meet the one or the other."""
        self._moved(self._written(content), name, self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE)

    def move(self, name: str, other: str) -> None:
        """Move a file or folder to where nothing is."""
        self._moved(self.at(name), other)

    def delete(self, name: str = "") -> bool:
        fs, at = self.fs(), self.at(name)
        return fs.delete(at, True) if fs.exists(at) else False
