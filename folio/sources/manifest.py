"""Numbered manifests: small JSON files that say which folders are live, published by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """The manifests below ``folder``, which all executors share; none is ever changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.package = spark._jvm.org.apache.hadoop.fs
        self.configuration = spark._jsc.hadoopConfiguration()
        self.fs = self.path(folder).getFileSystem(self.configuration)

    def path(self, path: str):
        return self.package.Path(path)

    def numbers(self) -> list[int]:
        folder = self.path(self.folder)
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def read(self, number: int) -> dict:
        return self.read_file(self.file(number))

    def read_file(self, path: str) -> dict:
        stream = self.fs.open(self.path(path))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> None:
        """Make ``content`` manifest ``number``; fails where another writer has published that number."""
        self.publish_file(self.file(number), content)

    def publish_file(self, target: str, content: dict) -> None:
        unfinished = f"{self.folder}/unfinished-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(unfinished), False)
        out.write(json.dumps(content).encode())
        out.close()
        context = self.package.FileContext.getFileContext(self.fs.getUri(), self.configuration)
        # no options: the rename fails where the target exists
        context.rename(self.path(unfinished), self.path(target), self.spark._sc._gateway.new_array(self.package.Options.Rename, 0))

    def remove(self, number: int) -> None:
        self.fs.delete(self.path(self.file(number)), False)
