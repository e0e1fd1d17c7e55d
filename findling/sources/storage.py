"""Small files and folders of an index, through the file systems that Spark reads."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder by its URI; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What a folder holds, hidden names left out."""
        if not self.exists(name):
            return []
        found = [x.getPath().getName() for x in self.fs.listStatus(self._at(name))]
        return [x for x in found if not x.startswith((".", "_"))]

    def weigh(self, name: str) -> tuple[int, int]:
        """Number and bytes of the files below."""
        files = size = 0
        if self.exists(name):
            walk = self.fs.listFiles(self._at(name), True)
            while walk.hasNext():
                x = walk.next()
                if not x.getPath().getName().startswith((".", "_")):
                    files, size = files + 1, size + x.getLen()
        return files, size

    def size(self, name: str) -> int:
        return self.weigh(name)[1]

    def delete(self, name: str = "") -> None:
        self.fs.delete(self._at(name), True)

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self._at(name), self._at(to)):
            raise OSError(f"can't rename {name} to {to} in {self.path}")

    def read_json(self, name: str) -> dict | None:
        """A small file; what a writer left beside it counts if the file itself is not there."""
        for own in (name, f"{name}.old"):
            if self.exists(own):
                stream = self.fs.open(self._at(own))
                try:
                    return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return None

    def write_json(self, name: str, value: dict) -> None:
        """Replaces a small file: written whole beside it, then renamed."""
        scratch = f".{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(scratch), True)
        stream.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        stream.close()
        old = f"{name}.old"
        if self.exists(name):
            self.delete(old)
            self.rename(name, old)
        self.rename(scratch, name)
        self.delete(old)
