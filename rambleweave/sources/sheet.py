"""A small sheet of facts in a folder, which a crash cannot lose and a reader never sees half written."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


class Sheet:
    """Each change is a new numbered file that appears by one rename; the greatest number holds. The one before stays for readers that still have its name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        folder = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"facts-(\d+)\.json", n)))

    def facts(self) -> dict:
        """The facts; none if nothing was put."""
        numbers = self._numbers()
        if not numbers:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/facts-{numbers[-1]}.json", wholetext=True).collect()))

    def put(self, **facts: object) -> None:
        """Change some facts. Of two writers at once, the later one fails."""
        numbers = self._numbers()
        number = numbers[-1] + 1 if numbers else 0
        text = json.dumps(self.facts() | facts, ensure_ascii=False)
        new, to = self._path(f"{self.path}/facts.json.new"), self._path(f"{self.path}/facts-{number}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(new, to):
            raise OSError(f"{self.path} was changed by another writer")
        for old in numbers[:-1]:
            self._fs.delete(self._path(f"{self.path}/facts-{old}.json"), False)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/{name}"), True)
