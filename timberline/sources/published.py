"""Results that readers see whole or not at all.

A new version writes its tables into folders nobody knows yet. Only when all of them are there a
small file that lists them is put in place under the next number, in one step that
fails if another writer took that number. Readers follow the file of the highest number. A job
that fails leaves folders without a list; they are deleted with the versions that later ones replace.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Published:
    """The versions of some named tables under one folder.

    A version keeps, replaces or extends each table of the version before. ``keep`` versions stay readable for those
    who have begun to read them; a table extended more than ``parts`` times is rewritten as one.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, parts: int = 64):
        self.spark, self.path, self.keep, self.parts = spark, path.rstrip("/"), keep, parts
        self._fs = spark._jvm.org.apache.hadoop.fs

    def versions(self) -> list[int]:
        """Numbers of the versions that still have a list, lowest first."""
        folder = self._fs.Path(f"{self.path}/_versions")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """What a version lists (the last one by default); empty before the first."""
        if number is None:
            numbers = self.versions()
            if not numbers:
                return {"number": -1, "tables": {}, "streams": {}}
            number = numbers[-1]
        return json.loads(self._read(f"{self.path}/_versions/{number:012d}.json"))

    def done(self, stream: str, batch: int) -> bool:
        """Whether a version holds this batch of a stream: a replayed batch changes nothing."""
        return self.version()["streams"].get(stream, -1) >= batch

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table as it is now; with ``schema`` an empty one where there is none yet."""
        folders = self.version()["tables"].get(name)
        if not folders:
            if schema is None:
                raise FileNotFoundError(f"no table {name} is published under {self.path}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders))

    def publish(self, replace: dict[str, DataFrame] | None = None, extend: dict[str, DataFrame] | None = None,
                stream: str | None = None, batch: int = 0) -> int:
        """Write a version and switch to it. Of a stream, batches published before are left alone."""
        before = self.version()
        if stream is not None and before["streams"].get(stream, -1) >= batch:
            return before["number"]
        tables = dict(before["tables"])
        for name, df in (replace or {}).items():
            tables[name] = [self._write(name, df)]
        for name, df in (extend or {}).items():
            if len(tables.get(name, ())) >= self.parts:
                tables[name] = [self._write(name, self.read(name))]
            tables[name] = [*tables.get(name, ()), self._write(name, df)]
        streams = before["streams"] | ({stream: batch} if stream is not None else {})
        number = before["number"] + 1
        self._put(f"{number:012d}.json", json.dumps({"number": number, "tables": tables, "streams": streams}))
        self._sweep()
        return number

    # -- files ---------------------------------------------------------------
    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _read(self, at: str) -> str:
        path = self._fs.Path(at)
        stream = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        """Write beside, then rename: the file is there with all its content or not at all, and never replaced."""
        conf = self.spark._jsc.hadoopConfiguration()
        beside, place = (self._fs.Path(f"{self.path}/_versions/{n}") for n in (f"_{uuid.uuid4().hex}", name))
        stream = beside.getFileSystem(conf).create(beside, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self._fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 0)
        # The context of the folder's own file system, not of the default one.
        self._fs.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, options)

    def _sweep(self) -> None:
        """Delete lists beyond the last ``keep`` and the folders that only those name."""
        numbers = self.versions()
        old, kept = numbers[: -self.keep], numbers[-self.keep :]
        if not old:
            return
        named = {f for n in kept for folders in self.version(n)["tables"].values() for f in folders}
        gone = {f for n in old for folders in self.version(n)["tables"].values() for f in folders} - named
        for at in [*(f"{self.path}/_versions/{n:012d}.json" for n in old), *(f"{self.path}/{f}" for f in sorted(gone))]:
            path = self._fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read_published(spark: SparkSession, path: str, name: str) -> DataFrame:
    return Published(spark, path).read(name)
