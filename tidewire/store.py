"""Tables as numbered versions of a folder, and locks: what drivers must agree on without a database.

A version is a small file in `_log` that names a folder of data. It appears whole or not at all, and only if nobody
else made that number, so a writer that breaks off changes nothing that a reader sees, and of two writers of one
number one fails. This rests on a file system whose renames do not replace a file (local disks, HDFS).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

LOG, DIGITS = "_log", 12


class Conflict(Exception):
    """Another writer made the version first."""


class Files:
    """The few file operations that versions and locks need, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.fs = self.path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def put_if_absent(self, name: str, said: str) -> bool:
        """Make a file with these contents, unless it is there; whether this call made it."""
        at, draft = self.path(name), self.path(f"{name}.{uuid.uuid4().hex}.draft")
        self.fs.mkdirs(at.getParent())
        out = self.fs.create(draft, True)
        out.write(bytearray(said.encode()))
        out.close()
        try:
            if not self.local:
                return bool(self.fs.rename(draft, at))
            file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
            self.jvm.java.nio.file.Files.createLink(file(self.fs.makeQualified(at)), file(self.fs.makeQualified(draft)))  # a rename would replace
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.fs.delete(draft, False)

    def move(self, name: str, to: str) -> bool:
        """Rename a file; of several that try only one succeeds."""
        try:
            return bool(self.fs.rename(self.path(name), self.path(to)))
        except Exception as e:
            if "FileNotFound" in str(e):
                return False
            raise

    def read(self, name: str) -> str | None:
        """The contents of a small file; null if it is not there."""
        try:
            stream = self.fs.open(self.path(name))
        except Exception as e:
            if "FileNotFound" in str(e):
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def delete(self, name: str) -> bool:
        return bool(self.fs.delete(self.path(name), True))


@dataclass
class Versions:
    """A stored table at root. A reader sees the last version, or one that it names; old ones stay until vacuum()."""

    spark: SparkSession
    root: str

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.files = Files(self.spark, self.root)

    def latest(self) -> int:
        """The last version; -1 before the first."""
        numbers = [int(n) for n in self.files.names(f"{self.root}/{LOG}") if n.isdigit()]
        return max(numbers, default=-1)

    def entry(self, version: int) -> dict:
        said = self.files.read(f"{self.root}/{LOG}/{version:0{DIGITS}d}")
        if said is None:
            raise KeyError(f"{self.root} has no version {version}")
        return json.loads(said)

    def commit(self, tables: DataFrame | dict[str, DataFrame], base: int | None = None, how: str = "parquet", **notes: object) -> int:
        """Write a table, or several by name, beside the other versions, then make them the next version; its number.

        base is the version that they were made from: if there is a later one by now, nothing changes and
        Conflict is raised. Without base they are added as they are, behind whatever others commit meanwhile.
        """
        folder = f"data-{uuid.uuid4().hex}"
        named = tables if isinstance(tables, dict) else {"": tables}
        for name, df in named.items():
            writer = df.write.partitionBy(*notes["by"]) if notes.get("by") else df.write
            writer.format(how).save(f"{self.root}/{folder}/{name}".rstrip("/"))
        said = json.dumps({"folder": folder, "schemas": {n: df.schema.jsonValue() for n, df in named.items()}, "how": how, **notes})
        number = (self.latest() if base is None else base) + 1
        while not self.files.put_if_absent(f"{self.root}/{LOG}/{number:0{DIGITS}d}", said):
            if base is not None:
                self.files.delete(f"{self.root}/{folder}")
                raise Conflict(f"{self.root} has a version {number} already")
            number += 1
        return number

    def read(self, version: int | None = None, name: str = "") -> DataFrame:
        """The rows of a version, by default of the last, and of one of its tables."""
        entry = self.entry(self.latest() if version is None else version)
        return self.spark.read.schema(StructType.fromJson(entry["schemas"][name])).format(entry["how"]).load(f"{self.root}/{entry['folder']}/{name}".rstrip("/"))

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data of all but the last versions, and what broken writers left; not while others write. The number of folders."""
        last = self.latest()
        kept = {self.entry(v)["folder"] for v in range(max(0, last - keep + 1), last + 1)}
        return sum(self.files.delete(f"{self.root}/{n}") for n in self.files.names(self.root) if n.startswith("data-") and n not in kept)


class Lock:
    """One holder at a time, whichever driver asks. A holder that died is removed by take_over()."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.files, self.at = spark, Files(spark, path), path

    def take(self, holder: str) -> bool:
        return self.files.put_if_absent(self.at, holder)

    def holder(self) -> str | None:
        return self.files.read(self.at)

    def release(self, holder: str) -> bool:
        """Free the lock, if this holder has it."""
        return self.holder() == holder and self.files.delete(self.at)

    def take_over(self, dead: str, holder: str) -> bool:
        """Take the lock from a holder that is known to be dead; of several that try only one succeeds."""
        aside = f"{self.at}.{uuid.uuid4().hex}.dead"
        if self.holder() != dead or not self.files.move(self.at, aside):
            return False
        if self.files.read(aside) != dead:  # another had taken it over in between: give it back
            self.files.put_if_absent(self.at, self.files.read(aside) or "")
            self.files.delete(aside)
            return False
        self.files.delete(aside)
        return self.take(holder)
