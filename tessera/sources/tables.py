"""Tables that change together: one commit switches all of them."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit came in between."""


@dataclass(frozen=True)
class Tables:
    """A folder of tables. Each commit is a small file that names a folder of Parquet for every table, so readers see all of a commit or nothing of it.

    Data are written first, under names of their own; the commit's file is then renamed into place under the next number,
    which fails if that number is taken. What a failed writer leaves behind is never read. The folder's
    file system must rename without overwriting (HDFS and local ones do).
    """

    spark: SparkSession
    path: str

    def _fs(self, where: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest commit's number; 0 if there is none."""
        p, fs = self._fs(f"{self.path}/commits")
        if not fs.exists(p):
            return 0
        return max([int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict:
        if version == 0:
            return {}
        p, _ = self._fs(f"{self.path}/commits/{version:012d}.json")
        return json.loads("".join(r.value for r in self.spark.read.text(p.toString(), wholetext=True).collect()))

    def names(self, version: int | None = None) -> list[str]:
        return sorted(self._manifest(self.version() if version is None else version))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a commit (the newest, where none is named). It stays as it is while others commit."""
        entry = self._manifest(self.version() if version is None else version)[name]
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])

    def commit(self, changes: dict[str, DataFrame], base: int | None = None) -> int:
        """Writes the changed tables and switches to them at once; the others stay. Returns the commit's number.

        ``base`` is the commit that the changes were made from; Conflict is raised if it isn't the newest any more.
        """
        base = self.version() if base is None else base
        if self.version() != base:
            raise Conflict(f"made from commit {base}, but {self.version()} is there")
        entries = self._manifest(base)
        for name, df in changes.items():
            where = f"{self.path}/data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(where)
            entries[name] = {"path": where, "schema": json.loads(df.schema.json())}
        self._publish(base + 1, json.dumps(entries))
        return base + 1

    def _publish(self, version: int, text: str) -> None:
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        draft, fs = self._fs(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        final, _ = self._fs(f"{self.path}/commits/{version:012d}.json")
        fs.mkdirs(final.getParent())
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(final).toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(draft), fs.makeQualified(final), how)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"commit {version} is there already") from None
            raise
