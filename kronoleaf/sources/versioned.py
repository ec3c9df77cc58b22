"""Tables in versions, swapped together, with an audit that cannot disagree with them.

A commit first writes the changed tables into folders of their own, then publishes one small log entry that names
the folder of every table and holds the audit of what was done. The entry is put in place by a
rename that fails if its number is taken. So readers see all of a commit or nothing, two writers
cannot both win, and what a killed writer left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

AUDIT = "version long, at string, action string, target_type string, target_id string, details string"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change was made from."""


class Versioned:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._log = self._fs.Path(f"{self.path}/_log")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._log.getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.makeQualified(self._log).toUri(), conf)
        self._files.mkdirs(self._log)

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._log)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _entry(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_log/{version:010d}.json", wholetext=True).first()[0]) if version else {"tables": {}}

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version, the last one if none is given."""
        tables = self._entry(self.version() if version is None else version)["tables"]
        if name not in tables:
            raise KeyError(f"no table {name}; there are {', '.join(sorted(tables)) or 'none'}")
        return self.spark.read.parquet(f"{self.path}/{tables[name]}")

    def commit(self, changes: dict[str, DataFrame], action: str, target_type: str = "", target_id: str = "", details: dict | None = None, made_from: int | None = None) -> int:
        """Publish changed tables and the audit of the change at once; the new version.

        `made_from` is the version that the changes were read from; if it is no longer the last, nothing happens and `Conflict` is raised.
        """
        base = self.version() if made_from is None else made_from
        if base != self.version():
            raise Conflict(f"version {self.version()} was committed after {base}")
        folders = {name: f"{name}/{base + 1:010d}-{uuid.uuid4().hex}" for name in changes}
        for name, df in changes.items():
            df.write.parquet(f"{self.path}/{folders[name]}")
        audit = {"at": datetime.now(UTC).isoformat(timespec="seconds"), "action": action, "target_type": target_type, "target_id": target_id, "details": json.dumps(details or {}, sort_keys=True)}
        entry = json.dumps({"version": base + 1, "tables": self._entry(base)["tables"] | folders, **audit}, ensure_ascii=False)
        draft = self._fs.Path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(entry.encode()))
        out.close()
        try:
            self._context.rename(draft, self._fs.Path(f"{self.path}/_log/{base + 1:010d}.json"), self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0))
        except Exception as e:
            self._files.delete(draft, False)
            raise Conflict(f"version {base + 1} has been committed by another writer") from e
        return base + 1

    def audit(self) -> DataFrame:
        """A row a commit."""
        if not self.version():
            return self.spark.createDataFrame([], AUDIT)
        return self.spark.read.schema(AUDIT).json(f"{self.path}/_log/*.json").orderBy(F.col("version"))
