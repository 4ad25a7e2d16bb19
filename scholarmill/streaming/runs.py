"""Incremental runs that can be killed: a run log, a checkpoint that moves with success only, stages that are not done twice.

Everything lies in one folder of the cluster: ``log/`` has an entry for each run, ``work/`` what its stages and pages
wrote, ``table/`` the versions of the loaded table. An entry is put in place by one rename, and it names the version that
it made: readers see the versions of succeeded runs only.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import upsert
from .incremental import start_date

Stage = Callable[[DataFrame], DataFrame]
_ENTRY = "number long, run_id string, state_key string, status string, from_date string, to_date string, records long, version string, error string"


class Store:
    """Files beside Spark's tables, by the file system that Spark uses for the folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")))

    def put(self, name: str, text: str) -> bool:
        """Writes a small file and moves it to its name; false if there is one already."""
        target = self._path(f"{self.root}/{name}")
        if self._fs.exists(target):
            return False
        self._fs.mkdirs(target.getParent())
        draft = self._path(f"{self.root}/{name}.{self.spark.sparkContext.applicationId}.draft")
        out = self._fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        return bool(self._fs.rename(draft, target))

    def done(self, folder: str) -> bool:
        """Whether Spark finished writing a table."""
        return self.exists(f"{folder}/_SUCCESS")

    def keep(self, df: DataFrame, folder: str) -> DataFrame:
        """``df`` as a table of the folder; one that is complete is read as it is, one that is not is written anew."""
        if not self.done(folder):
            df.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        return self.spark.read.parquet(f"{self.root}/{folder}")


@dataclass(frozen=True)
class Window:
    """The days that a run takes, both ends included."""

    from_date: str
    to_date: str


class Runs:
    """Incremental runs of one ``state_key`` in a folder."""

    def __init__(self, spark: SparkSession, root: str, state_key: str, initial: str) -> None:
        self.spark, self.state_key, self.initial = spark, state_key, initial
        self.store = Store(spark, root)

    def log(self) -> DataFrame:
        """An entry for each run of the key, in order."""
        names = [n for n in self.store.names("log") if n.endswith(".json")]
        rows = self.spark.read.schema(_ENTRY).json([f"{self.store.root}/log/{n}" for n in names]) if names else self.spark.createDataFrame([], _ENTRY)
        return rows.where(F.col("state_key") == self.state_key)

    def checkpoint(self) -> str | None:
        """The last day that a succeeded run took; failed runs and runs over earlier days do not move it."""
        return self.log().where("status = 'succeeded'").agg(F.max("to_date")).first()[0]

    def table(self) -> DataFrame | None:
        """The table as the last succeeded run left it."""
        last = self.log().where("status = 'succeeded' AND version IS NOT NULL").orderBy(F.desc("number")).first()
        return None if last is None else self.spark.read.parquet(f"{self.store.root}/table/{last.version}")

    def window(self, to_date: str, explicit: str | None = None) -> Window | None:
        """What the next run takes; nothing if the checkpoint is there already."""
        begin = start_date(explicit, self.checkpoint(), self.initial)
        return Window(begin, to_date) if begin <= to_date else None

    def _enter(self, run_id: str, status: str, window: Window, records: int | None = None, version: str | None = None, error: str | None = None) -> None:
        while True:
            number = 1 + max((int(n[:-5]) for n in self.store.names("log") if n.endswith(".json")), default=0)
            entry = {"number": number, "run_id": run_id, "state_key": self.state_key, "status": status, "from_date": window.from_date, "to_date": window.to_date, "records": records, "version": version, "error": error}
            if self.store.put(f"log/{number:012d}.json", json.dumps(entry)):
                return

    def collected(self, run_id: str, pages: Callable[[str | None], Iterator[tuple[DataFrame, str | None]]]) -> DataFrame:
        """The records of all pages, each kept as it comes; a run that starts again goes on from the last page's cursor.

        ``pages(cursor)`` gives (records, cursor of the next page) from a cursor on, or from the start; a null cursor ends
        them. A page counts once its cursor is put down, so a page that was cut off is taken again.
        """
        folder = f"work/{run_id}/pages"
        marks = [n for n in self.store.names(f"{folder}/marks") if n.endswith(".json")]
        at, cursor = len(marks), None
        if marks:
            text = self.spark.read.text(f"{self.store.root}/{folder}/marks/{marks[-1]}", wholetext=True).first().value
            cursor = json.loads(text)["next"]
        if not marks or cursor is not None:
            for records, following in pages(cursor):
                records.write.mode("overwrite").parquet(f"{self.store.root}/{folder}/page={at}")
                self.store.put(f"{folder}/marks/{at:012d}.json", json.dumps({"page": at, "next": following}))
                at += 1
                if following is None:
                    break
        return self.spark.read.option("basePath", f"{self.store.root}/{folder}").parquet(*(f"{self.store.root}/{folder}/page={k}" for k in range(at)))

    def pages_report(self, run_id: str) -> DataFrame:
        """(page, records, next): what each page of a run gave."""
        folder = f"{self.store.root}/work/{run_id}/pages"
        marks = self.spark.read.schema("page long, next string").json(f"{folder}/marks")
        counts = self.spark.read.option("basePath", folder).parquet(*(f"{folder}/page={r.page}" for r in marks.select("page").collect())).groupBy("page").agg(F.count("*").alias("records"))
        return marks.join(counts, "page", "left").select("page", F.coalesce("records", F.lit(0)).alias("records"), "next")

    def run(self, to_date: str, fetch: Callable[[str, Window], DataFrame], stages: list[tuple[str, Stage]], key: str, explicit: str | None = None) -> str:
        """Fetches the window's records, takes them through the stages and upserts them into the table by ``key``.

        Returns ``succeeded``, or ``nothing`` if there is no day to take. An error is entered as a failed run and raised;
        until one succeeds, runs of the same days have the same id, find the tables of the finished stages, and make the
        rest. The new version of the table counts with the entry of the succeeded run; a version of a run that was killed
        before its entry is written again.
        """
        window = self.window(to_date, explicit)
        if window is None:
            return "nothing"
        made = self.log().where("status = 'succeeded'").count()
        run_id = f"{self.state_key}-{made + 1}-{window.from_date}-{window.to_date}"
        try:
            rows = self.store.keep(fetch(run_id, window), f"work/{run_id}/fetched")
            for k, (name, stage) in enumerate(stages):
                rows = self.store.keep(stage(rows), f"work/{run_id}/{k}-{name}")
            before = self.table()
            fresh = upsert(before, rows, key) if before is not None else rows
            fresh.write.mode("overwrite").parquet(f"{self.store.root}/table/{run_id}")
            records = rows.count()
        except Exception as error:
            self._enter(run_id, "failed", window, error=f"{type(error).__name__}: {error}"[:500])
            raise
        self._enter(run_id, "succeeded", window, records, run_id)
        return "succeeded"
