"""A table of micro-batches behind a manifest.

Every batch is a folder under ``data``; which folders count is what the newest file under ``manifest``
says. A batch is there from the moment its manifest is renamed into place, and not before, so that
neither a repeated task nor a repeated batch is seen twice. Small folders are folded into larger ones
as the stream goes on: after n batches about ``FANOUT * log(n)`` folders are live, each row has been
written ``log(n)`` times, and a reader lists nothing but the manifest.

One writer at a time, as a streaming query is; a second one fails at its first commit. Readers may come
at any time: what a batch replaces stays until the batch after the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of one level that become one of the next.
FANOUT = 8
#: A folder with entries of more days than this is read for any day.
MOST_DAYS = 100
#: Manifests that are kept, the newest included.
KEPT = 3


class Folder:
    """A folder in storage all executors share, through the file system that Spark has for it."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str) -> list[str]:
        at = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Whole or not at all; an error where the file is there already."""
        hidden = self._at(f"_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target = self._at(name)
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(hidden, target):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"another writer made {name} of {self.path}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def next_fold(files: list[dict], fanout: int = FANOUT) -> list[dict]:
    """The folders to fold into one: all of the lowest level that has enough of them."""
    for level in sorted({f["level"] for f in files}):
        own = [f for f in files if f["level"] == level]
        if len(own) >= fanout:
            return own
    return []


def days_of(groups: list[list[str | None] | None]) -> list[str | None] | None:
    """Days of several folders together; ``None``: any day."""
    if any(g is None for g in groups):
        return None
    found = sorted({d for g in groups for d in g}, key=lambda d: d or "")
    return found if len(found) <= MOST_DAYS else None


class BatchTable:
    """Rows of ``schema`` in batches. ``fold`` may merge rows when folders are folded; it is applied to
    what it made before, so it has to be associative. ``day`` names a date column; reads of some days
    open only folders that have rows of them."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        fold: Callable[[DataFrame], DataFrame] | None = None,
        day: str | None = None,
        fanout: int = FANOUT,
    ):
        self.spark, self.schema, self.fold, self.day, self.fanout = spark, schema, fold, day, fanout
        self.folder = Folder(spark, path)

    def manifest(self) -> dict:
        names = sorted(n for n in self.folder.names("manifest") if n.endswith(".json"))
        if not names:
            return {"version": 0, "number": 0, "files": [], "last": {}, "dropped": []}
        return json.loads(self.folder.read(f"manifest/{names[-1]}"))

    def read(self, days: list[str | None] | None = None) -> DataFrame:
        """All committed rows, or those of ``days`` (as ISO text, or null)."""
        files = self.manifest()["files"]
        if days is None:
            return self._rows(files)
        wanted = set(days)
        rows = self._rows([f for f in files if f["days"] is None or wanted & set(f["days"])])
        dated = [F.lit(d).cast("date") for d in wanted if d is not None]
        found = F.col(self.day).isin(*dated) if dated else F.lit(False)
        return rows.where(found | F.col(self.day).isNull() if None in wanted else found)

    def own(self, run: str, batch: int) -> tuple[DataFrame, int] | None:
        """Rows and number of a batch that was committed last of its run, for a batch that is repeated."""
        last = self._last(run, batch)
        return None if last is None else (self._rows([last]), last["number"])

    def next_number(self) -> int:
        """The number that the next batch gets; it rises over all runs."""
        return self.manifest()["number"] + 1

    def append(
        self, rows: DataFrame, run: str, batch: int, days: list[str | None] | None = None,
        skip_empty: bool = False, replace: bool = False,
    ) -> int:
        """Commit the rows of a batch and return its number.

        A batch that is there already stays as it is, or gets the new rows with ``replace``. ``rows`` are
        computed once, wholly. With ``skip_empty`` a batch without rows leaves no trace.
        """
        last = self._last(run, batch)
        if last is not None and not replace:
            return last["number"]
        while some := next_fold(self._settled(), self.fanout):
            self._fold(some)
        path = self._write(rows)
        state = self.manifest()
        files = [f for f in state["files"] if last is None or f["path"] != last["path"]]
        number = state["number"] + 1 if last is None else last["number"]
        if skip_empty and self._rows([{"path": path}]).isEmpty():
            if last is None:
                self.folder.delete(path)
                return state["number"]
        else:
            files.append({"path": path, "level": 0, "days": days_of([days])})
        ends = {**state["last"], run: {"batch": batch, "number": number, "path": path}}
        self._commit(state, files, ends, max(number, state["number"]))
        return number

    def _last(self, run: str, batch: int) -> dict | None:
        """The entry of a batch that was committed last of its run."""
        last = self.manifest()["last"].get(run)
        if last is None or last["batch"] < batch:
            return None
        if last["batch"] > batch:
            raise RuntimeError(f"batch {batch} of {run} comes after {last['batch']}")
        return last

    def _settled(self) -> list[dict]:
        """Folders that may be folded: all but the last of each run, which may come again."""
        state = self.manifest()
        ends = {x["path"] for x in state["last"].values()}
        return [f for f in state["files"] if f["path"] not in ends]

    def _fold(self, some: list[dict]) -> None:
        rows = self._rows(some)
        rows = self.fold(rows) if self.fold else rows
        # Files of a useful size, with the rows of a day side by side.
        path = self._write(rows.hint("rebalance", self.day) if self.day else rows.hint("rebalance"))
        state = self.manifest()
        paths = {f["path"] for f in some}
        left = [f for f in state["files"] if f["path"] not in paths]
        made = {"path": path, "level": some[0]["level"] + 1, "days": days_of([f["days"] for f in some])}
        self._commit(state, [*left, made], state["last"], state["number"])

    def _commit(self, state: dict, files: list[dict], last: dict, number: int) -> None:
        version = state["version"] + 1
        live = {f["path"] for f in files} | {x["path"] for x in last.values()}
        old = {f["path"] for f in state["files"]} | {x["path"] for x in state["last"].values()}
        # What was replaced stays over the next batch, for readers that have begun.
        dropped = [[n, p] for n, p in state["dropped"] if n >= number - 1] + [[number, p] for p in sorted(old - live)]
        made = {"version": version, "number": number, "files": files, "last": last, "dropped": dropped}
        self.folder.write_once(f"manifest/{version:012d}.json", json.dumps(made))
        # What was replaced long ago, what a writer that failed left behind, old manifests.
        keep = {p.removeprefix("data/") for p in [*live, *(p for _, p in dropped)]}
        for name in self.folder.names("data"):
            if name not in keep:
                self.folder.delete(f"data/{name}")
        for name in sorted(n for n in self.folder.names("manifest") if n.endswith(".json"))[:-KEPT]:
            self.folder.delete(f"manifest/{name}")

    def _write(self, rows: DataFrame) -> str:
        path = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder.path}/{path}")
        return path

    def _rows(self, files: list[dict]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.folder.path}/{f['path']}" for f in files]
        return self.spark.read.schema(self.schema).parquet(*paths)
