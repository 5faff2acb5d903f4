"""Background jobs: tickets, an append-only log and the first error."""

from __future__ import annotations

import threading
import time
import traceback
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import files

_LOG = "generator string, identifier string, state string, message string, at timestamp"


class Jobs:
    """Runs pipelines beside the caller and keeps their log as a table under a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._threads: dict[str, threading.Thread] = {}

    def _log(self, generator: str, identifier: str, state: str, message: str = "") -> None:
        row = self.spark.createDataFrame([(generator, identifier, state, message)], "generator string, identifier string, state string, message string")
        # a folder for each entry: jobs that end at the same time do not meet
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.json(f"{self.root}/log/{identifier}-{state}-{uuid.uuid4().hex[:8]}")

    def submit(self, generator: str, build: Callable[[], DataFrame]) -> dict[str, str]:
        """Starts a job and gives its ticket at once; the result is written under the ticket, an error ends in the log."""
        identifier = uuid.uuid4().hex
        self._log(generator, identifier, "submitted")

        def run() -> None:
            try:
                build().write.mode("overwrite").parquet(f"{self.root}/results/{identifier}")
                self._log(generator, identifier, "done")
            except Exception as e:  # the job's error is its result
                self._log(generator, identifier, "error", "".join(traceback.format_exception_only(e)).strip()[:500])

        t = threading.Thread(target=run, daemon=True)
        self._threads[identifier] = t
        t.start()
        return {"id": generator, "value": identifier}

    def wait(self, identifier: str, seconds: float = 120) -> str:
        self._threads[identifier].join(seconds)
        return self.status(identifier)["state"]

    def log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).option("recursiveFileLookup", "true").json(f"{self.root}/log")

    def status(self, identifier: str) -> dict[str, str]:
        """The first error if there is one, else the last state."""
        rows = self.log().filter(F.col("identifier") == identifier)
        order = F.when(F.col("state") == "error", 0).otherwise(1)
        r = rows.orderBy(order, F.col("at").desc()).limit(1).collect()
        return {"state": r[0]["state"], "message": r[0]["message"] or ""} if r else {"state": "unknown", "message": ""}

    def result(self, identifier: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/results/{identifier}")


    def export(self, identifier: str, path: str, kind: str = "json") -> str:
        """Writes a result in one of the FORMATS under a path and gives the path back."""
        if kind not in FORMATS:
            raise ValueError(f"no such format: {kind}")
        FORMATS[kind](self.result(identifier), path)
        return path


def _text(df: DataFrame, path: str) -> None:
    df.select(F.col("value").cast("string")).write.mode("overwrite").text(path)


def _gexf(df: DataFrame, path: str) -> None:
    """Edges (source, target, weight) as one graph file; a graph of over MOST_EDGES edges is refused."""
    rows = df.select("source", "target", "weight").limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError("the graph has too many edges for one file")
    nodes = [{"id": n} for n in sorted({x for r in rows for x in (r["source"], r["target"])})]
    text = files.gexf(nodes, [r.asDict() for r in rows])
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


MOST_EDGES = 1_000_000
#: Forms in which a result can be fetched.
FORMATS: dict[str, Callable[[DataFrame, str], None]] = {
    "json": lambda df, p: files.save(df, p), "jsonl.gz": lambda df, p: files.save(df, p, compress=True), "csv": lambda df, p: files.write_csv(df, p), "flatten-csv": lambda df, p: files.write_csv(files.flatten(df), p),
    "lines-csv": lambda df, p: files.write_csv(files.lines_csv(df), p), "txt": _text, "gexf": _gexf, "corpus": lambda df, p: files.write_corpus(df, p),
}


def with_retries(f: Callable, tries: int = 3, pause: float = 0.5):
    """Calls a connector until it answers, waiting longer each time; the last error is raised."""
    for k in range(tries):
        try:
            return f()
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
