"""Tasks and their edits as append-only Parquet logs; the latest entry of a key counts."""

from __future__ import annotations

import json
import math
import secrets
import string
import time
from datetime import date, datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.edits import latest, merged

# The fields of a task and their defaults.
DEFAULTS = {
    "filename": "", "filesize": 0, "status": "pending", "progress": 0, "message": "Đang chờ xử lý...", "suggested_workers": 1, "n_workers": 1,
    "pending_groups": [], "selected_groups": [], "columns": [], "step": 0, "result": None, "created_at": None,
}
LOG = "task_id string, body string, at timestamp, seq long"
EDITS = "task_id string, row_index int, edited map<string,string>, original string, edited_at timestamp, seq long"
ID_LETTERS = string.digits + string.ascii_letters + "_-"


def plain(value):
    """A value as JSON takes it: NaN and bytes become null, times ISO text, the rest text."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if value is None or isinstance(value, (bytes, bytearray)) or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value if isinstance(value, (str, int, float, bool)) else str(value)


def progress(value) -> int:
    return max(0, min(100, int(value or 0)))


def progress_of(share: Column) -> Column:
    """progress as an expression."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(share, F.lit(0)).cast("int"))).cast("int")


def new_id(size: int = 14) -> str:
    return "".join(secrets.choice(ID_LETTERS) for _ in range(size))


def elapsed(began: float) -> str:
    """Seconds since began (a time.time()), as messages show them."""
    return f"{time.time() - began:.1f}s"


class TaskStore:
    """Create, update and find tasks; add and read edits."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.tasks, self.edits = spark, folder, f"{folder}/tasks", f"{folder}/edits"

    def _log(self, task_id: str, body: dict) -> None:
        row = (task_id, json.dumps(plain(body), ensure_ascii=False), datetime.now(timezone.utc), time.time_ns())
        self.spark.createDataFrame([row], LOG).write.mode("append").parquet(self.tasks)

    def create(self, task_id: str, **fields) -> dict:
        body = DEFAULTS | {"created_at": datetime.now(timezone.utc)} | {k: v for k, v in fields.items() if k in DEFAULTS}
        self._log(task_id, body)
        return plain(body)

    def update(self, task_id: str, **fields) -> dict | None:
        """Unknown fields are ignored; progress is held in 0..100."""
        known = self.get(task_id)
        if known is None:
            return None
        body = {k: v for k, v in fields.items() if k in DEFAULTS}
        if "progress" in body:
            body["progress"] = progress(body["progress"])
        known = {k: v for k, v in known.items() if k in DEFAULTS} | body
        self._log(task_id, known)
        return known

    def get(self, task_id: str) -> dict | None:
        rows = self.spark.read.schema(LOG).parquet(self.tasks).filter(F.col("task_id") == task_id)
        row = latest(rows, ["task_id"], F.desc("at"), F.desc("seq")).first()
        return None if row is None or row["body"] is None else {"task_id": task_id} | json.loads(row["body"])

    def delete(self, task_id: str) -> None:
        """The task is gone, and with it all its edits so far."""
        row = (task_id, None, datetime.now(timezone.utc), time.time_ns())
        self.spark.createDataFrame([row], LOG).write.mode("append").parquet(self.tasks)

    def add_edit(self, task_id: str, row_index: int, edited: dict[str, str | None], original: dict | None = None) -> None:
        shown = None if original is None else json.dumps(plain(original), ensure_ascii=False)
        row = (task_id, row_index, edited, shown, datetime.now(timezone.utc), time.time_ns())
        # A folder for each task: the edits of others are never read.
        self.spark.createDataFrame([row], EDITS).write.mode("append").partitionBy("task_id").parquet(self.edits)

    def _edits(self, task_id: str) -> DataFrame:
        try:
            made = self.spark.read.schema(EDITS).parquet(self.edits).filter(F.col("task_id") == task_id)
        except AnalysisException:  # no edit was ever made
            return self.spark.createDataFrame([], EDITS)
        log = self.spark.read.schema(LOG).parquet(self.tasks).filter(F.col("task_id") == task_id)
        gone = log.agg(F.max(F.when(F.col("body").isNull(), F.col("seq")))).first()[0]
        return made if gone is None else made.filter(F.col("seq") > gone)

    def edits_of(self, task_id: str, row_index: int | None = None) -> DataFrame:
        """One edit per row (or of the one row): later ones add to and replace fields of earlier ones; one without fields still marks its row."""
        made = self._edits(task_id)
        return merged(made if row_index is None else made.filter(F.col("row_index") == row_index), ["row_index"], "edited", F.desc("edited_at"), F.desc("seq"))

    def original_of(self, task_id: str, row_index: int) -> dict | None:
        """The row as it was before its first edit."""
        rows = self._edits(task_id).filter((F.col("row_index") == row_index) & F.col("original").isNotNull())
        row = latest(rows, ["row_index"], "edited_at", "seq").first()
        return None if row is None else json.loads(row["original"])
