"""The facade: take a file, detect, preview, convert, correct, filter, export."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import asdict
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import convert as conversion
from .operators import detect as detection
from .operators import edits, ordering, status
from .operators.convert import AddressGroup
from .plans import mapping as mappings
from .sources import files, sinks
from .tasks import TaskStore, elapsed, new_id


class NotFound(LookupError):
    """No such task or row, or the task is not that far."""


class AddressEngine:
    def __init__(self, spark: SparkSession, mapping: mappings.Mapping, folder: str | None = None):
        self.spark, self.mapping, self.folder = spark, mapping, folder
        self.tasks = TaskStore(spark, folder) if folder else None

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, folder: str | None = None) -> AddressEngine:
        return cls(spark, mappings.build(mappings.read_rows(spark, path)), folder)

    # Tables

    def read(self, path: str, **options) -> DataFrame:
        return files.read_table(self.spark, path, **options)

    def sample(self, df: DataFrame) -> DataFrame:
        return ordering.head(df, ordering.sample_size(df.count()), files.ORD).drop(files.ORD)

    def detect(self, path: str) -> list[AddressGroup]:
        return detection.detect(self.sample(self.read(path)), self.mapping.units)

    @staticmethod
    def preview(sample: DataFrame, columns: list[str]) -> DataFrame:
        """The first five rows of those columns that exist."""
        return sample.select(*[F.col(f"`{c}`") for c in columns if c in sample.columns]).limit(5)

    def convert(self, df: DataFrame, groups: list[AddressGroup], options: int | None = None) -> DataFrame:
        """df has its file order in `_ord`; the result begins with `id`."""
        if "id" in df.columns:
            raise ValueError("the input has a column named id already")
        converted = conversion.convert(df, groups, self.mapping, options, conversion.DISTINCT_KEYS)
        return conversion.with_ids(converted, files.ORD)

    @staticmethod
    def output_columns(df: DataFrame) -> list[str]:
        return [c for c in df.columns if c.lower() != "id"]

    def apply_edits(self, task_id: str, base: DataFrame) -> DataFrame:
        return edits.overlay(base, self.tasks.edits_of(task_id), self.output_columns(base))

    filtered = staticmethod(status.filtered)
    counts = staticmethod(status.counts)

    def export(self, df: DataFrame, path: str, mode: str) -> str:
        """Write success or error rows beside path, in its format; returns where they are."""
        writer = sinks.WRITERS.get(files.extension(path))
        if writer is None:
            raise files.UnsupportedFormat(files.extension(path))
        name = sinks.output_name(path, mode, self.spark)
        return writer(status.export_rows(df, mode), name) or name

    # Tasks: pending, processing, then preview_ready or failed

    def upload_and_detect(self, path: str, filename: str | None = None) -> dict:
        """Take a file as a new task: what it holds, and which of its columns are addresses."""
        info = files.file_info(self.spark, path)
        if info.error:
            raise ValueError(info.error)
        task_id, workers = new_id(), ordering.suggested_workers(info.rows, info.mb)
        self.tasks.create(task_id, filename=filename or path, filesize=files.file_size(self.spark, path), suggested_workers=workers, n_workers=workers)
        groups = [asdict(g) for g in detection.detect(info.sample, self.mapping.units)]
        self.tasks.update(task_id, pending_groups=groups, step=1)
        return {"task_id": task_id, "step": 1, "groups": groups, "all_columns": info.names, "rows": info.rows, "mb": info.mb, "suggested_workers": workers}

    def group_preview(self, task_id: str, columns: list[str], id_group: int = 0) -> dict:
        """The first five rows of the task's file, of the given columns."""
        path = self._task(task_id)["filename"]
        found = self.preview(files.file_info(self.spark, path).sample, columns)
        rows = [r.asDict() for r in found.collect()]  # five rows
        return {"columns": columns, "sample_data": rows, "total_sample_rows": len(rows), "id_group": id_group}

    def start_conversion(self, task_id: str, groups: list[dict], n_workers: int = 1, options: int | None = None) -> dict:
        """Convert the task's file; its records are stored, its counts and columns are in the task. A failure is told there too."""
        if not groups:
            raise ValueError("no address group is chosen")
        task = self.tasks.update(task_id, selected_groups=groups, n_workers=n_workers, status="processing", progress=0, step=1, message="Đang chuyển đổi (đồng bộ, vui lòng chờ)...")
        if task is None:
            raise NotFound(task_id)
        began = time.time()
        try:
            fields = AddressGroup.__dataclass_fields__
            chosen = [AddressGroup(**{f: g.get(f) for f in fields}) for g in groups]
            done = self.convert(self.read(task["filename"]), chosen, options)
            # Counted while the records are written; they are not read again.
            seen = Observation(f"counts-{task_id}")
            done.observe(seen, *status.tallies()).write.parquet(where := f"{self.folder}/records/{task_id}-{uuid.uuid4().hex}")
            total, success = seen.get["total"], seen.get["success"]
            result = {"total_rows": total, "success_count": success, "fail_count": total - success, "records": where}
            message = f"HOÀN THÀNH trong {elapsed(began)}, Sẵn sàng xem kết quả và chỉnh sửa!"
            self.tasks.update(task_id, status="preview_ready", progress=status.share(success, total), message=message, columns=self.output_columns(done), step=2, result=result)
        except Exception as e:  # whatever went wrong belongs to the task
            self.tasks.update(task_id, status="failed", message=f"Lỗi: {str(e).splitlines()[0] if str(e) else type(e).__name__}", progress=0)
        return self.tasks.get(task_id)

    def _task(self, task_id: str, ready: bool = False) -> dict:
        task = self.tasks.get(task_id)
        if task is None or ready and task["status"] != "preview_ready":
            raise NotFound(task_id)
        return task

    def _records(self, result: dict) -> DataFrame:
        """The records as they are written, with the edits settled so far."""
        if not result.get("files"):
            return self.spark.read.parquet(result["records"])
        names = self.spark.read.parquet(result["files"]).collect()  # as many as Spark's own listing holds
        return self.spark.read.parquet(*[r["file"] for r in names])

    def settle(self, task_id: str) -> int:
        """Lay the task's edits so far into its records; returns how many files were written anew or left out.

        Edits stay in their log, so a row's original is still known; laying one over again changes nothing.
        """
        result = self._task(task_id, ready=True)["result"]
        base = self._records(result)
        before = set(edits.files_of(base))
        files_now = edits.settle(base, self.tasks.edits_of(task_id), f"{self.folder}/records/{task_id}-{uuid.uuid4().hex}")
        changed = before.symmetric_difference(files_now)
        if changed:
            listed = f"{self.folder}/listed/{task_id}-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(f,) for f in files_now], "file string").coalesce(1).write.parquet(listed)
            self.tasks.update(task_id, result=self._task(task_id)["result"] | {"files": listed})
        return len(changed)

    def records(self, task_id: str) -> DataFrame:
        """The task's converted records with all its edits."""
        return self.apply_edits(task_id, self._records(self._task(task_id, ready=True)["result"]))

    def recount(self, task_id: str) -> dict:
        """Counts of all records with their edits, from the records themselves."""
        found = status.counts(self.records(task_id), empty=100.0).first()
        return {"total_rows": found["total"], "success_count": found["success"], "fail_count": found["fail"], "progress": found["percent"]}

    def row(self, task_id: str, row_id):
        """The record with this id and its edits laid over, or None: only the files that can hold it are read, and its own edits."""
        result = self._task(task_id, ready=True)["result"]
        found = edits.row_by_id(self._records(result), row_id)
        number = edits.number_of(row_id)
        if number is not None:
            made = self.tasks.edits_of(task_id, number - 1)
            found = edits.overlay(found, made, self.output_columns(found))
        return found.first()

    def update_row(self, task_id: str, row_id, fields: dict[str, str | None]) -> dict:
        """Lay fields over the row with this id, which is then a success; the row as it was is kept.

        The counts are those of the task before, changed by the row's status before and after.
        """
        row = self.row(task_id, row_id)
        if row is None:
            raise NotFound(f"{task_id}: no row with id {row_id}")
        self.tasks.add_edit(task_id, int(row["id"]) - 1, {k: None if v is None else str(v) for k, v in fields.items()}, row.asDict())
        updated = row.asDict() | fields | {status.STATUS: status.SUCCESS}
        result = self._task(task_id)["result"]
        gained = row[status.STATUS] != status.SUCCESS
        result = result | {"success_count": result["success_count"] + gained, "fail_count": result["fail_count"] - gained}
        self.tasks.update(task_id, step=2, result=result)
        counts = {c: result[c] for c in ("total_rows", "success_count", "fail_count")}
        return {"id": row_id, "row_index": int(row["id"]) - 1, "updated_row": updated, "step": 2} | counts | {"progress": status.share(counts["success_count"], counts["total_rows"], 100.0)}

    def filtered_data(self, task_id: str, mode: str = "all") -> DataFrame:
        """success, error, or all records of the task."""
        found = status.filtered(self.records(task_id), mode)
        self.tasks.update(task_id, step=2, created_at=datetime.now(timezone.utc))
        return found

    def download(self, task_id: str, mode: str, folder: str | None = None) -> str:
        """Write the task's success or error rows in its file's format; returns where they are."""
        done, task = self.records(task_id), self._task(task_id)
        columns = [F.col(f"`{c}`") for c in task["columns"]]
        path = task["filename"] if folder is None else f"{folder}/{os.path.basename(task['filename'])}"
        where = self.export(done.select("id", *columns).orderBy("id"), path, mode)
        self.tasks.update(task_id, step=2)
        return where
