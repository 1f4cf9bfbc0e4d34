"""Tasks: stored parameters of jobs, and their dispatch by type."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from clickloom.params import Params
from clickloom.sources.sinks import KeyedTable, write_result

SCHEMA = "id long, task_name string, create_time long, start_time long, finish_time long, task_type string, task_status string, args map<string,string>, task_param string"


class TaskNotFound(KeyError):
    pass


@dataclass(frozen=True)
class Task:
    id: int
    task_name: str
    task_type: str
    task_param: str = "{}"
    args: dict[str, str] = field(default_factory=dict)
    create_time: int | None = None
    start_time: int | None = None
    finish_time: int | None = None
    task_status: str = "new"

    @property
    def params(self) -> Params:
        return Params.from_json(self.task_param)


class TaskStore:
    """Tasks in a keyed table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, KeyedTable(spark, path, SCHEMA, ["id"], "id")

    def all(self) -> DataFrame:
        return self.table.read()

    def get(self, task_id: int) -> Task:
        row = self.table.read().where(f"id = {int(task_id)}").first()
        if row is None:
            raise TaskNotFound(task_id)
        return Task(**row.asDict())

    def save(self, task: Task) -> Task:
        """Write a task's row, under a number that only this call has. Each task is a part of its own, so
        that writers of different tasks do not touch each other's rows; of one task's rows the one with
        the highest number holds."""
        if task.create_time is None:
            task = replace(task, create_time=int(time.time() * 1000))
        row = tuple(getattr(task, c) for c in self.spark.createDataFrame([], SCHEMA).columns)
        self.table.write(self.spark.createDataFrame([row], SCHEMA), self.table.claim())
        return task


Job = Callable[[SparkSession, Params], dict[str, DataFrame]]


def run_task(store: TaskStore, jobs: dict[str, Job], task_id: int, output: str) -> Task:
    """Run a task's job and write each of its results under output, by task id; status and times are
    kept. A run after a failed one replaces what that one wrote. "finished" is written last."""
    task = store.save(replace(store.get(task_id), start_time=int(time.time() * 1000), task_status="running"))
    try:
        if task.task_type not in jobs:
            raise ValueError(f"no job of type {task.task_type!r}")
        for name, df in jobs[task.task_type](store.spark, task.params).items():
            write_result(df, f"{output}/{name}", task.id)
    except Exception:
        store.save(replace(task, finish_time=int(time.time() * 1000), task_status="failed"))
        raise
    return store.save(replace(task, finish_time=int(time.time() * 1000), task_status="finished"))
