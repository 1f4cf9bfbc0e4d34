"""python -m clickloom tasks list|add|run --store PATH ..."""

from __future__ import annotations

import argparse

from clickloom.plans.jobs import jobs
from clickloom.session import get_session
from clickloom.sources.readers import Catalog
from clickloom.tasks import Task, TaskStore, run_task


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="clickloom")
    parser.add_argument("group", choices=["tasks"])
    parser.add_argument("action", choices=["list", "add", "run"])
    parser.add_argument("--store", required=True, help="folder of the task table")
    parser.add_argument("--id", type=int)
    parser.add_argument("--name", default="")
    parser.add_argument("--type", choices=["session", "page", "product"])
    parser.add_argument("--param", default="{}", help="parameters as JSON")
    parser.add_argument("--output", help="folder of the result tables")
    parser.add_argument("--table", action="append", default=[], metavar="NAME=PATH", help="a parquet input; others come from the catalog")
    a = parser.parse_args(argv)
    spark = get_session()
    store = TaskStore(spark, a.store)
    if a.action == "list":
        store.all().orderBy("id").show(truncate=False)
    elif a.action == "add":
        print(store.save(Task(a.id, a.name, a.type, a.param)))
    else:
        print(run_task(store, jobs(Catalog(spark, **dict(x.split("=", 1) for x in a.table))), a.id, a.output))


if __name__ == "__main__":
    main()
