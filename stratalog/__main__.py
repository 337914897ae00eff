"""python -m stratalog: import an older log, show a log, compact it."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .sources import importer
from .sources.store import LogStore


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="stratalog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (
        ("import", "rows (offset, namespace, body) in Parquet into a new log"),
        ("import-branches", "the same, with branches made from fork markers, without marker records"),
        ("show", "a log's head, floor and branches"), ("compact", "join small files"),
        ("verify", "check positions, revisions and batches"),
    ):
        p = commands.add_parser(name, help=text)
        if name.startswith("import"):
            p.add_argument("source")
        p.add_argument("log")
        if name == "import-branches":
            p.add_argument("--marker", default="branch.marker")
    given = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("stratalog").getOrCreate()
    store = LogStore(spark, given.log, read_only=given.command in ("show", "verify"))
    try:
        if given.command.startswith("import"):
            rows = spark.read.parquet(given.source)
            marker = getattr(given, "marker", None)
            report = importer.run(store, rows, marker)
            importer.verify(store, rows, marker)
            print(json.dumps(report.__dict__))
        elif given.command == "compact":
            print(json.dumps({"files_joined": store.compact(), "orphans": store.vacuum()}))
        elif given.command == "verify":
            print(json.dumps(store.verify()))
        else:
            print(
                json.dumps(
                    {
                        "database_id": store.database_id, "head": store.head, "floor": store.floor,
                        "files": len(store.state.files), "branches": [b.name for b in store.catalog.by_id.values()],
                    }
                )
            )
    finally:
        if not store.read_only:
            store.close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
