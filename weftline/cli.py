"""Command line: compile a CSV by a plan file, check it, write the results.

Exit code 0: passed; 1: quarantined or to be healed; 2: failed.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .mapping import from_files, heuristic
from .ontology import Registry
from .pipeline import run_pipeline
from .review import payload
from .sources.readers import CsvSource
from .sources.sinks import write_csv, write_json, write_sqlite, write_table


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("source")
    p.add_argument("--registry", required=True)
    p.add_argument("--target", required=True)
    p.add_argument("--plan", action="append", help="plan file; several are tried in turn")
    p.add_argument("--out", required=True)
    p.add_argument("--reference", action="append", default=[], metavar="NAME=PATH", help="a Parquet table that foreign keys are checked against")
    p.add_argument("--row-id", help="column that names a row")
    p.add_argument("--sqlite", help="also append the clean rows to this SQLite file")
    p.add_argument("--retries", type=int, default=2)
    p.add_argument("--delimiter", default=",")
    p.add_argument("--encoding", default="utf-8")
    o = p.parse_args(args)
    try:
        spark = SparkSession.builder.appName("weftline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        model = Registry(o.registry).get(o.target)
        source = spark.read.parquet(o.source) if o.source.rstrip("/").endswith(".parquet") else CsvSource(spark, o.source, o.encoding, o.delimiter).read()
        references = {n: spark.read.parquet(f) for n, _, f in (r.partition("=") for r in o.reference)}
        done = run_pipeline(source, model, from_files(o.plan) if o.plan else heuristic, references=references, max_retries=o.retries, row_id=o.row_id)
        write_json(done.report.to_json(), f"{o.out}/audit_{done.report.report_id}.json")
        if done.decision == "PASS":
            write_table(done.clean, f"{o.out}/{model['dataset_name']}")
            write_csv(done.clean, f"{o.out}/{model['dataset_name']}_csv")
            if o.sqlite:
                write_sqlite(done.clean, model, o.sqlite)
            return 0
        write_table(done.quarantine, f"{o.out}/quarantine")  # all of it; the payload is a page for screens
        write_json(payload(done.quarantine, done.report), f"{o.out}/quarantine_payload.json")
        write_json(done.report.to_markdown(), f"{o.out}/audit_{done.report.report_id}.md")
        return 1
    except Exception:
        logging.exception("compilation failed")
        return 2


if __name__ == "__main__":
    sys.exit(main())
