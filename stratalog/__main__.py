"""python -m stratalog: verify writes timelines, compacts them, reads them back and reports what is wrong; status, segments, read and compact look at a stored log and tend it."""

from __future__ import annotations

import argparse
import sys
import time
import uuid


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="stratalog")
    commands = parser.add_subparsers(dest="command", required=True)
    verify = commands.add_parser("verify")
    verify.add_argument("--timelines", type=int, default=4)
    verify.add_argument("--events", type=int, default=1000)
    verify.add_argument("--payload-size", type=int, default=256)
    verify.add_argument("--folder", help="a new folder that all machines share; else one in spark.checkpoint.dir or the warehouse")
    for name in ("status", "segments", "compact", "read"):
        commands.add_parser(name).add_argument("--folder", required=True, help="a stored log")
    commands.choices["segments"].add_argument("--level", type=int, default=0, help="0 for all")
    read = commands.choices["read"]
    read.add_argument("--timeline", required=True)
    read.add_argument("--start", type=int, default=1)
    read.add_argument("--limit", type=int, default=20)
    return parser


def main(args: list[str]) -> int:
    given = _parser().parse_args(args)

    from pyspark.sql import SparkSession

    from .operators.log import fetch
    from .plans.check import run
    from .plans.storage import LogStore

    spark = SparkSession.builder.getOrCreate()
    if given.command == "verify":
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        wrong = run(spark, given.folder or f"{base}/verify-{uuid.uuid4().hex}", given.timelines, given.events, given.payload_size).orderBy("timeline", "kind").collect()
        for row in wrong:
            print(f"{row.timeline}: {row.kind} {row.n}")
        print("FAILED" if wrong else f"PASSED: {given.timelines} timelines, {given.events} events each")
        return int(bool(wrong))
    store = LogStore(spark, given.folder)
    if store.version() < 0:
        print(f"{given.folder} holds no log", file=sys.stderr)
        return 2
    if given.command == "compact":
        merged, split = store.compact(int(time.time() * 1000))
        print(f"merged: {merged}, split: {split}")
    elif given.command == "read":
        for row in fetch(store.read(), given.timeline, given.start, limit=given.limit).collect():
            print(row.log_offset, row.payload, sep="\t")
    else:
        rows = sorted((r for r in store._rows() if not getattr(given, "level", 0) or r["level"] == given.level), key=lambda r: r["segment_id"])
        if given.command == "segments":
            for r in rows:
                print(r["segment_id"], f"L{r['level']}", r["location"], r["entry_count"], r["size"], r["path"], sep="\t")
        else:
            print(f"version {store.version()}, {len(rows)} segments, {sum(r['entry_count'] for r in rows)} rows, {sum(r['size'] for r in rows)} bytes")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
