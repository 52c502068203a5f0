"""python -m tidelog verify-store ROOT | maintain ROOT TOPIC PARTITION [--max-age-ms N] [--max-bytes N] [--apply]
| topics ROOT | offsets ROOT TOPIC PARTITION; prints JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .errors import LogError
from .sources.log import EventLog
from .sources.store import open_store, verify_store


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="tidelog")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("verify-store", "topics"):
        commands.add_parser(name).add_argument("root")
    for name in ("maintain", "offsets"):
        p = commands.add_parser(name)
        p.add_argument("root")
        p.add_argument("topic")
        p.add_argument("partition", type=int)
        if name == "maintain":
            p.add_argument("--max-age-ms", type=int)
            p.add_argument("--max-bytes", type=int)
            p.add_argument("--apply", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command == "verify-store":
            verify_store(open_store(spark, a.root))
            out = {"ok": True}
        elif a.command == "topics":
            out = [r.asDict() for r in EventLog(spark, a.root).topics().collect()]
        elif a.command == "offsets":
            earliest, latest = EventLog(spark, a.root).offsets(a.topic, a.partition)
            out = {"earliest": earliest, "latest": latest}
        else:
            out = EventLog(spark, a.root).maintain(a.topic, a.partition, a.max_age_ms, a.max_bytes, a.apply)
    except LogError as e:
        print(json.dumps({"error": e.code, "message": str(e)}))
        return 1
    print(json.dumps(out))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
