"""Summarise the physical plans of registered queries from
`explain("formatted")`: shuffles, join strategies, aggregates, top-k nodes,
Python stages, and what each parquet scan pushes down and reads.

    python tools/show_plans.py [sf_dir] [name ...]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = (
    "Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
    "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate",
    "ObjectHashAggregate", "TakeOrderedAndProject", "Window", "WindowGroupLimit", "Generate",
    "MapInPandas", "BatchEvalPython", "ArrowEvalPython",
)


def summarise(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n\n")[0]
    counts = Counter()
    for line in tree.splitlines():
        m = re.search(r"([A-Za-z]+)(?: [A-Za-z]+)* \(\d+\)", line)
        if m:
            name = line.strip(" :+-").split(" (")[0].split(" ")[0]
            if name in NODES:
                counts[name] += 1
    scans = []
    for block in re.findall(r"\(\d+\) Scan parquet[^\n]*\n(.*?)(?=\n\(\d+\) |\Z)", text, re.S):
        loc = re.search(r"Location: \S+ \[(.*?)\]", block)
        pushed = re.search(r"PushedFilters: (\[.*?\])\n", block + "\n")
        schema = re.search(r"ReadSchema: (struct<.*?>)\n", block + "\n")
        scans.append(
            {
                "file": os.path.basename(loc.group(1)) if loc else "?",
                "pushed": pushed.group(1) if pushed else "[]",
                "read": schema.group(1)[:160] if schema else "",
            }
        )
    return {"nodes": dict(counts), "scans": scans}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and os.path.isdir(argv[1]) else "/root/testdata/sf0.1"
    names = [a for a in argv[1:] if not os.path.isdir(a)]
    from quire.plans.catalog import QUERIES
    from quire.session import local_session

    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    for name, fn in QUERIES.items():
        if names and name not in names:
            continue
        if name.startswith("stream_"):
            continue
        s = summarise(fn(spark, sf_dir))
        print(f"## {name}")
        print("   nodes:", s["nodes"])
        for sc in s["scans"]:
            print(f"   scan {sc['file']}: pushed={sc['pushed']} read={sc['read']}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
