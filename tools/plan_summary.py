"""Summarise the executed plan of each report: scans per table, shuffles,
join strategies, partial window limits.  Writes markdown to stdout.

usage: python tools/plan_summary.py [sf_dir] [--no-broadcast] [--formatted NAME]

The CRM tables are derived from ``sf_dir`` and written once as parquet under
the session's checkpoint folder, then read back, as a deployment would read
stored tables.  ``--no-broadcast`` disables broadcast joins (the shape at a
scale where no side fits in memory).
"""

from __future__ import annotations

import collections
import os
import re
import sys
import tempfile
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from salesops.plans import reports as R  # noqa: E402
from salesops.plans.params import CONFIG, TODO_CONFIG  # noqa: E402
from salesops.session import local_session, scratch_dir  # noqa: E402
from salesops.sources import fixture_tables, read_tables, write_tables  # noqa: E402

REPORTS = {
    "collection": lambda t: R.report_collection(t, None, CONFIG),
    "debtors": lambda t: R.report_debtors(t, None, CONFIG),
    "dashboard": lambda t: R.report_dashboard(t, None, CONFIG),
    "funnel": lambda t: R.report_funnel(t, None, CONFIG),
    "zero_order": lambda t: R.report_zero_order(t, None, CONFIG),
    "appointment": lambda t: R.report_appointment(t, None, TODO_CONFIG),
}

NODES = ["Exchange hashpartitioning", "Exchange rangepartitioning", "BroadcastExchange", "SortMergeJoin",
         "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct", "WindowGroupLimit",
         "Expand", "Subquery"]


def summarise(plan: str) -> tuple[dict, dict]:
    scans = collections.Counter(re.findall(r"FileScan parquet [^\n]*/(\w+)\.parquet", plan))
    nodes = {n: plan.count(n) for n in NODES if plan.count(n)}
    return dict(sorted(scans.items())), nodes


def main() -> None:
    args = sys.argv[1:]
    formatted = None
    if "--formatted" in args:
        i = args.index("--formatted")
        formatted = args[i + 1]
        del args[i:i + 2]
    no_bc = "--no-broadcast" in args
    args = [a for a in args if a != "--no-broadcast"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = local_session(**{"spark.sql.maxMetadataStringLength": "1000",
                              "spark.checkpoint.dir": tempfile.mkdtemp(prefix="salesops-plans-")})
    path = scratch_dir(spark, f"plans-{uuid.uuid4().hex[:12]}")
    write_tables(fixture_tables(spark, sf_dir), path)
    tables = read_tables(spark, path)
    if no_bc:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print(f"### Executed plans, {os.path.basename(sf_dir)}, broadcast {'off' if no_bc else 'on'}\n")
    print("| Report | Scans per table | Plan nodes |")
    print("| --- | --- | --- |")
    for name, build in REPORTS.items():
        df = build(tables)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans, nodes = summarise(plan)
        s = ", ".join(f"{k} {v}" for k, v in scans.items())
        n = ", ".join(f"{k} {v}" for k, v in nodes.items())
        print(f"| {name} | {s} | {n} |")
        if formatted == name:
            df.explain("formatted")


if __name__ == "__main__":
    main()
