"""Benchmark the six reports.

The CRM tables are derived once from the driver files in ``$BENCH_SF_DIR`` and
written as parquet under ``$BENCH_SCRATCH`` (default: a temporary folder, as
this runs on one machine); then every report runs once to warm up and
``$BENCH_REPEAT`` (default 3) times timed, fully executed into a no-op sink.
the same parquet files with as many threads (``BENCH_YARDSTICK=0`` skips it).
Prints one JSON line with the median seconds per report, their sum, and the
yardstick's.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
import uuid

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesops.plans import reports as R  # noqa: E402
from salesops.plans.oracles import ORACLES, render  # noqa: E402
from salesops.plans.params import CONFIG, TODO_CONFIG  # noqa: E402
from salesops.session import local_session, scratch_dir  # noqa: E402
from salesops.sources import fixture_tables, read_tables, write_tables  # noqa: E402

HEADLINE = {
    "collection": lambda t: R.report_collection(t, None, CONFIG),
    "debtors": lambda t: R.report_debtors(t, None, CONFIG),
    "dashboard": lambda t: R.report_dashboard(t, None, CONFIG),
    "funnel": lambda t: R.report_funnel(t, None, CONFIG),
    "zero_order": lambda t: R.report_zero_order(t, None, CONFIG),
    "appointment": lambda t: R.report_appointment(t, None, TODO_CONFIG),
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="salesops-bench-")
    spark = local_session(cpus, app="salesops-bench", **{"spark.sql.shuffle.partitions": str(cpus),
                                                         "spark.checkpoint.dir": scratch})

    t0 = time.time()
    path = scratch_dir(spark, f"bench-{uuid.uuid4().hex[:12]}")
    write_tables(fixture_tables(spark, sf_dir), path)
    load_sec = time.time() - t0
    tables = read_tables(spark, path)

    times: dict[str, float] = {}
    for name, q in HEADLINE.items():
        run(q(tables))
        samples = []
        for _ in range(repeat):
            t = time.time()
            run(q(tables))
            samples.append(time.time() - t)
        times[name] = round(statistics.median(samples), 3)

    yardstick: dict[str, float] = {}
    if os.environ.get("BENCH_YARDSTICK", "1") != "0":
        con = duckdb.connect(config={"threads": int(cpus)})
        for n in tables:
            con.sql(f"CREATE VIEW crm_{n} AS SELECT * FROM '{path}/{n}.parquet/*.parquet'")
        for name in HEADLINE:
            sql = render(ORACLES[f"report_{name}"], views=False)
            samples = []
            for _ in range(repeat + 1):
                t = time.time()
                con.sql(sql).to_arrow_table()
                samples.append(time.time() - t)
            yardstick[name] = round(statistics.median(samples[1:]), 3)

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    extra = {}
    if yardstick:
        extra = {"duckdb_same_tables": yardstick, "duckdb_total_sec": round(sum(yardstick.values()), 3)}
    print(json.dumps({
        "metric": "reports_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "derive_and_write_tables_sec": round(load_sec, 3),
        **extra,
    }))


if __name__ == "__main__":
    main()
