"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of source tables, BENCH_CPUS the number of cores.  The
book is loaded first and timed on its own; every query then runs once to warm up and
three times for its median.  ``sql_seconds`` is the same result computed by DuckDB
from the source tables on the same machine.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folio.catalog.oracle import all_oracles  # noqa: E402
from folio.catalog.queries import all_queries  # noqa: E402
from folio.session import local_session  # noqa: E402
from folio.sources.binding import book  # noqa: E402

HEADLINES = (
    "portfolio_summary", "portfolio_kpis", "account_cards", "pending_followups", "top_at_risk", "customer_sentiment",
    "resolve_names", "recent_orders", "timeline", "recent_activity", "fk_coverage", "audit_duplicates", "ref_resolution",
    "spread_tickets", "evidence_bundle", "score_predictions", "labeler_pairs", "action_state",
)
RUNS = 3


def median_seconds(run, runs: int = RUNS) -> float:
    run()
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times), 3)


def duckdb_seconds(folder: str, names: tuple[str, ...], cores: str) -> dict[str, float]:
    try:
        import duckdb
    except ImportError:
        return {}
    con = duckdb.connect()
    if cores.isdigit():
        con.execute(f"set threads to {cores}")
    for file in sorted(os.listdir(folder)):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from read_parquet('{folder}/{file}')")
    sql = all_oracles()
    return {n: median_seconds(lambda n=n: con.execute(sql[n]).fetchall()) for n in names}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", partitions=int(cores) if cores.isdigit() else 8)
    start = time.perf_counter()
    book(spark, folder).store()
    load = round(time.perf_counter() - start, 3)
    catalogue = all_queries()

    def runner(name: str):
        return lambda: catalogue[name](spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {name: median_seconds(runner(name)) for name in HEADLINES}
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "load_seconds": load, "cores": cores,
        "sql_seconds": duckdb_seconds(folder, HEADLINES, cores),
    }))


if __name__ == "__main__":
    main()
