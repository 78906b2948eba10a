"""Headline timings on one machine; prints one JSON line.

Lines are rendered once from ``events`` into text-like Parquet parts before the
clock starts (they stand for the raw log files). Every query is then timed from
its stored inputs to a full result, the best of two runs.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from timberline.operators import correlate as C  # noqa: E402
from timberline.operators import retrieval as R  # noqa: E402
from timberline.operators import scoring as SC  # noqa: E402
from timberline.operators import sequences as Q  # noqa: E402
from timberline.operators import templates as T  # noqa: E402
from timberline.operators.detect import detect  # noqa: E402
from timberline.operators.normalize import normalize  # noqa: E402
from timberline.plans import fixture  # noqa: E402
from timberline.plans.tables import Tables  # noqa: E402
from timberline.session import SESSION_CONF, cut, prepare, scratch  # noqa: E402
from timberline.sources import parquet as PQ  # noqa: E402
from timberline.sources import text as TX  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, repeats: int = 2) -> float:
    best = float("inf")
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = prepare(
        builder.config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, sf_dir)
    lines = cut(t.lines.repartition(cpus * 2), "bench-lines")
    n = lines.count()
    store = t.new_path("bench-store")

    times = {"parse": timed(lambda: run(normalize(lines, "dialect", fixture.YEAR)), 3)}
    t.events = cut(normalize(lines, "dialect", fixture.YEAR), "events")
    times["score_core"] = timed(lambda: run(SC.score_core(t.events)))
    times["correlate"] = timed(lambda: run(C.correlate(t.scored).members))
    times["store"] = timed(lambda: PQ.save_events(t.scored, store), 1)
    times["flag_scan"] = timed(lambda: PQ.flag_scan(spark, store).collect(), 3)
    times["template_cluster"] = timed(lambda: run(T.cluster_templates(t.leaves)))
    times["rare_transitions"] = timed(lambda: run(Q.rare_transitions(Q.transitions(t.sessions))))
    # The whole way as the reference goes it: clustered templates, all signals, incidents.
    def whole():
        with scratch(spark):
            mined = cut(T.mine_templates(cut(normalize(lines, "dialect", fixture.YEAR), "parsed")), "mined")
            run(C.correlate(cut(detect(mined), "detected")).members)

    times["parse_mine_detect_correlate"] = timed(whole, 1)
    times["passages"] = timed(lambda: run(R.passages(t.ordered)))
    times["index_and_search"] = timed(lambda: run(R.TermIndex(t.passages).search(t.questions)))

    scan = PQ.timed_flag_scan(spark, store)
    sizes = PQ.storage_stats(TX.raw_bytes(t.events), spark, store).selectExpr(
        "sum(raw_bytes) AS raw", "sum(binary_bytes) AS stored"
    ).first()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "lines": n,
        "parse_lines_per_sec": round(n / times["parse"]),
        "parse_detect_correlate_sec": round(times["parse"] + times["score_core"] + times["correlate"], 3),
        "whole_lines_per_sec": round(n / times["parse_mine_detect_correlate"]),
        "flag_scan_rows_per_sec": scan["scan_rows_per_sec"],
        "raw_bytes": sizes["raw"], "parquet_bytes": sizes["stored"],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
