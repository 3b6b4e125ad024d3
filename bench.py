"""Benchmark the headline operator queries.

Runs each headline query of the registry at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "headline_total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced with a ``noop`` write (the full plan runs, nothing is
collected to the driver). Steady state is measured: every headline query runs
once, untimed, on the smallest tables ($BENCH_WARMUP_DIR, default sf0.001) so
JVM start-up, JIT and first code generation are not charged to the timings.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x]
    from tabloom.session import checkpoint_dir, get_session, release
    spark = get_session(f"local[{cpus}]", int(cpus), extra={"spark.driver.memory": "16g"})
    checkpoint_dir(spark)
    from tabloom.plans import registry
    registry.load_all()
    names = only or list(registry.HEADLINE)
    # warm-up (not timed): each headline query once on the smallest tables, so
    # JIT/code generation is not charged to the measured run; no data or
    # result of the measured scale is cached by this.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and warm_dir != sf_dir:
        for name in names:
            registry.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    extra = {}
    if not only:
        # jobs per fit of the preprocessing plan (independent of table width) and
        # scoring throughput of the batch scorer (three models + ensemble)
        from tabloom.plans.inputs import raw_project_frame, table
        from tabloom.plans.preprocess import Preprocessor
        from tabloom.session import materialize
        sc = spark.sparkContext
        raw = materialize(raw_project_frame(spark, sf_dir))
        sc.setJobGroup("bench-fit", "preprocessing fit")
        Preprocessor("normalised_work_effort").fit(raw)
        # AQE submits every shuffle stage as its own job, so this counts stage jobs
        extra["fit_spark_jobs"] = len(sc.statusTracker().getJobIdsForGroup("bench-fit"))
        sc.setJobGroup("bench-other", "other")
        n_rows = table(spark, sf_dir, "lineitem").count()
        if "m13_score_all" in times:
            extra["rows_scored_per_sec"] = round(n_rows / times["m13_score_all"])
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir,
           "spark": spark.version, "cores": int(cpus), **extra}
    print(json.dumps(out))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
