"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``python bench.py [QUERY …]`` times the named queries only.  Seconds are the best of two runs after a warm-up; the costly
queries run once and are not part of the total.  Jobs and shuffled megabytes are those of the last run."""

from __future__ import annotations

import json
import os
import sys
import time

from winnow.queries import load
from winnow.session import get_spark

HEADLINE = [
    "describe_numeric", "profile_numeric", "missing_values", "fill_all_missing", "fill_median", "outliers_cap",
    "winsorize", "remove_duplicates", "dup_flag", "standardize_text", "convert_dates", "encode_target", "encode_onehot",
    "scale_robust", "bin_freq", "group_agg", "pivot", "top_values", "histogram", "corr_matrix", "sample_stratified",
    "streaks", "fill_ffill", "diff_rows", "rule_templates", "issue_list", "q_overall", "pii_scan_documents", "an_zscore",
    "an_dup_id", "preset_sales", "stream_quality",
]
COSTLY = ["knn_join", "lof", "knn_impute", "fuzzy_categories", "cluster_dbscan", "clf_logistic", "full_profile", "an_flags_all"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    sc = spark.sparkContext
    tracker, stages = sc.statusTracker(), sc._jsc.sc().statusStore()

    def run(name: str, turn: int) -> tuple[float, int, float]:
        """Seconds, jobs and megabytes written to shuffles."""
        group = f"{name}-{turn}"
        sc.setJobGroup(group, name)
        t = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - t
        jobs = tracker.getJobIdsForGroup(group)
        ran = {s for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
        known = [s for s in ran if tracker.getStageInfo(s)]
        return round(took, 3), len(jobs), round(sum(stages.lastStageAttempt(s).shuffleWriteBytes() for s in known) / 1e6, 2)

    named = sys.argv[1:]
    times, costly, jobs, shuffled = {}, {}, {}, {}
    for name in [n for n in HEADLINE if not named or n in named]:
        run(name, 0)  # warm-up: code generation and file listing
        runs = [run(name, turn) for turn in (1, 2)]
        times[name] = min(t for t, *_ in runs)
        _, jobs[name], shuffled[name] = runs[-1]
    for name in [n for n in COSTLY if not named or n in named]:
        costly[name], jobs[name], shuffled[name] = run(name, 0)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "costly": costly, "jobs": jobs, "shuffle_mb": shuffled,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
