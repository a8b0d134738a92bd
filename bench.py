"""Times the headline queries, each once after a warm-up, and prints one line of JSON."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from sievework import queries as core

HEADLINE = ["quality_report", "profile_numeric", "profile_counts", "profile_string", "value_counts_topk", "type_vote", "format_vote", "completeness", "typos", "synonyms", "case_variants", "date_standardize", "iqr_outliers_orders", "dup_exact", "dup_near", "id_conflict", "taxonomy_match", "accession_class", "apply_decisions", "row_audit", "readiness", "windowed_rates"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    root = tempfile.mkdtemp(prefix="spark-")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.local.dir": root}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.time()
            core.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
