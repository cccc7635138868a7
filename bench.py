"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Every query runs once to warm up and then three times; the median counts. marginal_per_clique
does what marginal_all_pairs does with one scan for each clique, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce
from statistics import median

from pyspark.sql import DataFrame, SparkSession

from veilspark import queries as core
from veilspark.operators import marginal

HEADLINE = ["marginal_all_pairs", "marginal_per_clique", "marginal_3way", "marginal_zero_filled", "noisy_marginal_keyed", "tvd_2way", "tvd_3way", "predicate_counts", "query_error", "indif_pairs", "range_queries", "halfspace_counts", "roc_auc_rank", "rare_merge", "rff_mean"]


def marginal_per_clique(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = core.coded_lines(spark, sf_dir)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [marginal.marginals(lines, [c], collapse=False) for c in core.ONE + core.TWO])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        query = core.QUERIES.get(name) or globals()[name]
        times = []
        for _ in range(4):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "marginal_all_pairs_seconds", "value": took["marginal_all_pairs"], "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    sys.stdout.flush()


if __name__ == "__main__":
    main()
