"""``python -m sievelake``: run the five experiments, one CSV per query, and say which ones failed.

The exit code is 0 if all that were asked for ran, else 1. An experiment that fails doesn't stop the others.
"""

from __future__ import annotations

import argparse
import os
import sys
import traceback

from pyspark.sql import SparkSession

from .plans import registry
from .sources.tables import save_csv

#: The experiments: a name, and the queries that give its tables.
EXPERIMENTS = {
    1: ("token cost", ["q_token_cost", "q_cost_percentiles", "q_cost_cdf", "q_cost_spread", "q_cost_pivot", "q_cost_box"]),
    2: ("budgets", ["q_budget_simulation", "q_budget_bins", "q_budget_centers", "q_deviation_centers", "q_budget_pivot"]),
    3: ("retrieval against use", ["q_keyword_quality", "q_quality", "q_quality_by_topk", "q_quality_pivot", "q_recall_density", "q_similarity_points"]),
    4: ("hard queries", ["q_hardness", "q_adaptive", "q_adaptive_by_class", "q_savings_histogram", "q_cost_success"]),
    5: ("repeat runs", ["q_simulated_outputs", "q_stability", "q_stability_means", "q_stability_by_type", "q_stability_histogram"]),
}


def run(spark: SparkSession, number: int, sf_dir: str, output_dir: str) -> None:
    """Write each table of an experiment as CSV below ``output_dir``."""
    found = registry.queries()
    for name in EXPERIMENTS[number][1]:
        # results are a row per task, plan or bin
        save_csv(found[name](spark, sf_dir), f"{output_dir.rstrip('/')}/test{number}/{name[2:]}", single=True)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sievelake", description="Run the experiments over a folder of Parquet tables.")
    parser.add_argument("--test", type=int, choices=sorted(EXPERIMENTS), help="one experiment; all if left out")
    parser.add_argument("--output-dir", default="results", help="where the CSV files go")
    parser.add_argument("--data", required=True, help="folder with documents.parquet, embeddings.parquet, benchmark.parquet")
    asked = parser.parse_args(args)
    spark = SparkSession.builder.appName("sievelake").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    failed = []
    for number in [asked.test] if asked.test else sorted(EXPERIMENTS):
        try:
            run(spark, number, asked.data, asked.output_dir)
            print(f"experiment {number}, {EXPERIMENTS[number][0]}: done")
        except Exception:
            traceback.print_exc()
            failed.append(number)
            print(f"experiment {number}, {EXPERIMENTS[number][0]}: failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
