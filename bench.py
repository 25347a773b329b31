"""Time the headline queries on one local session and print one JSON line."""

from __future__ import annotations

import json
import os
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

HEADLINE = (
    "agg_bank_features",
    "sal_features",
    "utl_features",
    "jn_features",
    "score_batch",
    "reason_codes_points",
    "whatif",
    "metric_eval",
    "pd_calibration",
    "woe_table",
    "bin_fit",
    "lr_wald",
    "jn_consent",
    "dq_rows",
    "rule_fraud4",
    "txt_normalise",
    "txt_normalise_light",
    "tx_bank_df",
    "tx_argmax",
    "fx_gate5",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    from creditloom.plans import PLANS
    from creditloom.session import build_session

    spark = build_session(
        "creditloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executors
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": pathlib.Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
