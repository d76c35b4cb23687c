"""Summarise the physical plan of every registered query (PLANS.md).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts scans of the two large inputs, shuffles, broadcasts, sort-merge joins,
Python evaluation nodes and single-partition exchanges in the final
adaptive plan after one execution.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from queuelens.plans.registry import all_plans as queries  # noqa: E402
from queuelens.session import get_spark  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    only = set(sys.argv[2:])
    spark = get_spark("local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    print("# Physical plan summary\n")
    print(f"Final adaptive plans after one run at `{sf_dir}`. `fact scans` counts Parquet scans of "
          "`lineitem`/`orders` (reused exchanges are not re-scans); `1-part` counts exchanges to a single "
          "partition (global windows / final sorts), which only ever see aggregated rows.\n")
    print("| query | fact scans | shuffles | reused | broadcasts | SMJ | python | 1-part | checkpoint reads |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in queries().items():
        if only and name not in only:
            continue
        df = fn(spark, sf_dir)
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
        p = p.split("== Initial Plan ==")[0]          # adaptive plans print both
        lines = p.split("\n")
        scans = sum(1 for ln in lines if re.search(r"Scan parquet", ln) and re.search(r"lineitem|orders", ln))
        shuffles = sum(1 for ln in lines if re.search(r"\bExchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", ln))
        single = sum(1 for ln in lines if "Exchange SinglePartition" in ln)
        reused = sum(1 for ln in lines if "ReusedExchange" in ln)
        bcast = sum(1 for ln in lines if "BroadcastExchange" in ln)
        smj = sum(1 for ln in lines if "SortMergeJoin" in ln)
        py = sum(1 for ln in lines if "ArrowEvalPython" in ln or "BatchEvalPython" in ln)
        ckpt = sum(1 for ln in lines if "Scan ExistingRDD" in ln or "LogicalRDD" in ln)
        print(f"| {name} | {scans} | {shuffles} | {reused} | {bcast} | {smj} | {py} | {single} | {ckpt} |")
    spark.stop()


if __name__ == "__main__":
    main()
