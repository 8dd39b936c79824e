"""Count plan operators that matter at scale for each registered query:
shuffles, broadcasts, windows, Python evaluation, cartesian/nested-loop joins.

    python tools/plan_shapes.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {
    "shuffle": r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange RoundRobinPartitioning|\bExchange SinglePartition",
    "single_partition": r"Exchange SinglePartition",
    "broadcast": r"BroadcastExchange",
    "window": r"\bWindow\b",
    "python": r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas",
    "cartesian_or_nl": r"CartesianProduct|BroadcastNestedLoopJoin",
}


def main():
    from qtemplates.plans.catalog import QUERIES
    from qtemplates.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark("local[4]", 8, extra={"spark.sql.adaptive.enabled": "false",
                                          "spark.ui.showConsoleProgress": "false"})
    print("| query | " + " | ".join(KINDS) + " |")
    print("| --- |" + " --- |" * len(KINDS))
    for n in names:
        plan = QUERIES[n](spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(p, plan)) for p in KINDS.values()]
        print(f"| {n} | " + " | ".join(str(c) for c in counts) + " |", flush=True)


if __name__ == "__main__":
    main()
