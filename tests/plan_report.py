"""Print a markdown table of physical-plan shapes for the registered queries.

usage: python tests/plan_report.py [sf_dir]
Counts come from the executed (pre-AQE) plan of each query's final DataFrame;
planning-time jobs (vocabulary, hot-key check, cutoff passes) are not shown.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")


def shape(plan: str) -> dict:
    return {
        "hash exchanges": len(re.findall(r"Exchange hashpartitioning", plan)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "sort-merge joins": len(re.findall(r"SortMergeJoin", plan)),
        "python": len(re.findall(r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas", plan)),
    }


def main():
    import __spark_entry__ as E
    from rankline.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    skip = {"stream_insert", "stream_score", "train_rf", "train_gbt", "train_ordinal", "tune_gbt",
            "model_leaderboard", "score_batch", "feature_importance", "pca_features", "dq_report"}
    rows = []
    for k, fn in sorted(E.queries().items()):
        if k in skip:
            continue
        df = fn(spark, sf)
        rows.append((k, shape(df._jdf.queryExecution().executedPlan().toString())))
    cols = list(rows[0][1])
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for k, s in rows:
        print(f"| `{k}` | " + " | ".join(str(s[c]) for c in cols) + " |")


if __name__ == "__main__":
    main()
