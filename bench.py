"""Time headline queries of every operator family; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores.  Each query is run
to completion through the no-op sink; queries that write frames while they are
built (ranks, duplicates) are timed with that work.
"""

from __future__ import annotations

import json
import os
import time

from tallyworks.plans import QUERIES
from tallyworks.session import local_session

HEADLINES = (
    "agg_01_outlet_features",
    "rul_01_opportunity_score",
    "set_01_merge_feeds",
    "ts_06_errors",
    "ts_12_top_outlet_forecast",
    "agg_04_brand_rollup",
    "agg_09_supplier_aggression",
    "act_01_rising",
    "rul_03_document_type",
    "rul_02_relevance",
    "jn_13_near_duplicates",
    "txt_02_chunks",
    "txt_04_token_jaccard",
    "txt_08_records",
    "rul_19_url_policy",
    "vec_01_top_k",
    "vec_03_group_match_all",
    "rul_09_verification_report",
    "rul_10_building_scrutiny",
    "rul_15_bid_evaluation",
    "rul_17_draft_validation",
    "agg_41_state_dashboard",
    "geo_03_point_in_polygon",
    "geo_05_nearest_road",
    "grf_02_edge_explorer",
    "ml_03_isolation_forest",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_custkey").count().count()  # start-up
    QUERIES[HEADLINES[0]](spark, folder).count()  # so that the first timing holds no code generation of Spark's own
    took: dict[str, float] = {}
    for name in HEADLINES:
        if name not in QUERIES:
            continue
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
