"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Indicators are built and published once (`publish`); the queries that match observables then read that version, as lookups do. Each
query runs once, in this order, after one small query that warms the session up; so its seconds hold its own planning and code
generation. rates: contributions a second through normalising, merging and flattening; observables a second through match and
policy, and through the match alone; seconds of a fold for each thousand changed rows.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")


def main() -> None:
    from pyspark.sql import SparkSession

    from palisade import queries as Q

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}

    def timed(name, make):
        began = time.perf_counter()
        out = make()
        if hasattr(out, "write"):
            out.write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        return out

    Q.masks(spark, sf).write.format("noop").mode("overwrite").save()
    timed("merge_identity", lambda: Q.merge_identity(spark, sf))
    indicators = Q.part_indicators(spark, sf)
    timed("flatten_ranges", lambda: Q.flatten_ranges(spark, sf, indicators))
    at = timed("publish", lambda: Q.published(spark, sf))
    six = Q.six_indicators(spark, sf)
    timed("match_ipv4_range", lambda: Q.match_ipv4_range(spark, sf, at.indicators))
    timed("match_ipv4_disjoint", lambda: Q.match_ipv4_disjoint(spark, sf, at.ranges4))
    timed("match_strings", lambda: Q.match_strings(spark, sf, at.indicators))
    timed("match_ipv6_range", lambda: Q.match_ipv6_range(spark, sf, six))
    timed("overlay_policy", lambda: Q.overlay_policy(spark, sf, at))
    timed("event_fold", lambda: Q.event_fold(spark, sf, at))
    timed("prevalence_lookup", lambda: Q.prevalence_lookup(spark, sf))
    timed("fold_withdraw", lambda: Q.fold_withdraw(spark, sf))
    rows = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").count()
    parts, events = rows("part"), rows("events")
    rates = {
        "contributions_per_s": parts / (took["merge_identity"] + took["flatten_ranges"]), "policy_observables_per_s": events / took["overlay_policy"], "ipv4_observables_per_s": events * 3 / 4 / took["match_ipv4_disjoint"],
        "string_observables_per_s": events / 4 / took["match_strings"], "fold_s_per_1000_changes": took["fold_withdraw"] / (events / 2 / 1000),
    }
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "runs": 1, "rates": {k: round(v, 4) for k, v in rates.items()}}))


if __name__ == "__main__":
    main()
