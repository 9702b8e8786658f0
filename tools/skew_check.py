"""Stress the skew-safe operators on a generated table where one key holds a third of all rows.

Compares the stratified sampler with the plain window plan and the distributed median with Spark's
``median``, and prints timings. Usage: python tools/skew_check.py [rows]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main(n: int) -> None:
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from evalspark.operators import sampling
    from evalspark.operators.quantiles import distributed_median
    from evalspark.session import local_session, materialize

    spark = local_session(8, shuffle_partitions=32)
    hot = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise((F.col("id") % 50) + 1)
    df = materialize(spark.range(n).select(
        F.col("id").alias("example_id"), hot.cast("int").alias("s"),
        (F.rand(7) * 100 + F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11)).alias("v")))

    t = time.time()
    got = sampling.stratified_sample(df, ["s"], 0.01, seed=3).select("example_id")
    got_ids = {r.example_id for r in got.collect()}
    t_sample = time.time() - t

    t = time.time()
    quotas = sampling.largest_remainder(sampling.stratum_sizes(df, ["s"]), int(-(-0.01 * n // 1)))
    q = spark.createDataFrame([(k[0], v) for k, v in quotas.items()], "s int, _q long")
    rn = F.row_number().over(W.partitionBy("s").orderBy(sampling.order_key("example_id", 3), "example_id"))
    want_ids = {r.example_id for r in df.join(q, "s").withColumn("_rn", rn).filter("_rn <= _q").select("example_id").collect()}
    t_window = time.time() - t

    t = time.time()
    dm = {r.s: r.median for r in distributed_median(df, "v", ["s"]).collect()}
    t_dm = time.time() - t
    t = time.time()
    sm = {r.s: r.m for r in df.groupBy("s").agg(F.median("v").alias("m")).collect()}
    t_sm = time.time() - t
    print({"rows": n, "sample_equal": got_ids == want_ids, "sample_rows": len(got_ids),
           "sample_sec": round(t_sample, 2), "window_sec": round(t_window, 2),
           "median_equal": dm == sm, "distributed_median_sec": round(t_dm, 2), "map_median_sec": round(t_sm, 2)})


if __name__ == "__main__":
    main(int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000)
