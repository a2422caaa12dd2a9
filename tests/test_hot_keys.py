"""No step moves rows by the key alone: one key may hold most of them."""

from pyspark.sql import functions as F

from spanveil.operators import ordered


def test_rows_are_not_moved_by_their_key(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = []
        settled = ordered.settled
        monkeypatch.setattr(ordered, "settled", lambda df: (seen.append(df), settled(df))[1])
        rows = spark.range(500).select((F.col("id") % 2).alias("key"), (F.col("id") * 7 % 500).alias("at"), F.lit(3).cast("long").alias("n"))
        got = {(r.key, r["at"]): r.i for r in ordered.before(rows, ["at"], F.col("n")).collect()}
        assert all(got[k, a] == 3 * sum(x < a for q, x in got if q == k) for k, a in got)
        t = rows.select("key", F.col("at").alias("v"))
        after = ordered.first_after(rows.select("key", F.col("at").alias("q")), t)
        assert after.count() == 500
        joins = [line for df in [*seen, after] for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin [key#" in line and line.split("SortMergeJoin ")[1].split("]")[0].count("#") == 1]
        assert not joins
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
