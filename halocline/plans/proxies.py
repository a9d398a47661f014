"""Views of the engine's data model over the driver's tables: pairs, drifters, gridded fields, profiles, points, ridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_extendedprice").alias("obs"), (F.col("l_quantity") * F.col("p_retailprice")).alias("model"), F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("weight"))


def drifters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    angle = 2 * F.pi() * F.col("k") / 100
    golden = F.col("event_id") * 0.618034
    return e.select("event_id", F.col("user_id").alias("series_id"), "ts", "k", "value", (F.col("value") * F.cos(angle)).alias("u"), (F.col("value") * F.sin(angle)).alias("v"), (-98 + 18 * F.col("k") / 100).alias("lon"), (18 + 12 * (golden - F.floor(golden))).alias("lat"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("profile"), (F.col("l_quantity") * 10).alias("depth"), (25 - 100 * F.col("l_discount")).alias("temp"))
    return p.groupBy("profile", "depth").agg(F.min("temp").alias("temp"))


def grid(spark: SparkSession) -> DataFrame:
    """A regular field v = lon + lat + t on 20 x 15 points and 30 days."""
    n = spark.range(20 * 15 * 30)
    n = n.select((F.col("id") % 20).alias("i"), (F.floor(F.col("id") / 20) % 15).alias("j"), F.floor(F.col("id") / 300).alias("t"))
    return n.select("i", "j", "t", (F.col("i") - 98.0).alias("lon"), (F.col("j") + 18.0).alias("lat"), (F.col("i") - 98.0 + F.col("j") + 18.0 + F.col("t")).alias("v"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("snapshot"), (F.col("c_custkey") % 97).cast("double").alias("x"), (F.col("c_custkey") % 89).cast("double").alias("y"), (F.col("c_acctbal") / 1e4).alias("u"), (-F.col("c_acctbal") / 2e4).alias("v"))


def ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (1.6 + F.col("o_totalprice") / 50000).alias("l"), (((F.col("o_orderkey") * 37) % 201 - 100) / 100.0).alias("xi_bar"), (((F.col("o_orderkey") * 53) % 301 - 150) / 100.0).alias("omega_bar"), (24 + F.col("o_orderkey") % 200).alias("npoints"), F.when(F.col("o_custkey") % 2 == 0, "data").otherwise("noise").alias("kind"))


#: The same views for the SQL form of the queries.
SQL = {
    "v_pairs": "SELECT l_extendedprice AS obs, l_quantity * p_retailprice AS model, l_returnflag AS grp, l_quantity AS weight FROM lineitem JOIN part ON l_partkey = p_partkey",
    "v_drift": "SELECT *, value * cos(2 * pi() * k / 100) AS u, value * sin(2 * pi() * k / 100) AS v, -98 + 18 * k / 100.0e0 AS lon, 18 + 12 * (event_id * 0.618034e0 - floor(event_id * 0.618034e0)) AS lat FROM (SELECT event_id, user_id AS series_id, ts, CAST(json_extract(props, '$.k') AS INT) AS k, value FROM events)",
    "v_profile": "SELECT l_orderkey AS profile, l_quantity * 10 AS depth, min(25 - 100 * l_discount) AS temp FROM lineitem GROUP BY 1, 2",
    "v_grid": "SELECT i, j, t, i - 98.0e0 AS lon, j + 18.0e0 AS lat, i - 98.0e0 + j + 18.0e0 + t AS v FROM range(20) a(i), range(15) b(j), range(30) c(t)",
    "v_points": "SELECT c_custkey AS id, c_nationkey AS snapshot, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS y, c_acctbal / 1e4 AS u, -c_acctbal / 2e4 AS v FROM customer",
    "v_ridges": "SELECT o_orderkey AS id, 1.6e0 + o_totalprice / 50000 AS l, ((o_orderkey * 37) % 201 - 100) / 100.0e0 AS xi_bar, ((o_orderkey * 53) % 301 - 150) / 100.0e0 AS omega_bar, 24 + o_orderkey % 200 AS npoints, CASE WHEN o_custkey % 2 = 0 THEN 'data' ELSE 'noise' END AS kind FROM orders",
}


def with_views(sql: str) -> str:
    used = [f"{name} AS ({body})" for name, body in SQL.items() if name in sql]
    body = sql.strip()
    if not used:
        return body
    return f"WITH {', '.join(used)}, {body[5:]}" if body.startswith("WITH ") else f"WITH {', '.join(used)} {body}"
