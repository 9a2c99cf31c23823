"""Text and document scans, resumable and streaming ingestion, frozen-table hand-over.

Files these plans write themselves go to the shared folder (see operators/materialise.py).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skylattice.operators.materialise import shared_folder
from skylattice.plans import views as v
from skylattice.plans.registry import query
from skylattice.sources import freeze, tables
from skylattice.streaming import ingest


@query("SELECT p_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def text_table_roundtrip(spark, sf):
    """Semicolon-separated text written and scanned back with an explicit schema."""
    path = f"{shared_folder(spark)}/parts"
    v.table(spark, sf, "part").write.option("header", True).option("sep", ";").csv(path)
    t = tables.read_text_table(spark, path, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", sep=";")
    return t.groupBy("p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("size"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT r_name AS season, count(*) AS n, round(avg(s_acctbal), 4) AS e, round(min(s_acctbal), 4) AS lo, round(max(s_acctbal), 4) AS hi FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def result_documents(spark, sf):
    """Nested result documents: written as JSON with a map of structs, read back and unnested."""
    j = (v.table(spark, sf, "supplier").join(v.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
         .join(v.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))
    per = j.groupBy("r_name").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("e"), F.array(F.min("s_acctbal"), F.max("s_acctbal")).alias("ci"))
    # one entry per season: a result document, not a data table
    doc = per.agg(F.map_from_entries(F.collect_list(F.struct("r_name", F.struct("n", "e", "ci")))).alias("seasons"))
    path = f"{shared_folder(spark)}/results"
    doc.write.json(path)
    back = tables.map_rows(tables.read_result(spark, path, "seasons map<string, struct<n: bigint, e: double, ci: array<double>>>"), "seasons", "season", "r")
    return back.select("season", "r.n", F.round("r.e", 4).alias("e"), F.round(F.col("r.ci")[0], 4).alias("lo"), F.round(F.col("r.ci")[1], 4).alias("hi"))


@query("SELECT event_type AS product, strftime(ts, '%Y-%m') AS month, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY ALL")
def partitioned_scan(spark, sf):
    """Observation table partitioned by product and month, scanned with partition pruning."""
    path = f"{shared_folder(spark)}/obs"
    o = v.observations(spark, sf).withColumn("month", F.date_format("ts", "yyyy-MM"))
    o.write.partitionBy("product", "month").parquet(path)
    s = tables.read_observations(spark, path, "click", ("2024-01", "2024-02"))
    return s.groupBy("product", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)")
def pending_partitions(spark, sf):
    """Days not yet materialised, by anti join with the finished keys."""
    cand = v.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    done = v.table(spark, sf, "lineitem").where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).select(F.to_date("l_shipdate").alias("day"))
    return ingest.pending(cand, done, ["day"])


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def incremental_ingest(spark, sf):
    """Streamed files, deduplicated on re-delivery, stored per day; the stored table equals the batch table.

    The file is delivered twice: the second copy adds nothing.
    """
    base = shared_folder(spark)
    e = v.table(spark, sf, "events")
    schema = e.schema
    for part in ("first", "again"):
        e.write.mode("append").parquet(f"{base}/landing/{part}")
        s = ingest.watch_files(spark, f"{base}/landing/*", schema).withColumn("day", F.to_date("ts"))
        ingest.ingest(s, f"{base}/stored", f"{base}/checkpoint", "day", key="event_id").awaitTermination()
    t = spark.read.parquet(f"{base}/stored")
    return t.groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT date_trunc('day', ts) AS day_start, count(*) AS n_all, count(CASE WHEN value > 20 THEN 1 END) AS n_valid FROM events GROUP BY 1")
def streaming_daily_counts(spark, sf):
    """Per-day counts kept current by a stream over the event files."""
    base = shared_folder(spark)
    s = ingest.watch_files(spark, sf, v.table(spark, sf, "events").schema, pattern="events.parquet").withColumn("valid", F.col("value") > 20)
    ingest.daily_counts(s, "ts", "valid", f"{base}/counts", f"{base}/checkpoint").awaitTermination()
    return ingest.latest_counts(spark, f"{base}/counts")


@query("SELECT p_type, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def frozen_hand_over(spark, sf):
    """Table frozen with its fingerprint, gated on reopening, then used."""
    path = shared_folder(spark)
    stored = freeze.write_frozen(v.table(spark, sf, "part"), path, [F.count_distinct("p_type").alias("types")])
    fp = freeze.fingerprint(stored).first()
    t = freeze.open_frozen(spark, path, fp["digest_sum"], fp["digest_xor"])
    return t.groupBy("p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))
