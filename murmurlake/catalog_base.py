"""What the driver's tables stand for.

Documents are texts, conversations are meetings (conv_id, turn, role, with times from text lengths), orders are jobs with lineitems as
actions and suppliers as assignees, region/nation/segment is a folder path, events are sound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .operators import jobs

TODAY = "1998-06-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark, sf_dir) -> DataFrame:
    """Conversations as timed rows: 15 characters a second."""
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").alias("meeting_id"), F.col("turn").cast("int").alias("idx"), F.col("role").alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("meeting_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    chars = F.sum(F.length("text")).over(w)
    return rows.withColumns({"start": (chars - F.length("text")) / 15.0, "end": chars / 15.0}).withColumn("name", F.initcap("speaker"))


def turns(spark, sf_dir) -> DataFrame:
    """Fixed 7-second turns of three voices over each meeting."""
    ends = utterances(spark, sf_dir).groupBy("meeting_id").agg(F.ceil(F.max("end") / 7).cast("int").alias("n"))
    each = ends.where("n > 0").select("meeting_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select("meeting_id", (F.col("i") * 7.0).alias("start"), (F.col("i") * 7.0 + 7.0).alias("end"), F.pmod(F.col("i") * F.col("i") + F.col("meeting_id"), F.lit(3)).cast("int").alias("speaker"))


def job_rows(spark, sf_dir) -> DataFrame:
    """Orders as jobs: nested actions from line items, folder from region, nation and market segment."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name")
    folders = c.join(F.broadcast(place), c["c_nationkey"] == place["n_nationkey"]).select("c_custkey", "c_name", F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("category"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", action_struct().alias("a"))
    each = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "a"))).alias("s")).select("l_orderkey", F.transform("s", lambda x: x.a).alias("actions"))
    rows = o.join(folders, o["o_custkey"] == folders["c_custkey"]).join(each, o["o_orderkey"] == each["l_orderkey"], "left")
    return rows.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), "category", F.col("o_orderdate").cast("date").cast("string").alias("updated_at"), F.col("o_orderstatus").alias("summary"), F.col("o_orderpriority").alias("notes"), "actions", F.col("o_totalprice").alias("price"))


def action_struct():
    return F.struct(F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_linestatus") == "F").alias("done"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("assignee"), F.col("l_shipdate").cast("date").cast("string").alias("due"))


def actions(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tasks = p.select(F.col("p_partkey").alias("id"), F.lit("Egna").alias("category"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("text"), (F.col("p_size") % 2 == 0).alias("done"), F.lit(None).cast("string").alias("assignee"), F.lit("snart").alias("due"))
    return jobs.all_actions(job_rows(spark, sf_dir), tasks)


def signals(spark, sf_dir) -> DataFrame:
    """Each user's event values as two signals, of even and odd event ids, in order of the id."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("user_id", F.struct("event_id", (F.col("value") / 100.0).alias("v")).alias("s"), (F.col("event_id") % 2).alias("odd"))
    part = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("odd") == k, F.col("s")))), lambda x: x.v)
    return e.groupBy("user_id").agg(part(0).alias("a"), part(1).alias("b"))


def recordings(spark, sf_dir, most: int = 4096) -> DataFrame:
    """Each user's values as a recording of two samples a second in one piece, longer than any chunk, and again as a second piece.

    A piece is the two signals and then both reversed. It comes in slices of at most so many samples (piece, at, ends), so that no user's
    values are gathered in one row; one task still ranks them, sorted and spilled, as one task has to cut a recording.
    """
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND event_id % 2 IN (0, 1)").select("user_id", "event_id", (F.col("value") / 100.0).alias("v"), (F.col("event_id") % 2).alias("odd"))
    user = Window.partitionBy("user_id")
    ranked = e.select("user_id", "odd", "v", F.row_number().over(user.orderBy("odd", "event_id", "v")).alias("i"), F.count("*").over(user).alias("n"), F.sum("odd").over(user).alias("n_odd"))
    k = F.floor((F.col("i") - 1 - F.when(F.col("odd") == 1, F.col("n") - F.col("n_odd")).otherwise(0)) / most)
    parts = ranked.groupBy("user_id", "odd", k.alias("k")).agg(F.first("n").alias("n"), F.first("n_odd").alias("n_odd"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x.v).alias("s"))
    last = (F.col("k") == 0) & ((F.col("odd") == 1) | (F.col("n_odd") == 0))
    slices = [
        F.struct(F.lit(piece).alias("piece"), (F.col("n") * float(piece)).alias("start_s"), (F.col("odd") * 2**40 + 2 * back * 2**40 + (-F.col("k") if back else F.col("k"))).alias("at"), (F.reverse("s") if back else F.col("s")).alias("samples"), (last if back else F.lit(False)).alias("ends"))
        for piece in (0, 1)
        for back in (0, 1)
    ]
    return parts.select(F.col("user_id").cast("string").alias("source"), F.lit(2).alias("rate"), F.inline(F.array(*slices)))


def stamp_sql(x: str, mark: str = ".") -> str:
    ms = f"round({x} * 1000)::BIGINT"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def turns_sql(utterances: str) -> str:
    """CTE g(meeting_id, idx, cluster): the voice with the most overlap of each utterance, from turns()."""
    return utterances + """, e AS (
  SELECT meeting_id, ceil(max("end") / 7)::INT AS n FROM u GROUP BY meeting_id
), t AS (
  SELECT meeting_id, i * 7.0::DOUBLE AS s, i * 7.0::DOUBLE + 7.0 AS e, ((i * i + meeting_id) % 3)::INT AS cluster FROM (SELECT meeting_id, unnest(range(0, n)) AS i FROM e WHERE n > 0)
), o AS (
  SELECT u.meeting_id, u.idx, t.cluster, sum(least(u."end", t.e) - greatest(u."start", t.s)) AS overlap FROM u JOIN t ON u.meeting_id = t.meeting_id AND u."start" < t.e AND t.s < u."end" GROUP BY ALL
), best AS (
  SELECT meeting_id, idx, cluster FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY meeting_id, idx ORDER BY overlap DESC, cluster) = 1
), g AS (
  SELECT u.meeting_id, u.idx, best.cluster FROM u LEFT JOIN best ON u.meeting_id = best.meeting_id AND u.idx = best.idx
)"""
