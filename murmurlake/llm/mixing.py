"""Mixing sources to target weights: tokens per source, repetition rates, then whole copies plus one Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_RE, guarded_join, written


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Weights repeat over sources in code-point order, null last. The sum of targets is share[0] / share[1] of all sizes.
    No target exceeds `most` times its source's size; what is cut is dealt again by weight until none is above. That end
    state is a water level: in ascending order of size by weight, a source is full while its cap lies under the level that
    the others would get. Everything is whole numbers until one last division, so any engine gets the same doubles.
    The table has one row for each source; only this summary is ordered as a whole.
    """
    lcm = 1
    for w in weights:
        lcm = lcm * w
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    big = lambda c: c.cast("decimal(38,0)")
    df = sizes.withColumn("weight", w.cast("bigint")).withColumn("level", big(F.col("source_size")) * F.expr(f"cast({lcm} div weight as decimal(9,0))"))
    before = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({"total": F.sum("source_size").over(all_), "all_w": F.sum("weight").over(all_), "size_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("weight").over(before), F.lit(0))})
    num, den = share
    left = lambda size: big(F.lit(num) * F.col("total")) - big(F.lit(den * most) * size)  # noqa: E731  den times what is left to deal
    full = big(F.lit(den * most) * F.col("source_size")) * (F.col("all_w") - F.col("w_before")) <= F.col("weight") * left(F.col("size_before"))
    df = df.withColumn("full", full)
    open_w = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_)
    full_size = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(all_), F.lit(0))
    dealt = (F.col("weight") * left(full_size)).cast("double") / (F.lit(den) * open_w).cast("double")
    return df.select("source", "source_size", F.when(F.col("full"), (F.lit(most) * F.col("source_size")).cast("double")).otherwise(dealt).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", most: int = 2, id_col: str = "doc_id", size: str | None = None, **targets) -> DataFrame:
    """docs plus size, source_size, target, copies (how often the mix takes the document) and taken (size times copies).

    copies is floor(rate) plus 1 with probability the rate's fraction, rate = target / source_size; the draw is the first
    52 bits of md5(seed:id), so reruns agree and repeated ids draw alike. Null or empty texts have size 0. Null sources form
    one source, the last. A source without words has target 0 and no copies; so do documents of an empty table. Columns
    that docs has besides stay, except those that carry the names above, which are replaced.
    """
    docs = docs.withColumn("size", F.col(f"`{size}`") if size else word_count()).drop("source_size", "target", "copies", "taken")
    sizes = written(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = written(source_targets(sizes, most=most, **targets).withColumn("_mix_has", F.col("source").isNotNull()).withColumn("_mix_key", F.coalesce("source", F.lit(""))).drop("source"))
    keyed = docs.withColumns({"_mix_has": F.col("source").isNotNull(), "_mix_key": F.coalesce("source", F.lit(""))})
    out = guarded_join(keyed, plan, ["_mix_has", "_mix_key"]).drop("_mix_has", "_mix_key")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
    whole = F.floor(rate)
    out = out.withColumn("copies", (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("bigint"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say, with copy_no from 0."""
    return mixed.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
