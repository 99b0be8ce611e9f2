"""Document fingerprints by consistent weighted sampling: native DataFrame expressions only.

Terms are a text's words, weights their counts. For each sample k and term a gamma(2,1) step r, a gamma(2,1) value c and a
uniform shift b follow from one hash of (term, k). With t = floor(ln w / r + b), the term's value is a = c / exp(r (t + 1 - b));
the sample is (term, t) of the least a. Two texts share a sample with a probability equal to the generalised Jaccard similarity
of their weights, the sum of least counts over the sum of largest.

A gamma(2, 1) value is minus the logarithm of a product of two uniform numbers, so a sample costs two hashes and three logarithms
inside generated code. ln a, as 31 bits, and 32 bits of (term, t) are packed into one long, so that all samples of a text are plain
minima of one aggregation and no list of terms is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NULL_ID, written

def _uniform(bits: Column, start: int) -> Column:
    """A number inside (0, 1) from 20 of the bits."""
    return (F.shiftrightunsigned(bits, start).bitwiseAND(F.lit(0xFFFFF)).cast("double") + 0.5) / F.lit(float(2**20))


def _sample(k: int) -> Column:
    """The packed value of sample k for a row with term hash h, ln of its count lnw and the low half of h."""
    one, two = F.xxhash64("h", F.lit(2 * k)), F.xxhash64("h", F.lit(2 * k + 1))
    step = -F.log(_uniform(one, 0) * _uniform(one, 20))
    value = F.log(-F.log(_uniform(two, 0) * _uniform(two, 20)))
    shift = _uniform(two, 40)
    t = F.floor(F.col("lnw") / step + shift)
    ln_a = value - step * (t.cast("double") + 1.0 - shift)
    sign = (F.col("low") + t * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(F.floor((F.least(ln_a, F.lit(20.0)) + 100.0) * float(2**24)), 32).bitwiseOR(sign)


def fingerprints(texts: DataFrame, text_cols: tuple[str, str], samples: int = 36) -> DataFrame:
    """For each row and each of the two text_cols, `<col>_sig`: array of 16-bit samples; texts without words give no array.

    The other columns must tell the rows apart and stay; a row none of whose texts has words is missing. A term that both texts have
    equally often is sampled once for both: terms of the first text alone, of the second alone and of both are minimised apart
    (sides 1, 2, 3). Nothing is shuffled here if texts is dealt out by columns that stay, else (row, term, counts) is, never a text.
    """
    stay = [c for c in texts.columns if c not in text_cols]
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(F.col(c), F.lit("")).alias("t")) for i, c in enumerate(text_cols)])
    rows = texts.select(*stay, F.explode(sides).alias("s"))
    words = rows.select(*stay, "s.side", F.explode(F.split("s.t", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    terms = words.select(*stay, "side", F.xxhash64("word").alias("h")).groupBy(*stay, "h").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1"))
    part = lambda side, n: F.struct(F.lit(side).alias("side"), n.alias("n"))
    each = F.when(F.col("n0") == F.col("n1"), F.array(part(3, F.col("n0")))).otherwise(F.filter(F.array(part(1, F.col("n0")), part(2, F.col("n1"))), lambda x: x.n > 0))
    terms = terms.select(*stay, "h", F.explode(each).alias("x"))
    terms = terms.select(*stay, "x.side", "h", F.log(F.col("x.n").cast("double")).alias("lnw"), F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))
    mins = terms.groupBy(*stay, "side").agg(*[F.min(_sample(k)).alias(f"s{k}") for k in range(samples)])
    of = lambda i, k: F.min(F.when(F.col("side").isin(i + 1, 3), F.col(f"s{k}")))
    both = mins.groupBy(*stay).agg(*[of(i, k).alias(f"s{i}_{k}") for i in (0, 1) for k in range(samples)])
    short = lambda i: F.array(*[F.shiftrightunsigned(F.col(f"s{i}_{k}").bitwiseAND(F.lit(0xFFFFFFFF)), 16).cast("int") for k in range(samples)])
    return both.select(*stay, *[F.when(F.col(f"s{i}_0").isNotNull(), short(i)).alias(f"{c}_sig") for i, c in enumerate(text_cols)])


def likeness(a: str, b: str) -> Column:
    """The share of equal samples; 1 for two texts without words, 0 if one has none."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0), 0.0).otherwise(equal / n).cast("double")


def text_form(sig: str) -> Column:
    """Four hexadecimal digits for each sample."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("bigint"))), 4, "0")), "")


def next_keys(keys: DataFrame, parts: int) -> DataFrame:
    """keys (key distinct, ...) plus next_key, the least larger key, and for the largest the least.

    Keys are dealt by range; each part is numbered in itself, and only the first key of each part is ordered as a whole and broadcast:
    one row for each of `parts`.
    """
    ranged = written(keys.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    firsts = ranged.groupBy("part").agg(F.min("key").alias("first"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.withColumn("following", F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(whole))).select("part", "following")
    lead = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return ranged.withColumn("lead", lead).join(F.broadcast(firsts), "part").withColumn("next_key", F.coalesce("lead", "following")).drop("lead", "following", "part")


def fingerprint_with_neighbours(docs: DataFrame, samples: int = 36, id_col: str = "doc_id") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    edited: the last quarter (rounded down) of the code points replaced by the first as many, or all, of the next document by
    ascending id; after the last comes the first. Null texts are empty. A null id comes before all others. Rows that repeat
    an id are fingerprinted each; for their predecessor the least text among them (by its samples for near_next) is next, and
    all of them have the same next document.
    """
    spark = docs.sparkSession
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keys = base.groupBy("key").agg(F.max(F.length("text")).alias("longest"), F.count("*").alias("times"))
    shuffled = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    after = written(next_keys(keys, shuffled))
    most = after.agg(F.max("times")).first()[0] or 0
    base = base.repartition(4 * shuffled, "key")  # texts move once; both joins and all aggregation by text reuse this
    right = after.select(F.col("key").alias("for_key"), "next_key", "longest")
    heads = base.join(right, F.col("key") == F.col("next_key")).select("for_key", F.substr("text", F.lit(1), F.floor(F.col("longest") / 4).cast("int")).alias("head"))
    if most > 1:
        heads = heads.groupBy("for_key").agg(F.min("head").alias("head"))
    whole = base.join(heads, F.col("key") == F.col("for_key"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    whole = whole.select("key", F.xxhash64("text").alias("th"), n.cast("long").alias("n_chars"), "text", F.concat(F.substr("text", F.lit(1), n - cut), F.substr("head", F.lit(1), cut)).alias("edited"))
    facts = whole.select("key", "th", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    once = whole.dropDuplicates(["key", "th"]) if most > 1 else whole
    sigs = fingerprints(once.select("key", "th", "text", "edited"), ("text", "edited"), samples).withColumnRenamed("text_sig", "sig")
    none = F.array().cast("array<int>")
    done = facts.join(sigs, ["key", "th"], "left").withColumns({"sig": F.coalesce("sig", none), "edited_sig": F.coalesce("edited_sig", none)})
    done = written(done)
    firsts = after.select(F.col("key").alias("for_key"), "next_key").join(done.groupBy("key").agg(F.min("sig").alias("next_sig")), F.col("next_key") == F.col("key")).select("for_key", "next_sig")
    out = done.join(firsts, F.col("key") == F.col("for_key"))
    return out.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias(id_col),
        "n_chars",
        "edited_sha256",
        text_form("sig").alias("fingerprint"),
        text_form("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
