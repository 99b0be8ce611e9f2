"""A corpus pipeline: toxicity, MinHash near-dedup, substring dedup, mixing sources to target weights, best-fit packing.

Each stage takes the documents that its predecessor kept and returns the columns of documents; the last returns packed pieces.
Every stage works on whole texts of all its rows; clean documents pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.llm import minhash, mixing, packing, substring_tree, toxicity
from murmurlake.llm.common import WORD_RE, guarded_join, pick, release, scratch_mark, written
from murmurlake.llm.queries import table, tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon's score marks as toxic go. The lexicon is learned from the labelled rows of these documents."""
    lexicon = toxicity.learn(*toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return pick(toxicity.score_texts(docs, lexicon, keep=COLUMNS).where("predicted = 0"), *COLUMNS)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) one row stays: that of the smallest doc_id, null before all.

    Nodes are hashes of (doc_id, text), so rows that share an id, or have none, are judged each by its own text; of rows that
    repeat both, one stays. Rows without words resemble nothing and all stay.
    """
    rows = pick(docs, *COLUMNS).withColumn("node", F.xxhash64("doc_id", "text"))
    again = written(rows.where(F.coalesce("text", F.lit("")).rlike(WORD_RE)).groupBy("node").count().where("count > 1").select("node"))
    texts = rows.select("node", "text")
    repeats = not again.isEmpty()
    if repeats:  # a node is to be one row below
        repeated = guarded_join(texts, again, ["node"], "left_semi", max_rows=200_000).dropDuplicates(["node"])
        texts = guarded_join(texts, again, ["node"], "left_anti", max_rows=200_000).unionByName(repeated)
    found = written(minhash.near_duplicates(texts, k=5, id_col="node").where("n_shingles > 0").select("node", "component_id"))
    many = written(found.groupBy("component_id").count().where("count > 1").select("component_id"))
    members = guarded_join(found, many, ["component_id"], "left_semi", max_rows=200_000).select("node", "component_id")
    members = written(members.union(found.join(again, "node", "left_semi").select("node", "component_id")).distinct() if repeats else members)

    order = ("doc_id", "lang", "source", "n_chars", "node")
    alike = guarded_join(rows.drop("text"), members, ["node"], max_rows=200_000).groupBy("component_id", *order).agg(F.count("*").alias("copies"))
    stays = written(alike.groupBy("component_id").agg(F.min(F.struct(*order, "copies")).alias("first")).select(F.col("first.node").alias("node"), "first"))
    marks = written(guarded_join(members, stays, ["node"], "left", max_rows=200_000).select("node", "first"))
    own = F.struct(*order[:-1]).eqNullSafe(F.struct(*[F.col(f"first.{c}") for c in order[:-1]]))
    left = guarded_join(rows, marks.withColumn("grouped", F.lit(True)), ["node"], "left", max_rows=200_000).where(F.col("grouped").isNull() | F.col("first").isNotNull() & own)
    single = F.coalesce(F.col("first.copies"), F.lit(1)) == 1
    out = pick(left.where(single), *COLUMNS)
    if not repeats:
        return out
    return out.unionByName(pick(left.where(~single).dropDuplicates(["node"]), *COLUMNS))


def passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 and more that a smaller doc_id has too go; documents of which nothing is left go."""
    found = substring_tree.without_repeats(pick(docs, *COLUMNS), window=50, carry=("lang", "source"))
    found = found.where("n_removed < n_words or n_words = 0")
    return found.select("doc_id", F.col("cleaned").alias("text"), "lang", "source", F.length("cleaned").cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target says; copies are rows with the same doc_id."""
    return pick(mixing.repeated(mixing.mix(pick(docs, *COLUMNS))), *COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences; token ids as their CRC-32."""
    out = packing.pack_documents(docs, tokenizer_path(), capacity=2048, end_id=0, digest=True)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxic_out),
    ("minhash near-dedup", near_copies_out),
    ("substring dedup", passages_out),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: Several stages have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        mark = scratch_mark()
        docs = written(stage(spark, docs, sf_dir))
        release(spark, mark, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
