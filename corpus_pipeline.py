"""From raw documents to packed sequences: toxicity, near-dedup, PII, mixing, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import common, mixing, packing, pii, simhash_wide, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5; it learns from the labelled documents of sf_dir."""
    common.small_batches(spark)
    model = toxicity.train(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return toxicity.keep(docs.select(COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (5-word shingles, a similarity of about 0.8 or more, by SimHash): that of the smallest doc_id, of rows with that id one, and a null id only where a component has no other.

    A row is known by its id and a digest of its other columns, so rows of unrelated texts that
    share an id, or have none, are told apart. The kept pairs grow with the corpus, so they meet
    the texts in a shuffled join at every size.
    """
    common.small_batches(spark)
    rest = F.to_json(F.struct("lang", "source", "n_chars"))
    docs = docs.select(COLUMNS).withColumn("digest", F.sha2(F.concat(F.coalesce(F.sha2("text", 256), F.lit("")), rest), 256))
    kept = common.stage(simhash_wide.representatives(docs), "kept-rows")
    pair = kept.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).hint("merge")
    out = docs.join(pair, F.expr("doc_id <=> _id AND digest = _digest"), "left_semi")
    return (out.dropDuplicates(["doc_id", "digest"]) if kept.where("n > 1").limit(1).count() else out).select(COLUMNS)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets and n_chars counted again."""
    common.small_batches(spark)
    out = pii.detect(docs, keep=("lang", "source"), clean=True)
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, and the first words of the document in service where a source's share ends.

    The schedule is cut at virtual time 1, where the budget is spent, so sorting it by that
    time would change no row; packing doesn't look at order, and texts are neither sorted nor shuffled.
    """
    mix = mixing.take(docs, ["doc_id", "text", "lang", "source"])
    takes = F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies").cast("int"))).otherwise(F.expr("array()").cast("array<int>"))
    each = mix.withColumn("take", F.explode(F.when(F.col("part") > 0, F.concat(takes, F.array(F.lit(0)))).otherwise(takes)))
    first = F.array_join(F.slice(F.filter(F.split("text", common.SPACE), lambda w: w != ""), 1, F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")
    text = F.when(F.col("take") > 0, F.col("text")).otherwise(first)
    return each.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of at most 4096 tokens."""
    common.small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", clean_toxicity),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models, hashes and tokenizers are beyond SQL; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
