"""A corpus from raw documents to token ids, in stages that each read what the one before kept.

1 quality: documents that a quality rule rejects go.
2 near_duplicates: of each group of near copies (SimHash fingerprints within a radius, confirmed by a five-word Jaccard
  similarity of 0.8 at least) the document with the smallest id stays; rows are told apart by id and text, so rows with
  one id or none are only dropped as copies.
3 personal_data: personal data in texts is masked.
4 mix: documents are taken, in whole or in part, up to twice, so that sources have their target weights.
5 tokens: texts are encoded to ids of a byte-level BPE vocabulary; each row has its ids as bytes and their number.

Null texts have no word, so the first stage rejects them; an empty table stays empty through all stages; columns other
than those of documents are carried along up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm import byte_bpe, mixing, near_copies, pii, quality_rules
from ledgerloom.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # What a row is known by: its text and its id. Its columns move as one struct, so their names clash with nothing.
    key, docs_id = ["node", "id", "none"], F.col("doc_id").cast("long")
    names = [near_copies.node().alias("node"), F.coalesce(docs_id, F.lit(0).cast("long")).alias("id"), docs_id.isNull().alias("none")]
    rows = docs.select(*names).distinct()
    roots = near_copies.groups(docs)
    named = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # A group's least is a minimum, so a group of any size is aggregated before it moves.
    stay = named.groupBy("root").agg(F.min(F.struct("none", "id", "node")).alias("best")).select("best.node", "best.id", "best.none")
    keyed = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), *names)
    # Of rows alike in id and text one is left, cut before they move; the join deals by the window's keys, so texts move once.
    rest = F.xxhash64(F.to_json(F.struct(*[F.col(f"row.`{x}`") for x in docs.columns if x != "text"])))
    first = keyed.withColumn("first", F.row_number().over(W.partitionBy(*key).orderBy(rest))).where("first = 1")
    return first.join(stay, key, "left_semi").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix", mix), ("tokens", tokens)]

#: SQL can't express SimHash's links; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
