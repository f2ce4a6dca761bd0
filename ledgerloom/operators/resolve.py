"""From raw card descriptors to brands: rules, then lookups, then fuzzy scores, for a catalog of distinct descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def keys(aliases: DataFrame) -> DataFrame:
    """kind, key, brand: aliases as they are and without blanks (of several brands the first by `place`), and as beginnings
    of a descriptor (of several the last by name)."""
    first = F.min_by("brand", "place").alias("brand")
    bare = F.regexp_replace("alias_norm", " ", "")
    return (
        aliases.groupBy(F.lit("exact").alias("kind"), F.col("alias_norm").alias("key")).agg(first)
        .union(aliases.groupBy(F.lit("compact").alias("kind"), bare.alias("key")).agg(first))
        .union(aliases.groupBy(F.lit("prefix").alias("kind"), F.col("alias_norm").alias("key")).agg(F.max("brand").alias("brand")))
    )


def looked_up(descs: DataFrame, aliases: DataFrame) -> DataFrame:
    """desc, found, whole: the brand of the first lookup that has one (the descriptor, the same without blanks, its first
    word, its longest beginning that is an alias), and whether the descriptor is an alias itself. One join for all."""
    words = F.split("desc", " ")
    one = lambda kind, order, key: F.struct(F.lit(kind).alias("kind"), F.lit(order).alias("order"), key.alias("key"))
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.struct(F.lit("prefix").alias("kind"), (100_000 - F.char_length(F.array_join(F.slice(words, 1, n), " "))).alias("order"), F.array_join(F.slice(words, 1, n), " ").alias("key")))
    starts = F.filter(starts, lambda x: F.char_length(x.key) < F.char_length("desc"))
    asked = F.concat(F.array(one("exact", 1, F.col("desc")), one("compact", 2, F.regexp_replace("desc", " ", "")), one("compact", 3, words[0])), starts)
    rows = descs.select("desc", F.inline(asked)).join(keys(aliases), ["kind", "key"])
    return rows.groupBy("desc").agg(F.min_by("brand", "order").alias("found"), F.max(F.col("kind") == "exact").alias("whole"))


def scored(pending: DataFrame, aliases: DataFrame, brands: DataFrame) -> DataFrame:
    """desc, mcc, brand, score, mcc_ok, runner_up, runner_up_score, unclear of descriptors that no lookup settles: the best
    two brands by the blend of similarities, a brand that the category code speaks against at a discount."""
    near = tx.top_aliases(pending.select("desc").distinct(), aliases.select("alias_norm").distinct())
    near = near.withColumn("pair", tx.pair_score_udf("desc", "alias", "cosine")).join(aliases.select(F.col("alias_norm").alias("alias"), "brand").distinct(), "alias")
    each = pending.join(near, "desc").join(brands, "brand").withColumn("mcc_ok", F.coalesce(F.array_contains("mcc_list", F.col("mcc")), F.lit(False)))
    each = each.withColumn("score", F.col("pair") * F.when(F.col("mcc_ok"), 1.0).otherwise(tx.MCC_PENALTY))
    per = each.groupBy("desc", "mcc", "brand", "ticker").agg(F.max(F.struct("score", "mcc_ok")).alias("s")).select("desc", "mcc", "brand", "ticker", "s.*")
    order = W.partitionBy("desc", "mcc").orderBy(F.col("score").desc(), "brand")
    two = per.select("*", F.row_number().over(order).alias("n"), *[F.lead(c).over(order).alias(f"next_{c}") for c in ("brand", "ticker", "score")]).where("n = 1")
    unclear = F.coalesce((F.col("next_ticker") != F.col("ticker")) & (F.col("score") - F.col("next_score") < tx.AMBIGUITY), F.lit(False))
    return two.select("desc", "mcc", "brand", "score", "mcc_ok", F.col("next_brand").alias("runner_up"), F.col("next_score").alias("runner_up_score"), unclear.alias("unclear"))


def resolved(catalog: DataFrame, aliases: DataFrame, brands: DataFrame, accept: float = tx.ACCEPT, review: float = tx.REVIEW) -> DataFrame:
    """desc, mcc, brand, ticker, score, method, decision, mcc_ok, runner_up, runner_up_score of each distinct (desc, mcc).

    catalog: desc (normalised), mcc; aliases: alias_norm, brand, place; brands: brand, ticker, mcc_list. A lookup counts only if
    the category code agrees, else the fuzzy scores decide. Null descriptors count as empty.
    """
    rows = catalog.select(F.coalesce("desc", F.lit("")).alias("desc"), "mcc").distinct().withColumn("rule", tx.merchant_of_record(F.col("desc")))
    ruled = rows.where("rule IS NOT NULL").select(
        "desc", "mcc", "rule.brand", F.when(F.col("rule.method") == "rule:empty", 0.0).otherwise(1.0).alias("score"), "rule.method", "rule.decision", (F.col("rule.method") != "rule:empty").alias("mcc_ok"),
        F.lit(None).cast("string").alias("runner_up"), F.lit(0.0).alias("runner_up_score"),
    )
    left = rows.where("rule IS NULL").select("desc", "mcc")
    hits = left.join(looked_up(left.select("desc").distinct(), aliases), "desc", "left").join(brands.select(F.col("brand").alias("found"), "mcc_list"), "found", "left")
    hits = hits.withColumn("settled", F.coalesce(F.array_contains("mcc_list", F.col("mcc")), F.lit(False)))
    exact = hits.where("settled").select("desc", "mcc", F.col("found").alias("brand"), F.when(F.col("whole"), 1.0).otherwise(0.99).alias("score"), F.lit("exact").alias("method"), F.lit("MATCH").alias("decision"), F.lit(True).alias("mcc_ok"), F.lit(None).cast("string").alias("runner_up"), F.lit(0.0).alias("runner_up_score"))
    pending = hits.where("NOT settled").select("desc", "mcc")
    best = pending.join(scored(pending, aliases, brands).withColumnsRenamed({"desc": "d", "mcc": "m"}), (F.col("desc") == F.col("d")) & F.col("mcc").eqNullSafe(F.col("m")), "left")
    score = F.coalesce("score", F.lit(0.0))
    decision = F.when((score >= accept) & F.col("mcc_ok") & ~F.col("unclear"), "MATCH").when(score >= review, "REVIEW").otherwise("NONE")
    fuzzy = best.select("desc", "mcc", "brand", F.round(score, 4).alias("score"), F.lit("fuzzy").alias("method"), decision.alias("decision"), F.coalesce("mcc_ok", F.lit(False)).alias("mcc_ok"), "runner_up", F.round(F.coalesce("runner_up_score", F.lit(0.0)), 4).alias("runner_up_score"))
    return ruled.union(exact).union(fuzzy).join(brands.select("brand", "ticker"), "brand", "left")


def review_queue(found: DataFrame, spend: DataFrame, most: int = 150, floor: float = 0.40) -> DataFrame:
    """What people look at: all REVIEW rows, and of the fuzzy NONE rows above `floor` the `most` with the largest spend.
    spend: desc, mcc, abs_spend."""
    s = found.join(spend, ["desc", "mcc"], "left").fillna({"abs_spend": 0.0})
    large = s.where((F.col("decision") == "NONE") & (F.col("method") == "fuzzy") & (F.col("score") >= floor)).orderBy(F.col("abs_spend").desc(), "desc", "mcc").limit(most)
    return s.where("decision = 'REVIEW'").unionByName(large)
