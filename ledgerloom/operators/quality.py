"""Parsing, expectations, quarantine and de-duplication of delivered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the data contract.
MIN_DATE, MAX_ABS_AMOUNT, CURRENCIES = "2010-01-01", 25000, ("USD",)


def parse(df: DataFrame, min_date: str = MIN_DATE, max_date: str | None = None, max_abs_amount: float = MAX_ABS_AMOUNT, currencies: tuple[str, ...] = CURRENCIES) -> DataFrame:
    """Typed columns (a bad value becomes null) and dq_reasons, the names of the rules that a row breaks."""
    day = lambda c: F.to_date(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd")))
    typed = df.select(
        "*", day("txn_date").alias("_txn_date"), day("post_date").alias("_post_date"), F.expr("try_cast(amount AS decimal(14,2))").alias("_amount"), F.expr("try_cast(mcc AS int)").alias("_mcc")
    )
    latest = F.lit(max_date).cast("date") if max_date else F.current_date()
    missing = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = {
        "missing_txn_id": missing("txn_id"),
        "missing_user_id": missing("user_id"),
        "bad_txn_date": F.col("_txn_date").isNull(),
        "txn_date_out_of_range": ~F.col("_txn_date").between(F.lit(min_date).cast("date"), latest),
        "bad_amount": F.col("_amount").isNull(),
        "amount_out_of_range": F.abs("_amount") > max_abs_amount,
        "bad_currency": ~F.coalesce("currency", F.lit("")).isin(*currencies),
        "missing_descriptor": missing("merchant_descriptor"),
        "bad_mcc": F.col("_mcc").isNull(),
    }
    # One row's reasons come out of a generator, which no filter on them is pushed below: rules are worked out once.
    return typed.select("*", F.explode(F.array(failed(rules))).alias("dq_reasons"))


def failed(rules: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that break no rule, typed; and the others as they came, with their reasons."""
    raw = [c for c in parsed.columns if not c.startswith("_txn") and c not in ("_post_date", "_amount", "_mcc", "dq_reasons")]
    good = parsed.where(F.size("dq_reasons") == 0)
    bad = parsed.where(F.size("dq_reasons") > 0).select(*raw, F.concat_ws(",", "dq_reasons").alias("dq_reasons"))
    typed = {"txn_date": "_txn_date", "post_date": "_post_date", "amount": "_amount", "mcc": "_mcc"}
    return good.select(*[F.col(typed.get(c, c)).alias(c) for c in raw]), bad


def numbered(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*key).orderBy(*order)))


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key. Spark cuts to candidates before it shuffles (window group limit)."""
    return numbered(df, key, order).where("_rn = 1").drop("_rn")


def keep_others(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """All but the first row of each key."""
    return numbered(df, key, order).where("_rn > 1").drop("_rn")
