"""A simulated panel. Every draw is a hash of ids and a seed, so rows are the same however they are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(*parts, seed: int = 0) -> Column:
    """A number in (0, 1) for the parts' values."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)) + 0.5) / float(1 << 53)


def normal(*parts, seed: int = 0) -> Column:
    """Standard normal (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(*parts, seed=seed))) * F.cos(6.283185307179586 * uniform(*parts, seed=seed + 1_000_003))


def pick(u: Column, weights: dict[str, float]) -> Column:
    """A name by its weight, from a uniform number."""
    names, total = list(weights), sum(weights.values())
    out = F.lit(names[-1])
    for k in range(len(names) - 2, -1, -1):
        out = F.when(u < sum(weights[x] for x in names[: k + 1]) / total, F.lit(names[k])).otherwise(out)
    return out


def poisson(u: Column, mean: Column | float, most: int = 20) -> Column:
    """A count by inversion: how many terms of the distribution stay below a uniform number."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    first = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("n"))
    step = lambda a, k: F.when(u > a.below, F.struct((a.p * mean / k).alias("p"), (a.below + a.p * mean / k).alias("below"), (a.n + 1).alias("n"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), first, step).n


def exponential(u: Column, mean: float) -> Column:
    return -F.ln(u) * mean


def code(*parts, seed: int = 0, size: int = 6) -> Column:
    """A reference code of digits and capitals."""
    return F.upper(F.substring(F.lpad(F.conv(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, 36), 13, "0"), -size, size))


def world(spark: SparkSession, brands: list[str], start: str) -> DataFrame:
    """brand, ticker, mcc, weight, valid_from, valid_to: each company owns two brands, and the last brand changes hands."""
    codes = (5411, 5812, 5311, 5999)
    rows = [(b, f"T{k // 2}", codes[k % 4], 1.0 / (k + 1), k) for k, b in enumerate(brands)]
    w = spark.createDataFrame(rows, "brand string, ticker string, mcc int, weight double, k int")
    begin, end = F.lit(start).cast("date"), F.lit("2099-12-31").cast("date")
    sold = (F.col("k") == len(brands) - 1) & F.lit(len(brands) > 1)
    w = w.withColumn("when", F.explode(F.when(sold, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    change = F.date_add(begin, 180)
    return w.select(
        "brand", F.when(F.col("when") == 1, "T0").otherwise(F.col("ticker")).alias("ticker"), "mcc", "weight",
        F.when(F.col("when") == 1, change).otherwise(begin).alias("valid_from"), F.when(sold & (F.col("when") == 0), F.date_sub(change, 1)).otherwise(end).alias("valid_to"),
    )


#: Faults of a delivery: type, source, brand (null: all), first day and number of days, both counted from the panel's start.
FAULTS = [("outage", "SRC_1", None, 100, 4), ("unit_error", "SRC_2", None, 130, 3), ("volume_drop", "SRC_0", None, 150, 4), ("duplicate_delivery", "SRC_4", None, 60, 1), ("tagging_break", "SRC_3", 0, 160, 10_000)]


def fault_log(spark: SparkSession, brands: list[str], start: str, days: int, faults: list[tuple] = FAULTS) -> DataFrame:
    """type, source, brand, start, end of the faults that fall into the panel's days: the truth that detectors are held to."""
    rows = [(kind, source, None if b is None else brands[b], first, min(first + n, days) - 1) for kind, source, b, first, n in faults if first < days]
    log = spark.createDataFrame(rows, "type string, source string, brand string, a int, z int")
    at = lambda c: F.date_add(F.lit(start).cast("date"), F.col(c))
    return log.select("type", "source", "brand", at("a").alias("start"), at("z").alias("end"))


def delivered(t: DataFrame, log: DataFrame, seed: int = 50) -> DataFrame:
    """Transactions as vendors deliver them: strings, in each source's way of writing, with the faults of the log, some
    malformed rows and some rows delivered again. Columns `is_malformed` and `delivery` say which; a duplicate is a
    re-delivery. The log is one row a fault, so it is broadcast."""
    u = lambda k: uniform("txn_id", seed=seed + k)
    hit = F.broadcast(log.select("type", F.col("source").alias("s"), F.col("brand").alias("b"), "start", "end"))
    on = (F.col("source") == F.col("s")) & F.col("txn_date").between(F.col("start"), F.col("end")) & (F.col("b").isNull() | (F.col("b") == F.col("brand")))
    j = t.join(hit, on, "left").withColumn("type", F.coalesce("type", F.lit("")))
    j = j.where((F.col("type") != "outage") & ~((F.col("type") == "volume_drop") & (u(1) < 0.75)))
    style = F.pmod(F.xxhash64("source"), F.lit(4))
    name, ref = F.upper("brand"), code("txn_id", seed=seed)
    text = F.when(style == 0, F.concat(F.lit("SQ *"), name, F.lit(" "), ref)).when(style == 1, F.concat(F.lit("POS PURCHASE "), name, F.lit(" #"), F.substring(ref, 1, 4), F.lit(" DALLAS TX"))).when(style == 2, F.concat(name, F.lit(".COM/"), ref)).otherwise(F.concat(name, F.lit(" XXXX1234")))
    text = F.when(F.col("type") == "tagging_break", F.concat(F.lit("ACQ "), F.lower(ref), F.lit(" PAYMENT"))).otherwise(text)
    bad = u(2) < 0.002
    raw = j.select(
        "txn_id", F.col("user_id").cast("string").alias("user_id"), F.when(bad & (u(3) < 0.5), "2024-13-45").otherwise(F.col("txn_date").cast("string")).alias("txn_date"), F.col("post_date").cast("string").alias("post_date"),
        F.when(bad & (u(3) >= 0.5), F.lit("12.3O")).otherwise((F.col("amount") * F.when(F.col("type") == "unit_error", 100).otherwise(1)).cast("decimal(14,2)").cast("string")).alias("amount"),
        F.lit("USD").alias("currency"), text.alias("merchant_descriptor"), F.col("mcc").cast("string").alias("mcc"), F.lit("daily").alias("delivery"), "source", "brand", bad.alias("is_malformed"), "type",
    )
    again = raw.where((F.col("type") == "duplicate_delivery") | (u(4) < 0.003)).withColumn("delivery", F.lit("redelivery"))
    return raw.unionByName(again).drop("type")


def members(spark: SparkSession, n: int, start: str, days: int, seed: int = 1) -> DataFrame:
    """user_id, source, age, income, region, join_date, leave_date: half join at once, others trickle in; tenures are
    exponential, and a few leave without notice."""
    m = spark.range(n).withColumnRenamed("id", "user_id")
    u = lambda k: uniform("user_id", seed=seed + k)
    joined = F.date_add(F.lit(start).cast("date"), F.when(u(1) < 0.5, 0).otherwise(F.floor(u(2) * days)).cast("int"))
    left = F.date_add("join_date", (F.floor(-F.ln(u(3)) * days) + 1).cast("int"))
    m = m.select(
        "user_id", F.concat(F.lit("SRC_"), F.floor(u(4) * 5).cast("string")).alias("source"), pick(u(5), {"18-34": 0.30, "35-54": 0.33, "55+": 0.37}).alias("age"),
        pick(u(6), {"low": 0.38, "mid": 0.30, "high": 0.32}).alias("income"), pick(u(7), {"NE": 0.17, "MW": 0.21, "S": 0.38, "W": 0.24}).alias("region"), joined.alias("join_date"), (u(8) < 0.05).alias("silent"),
    )
    end = F.date_add(F.lit(start).cast("date"), days)
    return m.withColumn("leave_date", F.when(left < end, left))


def transactions(people: DataFrame, brands: list[str] | DataFrame, start: str, days: int, rate: float = 0.2, seed: int = 2) -> DataFrame:
    """A row a purchase. A member's purchases of a day are a Poisson count, more of them at the week's end; amounts are
    lognormal, 1.2 % are refunds, some posts come late. brands: names of equal weight, or a table brand, mcc, weight of a
    bounded number of brands."""
    table = [(b, 5411, 1.0) for b in brands] if isinstance(brands, list) else [tuple(r) for r in brands.select("brand", "mcc", "weight").distinct().orderBy("brand").collect()]
    weights, codes = {b: w for b, _, w in table}, F.create_map(*[F.lit(x) for b, m, _ in table for x in (b, m)])
    end = F.date_add(F.lit(start).cast("date"), days - 1)
    last = F.least(F.coalesce(F.date_sub("leave_date", 1), end), end)
    day = people.where(F.col("join_date") <= last).withColumn("txn_date", F.explode(F.sequence("join_date", last)))
    u = lambda k: uniform("user_id", "txn_date", "n", seed=seed + k)
    season = F.element_at(F.lit([0.9, 0.9, 0.95, 1.0, 1.15, 1.25, 0.85]), F.weekday("txn_date") + 1)
    count = poisson(uniform("user_id", "txn_date", seed=seed + 1), season * rate)
    t = day.withColumn("count", count).where("count > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("count"))))
    t = t.withColumn("brand", pick(u(2), weights))
    amount = F.exp(3 + 0.6 * normal("user_id", "txn_date", "n", seed=seed + 3)) * F.when(u(4) < 0.012, -1).otherwise(1)
    return t.select(
        F.concat_ws("-", "user_id", "txn_date", "n").alias("txn_id"), "user_id", "source", "txn_date", F.date_add("txn_date", F.floor(u(5) * 4).cast("int")).alias("post_date"), F.round(amount, 2).alias("amount"),
        "brand", F.element_at(codes, F.col("brand")).alias("mcc"), "age", "income", "region",
    )
