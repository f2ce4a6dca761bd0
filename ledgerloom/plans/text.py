"""Entity-resolution and text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.views import alias, brand, descriptor, load
from .notes import ADVICE_PATTERN
from .registry import query

NORM = f"norm AS (SELECT p_partkey, p_name, brand, raw, mcc, {tx.normalize_sql('raw')} AS norm FROM descriptor)"


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return descriptor(spark, d).withColumn("norm", tx.normalize(F.col("raw")))


@query(f"WITH {NORM} SELECT p_partkey, raw, norm FROM norm")
def normalize_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return normalized(spark, d).select("p_partkey", "raw", "norm")


@query("SELECT p_partkey, 'SRC' || lpad(CAST(p_partkey % 100 AS VARCHAR), 3, '0') || ' ' || upper(substr(p_name, 1, 10)) || '*' || substr(raw, 1, 12) AS formatted FROM descriptor")
def source_formats(spark: SparkSession, d: str) -> DataFrame:
    """How a vendor writes a descriptor: padded code, truncated name, glued reference."""
    code = F.concat(F.lit("SRC"), F.lpad((F.col("p_partkey") % 100).cast("string"), 3, "0"))
    return descriptor(spark, d).select("p_partkey", F.concat(code, F.lit(" "), F.upper(F.substring("p_name", 1, 10)), F.lit("*"), F.substring("raw", 1, 12)).alias("formatted"))


RULES = """CASE WHEN norm = '' THEN 'rule:empty' WHEN list_contains(string_split(norm, ' '), 'INSTACART') OR list_contains(string_split(norm, ' '), 'GRUBHUB') THEN 'NONE' WHEN list_contains(string_split(norm, ' '), 'DOORDASH') THEN 'DOORDASH' END"""


@query(f"WITH {NORM} SELECT p_partkey, {RULES} AS rule FROM norm")
def mor_rules(spark: SparkSession, d: str) -> DataFrame:
    r = normalized(spark, d).withColumn("r", tx.merchant_of_record(F.col("norm")))
    return r.select("p_partkey", F.when(F.col("r").isNotNull(), F.when(F.col("r.method") == "rule:empty", "rule:empty").otherwise(F.coalesce("r.brand", "r.decision"))).alias("rule"))


EXACT = f"""{NORM}, exact AS (SELECT n.p_partkey, n.norm, n.mcc, coalesce(e.brand, c.brand) AS brand, CASE WHEN e.brand IS NOT NULL THEN 1.0 WHEN c.brand IS NOT NULL THEN 0.99 END AS score FROM norm n LEFT JOIN alias e ON e.alias_norm = n.norm
  LEFT JOIN (SELECT replace(alias_norm, ' ', '') AS k, min(brand) AS brand FROM alias GROUP BY ALL) c ON c.k = replace(n.norm, ' ', ''))"""


def exact(spark: SparkSession, d: str) -> DataFrame:
    """Brand by the alias itself, else by the alias without blanks."""
    n, a = normalized(spark, d).select("p_partkey", "norm", "mcc"), alias(spark, d)
    e = a.select(F.col("alias_norm").alias("norm"), F.col("brand").alias("e"))
    c = a.groupBy(F.regexp_replace("alias_norm", " ", "").alias("k")).agg(F.min("brand").alias("c"))
    j = n.join(e, "norm", "left").withColumn("k", F.regexp_replace("norm", " ", "")).join(c, "k", "left")
    return j.select("p_partkey", "norm", "mcc", F.coalesce("e", "c").alias("brand"), F.when(F.col("e").isNotNull(), 1.0).when(F.col("c").isNotNull(), 0.99).alias("score"))


@query(f"WITH {EXACT} SELECT p_partkey, norm, brand, CAST(score AS DOUBLE) AS score FROM exact")
def exact_alias_match(spark: SparkSession, d: str) -> DataFrame:
    return exact(spark, d).select("p_partkey", "norm", "brand", "score")


@query(f"WITH {NORM}, w AS (SELECT DISTINCT norm || ' STORE NORTH' AS t FROM norm) SELECT t, arg_max(alias_norm, length(alias_norm)) AS alias_norm FROM w JOIN alias ON starts_with(t, alias_norm || ' ') GROUP BY t")
def longest_prefix_match(spark: SparkSession, d: str) -> DataFrame:
    """The longest alias that a text begins with, on a word border: each prefix of whole words is looked up."""
    t = normalized(spark, d).select(F.concat("norm", F.lit(" STORE NORTH")).alias("t")).distinct()
    words = F.split("t", " ")
    p = t.withColumn("alias_norm", F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), " "))))
    hit = p.join(alias(spark, d).select("alias_norm"), "alias_norm")
    return hit.groupBy("t").agg(F.max_by("alias_norm", F.struct(F.char_length("alias_norm"), "alias_norm")).alias("alias_norm"))


GRAM_OF = "SELECT {key}, unnest(list_concat(list_transform(range(1, greatest(length(w) - 1, 1) + 1), lambda i: substr(w, i, 2)), CASE WHEN length(w) >= 3 THEN list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) ELSE [] END, CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END)) AS gram FROM (SELECT {key}, ' ' || unnest(list_filter(string_split({key}, ' '), lambda x: x <> '')) || ' ' AS w FROM {table})"
TFIDF = f"""{NORM}, ds AS (SELECT DISTINCT norm AS descr FROM norm WHERE norm <> ''), al AS (SELECT alias_norm AS alias FROM alias),
atf AS (SELECT alias, gram, 1 + ln(count(*)) AS tf FROM ({GRAM_OF.format(key='alias', table='al')}) GROUP BY ALL), idf AS (SELECT gram, ln((1.0 + (SELECT count(*) FROM al)) / (1 + count(*))) + 1 AS idf FROM atf GROUP BY gram),
aw AS (SELECT alias, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY alias)) AS w FROM atf JOIN idf USING (gram)),
dtf AS (SELECT descr, gram, 1 + ln(count(*)) AS tf FROM ({GRAM_OF.format(key='descr', table='ds')}) GROUP BY ALL), dw AS (SELECT descr, gram, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY descr)) AS w FROM dtf JOIN idf USING (gram)),
sims AS (SELECT descr, alias, sum(dw.w * aw.w) AS cosine FROM dw JOIN aw USING (gram) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY round(cosine, 9) DESC, alias) AS n FROM sims) WHERE n <= 5)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    descs = normalized(spark, d).select(F.col("norm").alias("desc")).where("desc <> ''").distinct()
    return tx.top_aliases(descs, alias(spark, d))


@query(f"WITH {TFIDF} SELECT descr, alias, round(cosine, 6) AS cosine FROM top")
def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select(F.col("desc").alias("descr"), "alias", F.round("cosine", 6).alias("cosine"))


@query("SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS jw FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def jaro_winkler(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", "p_name")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    return p.join(n, "p_partkey").select("p_partkey", F.round(tx.jaro_winkler_udf("p_name", "next"), 6).alias("jw"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).withColumn("score", tx.pair_score_udf("desc", "alias", "cosine"))


@query()
def fuzzy_score(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("desc", "alias", F.round("score", 6).alias("score"))


def ranked(cand: DataFrame, aliases: DataFrame, score: str) -> DataFrame:
    """desc with the best brand and the runner-up, each brand by its best alias."""
    per = cand.join(aliases.select(F.col("alias_norm").alias("alias"), "brand", "ticker"), "alias").groupBy("desc", "brand", "ticker").agg(F.max(score).alias("score"))
    n = F.row_number().over(W.partitionBy("desc").orderBy(F.round("score", 9).desc(), "brand"))
    two = per.withColumn("n", n).where("n <= 2")
    pick = lambda c, k: F.max(F.when(F.col("n") == k, F.col(c)))
    return two.groupBy("desc").agg(*[pick(c, k).alias(f"{c}_{k}") for k in (1, 2) for c in ("brand", "ticker", "score")])


BEST = f"""{TFIDF}, per AS (SELECT descr, brand, ticker, max(cosine) AS score FROM top JOIN alias ON alias_norm = alias GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY round(score, 9) DESC, brand) AS n FROM per),
best AS (SELECT descr, max(CASE WHEN n = 1 THEN brand END) AS brand, max(CASE WHEN n = 1 THEN ticker END) AS ticker, max(CASE WHEN n = 1 THEN score END) AS score, max(CASE WHEN n = 2 THEN brand END) AS runner_up, max(CASE WHEN n = 2 THEN ticker END) AS runner_ticker, max(CASE WHEN n = 2 THEN score END) AS runner_up_score FROM rk GROUP BY descr)"""


@query(f"WITH {BEST} SELECT descr, brand, round(score, 6) AS score, runner_up, round(runner_up_score, 6) AS runner_up_score FROM best")
def best_and_runner_up(spark: SparkSession, d: str) -> DataFrame:
    r = ranked(candidates(spark, d), alias(spark, d), "cosine")
    return r.select(F.col("desc").alias("descr"), F.col("brand_1").alias("brand"), F.round("score_1", 6).alias("score"), F.col("brand_2").alias("runner_up"), F.round("score_2", 6).alias("runner_up_score"))


@query(f"""WITH {BEST} SELECT p_partkey, best.brand, CASE WHEN s >= 0.90 AND ok AND NOT coalesce(runner_ticker <> ticker AND s - runner_up_score < 0.03, false) THEN 'MATCH' WHEN s >= 0.72 THEN 'REVIEW' ELSE 'NONE' END AS decision, ok AS mcc_ok
FROM (SELECT p_partkey, best.*, list_contains(mcc_list, mcc % 7) AS ok, score * CASE WHEN list_contains(mcc_list, mcc % 7) THEN 1.0 ELSE 0.85 END AS s FROM norm JOIN best ON descr = norm JOIN brand b ON b.brand = best.brand) best""")
def match_decision(spark: SparkSession, d: str) -> DataFrame:
    """MATCH, REVIEW or NONE by score, category code and how near another owner's brand comes."""
    r = ranked(candidates(spark, d), alias(spark, d), "cosine")
    n = normalized(spark, d).select("p_partkey", F.col("norm").alias("desc"), (F.col("mcc") % 7).alias("code"))
    b = brand(spark, d).select(F.col("brand").alias("brand_1"), "mcc_list")
    j = n.join(r, "desc").join(b, "brand_1").withColumn("mcc_ok", F.array_contains("mcc_list", F.col("code")))
    s = F.col("score_1") * F.when(F.col("mcc_ok"), 1.0).otherwise(tx.MCC_PENALTY)
    unclear = F.coalesce((F.col("ticker_2") != F.col("ticker_1")) & (s - F.col("score_2") < tx.AMBIGUITY), F.lit(False))
    decision = F.when((s >= tx.ACCEPT) & F.col("mcc_ok") & ~unclear, "MATCH").when(s >= tx.REVIEW, "REVIEW").otherwise("NONE")
    return j.select("p_partkey", F.col("brand_1").alias("brand"), decision.alias("decision"), "mcc_ok")


def resolution(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.resolve import resolved

    n = normalized(spark, d).select(F.col("norm").alias("desc"), (F.col("mcc") % 7).alias("mcc"))
    b = brand(spark, d).select("brand", "ticker", "mcc_list")
    return resolved(n, alias(spark, d).withColumn("place", F.col("alias_norm")), b)


@query()
def resolve(spark: SparkSession, d: str) -> DataFrame:
    """The whole resolver over the catalog of descriptors and category codes."""
    return resolution(spark, d)


@query(f"""WITH {EXACT.replace("n.mcc", "n.mcc % 7 AS mcc")}, t AS (SELECT DISTINCT norm, string_split(norm, ' ') AS ws FROM norm), p AS (SELECT norm, unnest(range(1, greatest(len(ws), 2))) AS k, ws FROM t),
pre AS (SELECT norm, arg_max(a.brand, length(a.alias_norm)) AS brand FROM p JOIN alias a ON a.alias_norm = array_to_string(ws[1:k], ' ') WHERE length(a.alias_norm) < length(norm) GROUP BY norm),
f1 AS (SELECT DISTINCT e.norm AS descr, e.mcc, e.score, coalesce(e.brand, f.brand, pre.brand) AS brand FROM exact e LEFT JOIN (SELECT replace(alias_norm, ' ', '') AS k, arg_min(brand, alias_norm) AS brand FROM alias GROUP BY ALL) f ON f.k = string_split(e.norm, ' ')[1] LEFT JOIN pre ON pre.norm = e.norm)
SELECT descr, f1.mcc, f1.brand, CASE WHEN score = 1.0 THEN 1.0 ELSE 0.99 END::DOUBLE AS score FROM f1 JOIN brand b ON b.brand = f1.brand WHERE list_contains(b.mcc_list, f1.mcc) AND descr <> ''
  AND len(list_intersect(string_split(descr, ' '), ['INSTACART', 'INSTACAR', 'GRUBHUB', 'DOORDASH', 'DASHPASS'])) = 0 AND string_split(descr, ' ')[1] NOT IN ('UBER', 'LYFT')""")
def resolve_exact(spark: SparkSession, d: str) -> DataFrame:
    """Of the resolver's answers those by lookup."""
    return resolution(spark, d).where("method = 'exact'").select(F.col("desc").alias("descr"), "mcc", "brand", "score")


@query("SELECT event_id, CAST(props ->> '$.k' AS INT) AS k, json_object('id', event_id, 'k', CAST(props ->> '$.k' AS INT))::VARCHAR AS doc FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
    return e.select("event_id", "k", F.to_json(F.struct(F.col("event_id").alias("id"), "k")).alias("doc"))


@query("""SELECT ticker, CASE WHEN k = 0 THEN 'Revenues' ELSE 'Sales' END AS concept, period_start AS start, period_end AS "end", period_days AS days, CASE WHEN period_days BETWEEN 80 AND 125 THEN 'quarter' WHEN period_days BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END AS kind, round(revenue, 2) AS val FROM fiscal CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
def json_facts_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Nested filings, written as JSON documents and read back: one row a fact; facts without a start are skipped."""
    from ..sources.views import fiscal

    fact = F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end"), F.round("revenue", 2).alias("val"))
    instant = F.struct(F.lit(None).cast("string").alias("start"), F.lit("2000-01-01").alias("end"), F.lit(1.0).alias("val"))
    unit = F.struct(F.struct(F.array_append(F.collect_list(fact), instant).alias("USD")).alias("units"))
    docs = fiscal(spark, d).groupBy("ticker").agg(unit.alias("u")).select("ticker", F.to_json(F.struct(F.create_map(F.lit("Revenues"), "u", F.lit("Sales"), "u").alias("gaap"))).alias("doc"))
    kind = "gaap map<string, struct<units: struct<USD: array<struct<start: string, end: string, val: double>>>>>"
    flat = docs.select("ticker", F.explode(F.from_json("doc", kind)["gaap"]).alias("concept", "c")).select("ticker", "concept", F.explode("c.units.USD").alias("f")).where("f.start IS NOT NULL")
    days = F.datediff(F.col("f.end").cast("date"), F.col("f.start").cast("date")) + 1
    span = F.when(days.between(80, 125), "quarter").when(days.between(350, 380), "annual").otherwise("other")
    return flat.select("ticker", "concept", F.col("f.start").cast("date").alias("start"), F.col("f.end").cast("date").alias("end"), days.cast("long").alias("days"), span.alias("kind"), "f.val")


SAID = "CASE fiscal_quarter WHEN 1 THEN 'We recommend buying.' WHEN 2 THEN 'Members hold cards; sales held.' WHEN 3 THEN 'The PRICE TARGET is higher.' ELSE 'Buyers of shares buy more.' END"


@query(f"SELECT ticker, period_start, regexp_matches({SAID}, '(?i){ADVICE_PATTERN}') AS advice FROM fiscal")
def advice_filter(spark: SparkSession, d: str) -> DataFrame:
    """Notes that read as investment advice; plain words such as hold are none."""
    from ..sources.views import fiscal

    return fiscal(spark, d).select("ticker", "period_start", F.expr(SAID).rlike(f"(?i){ADVICE_PATTERN}").alias("advice"))


NOTE = "'FY' || fiscal_year || ' Q' || fiscal_quarter || ' ended ' || CAST(period_end AS VARCHAR) || ': revenue ' || CAST(CAST(revenue AS BIGINT) AS VARCHAR) || ' over ' || period_days || ' days.'"


@query(f"SELECT ticker, period_start, {NOTE} AS note FROM (SELECT * REPLACE (floor(revenue) AS revenue) FROM fiscal)")
def note_template(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import fiscal

    note = F.format_string("FY%s Q%s ended %s: revenue %s over %s days.", F.col("fiscal_year").cast("string"), F.col("fiscal_quarter").cast("string"), F.col("period_end").cast("string"), F.floor("revenue").cast("long").cast("string"), F.col("period_days").cast("string"))
    return fiscal(spark, d).select("ticker", "period_start", note.alias("note"))


@query(rf"""WITH n AS (SELECT ticker, period_start, {NOTE} AS note FROM (SELECT * REPLACE (floor(revenue) AS revenue) FROM fiscal)), p AS (SELECT *, regexp_replace(note, '\b(FY ?\d{{2,4}}|Q[1-4]|\d{{4}}-\d{{2}}-\d{{2}})\b', ' ', 'g') AS rest FROM n)
SELECT ticker, period_start, claim FROM (SELECT ticker, period_start, trim(unnest(regexp_extract_all(rest, '[-+]?\$?\d[\d,]*(?:\.\d+)?\s?(?:%|pp|bps|bn|B|M|k)?'))) AS claim FROM p) WHERE NOT regexp_matches(claim, '^(19|20)\d{{2}}$') AND NOT regexp_matches(claim, '^\d{{1,2}}$')""")
def extract_claims(spark: SparkSession, d: str) -> DataFrame:
    """Numeric claims of the notes, one row each."""
    return note_template(spark, d).select("ticker", "period_start", F.explode(tx.claims(F.col("note"))).alias("claim"))


CLAIM = "CAST(round(revenue / 1e6, 1) + CASE WHEN fiscal_quarter = 4 THEN 0.5 ELSE 0 END AS DOUBLE)"


@query(f"""SELECT ticker, period_start, {CLAIM} AS claim, EXISTS (SELECT 1 FROM fiscal f WHERE f.ticker = c.ticker AND f.period_end <= c.period_end AND abs({CLAIM.replace("revenue", "c.revenue").replace("fiscal_quarter", "c.fiscal_quarter")} - f.revenue / 1e6) <= 0.05 + 1e-9) AS grounded FROM fiscal c""")
def grounding_check(spark: SparkSession, d: str) -> DataFrame:
    """A claim with one digit after the point stands if some fact of its ticker known by then is within half of that
    digit's unit. Fourth quarters' claims are off, and stand only if another quarter bears them out. Facts are looked
    up by the digit that they round to and its neighbours."""
    from ..sources.views import fiscal

    f = fiscal(spark, d)
    claim = F.round(F.col("revenue") / 1e6, 1) + F.when(F.col("fiscal_quarter") == 4, 0.5).otherwise(0.0)
    digit = F.round(F.col("claim") * 10).cast("long")
    said = f.select("ticker", "period_start", "period_end", claim.alias("claim")).withColumn("near", F.explode(F.sequence(digit - 1, digit + 1)))
    fact = F.col("revenue") / 1e6
    facts = f.select("ticker", F.col("period_end").alias("fact_end"), fact.alias("fact"), F.round(fact * 10).cast("long").alias("near"))
    borne = said.join(facts, ["ticker", "near"], "left").withColumn("hit", F.coalesce((F.col("fact_end") <= F.col("period_end")) & (F.abs(F.col("claim") - F.col("fact")) <= 0.05 + 1e-9), F.lit(False)))
    return borne.groupBy("ticker", "period_start", "claim").agg(F.max("hit").alias("grounded"))


@query("SELECT ticker, count(*) AS n, max(period_end) AS latest FROM fiscal GROUP BY ticker ORDER BY ticker LIMIT 200")
def adhoc_sql(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import fiscal
    from .notes import guarded_sql

    return guarded_sql(spark, "SELECT ticker, count(*) AS n, max(period_end) AS latest FROM fiscal GROUP BY ticker ORDER BY ticker", {"fiscal": fiscal(spark, d)})
