"""URL filters by association rules (operator 2), in DataFrame functions and Spark ML, long rows' rules on the driver.

Given rules name a host and the beginning of a path; they hold for the host and its subdomains, and the longest one that
fits decides. For all other URLs there are mined rules: FP-growth finds which combinations of URL tokens go with which
label; combinations of enough support and confidence are kept, without those that a part of them makes superfluous, and
an inverted index from token to rules finds the rules all of whose tokens a URL has. The most confident one decides,
and where none matches the verdict is `allow`.

Rules need a least number of rows beside their support, so that a few rows make no rule.

A null URL, or one without `://`, has an empty host and path, no token, and no rule; URLs of any length are read whole;
each row is judged by itself, so repeated rows and ids get the same verdict; an empty table, or one without a labelled
row, gives no mined rule. Only the named id and URL columns are read.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of the labelled rows that have a combination, and least share of those with its label.
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Least number of labelled rows that a rule holds in.
COUNT = 10
#: Tokens of a labelled row, rare ones and those that decide by themselves left out, up to which combinations are all grown;
#: beyond, they are grown one by one, without those that can't become rules. Both give the same rules.
LONG = 16
#: How items of a label are told from tokens.
LABEL = "label="


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = ""

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}" if self.path else f"{self.host}/"


@dataclass(frozen=True)
class Mined:
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float
    #: For each token those that always stood beside it, itself included; any of them will do.
    alike: tuple[tuple[str, ...], ...] = ()


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    at = F.instr(url, "://")
    found = F.translate(F.regexp_extract(F.substring(url, at + 3, F.char_length(url)), "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(at > 0, found).otherwise("")


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting(rules: list[Rule], host: Column, path: Column) -> list[tuple[Column, Rule]]:
    """A condition for each rule, the longest rule first."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return [(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(f"/{r.path}"), r) for r in order]


def choose(cases: list[tuple[Column, Rule]], what: str) -> Column:
    out = F.lit(None).cast("string")
    for fits, rule in reversed(cases):
        out = F.when(fits, getattr(rule, what)).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The URL's distinct tokens: scheme, labels of the host, segments of the path (numbers as one token), suffix of the
    last segment, names of the query's fields."""
    prefix = lambda name, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(f"{name}="), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), r"^\d+$", "#"))
    suffix = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    scheme = F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    every = F.concat(prefix("scheme", F.array(F.lower(scheme))), prefix("host", F.split(host, r"\.")), prefix("path", segments), prefix("suffix", F.array(F.lower(suffix))), prefix("query", fields))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, count: int = 1) -> list[Mined]:
    """Rules from tokens (array<string>) and label, the most confident first. A rule holds in a `support` share of the
    labelled rows at least, and in `count` of them.

    All labelled rows count, and combinations have any length. Before FP-growth grows them, what it need not grow is taken
    out, without losing a rule: tokens too rare for any rule; tokens whose rows have one label, as each is a rule that no
    longer one can better; and of tokens that always stand together all but one. Where a row has more than `LONG` tokens even
    so, whose combinations are too many to write down, `pruned` grows them and leaves out those that a bound rules out.
    """
    items = labelled.where(F.col("label").isNotNull()).select(F.array_distinct(F.filter("tokens", lambda x: x.isNotNull())).alias("tokens"), "label")
    n = items.count()
    if not n:
        return []
    least = max(1, count, math.ceil(support * n))
    # Tokens that stand in the same rows have the same sums of the rows' hashes.
    marks = [F.xxhash64(F.lit(k), F.sort_array("tokens"), "label").cast("decimal(20,0)").alias(f"m{k}") for k in (1, 2)]
    per = items.select(F.explode("tokens").alias("token"), "label", *marks).groupBy("token", "label").agg(F.count("*").alias("n"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    known = per.groupBy("token").agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("m1").alias("m1"), F.sum("m2").alias("m2"))
    # Each token stands in `least` rows, so there are no more than all rows' tokens divided by that.
    known = sorted(known.where(F.col("most") >= least).collect(), key=lambda r: r.token)
    found = [Mined((r.token,), r.label, r.most / r.n, r.most / n) for r in known if r.most >= confidence * r.n]
    classes: dict[tuple, list[str]] = {}
    for r in known:
        if r.most < r.n:
            classes.setdefault((r.n, r.m1, r.m2), []).append(r.token)
    classes = {x[0]: x for x in classes.values()}
    if classes:
        heads = items.select(F.array_intersect("tokens", F.lit(list(classes))).alias("tokens"), "label").where(F.size("tokens") > 0)
        longest = heads.agg(F.max(F.size("tokens"))).first()[0] or 0
        if longest > LONG:
            found += [replace(r, support=r.support / n) for r in pruned(heads, least, confidence) if len(r.tokens) > 1]
            rules = None
        else:
            rules = grown(heads, (least - 0.5) / n, n, confidence)
    if classes and rules is not None:
        # A rule that a part of it with one token less makes superfluous goes before rules are collected.
        parts = rules.select("*", F.explode("tokens").alias("x")).select("tokens", "verdict", "confidence", F.array_remove("tokens", F.col("x")).alias("part"))
        better = rules.select(F.col("tokens").alias("part"), "verdict", F.col("confidence").alias("c"))
        worse = parts.join(better, ["part", "verdict"]).where("c >= confidence").select("tokens", "verdict")
        for r in rules.join(worse, ["tokens", "verdict"], "left_anti").collect():
            if len(r.tokens) > 1:
                found.append(Mined(tuple(r.tokens), r.verdict, r.confidence, r.n / n))
    found.sort(key=lambda r: (len(r.tokens), -r.confidence, r.tokens, r.verdict))
    # Kept rules by their first token, as the parts of a long combination are too many to look up each.
    kept: dict[str, list[Mined]] = {}
    for r in found:
        mine = frozenset(r.tokens)
        parts = [p for x in r.tokens for p in kept.get(x, []) if len(p.tokens) < len(mine) and mine.issuperset(p.tokens)]
        if not any(p.verdict == r.verdict and p.confidence >= r.confidence for p in parts):
            kept.setdefault(r.tokens[0], []).append(r)
    alike = [replace(r, alike=tuple(tuple(classes.get(x, [x])) for x in r.tokens)) if len(r.tokens) > 1 else r for rules in kept.values() for r in rules]
    return sorted(alike, key=lambda r: (-r.confidence, -r.support, r.tokens, r.verdict))


def grown(items: DataFrame, support: float, n: int, confidence: float) -> DataFrame:
    """tokens, verdict, confidence, n of rules, by FP-growth; support is a share of n rows, those of `items` or more."""
    rows = items.select(F.array_append("tokens", F.concat(F.lit(LABEL), "label")).alias("items"))
    total = rows.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / total), minConfidence=confidence).fit(rows)
    rules = model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith(LABEL))
    rules = rules.where(~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    return rules.select(F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 30).alias("verdict"), "confidence", F.round(F.col("support") * total).cast("long").alias("n"))


def pruned(items: DataFrame, least: int, confidence: float) -> list[Mined]:
    """The same rules, with n as support, where rows are long: FP-growth by conditional rows, the rarest token first, on equal
    rows as one with a count, for one verdict at a time. A combination isn't grown further

    * with a token that leaves too few rows of the verdict;
    * with a token without which only rows of the verdict would be added: the rule without it is as good;
    * if it has rows of the verdict only;
    * if rows of other verdicts, which have all tokens that may yet be added, hold the confidence down to less than a rule
      needs or than it has already.

    Rules can still be as many as combinations, and then time and the driver's memory go with them: nothing is cut.
    """
    rows = items.groupBy(F.sort_array("tokens").alias("tokens"), "label").agg(F.count("*").alias("n")).collect()
    number = Counter()
    for r in rows:
        number.update(dict.fromkeys(r.tokens, 0))
        for x in r.tokens:
            number[x] += r.n
    names = sorted(number, key=lambda x: (number[x], x))
    at = {x: k for k, x in enumerate(names)}
    sets = sorted({tuple(r.tokens) for r in rows})
    place = {x: k for k, x in enumerate(sets)}
    has = np.zeros((len(sets), len(names)), bool)
    for x, k in place.items():
        has[k, [at[y] for y in x]] = True
    labels = sorted({r.label for r in rows})
    counts = {x: np.zeros(len(sets), np.int64) for x in labels}
    for r in rows:
        counts[r.label][place[tuple(r.tokens)]] += r.n
    every, found = sum(counts.values()), []
    for verdict in labels:
        mine, other = counts[verdict], every - counts[verdict]
        stack = [((), np.arange(len(sets)), np.arange(len(names)), 0.0)]
        while stack:
            chosen, of, rest, best = stack.pop()
            yes, no = mine[of], other[of]
            n, against = int(yes.sum()), int(no.sum())
            if chosen and n >= confidence * (n + against) and n / (n + against) > best:
                best = n / (n + against)
                found.append(Mined(tuple(sorted(names[k] for k in chosen)), verdict, best, n))
            if not against:
                continue
            sub = has[np.ix_(of, rest)]
            keep = np.flatnonzero((yes @ sub >= least) & (no @ sub < against))
            sub, rest = sub[:, keep], rest[keep]
            # Of each token: rows of the verdict with it, and others that have it and all tokens after it.
            most = yes @ sub
            stay = no @ np.logical_and.accumulate(sub[:, ::-1], axis=1)[:, ::-1]
            good = (most >= confidence * (most + stay)) & (most > best * (most + stay))
            stack += [((*chosen, rest[k]), of[sub[:, k]], rest[k + 1 :], best) for k in np.flatnonzero(good)]
    return found


def constant(value: dict | list, kind: str) -> Column:
    """A literal of many parts, as one expression."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def best_match(tokens: Column, mined: list[Mined]) -> Column:
    """The number of the first mined rule all of whose tokens are there, else null, by an inverted index: each token
    brings its rules' numbers, and a rule matches that is brought as often as it has tokens. Of tokens that a rule takes
    as alike one counts."""
    if not mined:
        return F.lit(None).cast("int")
    places = max(len(r.tokens) for r in mined)
    index: dict[str, list[int]] = {}
    for k, r in enumerate(mined):
        for place, x in enumerate(r.tokens):
            for y in r.alike[place] if r.alike else (x,):
                index.setdefault(y, []).append(k * places + place)
    entries, sizes = constant(index, "map<string,array<int>>"), constant([len(r.tokens) for r in mined], "array<int>")
    # What is used once for each element is named first, as it would be worked out as often otherwise.
    named = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    brought = named(entries, lambda e: F.array_distinct(F.flatten(F.transform(tokens, lambda x: F.coalesce(F.element_at(e, x), F.array().cast("array<int>"))))))
    brought = F.sort_array(F.transform(brought, lambda x: F.floor(x / places).cast("int")))
    # A rule's numbers lie in a row; if as many as its tokens, the last of them is that far from the first.
    whole = lambda x: F.filter(x["brought"], lambda k, i: F.get(x["brought"], i + F.get(x["sizes"], k) - 1) == k)
    return named(F.struct(brought.alias("brought"), sizes.alias("sizes")), lambda x: F.array_min(whole(x)))


def judged(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url", labels: DataFrame | None = None) -> DataFrame:
    """id, host, path, rule (the given rule that fits, or null), verdict, mined (the mined rule's tokens, or null).

    `labels` has `id_column` and label (allow or block). Without it, the URLs that given rules decide are the labelled
    ones, so that mined rules carry those decisions over to similar URLs.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    base = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"))
    base = base.select("id", url.alias("url"), host(url).alias("host"), path(url).alias("path"))
    cases = fitting(rules, F.col("host"), F.col("path"))
    base = base.select("*", choose(cases, "name").alias("rule"), choose(cases, "verdict").alias("given"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    if labels is None:
        labelled = base.select("tokens", F.col("given").alias("label"))
    else:
        labelled = base.join(labels.select(F.col(id_column).alias("id"), "label"), "id").select("tokens", "label")
    mined = mine(labelled, count=COUNT)
    found = base.select("*", best_match(F.col("tokens"), mined).alias("k"))
    say = lambda what: F.element_at(constant([what(r) for r in mined], "array<string>"), F.col("k") + 1) if mined else F.lit(None).cast("string")
    return found.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("given", say(lambda r: r.verdict), F.lit("allow")).alias("verdict"),
        F.when(F.col("given").isNull(), say(lambda r: " ".join(r.tokens))).alias("mined"),
    )
