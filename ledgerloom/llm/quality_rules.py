"""Quality rules as a short-circuit cascade (operator 3), in DataFrame functions only.

A rule is a condition by which a text fails. What each rule costs and how much it rejects is measured on a
sample; rules are then tried in the order of rejection per cost, and what stands behind the first that rejects a text
isn't computed for it. As a text is kept if no rule rejects it, the order changes the work and never the verdict.

Null texts have no word. A text without a word has counts of 0 and fails. Texts of any length are judged whole; rows
are judged one by one, so repeated rows and ids get the same verdict; an empty table gives no row; columns other than
text are carried along or left out and never read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, fresh_folder, remove

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: The cascade's thresholds. Ordinary prose stays far from each of them.
MIN_WORDS = 20
MAX_REPEATED = 30  # per 100 words, in windows found twice
MAX_SYMBOLS = 30  # per 100 words
MAX_DUPLICATE_LINES = 30  # per 100 lines with a word
MAX_CAPITALS = 70  # per 100 letters of texts that have both cases
MIN_DUPLICATE_LINES = 3  # a line or two said again are no fault
MIN_DISTINCT = 22  # distinct words per 100 words, in texts of up to DISTINCT_WORDS words
DISTINCT_WORDS = 500
#: Documents that costs and selectivities are measured on, about, and passes over them for each rule.
SAMPLE, RUNS = 1000, 3


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def words(text: Column) -> Column:
    """The text's words, [^\\x20\\x09-\\x0D]+."""
    return F.array_remove(F.split(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)), " "), "")


def word_chars(text: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.translate(text, SPACE, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long")


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, SPACE[1:], " " * (len(SPACE) - 1))) != "")


def n_dup_lines(lines: Column) -> Column:
    """Lines that equal an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _pairs(x: Column, step: int, n: Column) -> Column:
    """The hash of each element and the one `step` after it."""
    return F.zip_with(x, F.slice(x, step + 1, n), lambda a, b: F.xxhash64(a, b))


def windows(words: Column) -> Column:
    """A 64-bit hash of each window of eight words. Hashes of one, two and four words are put together in pairs, so a
    window costs three steps and never a copy of its words."""
    n = F.size(words)
    one = F.transform(words, lambda w: F.xxhash64(w))
    eight = _pairs(_pairs(_pairs(one, 1, n), 2, n), 4, n)
    return F.slice(eight, 1, F.greatest(n - (WINDOW - 1), F.lit(0)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_repeated(windows: Column) -> Column:
    """Words in windows that are found twice or more. If all windows differ nothing else is computed."""
    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w)))


def _covered(windows: Column) -> Column:
    """Words in repeated windows, from the places of equal hashes side by side in sorted order."""
    n = F.size(windows)
    none = F.array().cast("array<int>")
    twice = lambda placed: F.zip_with(placed, F.slice(placed, 2, n), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)).otherwise(none))
    starts = let(F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda placed: F.sort_array(F.array_distinct(F.flatten(twice(placed)))))
    spans = lambda s: F.zip_with(s, F.slice(s, 2, n), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(let(starts, spans), F.lit(0).cast("long"), lambda x, y: x + y)


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and the counts that the base rules need."""
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    split = base.select("doc_id", "text", words(F.col("text")).alias("words"), word_lines(F.col("text")).alias("lines"))
    hashed = split.select("*", windows(F.col("words")).alias("windows"))
    return hashed.select(
        "doc_id", "text", "words", "lines", F.size("words").cast("long").alias("n_words"), word_chars(F.col("text")).alias("word_chars"), n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("lines")).alias("n_dup_lines"), n_repeated(F.col("windows")).alias("n_repeat_words"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def further_rules(symbols: Column | None = None, dup_lines: Column | None = None) -> list[Rule]:
    """Rules over columns text, words and lines, beside the base rules. Counts that are there already can be given."""
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    symbols = n_symbols(text) if symbols is None else symbols
    dup_lines = n_dup_lines(lines) if dup_lines is None else dup_lines
    capitals, small = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"\p{Ll}"))
    return [
        Rule("symbols", 100 * symbols > MAX_SYMBOLS * F.size(words)),
        Rule("duplicate_lines", (dup_lines >= MIN_DUPLICATE_LINES) & (100 * dup_lines > MAX_DUPLICATE_LINES * F.size(lines))),
        Rule("capitals", 100 * capitals > MAX_CAPITALS * (capitals + small)),
        Rule("few_words", (F.size(words) <= DISTINCT_WORDS) & (100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words))),
    ]


def all_rules() -> list[Rule]:
    """The base rules and the further ones, over columns text, words and lines."""
    words = F.col("words")
    return [
        Rule("short", F.size(words) < MIN_WORDS),
        Rule("repeated", 100 * n_repeated(windows(words)) > MAX_REPEATED * F.size(words)),
        *further_rules(),
    ]


def measure(docs: DataFrame, rules: list[Rule], sample: int = SAMPLE) -> list[Measured]:
    """Cost and selectivity of each rule on about `sample` documents, the most worthwhile first.

    Each partition draws its own documents, in proportion to its rows, so no document moves between tasks. A rule's cost
    is what it adds to a pass over the written sample: the least of a few runs, less the least of passes without a rule,
    so neither compilation nor starting a job counts.
    """
    total = docs.count()
    share = min(1.0, sample / max(1, total))
    some = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).sample(share, seed=3)
    path = fresh_folder(docs.sparkSession, "rule-sample")
    some.select("text", words(F.col("text")).alias("words"), word_lines(F.col("text")).alias("lines")).write.parquet(path)
    some = docs.sparkSession.read.schema("text string, words array<string>, lines array<string>").parquet(path)

    def run(fails: Column) -> tuple[float, float]:
        least, share = float("inf"), 0.0
        for _ in range(RUNS):
            began = time.perf_counter()
            n, rejected = some.agg(F.count("text"), F.sum(fails.cast("int"))).first()
            least, share = min(least, time.perf_counter() - began), (rejected or 0) / max(n, 1)
        return least, share

    idle, _ = run((F.size("words") < 0) | (F.size("lines") < 0))
    found = [Measured(rule, max(seconds - idle, 1e-3), rejected) for rule, (seconds, rejected) in [(x, run(x.fails)) for x in rules]]
    remove(docs.sparkSession, path)
    return sorted(found, key=lambda x: (-x.worth, x.rule.name))


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, else null."""
    first, *rest = rules
    out = F.when(first.fails, first.name)
    for rule in rest:
        out = out.when(rule.fails, rule.name)
    return out


def judged(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed and kept."""
    names = [x.rule.name for x in measure(docs, further_rules(), sample)]
    rules = {x.name: x for x in further_rules(F.col("n_symbols"), F.col("n_dup_lines"))}
    order = [rules[x] for x in names]
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return counted(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.when(failed, False).otherwise(cascade(order).isNull()).alias("kept"),
    )


def keep(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their own columns."""
    order = [x.rule for x in measure(docs, all_rules(), sample)]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), text.alias("text"))
    split = row.select("row", "text", words(F.col("text")).alias("words"), word_lines(F.col("text")).alias("lines"))
    # A plain filter would be pushed below the words and write their split out anew wherever a rule names them. So the
    # verdict is a generator's: a row for a text that is kept, none for another.
    stays = F.explode(F.when(cascade(order).isNull(), F.array(F.lit(True))))
    return split.select("row", stays.alias("kept")).select("row.*")
