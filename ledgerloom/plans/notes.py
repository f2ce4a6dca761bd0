"""Research tools: guarded SQL, notes and their verification."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Rows that an ad-hoc query shows at most: a limit of the tool.
CAP = 200
#: Functions that reach outside the tables.
OUTSIDE = re.compile(r"(?i)\b(reflect|try_reflect|java_method|read_files|from_avro|to_avro)\s*\(")


def guarded_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One SELECT over the given tables, CAP rows at most. The statement is parsed, and every relation in it, in
    subqueries too, must be one of the tables or named in its own WITH."""
    text = sql.strip().rstrip(";")
    if ";" in text or OUTSIDE.search(text) or not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only one SELECT statement is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    if re.search(r"(?m)^['\s:+-]*\w*(Insert|Create|Delete|Update|Merge|Drop|Command|Cache|TableValuedFunction)\w*", plan):
        raise ValueError("only SELECT is allowed")
    own = {x for m in re.findall(r"CTE \[([^\]]*)\]", plan) for x in re.split(r",\s*", m)} | set(re.findall(r"(?i)(?:\bwith|,)\s+(\w+)\s+as\s*\(", text))
    named = re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan)
    if unknown := set(named) - set(tables) - own:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    asked = {k: v for k, v in tables.items() if k in named}
    return spark.sql(re.sub(r"(?i)\b(from|join)\s+(\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in asked else m[0], text), **asked).limit(CAP)


NUMBER = re.compile(r"(?<![\w.])([-+]?)(\$?)(\d[\d,]*(?:\.\d+)?)\s?(%|pp|bps|bn|B|M|k)?(?![\w%])")
SKIP = re.compile(r"\b(FY ?\d{2,4}|Q[1-4]|\d{4}-\d{2}-\d{2})\b")
#: What reads as investment advice. Fixed value.
ADVICE_PATTERN = (
    r"\b(buy|sell|hold)\s+(rating|recommendation|the stock|shares)\b|\bprice target\b|\b(overweight|underweight)\b"
    r"|\brecommend (buying|selling|investors)\b|\bshould (buy|sell)\b"
)
ADVICE = re.compile(ADVICE_PATTERN, re.IGNORECASE)


def claims_of(note: str) -> list[tuple[float, int, str]]:
    """(value, digits after the point, unit) of each number that claims something."""
    out = []
    for m in NUMBER.finditer(SKIP.sub(" ", note)):
        digits = m[3].replace(",", "")
        if not m[2] and not m[4] and (re.fullmatch(r"(19|20)\d{2}|\d{1,2}", digits)):
            continue
        out.append((float(m[1] + digits), len(digits.partition(".")[2]), "usd" if m[2] else m[4] or ""))
    return out


def facts_of(x) -> list[float]:
    """All numbers inside nested facts."""
    if isinstance(x, dict):
        return [v for y in x.values() for v in facts_of(y)]
    if isinstance(x, (list, tuple)):
        return [v for y in x for v in facts_of(y)]
    if isinstance(x, bool) or x is None:
        return []
    if isinstance(x, (int, float)):
        return [float(x)]
    return [float(v.replace(",", "")) for v in re.findall(r"[-+]?\d[\d,]*(?:\.\d+)?", str(x))]


def verify(note: str, facts, sections: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a note: numbers that no fact bears out, missing sections, advice."""
    known, issues = facts_of(facts), []
    for value, digits, unit in claims_of(note):
        slack = 0.5 * 10**-digits + 1e-9
        if not any(abs(abs(value) - abs(f) / s) <= slack for f in known for s in ((1, 1e6, 1e9) if unit == "usd" else (1,))):
            issues.append(f"ungrounded {value:g}{unit}")
    issues += [f"missing section {s}" for s in sections if s.lower() not in note.lower()]
    return issues + ["advice"] * bool(ADVICE.search(note))


@dataclass
class Research:
    """gather, write, verify, revise (at most `revisions` times), else fall back to the template."""

    write: Callable[[dict, list[str]], str] | None
    template: Callable[[dict], str]
    sections: tuple[str, ...] = ()
    revisions: int = 2
    log: list[str] = field(default_factory=list)

    def run(self, facts: dict) -> str:
        issues: list[str] = []
        for turn in range(self.revisions + 1 if self.write else 0):
            note = self.write(facts, issues)
            issues = verify(note, facts, self.sections)
            self.log.append(f"turn {turn}: {len(issues)} issues")
            if not issues:
                return note
        return self.template(facts)
