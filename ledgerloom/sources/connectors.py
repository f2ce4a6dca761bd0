"""Filings and page views from the web, kept as files. The transport is a function that is handed in, so nothing here needs
a network: `get(url, headers)` answers (status, headers, body)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote, urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Get = Callable[[str, dict[str, str]], tuple[int, dict[str, str], bytes]]


class TooManyRequests(RuntimeError):
    """The service kept asking to wait."""


@dataclass
class Files:
    """Answers by name in a folder; what is there isn't asked for again unless `refresh` is set.

    After each request there is a pause. A service that answers 429 is asked again after the time it names, or after waits
    that double up to two minutes."""

    folder: Path
    get: Get
    agent: str
    pause: float = 0.15
    tries: int = 7
    refresh: bool = False
    sleep: Callable[[float], None] = time.sleep

    def fetch(self, name: str, url: str) -> bytes:
        path = Path(self.folder) / name
        if path.exists() and not self.refresh:
            return path.read_bytes()
        body = self._ask(url)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f".{path.name}.part")
        part.write_bytes(body)
        part.replace(path)
        self.sleep(self.pause)
        return body

    def _ask(self, url: str) -> bytes:
        for n in range(self.tries):
            status, headers, body = self.get(url, {"User-Agent": self.agent})
            if status == 200:
                return body
            if status != 429:
                raise OSError(f"{status} from {url}")
            self.sleep(float(headers.get("Retry-After", min(5.0 * 2**n, 120.0))))
        raise TooManyRequests(url)


def company_facts(files: Files, cik: int, base: str) -> str:
    """The name of the file with a company's facts, fetched if it isn't there."""
    name = f"facts/CIK{cik:010d}.json"
    files.fetch(name, f"{base}/CIK{cik:010d}.json")
    return name


FACTS = "struct<facts: map<string, map<string, struct<units: map<string, array<struct<start: date, end: date, val: double, filed: date, form: string, accn: string>>>>>>>"


def facts_frame(spark: SparkSession, folder: str, concepts: list[str], unit: str = "USD") -> DataFrame:
    """cik, concept, start, end, days, kind, val, filed, form, accn: a row a fact of the files of a folder, without facts
    that have no start. Files are read and taken apart by Spark, one row a file."""
    docs = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"CIK(\d+)", 1).cast("long").alias("cik"), F.from_json("value", FACTS).alias("d"))
    named = docs.select("cik", F.explode("d.facts").alias("taxonomy", "by_name")).select("cik", F.explode("by_name").alias("concept", "c")).where(F.col("concept").isin(concepts))
    facts = named.select("cik", "concept", F.inline(F.element_at("c.units", unit))).where("start IS NOT NULL")
    days = F.datediff("end", "start") + 1
    kind = F.when(days.between(80, 125), "quarter").when(days.between(350, 380), "annual").otherwise("other")
    return facts.select("cik", "concept", "start", "end", days.alias("days"), kind.alias("kind"), "val", "filed", "form", "accn")


def canonical_titles(files: Files, titles: list[str], api: str) -> dict[str, str]:
    """Each title with the article that it leads to, by one step of spelling and one of redirection."""
    query = urlencode({"action": "query", "titles": "|".join(titles), "redirects": 1, "format": "json"})
    answer = json.loads(files.fetch(f"titles/{quote('_'.join(titles), safe='')[:120]}.json", f"{api}?{query}"))["query"]
    spelled, moved = ({x["from"]: x["to"] for x in answer.get(step, [])} for step in ("normalized", "redirects"))
    return {t: moved.get(s, s) for t in titles for s in [spelled.get(t, t)]}


def page_views(spark: SparkSession, files: Files, article: str, start: str, end: str, base: str) -> DataFrame:
    """article, date, views of one article. An answer is a row a day, so it is small."""
    a, z = start.replace("-", ""), end.replace("-", "")
    title = quote(article.replace(" ", "_"), safe="")
    items = json.loads(files.fetch(f"views/{title}_{a}_{z}.json", f"{base}/{title}/daily/{a}/{z}")).get("items", [])
    rows = spark.createDataFrame([(article, x["timestamp"][:8], int(x["views"])) for x in items], "article string, day string, views long")
    return rows.select("article", F.to_date("day", "yyyyMMdd").alias("date"), "views")
