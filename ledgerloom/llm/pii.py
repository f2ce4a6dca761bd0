"""Personal data, plain and disguised (operator 9).

Plain identifiers are found by their patterns. Disguised ones are found in a normalised text: transducers put look-alike
characters, spelled digits and `at`/`dot` disguises into their plain form and keep, for each change, which source
characters it stands for. Spans found there are mapped back to source characters.

Positions are code points. Null texts count as empty and have no span; texts of any length are searched whole in time
proportional to their length; rows are searched one by one, so repeated rows and ids do no harm; an empty table gives
no row. Only doc_id and text are read, and masking changes text alone (and n_chars, if it is there).
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right, insort
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_chunks

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits is taken whole by each pattern, so a match can only begin where one does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches: before each @ as many characters as can be, but none of an earlier match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def plain(text: str) -> list[Span]:
    """The base spans, by start and then kind."""
    found: list[Span] = list(emails(text)) if "@" in text else []
    if DIGITS.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


class Changed:
    """A text with some spans replaced, and the way back."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        parts, at, new = [], 0, 0
        #: For each change: where it begins and ends in the new text, and in the old one.
        self.new_start, self.new_end, self.old_start, self.old_end = [], [], [], []
        for start, end, put in changes:
            parts += [text[at:start], put]
            new += start - at
            self.new_start.append(new)
            self.old_start.append(start)
            new += len(put)
            self.new_end.append(new)
            self.old_end.append(end)
            at = end
        parts.append(text[at:])
        self.text = "".join(parts)

    def start(self, at: int) -> int:
        """Where the new text's character `at` begins in the old one; characters left out before it aren't part of it."""
        k = bisect_right(self.new_start, at) - 1
        if k < 0:
            return at
        return self.old_start[k] if at < self.new_end[k] else self.old_end[k] + at - self.new_end[k]

    def end(self, at: int) -> int:
        """Where the new text's character before `at` ends in the old one."""
        k = bisect_right(self.new_start, at - 1) - 1
        if k < 0:
            return at
        return self.old_end[k] if at - 1 < self.new_end[k] else self.old_end[k] + at - self.new_end[k]


#: Letters of other scripts that look like the Latin letter after them. Fixed values, by the Unicode charts.
LOOK_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуԁɡһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονα", "ABESIJKMHOPCTXYaesijopcxydghqwABEZHIKMNOPTYXova", strict=True))
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2212\ufe63\uff0d"
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
BLANKS = "\u00a0\u2007\u2009\u202f\u3000"
STOPS = "\u3002\uff61"


def _table() -> dict[str, str]:
    """What single characters become. Look-alikes as above; full-width forms and digits of all scripts by rule."""
    table = LOOK_ALIKE | dict.fromkeys(DASHES, "-") | dict.fromkeys(INVISIBLE, "") | dict.fromkeys(BLANKS, " ") | dict.fromkeys(STOPS, ".")
    table |= {chr(x + 0xFEE0): chr(x) for x in range(0x21, 0x7F) if chr(x + 0xFEE0) not in DASHES}
    for x in range(0x80, 0x20000):
        if unicodedata.category(chr(x)) == "Nd" and chr(x) not in table:
            table[chr(x)] = str(unicodedata.digit(chr(x)))
    return table


TABLE = _table()
ODD = re.compile("[" + "".join(map(re.escape, sorted(TABLE))) + "]")
#: Spelled digits. Fixed values.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
WORD = "(?:" + "|".join(SPELLED) + ")"
ONE_SPELLED = re.compile(f"(?i){WORD}")
#: Spelled digits in a row, and such beside numerals; what a mixed run may be is left to the patterns of plain identifiers.
ROW = re.compile(rf"(?i){WORD}(?![A-Za-z])(?:[ ,-]{{1,2}}{WORD}(?![A-Za-z]))*")
PLUS = re.compile(r"(?i)(?<![A-Za-z])plus[ ,-]{1,2}(?=[0-9])")
LABEL = r"[A-Za-z0-9-]+"
#: name (at) host (dot) tld, brackets of any kind or none; a bare `at` or `dot` only counts next to the other one.
AT = r"(?:\s{0,2}[\[({<]\s?(?:at|@)\s?[\])}>]\s{0,2}|\s?@\s?)"
DOT = r"(?:\s{0,2}[\[({<]\s?(?:dot|\.)\s?[\])}>]\s{0,2}|\s(?:dot)\s)"
BRACKETED = re.compile(rf"(?i)(?P<at>{AT})(?={LABEL}(?:(?:{DOT}|\.){LABEL})+)")
BARE = re.compile(rf"(?i)(?<=[A-Za-z0-9_])(?P<at>\s(?:at)\s)(?={LABEL}(?:{DOT}{LABEL})+)")
ONE_LABEL = re.compile(LABEL)
DOTS = re.compile(rf"(?i){DOT}(?={LABEL})")
TOKEN = f"(?:{WORD}(?![A-Za-z])|[0-9]++(?![A-Za-z]))"
MIXED = re.compile(rf"(?i)(?<![A-Za-z0-9]){TOKEN}(?:(?:{DOT}|[ ,-]{{1,2}}|\.){TOKEN})+")
PAIR = re.compile(rf"(?i)(?<![A-Za-z])(?:{WORD}(?:{DOT}|[ ,-]{{1,2}}|\.){TOKEN}|(?<=[0-9])(?:{DOT}|[ ,-]{{1,2}}|\.){WORD}(?![A-Za-z]))")
#: Digits of the least mixed run that may be an identifier, and dots of an ip.
LEAST, OCTET_DOTS = 7, 3
OCTETS = re.compile(rf"(?i)(?<![A-Za-z0-9])[0-9]{{1,3}}(?:(?:{DOT}|\.)[0-9]{{1,3}}){{{OCTET_DOTS}}}(?![0-9])")
EVERY_DOT = re.compile(f"(?i){DOT}")
#: What precedes an `at`: a local part with dots in disguise. Local parts have 64 characters at most, and disguises add to them.
PARTS = re.compile(rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{DOT}[A-Za-z0-9._%+-]+)+\Z")
LOCAL_WINDOW = 256
#: How an address ends whose `at` has no brackets and that has only one dot in disguise. Common top-level
#: domains and those of countries. With two such dots (in the local part or the host) any letters will do.
ENDS = frozenset(
    "com org net edu gov mil int info biz io co name pro mobi app dev xyz online site shop tech store cloud blog club live page email eu uk "
    "ad ae af ag ai al am ao ar at au az ba bb bd be bf bg bh bi bj bn bo br bs bt bw by bz ca cd cf cg ch ci cl cm cn cr cu cv cy cz de dj dk dm do dz "
    "ec ee eg er es et fi fj fm fr ga gb gd ge gh gl gm gn gq gr gt gw gy hk hn hr ht hu id ie il in iq ir is it jm jo jp ke kg kh km kn kp kr kw kz "
    "la lb lc li lk lr ls lt lu lv ly ma mc md me mg mk ml mm mn mo mr mt mu mv mw mx my mz na ne ng ni nl no np nr nz om pa pe pg ph pk pl pr ps pt pw py "
    "qa ro rs ru rw sa sb sc sd se sg si sk sl sm sn so sr ss st sv sy sz td tg th tj tl tm tn to tr tt tv tw tz ua ug us uy uz va vc ve vn vu ws ye za zm zw".split()
)
END = re.compile("[A-Za-z]{2,63}")
HINT = re.compile(r"(?i)\bdot\b|[\[({<]\s?(?:at|@|\.)\s?[\])}>]")


def characters(text: str) -> list[tuple[int, int, str]]:
    """The first transducer: single characters that stand for others."""
    return [(m.start(), m.end(), TABLE[m[0]]) for m in ODD.finditer(text)]


def spelled(text: str) -> list[tuple[int, int, str]]:
    """The second: runs of spelled digits, without what stands between them, if with the numerals beside them they are
    long enough for an identifier or have the dots of an ip."""
    found = []
    for m in MIXED.finditer(text):
        rows = [(m.start() + r.start(), m.start() + r.end(), "".join(SPELLED[x.lower()] for x in ONE_SPELLED.findall(r[0]))) for r in ROW.finditer(m[0])]
        if rows and (len(DIGITS.findall(m[0])) + sum(len(r[2]) for r in rows) >= LEAST or len(EVERY_DOT.findall(m[0])) + m[0].count(".") >= OCTET_DOTS):
            found += rows
    return found


def disguised(text: str) -> list[tuple[int, int, str]]:
    """The third: `at` and `dot` of an address, dots between an ip's octets."""
    found = [(d.start() + m.start(), d.end() + m.start(), ".") for m in OCTETS.finditer(text) for d in EVERY_DOT.finditer(m[0])]
    for pattern in (BRACKETED, BARE):
        for m in pattern.finditer(text):
            if m[0] == "@" or not m.start() or text[m.start() - 1] not in LOCAL:
                change = []
            else:
                change = [(m.start(), m.end(), "@")]
            # The dots of this address: each follows the label before it.
            at, dots, last = m.end(), [], ""
            while label := ONE_LABEL.match(text, at):
                at, last = label.end(), label[0]
                if d := DOTS.match(text, at):
                    dots.append((d.start(), d.end(), "."))
                    at = d.end()
                elif text[at : at + 1] == "." and ONE_LABEL.match(text, at + 1):
                    at += 1
                else:
                    break
            if change or (dots and m[0] == "@"):
                # The dots before the `at`.
                low = max(0, m.start() - LOCAL_WINDOW)
                if parts := PARTS.search(text[low : m.start()]):
                    low += parts.start()
                    dots += [(low + d.start(), low + d.end(), ".") for d in EVERY_DOT.finditer(parts[0])]
                if pattern is BARE and not (last.lower() in ENDS or (len(dots) > 1 and END.fullmatch(last))):
                    continue
                found += change + dots
    found.sort()
    return [x for k, x in enumerate(found) if not k or x[0] >= found[k - 1][1]]


def spans(text: str, base: list[Span] | None = None) -> list[Span]:
    """The base spans, and those of disguised identifiers that overlap no base span of their kind."""
    base = plain(text) if base is None else base
    steps, now, versions = [], text, []
    for hint, transducer in ((ODD, characters), (PAIR, spelled), (HINT, disguised)):
        if (hint is not ODD or not text.isascii()) and hint.search(now) and (changes := transducer(now)):
            steps.append(Changed(now, changes))
            now = steps[-1].text
            versions.append((now, len(steps)))
    if not steps:
        return base
    if m := list(PLUS.finditer(now)):
        steps.append(Changed(now, [(x.start(), x.end(), "+") for x in m]))
        versions.append((steps[-1].text, len(steps)))
    more = []
    taken = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    # What a later step has joined to a neighbour may stand alone before it, so each step's text is searched, the last first.
    for now, depth in reversed(versions):
        for kind, start, end in plain(now):
            a, b = start, end
            for step in reversed(steps[:depth]):
                a, b = step.start(a), step.end(b)
            k = bisect_right(taken[kind], (b - 1, 1 << 60)) - 1
            if text[a:b] != now[start:end] and (k < 0 or taken[kind][k][1] <= a):
                more.append((kind, a, b))
                insort(taken[kind], (a, b))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches):
            counts, digests, every = {k: [] for k in KINDS}, [], []
            for x in part.column(1).to_pylist():
                base = plain(x or "")
                kinds = [k for k, _, _ in base]
                for k in KINDS:
                    counts[k].append(kinds.count(k))
                digests.append(sha256(joined(base).encode()).hexdigest())
                every.append(joined(spans(x or "", base)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def masked_text(text: str, found: list[Span]) -> str:
    """The text with its spans replaced by their kinds' names; overlapping ones become one, named by the first."""
    parts, at = [], 0
    for kind, a, b in found:
        if a < at:
            if b > at:
                at = b
            continue
        parts += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """`docs` with personal data masked in column text; null texts stay null; n_chars, if there, follows the text."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches):
            at = part.schema.get_field_index("text")
            texts = [x if x is None else masked_text(x, spans(x)) for x in part.column(at).to_pylist()]
            arrays = [part.column(k) if k != at else pa.array(texts, pa.string()) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays(arrays, part.schema.names)

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out
