import re

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import license_scan as ls

EXPR = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return EXPR.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def as_pattern(template):
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    for m in ls.MARK.finditer(template):
        if m[0] == "<<?":
            out += "(?:(?:"
        elif m[0] == "?>>":
            out += ")?)"
        elif m[0] == "|":
            out += "|"
        elif m[1]:
            out += f"(?:[^ ]+ ){{0,{m[1]}}}"
        else:
            out += "".join(re.escape(w) + " " for w in words_of(m[0]))
    return re.compile(out)


TEST = {"a": "x <<? y | z w ?>> v", "b": "<<? x ?>> y <<~2>> w", "c": "x <<? y <<? z ?>> ?>> x"}


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("xyzwv"), max_size=10))
def test_automata_accept_what_the_markup_says(words):
    for label, template in TEST.items():
        a, p = ls.compiled(label, template), as_pattern(template)
        for k in range(len(words)):
            rest = "".join(f"{x} " for x in words[k:])
            assert (a.run([x.encode() for x in words], k) >= 0) == bool(p.match(rest)), (template, words, k)


def test_templates_against_expressions():
    patterns = {k: as_pattern(v) for k, v in ls.TEMPLATES.items()}
    texts = [
        "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
        "Copyright (c) 2020 Some One. All rights reserved.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Neither the name of the copyright holder nor names of its contributors may be used", "the mit  license apache-license general public LICENSE", "under the terms of the MIT license",
    ]
    for text in texts:
        words = words_of(text)
        got = {x for _, _, x in ls.scanner().scan(text.encode().lower())[2]}
        want = {k for k, p in patterns.items() for at in range(len(words)) if p.match("".join(f"{x} " for x in words[at:]))}
        assert got == want, text
    assert {x for _, _, x in ls.scanner().scan(texts[3].encode().lower())[2]} == {"cc-by-nc-4.0"}


def test_hints_miss_nothing():
    for text in ls.TEMPLATES.values():
        assert ls.scanner().hints.search(text.lower().encode())


@given(st.text(st.sampled_from("aZ0 .é-_\n中/@[`{"), max_size=30))
def test_words(text):
    low = text.encode().lower()
    assert [x.encode() for x in words_of(text)] == ls.WORD.findall(low)
    assert ls.count_words(low) == len(words_of(text))


def test_query(spark, odd_docs):
    extra = spark.createDataFrame([(60, "An MIT license, the MIT License; GNU General Public License, version 3!", "q", 1)], odd_docs.schema)
    rows = {r.doc_id: r for r in ls.judged(odd_docs.unionByName(extra)).collect()}
    r = rows[60]
    # The notice wants "the" ahead of GNU; here are phrases alone.
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (12, 3, 1, 7, "gpl,mit", "gpl,mit", 0.5)
    assert (rows[0].n_words, rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (0, 0, None, "", 0.0)
    for d in odd_docs.collect():
        if d.doc_id not in (None, 3):
            assert rows[d.doc_id].n_words == len(words_of(d.text or ""))
    assert ls.judged(odd_docs.where("false")).collect() == []


def brute(text):
    """The query's row by regular expressions over the words, templates included."""
    words = words_of(text or "")
    flat = [f"{x} " for x in words]
    at = [(k, label) for phrase, label in ls.PHRASES.items() for k in range(len(words)) if " ".join(words[k : k + len(phrase.split())]) == phrase]
    runs = {x for x, p in PATTERNS.items() for k in range(len(words)) if p.match("".join(flat[k:]))}
    base = {x for _, x in at}
    places = [k for k, _ in at]
    score = 1.0 if runs & set(ls.WHOLE) else 0.8 if runs & set(ls.NOTICES) else 0.6 if runs else 0.5 if at else 0.0
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | runs)), score


PATTERNS = {k: as_pattern(v) for k, v in ls.TEMPLATES.items()}


def written_out(template):
    """A text that the template accepts: first branches, and a name where any words may stand."""
    while "<<?" in template:
        template = re.sub(r"<<\?((?:(?!<<\?|\?>>).)*)\?>>", lambda m: m[1].split(" | ")[0], template)
    return re.sub(r"<<~\d+>>", "the Holders of It", template)


def test_whole_wordings(spark):
    """Each license's own text has its label and score 1; with a mandatory word changed or the end cut off it has not."""
    rows, want = [], {}
    for k, (label, template) in enumerate(ls.WHOLE.items()):
        text = f"Copyright 2020 Some One\n\n{written_out(template)}."
        words = text.split(" ")
        for n, x in enumerate([text, " ".join(words[:-30]), " ".join([*words[:-12], "indeed", *words[-12:]])]):
            rows.append((10 * k + n, x))
            want[10 * k + n] = (label, n == 0)
    got = {r.doc_id: r for r in ls.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (label, whole) in want.items():
        assert (label in got[k].labels.split(",")) == whole and (got[k].score == 1.0) == whole, (label, k)


def test_every_row_against_brute_force(spark, odd_docs):
    from ledgerloom.llm.queries import op6_license_scan

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in op6_license_scan(spark, d).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(texts[r.doc_id]), r.doc_id


def test_hints_stand_inside_words_too():
    """What separates words for the automata separates them for the first look as well."""
    for text in ["dedicated to the public_domain under CC0", "The-MIT_LICENSE", "licensed under\x00the Apache\tLicense_Version 2.0", "copyright\xa9all rights reserved"]:
        low = text.encode("latin-1", "replace").lower() if "\xa9" not in text else text.replace("\xa9", " ").encode().lower()
        assert bool(ls.scanner().hints.search(low)) >= bool(ls.scanner().scan(low)[1] or ls.scanner().scan(low)[2])
    assert ls.scanner().hints.search(b"dedicated to the public_domain under cc0")
