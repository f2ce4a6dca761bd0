"""Disguises by dots and spelled digits outside of an address's domain."""

import pytest

from ledgerloom.llm import pii


@pytest.mark.parametrize(
    "kind,span",
    [
        ("ip", "192[.]168[.]0[.]1"),
        ("ip", "192 dot 168 dot 0 dot 1"),
        ("ip", "one nine two dot one six eight dot zero dot one"),
        ("ip", "192.168.zero.one"),
        ("email", "john dot doe at example dot com"),
        ("email", "john[.]doe[at]example[.]com"),
        ("email", "john (dot) q (dot) doe@example dot com"),
        ("email", "john at example dot dev"),
        ("email", "ann at mail dot example dot xyz"),
        ("card", "4111 1111 1111 one one one one"),
        ("card", "four one one one 1111 1111 1111"),
    ],
)
def test_found_and_masked_whole(kind, span):
    text = f"Write to {span}, please."
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == [(kind, span)]
    assert pii.masked_text(text, pii.spans(text)) == f"Write to <{kind.upper()}>, please."


def test_left_alone():
    for text in ("In 2019 one of 3 came at noon.", "300 dot 1 dot 1 dot 1", "4111 1111 1111 one one one two", "We met at 5, two or three."):
        assert pii.spans(text) == []


def test_neighbours_do_not_hide_what_a_step_before_shows():
    text = "one \uff14111 1111 1111 1111"
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == [("card", text[4:])]
