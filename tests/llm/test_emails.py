"""E-mail addresses in long runs, against a plain pattern."""

from __future__ import annotations

import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from vesper.llm import pii

PLAIN = re.compile(r"[A-Za-z0-9](?:[\w.%+-]*[\w%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="aB1_.@-é %+", max_size=40))
def test_same_places_as_a_plain_pattern(text):
    assert list(pii._emails(text)) == [m.span() for m in PLAIN.finditer(text)]


def test_addresses_one_after_the_other():
    for text in ("x@foo.com.bar_y@z.org", "é@aa.bb@c.com", "a@b@c.com", "..a@b.cd..e@f.gh", "a.@b.com", "_@b.com é@b.com"):
        assert list(pii._emails(text)) == [m.span() for m in PLAIN.finditer(text)], text


def test_a_million_letters_take_no_time():
    for text in ("a" * 1_000_000 + " x@", "a@" * 500_000, "a." * 500_000 + "@" + "b." * 500_000 + "1", "x@y.co " + "_" * 1_000_000):
        began = time.time()
        list(pii._emails(text))
        assert time.time() - began < 2, text[:10]
    began = time.time()
    pii.entities("a" * 1_000_000 + " me@example.org " + "b@" * 1000)
    assert time.time() - began < 5
