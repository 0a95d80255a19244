"""Which texts are not cut into units, against the rule as expressions."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from skylattice.llm import units

SPACE_BEFORE, OTHER = re.compile(r" (?:\s|\Z)").search, re.compile(r"[^\S \n]").search


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r\x1c\x85\xa0   　abé."), st.characters(codec="utf-8")), max_size=12))
def test_unsafe_texts(text):
    want = bool("\n\n\n" in text or text.endswith("\n\n") or SPACE_BEFORE(text) or OTHER(text) or "\n " in text)
    assert units.unsafe(text) == want


def test_every_white_space_is_known():
    import sys

    assert all(units.unsafe(f"a{c}b") for c in map(chr, range(sys.maxunicode + 1)) if OTHER(c))
