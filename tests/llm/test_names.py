"""Names of persons where a text has them again without a title."""

from __future__ import annotations

from vesper.llm import pii


def test_bare_mentions_take_the_surrogate():
    text = "Petrova came. Mrs. Anna Petrova spoke; Petrova's friend said that Anna left. xPetrova, Petrova2 and Annapolis stay."
    got, spans = pii.rewrite(pii.Keyed(b"secret"), text, {})
    given, surname = got.split("Mrs. ")[1].split(" spoke")[0].split(" ")
    assert given != "Anna" and surname != "Petrova"
    assert got == f"{surname} came. Mrs. {given} {surname} spoke; {surname}'s friend said that {given} left. xPetrova, Petrova2 and Annapolis stay."
    assert [s["kind"] for s in spans] == ["surname", "given", "surname", "surname", "given"]


def test_a_name_of_four_words():
    got, spans = pii.rewrite(pii.Keyed(b"secret"), "We met Maria Anna Elena Schmidt here.", {})
    assert "Schmidt" not in got and len(spans) == 4


def test_no_name_no_change():
    assert pii.entities("Anna is alone. Monday came, Petrova too.") == []
