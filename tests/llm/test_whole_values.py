"""Values that stand next to other digits (personal data) are found whole."""

import re

import pytest

from mlqa.llm import pii_fpe


def kinds(text):
    return dict(pii_fpe.Pseudonyms("k").replace(text)[1])


def new(value):
    out, found = pii_fpe.Pseudonyms("k").replace(value)
    assert sum(found.values()) == 1, value
    return out


@pytest.mark.parametrize("value, behind, more", [
    ("+1 (826) 555-4081", " 190.137.223.204", "ip"), ("+1 (826) 555-4081", " 2021-03-04", "date"),
    ("+49 30 555 4081", " 190.137.223.204", "ip"), ("+49 30 555 4081", " 4845168114407329", "card"),
    ("+1 826-555-4081", " 1900 22", None), ("+33 1 42 68 53 00", " x", None), ("+33 1 42 68 53 00", "", None),
    ("4111 1111 1111 1111", " 12/27", None), ("4111111111111111", " 123", None), ("4845168114407329", " 12 34", None),
    ("4111 1111 1111 1111", "-12/27", None), ("378282246310005", " 1234", None),
    ("BE68 5390 0754 7034", " AND", None), ("ES91 2100 0418 4502 0005 1332", " 12", None),
    ("DE89 3704 0044 0532 0130 00", " 4111 1111 1111 1111", "card")])
def test_values_do_not_run_into_what_follows(value, behind, more):
    text = value + behind
    out, found = pii_fpe.Pseudonyms("k").replace(text)
    follows = new(behind) if more else behind
    assert out == new(value) + follows and sum(found.values()) == 1 + bool(more)
    assert pii_fpe.Pseudonyms("k", True).replace(out)[0] == text


def test_later_starts_and_other_kinds():
    out, found = pii_fpe.Pseudonyms("k").replace("order 9807 4111 1111 1111 1111 done")
    assert found == {"card": 1} and out == f"order 9807 {new('4111 1111 1111 1111')} done"
    assert kinds("+1 4111 1111 1111 1111") == {"card": 1}
    for kept in ("1 2 3 4 5 6 7 8 9 10 11 12 13", "9807 9157 6280 4490", "4 31 2020 12 13 14"):
        assert kinds(kept) == {}, kept
    assert re.fullmatch(r"\+33( \d\d?){5}", new("+33 1 42 68 53 00"))
