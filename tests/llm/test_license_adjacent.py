"""Edited and exact notices next to each other, against every stretch of the text."""

import random

from mlqa.llm import license_fuzzy

TEXT = "licensed under cc by nc 4 0"


def distances(s, notice, k):
    """(start, end): edits, for all stretches within k edits of the notice."""
    out = {}
    for a in range(len(s)):
        row = list(range(len(notice) + 1))
        for b in range(a, min(len(s), a + len(notice) + k)):
            new = [row[0] + 1]
            for j, ch in enumerate(notice):
                new.append(min(row[j] + (ch != s[b]), row[j + 1] + 1, new[j] + 1))
            row = new
            if row[-1] <= k:
                out[a, b + 1] = row[-1]
    return out


def test_edited_notice_before_an_exact_one():
    notice = license_fuzzy.Notice(TEXT, "cc", 0.1)
    assert notice.matches(f"licensed undr cc by nc 4 0 {TEXT}") == [(0, 26, 1), (27, 54, 0)]
    many = " ".join(["licensed undr cc by nc 4 0", TEXT, "licensd undr cc by nc 4 0"] * 200)
    assert [e for _, _, e in notice.matches(many)] == [1, 0, 2] * 200


def test_adjacent_notices_against_brute_force():
    rnd = random.Random(5)
    notice = license_fuzzy.Notice(TEXT, "cc", 0.1)
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(2, 4)):
            s = list(TEXT)
            for _ in range(rnd.randint(0, notice.k + 1)):
                i = rnd.randrange(len(s))
                s[i:i + 1] = rnd.choice([[], [s[i], "q"], ["z"]])
            parts.append("".join(s))
        text = rnd.choice([" ", "", " and "]).join(parts)
        got, every = notice.matches(text), distances(text, TEXT, notice.k)
        assert all(every[a, b] == e for a, b, e in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:])), text
        # each possible match is reported or overlaps one that is no worse
        assert all(any(a < y and x < b and f <= e for x, y, f in got) for (a, b), e in every.items()), text
