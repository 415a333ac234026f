"""One long text never stops a task: linear finders against the plain patterns, and hostile texts."""

import random
import re
import time

import pytest
import regex

from mlqa.llm import langid_fusion, license_fuzzy, pii_fpe

SHOWN = regex.compile(r"(?is)<(script|style|template|nav)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]+;", regex.ASCII)
LANG = regex.compile(r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", regex.ASCII)
PARTS = ["<script", "<SCRIPT>", "</script >", "</script", ">", "<", "<!--", "-->", "<!-->", "a", " ", "&amp;", "&", "<nav>", "</nav>",
         "<b>", "</b>", "<html", " lang=", "en", '"de"', " lang='fr'", "\n", "é", "<style x", "</style>"]


def test_visible_text_and_language_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(20000):
        html = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(14)))
        assert langid_fusion.visible_text(html) == SHOWN.sub(" ", html), html
        m = LANG.search(html)
        assert langid_fusion.declared_language(html) == (m[1].lower() if m else ""), html


def test_mails_are_found_as_by_the_pattern():
    rnd, mail = random.Random(2), re.compile(dict(pii_fpe.KINDS)["email"])
    for _ in range(20000):
        text = "".join(rnd.choice(["a", "b.", "@", "@x.com", ".", "-", " ", "é", "1", "%", "org"]) for _ in range(rnd.randrange(14)))
        mails, at, got = pii_fpe._Mails(text), 0, []
        while (start := mails.start(at)) is not None:
            got.append((start, mails.end))
            at = mails.end
        assert got == [m.span() for m in mail.finditer(text)], text


def test_secrets_of_any_length_are_replaced_and_linked():
    maker, back = pii_fpe.Pseudonyms("k"), pii_fpe.Pseudonyms("k", True)
    for n in (32, 128, 129, 1000):
        value = ("0123456789abcdef" * n)[:n]
        new, found = maker.replace(f"key {value} end")
        assert found["secret"] == 1 and value not in new and len(new) == n + 8
        assert back.replace(new)[0] == f"key {value} end"


MB = 1 << 20
HOSTILE = {"script": "<script " * (MB // 8), "comment": "<!-- " * (MB // 5), "angle": "<" * MB, "html": "<html " * (MB // 6),
           "lang": " lang=en" * (MB // 8), "run": "a1" * (MB // 2), "dots": "a.b-1" * (MB // 5), "signs": "a@" * (MB // 2),
           "mails": "a@b.co " * (MB // 70), "hex": "0a" * (MB // 2), "pieces": "license permission " * (MB // 19),
           "phrases": "cc by nc " * (MB // 9), "letters": "a" * MB, "blanks": " " * MB}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_of_one_megabyte(name):
    text, notices = HOSTILE[name], [license_fuzzy.Notice(t, label, 0.1) for t, label in license_fuzzy.NOTICES]
    for f in (langid_fusion.visible_text, langid_fusion.declared_language, pii_fpe.Pseudonyms("k").replace,
              lambda t: license_fuzzy.scan(" ".join(t.split()), notices)):
        begun = time.process_time()
        f(text)
        assert time.process_time() - begun < 10, (name, f)
