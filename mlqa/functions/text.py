"""Column -> Column text helpers (completion parsing and normalisation, D1-D11).

All built-in expressions (whole-stage codegen). Python's ``str.strip`` and ``\\s``
are Unicode-aware while Spark's ``trim`` and Java's ``\\s`` are not, hence the
``(?U)`` patterns. Regexes are raw Python strings handed to the DataFrame API, so
no SQL-literal unescaping happens.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mlqa.functions.util import col_of

_WS_EDGES = r"(?U)^\s+|\s+\z"


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col_of(c), _WS_EDGES, "")


def norm_text(c) -> Column:
    """Collapse whitespace runs to one space, strip, lower-case."""
    return F.lower(strip(F.regexp_replace(col_of(c), r"(?U)\s+", " ")))


def open_think(c, mode: str = "always") -> Column:
    """Prefix ``<think>``.

    ``always``        unconditional (format and exact rewards)
    ``if_absent``     only when the text contains no ``<think>`` (fuzzy reward)
    ``if_not_prefix`` only when the text does not start with it (language rewards)
    """
    c = col_of(c)
    tag = F.lit("<think>")
    if mode == "always":
        return F.concat(tag, c)
    if mode == "if_absent":
        return F.when(F.instr(c, "<think>") > 0, c).otherwise(F.concat(tag, c))
    if mode == "if_not_prefix":
        return F.when(c.startswith("<think>"), c).otherwise(F.concat(tag, c))
    raise ValueError(mode)


def _tag_bounds(c: Column, tag: str):
    opener, closer = f"<{tag}>", f"</{tag}>"
    p = F.instr(c, opener)
    start = p + F.lit(len(opener))
    # first closer at or after the end of the first opener
    q = F.call_function("locate", F.lit(closer), c, start)
    return p, start, q


def tag_body(c, tag: str) -> Column:
    """Raw body of the first closed block (regex ``<tag>(.*?)</tag>`` with DOTALL);
    NULL when there is none. An empty block gives ``''``, not NULL."""
    c = col_of(c)
    p, start, q = _tag_bounds(c, tag)
    return F.when((p > 0) & (q > 0), F.substring(c, start, q - start))


def extract_tag(c, tag: str) -> Column:
    """First block of ``tag``, stripped; NULL when no closed block."""
    return strip(tag_body(c, tag))


def extract_tag_or_empty(c, tag: str) -> Column:
    """Generation parser form: ``''`` instead of NULL when there is no block."""
    return F.coalesce(extract_tag(c, tag), F.lit(""))


def repair_tags(c) -> Column:
    """Append ``</think>`` at the end when missing, then an answer block
    (placeholder text) when ``<answer>`` is missing, else ``</answer>`` when
    only the closer is missing."""
    c = col_of(c)
    t = F.when(F.instr(c, "</think>") > 0, c).otherwise(F.concat(c, F.lit("</think>")))
    return (F.when(F.instr(t, "<answer>") == 0,
                   F.concat(t, F.lit("\n<answer>" + UNABLE_ANSWER + "</answer>")))
             .when(F.instr(t, "</answer>") == 0, F.concat(t, F.lit("</answer>")))
             .otherwise(t))


def strip_echo(out, prompt) -> Column:
    """Remove every occurrence of the prompt from the output, then strip."""
    return strip(F.replace(col_of(out), col_of(prompt), F.lit("")))


def chunk_text(c, n: int = 100) -> Column:
    """Array of consecutive ``n``-character pieces (last one shorter), in one linear pass."""
    pieces = F.regexp_extract_all(col_of(c), F.lit(f"(?s)(.{{1,{n}}})"), F.lit(1))
    return F.coalesce(pieces, F.array().cast("array<string>"))


def split_sentences(c) -> Column:
    """Split after ``.!?`` + whitespace and at newlines; stripped, non-empty."""
    parts = F.split(col_of(c), r"(?U)(?<=[.!?])\s+|\n")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 0)


# Zero code points of the Unicode decimal-digit blocks mapped to
# ASCII before number extraction, because Python's \d (and float()) accept them.
_DIGIT_ZEROS = (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66,
                0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0DE6, 0x0E50, 0x0ED0, 0x0F20,
                0x1040, 0x17E0, 0x1810, 0xFF10)
_DIGIT_SRC = "".join(chr(z + d) for z in _DIGIT_ZEROS for d in range(10))
_DIGIT_DST = "0123456789" * len(_DIGIT_ZEROS)

NUMBER_PATTERN = r"[-+]?\d*\.\d+|\d+"


def ascii_digits(c) -> Column:
    return F.translate(col_of(c), _DIGIT_SRC, _DIGIT_DST)


def extract_numbers(c) -> Column:
    """Numbers in the text as doubles; the sign only binds to decimals."""
    found = F.regexp_extract_all(ascii_digits(c), F.lit(NUMBER_PATTERN), 0)
    return F.transform(found, lambda s: s.cast("double"))


def key_words(c) -> Column:
    """Whitespace tokens longer than 3 characters, or all tokens if none."""
    toks = F.filter(F.split(strip(c), r"(?U)\s+"), lambda w: F.length(w) > 0)
    long_ = F.filter(toks, lambda w: F.length(w) > 3)
    return F.when(F.size(long_) > 0, long_).otherwise(toks)


# Fixed value: placeholder answer appended to generations without an answer block.
UNABLE_ANSWER = "Unable to generate a complete answer"
