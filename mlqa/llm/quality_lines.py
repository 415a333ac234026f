"""Line-first quality cleaning (DataFrame functions only).

Each line is judged on its own and by rate, so that one hit never fails a long line:
navigation bars (separators per word; quotation marks in pairs are none), boilerplate (in
short lines), shouting (per word), symbol noise (per word), stutter (in windows of
``STUTTER_WINDOW`` words that hold half of the line), a long line without any sentence mark
of any script, and repeats of an earlier line fail. Failed lines are removed; a
document goes when its base measures fail or when the removed lines held more
than ``max_loss`` of its words.

Defined results: a null text counts as empty (no words, ``base_failed``);
repeated rows are judged alike, independently; an empty table gives an empty
table; all other input columns pass through, and an input column that has the
name of a measure is replaced by it.

Everything is computed inside the row, so there is no shuffle and no hot key;
the work per text is O(n log n) in its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
MAX_LOSS = 0.4
MIN_WORDS = 10

# Rules on one line; the patterns read alike in Java and RE2.
BARS_LEAST, BARS_PCT = 3, 10  # so many separators, and per 100 words: a navigation bar
QUOTES = (("«", "»"), ("‹", "›"))     # a pair quotes, only a surplus of the second kind separates
SHORT_LINE_WORDS = 25         # boilerplate fails a line up to this length
SHOUTS_PCT = 10               # shouts ("!!") per 100 words that fail a line with a shouted word
BOILERPLATE = ["cookie policy", "cookie settings", "cookie consent", "all rights reserved", "terms of use",
               "terms and conditions", "privacy policy", "click here", "sign up", "subscribe to",
               "enable javascript", "lorem ipsum", "skip to content"]
SHOUTING = r"[A-Z]{2,}[^a-z]*!!"
SENTENCE_MARK = r"[.!?:;。！？：；…।॥؟؛۔։።፧។၊။།]"
LONG_LINE_WORDS = 40          # a longer line must hold a sentence mark
SYMBOL_WORDS_PCT = 20         # symbols per 100 words that a line may hold
STUTTER_WORDS = 8             # from this many words on, a line needs varied words
STUTTER_DISTINCT_PCT = 25
STUTTER_WINDOW = 50


def words_of(line: Column) -> Column:
    """Array of the words of a line (no line feed in it); empty for white space.
    Plain replacements and a one-character split cost far less than a regular
    expression."""
    odd = line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c")
    return F.array_remove(F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " "), "")


def _n_symbols(text: Column) -> Column:
    any_of = text.contains(SYMBOLS[0])
    for ch in SYMBOLS[1:]:
        any_of = any_of | text.contains(ch)
    return F.when(any_of, F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))).otherwise(F.lit(0))


def _count(line: Column, part: str) -> Column:
    return F.floor((F.length(line) - F.length(F.replace(line, F.lit(part), F.lit("")))) / len(part))


def _bars(line: Column) -> Column:
    bars = _count(line, "|")
    for opened, closed in QUOTES:
        bars = bars + F.greatest(_count(line, closed) - _count(line, opened), F.lit(0))
    return bars


def _stutters(hashes: Column) -> Column:
    """Whether windows with few different words hold half of the line's words."""
    poor = lambda w: F.size(F.array_distinct(w)) * 100 < F.size(w) * STUTTER_DISTINCT_PCT
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STUTTER_WINDOW).cast("int")),
                          lambda i: F.slice(hashes, i * STUTTER_WINDOW + 1, STUTTER_WINDOW))
    held = F.aggregate(F.filter(windows, poor), F.lit(0), lambda a, w: a + F.size(w))
    return F.when(n < STUTTER_WORDS, False).when(n <= STUTTER_WINDOW, poor(hashes)).otherwise(held * 2 >= n)


def _line_ok(line: Column, low: Column, hashes: Column, doc_symbols: Column) -> Column:
    """Verdict on one line with at least one word; ``low`` is the line in lower case,
    ``hashes`` those of its words."""
    n = F.size(hashes)
    boiler = low.contains(BOILERPLATE[0])
    for phrase in BOILERPLATE[1:]:
        boiler = boiler | low.contains(phrase)
    separator = line.contains("|")
    for _, closed in QUOTES:
        separator = separator | line.contains(closed)
    return ~(
        (separator & (_bars(line) >= BARS_LEAST) & (_bars(line) * 100 >= n * BARS_PCT))
        | ((n <= SHORT_LINE_WORDS) & boiler)
        | (line.contains("!!") & line.rlike(SHOUTING) & (_count(line, "!!") * 100 >= n * SHOUTS_PCT))
        | ((doc_symbols > 0) & (_n_symbols(line) * 100 > n * SYMBOL_WORDS_PCT))
        | ((n >= LONG_LINE_WORDS) & ~line.rlike(SENTENCE_MARK))
        | _stutters(hashes)
    )


def measure(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """``docs`` with the base measures, ``cleaned_text``, ``lost_words``,
    ``base_failed`` and ``kept``.

    The words are split once, line by line (a line feed is white space, so a text's
    words are its lines' words). ``n_repeat_words`` counts the words covered by 5-word
    windows that occur twice or more. Words and windows are compared by 64-bit
    hashes; equal windows are found by sorting the (hash, start) pairs, and only in
    texts that have an equal pair. Every intermediate array is a column of its own,
    so that no lambda computes it again for each element.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words",
                "cleaned_text", "base_failed", "kept"]
    d = docs.drop(*[c for c in measures if c != text])
    own = d.columns
    hashed = lambda words: F.transform(words, lambda x: F.xxhash64(x))
    d = d.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.select(*own, "_t", F.split("_t", "\n").alias("_all"))
    d = d.select("*", F.transform("_all", words_of).alias("_aw"))
    d = d.select(*own, "_t", "_all", F.transform("_aw", hashed).alias("_ah"),
                 F.length(F.array_join(F.transform("_aw", lambda x: F.array_join(x, "")), "")).cast("bigint")
                 .alias("word_chars"))
    ah = F.col("_ah")
    d = d.select(*own, "_t", "_ah", "word_chars", F.flatten("_ah").alias("_h"),
                 F.filter("_all", lambda x, i: F.size(F.get(ah, i)) > 0).alias("_lines"),
                 _n_symbols(F.col("_t")).cast("bigint").alias("n_symbols"))
    h = F.col("_h")
    n = F.size("_h")
    windows = F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)])),
                      1, F.greatest(n - 4, F.lit(0)))
    d = d.select(*own, "_t", "_ah", "word_chars", "n_symbols", n.cast("bigint").alias("n_words"), windows.alias("_win"),
                 "_lines", F.array_distinct("_lines").alias("_uniq"))
    n_dup = F.size("_lines") - F.size("_uniq")
    pairs = F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    d = d.select(*own, "_t", "word_chars", "n_symbols", "n_words", "_uniq", n_dup.cast("bigint").alias("n_dup_lines"),
                 F.when(n_dup == 0, F.filter("_ah", lambda x: F.size(x) > 0))
                 .otherwise(F.transform("_uniq", lambda x: hashed(words_of(x)))).alias("_lh"),
                 F.transform("_uniq", F.lower).alias("_low"),
                 F.when(F.size(F.array_distinct("_win")) < F.size("_win"), pairs).alias("_pairs"))
    lh, low = F.col("_lh"), F.col("_low")
    d = d.select("*", F.transform("_uniq", lambda x, i: _line_ok(x, F.get(low, i), F.get(lh, i), F.col("n_symbols")))
                 .alias("_ok")).drop("_low")
    p, ok = F.col("_pairs"), F.col("_ok")
    repeated = F.filter(
        F.transform("_pairs", lambda x, i: F.when(
            (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]), x["i"])),
        lambda x: x.isNotNull())
    d = d.select("*", F.when(p.isNotNull(), F.sort_array(repeated)).alias("_at"))
    at = F.col("_at")
    steps = F.transform("_at", lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(5)), F.lit(5)))
    zero = F.lit(0).cast("bigint")
    # a line that passes counts once: its repeats fail
    stays = F.aggregate(F.transform("_lh", lambda x, i: F.when(F.get(ok, i), F.size(x).cast("bigint")).otherwise(zero)),
                        zero, lambda a, x: a + x)
    d = d.select("*", F.coalesce(F.aggregate(steps, zero, lambda a, x: a + x), zero).alias("n_repeat_words"),
                 (F.col("n_words") - stays).alias("lost_words"))
    d = d.withColumn("cleaned_text", F.when(F.col("lost_words") == 0, F.col("_t"))
                     .otherwise(F.array_join(F.filter("_uniq", lambda x, i: F.get(ok, i)), "\n")))
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    d = d.withColumn("kept", ~F.col("base_failed")
                     & (F.col("lost_words") <= F.col("n_words") * F.lit(float(max_loss))))
    return d.select(*[c for c in own if c not in measures or c == text], *[c for c in measures if c != text])


def clean_documents(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """Documents that stay, with the failed lines removed; columns as in ``docs``
    (``n_chars``, if there, is the new length)."""
    # the row number keeps the optimiser from pushing the filter below the measures, which
    # would write their whole expression tree out in the condition
    m = measure(docs, text, max_loss).withColumn("_row", F.monotonically_increasing_id())
    m = m.filter((F.col("_row") >= 0) & F.col("kept"))
    out = {c: F.col(c) for c in docs.columns}
    out[text] = F.col("cleaned_text")
    if "n_chars" in out:
        out["n_chars"] = F.length("cleaned_text").cast(docs.schema["n_chars"].dataType)
    return m.select(*[v.alias(k) for k, v in out.items()])


def _sql_words(x: str) -> str:
    return f"regexp_extract_all({x}, '[^\\x20\\x09-\\x0D]+')"


def oracle_sql(max_loss: float = MAX_LOSS) -> str:
    """DuckDB SQL for the query: word lists, unnested windows, unnested lines."""
    boiler = " OR ".join(f"contains(lower(x), '{p}')" for p in BOILERPLATE)
    count = lambda ch: f"(length(x) - length(replace(x, '{ch}', '')))"
    bars = " + ".join([count("|"), *(f"greatest({count(z)} - {count(a)}, 0)" for a, z in QUOTES)])
    poor = f"len(list_distinct(v)) * 100 < len(v) * {STUTTER_DISTINCT_PCT}"
    windows = (f"list_transform(range(0, (len(xw) - 1) // {STUTTER_WINDOW} + 1), "
               f"lambda i: xw[i * {STUTTER_WINDOW} + 1:(i + 1) * {STUTTER_WINDOW}])")
    held = f"coalesce(list_sum(list_transform(list_filter({windows}, lambda v: {poor}), lambda v: len(v))), 0)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_sql_words('t')} AS w, string_split(t, chr(10)) AS l FROM d),
win AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, w[i + 1:i + 5] AS g FROM win),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM r WHERE n > 1),
rep AS (SELECT doc_id, sum(least(5, coalesce(j - i, 5))) AS n_repeat FROM s GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(l) AS x FROM w),
lw AS (SELECT doc_id, x, {_sql_words('x')} AS xw, count(*) AS n FROM ln
       WHERE len({_sql_words('x')}) > 0 GROUP BY doc_id, x),
lv AS (SELECT doc_id, n, len(xw) AS k, NOT (
         (({bars}) >= {BARS_LEAST} AND ({bars}) * 100 >= len(xw) * {BARS_PCT})
         OR (len(xw) <= {SHORT_LINE_WORDS} AND ({boiler}))
         OR (regexp_matches(x, '{SHOUTING}') AND ({count("!!")}) // 2 * 100 >= len(xw) * {SHOUTS_PCT})
         OR (length(x) - length(translate(x, '{SYMBOLS}', ''))) * 100 > len(xw) * {SYMBOL_WORDS_PCT}
         OR (len(xw) >= {LONG_LINE_WORDS} AND NOT regexp_matches(x, '{SENTENCE_MARK}'))
         OR (len(xw) >= {STUTTER_WORDS} AND {held} * 2 >= len(xw))) AS ok
       FROM lw),
la AS (SELECT doc_id, sum(n - 1) AS n_dup, sum(CASE WHEN ok THEN k ELSE 0 END) AS stay FROM lv GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
        CAST(len(w) - coalesce(stay, 0) AS BIGINT) AS lost_words
      FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN la USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
       (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 20) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * 20)
         AND lost_words <= n_words * {float(max_loss)} AS kept
FROM m
"""
