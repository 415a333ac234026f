"""URL filtering with a token-indexed rule list (DataFrame functions only).

Two rule sets judge a URL:

* *host rules* ``(verdict, host, path prefix)``: a rule fits its host and every
  subdomain when the path starts with its prefix; the longest fitting rule wins.
* *pattern rules* ``(verdict, pattern)`` in the public block-list notation: ``*``
  any characters, ``^`` a separator or the end, ``|`` at an edge the edge of the
  URL, ``||`` the start of a host label. A pattern becomes one regular
  expression. Its *whole tokens* (letter/digit runs closed on both sides by
  something other than ``*``) must each be a token of any URL that it matches, so
  the pattern is stored under the rarest of them, by a grouped count over the
  URLs at hand. A URL's tokens fetch its candidate patterns, and only those run
  their regular expressions. A pattern without a whole token is a candidate for
  every URL. ``allow`` patterns win over ``block`` patterns.

A host rule's verdict wins over the patterns; with neither the verdict is allow.

Defined results: a null URL or one without ``://`` has empty host and path and no
rule, and is judged by the patterns alone (null: as an empty text). Repeated
rows are judged alike. Other input columns pass through; input columns named like
a result column are replaced. The row identity used between the steps is the
URL text itself, so page ids need not be unique or non-null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOST_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

# A small production list in block-list notation (trackers, print views, session links, feeds).
PATTERN_RULES = [
    ("block", "?page=*&ref="),
    ("block", "^utm_source="),
    ("block", "^sessionid="),
    ("block", "||ads."),
    ("block", "||tracker."),
    ("block", "/print/"),
    ("block", "/wp-login.php"),
    ("block", "/feed/|"),
    ("block", "/login^"),
    ("block", "#top|"),
    ("block", "*.exe|"),
    ("allow", "||docs.*^ref="),
    ("allow", "^license^"),
]

TOKEN = r"[a-z0-9]+"


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern (for lower-cased URLs; Java and RE2)."""
    body, head, tail = pattern.lower(), "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    out = []
    for ch in body:
        if ch == "*":
            out.append(".*")
        elif ch == "^":
            out.append(r"(?:[^a-z0-9_.%-]|$)")
        elif ch.isalnum() or ch in "/_=&-: ":
            out.append(ch)
        else:
            out.append("[" + ch + "]" if ch not in "\\^]" else "\\" + ch)
    return "(?s)" + head + "".join(out) + tail


def whole_tokens(pattern: str) -> list[str]:
    """Letter/digit runs of a pattern that are whole tokens of every match: the
    neighbour on each side is a literal character, ``^`` or an anchored edge."""
    p, found, i = pattern.lower(), [], 0
    while i < len(p):
        if not (p[i].isascii() and p[i].isalnum()):
            i += 1
            continue
        j = i
        while j < len(p) and p[j].isascii() and p[j].isalnum():
            j += 1
        if i > 0 and p[i - 1] != "*" and j < len(p) and p[j] != "*":
            found.append(p[i:j])
        i = j
    return found


def pattern_table(spark: SparkSession, rules=None) -> DataFrame:
    """``rule_no, action, pattern, regex, tokens``."""
    rules = PATTERN_RULES if rules is None else rules
    rows = [(i, a, p, regex_of(p), whole_tokens(p)) for i, (a, p) in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, action string, pattern string, regex string, "
                                       "tokens array<string>")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    h = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(h, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_host_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text like ``net/``, verdict) of the longest fitting rule; null if none.
    The list is short and fixed, so it is one CASE in order of length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def index_patterns(patterns: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Each pattern under its rarest whole token (``key``; null: none). The count of
    a token is the number of URLs that hold it (partial aggregation, only tokens
    that some pattern names)."""
    named = patterns.select("rule_no", F.explode("tokens").alias("token")).distinct()
    seen = (url_tokens.join(named.select("token").distinct(), "token", "left_semi")
            .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    best = (named.join(seen, "token", "left")
            .groupBy("rule_no")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("key")))
    return patterns.join(best, "rule_no", "left").select("rule_no", "action", "pattern", "regex", "key")


def judge_urls(pages: DataFrame, url: str = "url", host_rules=None, pattern_rules=None) -> DataFrame:
    """``pages`` with ``host, path, rule, pattern, verdict``."""
    host_rules = HOST_RULES if host_rules is None else host_rules
    spark = pages.sparkSession
    made = ["host", "path", "rule", "pattern", "verdict"]
    d = pages.drop(*[c for c in made if c != url])
    patterns = pattern_table(spark, pattern_rules)
    # distinct URLs carry their tokens; equal URLs are judged once
    urls = (d.select(F.coalesce(F.lower(F.col(url)), F.lit("")).alias("_u")).distinct())
    tokens = urls.select("_u", F.explode(F.array_distinct(F.regexp_extract_all("_u", F.lit(f"({TOKEN})"))))
                         .alias("token"))
    index = index_patterns(patterns, tokens)
    by_token = tokens.join(index.filter("key IS NOT NULL").withColumnRenamed("key", "token"), "token")
    # a pattern without a key is tried on every URL: its rules ride along in one array
    loose_rules = [r for r in (PATTERN_RULES if pattern_rules is None else pattern_rules) if not whole_tokens(r[1])]
    hits = by_token.filter(F.expr("_u RLIKE regex")).select("_u", "action", "pattern")
    if loose_rules:
        loose = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(p).alias("pattern"), F.lit(regex_of(p)).alias("regex"))
                          for a, p in loose_rules])
        tried = urls.select("_u", F.explode(loose).alias("r")).filter(F.expr("_u RLIKE r.regex"))
        hits = hits.unionByName(tried.select("_u", "r.action", "r.pattern"))
    found = hits.groupBy("_u").agg(F.min(F.struct("action", "pattern")).alias("_hit"))  # allow < block
    host, path = host_of(F.col(url)), path_of(F.col(url))
    d = d.withColumns({"host": host, "path": path,
                       "_u": F.coalesce(F.lower(F.col(url)), F.lit(""))})
    rule, by_rule = longest_host_rule(F.col("host"), F.col("path"), host_rules)
    out = d.join(found, "_u", "left").withColumns({
        "rule": rule,
        "pattern": F.col("_hit.pattern"),
        "verdict": F.coalesce(by_rule, F.col("_hit.action"), F.lit("allow")),
    })
    return out.drop("_u", "_hit")


def oracle_sql(host_rules=None, pattern_rules=None) -> str:
    """DuckDB twin: every rule against every URL."""
    hosts = HOST_RULES if host_rules is None else host_rules
    pats = PATTERN_RULES if pattern_rules is None else pattern_rules
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    hv = ", ".join(f"({lit(a)}, {lit(h)}, {lit(p)})" for a, h, p in hosts)
    pv = ", ".join(f"({lit(a)}, {lit(p)}, {lit(regex_of(p))})" for a, p in pats)
    return f"""
WITH u AS (SELECT page_id, coalesce(lower(url), '') AS u,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h(action, h, p) AS (VALUES {hv}),
b(action, pattern, regex) AS (VALUES {pv}),
k AS (SELECT page_id, u, host, path,
    (SELECT max_by(struct_pack(rule := h.h || h.p, action := h.action), length(h.h || h.p)) FROM h
      WHERE (u.host = h.h OR ends_with(u.host, '.' || h.h)) AND starts_with(u.path, h.p)) AS hr,
    (SELECT min_by(struct_pack(pattern := b.pattern, action := b.action), b.action || b.pattern) FROM b
      WHERE regexp_matches(u.u, b.regex)) AS pr
  FROM u)
SELECT page_id, host, path, hr.rule AS rule, coalesce(hr.action, pr.action, 'allow') AS verdict,
       pr.pattern AS pattern
FROM k
"""
