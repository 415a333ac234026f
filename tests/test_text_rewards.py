"""Semantics of the parsing and reward operators: tables of inputs and expected
values worked out by hand from the rules, and properties that must hold for any input."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from mlqa.functions import text as X
from mlqa.operators import rewards as R

# --------------------------------------------------------------- helpers
def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()["x"]


def scored(spark, expr, rows, names):
    """expr over a table whose last column is the expected value: [(got, wanted, inputs)]."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i int, " + ", ".join(f"{n} string" for n in names) + ", want double")
    out = df.select("i", expr.alias("got"), "want").orderBy("i").collect()
    return [(r["got"], r["want"], rows[r["i"]]) for r in out]


# The opener is implied; one think block without think tags inside, a line feed, one
# answer block up to the end (a final line feed is allowed).
FORMAT_CASES = [
    ("x</think>\n<answer>y</answer>", 1.0),
    ("x</think>\n<answer>y</answer>\n", 1.0),
    ("</think>\n<answer></answer>", 1.0),
    ("a<b and c>d</think>\n<answer>1\n2</answer>", 1.0),
    ("a</thin b</think>\n<answer>y</answer>", 1.0),
    ("x</think>\n<answer>y</answer></answer>", 1.0),
    ("x</think>\n<answer>y</answer>\n\n", 0.0),
    ("<think>x</think>\n<answer>y</answer>", 0.0),
    ("x</think>y</think>\n<answer>y</answer>", 0.0),
    ("x</think><answer>y</answer>", 0.0),
    ("x</think>\n\n<answer>y</answer>", 0.0),
    ("x</think>\n<answer>y</answer> z", 0.0),
    ("x</think>\n<answer>y", 0.0),
    ("<answer>y</answer>", 0.0),
    ("", 0.0),
]


def test_format_reward_cases(spark):
    for got, want, row in scored(spark, R.format_reward("c"), FORMAT_CASES, ["c"]):
        assert got == want, row


def test_format_reward_properties(spark):
    """Text after a well-formed completion, a second opener, or a lost closer breaks the format."""
    rnd = random.Random(7)
    rows = []
    for _ in range(200):
        body = "".join(rnd.choice(["a", " ", "<", ">", "1.5", "x<y", "b\n"]) for _ in range(rnd.randint(0, 9)))
        good = f"{body}</think>\n<answer>{body}</answer>"
        rows += [(good, 1.0), (good + "x", 0.0), ("<think>" + good, 0.0), (good.replace("</think>", ""), 0.0)]
    for got, want, row in scored(spark, R.format_reward("c"), rows, ["c"]):
        assert got == want, row


def test_format_reward_long_body_no_stack_overflow(spark):
    body = "a<b " * 20000
    assert one(spark, R.format_reward(F.col("c")), c=body + "</think>\n<answer>x</answer>") == 1.0


def test_strip_is_unicode_aware(spark):
    assert one(spark, X.strip(F.col("c")), c=" 　 abc  \n") == "abc"
    assert one(spark, X.norm_text(F.col("c")), c="  A  B\tC ") == "a b c"


def test_extract_tag_first_block_and_null(spark):
    assert one(spark, X.extract_tag(F.col("c"), "answer"), c="<answer> a </answer><answer>b</answer>") == "a"
    assert one(spark, X.extract_tag(F.col("c"), "answer"), c="<answer>open") is None
    assert one(spark, X.extract_tag(F.col("c"), "answer"), c="<answer></answer>") == ""


def test_repair_tags_order(spark):
    assert one(spark, X.repair_tags(F.col("c")), c="t<answer>x") == "t<answer>x</think></answer>"
    assert one(spark, X.repair_tags(F.col("c")), c="t") == \
        "t</think>\n<answer>Unable to generate a complete answer</answer>"


def test_numbers_sign_binds_to_decimals_only(spark):
    got = one(spark, X.extract_numbers(F.col("c")), c="-5 and -2.5 .5 ๑๒")
    assert got == [5.0, -2.5, 0.5, 12.0]


def test_sentences(spark):
    text = "One. Two!  Three?\nFour\n\n  five. six.seven"
    assert one(spark, X.split_sentences(F.col("c")), c=text) == ["One.", "Two!", "Three?", "Four", "five.", "six.seven"]


def test_chunks(spark):
    assert one(spark, X.chunk_text(F.col("c"), 3), c="abcdefg") == ["abc", "def", "g"]
    assert one(spark, X.chunk_text(F.col("c"), 3), c="") == []


def test_exact_reward_alias_and_missing(spark):
    assert one(spark, R.exact_reward(F.col("c"), F.col("t")), c="x</think>\n<answer> USA </answer>",
               t="United States") == 1.0
    assert one(spark, R.exact_reward(F.col("c"), F.col("t")), c="x", t="usa") == 0.0
    assert one(spark, R.exact_reward(F.col("c"), F.col("t")), c="<answer>a</answer>", t=None) == 0.0


@pytest.mark.parametrize("p,t,want", [("1971", "1970", 1.0), ("12.5 km", "12 km", 1.0), ("3 and 30", "4 and 30", 0.5),
                                      ("none", "5", 0.0), ("-5", "5", 1.0)])
def test_numeric_match(spark, p, t, want):
    assert one(spark, R.numeric_match(F.col("p"), F.col("t")), p=p, t=t) == want


def test_similarity_udf_equals_difflib(spark):
    from mlqa.functions.similarity import ratio_udf
    rnd = random.Random(3)
    pairs = [("".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 30))),
              "".join(rnd.choice("abcde ") for _ in range(rnd.randint(0, 250)))) for _ in range(60)]
    pairs.append(("sanuki", "shikoku"))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["r"] for r in df.select(ratio_udf("a", "b").alias("r")).collect()]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert all(math.isclose(g, w) for g, w in zip(got, want))
    assert round(want[-1], 2) == 0.31


# (completion, target, other answers, reward): no answer block 0; an equal answer 1; a number
# within 5 % 1; the share of an answer's long words that the prediction holds, or its
# similarity, falls into the tiers 0.9 -> 0.9, 0.75 -> 0.7, 0.6 -> 0.5, else 0.
FUZZY_CASES = [
    ("usa", "usa", None, 0.0),
    ("<answer>usa</answer>", "USA", None, 1.0),
    ("x</think>\n<answer>  United   States </answer>", "united states", None, 1.0),
    ("<answer>marekani</answer>", "usa", "america, Marekani", 1.0),
    ("<answer>1971</answer>", "1970", None, 1.0),
    ("<answer>300</answer>", "5", None, 0.0),
    ("<answer>new york city hall</answer>", "york city", None, 1.0),
    ("<answer>zzz qqq</answer>", "kenya", None, 0.0),
    ("<answer>indian</answer>", "india", None, 1.0),
    ("<answer>abcdefghij</answer>", "abcdefghix", None, 0.9),
    ("<answer>abcdefgh</answer>", "abcdefxy", None, 0.7),
    ("<answer>abcdef</answer>", "abcdxy", None, 0.5),
    ("<answer></answer>", "usa", "", 1.0),
    ("<answer>a</answer>", None, None, 0.0),
]


def test_fuzzy_reward_cases(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(FUZZY_CASES)], "i int, c string, t string, a string, want double")
    for r in R.with_fuzzy_reward(df, "c", "t", "a").collect():
        assert r["fuzzy_reward"] == r["want"], FUZZY_CASES[r["i"]]


def test_fuzzy_reward_properties(spark):
    """More accepted answers never lower the reward; the prediction itself among them gives 1;
    a repeated answer changes nothing."""
    rnd = random.Random(11)
    words = ["united states", "india", "kenya", "1971", "new york city", "paris", "the big apple"]
    rows = []
    for i in range(150):
        pred, few = rnd.choice(words) + rnd.choice(["", "s", " city"]), rnd.sample(words, 2)
        rows.append((i, f"<answer>{pred}</answer>", few[0], ",".join(few), ",".join(few + few), ",".join(few + [pred])))
    df = spark.createDataFrame(rows, "i int, c string, t string, few string, twice string, own string")
    get = lambda col: {r["i"]: r["fuzzy_reward"] for r in R.with_fuzzy_reward(df, "c", "t", col).collect()}
    alone, few, twice, own = ({r["i"]: r["fuzzy_reward"] for r in R.with_fuzzy_reward(
        df.withColumn("none", F.lit(None).cast("string")), "c", "t", "none").collect()}, get("few"), get("twice"), get("own"))
    assert all(few[i] >= alone[i] for i in few) and few == twice and set(own.values()) == {1.0}


def test_best_match_of_repeated_candidates(spark):
    rows = [(0, "alpha beta", ["gamma", "gamma", "alpha beta"]), (1, "12 km", ["13 km", "13 km"]), (2, "x", [])]
    df = spark.createDataFrame(rows, "i int, p string, cands array<string>")
    got = {r["i"]: r["best"]["score"] for r in R.with_best_match(df, "p", "cands").collect()}
    assert got[0] == 1.0 and math.isclose(got[1], SequenceMatcher(None, "12 km", "13 km").ratio()) and got[2] == 0.0


@pytest.mark.parametrize("score,want", [(0.0, 0.0), (0.59, 0.0), (0.6, 0.5), (0.74, 0.5), (0.75, 0.7), (0.89, 0.7),
                                        (0.9, 0.9), (0.99, 0.9), (1.0, 1.0)])
def test_tiers(spark, score, want):
    df = spark.createDataFrame([(score,)], "s double")
    assert df.select(R.tier_reward(F.col("s")).alias("t")).first()["t"] == want
