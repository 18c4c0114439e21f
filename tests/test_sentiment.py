import math
import random

import pytest

from murmur.operators import sentiment as S
from murmur.operators import valence_rules as R
from murmur.sources.files import read_lexicon

# Ratings of a few words in the published lexicon's scale.
RATINGS = {"good": 1.9, "great": 3.1, "bad": -2.5, "terrible": -2.1}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(list(RATINGS.items()), "token string, valence double")


def score(total):
    return round(total / math.sqrt(total * total + 15), 4)


def test_scores_per_post(spark, lexicon):
    texts = [("a", "Good, GREAT market"), ("b", "bad good"), ("c", "no such words"), ("d", ""), ("e", None),
             ("f", "bad " * 400)]
    posts = spark.createDataFrame(texts, "id string, text string")
    got = {r.id: r.sentiment_score for r in S.sentiment_scores(posts, lexicon, ["id"]).collect()}
    assert got == {
        "a": score(5.0), "b": score(-0.6), "c": 0.0, "d": 0.0, "e": None, "f": score(-1000.0)}


def test_text_does_not_travel(spark, lexicon):
    posts = spark.createDataFrame([("a", "good")], "id string, text string").repartition(2)
    plan = S.sentiment_scores(posts, lexicon, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    top = plan.splitlines()
    shuffles = [line for line in top if "Exchange hashpartitioning(id" in line]
    assert len(shuffles) == 1 and "token" not in shuffles[0]


def test_coin_metrics(spark):
    rows = [("BTC", 0.5), ("BTC", -0.5), ("BTC", 0.05), ("BTC", None), ("ETH", 0.25), ("SOL", None)]
    scored = spark.createDataFrame(rows, "coin string, sentiment_score double")
    got = {r.coin: r for r in S.coin_sentiment(scored).collect()}
    btc = got["BTC"]
    assert (btc.mention_count, btc.bullish_ratio, btc.bearish_ratio) == (3, 1 / 3, 1 / 3)
    assert btc.fear_greed_score == pytest.approx((0.05 / 3 + 1) * 50)
    assert got["ETH"].fear_greed_score == 62.5
    assert got["SOL"].fear_greed_score is None and got["SOL"].bullish_ratio == 0.0


# Ratings of the published lexicon, and published example scores.
RULE_RATINGS = {
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "bad": -2.5,
    "horrible": -2.5, "sux": -1.5, "lol": 1.8, ":)": 2.0, ":d": 2.3, "uncompelling": -0.9, "kind": 2.4,
}
PUBLISHED = {
    "VADER is smart, handsome, and funny.": 0.8316,
    "VADER is smart, handsome, and funny!": 0.8439,
    "VADER is very smart, handsome, and funny.": 0.8545,
    "VADER is VERY SMART, handsome, and FUNNY.": 0.9227,
    "VADER is VERY SMART, handsome, and FUNNY!!!": 0.9342,
    "VADER is VERY SMART, really handsome, and INCREDIBLY FUNNY!!!": 0.9469,
    "The book was good.": 0.4404,
    "The book was kind of good.": 0.3832,
    "The plot was good, but the characters are uncompelling and the dialog is not great.": -0.7042,
    "A really bad, horrible book.": -0.8211,
    "At least it isn't a horrible book.": 0.431,
    ":) and :D": 0.7925,
    "": 0.0,
    "Today sux": -0.3612,
    "Today sux!": -0.4199,
    "Today SUX!": -0.5461,
    "Today kinda sux! But I'll get by, lol": 0.2228,
}


@pytest.fixture(scope="module")
def rated_words(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.txt"
    lines = [f"{token}\t{mean}\t0.5\t[1, 2]" for token, mean in RULE_RATINGS.items()]
    path.write_text("\n".join(lines) + "\n")
    return read_lexicon(spark, str(path)).cache()


def rule_score(spark, lexicon, texts):
    posts = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    rows = R.rule_scores(posts, lexicon, ["id"]).orderBy("id").collect()
    return [r.sentiment_score for r in rows]


def test_published_examples(spark, rated_words):
    assert rule_score(spark, rated_words, PUBLISHED) == list(PUBLISHED.values())


def test_rules_beyond_the_examples(spark, rated_words):
    cases = {
        "no rated word here": 0.0,
        None: None,
        "never so good": score((1.9 + 0.293) * 1.5),
        "good but bad BUT good": score(1.9 * (0.5 + 1.5) - 2.5 * 1.5),
        "the least good": score(1.9 * -0.74),
        "at least good": score(1.9),
        "that was bad ass": score(-2.5),
        "oh it was bad ass": score(1.5),
        "good?": score(1.9),
        "good??": score(1.9 + 0.36),
        "good ????": score(1.9 + 0.96),
        "good????": 0.0,
        "bad !!!!!!": score(-2.5 - 4 * 0.292),
        "..good": 0.0,
        "without doubt good": score(1.9 * -0.74),
    }
    assert rule_score(spark, rated_words, cases) == list(cases.values())


def test_large_lexicon_gives_the_same_scores(spark, rated_words, monkeypatch):
    rng = random.Random(5)
    pool = [*RULE_RATINGS, "not", "very", "but", "VERY", "GOOD", "book", "the", "so", "never", "good!"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    expected = rule_score(spark, rated_words, texts)
    monkeypatch.setattr(R, "fits", lambda table: False)
    monkeypatch.setattr(R.F, "broadcast", lambda table: pytest.fail("broadcast of a large table"))
    assert rule_score(spark, rated_words, texts) == expected


def test_rules_read_the_text_once(spark, rated_words, tmp_path):
    spark.createDataFrame([("a", "good")], "id string, text string").write.parquet(str(tmp_path / "p"))
    plan = R.rule_scores(spark.read.parquet(str(tmp_path / "p")), rated_words, ["id"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_rules_shuffle_sums_of_posts_not_words(spark, rated_words):
    posts = spark.createDataFrame([("a", "good")], "id string, text string")
    plan = R.rule_scores(posts, rated_words, ["id"])._jdf.queryExecution().sparkPlan().toString()
    executed = R.rule_scores(posts, rated_words, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "min(struct(" not in plan
    moved = [line for line in executed.split("\n") if "Exchange hashpartitioning(id" in line]
    assert len(moved) == 1 and "word" not in moved[0]


def test_equal_words_share_the_first_context(spark, rated_words):
    texts = ["good one good but good", "very good and good", "", "good", "not good but really good good"]
    got = rule_score(spark, rated_words, texts)
    boosted = 1.9 + 0.293
    assert got == [score(1.9 * 2.5), score(boosted * 2), 0.0, score(1.9), score(1.9 * -0.74 * 3.5)]
