"""Compound sentiment with the published rules for context.

The rules are those of the rule-based model for social media text by Hutto and
Gilbert (ICWSM 2014) in its common Python edition: boosters and negations among
the three words before a rated word, capitals, idioms, "but" and punctuation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions import scores
from murmur.functions.text import normalize_text
from murmur.operators.lookup import fits

# The published weights and word lists.
BOOST = 0.293
CAPITALS = 0.733
NEGATED = -0.74
DISTANCE = {1: 1.0, 2: 0.95, 3: 0.9}
EXCLAMATION = 0.292
QUESTION = 0.18
MANY_QUESTIONS = 0.96
BOOSTERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously "
    "entirely especially exceptionally extremely fabulously flipping flippin fricking frickin "
    "frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly more "
    "most particularly purely quite really remarkably so substantially thoroughly totally "
    "tremendously uber unbelievably unusually utterly very"
).split()
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely "
    "slightly somewhat sorta sortof sort-of"
).split()
DAMPENING_PAIRS = ("just enough", "kind of", "sort of")
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't "
    "doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't "
    "mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt "
    "uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't "
    "wouldn't rarely seldom despite"
).split()
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
_MARKS = r"""(?:[.,;:'"-]|!{1,3}|\?{1,3}|\?!\?!?|!\?!\??)"""
_WRAPPED = rf"^{_MARKS}([^\p{{Punct}}]{{2,}})$|^([^\p{{Punct}}]{{2,}}){_MARKS}$"


def words(text: Column) -> Column:
    """Words of two characters or more, without one mark before or after them."""
    pieces = F.filter(F.split(normalize_text(text), " "), lambda w: F.length(w) > 1)
    return F.transform(pieces, lambda w: F.regexp_replace(w, _WRAPPED, "$1$2"))


def _is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _emphasis(text: Column) -> Column:
    """Extra weight of exclamation and question marks."""
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    questions = count("?")
    asked = F.when(questions > 3, MANY_QUESTIONS).when(questions > 1, questions * QUESTION)
    return F.least(count("!"), F.lit(4)) * EXCLAMATION + F.coalesce(asked, F.lit(0.0))


def _either(word: Column) -> Column:
    return word.isin("so", "this")


def _negates(word: Column) -> Column:
    lowered = F.lower(word)
    return lowered.isin(*NEGATIONS) | lowered.contains("n't")


def _boost(word: Column, valence: Column, mixed_case: Column) -> Column:
    """What a preceding word adds to a valence, before its distance counts."""
    lowered = F.lower(word)
    size = F.when(lowered.isin(*BOOSTERS), BOOST).when(lowered.isin(*DAMPENERS), -BOOST)
    directed = F.when(valence < 0, -size).otherwise(size)
    shout = F.when(valence > 0, CAPITALS).otherwise(-CAPITALS)
    loud = F.when(_is_upper(word) & mixed_case, directed + shout).otherwise(directed)
    return F.coalesce(loud, F.lit(0.0))


def _idiom(*parts: str) -> Column:
    phrase = F.concat_ws(" ", *[F.col(p) for p in parts])
    value = F.lit(None).cast("double")
    for known, rating in IDIOMS.items():
        value = F.when(phrase == known, rating).otherwise(value)
    return value


def _negation(step: int, valence: Column) -> Column:
    """Negation by the word ``step`` places before; "never so" strengthens instead."""
    plain = F.when(_negates(F.col(f"p{step}")), valence * NEGATED).otherwise(valence)
    if step == 2:
        never = (F.col("p2") == "never") & _either(F.col("p1"))
        return F.when(never, valence * 1.5).otherwise(plain)
    if step == 3:
        never = (F.col("p3") == "never") & _either(F.col("p2")) | _either(F.col("p1"))
        return F.when(never, valence * 1.25).otherwise(plain)
    return plain


def _idioms(valence: Column) -> Column:
    before = F.coalesce(
        _idiom("p1", "word"), _idiom("p2", "p1", "word"), _idiom("p2", "p1"),
        _idiom("p3", "p2", "p1"), _idiom("p3", "p2"),
    )
    after = F.coalesce(
        F.when(F.col("n2").isNotNull(), _idiom("word", "n1", "n2")),
        F.when(F.col("n1").isNotNull(), _idiom("word", "n1")),
    )
    pairs = [F.lower(F.concat_ws(" ", F.col(a), F.col(b))) for a, b in (("p3", "p2"), ("p2", "p1"))]
    dampened = pairs[0].isin(*DAMPENING_PAIRS) | pairs[1].isin(*DAMPENING_PAIRS)
    value = F.coalesce(after, before, valence)
    return F.when(dampened, value - BOOST).otherwise(value)


def _share(place: Column) -> Column:
    """What an occurrence counts: half before a "but", one and a half times after it."""
    but = F.col("but")
    return F.when(but.isNull() | (place == but), 1.0).when(place < but, 0.5).otherwise(1.5)


def _context(posts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per different word of a post, and one without a word per post; no shuffle.

    A row has the neighbours of the word's first occurrence, and the shares of all as ``weight``.
    """
    text = F.col(text_col)
    listed = posts.select(
        *keys,
        text.isNotNull().alias("has_text"),
        F.coalesce(_emphasis(text), F.lit(0.0)).alias("emphasis"),
        words(text).alias("w"),
    )
    loud = F.size(F.filter("w", _is_upper))
    buts = F.array(F.array_position("w", "but"), F.array_position("w", "BUT"))
    facts = listed.withColumns(
        {
            "mixed_case": (loud > 0) & (loud < F.size("w")),
            "but": F.array_min(F.filter(buts, lambda p: p > 0)),
            "s": F.sort_array(F.transform("w", lambda word, i: F.struct(word.alias("word"), i.alias("i")))),
        }
    )
    at = lambda i: F.get(F.col("w"), i)
    # Equal words stand together, in order; these are the places where another word begins.
    begins = lambda x, j: F.when((j == 0) | (x["word"] != F.get(F.col("s"), j - 1)["word"]), j)
    facts = facts.withColumn("starts", F.filter(F.transform("s", begins), lambda j: j.isNotNull()))

    def entry(word: Column, i: Column, weight: Column) -> Column:
        return F.struct(
            word.alias("word"), weight.alias("weight"),
            at(i - 1).alias("p1"), at(i - 2).alias("p2"), at(i - 3).alias("p3"),
            at(i + 1).alias("n1"), at(i + 2).alias("n2"),
        )

    def run(start: Column, r: Column) -> Column:
        first = F.get(F.col("s"), start)
        end = F.coalesce(F.get(F.col("starts"), r + 1), F.size("s"))
        equal = F.slice(F.col("s"), start + 1, end - start)
        return entry(first["word"], first["i"], F.aggregate(equal, F.lit(0.0), lambda sum_, x: sum_ + _share(x["i"] + 1)))

    blank = entry(F.lit(None).cast("string"), F.lit(-9), F.lit(1.0))
    entries = F.concat(F.transform("starts", run), F.array(blank))
    common = [*keys, "has_text", "emphasis", "mixed_case"]
    return facts.select(*common, F.explode(entries).alias("c")).select(*common, "c.*")


def _rated(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rated words (and the rows without a word), and which words before them are rated."""
    ratings = lexicon.select(
        F.col("token").alias("_token"), F.col("valence").cast("double").alias("valence")
    )
    # One check serves all four joins, which have the same tokens on their small side.
    mark = F.broadcast if fits(ratings) else (lambda table: table)
    boosts = F.coalesce(F.lower("word").isin(*BOOSTERS, *DAMPENERS), F.lit(False))
    joined = rows.where(~boosts).join(
        mark(ratings), F.lower("word") == F.col("_token"), "left"
    )
    found = joined.where(F.col("valence").isNotNull() | F.col("word").isNull()).drop("_token")
    for step in (1, 2, 3):
        known = lexicon.select(F.col("token").alias("_token"), F.lit(True).alias(f"k{step}"))
        found = found.join(
            mark(known), F.lower(f"p{step}") == F.col("_token"), "left"
        ).drop("_token")
    return found


def _valence(first: DataFrame) -> DataFrame:
    """Apply the context rules to one row per distinct rated word of a post."""
    mixed = F.col("mixed_case")
    shout = F.when(F.col("valence") > 0, CAPITALS).otherwise(-CAPITALS)
    df = first.withColumn(
        "v", F.col("valence") + F.when(_is_upper(F.col("word")) & mixed, shout).otherwise(0.0)
    )
    for step in (1, 2, 3):
        applies = F.col(f"p{step}").isNotNull() & F.col(f"k{step}").isNull()
        boosted = F.col("v") + _boost(F.col(f"p{step}"), F.col("v"), mixed) * DISTANCE[step]
        df = df.withColumn("b", boosted).withColumn("b", _negation(step, F.col("b")))
        if step == 3:
            df = df.withColumn("b", _idioms(F.col("b")))
        df = df.withColumn("v", F.when(applies, F.col("b")).otherwise(F.col("v")))
    least = (F.lower("p1") == "least") & F.col("k1").isNull()
    softened = F.coalesce(F.lower("p2").isin("at", "very"), F.lit(False))
    kind_of = (F.lower("word") == "kind") & (F.lower("n1") == "of")
    final = (
        F.when(F.coalesce(kind_of, F.lit(False)), 0.0)
        .when(least & ~softened, F.col("v") * NEGATED)
        .otherwise(F.col("v"))
    )
    return df.withColumn("v", final)


def rule_scores(
    posts: DataFrame, lexicon: DataFrame, keys: list[str], text_col: str = "text"
) -> DataFrame:
    """Compound score per post with all context rules: ``keys`` + ``sentiment_score``.

    Rated words are found by a map-side join and summed where the post was split, so
    one short row per post and task is shuffled; a row without a word keeps each post and
    its punctuation, so the text is read once.  Equal words of a post share the context
    of their first occurrence, as in the published program; each occurrence counts half
    before a "but" and one and a half times after it.
    """
    judged = _valence(_rated(_context(posts, keys, text_col), lexicon))
    sums = judged.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("v") * F.col("weight")), F.lit(0.0)).alias("sum"),
        F.max("emphasis").alias("emphasis"),
        F.max("has_text").alias("has_text"),
    )
    total = F.col("sum") + F.signum("sum") * F.col("emphasis")
    score = F.when(F.col("has_text"), scores.compound(total))
    return sums.select(*keys, score.alias("sentiment_score"))
