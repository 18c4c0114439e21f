"""Raw messages to clean posts: parse, normalise, tag what is invalid, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions import parse, scores, text
from murmur.schemas import CLEAN_POST, RAW_POST
from murmur.settings import MARKET_WEIGHT, WHALE_AUTHORS, WHALE_SIGNAL, WHALE_WEIGHT

_CORRUPT = "_corrupt"
_TAG_LISTS = ("hashtags", "cashtags")
_COUNTS = ("like_count", "retweet_count", "reply_count")
_OTHER_TYPES = {n: T.ArrayType(T.StringType()) for n in _TAG_LISTS} | {n: T.VariantType() for n in _COUNTS}


def _message_schema() -> T.StructType:
    """Raw posts with real tag arrays and typed counts, so that a message is parsed just once."""
    fields = [T.StructField(f.name, _OTHER_TYPES.get(f.name, f.dataType)) for f in RAW_POST.fields]
    return T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])


def _count_text(value: Column) -> Column:
    """A count as text: a bare number loses its fraction, true is 1, quoted text stays."""
    bare = F.schema_of_variant(value).rlike("^(DECIMAL|DOUBLE|BOOLEAN)")
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(F.abs(number) <= parse.MOST_COUNT, number.cast("bigint"))
    return F.when(bare, whole.cast("string")).otherwise(value.cast("string"))


def parse_posts(raw: DataFrame, value: str = "value") -> DataFrame:
    """JSON messages (bytes or text) as raw post columns.

    All other columns of ``raw`` are kept.  ``bad_json`` marks messages that are
    empty or not a JSON object; ``from_json`` alone gives a struct of NULLs for
    those, so the corrupt-record column is what tells them apart.  That column is
    also set if a tag list is a lone scalar; only then the list is read again.
    """
    options = {"columnNameOfCorruptRecord": _CORRUPT}
    message = F.col(value).cast("string")
    kept = [c for c in raw.columns if c != value]
    parsed = raw.select(
        *kept,
        message.alias("raw_json"),
        F.from_json(message, _message_schema(), options).alias("post"),
    )
    corrupt = F.col(f"post.{_CORRUPT}").isNotNull()
    is_object = F.coalesce(F.ltrim(F.col("raw_json")).startswith("{"), F.lit(False))
    nothing = F.coalesce(*[F.col(f"post.{n}").cast("string") for n in RAW_POST.names]).isNull()

    def field(name: str) -> Column:
        if name in _COUNTS:
            return _count_text(F.col(f"post.{name}")).alias(name)
        if name not in _TAG_LISTS:
            return F.col(f"post.{name}").alias(name)
        lone = F.when(corrupt, F.get_json_object("raw_json", f"$.{name}"))
        lone = F.when(lone.isNotNull(), F.array(lone))
        return F.coalesce(F.col(f"post.{name}"), lone).alias(name)

    return parsed.select(
        *kept,
        "raw_json",
        *[field(n) for n in RAW_POST.names],
        (~is_object | (corrupt & nothing)).alias("bad_json"),
    )


def parsed_only(parsed: DataFrame) -> DataFrame:
    """Drop messages that are not JSON."""
    return parsed.where(~F.col("bad_json"))


def is_whale(name: Column, target: Column) -> Column:
    """Sentinel target, or a known name in any case with or without ``@``.

    Both columns are normalised text.
    """
    handle = F.ltrim(F.lower(name), F.lit("@"))
    return (F.upper(target) == WHALE_SIGNAL) | handle.isin(*WHALE_AUTHORS)


def author_class(weight: Column) -> Column:
    return F.when(weight >= WHALE_WEIGHT, "whale").otherwise("market")


def classify_authors(df: DataFrame, author: str = "author", target: str = "target_coin") -> DataFrame:
    """Add the class and weight that follow from name and target alone."""
    whale = is_whale(text.normalize_text(F.col(author)), text.normalize_text(F.col(target)))
    return df.withColumn(
        "author_weight", F.when(whale, WHALE_WEIGHT).otherwise(MARKET_WEIGHT)
    ).withColumn("author_type", author_class(F.col("author_weight")))


def _tags(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return text.ensure_list(F.col(name))
    return text.ensure_list_from_json(F.col(name))


def _with_all_fields(df: DataFrame) -> DataFrame:
    missing = {n: F.lit(None).cast("string") for n in RAW_POST.names if n not in df.columns}
    if "bad_json" not in df.columns:
        missing["bad_json"] = F.lit(False)
    return df.withColumns(missing) if missing else df


def normalize_posts(
    raw: DataFrame,
    distinct_symbols: bool = True,
    api_times: bool = False,
    where: Column | str | None = None,
) -> DataFrame:
    """Raw post columns of either dialect as clean post columns plus ``invalid_reason``.

    The first non-blank candidate wins for id, text, user and name.  Symbols come
    from the tag array, else from the text, else from the target coin.  An
    explicit weight is kept; a missing one follows from name and target.  Columns
    of ``raw`` that are no post fields (topic, arrival, ...) are passed through.

    ``where`` filters on columns of ``raw`` and reaches the scan, so directories that
    it rules out are not read; a filter on the result is applied after the cleaning.
    """
    df = _with_all_fields(raw if where is None else raw.where(where))
    passed = [c for c in df.columns if c not in RAW_POST.names and c not in ("bad_json", "raw_json")]
    name = text.first_text(F.col("username"), F.col("author"))
    fields = df.select(
        *passed,
        "bad_json",
        text.first_text(F.col("tweet_id"), F.col("id")).alias("tweet_id"),
        F.coalesce(
            text.first_text(F.col("user_id"), F.col("author_id"), F.col("author")),
            name,
            F.lit("unknown"),
        ).alias("user_id"),
        parse.parse_instant(F.col("created_at"), api_times).alias("created_at"),
        F.coalesce(name, F.lit("unknown")).alias("username"),
        F.coalesce(text.first_text(F.col("content"), F.col("text")), F.lit("")).alias("content"),
        _tags(df, "hashtags").alias("hashtags"),
        _tags(df, "cashtags").alias("array_symbols"),
        text.normalize_text(F.col("target_coin")).alias("target"),
        parse.parse_int(F.col("like_count")).alias("like_count"),
        parse.parse_int(F.col("retweet_count")).alias("retweet_count"),
        parse.parse_int(F.col("reply_count")).alias("reply_count"),
        F.coalesce(F.lower(text.first_text(F.col("lang"))), F.lit("und")).alias("lang"),
        F.lower(text.first_text(F.col("author_type"))).alias("given_type"),
        parse.parse_weight(F.col("author_weight")).alias("given_weight"),
    )
    # A column of its own, so that the text is searched once and only if needed.
    searched = fields.withColumn(
        "text_symbols",
        F.when(
            (F.size("array_symbols") == 0) & F.col("content").contains("$"),
            text.extract_cashtags(F.col("content")),
        ),
    )
    symbols = text.first_non_empty(
        F.col("array_symbols"), F.col("text_symbols"), text.target_symbols(F.col("target"))
    )
    whale = is_whale(F.col("username"), F.col("target"))
    resolved = searched.withColumns(
        {
            "cashtags": F.array_distinct(symbols) if distinct_symbols else symbols,
            "author_weight": F.coalesce(
                F.col("given_weight"), F.when(whale, WHALE_WEIGHT).otherwise(MARKET_WEIGHT)
            ),
            "engagement_score": scores.engagement(
                F.col("like_count"), F.col("retweet_count"), F.col("reply_count")
            ),
        }
    )
    scored = resolved.withColumns(
        {
            "author_type": F.coalesce(F.col("given_type"), author_class(F.col("author_weight"))),
            "influence_score": scores.influence(
                F.col("author_weight"), F.col("engagement_score")
            ),
            "invalid_reason": invalid_reason(),
        }
    )
    return scored.select(*passed, *CLEAN_POST.names, "invalid_reason")


def invalid_reason() -> Column:
    """The first failing check of a normalised post, NULL if it is valid.

    The last condition never holds.  Being non-deterministic it keeps the
    optimizer from moving a filter on the reason below the projection that
    computes it, which would parse and normalise every post twice.
    """
    return (
        F.when(F.col("bad_json"), "bad_json")
        .when(F.col("tweet_id").isNull(), "missing_id")
        .when(F.col("created_at").isNull(), "bad_timestamp")
        .when(F.col("content") == "", "missing_content")
        .when(F.size("cashtags") == 0, "missing_symbol")
        .when(F.spark_partition_id() < 0, "")
    )


def valid_posts(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("invalid_reason").isNull()).drop("invalid_reason")


def rejected_posts(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("invalid_reason").isNotNull())


def split_posts(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One plan, two outputs: (valid, rejected)."""
    return valid_posts(normalized), rejected_posts(normalized)


def strict_posts(raw: DataFrame) -> DataFrame:
    """The batch rule without fall-backs: id, time, text and a tag array must be there.

    Used on typed single-dialect files; symbols are only upper-cased.
    """
    df = _with_all_fields(raw)
    tags = df.schema["cashtags"].dataType
    listed = (
        F.col("cashtags")
        if isinstance(tags, T.ArrayType)
        else F.from_json(F.col("cashtags"), "array<string>")
    )
    counts = {n: parse.parse_int(F.col(n)) for n in ("like_count", "retweet_count", "reply_count")}
    return (
        df.withColumns(
            {
                **counts,
                "cashtags": listed,
                "created_at": parse.parse_instant(F.col("created_at")),
                "user_id": F.coalesce("user_id", "username", F.lit("unknown")),
                "username": F.coalesce("username", F.lit("unknown")),
            }
        )
        .where(
            F.col("tweet_id").isNotNull()
            & F.col("created_at").isNotNull()
            & F.col("content").isNotNull()
            & (F.coalesce(F.size("cashtags"), F.lit(0)) > 0)
        )
        .withColumn(
            "engagement_score",
            scores.engagement(F.col("like_count"), F.col("retweet_count"), F.col("reply_count")),
        )
        .withColumn("cashtags", F.transform("cashtags", F.upper))
    )


def stage_funnel(normalized: DataFrame) -> DataFrame:
    """Raw, parsed, clean and deduplicated counts in one pass."""
    ok = F.col("invalid_reason").isNull()
    parsed = F.coalesce(F.col("invalid_reason") != "bad_json", F.lit(True))
    return normalized.agg(
        F.count("*").alias("raw_messages"),
        F.count_if(parsed).alias("parsed_messages"),
        F.count_if(ok).alias("clean_messages"),
        F.count_distinct(F.when(ok, F.col("tweet_id"))).alias("deduplicated_messages"),
    )


def observe_posts(normalized: DataFrame, name: str | Observation = "posts") -> DataFrame:
    """Attach live counters (no extra pass) to a batch or streaming plan."""
    reasons = ("bad_json", "missing_id", "bad_timestamp", "missing_content", "missing_symbol")
    return normalized.observe(
        name,
        F.count(F.lit(1)).alias("raw_messages"),
        F.count_if(F.col("invalid_reason").isNull()).alias("clean_messages"),
        *[F.count_if(F.col("invalid_reason") == r).alias(r) for r in reasons],
    )


def explode_symbols(posts: DataFrame) -> DataFrame:
    """One row per (post, symbol)."""
    return posts.withColumn("symbol", F.explode("cashtags")).withColumn("symbol", F.upper("symbol"))
