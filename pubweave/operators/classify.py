"""Topic tags by weighted keyword presence.

Narrow transformations only: no shuffle, no Python in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from pubweave.functions.text import phrases_found, sql_array, sql_text
from pubweave.functions.vocabulary import FALLBACK_TAG, TOPIC_KEYWORDS
from pubweave.schemas import require_columns

Topics = Mapping[str, Iterable[str]]

# Score per character of a keyword.  Sums are compared as doubles, so they are
# always added up in keyword order.
CHARACTER_WEIGHT = 0.1

_FOUND = "__keywords_found"


def _score_table(topics: Topics) -> Column:
    """First character, then keyword, to entries (place of the tag and of the keyword in it,
    tag, length)."""
    entries: dict[str, list[str]] = {}
    for place, (tag, keywords) in enumerate(topics.items()):
        for order, keyword in enumerate(dict.fromkeys(keywords)):
            entries.setdefault(keyword, []).append(
                f"named_struct('place', {place}, 'keyword', {order}, 'tag', {sql_text(tag)},"
                f" 'length', {len(keyword)})"
            )
    # A map is searched from its beginning, so there is one for every first character.
    by_first: dict[str, list[str]] = {}
    for keyword in entries:
        by_first.setdefault(keyword[:1], []).append(keyword)

    def table(keywords: list[str]) -> str:
        rows = ", ".join(f"array({', '.join(entries[keyword])})" for keyword in keywords)
        return f"map_from_arrays({sql_array(keywords)}, array({rows}))"

    # Written as SQL so that the whole table is one constant of the plan.
    tables = ", ".join(map(table, by_first.values()))
    return F.expr(f"map_from_arrays({sql_array(by_first)}, array({tables}))")


def _topic_scores(found: Column, topics: Topics) -> Column:
    """Array of (score, tag) of the topics with keywords found, in topic order.

    Only the keywords found are touched; each topic's are added up in their order.
    """
    nothing = F.expr("cast(array() as array<struct<score: double, tag: string>>)")
    if not any(topics.values()):
        return nothing
    table = _score_table(topics)
    entries = F.array_sort(F.flatten(F.transform(
        found,
        lambda keyword: F.try_element_at(
            F.try_element_at(table, F.substring(keyword, 1, 1)), keyword
        ),
    )))

    def add(scores: Column, entry: Column) -> Column:
        last = F.try_element_at(scores, F.lit(-1))
        weight = F.lit(CHARACTER_WEIGHT) * entry["length"]
        goes_on = F.coalesce(last["tag"] == entry["tag"], F.lit(False))
        before = F.when(goes_on, F.slice(scores, 1, F.size(scores) - 1)).otherwise(scores)
        score = F.when(goes_on, last["score"]).otherwise(F.lit(0.0)) + weight
        return F.concat(
            before, F.array(F.struct(score.alias("score"), entry["tag"].alias("tag")))
        )

    return F.aggregate(entries, nothing, add)


def classify_data(df: DataFrame, topics: Topics = TOPIC_KEYWORDS) -> DataFrame:
    """Add ``tag``: the topic with the highest keyword score.

    The earlier topic wins a tie; papers without keywords get ``other``.
    """
    require_columns(df, ["abstract"])
    found = F.col(_FOUND)
    best = F.aggregate(
        _topic_scores(found, topics),
        F.struct(F.lit(0.0).alias("score"), F.lit(FALLBACK_TAG).alias("tag")),
        lambda top, topic: F.when(topic["score"] > top["score"], topic).otherwise(top),
    )["tag"]
    tag = F.when(F.coalesce(F.size(found), F.lit(0)) > 0, best).otherwise(FALLBACK_TAG)
    # A one-item explode keeps later filters on the tag above it.  Pushed down,
    # they would carry the whole classification into the scan a second time.
    return (
        df.withColumn(_FOUND, phrases_found(F.col("abstract"), topics))
        .withColumn("tag", F.explode(F.array(tag)))
        .drop(_FOUND)
    )


def keywords_present(
    df: DataFrame, key: str = "id", topics: Topics = TOPIC_KEYWORDS
) -> DataFrame:
    """One row (key, keyword) per paper and distinct keyword in its abstract."""
    require_columns(df, [key, "abstract"])
    found = phrases_found(F.col("abstract"), topics)
    return df.select(key, F.explode(found).alias("keyword"))


def keyword_scores(
    df: DataFrame, key: str = "id", topics: Topics = TOPIC_KEYWORDS
) -> DataFrame:
    """One row (key, tag, score) per paper and topic with a positive score."""
    require_columns(df, [key, "abstract"])
    found = F.col(_FOUND)
    positive = F.filter(
        _topic_scores(found, topics), lambda topic: topic["score"] > F.lit(0.0)
    )
    # Filtered inside the row: filters on rows would be pushed down and repeat
    # the extraction.
    topic = F.explode(F.when(F.size(found) > 0, positive)).alias("topic")
    return (
        df.select(key, phrases_found(F.col("abstract"), topics).alias(_FOUND))
        .select(key, topic)
        .select(key, "topic.tag", "topic.score")
    )
