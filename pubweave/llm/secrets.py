"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in every text.  Their values are then counted
over the whole corpus by distinct repositories and owners: a value that several
owners have, or that stands in many repositories, is an example that people copied; one
that only its owner has, in few repositories, looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pubweave.llm.common import lookup, saved, whole_text

# The kinds of candidates, in order of output.  Each has a pattern, the
# group whose value is the secret, and the least length of that group.
KINDS = {
    "assign": (
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]"
        r"|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # The least length may stand in these two patterns: what is too short to match
    # would be dropped, and nothing inside it is longer.
    "access": (r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}

#: A value of more owners, or in more repositories, than this is an example.
LIVE_OWNERS, LIVE_REPOS = 1, 3


def matches(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern as an array of start, end (code points) and value.

    The pieces of the text between the matches tell where each one starts.
    Matches whose group is shorter than ``least`` are dropped afterwards, so
    they still take their place in the text.
    """
    regex = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, regex, 0)
    values = F.regexp_extract_all(text, regex, group) if group else found

    def placed(state: Column, item: Column) -> Column:
        start = state["at"] + item["gap"]
        end = start + F.length(item["hit"])
        span = F.struct(
            start.alias("start"), end.alias("end"), item["value"].alias("value")
        )
        return F.struct(
            end.alias("at"),
            F.when(
                F.length(item["value"]) >= least, F.concat(state["spans"], F.array(span))
            ).otherwise(state["spans"]).alias("spans"),
        )

    # The last piece has no match behind it; slice() leaves it out.
    zipped = F.arrays_zip(
        F.slice(gaps, F.lit(1), F.size(found)).alias("gap"),
        found.alias("hit"),
        values.alias("value"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(zipped, start, placed)["spans"]


def scan_candidates(text: Column) -> Column:
    """Spans of all kinds in a text, ordered by start, then kind."""
    parts = []
    for order, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
        # A text without any match is the usual case: one look decides it.
        spans = F.when(
            text.rlike(pattern), matches(text, pattern, group, least)
        ).otherwise(none)
        parts.append(
            F.transform(
                spans,
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.lit(order).alias("order"),
                    s["end"].alias("end"),
                    F.lit(kind).alias("kind"),
                    F.sha2(s["value"], 256).alias("hash"),
                    F.length(s["value"]).alias("length"),
                ),
            )
        )
    return F.array_sort(F.concat(*parts))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo: Column | None = None,
    owner: Column | None = None,
    live_owners: int = LIVE_OWNERS,
    live_repos: int = LIVE_REPOS,
) -> DataFrame:
    """doc_id and ``spans`` of every document, spans with their verdict.

    A span has start, end (code points, end exclusive), kind, hash (SHA-256 of the
    secret's value; the value itself is not returned), n_repos, n_owners and live: at
    most ``live_owners`` owners and ``live_repos`` repositories have the value.
    ``repo`` and ``owner`` say whose document it is (default: source and
    language, and source); a null counts as one unnamed owner.  Documents
    without candidates have an empty array.  A null text is empty.  Repeated rows
    are kept, each with its own spans; they don't add owners.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    found = saved(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(repo, F.lit("")).alias("repo"),
            F.coalesce(owner, F.lit("")).alias("owner"),
            scan_candidates(whole_text(text_col)).alias("spans"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "secret-candidates",
    )
    one = found.select("row", "repo", "owner", F.explode("spans").alias("span")).select(
        "row", "repo", "owner", F.col("span.hash").alias("hash"), "span"
    )
    # Distinct triples are combined before the shuffle; a hot value leaves each
    # task as one row per owner.
    owned = one.groupBy("hash", "repo", "owner").agg(F.count("*").alias("n"))
    by_owner = owned.groupBy("hash", "owner").agg(
        F.countDistinct("repo").alias("n_repos"), F.sum("n").alias("n")
    )
    frequency = saved(
        by_owner.groupBy("hash").agg(
            F.sum("n_repos").alias("n_repos"),
            F.count("*").alias("n_owners"),
            F.sum("n").alias("n"),
        ),
        "secret-frequency",
    )
    judged = lookup(one, frequency, "hash", "n")
    span = F.struct(
        F.col("span.start").alias("start"),
        F.col("span.order").alias("order"),
        F.col("span.end").alias("end"),
        F.col("span.kind").alias("kind"),
        "hash",
        "n_repos",
        "n_owners",
        ((F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)).alias("live"),
    )
    spans = judged.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    kind = spans.schema["judged"].dataType.simpleString()
    return found.join(spans, "row", "left").select(
        "doc_id", F.coalesce("judged", F.expr(f"cast(array() as {kind})")).alias("spans")
    )
