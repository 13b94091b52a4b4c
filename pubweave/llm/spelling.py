"""Spelling variants of words, found with a variable-length gram index.

1. Words are counted over all texts.
2. The gram dictionary holds the grams of ``SHORTEST`` to ``LONGEST`` characters that make
   up more than a fixed share of all gram places of the distinct words.  All others are
   pruned, which bounds its size by arithmetic.
3. A word is decomposed into one gram per place: the shortest that is not in the
   dictionary, or the longest allowed.  Frequent beginnings thus give longer, rarer grams.
   A gram depends on the characters it covers only.
4. An edit changes only the grams that cover its place; the largest number of those over
   all places bounds how many a word can lose.  Near words share the rest.  So all
   lists but the ``bound - 1`` longest ones of each word, in one order for all words, must
   contain a common gram; only these are merged, at equal or neighbouring places and
   for words of equal length or one more character.
5. Pairs found are verified by their edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubweave.llm.common import saved, small_batches, whole_text

#: Characters of the shortest and the longest gram.
SHORTEST, LONGEST = 3, 6
#: A gram is in the dictionary if it has more than one in so many gram places.
DICTIONARY = 1 << 16
#: A word has so many characters and occurrences at least.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs so many times as often as the word.
FACTOR = 10
#: One in so many runs loses a character, see runs_of_letters.
SLIP = 31

_LETTERS = "A-Za-zÀ-ÿ"
_BEGIN, _END = "^", "$"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def runs_of_letters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH
) -> DataFrame:
    """``word``: every maximal run of letters with ``least`` characters or more.

    Of the runs whose CRC-32 with their document's id is divisible by ``SLIP``, the
    character at that number modulo the length is taken out, as a slip of the pen would.
    """
    run = F.col("run")
    mark = F.crc32(F.concat(F.coalesce(F.col("id"), F.lit("")), F.lit(":"), run))
    at = F.pmod("mark", F.length(run)).cast("int")
    shortened = F.concat(
        F.substring(run, 1, at), F.substring(run, at + 2, F.length(run))
    )
    # Runs of fewer characters cannot become words; a match takes in its whole run.
    found = F.regexp_extract_all(
        lower_ascii(whole_text(text_col)), F.lit(f"[{_LETTERS}]{{{least},}}"), F.lit(0)
    )
    return (
        docs.select(F.col(id_col).cast("string").alias("id"), F.explode(found).alias("run"))
        .withColumn("mark", mark)
        .select(F.when(F.col("mark") % SLIP == 0, shortened).otherwise(run).alias("word"))
        .filter(F.length("word") >= least)
    )


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """Frequent grams of the distinct words and their numbers of places.

    At most ``DICTIONARY`` grams of every length, whatever the number of words.
    """
    padded = F.concat(F.lit(_BEGIN), F.col("word"), F.lit(_END))
    size = F.length("padded")

    def grams(length: int) -> Column:
        return F.transform(
            F.sequence(F.lit(1), size - (length - 1)),
            lambda at: F.substring(F.col("padded"), at, F.lit(length)),
        )

    every = F.flatten(F.array(*[
        # Words have more characters than the longest gram.
        grams(length) for length in range(SHORTEST, LONGEST + 1)
    ]))
    places = words.agg(F.sum(F.length("word"))).first()[0] or 0
    counted = (
        words.select(padded.alias("padded")).select(F.explode(every).alias("gram"))
        .groupBy("gram").agg(F.count("*").alias("n"))
        .filter(F.col("n") * DICTIONARY > F.lit(places))
    )
    return {row["gram"]: row["n"] for row in counted.collect()}


def decompose(word: str, frequent: dict[str, int]) -> tuple[list[tuple[str, int]], int]:
    """(gram, place) of a word, and the most grams that one edit can change."""
    padded = f"{_BEGIN}{word}{_END}"
    end_of_word = len(padded)
    grams = []
    covering = [0] * (end_of_word + 1)
    for at in range(end_of_word - SHORTEST + 1):
        end = at + SHORTEST
        last = min(end_of_word, at + LONGEST)
        while end < last and padded[at:end] in frequent:
            end += 1
        grams.append((padded[at:end], at))
        covering[at] += 1
        covering[end] -= 1
    most = now = covering[0]
    for change in covering[1 : end_of_word - 1]:
        now += change
        most = max(most, now)
    return grams, most


def lists_to_merge(word: str, frequent: dict[str, int]) -> list[tuple[str, int]]:
    """The grams of a word without those of the longest lists, which need no merging.

    A near word shares ``len(grams) - affected`` grams or more, so one of the others.
    """
    grams, affected = decompose(word, frequent)
    grams.sort(key=lambda gram: (frequent.get(gram[0], 0), gram))
    return grams[: affected + 1]


def gram_index(words: DataFrame) -> DataFrame:
    """word, n, length, gram, place of all lists that have to be merged."""
    spark = words.sparkSession
    frequent = spark.sparkContext.broadcast(gram_dictionary(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places, lengths = [], [], [], []
            for row, word in enumerate(batch["word"].to_pylist()):
                for gram, place in lists_to_merge(word, frequent.value):
                    rows.append(row)
                    grams.append(gram)
                    places.append(place)
                    lengths.append(len(word))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["word"].take(at), batch["n"].take(at),
                    pa.array(lengths, pa.int32()),
                    pa.array(grams, pa.string()), pa.array(places, pa.int32()),
                ],
                ["word", "n", "length", "gram", "place"],
            )

    return words.select("word", "n").mapInArrow(
        run, "word string, n long, length int, gram string, place int"
    )


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of words one edit apart."""
    index = saved(gram_index(words), "gram-index")

    def key(more: int, on: int) -> Column:
        """Stands for a gram at a place of a word of a length; verification is exact."""
        return F.xxhash64("gram", F.col("length") + more, F.col("place") + on)

    # Where the same gram stands in a word of equal length or with one more character.
    probes = index.select(
        F.col("word").alias("a"), F.col("n").alias("a_n"),
        F.explode(F.array(key(0, 0), key(1, 0), key(1, 1))).alias("key"),
    )
    met = probes.join(
        index.select(F.col("word").alias("b"), F.col("n").alias("b_n"), key(0, 0).alias("key")),
        "key",
    ).filter((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    near = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n").distinct()
    both = F.inline(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"),
                 F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"),
                 F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    ))
    return near.select(both)


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of all words with a form.

    A form is ``FACTOR`` times as frequent as its word, so chains are short: each round
    halves what is left of them.
    """
    roots = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(further, "root", "left_semi").isEmpty():
            return roots
        roots = saved(
            roots.join(further, "root", "left").select(
                "word", F.coalesce("next", "root").alias("root")
            ),
            "roots",
        )


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    factor: int = FACTOR,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the texts.

    Words are what runs_of_letters gives, with at least ``least_length`` (7 or more)
    characters and ``least_count`` occurrences ``n`` in all texts.  Two words are near if
    one inserted, deleted or replaced character turns one into the other; n_near counts
    those.  The form of a word is its near word of largest n, the smaller in byte
    order of equals, if that n (form_n) is ``factor`` (2 or more) times the word's or more,
    else null.  root is the last word that forms lead to, the word itself if it has none.

    A null text has no words, a null id counts as an empty one.  Repeated rows count
    as often as they come.  No rows, or no words, give no rows.  Other columns are
    ignored.
    """
    if least_length <= LONGEST or factor < 2:
        raise ValueError(f"words need over {LONGEST} characters, and a factor of 2 or more")
    small_batches(docs.sparkSession, 8192)
    runs = runs_of_letters(docs, id_col, text_col, least_length)
    words = saved(
        runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count),
        "words",
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    grouped = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.first("n").alias("n"), best.alias("best")
    )
    has_form = -F.col("best.less") >= F.col("n") * F.lit(factor)
    grouped = saved(
        grouped.select(
            "word", "n_near",
            F.when(has_form, F.col("best.near")).alias("form"),
            F.when(has_form, -F.col("best.less")).alias("form_n"),
        ),
        "near-words",
    )
    roots = _roots(grouped.filter("form is not null"))
    return (
        words.join(grouped, "word", "left").join(roots, "word", "left")
        .select(
            "word", "form", F.coalesce("root", "word").alias("root"), "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
        )
    )
