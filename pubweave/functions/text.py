"""Column expressions over free text: cleaning, words, keyword phrases."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

from pubweave.functions.vocabulary import CLEANER_STOPWORDS, distinct_keywords

# Letters and digits of any script; the plain ones, tested first, decide most characters.
ALNUM = r"a-z0-9\p{IsAlphabetic}\p{Nd}"
# Characters that make up a word when looking for phrase boundaries.
WORD = ALNUM + r"\p{M}_"
SPACE = r"\s\p{Z}\x{85}"
# "<...>" closed on the same line.
TAG = r"<[^>\n\x0B\f\r\x{85}\x{2028}\x{2029}]*>"

#: Letters that a word worth counting has at least; they are plain Latin ones.
COUNTABLE_LETTERS = 3


def lower_without_tags(text: Column) -> Column:
    """Lower-case text in which ``<...>`` leaves nothing in its place."""
    lower = F.lower(text)
    return F.when(
        F.contains(text, F.lit("<")), F.regexp_replace(lower, TAG, "")
    ).otherwise(lower)


def words(text: Column) -> Column:
    """Lower-case letter-and-digit runs of a text, tags removed.

    The first or last array item may be empty.
    """
    spaced = F.regexp_replace(lower_without_tags(text), f"[^{ALNUM}]+", " ")
    return F.split(spaced, " ")


def countable_words(text: Column) -> Column:
    """The letter-and-digit runs of ``words`` that are worth counting.

    Every match takes in a whole run; runs with other characters come out empty and
    are removed.
    """
    runs = F.regexp_extract_all(
        lower_without_tags(text), F.lit(f"([a-z]{{{COUNTABLE_LETTERS},}}+)(?![{ALNUM}])|[{ALNUM}]++"), F.lit(1)
    )
    return F.array_remove(runs, "")


def clean_text(text: Column, stopwords: Iterable[str] = CLEANER_STOPWORDS) -> Column:
    """Lower-case text without tags, punctuation, single characters, plain
    numbers and stop words.  Gaps left by stop words stay."""
    # All that is no word, space or hyphen leaves nothing in its place.
    kept = F.regexp_replace(lower_without_tags(text), f"[^{ALNUM}{SPACE}-]+", "")
    stops = list(dict.fromkeys(stopwords))
    plain = [word for word in stops if word.isalnum()]

    def is_short(word: Column) -> Column:
        # Most words begin with a plain letter, which one comparison tells.
        return F.when((word >= "a") & (word < "{"), F.length(word) == 1).otherwise(
            ((F.length(word) == 1) & (word != "-")) | word.rlike(r"^\p{Nd}+$")
        )

    def is_stop(word: Column) -> Column:
        return word.isin(plain) if plain else F.lit(False)

    def hyphened(chunk: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(chunk, "-"),
                lambda word: F.when(is_short(word) | is_stop(word), "").otherwise(word),
            ),
            "-",
        )

    # Gaps of short words close, those of stop words stay.
    chunks = F.filter(
        F.split(kept, f"[{SPACE}]+"), lambda chunk: (chunk != "") & ~is_short(chunk)
    )
    cleaned = F.array_join(
        F.transform(
            chunks,
            lambda chunk: F.when(is_stop(chunk), "")
            .when(F.contains(chunk, F.lit("-")), hyphened(chunk)).otherwise(chunk),
        ),
        " ",
    )
    phrases = [word for word in stops if word and not word.isalnum()]
    if phrases:
        cleaned = F.regexp_replace(
            cleaned, f"(?<![{ALNUM}])(?:{_any_of(phrases)})(?![{ALNUM}])", ""
        )
    return cleaned


def _any_of(phrases: Iterable[str], group: int = 6) -> str:
    """A pattern for any of the phrases that prefers longer ones.

    Common beginnings are shared, and first characters are tested a group at a
    time, so most positions are dismissed after a few comparisons.
    """
    branches: dict = {}
    for phrase in phrases:
        node = branches
        for char in phrase:
            node = node.setdefault(char, {})
        node[""] = {}

    def render(node: dict) -> str:
        options = [
            escaped(char) + render(rest) for char, rest in node.items() if char
        ]
        if not options:
            return ""
        body = options[0] if len(options) == 1 else f"(?:{'|'.join(options)})"
        return f"(?:{body})?" if "" in node else body

    starts = sorted(branches)
    groups = [starts[i : i + group] for i in range(0, len(starts), group)]
    return "|".join(
        f"(?=[{''.join(map(escaped, chars))}])"
        + render({char: branches[char] for char in chars})
        for chars in groups
    )


def escaped(text: str) -> str:
    """``text`` as a regular expression that matches it literally."""
    return "".join(
        char if char.isalnum() or char == " " or not char.isascii() else f"\\x{{{ord(char):x}}}"
        for char in text
    )


def phrase_pattern(phrases: Iterable[str]) -> str:
    """A regular expression whose group 1 is the longest phrase that starts at a word start
    and ends at a word end.

    A match takes in one word and what follows up to the next, and looks ahead for a
    phrase, so only word starts are tried and phrases may overlap; group 1 is empty where
    there is none.  Phrases that do not begin with a word have to be tried everywhere.
    """
    known = list(phrases)
    found = f"(?=({_any_of(known)})(?![{WORD}]))"
    if all(_starts_word(phrase[0]) for phrase in known):
        return f"(?:{found})?+[{WORD}]++[^{WORD}]*+"
    return f"(?<![{WORD}]){found}"


def _starts_word(char: str) -> bool:
    """Whether a character is one of ``WORD``."""
    return char.isalnum() or char == "_" or unicodedata.category(char)[0] == "M"


def phrases_found(text: Column, topics: Mapping[str, Iterable[str]]) -> Column:
    """Array with every topic keyword that occurs in ``text``, once each.

    Case does not matter.  The extraction finds the longest keyword per word
    start; keywords that begin it ("log" in "log file") are added by lookup.
    """
    phrases = distinct_keywords(topics)
    if not phrases:
        return F.when(text.isNotNull(), F.expr("cast(array() as array<string>)"))
    longest = F.array_remove(
        F.regexp_extract_all(F.lower(text), F.lit(phrase_pattern(phrases)), F.lit(1)), ""
    )
    beginnings = {
        phrase: [
            p for p in phrases
            if phrase != p and phrase.startswith(p) and not _starts_word(phrase[len(p)])
        ]
        for phrase in phrases
    }
    nested = {phrase: found for phrase, found in beginnings.items() if found}
    if not nested:
        return F.array_distinct(longest)
    table = F.expr(
        f"map_from_arrays({sql_array(nested)},"
        f" array({', '.join(map(sql_array, nested.values()))}))"
    )
    # The extraction is used once, so it is evaluated once; few keywords are left by then.
    with_beginnings = F.transform(
        F.array_distinct(longest),
        lambda phrase: F.concat(
            F.array(phrase),
            F.coalesce(F.try_element_at(table, phrase), F.expr("cast(array() as array<string>)")),
        ),
    )
    return F.array_distinct(F.flatten(with_beginnings))


def string_array(values: Iterable[str]) -> Column:
    """Constant array of strings."""
    return F.expr(sql_array(values))


def sql_array(values: Iterable[str]) -> str:
    """``string_array`` as SQL text."""
    return f"cast(array({', '.join(map(sql_text, values))}) as array<string>)"


def string_map(pairs: Mapping[str, str]) -> Column:
    """Constant map of strings."""
    return F.map_from_arrays(string_array(pairs), string_array(pairs.values()))


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"
