"""Toxicity scores of texts whose words may be disguised.

A disguised word is seen as a noisy channel's output: letters were replaced by
look-alikes, spread by spaces or dots, or repeated.  Its lattice of possible
letters is decoded by Viterbi under a trigram model of characters, counted over
the whole corpus, and the restored words are scored like plain ones.

The evidence of a word or word beginning is the lower confidence bound of the share
of toxic documents among those that contain it; near copies count once.  The score of
a text joins the evidence of its distinct words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pubweave.llm.common import saved, small_batches, whole_text
from pubweave.llm.shingles import chunks, utf8

#: Labelled documents, in the order of a hash of their ids, that the evidence is
#: learned from: so many toxic ones and so many others at most.
TOXIC_SAMPLE, OTHER_SAMPLE = 3000, 12000
#: Evidence needs this bound, and this share of all toxic documents.
LEAST_EVIDENCE, LEAST_SHARE = 0.5, 0.01
THRESHOLD = 0.7
#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5, 6)
#: Tokens that a Python worker remembers; beyond that it starts anew.
KNOWN_TOKENS = 600_000

# Characters that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t",
    "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c",
    "€": "e", "£": "l", "¡": "i",
}

_N = 28  # boundary, a to z, any other letter
_OTHER = _N - 1
_EDGES = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w@$!|+(€£¡]+$")
_PLAIN_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_PUNCTUATION = ".,;:?\"'()[]"
_MARKS = re.compile("[" + re.escape("".join(LOOKALIKES)) + "]")
_TWICE = re.compile(r"(.)\1+")
_DOTTED = re.compile(r"^[^\W_](?:[.\-_*~][^\W_]|[.\-_*~][@$!|+(€£¡])+$")
_BREAKS = re.compile(r"[^\w@$!|+(€£¡]+")
_EDGE_MARKS = "!|+("
#: Single characters between spaces: two in a row are looked at, three are a run.
_SINGLES = re.compile(r" \S \S ")
_SPACED = re.compile(r"(?<= )\S[.,]?(?: \S){2,}(?= )")
#: Letters that a look-alike may stand for are the same in a shape.
_SHAPES = str.maketrans(
    {mark: letters[0] for mark, letters in LOOKALIKES.items()} | {"l": "i", "b": "g"}
    | {"8": "g", "£": "i"}
)


def shape(text: str) -> str:
    """What all disguises of a word have in common: the class of every letter, runs
    of a class as one."""
    return _TWICE.sub(r"\1", text.translate(_SHAPES))


def decoded_parts(form: str) -> list[str]:
    """What stands between the characters that ``decode`` turns into word breaks."""
    return "".join(c if c.isalpha() or c in LOOKALIKES else " " for c in form).split()


def symbol_of(char: str) -> int:
    return ord(char) - 96 if "a" <= char <= "z" else _OTHER


# --- the character model ---------------------------------------------------------

_CLASS = np.full(256, _OTHER, np.uint16)
_CLASS[:128] = 0
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[ord("A") : ord("Z") + 1] = np.arange(1, 27)
_LATER = np.zeros(256, bool)  # bytes that continue a character
_LATER[0x80:0xC0] = True


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of character trigrams of all words of all texts.

    Their number is bounded by the alphabet, so only sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_N**3, np.int64)
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for first, last in chunks(offsets):
                part = data[offsets[first] : offsets[last]]
                # A boundary stands before every text.
                part = np.insert(part, offsets[first:last] - offsets[first], 0)
                kinds = _CLASS[part[~_LATER[part]]]
                kinds = np.concatenate([[0, 0], kinds, [0]]).astype(np.int64)
                codes = (kinds[:-2] * _N + kinds[1:-1]) * _N + kinds[2:]
                total += np.bincount(codes, minlength=_N**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    texts = docs.select(whole_text(text_col).alias("text"))
    sums = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(
        F.sum("n").alias("n")
    )
    counts = np.zeros(_N**3)
    for row in sums.toLocalIterator():
        counts[row["code"]] = row["n"]
    return counts.reshape(_N, _N, _N)


def trigram_logs(counts: np.ndarray) -> np.ndarray:
    """Log probability of a symbol after two others, backed off to shorter contexts."""
    counts = counts.copy()
    counts[:, 0, 0] = 0  # white space after white space is no text
    single = counts.sum(axis=(0, 1)) + 1
    single /= single.sum()
    pair = counts.sum(axis=0)
    pair = (pair + 5 * single) / (pair.sum(axis=1, keepdims=True) + 5)
    triple = (counts + 5 * pair[None]) / (counts.sum(axis=2, keepdims=True) + 5)
    return np.log(triple)


def decode(token: str, logs: np.ndarray, spread: bool = False) -> str:
    """The most likely restored form of a token in lower case.

    Look-alikes may be their letters, a run of one character one or two of them; in a
    spread token, marks and spaces between characters may vanish or part words.
    """
    slots: list[list[tuple[str, float]]] = []
    for match in re.finditer(r"(.)\1*", token, re.DOTALL):
        char, n = match.group(1), len(match.group(0))
        if char.isalpha():
            letters = char
        else:
            letters = LOOKALIKES.get(char, "")
        if not letters:
            if spread:
                slots.append([("", -0.1), (" ", -2.4)])
            else:
                slots.append([(" ", 0.0)])
            continue
        cost = -np.log(len(letters))
        options = [(x, cost) for x in letters]
        if n > 1:
            # Two of a kind are mostly meant, more of them mostly not.
            once, twice = (-1.7, -0.2) if n == 2 else (-0.7, -0.7)
            options = [(x, c + once) for x, c in options] + [
                (2 * x, c + twice) for x, c in options
            ]
        slots.append(options)
    states = {(0, 0): (0.0, "")}
    for slot in slots:
        reached: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (score, text) in states.items():
            for piece, cost in slot:
                x, y, total = a, b, score + cost
                for char in piece:
                    z = 0 if char == " " else symbol_of(char)
                    total += logs[x, y, z]
                    x, y = y, z
                if (x, y) not in reached or total > reached[x, y][0]:
                    reached[x, y] = (total, text + piece)
        states = reached
    return max((s + logs[a, b, 0], text) for (a, b), (s, text) in states.items())[1]


# --- evidence ----------------------------------------------------------------


def features(word: str) -> list[str]:
    """A plain word itself, marked by its end, and its beginnings."""
    return [f"{word}$", *[word[:k] for k in BEGINNINGS if len(word) > k]]


def lower_bound(hits: int, total: int, z: float = 1.96) -> float:
    """Wilson's lower bound of a share."""
    if not total:
        return 0.0
    p, zz = hits / total, z * z
    centre = p + zz / (2 * total)
    margin = z * np.sqrt(p * (1 - p) / total + zz / (4 * total * total))
    return float(max(0.0, (centre - margin) / (1 + zz / total)))


@dataclass
class Model:
    """What scoring needs: evidence by feature, log probabilities of trigrams."""

    evidence: dict[str, float]
    logs: np.ndarray


def plain_words(text: str) -> set[str]:
    words = {token.strip(_PUNCTUATION) for token in text.lower().split()}
    return {w if w.isalpha() else _PLAIN_EDGES.sub("", w) for w in words} - {""}


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_sample: int = TOXIC_SAMPLE,
    other_sample: int = OTHER_SAMPLE,
) -> Model:
    """The model of a corpus; ``labels`` has doc_id and toxic (0 or 1).

    Trigrams are counted over all texts, evidence over a bounded sample of labelled
    ones, which are the only texts whose labels are read.  Labels without an id or a
    value are ignored; of contradicting ones toxic wins.  Without toxic labels all
    scores are 0.
    """
    small_batches(docs.sparkSession)
    given = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic")
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = (
        given.filter("toxic = 1").orderBy(*order).limit(toxic_sample)
        .unionByName(given.filter("toxic <> 1").orderBy(*order).limit(other_sample))
        .select(F.col("doc_id").alias("__id"), "toxic")
    )
    # The sample has a fixed number of rows at most, so it is broadcast.
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    texts = saved(
        texts.join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select(
            "text", "toxic"
        ),
        "labelled",
    )

    def toxic_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for text in batch["text"].to_pylist():
                mark = copy_mark(text)
                found.update((f, mark) for w in plain_words(text) for f in features(w))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in found], pa.string()),
             pa.array([m for _, m in found], pa.int64())],
            ["feature", "mark"],
        )

    toxic = texts.filter("toxic = 1").select("text")
    pairs = toxic.mapInArrow(toxic_features, "feature string, mark long").distinct()
    n_toxic = toxic.mapInArrow(toxic_marks, "mark long").distinct().count()
    frequent = pairs.groupBy("feature").agg(F.count("*").alias("n")).filter(
        F.col("n") >= max(2.0, LEAST_SHARE * n_toxic)
    )
    # At most 1/LEAST_SHARE times the features of one document.
    hits = {row["feature"]: row["n"] for row in frequent.collect()}
    names = frozenset(hits)

    def other_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                counts.update({f for w in plain_words(text) for f in features(w)} & names)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
            ["feature", "n"],
        )

    others = texts.filter("toxic <> 1").select("text").mapInArrow(
        other_counts, "feature string, n long"
    )
    misses = defaultdict(int)
    for row in others.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        misses[row["feature"]] = row["n"]
    return Model(weigh(hits, misses), trigram_logs(count_trigrams(docs, text_col)))


def weigh(hits: Mapping[str, int], misses: Mapping[str, int]) -> dict[str, float]:
    """Evidence of features from the toxic and the other documents that have them.

    A beginning that other documents have, too, counts without the word that
    explains most of its hits: what is left is what it says by itself.
    """
    def bound(feature: str, explained: int = 0) -> float:
        n = hits[feature] - explained
        return lower_bound(n, n + misses.get(feature, 0))

    words = {f: b for f in hits if f.endswith("$") and (b := bound(f)) >= LEAST_EVIDENCE}
    explained: dict[str, int] = {}
    for word in words:
        for beginning in features(word[:-1])[1:]:
            explained[beginning] = max(explained.get(beginning, 0), hits[word])
    beginnings = {
        f: bound(f, explained.get(f, 0) if misses.get(f) else 0)
        for f in hits if not f.endswith("$")
    }
    return words | {f: b for f, b in beginnings.items() if b >= LEAST_EVIDENCE}


def copy_mark(text: str) -> int:
    """A min-hash of the pairs of neighbouring words: mostly the same for near copies."""
    words = text.lower().split()
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=0)


def toxic_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [copy_mark(text) for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(marks, pa.int64())], ["mark"])


# --- scoring -----------------------------------------------------------------


class Scorer:
    """Scores texts and remembers the evidence of the tokens met so far."""

    def __init__(self, model: Model):
        self.model = model
        #: How words with evidence begin, and what disguises of them begin like; nearly
        #: all other tokens end here, and no token that could have evidence does.
        self.heads = {f.rstrip("$")[:4] for f in model.evidence}
        self.shapes = {shape(head)[:3] for head in self.heads}
        self.short_shapes = tuple(s for s in self.shapes if len(s) < 3)
        self.known: set[str] = set()
        self.strong: dict[str, float] = {}

    def of_word(self, word: str) -> float:
        if word[:4] not in self.heads:
            return 0.0
        get = self.model.evidence.get
        return max(get(f, 0.0) for f in features(word))

    def of_token(self, token: str) -> float:
        """Evidence of a token in lower case, plain or restored."""
        word = token.strip(_PUNCTUATION)
        if word.isalpha():
            best = self.of_word(word)
            return max(best, self.of_disguise(word)) if _TWICE.search(word) else best
        word = _PLAIN_EDGES.sub("", token)
        best, full = self.of_word(word), _EDGES.sub("", token)
        if _DOTTED.match(full):
            restored = decode(full, self.model.logs, spread=True)
            return max([best, *map(self.of_word, restored.split())])
        # A mark at an edge may be a letter or just punctuation.
        for part in _BREAKS.split(full):
            for form in {part, part.strip(_EDGE_MARKS)}:
                best = max(best, self.of_disguise(form))
        return best

    def of_disguise(self, form: str) -> float:
        """Evidence of the restored form of letters and look-alikes."""
        if not form or form.isdigit() or not self.could_be_strong(form):
            return 0.0
        return max(map(self.of_word, decode(form, self.model.logs).split()), default=0.0)

    def could_be_strong(self, form: str) -> bool:
        """Whether a word with evidence may begin like this, or like what follows a
        character in it that ``decode`` turns into a word break; see ``shape``."""
        for part in [form] if form.isalpha() else decoded_parts(form):
            start = shape(part)[:3]
            if start in self.shapes or start.startswith(self.short_shapes):
                return True
        return False

    def of_spread(self, run: str) -> dict[str, float]:
        """Evidence of the words that a run of single characters spells."""
        text = decode(run, self.model.logs, spread=True)
        joined = text.replace(" ", "")
        found = {w: self.of_word(w) for w in text.split()}
        # The places where words part are unsure: whole words count anywhere.
        for i in range(len(joined)):
            for k in range(4, 13):
                word = joined[i : i + k]
                if bound := self.model.evidence.get(f"{word}$"):
                    found[word] = max(found.get(word, 0.0), bound)
        return {w: e for w, e in found.items() if e}

    def score(self, text: str) -> float:
        words = text.lower().split()
        tokens = set(words)
        if new := tokens - self.known:
            if len(self.known) > KNOWN_TOKENS:
                self.known, self.strong = set(), {}
                new = tokens
            for token in new:
                if evidence := self.of_token(token):
                    self.strong[token] = evidence
            self.known |= new
        found = {
            _EDGES.sub("", token): self.strong[token] for token in tokens & self.strong.keys()
        }
        line = f" {' '.join(words)} "
        if _SINGLES.search(line):
            for run in _SPACED.findall(line):
                for word, evidence in self.of_spread(run).items():
                    found[word] = max(found.get(word, 0.0), evidence)
        clean = 1.0
        for evidence in found.values():
            clean *= 1.0 - evidence
        return 1.0 - clean


def score_column(model: Model, text_col: str = "text") -> Column:
    """The score of a text column; null texts count as empty."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in texts:
            yield pd.Series([scorer.score(text) for text in batch], dtype="float64")

    return score(whole_text(text_col))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(
        F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False)
    )


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (0 or 1) of every document.

    Null and empty texts score 0.  A null id is not held out and has no label.
    Repeated rows get the same score.  Empty tables give no rows; other columns
    of ``docs`` and ``labels`` are ignored.
    """
    model = learn(docs, labels.filter(~held_out()), id_col, text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"),
        held_out(id_col).alias("held_out"),
        score_column(model, text_col).alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without those predicted toxic, all columns unchanged."""
    model = learn(docs, labels.filter(~held_out()), id_col, text_col)
    return docs.filter(score_column(model, text_col) < THRESHOLD)
