"""Phrase collocations from a weighted de Bruijn graph of word n-grams.

Nodes of the graph are runs of three words, edges are runs of four, weighted by
their number of occurrences within the pieces of the texts.

1. Words are counted per language.  A phrase of at least ``least`` occurrences has no
   rarer word and no rarer pair of neighbours, so pieces are cut at both, and its nodes are
   as frequent; filters of fixed size tell the scans where.  What a filter lets through
   by chance costs time only.
2. Every place of a cut piece gives one edge.  At its end, and where the next node is too
   rare, the words left give an edge with missing words: the piece-end corrections.
3. Edges are aggregated.  The count of a node is the flow out of it, corrected by the
   ends; the count of a pair is the flow of the nodes that begin with it, corrected
   likewise.  One shuffle by node serves edges and nodes.
4. A node whose whole flow comes in by one edge and leaves by one edge is unary: its
   edges are compacted into paths by pointer doubling.  Such a node is part of a longer
   phrase as often as it occurs, so it is no phrase of its own.
5. Phrases left are scored by their lowest cut with exact integers.

Words are 64-bit numbers, checked to be unique in the dictionary of all words;
if two words share one, the numbers are drawn anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pubweave.llm.common import saved, small_batches, whole_text
from pubweave.llm.pieces import ragged
from pubweave.llm.shingles import chunks, mix, utf8, word_hashes

#: Occurrences that a phrase needs.
LEAST = 30
#: Percent of a phrase's occurrences that one longer phrase may hold.
DOMINANCE = 80
#: Phrases returned per language.
TOP = 2000
#: Words of an edge.
LONGEST = 4
#: Language of documents that name none.
UNKNOWN = "und"
#: Bits of the filters of words and pairs, a fixed number.
FILTER_BITS = 24

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes between words, and those of them that end a piece.
_SEPARATORS = np.zeros(256, bool)
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS[[0x20, 0x09]] = True
_SEPARATORS |= _ENDS

_KEYS = [f"w{i}" for i in range(1, LONGEST + 1)]


def _numbered(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """Of every stretch of a batch: number, first and last byte + 1, row of every word,
    whether the next word follows in the same piece, and the bytes."""
    data, offsets = utf8(batch["text"])
    langs = batch["lang_hash"].to_numpy().view(np.uint64)
    for first, last in chunks(offsets):
        hashes, starts, ends, before = word_hashes(
            data, offsets[first : last + 1], separators=_SEPARATORS, seed=seed
        )
        row = np.repeat(np.arange(first, last), np.diff(before))
        ids = mix(hashes + mix(langs[row] + _ODD))
        ids[ids == 0] = 1  # 0 stands for no word
        base = int(offsets[first])
        cuts = np.append(0, np.cumsum(_ENDS[data[base : int(offsets[last])]]))
        follows = np.zeros(len(ids), bool)
        follows[:-1] = (row[1:] == row[:-1]) & (
            cuts[starts[1:] - base] == cuts[ends[:-1] - base]
        )
        yield ids, starts, ends, row, follows, data


def _word_rows(texts: DataFrame, seed: int) -> DataFrame:
    """id, lang, word and its number of occurrences in a stretch of texts."""
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, starts, ends, row, _, data in _numbered(batch, seed):
                found, at, counts = np.unique(ids, return_index=True, return_counts=True)
                lengths = ends[at] - starts[at]
                spelled = lower[data[ragged(starts[at], lengths)]]
                bounds = np.append(0, np.cumsum(lengths)).astype(np.int32)
                words = pa.StringArray.from_buffers(
                    len(at), pa.py_buffer(bounds.tobytes()), pa.py_buffer(spelled.tobytes())
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        batch["lang"].take(pa.array(row[at])),
                        words,
                        pa.array(counts.astype(np.int64)),
                    ],
                    ["id", "lang", "word", "n"],
                )

    return texts.mapInArrow(run, "id long, lang string, word string, n long")


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """id, lang, word, n of all words, and the seed for which the ids are unique."""
    seed = 0
    while True:
        words = saved(
            _word_rows(texts, seed).groupBy("id", "lang", "word").agg(F.sum("n").alias("n")),
            "words",
        )
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            return words, seed
        seed += 1


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A table of 2**FILTER_BITS bits in which the bit of every ``key`` is set."""
    at = F.shiftrightunsigned("key", 64 - FILTER_BITS)
    filled = keys.select(
        F.shiftright(at, 6).alias("at"),
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - FILTER_BITS}) & 63 as int))")
        .alias("mask"),
    ).groupBy("at").agg(F.bit_or("mask").alias("mask"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    found = filled.toPandas()
    table[found["at"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return table


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def _pair_keys(ids: np.ndarray) -> np.ndarray:
    """A number for every word and the next one; equal numbers only join counts."""
    return mix(ids[:-1] * _ODD + ids[1:])


def _triple_keys(ids: np.ndarray) -> np.ndarray:
    """The same for three words."""
    return mix(_pair_keys(ids)[:-1] * _ODD + ids[2:])


def _linked(ids: np.ndarray, follows: np.ndarray, words, pairs=None) -> np.ndarray:
    """Whether every word and the next one may be in a phrase together."""
    known = _passes(words.value, ids)
    linked = follows & known
    linked[:-1] &= known[1:]
    if pairs is not None:
        linked[:-1] &= _passes(pairs.value, _pair_keys(ids))
    return linked


def _frequent(texts: DataFrame, seed: int, least: int, words, pairs=None) -> DataFrame:
    """The ``key`` of every pair, or given those every triple, that occurs often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, _, follows, _ in _numbered(batch, seed):
                if len(ids) < 3:
                    ids, follows = np.append(ids, [0, 0, 0]).astype(np.uint64), np.append(
                        follows, [False] * 3
                    )
                linked = _linked(ids, follows, words, pairs)
                if pairs is None:
                    keys = _pair_keys(ids)[linked[:-1]]
                else:
                    keys = _triple_keys(ids)[linked[:-2] & linked[1:-1]]
                keys, counts = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))],
                    ["key", "n"],
                )

    counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")
    )
    return counted.filter(F.col("n") >= least).select("key")


def _edges(texts: DataFrame, seed: int, words, pairs, triples) -> DataFrame:
    """w1 to w4 of every place that a frequent pair begins, 0 where the piece has ended or
    no frequent node follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, _, _, follows, _ in _numbered(batch, seed):
                ids = np.append(ids, np.zeros(LONGEST, np.uint64))
                follows = np.append(follows, np.zeros(LONGEST, bool))
                linked = _linked(ids, follows, words, pairs)
                node = linked.copy()
                node[:-2] &= linked[1:-1] & _passes(triples.value, _triple_keys(ids))
                place = np.flatnonzero(linked)
                goes_on = np.ones(len(place), bool)
                columns = [ids[place], ids[place + 1]]
                for i in range(2, LONGEST):
                    goes_on &= node[place + i - 2]
                    columns.append(np.where(goes_on, ids[place + i], np.uint64(0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.view(np.int64)) for c in columns], _KEYS
                )

    return texts.mapInArrow(run, ", ".join(f"{k} long" for k in _KEYS))


@dataclass
class PhraseGraph:
    """Tables of the graph, all written.

    ``words`` has id, lang, word, n of all words; ``grams`` has w1 to w4 (0: none), their
    number ``size`` and the count f of all runs of 2 to 4 words that occur often enough;
    ``least`` says how often that is.
    """

    words: DataFrame
    grams: DataFrame
    least: int


def phrase_graph(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST
) -> PhraseGraph:
    """The graph of all texts; see mine_collocations for what a word and a piece is."""
    spark = docs.sparkSession
    small_batches(spark, 1024)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    texts = docs.select(
        lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), whole_text(text_col).alias("text")
    )
    words, seed = count_words(texts)
    frequent = words.filter(F.col("n") >= least).select(F.col("id").alias("key"))
    word_bits = spark.sparkContext.broadcast(_filter_of(frequent))
    pairs = _frequent(texts, seed, least, word_bits)
    pair_bits = spark.sparkContext.broadcast(_filter_of(pairs))
    triples = _frequent(texts, seed, least, word_bits, pair_bits)
    triple_bits = spark.sparkContext.broadcast(_filter_of(triples))
    edges = _edges(texts, seed, word_bits, pair_bits, triple_bits)
    edges = saved(edges.groupBy(*_KEYS).agg(F.count("*").alias("f")), "edges")
    grams = None
    for size in range(LONGEST, 1, -1):
        # The flow out of a run: the edges that begin with it, ended ones included.
        flow = edges.filter(F.col(_KEYS[size - 1]) != 0)
        if size < LONGEST:
            flow = flow.groupBy(*_KEYS[:size]).agg(F.sum("f").alias("f"))
        level = flow.filter(F.col("f") >= least).select(
            *_KEYS[:size],
            *[F.lit(0).cast("long").alias(k) for k in _KEYS[size:]],
            F.lit(size).alias("size"), "f",
        )
        grams = level if grams is None else grams.unionByName(level)
    return PhraseGraph(words, saved(grams, "grams"), least)


def _renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(old).alias(new) for old, new in names.items()])


def compacted_paths(graph: PhraseGraph) -> tuple[DataFrame, DataFrame]:
    """All frequent edges (w1 to w4, f) with the head of their path, an edge's number, and
    their steps from it; and the unary nodes (w1, w2, w3) inside the paths.

    An edge goes on into the next one over a node if both carry the node's whole flow.
    Every piece begins somewhere, so such edges never close a circle.
    """
    edges = saved(
        graph.grams.filter(F.col("size") == LONGEST)
        .withColumn("edge", F.monotonically_increasing_id()),
        "frequent-edges",
    )
    nodes = graph.grams.filter(F.col("size") == LONGEST - 1).select("w1", "w2", "w3", "f")
    into = _renamed(edges, {"edge": "before", "w2": "w1", "w3": "w2", "w4": "w3", "f": "f"})
    out = edges.select(F.col("edge").alias("after"), "w1", "w2", "w3", "f")
    flow = ["w1", "w2", "w3", "f"]
    unary = saved(nodes.join(into, flow).join(out, flow), "unary-nodes")
    steps = edges.select("edge").join(
        unary.select(F.col("after").alias("edge"), "before"), "edge", "left"
    )
    # head: an edge further ahead in the path, the first one in the end.
    ahead = saved(
        steps.select(
            "edge", F.coalesce("before", "edge").alias("head"),
            F.col("before").isNotNull().cast("long").alias("steps"),
        ),
        "path-pointers",
    )
    while True:
        further = ahead.filter("steps > 0").select(
            F.col("edge").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more")
        )
        if ahead.join(further, "head", "left_semi").isEmpty():
            break
        ahead = saved(
            ahead.join(further, "head", "left").select(
                "edge", F.coalesce("next", "head").alias("head"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            ),
            "path-pointers",
        )
    placed = edges.join(ahead, "edge").select(*_KEYS, "f", "head", "steps")
    return saved(placed, "path-edges"), unary.select("w1", "w2", "w3")


def _part(first: int, length: int, size: int) -> Column:
    """Key of ``length`` words from the word ``first`` (from 0) on, padded with 0."""
    words = [F.col(_KEYS[i]) for i in range(first, first + length)]
    pad = [F.lit(0).cast("long")] * (LONGEST - 1 - length)
    return F.array(*words, *pad)


def _cuts(size: int) -> Column:
    return F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            _part(0, k, size).alias("left"),
            _part(k, size - k, size).alias("right"),
        )
        for k in range(1, size)
    ])


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def _dominated(grams: DataFrame, dominance: int) -> DataFrame:
    """Runs of which one longer run holds ``dominance`` percent of the occurrences.

    A run of two more words holds no more than the run of one more between them.
    """
    shorter = []
    zero = F.lit(0).cast("long")
    for size in range(3, LONGEST + 1):
        level = grams.filter(F.col("size") == size)
        for first in (0, 1):
            keys = [F.col(k) for k in _KEYS[first : first + size - 1]]
            keys += [zero] * (LONGEST - len(keys))
            shorter.append(
                level.select(*[c.alias(k) for c, k in zip(keys, _KEYS)], F.col("f").alias("more"))
            )
    union = shorter[0]
    for other in shorter[1:]:
        union = union.unionByName(other)
    longer = union.groupBy(*_KEYS).agg(F.max("more").alias("more"))
    return grams.join(longer, _KEYS).filter(
        _whole("more") * 100 >= _whole("f") * F.lit(dominance)
    ).select(*_KEYS)


def score_phrases(graph: PhraseGraph, dominance: int = DOMINANCE) -> DataFrame:
    """lang, phrase, a, l, r, score and passage_words of all phrases that no longer one
    dominates."""
    grams, words = graph.grams, graph.words
    placed, unary = compacted_paths(graph)
    lengths = placed.groupBy("head").agg((F.count("*") + LONGEST - 1).alias("passage_words"))
    lengths = placed.join(lengths, "head").select(*_KEYS, "passage_words")
    none = [F.lit(0).cast("long").alias(k) for k in _KEYS[3:]]
    parts = unary.select("w1", "w2", "w3", *none).unionByName(_dominated(grams, dominance))
    left = grams.join(parts.distinct(), _KEYS, "left_anti")
    left = left.join(lengths, _KEYS, "left").withColumn("gram", F.monotonically_increasing_id())
    left = saved(left, "phrases")

    frequent = words.filter(F.col("n") >= graph.least)
    counts = frequent.select(
        F.array(F.col("id"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("part"),
        F.col("n").alias("f"),
    ).unionByName(
        grams.filter(F.col("size") < LONGEST).select(F.array(*_KEYS[:3]).alias("part"), "f")
    )
    counts = saved(counts, "part-counts")
    cuts = None
    for size in range(2, LONGEST + 1):
        level = left.filter(F.col("size") == size).select(
            "gram", F.col("f").alias("a"), F.explode(_cuts(size)).alias("cut")
        )
        cuts = level if cuts is None else cuts.unionByName(level)
    cuts = cuts.select("gram", "a", "cut.*")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(
            counts.select(F.col("part").alias(side), F.col("f").alias(name)), side
        )
    score = F.expr(
        "(cast(2000000 as decimal(38,0)) * cast(a as decimal(19,0)))"
        " div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    )
    lowest = cuts.select("gram", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    scored = lowest.groupBy("gram").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))

    spelled = left.select(
        "gram", F.posexplode(F.filter(F.array(*_KEYS), lambda w: w != 0)).alias("at", "id")
    ).join(frequent.select("id", "lang", "word"), "id")
    phrases = spelled.groupBy("gram").agg(
        F.first("lang").alias("lang"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]),
            " ",
        ).alias("phrase"),
    )
    return scored.join(phrases, "gram").join(left.select("gram", "passage_words"), "gram").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "passage_words"
    )


def mine_collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    dominance: int = DOMINANCE,
    top: int = TOP,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and passage_words of the best phrases of
    every language.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at
    spaces and tabs; A-Z count as lower case.  A phrase has 2 to 4 words and at least
    ``least`` (2 or more) occurrences ``a`` within pieces of its language, overlapping
    ones included; ``n`` is the language's number of words.  Cutting it in two gives the
    score floor(2000000 * a / (l + r)) with the occurrences of both parts; its lowest cut
    counts, the first one of equals.  Phrases inside a longer one that holds
    ``dominance`` percent of their occurrences are left out.  ``top`` phrases stay per
    language by score, a (both descending) and phrase (byte order).  A phrase of four
    words has the length of its path in ``passage_words``, the others null.

    A null text is empty, a null language is ``und``; the id plays no part, so repeated
    rows count as often as they come.  No rows, or texts without words, give no rows.
    Other columns are ignored.
    """
    if least < 2:
        raise ValueError("a phrase needs two occurrences at least")
    graph = phrase_graph(docs, text_col, lang_col, least)
    totals = graph.words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = score_phrases(graph, dominance).withColumn(
        "rank", F.row_number().over(order).cast("long")
    ).filter(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score", "passage_words"
    )


def maximal_phrases(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST
) -> DataFrame:
    """lang, phrase, n_words, f of the compacted paths: passages of four words and more
    that always go on the same way."""
    graph = phrase_graph(docs, text_col, lang_col, least)
    placed, _ = compacted_paths(graph)
    first = placed.filter("steps = 0").select(
        "head", "f", F.posexplode(F.array(*_KEYS[:3])).alias("at", "id")
    )
    rest = placed.select(
        "head", "f", (F.col("steps") + 3).cast("int").alias("at"), F.col("w4").alias("id")
    )
    spelled = first.unionByName(rest).join(graph.words.select("id", "lang", "word"), "id")
    return spelled.groupBy("head").agg(
        F.first("lang").alias("lang"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]),
            " ",
        ).alias("phrase"),
        F.count("*").alias("n_words"),
        F.first("f").alias("f"),
    ).drop("head")
