"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask of token positions; tokens between them are ignored, so a
passage keeps hashes in common with its source when single tokens are replaced.
Test items are hashed under every mask.  Filters of fixed size let the scan of the
documents emit only positions whose hash is likely a test hash; these are joined with
the test hashes, and around every hit the tokens of document and item are compared
along the diagonal.

A seed that many items share, such as the phrase of a question template, would pair every
document that has it with all of them.  Its places are joined by the seed and one more
token instead: a token near it, at a given distance, that few items have there.  A passage
that passes the comparison has so few replaced tokens that one of these is left, if
there are enough of them; items that have too few, which differ hardly from many others,
keep the seed itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.common import lookup, saved, small_batches, text_mark, whole_text, without_rows
from pubweave.llm.shingles import chunks, mix, utf8, word_hashes

#: Token positions that a seed reads.  Of 14 tokens with any 3 replaced, one of the
#: first three masks hits; what shorter and some longer items miss is in the README.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 2, 3, 5), (0, 1, 2, 3, 4), (0, 2, 3, 5, 7))
#: An item counts as found where this share of it, or of as many tokens of it as a
#: window has, stands in the document.
SIMILARITY = 75
WINDOW = 32
#: A seed, or a seed with a token, that more items share is not joined by itself.
COMMON = 64
#: Bits of a filter, a fixed number, and bits per hash.
FILTER_BITS = 25
PROBES = 3

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64))
_SPAN = max(mask[-1] for mask in MASKS) + 1


def seed_hashes(words: np.ndarray, masks=MASKS) -> Iterator[tuple[int, np.ndarray]]:
    """For every mask its span and the hash at every position where it fits."""
    for number, mask in enumerate(masks):
        n = max(0, len(words) - mask[-1])
        total = np.full(n, number, np.uint64)
        for factor, step in zip(_FACTORS, mask):
            total += words[step : step + n] * factor
        yield mask[-1] + 1, mix(total)


def probes(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The filter bits of hashes."""
    for i in range(PROBES):
        shift = np.uint64(64 - FILTER_BITS - i * 13)
        yield ((hashes >> shift) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _row_words(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of every text of a batch."""
    data, offsets = utf8(batch["text"])
    for first, last in chunks(offsets):
        words, _, _, before = word_hashes(data, offsets[first : last + 1], letters_only=True)
        for row in range(last - first):
            yield first + row, words[before[row] : before[row + 1]]


def _item_blocks(items: DataFrame, window: int) -> DataFrame:
    """item_id, block, n (words of the item), first and words of every stretch of an item.

    A block has the places from ``block * stride`` on, and a margin on both sides.
    """
    stride, margin = _stride(window), _margin(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _row_words(batch):
                starts = range(0, len(words), stride)
                firsts = [max(0, at - margin) for at in starts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["item_id"].take(pa.array([row] * len(firsts), pa.int64())),
                        pa.array(range(len(firsts)), pa.int64()),
                        pa.array([len(words)] * len(firsts), pa.int64()),
                        pa.array(firsts, pa.int64()),
                        pa.array(
                            [words[f : at + stride + margin].tobytes()
                             for f, at in zip(firsts, starts)],
                            pa.binary(),
                        ),
                    ],
                    ["item_id", "block", "n", "first", "words"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(
        run, f"item_id {kind}, block long, n long, first long, words binary"
    )


def _stride(window: int) -> int:
    return 4 * window


def _margin(window: int) -> int:
    """More than a window that contains a seed reaches beyond the seed's place."""
    return window + _SPAN


def _item_seeds(items: DataFrame) -> DataFrame:
    """hash, item_id, place and span of every seed of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in _row_words(batch):
                for span, found in seed_hashes(words):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found.view(np.int64)),
                            batch["item_id"].take(pa.array([row] * len(found), pa.int64())),
                            pa.array(np.arange(len(found))),
                            pa.array([span] * len(found), pa.int64()),
                        ],
                        ["hash", "item_id", "place", "span"],
                    )

    kind = items.schema["item_id"].dataType.simpleString()
    return items.mapInArrow(run, f"hash long, item_id {kind}, place long, span long")


def _distances(window: int) -> np.ndarray:
    """From a seed's place to the tokens that are joined with it."""
    return np.append(np.arange(-window, 0), np.arange(1, window + _SPAN))


def _token_numbers(seeds: np.ndarray, words: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """The numbers of seeds with tokens at distances."""
    factors = mix((distances + (1 << 20)).astype(np.uint64))
    return mix(seeds * np.uint64(0x9E3779B97F4A7C15) + words + factors)


def token_keys(
    words: np.ndarray, places: np.ndarray, hashes: np.ndarray, window: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every distance from a seed's place: which places have a token there, and the
    numbers of seed and token."""
    for distance in _distances(window):
        at = places + distance
        inside = np.flatnonzero((at >= 0) & (at < len(words)))
        yield inside, _token_numbers(hashes[inside], words[at[inside]], np.array([distance]))


def _token_rows(common: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """hash, item_id, place, span, n, distance and key of the tokens near common seeds."""
    stride, every = _stride(window), _distances(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch["place"].to_numpy() - batch["first"].to_numpy()
            seeds = batch["hash"].to_numpy().view(np.uint64)
            for row in range(batch.num_rows):
                words = np.frombuffer(batch["words"][row].as_py(), np.uint64)
                at = places[row] + every
                distances = every[(at >= 0) & (at < len(words))]
                keys = _token_numbers(seeds[row], words[places[row] + distances], distances)
                same = pa.array([row] * len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch[c].take(same) for c in ("hash", "item_id", "place", "span", "n")],
                        pa.array(distances), pa.array(keys.view(np.int64)),
                    ],
                    ["hash", "item_id", "place", "span", "n", "distance", "key"],
                )

    placed = common.withColumn("block", F.floor(F.col("place") / stride)).join(
        blocks, ["item_id", "block"]
    )
    kind = common.schema["item_id"].dataType.simpleString()
    return placed.select("hash", "item_id", "place", "span", "n", "first", "words").mapInArrow(
        run,
        f"hash long, item_id {kind}, place long, span long, n long, distance long, key long",
    )


def _always_met(window: int, similarity: int):
    """SQL expression: whether every window around a seed has more rare tokens than a
    passage may lack there; ``rare`` lists their distances."""
    size = f"least(n, {window})"
    lacking = f"{size} - ceil({size} * {similarity} / 100)"
    first = f"greatest(0, place + span - {size})"
    last = f"least(place, n - {size})"
    return F.expr(
        f"forall(sequence(cast({first} as int), cast({last} as int)), w ->"
        f" size(filter(rare, d -> place + d >= w and place + d < w + {size})) > {lacking})"
    )


def _item_keys(
    items: DataFrame, blocks: DataFrame, window: int, similarity: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents are joined with: the ``key``, item_id and place of plain seeds; those
    of seeds with a token; and the common hashes that the latter belong to."""
    seeds = saved(_item_seeds(items), "item-seeds")
    shared = seeds.groupBy("hash").agg(F.countDistinct("item_id").alias("items"))
    shared = saved(shared.filter(F.col("items") > COMMON), "common-seeds")
    if shared.isEmpty():
        plain = seeds.select(F.col("hash").alias("key"), "item_id", "place")
        return plain, plain.limit(0), plain.select("key").limit(0)
    common = seeds.join(shared.select("hash"), "hash")
    plain = seeds.join(shared, "hash", "left_anti")
    tokens = saved(_token_rows(common, blocks, window), "seed-tokens")
    rare = tokens.groupBy("key").agg(F.countDistinct("item_id").alias("items"))
    rare = saved(rare.filter(F.col("items") <= COMMON).select("key"), "rare-tokens")
    kept = saved(tokens.join(rare, "key"), "kept-tokens")
    # Seeds without any rare token have no row here and are left out below.
    seed = ["hash", "item_id", "place"]
    met = kept.groupBy(*seed, "span", "n").agg(F.collect_list("distance").alias("rare"))
    met = saved(met.filter(_always_met(window, similarity)).select(*seed), "met-seeds")
    plain = plain.unionByName(common.join(met, seed, "left_anti"))
    with_token = kept.join(met, seed)
    columns = ["key", "item_id", "place"]
    return (
        saved(plain.select(F.col("hash").alias("key"), "item_id", "place"), "plain-keys"),
        saved(with_token.select(*columns), "token-keys"),
        met.select(F.col("hash").alias("key")).distinct(),
    )


def _filter_words(keys: DataFrame) -> np.ndarray | None:
    """The Bloom filter of all keys, whose size does not depend on them; None of none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits in probes(batch["key"].to_numpy().view(np.uint64)):
                masks = np.left_shift(np.int64(1), bits & 63)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bits >> 6), pa.array(masks)], ["at", "mask"]
                )

    filled = keys.select("key").mapInArrow(run, "at long, mask long").groupBy("at").agg(
        F.bit_or("mask").alias("mask")
    )
    found = filled.toPandas()
    if not len(found):
        return None
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[found["at"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64)
    return table


def _likely(table: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that a filter lets through."""
    places = np.arange(len(hashes) if table is not None else 0)
    for at in probes(hashes):
        if not len(places):
            break
        passes = (table[at[places] >> 6] >> (at[places] & 63)) & 1 == 1
        places = places[passes]
    return places


def _scan(texts: DataFrame, filters, window: int) -> DataFrame:
    """doc_id, mark, hits (key, at) and stretches (number, words) of the documents with
    hits.

    A stretch has the words from ``number * reach`` on, twice as many as an item's block,
    so that one contains whatever a block is compared with.
    """
    reach = _reach(window)

    def hits(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        plain, with_token, common = filters.value
        for _, seeds in seed_hashes(words):
            places = _likely(plain, seeds)
            yield seeds[places], places
            places = _likely(common, seeds)
            if len(places):
                for inside, keys in token_keys(words, places, seeds[places], window):
                    found = _likely(with_token, keys)
                    yield keys[found], places[inside[found]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found, stretches = [], [], []
            for row, words in _row_words(batch):
                parts = list(hits(words))
                if not any(len(places) for _, places in parts):
                    continue
                keys = np.concatenate([k for k, _ in parts]).view(np.int64)
                places = np.concatenate([p for _, p in parts])
                least = (places - _stride(window) - _margin(window)) // reach
                most = (places - _margin(window)) // reach
                rows.append(row)
                found.append([
                    {"key": k, "at": p} for k, p in zip(keys.tolist(), places.tolist())
                ])
                stretches.append([
                    {"number": i,
                     "words": words[max(0, i * reach) : (i + 2) * reach].tobytes()}
                    for i in np.union1d(least, most).tolist()
                ])
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(taken), batch["mark"].take(taken),
                    pa.array(found, pa.list_(
                        pa.struct([("key", pa.int64()), ("at", pa.int64())])
                    )),
                    pa.array(stretches, pa.list_(
                        pa.struct([("number", pa.int64()), ("words", pa.binary())])
                    )),
                ],
                ["doc_id", "mark", "hits", "stretches"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        run,
        f"doc_id {kind}, mark long, hits array<struct<key:bigint,at:bigint>>,"
        " stretches array<struct<number:bigint,words:binary>>",
    )


def _reach(window: int) -> int:
    """Words of an item's block with both margins."""
    return _stride(window) + 2 * _margin(window)


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: int = SIMILARITY,
    window: int = WINDOW,
) -> DataFrame:
    """Test items found in documents: doc_id, item_id, first_word (of the document),
    matched and compared (tokens of the item), and the mark of the text.

    Words are runs of letters and digits in lower case.  An item is found where at
    least ``similarity`` percent of ``window`` of its consecutive words, or of all of
    a shorter item, stand in the same order and distance.  One row per document
    and item, with its best place.  Of items with equal texts the smallest id is
    reported.  Items and documents without text, and items of fewer than 5 words,
    are never found.  Rows that repeat an id and its text report once per item.  Empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    distinct_items = items.select(
        F.col(item_col).alias("item_id"), whole_text(item_text_col).alias("text")
    ).groupBy("text").agg(F.min("item_id").alias("item_id")).select("item_id", "text")
    distinct_items = saved(distinct_items, "items")
    blocks = saved(_item_blocks(distinct_items, window), "item-blocks")
    plain, with_token, common = _item_keys(distinct_items, blocks, window, similarity)
    filters = spark.sparkContext.broadcast(
        [_filter_words(plain), _filter_words(with_token), _filter_words(common)]
    )
    texts = docs.select(
        F.col(id_col).alias("doc_id"), text_mark(text_col).alias("mark"),
        whole_text(text_col).alias("text"),
    )
    likely = saved(
        _scan(texts, filters, window).withColumn("row", F.monotonically_increasing_id()),
        "likely",
    )
    hits = likely.select("row", F.explode("hits").alias("hit")).select(
        "row", "hit.key", "hit.at"
    )
    met = _joined_hits(hits, plain.unionByName(with_token))
    stride, reach = _stride(window), _reach(window)
    pairs = met.select(
        "row", "item_id", (F.col("at") - F.col("place")).alias("diagonal"),
        F.floor(F.col("place") / stride).alias("block"),
    ).distinct().withColumn(
        "number",
        F.floor((F.col("diagonal") + F.col("block") * stride - _margin(window)) / reach),
    )
    stretches = likely.select("row", "doc_id", "mark", F.explode("stretches").alias("s")).select(
        "row", "doc_id", "mark", "s.number", F.col("s.words").alias("tokens")
    )
    compared = pairs.join(stretches, ["row", "number"]).join(blocks, ["item_id", "block"]).select(
        "doc_id", "mark", "item_id", "diagonal", "n", "first", "words",
        F.greatest(F.lit(0), F.col("number") * reach).alias("begin"), "tokens",
    )
    kind = texts.schema["doc_id"].dataType.simpleString()
    item_kind = distinct_items.schema["item_id"].dataType.simpleString()
    found = compared.mapInArrow(
        verifier(similarity, window),
        f"doc_id {kind}, mark long, item_id {item_kind}, first_word long, matched long, compared long",
    )
    best = F.max(F.struct("matched", "compared", (-F.col("first_word")).alias("before")))
    return found.groupBy("doc_id", "mark", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", (-F.col("best.before")).alias("first_word"),
        "best.matched", "best.compared", "mark",
    )


def _joined_hits(hits: DataFrame, keys: DataFrame) -> DataFrame:
    """row, at, item_id, place of all hits.

    Of keys that many documents have, only those of at most ``COMMON`` places are
    broadcast; others are shuffled, and Spark splits their partitions.
    """
    counted = hits.groupBy("key").agg(F.count("*").alias("n"))
    width = keys.groupBy("key").agg(F.count("*").alias("places"))
    table = saved(keys.join(width, "key").join(counted, "key"), "seed-places")
    narrow = table.filter(F.col("places") <= COMMON).drop("places")
    wide = table.filter(F.col("places") > COMMON).drop("places", "n")
    met = lookup(hits, narrow, "key", "n").select("row", "at", "item_id", "place")
    return met.unionByName(hits.join(wide, "key").select("row", "at", "item_id", "place"))


def best_overlap(same: np.ndarray, size: int) -> tuple[int, int]:
    """The most matching words in a window of ``size``, and where it begins first."""
    sums = np.append(0, np.cumsum(same))
    matched = sums[size:] - sums[:-size]
    at = int(matched.argmax())
    return int(matched[at]), at


def verifier(similarity: int, window: int):
    """Compares a block of an item with the stretch of a document on one diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            numbers = zip(*[
                batch[c].to_pylist() for c in ("diagonal", "n", "first", "begin", "words", "tokens")
            ])
            for row, (diagonal, n, first, begin, words, tokens) in enumerate(numbers):
                item = np.frombuffer(words, np.uint64)
                document = np.frombuffer(tokens, np.uint64)
                # Places of the block whose counterpart is in the stretch.
                shift = first + diagonal - begin
                low, high = max(0, -shift), min(len(item), len(document) - shift)
                same = np.zeros(len(item), np.int64)
                if low < high:
                    same[low:high] = item[low:high] == document[low + shift : high + shift]
                size = min(window, n)
                matched, at = best_overlap(same, size)
                if 100 * matched >= similarity * size:
                    keep.append(row)
                    out.append((max(0, first + at + diagonal), matched, size))
            chosen = pa.array(keep, pa.int64())
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(chosen),
                    batch["mark"].take(chosen),
                    batch["item_id"].take(chosen),
                    *[pa.array(c, pa.int64()) for c in columns],
                ],
                ["doc_id", "mark", "item_id", "first_word", "matched", "compared"],
            )

    return run


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` without those in which a test item is found, all columns unchanged."""
    found = find_contamination(docs, items, id_col, text_col)
    return without_rows(docs, found, id_col, text_col)
