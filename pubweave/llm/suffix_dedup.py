"""Removal of byte strings that repeat across documents, by suffix order.

1. Every window of ``length`` bytes is assigned to its minimizer, the least hash of a
   shorter gram in it.  Equal windows have equal minimizers, so only windows of a
   bucket can be equal.  The windows that share a place of a minimizer form a
   context, a stretch of text.
2. Buckets are counted.  Contexts that occur several times are repeated as a whole.
3. The bytes of all other contexts of repeated buckets are fetched, each distinct one
   once, and brought into suffix order, bucket by bucket.  The previous and the next
   entry with a smaller text position give the longest previous factor of every
   position; where it reaches ``length`` the window has an earlier copy.
4. Windows found are joined to the documents, whose covered bytes are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.common import lookup, saved, small_batches, whole_text
from pubweave.llm.minhash import runs_of
from pubweave.llm.pieces import ragged
from pubweave.llm.shingles import mix, prefix_hash, run_hash, utf8

LENGTH = 200
#: Bytes of the grams whose least hash is the minimizer.
GRAM = 32
#: Bytes hashed at once; longer texts are cut into overlapping pieces.
PIECE_BYTES = 1 << 21
#: Bytes of contexts that are brought into suffix order together at most.
ORDER_BYTES = 1 << 22
#: A bucket with more distinct contexts, or more bytes of them, is compared window by
#: window, its contexts cut into stretches of so many windows.
HOT_CONTEXTS = 100_000
HOT_BYTES = ORDER_BYTES
STRETCH_WINDOWS = 1 << 12

_VALUE = mix(np.arange(1001, 1257, dtype=np.uint64))
_VALUE2 = mix(np.arange(5001, 5257, dtype=np.uint64))
_PLACE = 24  # bits of a place in a piece


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def contexts_of(
    text: np.ndarray, length: int = LENGTH, gram: int = GRAM
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of one piece of text: minimizer, hash of the bytes, first window,
    number of windows, number of minimizer places."""
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return (none,) * 5
    sums = prefix_hash(_VALUE[text])
    starts = np.arange(len(text) - gram + 1)
    grams = mix(run_hash(sums, starts, starts + gram))
    keys = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | starts.astype(np.uint64)
    least = sliding_least(keys, length - gram + 1)
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new_place = np.append(True, place[1:] != place[:-1])
    hashed = grams[place]
    # Neighbours with equal minimizers, as in a run of one character, are one context.
    new = np.append(True, hashed[1:] != hashed[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(place)))
    places = np.add.reduceat(new_place.astype(np.int64), first)
    sums2 = prefix_hash(_VALUE2[text])
    body = mix(run_hash(sums2, first, first + count + length - 1) + count.astype(np.uint64))
    return hashed[first].view(np.int64), body.view(np.int64), first, count, places


def _pieces(size: int, length: int) -> Iterator[tuple[int, int]]:
    """Overlapping stretches of a long text whose windows are all its windows."""
    for start in range(0, max(1, size - length + 1), PIECE_BYTES):
        yield start, min(size, start + PIECE_BYTES + length - 1)


# --- suffix order --------------------------------------------------------------------


class SuffixOrder:
    """Order of all suffixes of some bytes by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data = np.append(data, np.zeros(length + 8, np.uint8))
        self.n = n = len(data)
        code = np.zeros(n + length, np.uint64)
        for i in range(8):
            code |= self.data[i : i + n + length].astype(np.uint64) << np.uint64(56 - 8 * i)
        rank = np.unique(code, return_inverse=True)[1].astype(np.int64)
        self.levels = [(8, rank)]
        size = 8
        while 2 * size <= length:
            rank = self._joined(rank, rank, size)
            size *= 2
            self.levels.append((size, rank))
        if size < length:
            rank = self._joined(rank, rank, length - size)
        self.rank = rank

    @staticmethod
    def _joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        later = np.append(right[shift:], np.zeros(shift, np.int64))
        pair = left * (int(right.max(initial=0)) + 1) + later
        return np.unique(pair, return_inverse=True)[1].astype(np.int64)

    def common(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Length of the common prefix of suffixes, up to ``length``."""
        same = np.zeros(len(a), np.int64)
        full = self.rank[a] == self.rank[b]
        for size, rank in reversed(self.levels):
            fits = ~full & (same + size <= length)
            at = np.where(fits, same, 0)
            same += size * (fits & (rank[a + at] == rank[b + at]))
        for _ in range(8):
            fits = ~full & (same < length)
            at = np.where(fits, same, 0)
            same += fits & (self.data[a + at] == self.data[b + at])
            # The first difference ends it: what follows is compared with it again.
        return np.where(full, length, np.minimum(same, length))


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value to the left, or -1; by pointer jumping."""
    near = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        at = near[todo]
        todo = todo[(at >= 0) & (values[np.maximum(at, 0)] > values[todo])]
        near[todo] = near[near[todo]]
    return near


def previous_factors(order: SuffixOrder, at: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, up to ``length``, of the suffixes at sorted places."""
    suffixes = np.argsort(order.rank[at], kind="stable")
    place = at[suffixes]
    factor = np.zeros(len(at), np.int64)
    before = nearest_smaller(place)
    after = len(place) - 1 - nearest_smaller(place[::-1])[::-1]
    for near, none in ((before, -1), (after, len(place))):
        has = np.flatnonzero(near != none)
        found = order.common(place[has], place[near[has]], length)
        factor[suffixes[has]] = np.maximum(factor[suffixes[has]], found)
    return factor


def repeated_windows(
    texts: list[bytes], counts: np.ndarray, length: int, keep_first: bool
) -> list[np.ndarray]:
    """For every context which of its first ``counts`` windows have another copy.

    With ``keep_first`` only an earlier copy counts, in the order given.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    at = ragged(begin, counts)
    order = SuffixOrder(data, length)
    found = previous_factors(order, at, length) >= length
    if not keep_first:
        # A window with a later copy: the copy has an earlier one of its rank.
        ranks = order.rank[at]
        twice = np.unique(ranks[found])
        found |= np.isin(ranks, twice)
    return np.split(found, np.cumsum(counts)[:-1]) if len(counts) else []


# --- Spark -----------------------------------------------------------------------------


def _stretches(flags: np.ndarray, start: int, length: int) -> list[dict]:
    """Byte ranges that the flagged windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [
        {"start": start + a, "end": start + b - 1 + length}
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())
    ]


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            rows, parts = [], []
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                for a, b in _pieces(len(text), length):
                    found = contexts_of(text[a:b], length, gram)
                    rows.append(np.full(len(found[0]), row))
                    parts.append((found[0], found[1], found[2] + a, found[3], found[4]))
            if not parts:
                continue
            at = pa.array(np.concatenate(rows))
            columns = [np.concatenate(c) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays(
                [batch["k1"].take(at), batch["k2"].take(at), *map(pa.array, columns)],
                ["k1", "k2", "bucket", "body", "start", "windows", "places"],
            )

    return docs.mapInArrow(
        run,
        "k1 long, k2 long, bucket long, body long, start long, windows long, places long",
    )


def _short_stretches(wanted: DataFrame) -> DataFrame:
    """Contexts of hot buckets cut into stretches that share no window; others as they are."""
    step = F.when(F.col("hot") == 1, F.lit(STRETCH_WINDOWS)).otherwise(F.col("windows"))
    cut = F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1, step))
    return wanted.withColumn("at", cut).select(
        "bucket", "k1", "k2", (F.col("start") + F.col("at")).alias("start"),
        F.least(F.col("windows") - F.col("at"), step).alias("windows"), "hot",
    )


def _fetch(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            rows, found, texts = [], [], []
            for row, contexts in enumerate(batch["contexts"].to_pylist()):
                base = int(offsets[row])
                for c in contexts:
                    rows.append(row)
                    found.append(c)
                    a = base + c["start"]
                    texts.append(data[a : a + c["windows"] + length - 1].tobytes())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["k1"].take(at), batch["k2"].take(at),
                    *[pa.array([c[n] for c in found], pa.int64())
                      for n in ("bucket", "start", "windows", "hot")],
                    pa.array(texts, pa.binary()),
                ],
                ["k1", "k2", "bucket", "start", "windows", "hot", "bytes"],
            )

    lists = wanted.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("bucket", "start", "windows", "hot")).alias("contexts")
    )
    texts = docs.join(lists, ["k1", "k2"]).select("k1", "k2", "text", "contexts")
    return texts.mapInArrow(
        run,
        "k1 long, k2 long, bucket long, start long, windows long, hot long, bytes binary",
    )


def _distinct_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted contexts without those that rows with the same id and text bring again."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[n].to_numpy() for n in ("bucket", "k1", "k2", "start")])
        new = np.append(last is None or np.any(keys[:, 0] != last),
                        np.any(keys[:, 1:] != keys[:, :-1], axis=0))
        last = keys[:, -1]
        yield batch.filter(pa.array(new))


def _by_suffix_order(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Stretches of the contexts that repeat in another one of their bucket."""

    def solve(group: pa.Table) -> pa.RecordBatch:
        counts = group["windows"].to_numpy()
        flags = repeated_windows(group["bytes"].to_pylist(), counts, length, keep_first)
        starts = group["start"].to_pylist()
        out_row, out = [], []
        for row, found in enumerate(flags):
            if found.any():
                for stretch in _stretches(found, starts[row], length):
                    out_row.append(row)
                    out.append(stretch)
        at = pa.array(out_row, pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                group["k1"].combine_chunks().take(at), group["k2"].combine_chunks().take(at),
                *[pa.array([s[n] for s in out], pa.int64()) for n in ("start", "end")],
            ],
            ["k1", "k2", "start", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for bucket in runs_of(_distinct_contexts(batches), ["bucket"]):
            if held and size + bucket.nbytes > ORDER_BYTES:
                yield solve(pa.concat_tables(held))
                held, size = [], 0
            held.append(bucket)
            size += bucket.nbytes
        if held:
            yield solve(pa.concat_tables(held))

    ordered = contexts.repartition("bucket").sortWithinPartitions("bucket", "k1", "k2", "start")
    return ordered.mapInArrow(run, "k1 long, k2 long, start long, end long")


def _by_window(contexts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """The same for buckets too large for one task: windows meet by their bytes."""
    # Rows that repeat an id and its text bring their contexts twice.
    contexts = contexts.dropDuplicates(["k1", "k2", "start"])
    windows = contexts.select(
        "k1", "k2",
        F.posexplode(F.transform(
            F.sequence(F.lit(1).cast("long"), F.col("windows")),
            lambda i: F.substring(F.col("bytes"), i.cast("int"), F.lit(length)),
        )).alias("i", "window"),
        "start",
    ).withColumn("start", F.col("start") + F.col("i")).drop("i")
    seen = windows.groupBy("window").agg(
        F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start")).alias("first")
    ).filter("n > 1")
    own = F.struct("k1", "k2", "start")
    found = lookup(windows, saved(seen, "hot-windows"), "window", "n")
    if keep_first:
        found = found.filter(own != F.col("first"))
    return found.select("k1", "k2", "start", (F.col("start") + length).alias("end"))


def suffix_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    keep: str = "first",
    gram: int = GRAM,
    hot_contexts: int = HOT_CONTEXTS,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges: start, end) and kept (the rest).

    Texts are their UTF-8 bytes; a null text is empty.  A byte goes if a string of
    ``length`` bytes that covers it has a copy that starts anywhere else, in any
    document: an earlier one with ``keep="first"`` (ids ascend, then places), any one
    with ``keep="none"``.  Matches never reach into another document.  Rows that
    repeat an id and its text are each other's copies; they count as one place, so
    with ``keep="first"`` both stay or go.  A null id sorts first.  Ids are
    integers.  No rows give no rows; other columns are ignored.
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    small_batches(docs.sparkSession)
    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        # Whose text it is, for joins: repeated ids with other texts are told apart.
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(text).alias("k2"),
        text.alias("text"),
    )
    contexts = saved(_scan(rows.drop("doc_id"), length, gram), "contexts")
    buckets = saved(
        contexts.groupBy("bucket").agg(
            F.sum("places").alias("places"), F.count("*").alias("n"),
            F.min("body").alias("low"), F.max("body").alias("high"),
            F.max("places").alias("most"),
        ).filter("places > 1")
        .select("bucket", "n", ((F.col("low") != F.col("high")) | (F.col("most") > 1))
                .alias("mixed")),
        "buckets",
    )
    own = F.struct("k1", "k2", "start")
    repeated = saved(
        lookup(contexts, buckets, "bucket", "n").drop("n"),
        "repeated",
    )
    # Contexts with the same bytes: all of them repeat as a whole.
    same = saved(
        repeated.groupBy("bucket", "body").agg(
            F.count("*").alias("n"), F.min(own).alias("first"),
            F.first("windows").alias("windows"), F.first("mixed").alias("mixed"),
        ).withColumn("same", F.struct("bucket", "body")),
        "same",
    )
    copied = same.filter("n > 1").select("same", "n", "first")
    placed = repeated.withColumn("same", F.struct("bucket", "body"))
    whole = lookup(placed, copied, "same", "n")
    if keep == "first":
        whole = whole.filter(own != F.col("first"))
    whole = whole.select(
        "k1", "k2", "start",
        (F.col("start") + F.col("windows") + (length - 1)).alias("end"),
    )
    # Of every other context one place is compared with the rest of its bucket.
    crowded = same.filter("mixed").groupBy("bucket").agg(
        F.count("*").alias("distinct"), F.sum(F.col("windows") + (length - 1)).alias("size")
    )
    crowded = saved(crowded, "crowded")
    wanted = lookup(
        same.filter("mixed").select(
            "bucket", "first.k1", "first.k2", "first.start", "windows"
        ),
        crowded.withColumn("w", F.col("distinct")), "bucket", "w",
    )
    large = (F.col("distinct") > hot_contexts) | (F.col("size") > hot_bytes)
    wanted = _short_stretches(wanted.withColumn("hot", large.cast("long")))
    fetched = saved(_fetch(wanted, rows, length), "fetched")
    cold = _by_suffix_order(fetched.filter("hot = 0"), length, keep == "first")
    hot = _by_window(fetched.filter("hot = 1"), length, keep == "first")
    stretches = whole.unionByName(cold).unionByName(hot)
    lists = stretches.groupBy("k1", "k2").agg(
        F.collect_list(F.struct("start", "end")).alias("stretches")
    )
    return _cut(rows.join(lists, ["k1", "k2"], "left"))


def _cut(docs: DataFrame) -> DataFrame:
    """Documents without the bytes of their stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            stretches = batch["stretches"]
            spans, kept = [], []
            for row in range(batch.num_rows):
                text = data[offsets[row] : offsets[row + 1]]
                found = stretches[row]
                if not found.is_valid:
                    spans.append([])
                    kept.append(text.tobytes())
                    continue
                inner = found.values
                starts, ends = inner.field("start").to_numpy(), inner.field("end").to_numpy()
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, ends, -1)
                gone = np.cumsum(depth[:-1]) > 0
                spans.append(_stretches(gone, 0, 1))
                kept.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.diff(offsets)),
                    pa.array(spans, pa.list_(
                        pa.struct([("start", pa.int64()), ("end", pa.int64())])
                    )),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return docs.select("doc_id", "text", "stretches").mapInArrow(
        run,
        "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary",
    )
