"""Near-duplicate documents by fast similarity sketches.

1. One pass over the texts gives every document the digest of its shingle set, a
   fast similarity sketch, and the keys of its bands.
2. Documents with equal sets form classes; only one of each class goes on.
3. A bucket holds the classes that agree in a band.  Its first class is the hub,
   and the pairs of hub and member are verified on their full sets.  What links
   is joined, so a group of near copies is closed without forming its pairs.
4. Buckets that still hold several components come together with their texts.  Sketches
   are compared across components; pairs that the concentration bound of the sketches
   leaves are verified on full sets, the likeliest first, each in its first common
   band only and only while its ends are in different components.
5. Classes linked directly or over others make a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.classes import (
    class_components, class_texts, document_classes, representatives, same_document,
)
from pubweave.llm.common import (
    lookup, one_row_each, saved, small_batches, text_mark, whole_text, without_rows,
)
from pubweave.llm.graph import components
from pubweave.llm.shingles import chunks, shingle_sets, utf8
from pubweave.llm.sketch import band_keys, sketches

#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
SHINGLE = 5
#: A pair at the threshold shares no band with a probability of 1e-6.
BANDS, BAND_ROWS = 51, 5
#: Standard deviations below the threshold at which a sketch rules a pair out.
DEVIATIONS = 4.5
#: Classes of a bucket that are compared in one block.
BLOCK = 2048


def _least_agreement(similarity: int, t: int) -> int:
    p = similarity / 100
    return int(np.floor(t * p - DEVIATIONS * np.sqrt(t * p * (1 - p))))


def profiles(docs: DataFrame, k: int, bands: int, band_rows: int) -> DataFrame:
    """doc_id, mark of the text, n_shingles, digest of the set, bytes of the sketch, band
    keys."""
    t = bands * band_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch["text"])
            for first, last in chunks(offsets):
                flat, bounds = shingle_sets(data, offsets[first : last + 1], k)
                sketch = sketches(flat, bounds, t)
                keys = band_keys(sketch, bands, band_rows).view(np.int64)
                short = (sketch ^ (sketch >> np.uint64(32))).astype(np.uint8)
                ends = bounds.tolist()
                digests = [
                    hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest()
                    for a, b in zip(ends[:-1], ends[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, last - first),
                        batch["mark"].slice(first, last - first),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)),
                            pa.array(keys.reshape(-1)),
                        ),
                    ],
                    ["doc_id", "mark", "n_shingles", "digest", "sketch", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"doc_id {kind}, mark long, n_shingles long, digest binary, sketch binary,"
        " bands array<long>",
    )


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    A text may have very many pairs: Spark splits skewed partitions of these joins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(_sets(batch["text_a"], k), _sets(batch["text_b"], k))
            linked = [similar(left, right, similarity) for left, right in sides]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.select("a", "b")
    for side in ("a", "b"):
        joined = joined.join(
            texts.select(F.col("rep").alias(side), F.col("text").alias(f"text_{side}")), side
        )
    kind = pairs.schema["a"].dataType.simpleString()
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def similar(left: np.ndarray, right: np.ndarray, similarity: int) -> bool:
    """Whether two sets, sorted without repeats, link."""
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both > 0 and 100 * both >= similarity * (len(left) + len(right) - both)


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Shingle sets of the texts of a column."""
    data, offsets = utf8(column)
    return [
        part[x:y]
        for first, last in chunks(offsets)
        for part, bounds in [shingle_sets(data, offsets[first : last + 1], k)]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())
    ]


class _Bucket:
    """The classes of one block of a bucket, or of two, with different components."""

    def __init__(self, group: pa.Table, similarity: int, k: int, t: int):
        self.similarity, self.k = similarity, k
        self.least = _least_agreement(similarity, t)
        self.rep = group["rep"].to_numpy()
        self.component = group["component"].to_numpy()
        self.size = group["n_shingles"].to_numpy()
        self.text = group["text"].combine_chunks()
        is_left, is_right = group["left"].to_numpy(), group["right"].to_numpy()
        self.left, self.right = np.flatnonzero(is_left), np.flatnonzero(is_right)
        self.within = bool((is_left & is_right).any())  # a block against itself
        self.sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8)
        self.sketch = self.sketch.reshape(-1, t)
        flat = group["bands"].combine_chunks().flatten().to_numpy()
        self.bands = flat.reshape(len(self.rep), -1)
        # The first band that a pair shares is the one that looks at it.
        self.column = int(np.flatnonzero(self.bands[0] == group["key"][0].as_py())[0])

    def candidates(self) -> list[tuple[int, int, int]]:
        """(agreeing coordinates, one, other) of pairs that may link, the likeliest first."""
        found = []
        for i in self.left.tolist():
            others = self.right[self.component[self.right] != self.component[i]]
            low, high = np.minimum(self.size[others], self.size[i]), np.maximum(
                self.size[others], self.size[i]
            )
            others = others[100 * low >= self.similarity * high]
            if self.within:
                others = others[self.rep[others] > self.rep[i]]
            if not len(others):
                continue
            agree = (self.sketch[others] == self.sketch[i]).sum(axis=1)
            others, agree = others[agree >= self.least], agree[agree >= self.least]
            if self.column and len(others):
                earlier = self.bands[others, : self.column] == self.bands[i, : self.column]
                new = ~earlier.any(axis=1)
                others, agree = others[new], agree[new]
            found += [(a, i, j) for a, j in zip(agree.tolist(), others.tolist())]
        return sorted(found, key=lambda pair: -pair[0])

    def links(self) -> Iterator[tuple[int, int]]:
        """Verified links; none is needed between what earlier ones have joined."""
        pairs = self.candidates()
        rows = sorted({row for pair in pairs for row in pair[1:]})
        if not rows:
            return
        sets = dict(zip(rows, _sets(self.text.take(pa.array(rows)), self.k)))
        above: dict[int, int] = {}

        def root(component: int) -> int:
            while component in above:
                component = above[component]
            return component

        for _, i, j in pairs:
            one, other = root(int(self.component[i])), root(int(self.component[j]))
            if one != other and similar(sets[i], sets[j], self.similarity):
                above[max(one, other)] = min(one, other)
                yield int(self.rep[i]), int(self.rep[j])


def _cross_links(members: DataFrame, similarity: int, k: int, t: int) -> DataFrame:
    """Links (a, b) between different components in the blocks of every bucket.

    ``members`` has one row per block and class: key, block, left, right, rep,
    component, n_shingles, sketch, bands and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["key", "block"]):
            found = list(_Bucket(group, similarity, k, t).links())
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    ordered = members.repartition("key", "block").sortWithinPartitions("key", "block")
    return ordered.mapInArrow(run, "a long, b long")


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across the borders of batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for first, end in zip(cuts[:-1], cuts[1:]):
            now = tuple(column[first] for column in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(first, end - first))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _open_members(
    members: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame
) -> DataFrame:
    """Members of buckets that hold several components, in pairs of blocks."""
    labelled = members.join(labels, members["rep"] == labels["id"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    labelled = saved(labelled, "labelled")
    open_keys = labelled.groupBy("key").agg(
        F.count("*").alias("n"), F.min("component").alias("low"),
        F.max("component").alias("high"),
    )
    open_keys = saved(open_keys.filter("low < high").select("key", "n"), "open-buckets")
    found = lookup(labelled, open_keys, "key", "n")
    # A bucket of up to BLOCK classes is one block; a larger one is compared block by block.
    blocks = F.floor((F.col("n") - 1) / BLOCK) + 1
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = found.withColumn("blocks", blocks).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    placed = placed.select(
        "key", "rep", "component",
        (low * F.col("blocks") + high).alias("block"),
        (F.col("mine") == low).alias("left"),
        (F.col("mine") == high).alias("right"),
    )
    return placed.join(reps.select("rep", "n_shingles", "sketch", "bands"), "rep").join(
        texts, "rep"
    )


def minhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: int = SIMILARITY,
    k: int = SHINGLE,
    bands: int = BANDS,
    band_rows: int = BAND_ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the text's mark of every document.

    Words are what stands between ASCII white space, with A-Z in lower case; the
    set of a document has its distinct k-word shingles, or the whole of fewer words.
    Documents link if 100 * intersection >= similarity * union of their sets;
    component_id is the smallest id that links lead to, kept says that it is the
    document's own.  A null text is empty; documents without words link with
    nothing.  Ids are integers; a row without an id is left out of all links and
    kept.  Rows that repeat an id and its text share a verdict.  No rows give
    no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_mark(text_col).alias("mark"),
        whole_text(text_col).alias("text"),
    )
    profile = saved(profiles(rows, k, bands, band_rows), "profiles")
    usable = profile.filter("n_shingles > 0 and doc_id is not null")
    classes = document_classes(usable)
    reps = representatives(usable, classes, "n_shingles", "sketch", "bands").withColumnRenamed(
        "cls", "rep"
    )

    in_bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = saved(
        in_bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n"))
        .filter("n > 1"),
        "buckets",
    )
    members = saved(
        lookup(in_bands, buckets, "key", "n").select("key", "rep", "hub"),
        "members",
    )
    texts = class_texts(rows, classes, members.withColumnRenamed("rep", "cls"))
    texts = texts.withColumnRenamed("cls", "rep")

    stars = members.filter("rep <> hub").select(
        F.col("hub").alias("a"), F.col("rep").alias("b")
    ).distinct()
    near = verified(stars, texts, k, similarity)
    links = saved(near.unionByName(same_document(usable, classes)), "links")
    crossing = _open_members(members, components(links), reps, texts)
    more = _cross_links(crossing, similarity, k, bands * band_rows)
    labels = components(links.unionByName(saved(more, "links")))

    verdicts = lookup(
        profile.select("doc_id", "mark", "n_shingles", "digest"),
        class_components(classes, labels), "digest", "n", "left",
    )
    component = F.when(
        (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")
    ).otherwise(F.col("doc_id"))
    return verdicts.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"), "mark",
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each component, all columns unchanged.

    Rows without an id or without words stay; of those that repeat both id and text, one.
    """
    verdicts = saved(minhash_dedup(docs, id_col, text_col), "near-copies")
    # Of rows that share the id of a component, one text stays, and of equal rows one.
    other = verdicts.filter("kept and n_shingles > 0 and doc_id is not null").groupBy(
        "doc_id"
    ).agg(F.min("mark").alias("stays"), F.max("mark").alias("last")).filter("stays < last")
    extra = verdicts.filter("kept and n_shingles > 0").join(other, "doc_id").filter(
        "mark > stays"
    )
    dropped = verdicts.filter("not kept").unionByName(extra.select(*verdicts.columns))
    return without_rows(one_row_each(docs, id_col, text_col), dropped, id_col, text_col)
