"""Joining documents whose shingle sets are within a Jaccard distance, by metric regions.

The Jaccard distance is a metric, and so is that of two histograms, one minus the sum of
minima over the sum of maxima.  A histogram of the shingles' hashes in a fixed number of
bins never lies further apart than the sets, so what it rules out is out.

1. One pass counts shingles in a sketch of fixed size.  It orders them, rarer ones first.
2. A second pass gives every document the digest and the histogram of its set, and its
   first shingles in that order: so many that near documents have one in common.
   Documents with equal sets are one class.
3. A shingle that several classes bring is a region, its first class the region's first
   pivot.  Pivot and members are compared; what is near the pivot is one component.
4. Regions left with several components are divided: more pivots make Voronoi regions by
   the distance of histograms, and a class goes as a guest into every region whose pivot is
   at most two radii further away than its nearest, as the triangle inequality demands.
   Regions divide again until they are small, have one component only, or no longer
   shrink; large ones are divided by Spark jobs, others inside a task.
   A pair is looked at in the first region that both are in.
5. What remains meets in its leaf with the texts; pairs are confirmed on full sets, and
   only while their components are still apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.classes import (
    class_components, class_texts, document_classes, representatives, same_document,
)
from pubweave.llm.common import lookup, saved, small_batches, text_mark, whole_text
from pubweave.llm.graph import components
from pubweave.llm.minhash import runs_of, similar
from pubweave.llm.pieces import ragged
from pubweave.llm.shingles import chunks, mix, shingle_hashes, shingle_sets, utf8, word_hashes

#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
SHINGLE = 4
#: Bins of a histogram.
BINS = 128
#: Bits of the numbers of counters in the sketch, and counters in a row of its table.
COUNTER_BITS, COUNTER_ROW = 20, 1 << 10
#: Classes of a region that one task divides; Spark jobs divide larger ones.
REGION = 2048
#: Classes of a leaf; one that cannot be divided is compared in two blocks at a time.
LEAF = 128
#: Pivots of one division of a large region, and the share of a region's classes above
#: which a division counts as none.
PIVOTS, SHRINK = 16, 0.8

_SLACK = 1e-9
#: What a region knows of its members besides whether they are at home.
_MEMBER = ["origin", "cls", "component", "histogram", "keys"]


# --- sets, sketch of counts, profiles -------------------------------------------------


def _flat_shingles(batch: pa.RecordBatch, k: int) -> Iterator[tuple]:
    data, offsets = utf8(batch["text"])
    for first, last in chunks(offsets):
        words, _, _, before = word_hashes(data, offsets[first : last + 1])
        flat, after = shingle_hashes(words, before, k)
        yield first, last, flat, after


def count_sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Levels (binary logarithms) of the numbers of shingles per counter.

    Every task sends one table of fixed size, and so does Spark to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << COUNTER_BITS, np.int64)
        for batch in batches:
            for _, _, flat, _ in _flat_shingles(batch, k):
                at = (flat >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)
                table += np.bincount(at, minlength=len(table))
        yield from rows(dict(enumerate(table.reshape(-1, COUNTER_ROW))))

    def rows(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part, numbers in found.items():
            if numbers.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([numbers.tolist()], pa.list_(pa.int64()))],
                    ["part", "numbers"],
                )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, numbers in zip(batch["part"].to_pylist(), batch["numbers"]):
                sums[part] = sums.get(part, 0) + numbers.values.to_numpy()
        yield from rows(sums)

    schema = "part long, numbers array<long>"
    counted = texts.select("text").mapInArrow(count, schema)
    summed = counted.repartition("part").mapInArrow(add, schema)
    table = np.zeros(1 << COUNTER_BITS, np.int64)
    for part, numbers in summed.collect():
        table[part * COUNTER_ROW : (part + 1) * COUNTER_ROW] = numbers
    return np.log2(table + 1).astype(np.uint8)


def least_overlap(n: np.ndarray, similarity: int) -> np.ndarray:
    """Shingles that a set of n has in common with any near one."""
    return -(-similarity * n // 100)


def packed(histogram: np.ndarray) -> bytes:
    """A histogram in 1, 2, 4 or 8 bytes a bin."""
    top = int(histogram.max())
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return histogram.astype(f"<u{width}").tobytes()


def unpacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """One row of ``BINS`` numbers per histogram."""
    found = [np.frombuffer(h, f"<u{len(h) // BINS}") for h in column.to_pylist()]
    return np.array(found, np.int64).reshape(-1, BINS)


def profiles(texts: DataFrame, levels, k: int, similarity: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest, histogram and first shingles of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, flat, after in _flat_shingles(batch, k):
                bounds = after.tolist()
                sets = [np.unique(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                n = np.array([len(s) for s in sets], np.int64)
                whole = np.concatenate(sets)
                row = np.repeat(np.arange(len(sets)), n)
                bins = np.bincount(
                    row * BINS + (mix(whole) >> np.uint64(65 - BINS.bit_length())).astype(np.int64),
                    minlength=len(sets) * BINS,
                ).reshape(-1, BINS)
                level = levels.value[(whole >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                ordered = whole[np.lexsort((whole, level, row))]
                begin = np.cumsum(n) - n
                length = np.where(n > 0, n - least_overlap(n, similarity) + 1, 0)
                place = np.arange(len(whole)) - np.repeat(begin, n)
                keys = ordered[place < np.repeat(length, n)].view(np.int64)
                ends = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(first, last - first),
                        batch["mark"].slice(first, last - first),
                        pa.array(n),
                        pa.array([
                            hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets
                        ], pa.binary()),
                        pa.array([packed(h) for h in bins], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys)),
                    ],
                    ["doc_id", "mark", "n_shingles", "digest", "histogram", "first"],
                )

    return texts.mapInArrow(
        run,
        "doc_id long, mark long, n_shingles long, digest binary, histogram binary,"
        " first array<long>",
    )


# --- distances of histograms ---------------------------------------------------------------


def common_at_most(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper bounds of the intersections of a set with others, from their histograms."""
    return np.minimum(others, one).sum(axis=1)


def may_link(one: np.ndarray, others: np.ndarray, similarity: int) -> np.ndarray:
    common = common_at_most(one, others)
    return 100 * common >= similarity * (one.sum() + others.sum(axis=1) - common)


def distances(pivot: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of histograms from that of a pivot."""
    common = common_at_most(pivot, rows)
    return 1 - common / np.maximum(1, pivot.sum() + rows.sum(axis=1) - common)


def voronoi(rows: np.ndarray, pivots: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """The home of every row, and the regions (row by pivot) it has to be compared in.

    Of a near pair, x at home with pivot p: d(y, p) <= d(x, p) + r <= d(x, q) + r
    <= d(y, q) + 2 r for every other pivot q, so y is a guest of p at least.
    """
    away = np.stack([distances(p, rows) for p in pivots], axis=1)
    radius = 1 - similarity / 100
    return away.argmin(axis=1), away <= away.min(axis=1, keepdims=True) + 2 * radius + _SLACK


class Region:
    """Classes that one task divides: members, histograms, components; ``own`` marks those
    at home, of which every pair to find has one.

    ``origin`` is the shingle that the region began with, ``keys`` are those of all
    regions of every member: a pair is looked at in the first region it shares.
    """

    def __init__(self, group: pa.Table, similarity: int):
        self.histograms = unpacked(group["histogram"])
        self.component = group["component"].to_numpy()
        self.own = group["own"].to_numpy()
        self.similarity = similarity
        keys = group["keys"].combine_chunks()
        flat, self.bounds = keys.flatten().to_numpy(), np.append(
            0, np.cumsum(pc.list_value_length(keys).to_numpy())
        )
        row = np.repeat(np.arange(len(self.own)), np.diff(self.bounds))
        origin = group["origin"][0].as_py()
        earlier = flat < origin
        self.earlier = np.append(0, np.cumsum(earlier))[self.bounds]
        flat, row = flat[earlier], row[earlier]
        self.flat, order = flat, np.argsort(flat, kind="stable")
        self.sorted_keys, self.holders = flat[order], row[order]

    def met_before(self, row: int) -> np.ndarray:
        """Which classes share an earlier region with one."""
        found = np.zeros(len(self.own), bool)
        mine = self.flat[self.earlier[row] : self.earlier[row + 1]]
        first = np.searchsorted(self.sorted_keys, mine)
        last = np.searchsorted(self.sorted_keys, mine, "right")
        found[self.holders[ragged(first, last - first)]] = True
        return found

    def open(self, rows: np.ndarray, own: np.ndarray) -> bool:
        found = self.component[rows]
        return bool(own.any()) and bool((found != found[0]).any())

    def leaves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of small regions and whether they are at home there; every pair of near
        rows in different components meets in one of them."""
        todo = [(np.arange(len(self.own)), self.own)]
        while todo:
            rows, own = todo.pop()
            if not len(rows) or not self.open(rows, own):
                continue
            if len(rows) <= LEAF:
                yield rows, own
                continue
            found = list(self._divided(rows, own))
            if max(len(part) for part, _ in found) <= SHRINK * len(rows):
                todo += found
            else:
                yield from self._blocks(rows, own)

    def _divided(self, rows, own) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        count = int(np.sqrt(len(rows)))
        chosen = rows[np.linspace(0, len(rows) - 1, count).astype(np.int64)]
        home, guest = voronoi(self.histograms[rows], self.histograms[chosen], self.similarity)
        for p in range(count):
            here = guest[:, p]
            yield rows[here], own[here] & (home[here] == p)

    @staticmethod
    def _blocks(rows, own) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        half = LEAF // 2
        cuts = [slice(at, at + half) for at in range(0, len(rows), half)]
        for i, one in enumerate(cuts):
            for other in cuts[i + 1 :]:
                yield np.append(rows[one], rows[other]), np.append(own[one], own[other])

    def candidates(self, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which rows of a leaf may link with one of another component."""
        found = np.zeros(len(rows), bool)
        near = self.histograms[rows]
        for i in np.flatnonzero(own):
            others = may_link(near[i], near, self.similarity)
            others &= self.component[rows] != self.component[rows[i]]
            if others.any():
                others &= ~self.met_before(int(rows[i]))[rows]
            if others.any():
                found |= others
                found[i] = True
        return found


# --- regions -----------------------------------------------------------------------------


def _leaf_rows(regions: DataFrame, similarity: int) -> DataFrame:
    """leaf, cls, component, own of all classes that may link within their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["region"]):
            name = group["region"][0].as_py()
            cls, component = group["cls"].to_numpy(), group["component"].to_numpy()
            region = Region(group, similarity)
            for number, (rows, own) in enumerate(region.leaves()):
                keep = region.candidates(rows, own)
                if keep.any():
                    rows, own = rows[keep], own[keep]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(rows), pa.int64()),
                            pa.array([number] * len(rows), pa.int64()),
                            pa.array(cls[rows]), pa.array(component[rows]), pa.array(own),
                        ],
                        ["region", "leaf", "cls", "component", "own"],
                    )

    ordered = regions.repartition("region").sortWithinPartitions("region", "cls")
    return ordered.mapInArrow(
        run, "region long, leaf long, cls long, component long, own boolean"
    )


def _sizes(regions: DataFrame) -> DataFrame:
    return saved(
        regions.groupBy("region").agg(
            F.count("*").alias("n"),
            F.max("own").alias("owned"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).filter("owned and low < high").select("region", "n"),
        "region-sizes",
    )


def _divide_large(regions: DataFrame, similarity: int) -> DataFrame:
    """``regions`` (region, own and _MEMBER) with none of more than REGION classes."""
    done = []
    before = None
    while True:
        sizes = _sizes(regions)
        known = saved(lookup(regions, sizes, "region", "n"), "regions")
        done.append(known.filter(F.col("n") <= REGION).drop("n"))
        large = known.filter(F.col("n") > REGION)
        largest = sizes.agg(F.max("n")).first()[0] or 0
        if largest <= REGION:
            break
        if before is not None and largest > SHRINK * before:
            done.append(_in_blocks(large))
            break
        before = largest
        regions = _by_pivots(large, similarity)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole


def _by_pivots(large: DataFrame, similarity: int) -> DataFrame:
    """One division of every region by a fixed number of its classes."""
    draw = F.xxhash64("region", "cls")
    # Combined before the shuffle: the least draw in every of PIVOTS lots is a pivot.
    chosen = large.groupBy("region", F.pmod(draw, F.lit(PIVOTS)).alias("lot")).agg(
        F.min(F.struct(draw.alias("draw"), "histogram"))["histogram"].alias("pivot"),
        F.count("*").alias("n"),
    )
    pivots = saved(
        chosen.groupBy("region").agg(
            F.collect_list("pivot").alias("pivots"), F.sum("n").alias("weight")
        ),
        "pivots",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unpacked(batch["histogram"])
            names = batch["region"].to_numpy()
            for name in np.unique(names):
                at = np.flatnonzero(names == name)
                pivots = unpacked(batch["pivots"][int(at[0])].values)
                home, guest = voronoi(rows[at], pivots, similarity)
                own = batch["own"].to_numpy(zero_copy_only=False)[at]
                for p in range(len(pivots)):
                    here = np.flatnonzero(guest[:, p])
                    taken = pa.array(at[here])
                    child = mix(np.full(len(here), name).view(np.uint64) + np.uint64(p + 1))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(child.view(np.int64)),
                            pa.array(own[here] & (home[here] == p)),
                            *[batch[c].take(taken) for c in _MEMBER],
                        ],
                        ["region", "own", *_MEMBER],
                    )

    placed = lookup(large.drop("n"), pivots, "region", "weight").drop("weight")
    return saved(
        placed.select("region", "own", *_MEMBER, "pivots").mapInArrow(
            run,
            "region long, own boolean, origin long, cls long, component long,"
            " histogram binary, keys array<long>",
        ),
        "divided",
    )


def _in_blocks(large: DataFrame) -> DataFrame:
    """Regions that do not shrink, two blocks at a time: every pair meets."""
    blocks = F.ceil(F.col("n") * 2 / REGION)
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    placed = large.withColumn("blocks", blocks).withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    return placed.withColumn(
        "region", F.xxhash64("region", F.least("mine", "other"), F.greatest("mine", "other"))
    ).select("region", "own", *_MEMBER)


def _confirmed(leaves: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """Links (a, b) between components, confirmed on full sets in every leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, ["region", "leaf"]):
            data, offsets = utf8(group["text"].combine_chunks())
            flat, bounds = shingle_sets(data, offsets, k)
            cls, own = group["cls"].to_numpy(), group["own"].to_numpy()
            component = group["component"].to_numpy().copy()
            found = []
            for i in np.flatnonzero(own).tolist():
                for j in np.flatnonzero(component != component[i]).tolist():
                    if component[i] != component[j] and similar(
                        flat[bounds[i] : bounds[i + 1]], flat[bounds[j] : bounds[j + 1]],
                        similarity,
                    ):
                        found.append((int(cls[i]), int(cls[j])))
                        component[component == component[j]] = component[i]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    met = leaves.join(texts, "cls").select("region", "leaf", "cls", "component", "own", "text")
    ordered = met.repartition("region", "leaf").sortWithinPartitions("region", "leaf", "cls")
    return ordered.mapInArrow(run, "a long, b long")


def _near_pairs(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) that sizes and histograms do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = unpacked(batch["histogram_a"]), unpacked(batch["histogram_b"])
            common = np.minimum(one, other).sum(axis=1)
            union = one.sum(axis=1) + other.sum(axis=1) - common
            yield batch.select(["a", "b"]).filter(pa.array(100 * common >= similarity * union))

    for side in ("a", "b"):
        pairs = pairs.join(
            classes.select(
                F.col("cls").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                F.col("histogram").alias(f"histogram_{side}"),
            ),
            side,
        )
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * F.lit(similarity)
    return pairs.filter(sizes).select("a", "b", "histogram_a", "histogram_b").mapInArrow(
        run, "a long, b long"
    )


def _linked(pairs: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """The pairs whose full sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in ("text_a", "text_b"):
                flat, bounds = shingle_sets(*utf8(batch[column]), k)
                sides.append([flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
            near = [similar(left, right, similarity) for left, right in zip(*sides)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(
            texts.select(F.col("cls").alias(side), F.col("text").alias(f"text_{side}")), side
        )
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def metric_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: int = SIMILARITY,
    k: int = SHINGLE,
) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are what stands between ASCII white space, with A-Z in lower case; the set of
    a document has its distinct k-word shingles, or the whole of fewer words.  Documents
    link if 100 * intersection >= similarity * union of their sets; component_id is the
    smallest id that links lead to, the document's own included.

    A null text is empty; documents without words link with nothing.  Ids are
    integers.  Rows that share an id are one document: whatever one of them links with,
    all do.  A row without an id is left out of all links, its component_id is null.  No
    rows give no rows; other columns are ignored.  Shingles are 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        text_mark(text_col).alias("mark"),
        whole_text(text_col).alias("text"),
    )
    levels = spark.sparkContext.broadcast(count_sketch(rows, k))
    profile = saved(profiles(rows, levels, k, similarity), "profiles")
    usable = profile.filter("n_shingles > 0 and doc_id is not null")
    classes = document_classes(usable)
    reps = representatives(usable, classes, "n_shingles", "histogram", "first")

    brought = reps.select("cls", F.explode("first").alias("region"))
    shared = saved(
        brought.groupBy("region").agg(
            F.count("*").alias("n"), F.min("cls").alias("pivot"), F.max("cls").alias("last")
        ).filter("n > 1"),
        "shared-shingles",
    )
    # Two classes are a pair; only regions of more need their members.
    members = saved(
        lookup(brought, shared.filter("n > 2").drop("last"), "region", "n"), "members"
    )
    pairs = shared.filter("n = 2").select(F.col("pivot").alias("a"), F.col("last").alias("b"))
    stars = members.filter("cls <> pivot").select(
        F.col("pivot").alias("a"), F.col("cls").alias("b")
    )
    near = saved(_near_pairs(pairs.unionByName(stars).distinct(), reps, similarity), "near-pairs")

    ends = near.select(F.explode(F.array("a", "b")).alias("cls"))
    linked = _linked(near, class_texts(rows, classes, ends), k, similarity)
    links = saved(linked.unionByName(same_document(usable, classes)), "links")
    labels = components(links)
    labelled = members.join(labels, members["cls"] == labels["id"], "left").select(
        "region", "cls", F.coalesce("component", "cls").alias("component")
    )
    crossing = saved(_open_regions(saved(labelled, "labelled")), "open-members")
    keys = crossing.groupBy("cls").agg(F.sort_array(F.collect_list("region")).alias("keys"))
    described = keys.join(reps.select("cls", "histogram"), "cls")
    regions = crossing.withColumn("origin", F.col("region")).join(described, "cls").select(
        "region", F.lit(True).alias("own"), *_MEMBER
    )
    leaves = saved(
        _leaf_rows(_divide_large(saved(regions, "open-regions"), similarity), similarity), "leaves"
    )
    more = _confirmed(leaves, class_texts(rows, classes, leaves), k, similarity)
    labels = components(links.unionByName(saved(more, "links")))

    table = class_components(classes, labels)
    verdicts = lookup(
        profile.select("doc_id", "n_shingles", "digest"), table, "digest", "n", "left"
    )
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return verdicts.select(
        "doc_id", "n_shingles",
        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _open_regions(labelled: DataFrame) -> DataFrame:
    """Members of regions with several components; of regions with the same members one."""
    regions = labelled.groupBy("region").agg(
        F.count("*").alias("n"), F.min("component").alias("low"),
        F.max("component").alias("high"),
        F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("one"),
        F.sum(F.xxhash64("cls", F.lit(1)).cast("decimal(38,0)")).alias("other"),
    ).filter("low < high")
    distinct = regions.groupBy("n", "one", "other").agg(F.min("region").alias("region"))
    return lookup(labelled, saved(distinct.select("region", "n"), "open-keys"), "region", "n").drop(
        "n"
    )
