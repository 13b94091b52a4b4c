"""Token ids in flat binary files, to be memory-mapped by training jobs.

Format of a folder, one set of files per partition of documents in ascending id:

* ``*.bin``: the ids of all documents one after another, unsigned little-endian,
  16 bits wide if the vocabulary allows it, else 32;
* ``*.idx``: 64-bit little-endian numbers: the offsets of all documents in the
  ``.bin`` file, its total, then the document ids;
* ``manifest``: a Parquet table of the file names, their numbers of documents and
  ids, and ``base``, the number of ids in all files before, a prefix sum.

Files get a new name in every attempt of a task, and only the manifest of
finished tasks tells which ones count, so lost executors leave nothing wrong.
"""

from __future__ import annotations

import os
import re
import string
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from pubweave.llm.common import small_batches, whole_text
from pubweave.llm.pieces import ragged

#: Bytes that a Python worker holds of chunks and their ids; beyond that it starts anew.
KNOWN_BYTES = 96 << 20
#: Bytes of rows that are encoded together; a larger batch is by itself.
GROUP_BYTES = 12 << 20
#: New chunks that the library gets in one string, and strings in one call.
JOINED, CALL = 32, 1024

# White space as Unicode has it, and where it is next to a space or a line feed.
_WHITE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]"
_WHITE_RUN = f"{_WHITE}[ \n]|[ \n]{_WHITE}"
_SPACE_AFTER_WORD = re.compile(r"(?<=\S) ")

# Chunks that are sure to have no white space in any version of Unicode.
_VISIBLE = r"^[!-~\p{L}\p{N}]+$"
# Ends of words that are letters or digits in any version of Unicode.
_WORD_END = "[0-9A-Za-zÀ-ÖØ-öø-ſ]$"


class _Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.held, self.size = np.zeros(1 << 16, dtype), 0

    def add(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.held):
            self.held = np.append(self.held, np.zeros(max(end, len(self.held)), self.held.dtype))
        self.held[self.size : end] = values
        self.size = end


class Encoder:
    """A byte-level BPE tokenizer that encodes every chunk of text once.

    A token never continues over a space that follows another character than
    white space, nor into or out of a line feed between such characters, so a text
    may be cut there and its chunks encoded apart; nor from a letter or digit into
    the signs that end a chunk.  Chunks are split, numbered and parted from such signs by
    Arrow, then numbered with those known before; numpy looks up their ids by number.  New
    ones go to the library as lines of a few strings, where line feeds end their ids.
    """

    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known_bytes = known_bytes
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        #: The id of a line feed; None if chunks cannot be told apart by it.
        self.feed = feed[0] if len(feed) == 1 and self.tokenizer.normalizer is None else None
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Tokens that the library looks for before it cuts a text into words.
        self.added = "|".join(re.escape(token.content) for token in added)
        pieces = self.tokenizer.pre_tokenizer
        #: Whether words end where signs begin.
        self.parted = self.feed is not None and pieces is not None and all(
            len(pieces.pre_tokenize_str(word)) == 2 for word in ("é.", "a!?", "7),")
        )
        self._forget()

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.string())
        #: Per chunk the slot of its ids after a space, and where it begins without one.
        self.slot = _Grown(np.int32)
        self.at, self.length = _Grown(np.int64), _Grown(np.int32)
        self.pool = _Grown(np.uint32)

    def _held(self) -> int:
        grown = (self.slot, self.at, self.length, self.pool)
        return self.chunks.nbytes + sum(g.held.nbytes for g in grown)

    @staticmethod
    def split(texts: pa.StringArray) -> tuple[pa.ListArray, np.ndarray]:
        """Chunks of every text, and which texts have a line feed as a chunk of its own.

        There, all but the first, line feeds and what follows those stand after a space,
        which is not part of them; elsewhere, all but the first.
        """
        odd = pc.match_substring_regex(texts, _WHITE_RUN)
        plain = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        odd = odd.to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(odd)
        if not len(rows):
            return plain, ~odd
        slow = [_SPACE_AFTER_WORD.split(texts[row].as_py()) for row in rows.tolist()]
        order = np.arange(len(texts))
        order[rows] = len(texts) + np.arange(len(rows))
        whole = pa.concat_arrays([plain, pa.array(slow, plain.type)])
        return whole.take(pa.array(order)), ~odd

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts as the library has them, and the number of ids of each."""
        ids, counts = [], []
        for first in range(0, len(texts), CALL):
            found = self.tokenizer.encode_batch_fast(
                texts[first : first + CALL], add_special_tokens=False
            )
            each = [e.ids for e in found]
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            ids.append(np.fromiter(chain.from_iterable(each), np.uint32, counts[-1].sum()))
        return np.concatenate(ids), np.concatenate(counts)

    def _apart(self, chunks: pa.StringArray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        return self._library([lead + c for c in chunks.to_pylist()])

    def _joined(self, chunks: pa.StringArray, lead: str) -> tuple[np.ndarray, np.ndarray]:
        """As ``_apart``, of chunks without white space and added tokens."""
        bounds = np.append(np.arange(0, len(chunks), JOINED), len(chunks))
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chunks)
        lines = pc.binary_join(lists, f"\n{lead}").to_pylist()
        ids, counts = self._library([f"{lead}{line}\n" for line in lines])
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(chunks) or np.any(feeds[bounds[1:] - 1] + 1 != np.cumsum(counts)):
            return self._apart(chunks, lead)
        return np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1

    def _special(self, chunks: pa.StringArray) -> np.ndarray:
        """Which chunks have added tokens in them."""
        if not self.added:
            return np.zeros(len(chunks), bool)
        return pc.match_substring_regex(chunks, self.added).to_numpy(zero_copy_only=False)

    def _part(self, chunks: pa.StringArray) -> tuple[pa.StringArray, pa.StringArray, np.ndarray]:
        """Chunks without the signs that end them, these signs, and the rows that have some."""
        none = np.zeros(0, np.int64)
        if not self.parted:
            return chunks, chunks.slice(0, 0), none
        words = pc.ascii_rtrim(chunks, string.punctuation)
        ending = pc.match_substring_regex(words, _WORD_END).to_numpy(zero_copy_only=False)
        shorter = pc.not_equal(pc.binary_length(words), pc.binary_length(chunks))
        parted = ending & shorter.to_numpy(zero_copy_only=False) & ~self._special(chunks)
        rows = np.flatnonzero(parted)
        if not len(rows):
            return chunks, chunks.slice(0, 0), none
        # Signs are ASCII, so they are as many bytes as the difference.
        whole = chunks.take(pa.array(rows))
        signs = pc.replace_substring_regex(whole, "(?s)^.*[^!-/:-@\\[-`{-~]", "")
        return pc.if_else(pa.array(parted), words, chunks), signs, rows

    def _learn(self, keys: np.ndarray, lead: str) -> None:
        """Encode the chunks of these places in ``slot``."""
        chunks = self.chunks.take(pa.array(keys >> 1))
        plain = np.zeros(len(keys), bool)
        if self.feed is not None:
            visible = pc.match_substring_regex(chunks, _VISIBLE)
            plain = visible.to_numpy(zero_copy_only=False) & ~self._special(chunks)
        for mask, encoded in ((plain, self._joined), (~plain, self._apart)):
            if not mask.any():
                continue
            ids, counts = encoded(chunks.filter(pa.array(mask)), lead)
            self.slot.held[keys[mask]] = self.at.size + np.arange(len(counts))
            self.at.add(self.pool.size + np.cumsum(counts) - counts)
            self.length.add(counts)
            self.pool.add(ids)

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self._held() > self.known_bytes:
            self._forget()
        split, has_feeds = self.split(texts.cast(pa.string()))
        flat = split.flatten()
        lengths = pc.list_value_length(split).to_numpy()
        bounds = np.append(0, np.cumsum(lengths, dtype=np.int64))
        bare = np.zeros(len(flat) + 1, bool)
        bare[bounds[:-1]] = True
        feed = pc.equal(flat, "\n").to_numpy(zero_copy_only=False) & np.repeat(
            has_feeds, lengths
        )
        bare[:-1] |= feed
        bare[1:] |= feed
        numbered = flat.dictionary_encode()
        keys = 2 * numbered.indices.to_numpy().astype(np.int64) + bare[:-1]
        # Different chunks, after a space and without one, as far as they are there.
        there = np.zeros(2 * len(numbered.dictionary), bool)
        there[keys] = True
        chosen = np.flatnonzero(there)
        words, signs, ending = self._part(numbered.dictionary)
        # Chunks known before keep their numbers, new ones follow.
        coded = pa.chunked_array([self.chunks, words, signs]).dictionary_encode().chunks
        self.chunks = coded[-1].dictionary
        self.slot.add(np.full(2 * len(self.chunks) - self.slot.size, -1, np.int32))
        codes = np.concatenate([c.indices.to_numpy() for c in coded])
        codes = codes[len(codes) - len(words) - len(signs) :].astype(np.int64)
        first = 2 * codes[chosen >> 1] + (chosen & 1)
        then = np.full(len(words), -1)
        then[ending] = 2 * codes[len(words) :] + 1
        then = then[chosen >> 1]
        used = np.zeros(self.slot.size, bool)
        used[first] = used[then[then >= 0]] = True
        new = np.flatnonzero(used & (self.slot.held[: self.slot.size] < 0))
        for is_bare, lead in ((1, ""), (0, " ")):
            if len(some := new[new & 1 == is_bare]):
                self._learn(some, lead)
        # Ids of the different chunks, those of the word before those of the signs.
        slots = np.stack([self.slot.held[first], self.slot.held[np.maximum(then, 0)]], axis=1)
        sizes = self.length.held[slots]
        sizes[then < 0, 1] = 0
        pool = self.pool.held[ragged(self.at.held[slots].ravel(), sizes.ravel())]
        sizes = sizes.sum(axis=1)
        place = np.cumsum(there) - 1
        rows = place[keys]
        counts = sizes[rows]
        ids = pool[ragged((np.cumsum(sizes) - sizes)[rows], counts)]
        ends = np.append(0, np.cumsum(counts))
        return ids, np.diff(ends[bounds])


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """All rows in order, as many batches together as have up to ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > most:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.concat_batches(held)


_LOADED: dict[str, Encoder] = {}


def load(path: str) -> Encoder:
    """The tokenizer of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that all machines share."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class _Numbers:
    """The numbers of a file: mapped where its folder is mounted, else read by ranges."""

    def __init__(self, folder: str, name: str, dtype: str):
        self.dtype = np.dtype(dtype)
        system, path = _place(f"{folder}/{name}")
        self.file = self.map = None
        if not isinstance(system, pafs.LocalFileSystem):
            self.file = system.open_input_file(path)
        elif os.path.getsize(path):
            self.map = np.memmap(path, dtype=self.dtype, mode="r")
        else:
            self.map = np.zeros(0, self.dtype)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[part]
        wide = self.dtype.itemsize
        found = self.file.read_at((part.stop - part.start) * wide, part.start * wide)
        return np.frombuffer(found, self.dtype)


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode all texts and write them to a new ``folder`` in ascending id.

    ``tokenizer`` is the path of a tokenizer file on every machine; ``end_id`` closes
    every document.  Null and empty texts have the end id only.  Ids are
    integers; a null id comes first and is stored as the least 64-bit number.
    Rows that repeat an id stand next to each other, ordered by text.  No rows
    give a manifest without files.  Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    width = "<u2" if max(load(tokenizer).vocabulary, end_id + 1) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        part = TaskContext.get().partitionId()
        name = f"tokens-{part:08d}-{uuid.uuid4().hex}"
        system, path = _place(f"{folder}/{name}")
        ends, doc_ids = [np.zeros(1, np.int64)], []
        total = 0
        out = None
        for batch in grouped(batches, GROUP_BYTES):
            if not batch.num_rows:
                continue
            if out is None:
                out = system.open_output_stream(f"{path}.bin")
            ids, counts = encoder.encode(batch["text"])
            closed = np.full(len(ids) + len(counts), end_id, np.dtype(width))
            stops = np.cumsum(counts + 1)
            body = np.ones(len(closed), bool)
            body[stops - 1] = False
            closed[body] = ids
            out.write(closed.tobytes())
            ends.append(total + stops)
            total += len(closed)
            doc_ids.append(batch["doc_id"].to_numpy())
        if out is None:
            return
        out.close()
        with system.open_output_stream(f"{path}.idx") as index:
            for numbers in [*ends, *doc_ids]:
                index.write(numbers.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{
            "part": part, "name": name, "width": width,
            "n_docs": sum(map(len, doc_ids)), "n_tokens": total,
        }])

    least = -(1 << 63)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc_id"),
        whole_text(text_col).alias("text"),
    )
    system, path = _place(folder)
    system.create_dir(path, recursive=True)
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "part long, name string, width string, n_docs long, n_tokens long"
    # Written as it is first: the prefix sums must not run the encoding again.
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/parts")
    parts = spark.read.schema(schema).parquet(f"{folder}/parts")
    base = F.sum("n_tokens").over(W.orderBy("part")) - F.col("n_tokens")
    parts.withColumn("base", base).write.parquet(f"{folder}/manifest")


def read_token_files(
    spark: SparkSession,
    folder: str,
    value: Callable[[np.ndarray], object] | None = None,
    value_type: str = "array<long>",
) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ``value`` per document.

    ``value`` is made from the mapped ids of a document; by default it is the ids.
    """
    value = value or (lambda ids: ids.astype(np.int64))
    schema = f"doc_id long, start long, n_tokens long, value {value_type}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                yield from documents(part)

    def documents(part: dict) -> Iterator[pa.RecordBatch]:
        ids = _Numbers(folder, part["name"] + ".bin", part["width"])
        index = _Numbers(folder, part["name"] + ".idx", "<i8")
        n = part["n_docs"]
        for first in range(0, n, 512):
            stop = min(n, first + 512)
            # Offsets come first, document ids after the last of them.
            ends = index[first : stop + 1]
            here = ids[int(ends[0]) : int(ends[-1])]
            bounds = (ends - ends[0]).tolist()
            found = [value(here[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(index[n + 1 + first : n + 1 + stop]),
                    pa.array(part["base"] + ends[:-1]),
                    pa.array(np.diff(ends)),
                    pa.array(found),
                ],
                ["doc_id", "start", "n_tokens", "value"],
            )

    manifest = spark.read.parquet(f"{folder}/manifest")
    # One file per task where possible: the manifest itself is tiny.
    tasks = max(1, spark.sparkContext.defaultParallelism)
    spread = manifest.repartition(tasks, "part")
    found = spread.mapInArrow(run, schema)
    is_null = F.col("doc_id") == -(1 << 63)
    return found.withColumn("doc_id", F.when(~is_null, F.col("doc_id")))


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
