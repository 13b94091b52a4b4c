"""SentencePiece encoding and decoding by vectorised merge rounds.

Texts fall into words before every space mark that follows another character; no
piece of the vocabulary reaches across such a place.  The words that a batch
adds to those already known are encoded together: their symbols lie in one flat
array, every round finds the best pair of every word by a segmented minimum
over pair ranks, merges it at all its places from left to right, and compacts
the array, until no word has a pair.  Very long words need as many rounds as they have
different pairs and take their pairs from a heap instead.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pubweave.llm.common import small_batches, whole_text

MARK = "▁"
#: Words that a Python worker remembers, and their bytes with what an entry takes
#: besides; beyond that it starts anew.
KNOWN_WORDS, KNOWN_BYTES, ENTRY_BYTES = 600_000, 200 << 20, 150
#: Longer words are merged pair by pair: a round looks at all symbols of a word, which
#: costs little as long as few rounds are needed.
LONG_WORD = 256

_NONE = np.int64(1) << 40
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class PairTable:
    """Rank and result of a pair of symbols, in a hash table with linear probing."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (len(pairs) * 8).bit_length())
        size = 1 << self.bits
        left = np.fromiter((a for a, _ in pairs), np.int64, len(pairs))
        right = np.fromiter((b for _, b in pairs), np.int64, len(pairs))
        values = np.array(list(pairs.values()), dtype=np.int64).reshape(-1, 2)
        key = (left << 32) | right
        self.key = np.full(size, -1, np.int64)
        self.rank = np.full(size, _NONE, np.int64)
        self.made = np.zeros(size, np.int64)
        self.probes = 0
        todo = np.arange(len(key))
        slot = self._slot(key)
        while len(todo):
            at = (slot[todo] + self.probes) & (size - 1)
            free = self.key[at] == -1
            _, first = np.unique(at, return_index=True)
            taken = np.zeros(len(todo), bool)
            taken[first] = free[first]
            put, where = todo[taken], at[taken]
            self.key[where] = key[put]
            self.rank[where], self.made[where] = values[put, 0], values[put, 1]
            todo = todo[~taken]
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slots of pairs; a slot without the pair has the rank _NONE."""
        key = (left << 32) | right
        slot = self._slot(key)
        hit = self.key[slot] == key
        for step in range(1, self.probes):
            missed = np.flatnonzero(~hit)
            if not len(missed):
                break
            at = (self._slot(key[missed]) + step) & (len(self.key) - 1)
            same = self.key[at] == key[missed]
            slot[missed[same]] = at[same]
            hit[missed[same]] = True
        return np.where(hit, slot, -1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of runs that begin at starts."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)


class Pieces:
    """The vocabulary of a BPE model with byte fallback, and the words met so far."""

    def __init__(self, path: str, known_words: int = KNOWN_WORDS):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self._check(model)
        self.known_words = known_words
        kinds = proto.ModelProto.SentencePiece
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in normal):
            raise ValueError("pieces that reach into the next word are not supported")
        self.byte_id = np.zeros(256, np.int64)
        surface = []
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                surface.append(model.trainer_spec.unk_surface.encode())
            elif p.type == kinds.CONTROL:
                surface.append(b"")
            else:
                surface.append(p.piece.replace(MARK, " ").encode())
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.is_marked = np.array([p.piece.startswith(MARK) for p in model.pieces])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        # Symbols: ids of pieces, then characters that are no piece.
        self.of_char = {c: i for c, i in normal.items() if len(c) == 1}
        score = {piece: model.pieces[i].score for piece, i in normal.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs, best = {}, {}
        for piece, made in normal.items():
            for cut in range(1, len(piece)):
                halves = [self._symbol(h, normal) for h in (piece[:cut], piece[cut:])]
                if None not in halves:
                    pairs[tuple(halves)] = (order[score[piece]], made)
                    for half in halves:
                        best[half] = min(best.get(half, _NONE), order[score[piece]])
        self.pairs = PairTable(pairs)
        self.pair_of: dict[int, tuple[int, int]] | None = None
        # A merge is made at all places at once only if what it makes cannot come
        # first itself; else the leftmost place is merged alone.
        self.alone = np.zeros(self.size + 1, bool)
        for piece, made in normal.items():
            self.alone[made] = best.get(made, _NONE) <= order[score[piece]]
        self._forget()

    @staticmethod
    def _check(model) -> None:
        spec, rules = model.trainer_spec, model.normalizer_spec
        kinds = {p.type for p in model.pieces} - {1, 2, 3, 6}
        if (
            spec.model_type != 2 or not spec.byte_fallback or kinds
            or spec.treat_whitespace_as_suffix or rules.precompiled_charsmap
            or not rules.add_dummy_prefix or rules.remove_extra_whitespaces
            or not rules.escape_whitespaces
        ):
            raise ValueError("only plain BPE models with byte fallback are supported")

    def _symbol(self, piece: str, normal: dict[str, int]) -> int | None:
        if len(piece) == 1 and piece not in self.of_char:
            self.of_char[piece] = self.size + 1 + ord(piece)
        return normal.get(piece, self.of_char.get(piece))

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.at, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)
        self.bytes = 0

    # --- encoding ---------------------------------------------------------

    @staticmethod
    def words(text: str) -> list[str]:
        """The words of a text, each without the mark that it begins with."""
        if not text:
            return []
        if text[0] != " " and "  " not in text and MARK not in text:
            return text.split(" ")
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def _symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = MARK + MARK.join(words) if words else ""
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        chars, where = np.unique(codes, return_inverse=True)
        ids = [self.of_char.get(chr(c), self.size + 1 + c) for c in chars.tolist()]
        lengths = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        return np.array(ids, np.int64)[where], lengths

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one word after the last merge, best and leftmost pair first."""
        if self.pair_of is None:
            used = np.flatnonzero(self.pairs.key != -1)
            ranked = zip(self.pairs.rank[used].tolist(), self.pairs.made[used].tolist())
            self.pair_of = dict(zip(self.pairs.key[used].tolist(), ranked))
        pair_of, symbol, n = self.pair_of, symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for at, key in enumerate(((symbols[:-1] << 32) | symbols[1:]).tolist()):
            if found := pair_of.get(key):
                heap.append((found[0], at, key, found[1]))
        heapq.heapify(heap)
        while heap:
            _, at, key, made = heapq.heappop(heap)
            other = after[at]
            if other >= n or symbol[at] < 0 or (symbol[at] << 32) | symbol[other] != key:
                continue  # one of the two has been merged since
            symbol[at], symbol[other] = made, -1
            after[at] = following = after[other]
            if following < n:
                before[following] = at
            for first, second in ((before[at], at), (at, following)):
                if first >= 0 and second < n:
                    key = (symbol[first] << 32) | symbol[second]
                    if found := pair_of.get(key):
                        heapq.heappush(heap, (found[0], first, key, found[1]))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols of all words after the last merge, and their numbers."""
        symbol, lengths = self._symbols(words)
        word = np.repeat(np.arange(len(words)), lengths)
        done_symbol, done_word = [], []
        ends = np.cumsum(lengths)
        for long in np.flatnonzero(lengths > LONG_WORD).tolist():
            merged = self._merge_long(symbol[ends[long] - lengths[long] : ends[long]])
            done_symbol.append(merged)
            done_word.append(np.full(len(merged), long))
        short = np.repeat(lengths <= LONG_WORD, lengths)
        symbol, word = symbol[short], word[short]
        while len(symbol) > 1:
            # The rank of a symbol and its right neighbour in the same word.
            slot = self.pairs.find(symbol[:-1], symbol[1:])
            rank = np.append(np.where(slot < 0, _NONE, self.pairs.rank[slot]), _NONE)
            rank[:-1][word[:-1] != word[1:]] = _NONE
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.append(starts, len(word)))
            active = least < _NONE
            if not active.all():
                keep = np.repeat(active, counts)
                done_symbol.append(symbol[~keep])
                done_word.append(word[~keep])
                symbol, word, rank = symbol[keep], word[keep], rank[keep]
                slot = np.append(slot, -1)[keep]
                least, counts = least[active], counts[active]
                if not len(symbol):
                    break
            chosen = np.flatnonzero(rank == np.repeat(least, counts))
            # Of places that overlap, every second one from the left.
            first = np.append(True, np.diff(chosen) > 1)
            run = np.flatnonzero(first)
            odd = (np.arange(len(chosen)) - np.repeat(run, np.diff(np.append(run, len(chosen))))) & 1
            made = self.pairs.made[slot[chosen]]
            leftmost = np.append(True, np.diff(word[chosen]) > 0)
            chosen_ok = (odd == 0) & (leftmost | ~self._alone_words(made, word[chosen], leftmost))
            at = chosen[chosen_ok]
            symbol[at] = made[chosen_ok]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, word = symbol[stays], word[stays]
        done_symbol.append(symbol)
        done_word.append(word)
        symbol, word = np.concatenate(done_symbol), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.bincount(word, minlength=len(words))

    def _alone_words(self, made, word, leftmost) -> np.ndarray:
        """For every place: does its word have a place whose merge must stand alone?"""
        if not self.alone[made].any():
            return np.zeros(len(made), bool)
        group = np.cumsum(leftmost) - 1
        return np.bincount(group, self.alone[made])[group] > 0

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet."""
        symbol, counts = self.merge(words)
        unknown = np.flatnonzero(symbol >= self.size)
        of_word = np.repeat(np.arange(len(words)), counts)
        if len(unknown):
            # Characters without a piece become their bytes.
            spelled = [
                self.byte_id[list(chr(c - self.size - 1).encode())]
                for c in symbol[unknown].tolist()
            ]
            times = np.ones(len(symbol), np.int64)
            times[unknown] = [len(s) for s in spelled]
            at = np.cumsum(times) - times
            symbol, of_word = np.repeat(symbol, times), np.repeat(of_word, times)
            symbol[ragged(at[unknown], times[unknown])] = np.concatenate(spelled)
            counts = np.bincount(of_word, minlength=len(words))
        begin = len(self.pool) + np.cumsum(counts) - counts
        self.known.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.at = np.append(self.at, begin)
        self.length = np.append(self.length, counts)
        self.pool = np.append(self.pool, symbol.astype(np.int32))
        self.bytes += sum(map(len, words)) + len(words) * ENTRY_BYTES + symbol.nbytes // 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        split = [self.words(text) for text in texts]
        flat = [w for words in split for w in words]
        if len(self.known) > self.known_words or self.bytes > KNOWN_BYTES:
            self._forget()
        if new := list(set(flat) - self.known.keys()):
            self.learn(new)
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = self.length[index]
        ids = self.pool[ragged(self.at[index], lengths)]
        ends = np.append(0, np.cumsum(lengths))
        bounds = np.append(0, np.cumsum([len(words) for words in split], dtype=np.int64))
        return ids, np.diff(ends[bounds])

    # --- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of every list of ids."""
        ids = ids.astype(np.int64)
        lengths = self.surface_len[ids]
        data = self.surface[ragged(self.surface_at[ids], lengths)].tobytes()
        ends = np.append(0, np.cumsum(lengths))
        bounds = np.append(0, np.cumsum(counts))
        texts = []
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            start = int(ends[first])
            head = self._head(ids[first:last])
            if head is not None and self.is_marked[ids[first + head]]:
                start += 1  # the mark before the first word
            raw = data[start : int(ends[last])]
            try:
                texts.append(raw.decode())
            except UnicodeDecodeError:
                texts.append(self._decode_broken(ids[first:last]))
        return texts

    def _head(self, ids: np.ndarray) -> int | None:
        """The place of the first id that has a surface."""
        for k, i in enumerate(ids.tolist()):
            if self.surface_len[i]:
                return k
        return None

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Ids whose byte pieces are no UTF-8: each stray byte becomes U+FFFD."""
        out, run, head = [], bytearray(), self._head(ids)
        for k, i in enumerate([*ids.tolist(), None]):
            if i is not None and self.is_byte[i]:
                run += self.surface[self.surface_at[i] : self.surface_at[i] + 1].tobytes()
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    size = 1
                del run[:size]
            if i is not None:
                at = int(self.surface_at[i]) + int(k == head and self.is_marked[i])
                out.append(
                    self.surface[at : int(self.surface_at[i] + self.surface_len[i])]
                    .tobytes().decode()
                )
        return "".join(out)


_LOADED: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """The model of this Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode_pieces(
    docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text of these ids).

    ``model`` is the path of a BPE model file on every machine.  Null and empty texts
    have no ids and decode to an empty text.  Rows stand for themselves: repeated
    rows and null ids are kept, no rows give no rows, other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            ids, counts = pieces.encode(batch["text"].to_pylist())
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            decoded = pieces.decode(ids, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.array(decoded, pa.string()),
                ],
                ["doc_id", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
