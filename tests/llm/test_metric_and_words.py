"""Collocations, spelling variants, the Jaccard join, and cases that ids, hashes and
frequent phrases make hard."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from brute import collocations, contamination, joined_components, shingle_set, spelling
from pyspark.sql import functions as F
from test_corpus_operators import EDGES, LONG, near_rows, prose, table

from pubweave.llm import collocations as phrases, decontaminate, metric_join as metric, spelling as words
from pubweave.llm.collocations import maximal_phrases, mine_collocations
from pubweave.llm.decontaminate import find_contamination
from pubweave.llm.exact_dedup import drop_exact_copies
from pubweave.llm.metric_join import metric_join
from pubweave.llm.minhash import drop_near_copies, minhash_dedup
from pubweave.llm.pieces import Pieces
from pubweave.llm.sharding import pack, shard_documents
from pubweave.llm.shingles import utf8, word_hashes
from pubweave.llm.spelling import decompose, lists_to_merge, spelling_variants
from pubweave.llm.token_files import Encoder, grouped


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, EDGES).limit(0)


def thue_morse(n):
    """A word and its complement, alike to polynomial hashes modulo a power of two."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


# --- collocations -------------------------------------------------------------------


def phrase_rows():
    rng = random.Random(4)
    parts = ["New York", "new york city", "in the", "the", "über alles", "a b c d e f", "a b c d x",
             "x", ".", "!", "\n", " ", "\t", " ", "one\x0btwo", "A", "b", "C d"]
    rows = [
        (rng.choice(["en", "de", None, "und", ""]), " ".join(rng.choices(parts, k=rng.randrange(20))))
        for _ in range(150)
    ]
    return rows + [("en", None), ("en", ""), ("fr", " .,; "), ("xx", "buy now " * 40)] + rows[:5]


@pytest.mark.parametrize("least", [2, 7])
def test_collocations(spark, least):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").select(
        "*", *[F.lit(c).alias(c) for c in ("w1", "id", "word", "n", "f", "phrase", "lang_hash")]
    ).repartition(3)
    found = mine_collocations(docs, least=least)
    assert found.columns[:8] == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert Counter(tuple(r)[:8] for r in found.collect()) == Counter(collocations(rows, least))
    few = mine_collocations(docs, least=least, top=3).collect()
    assert Counter(tuple(r)[:8] for r in few) == Counter(collocations(rows, least, top=3))


def test_collocations_edges(edges, empty):
    assert mine_collocations(empty).count() == 0
    rows = [("en", text) for _, text in EDGES]
    assert Counter(tuple(r)[:8] for r in mine_collocations(edges).collect()) == Counter(
        collocations(rows, 30)
    )
    with pytest.raises(ValueError):
        mine_collocations(edges, least=1)


def test_paths_are_whole_passages(spark):
    passage = [f"p{i}" for i in range(23)]
    rows = [("en", f"q{i % 9} {' '.join(passage)} r{i % 7}.") for i in range(40)]
    rows += [("en", "p5 p6 p7"), ("en", "loop " * 60)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    found = {r.phrase: (r.n_words, r.f) for r in maximal_phrases(docs).collect()}
    # p5 p6 p7 ends a piece once: there the passage does not go on the same way.
    assert found == {
        " ".join(passage[:8]): (8, 40), " ".join(passage[5:]): (18, 40),
        "loop loop loop loop": (4, 57),
    }
    lengths = {r.phrase: r.passage_words for r in mine_collocations(docs).collect()}
    assert lengths["p0 p1 p2 p3"] == 8 and lengths["p6 p7 p8 p9"] == 18


def test_words_that_share_a_number_are_told_apart(spark, monkeypatch):
    real = phrases._word_rows

    def clash(texts, seed):
        rows = real(texts, seed)
        return rows.withColumn("id", F.lit(1).cast("long")) if seed == 0 else rows

    docs = spark.createDataFrame([("en", "a b c d " * 40)], "lang string, text string")
    texts = docs.select("lang", F.xxhash64("lang").alias("lang_hash"), "text")
    monkeypatch.setattr(phrases, "_word_rows", clash)
    counted, seed = phrases.count_words(texts)
    assert seed == 1 and {r.word: r.n for r in counted.collect()} == dict.fromkeys("abcd", 40)


# --- spelling variants ------------------------------------------------------------------


def spelling_rows(n=300):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdeé", k=rng.randrange(7, 13))) for _ in range(25)]
    base += ["aaaaaaa", "aaaaaaaa", "abababab", "ababababa", "naïveté", "Straßen", "x" * 300]
    rows = []
    for i in range(n):
        chosen = []
        for word in rng.choices(base, weights=range(1, len(base) + 1), k=30):
            if rng.random() < 0.15:
                at = rng.randrange(len(word) + 1)
                word = word[:at] + rng.choice(["", "a", "é", "zz"]) + word[at + rng.randrange(2) :]
            chosen.append(word.upper() if rng.random() < 0.2 else word)
        rows.append((i if i % 50 else None, rng.choice([" ", "-", "2", "_"]).join(chosen)))
    return rows + [(n, None), (n + 1, ""), (n + 1, "short words"), rows[3], rows[3]]


@pytest.mark.parametrize("dictionary", [1 << 16, 20])
def test_spelling_variants(spark, monkeypatch, dictionary):
    monkeypatch.setattr(words, "DICTIONARY", dictionary)
    rows = spelling_rows()
    found = Counter(tuple(r) for r in spelling_variants(table(spark, rows)).collect())
    expected = Counter(spelling(rows))
    assert found == expected and sum(form is not None for _, form, *_ in expected) > 5


def test_spelling_edges(spark, edges, empty):
    assert spelling_variants(empty).count() == 0
    assert Counter(tuple(r) for r in spelling_variants(edges).collect()) == Counter(spelling(EDGES))
    # Chains of forms end at their last one.
    rows = [(i, "abcdefgh") for i in range(900)] + [(i, "abcdefgx") for i in range(60)]
    rows += [(i, "abcdefyx") for i in range(3)]
    found = {r.word: r for r in spelling_variants(table(spark, rows)).collect()}
    assert found["abcdefyx"].form == "abcdefgx" and found["abcdefyx"].root == "abcdefgh"
    with pytest.raises(ValueError):
        spelling_variants(edges, least_length=5)


def test_near_words_share_a_list_to_merge():
    rng = random.Random(12)
    for _ in range(3000):
        word = "".join(rng.choices("ab" if rng.random() < 0.5 else "abcdef", k=rng.randrange(7, 15)))
        at, kind = rng.randrange(len(word)), rng.randrange(3)
        letter = "" if kind == 0 and len(word) > 7 else rng.choice("abx")
        other = word[:at] + letter + word[at + (kind < 2) :]
        grams = {(w + "^$")[i : i + n] for w in (word, other) for n in range(3, 6) for i in range(12)}
        padded = [f"^{w}$" for w in (word, other)]
        grams |= {p[i : i + n] for p in padded for n in (3, 4, 5) for i in range(len(p))}
        chosen = {g: rng.randrange(9) for g in grams if rng.random() < 0.7}
        # A frequent gram begins with frequent ones.
        frequent = {g: n for g, n in chosen.items() if all(g[:k] in chosen for k in range(3, len(g)))}
        shorter, longer = sorted((word, other), key=len)
        one, two = (set(lists_to_merge(w, frequent)) for w in (shorter, longer))
        on = range(len(longer) - len(shorter) + 1)
        assert word == other or any((gram, at + k) in two for gram, at in one for k in on)
        assert len(decompose(word, frequent)[0]) == len(word)


# --- Jaccard join -----------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(2048, 128), (8, 4)])
def test_metric_join(spark, monkeypatch, sizes):
    monkeypatch.setattr(metric, "REGION", sizes[0])
    monkeypatch.setattr(metric, "LEAF", sizes[1])
    rng = random.Random(3)
    base = [prose(i, rng.choice([3, 6, 7, 30, 80, 200])) for i in range(25)]
    common = " ".join(f"c{i}" for i in range(30))
    rows = near_rows()
    for i in range(400):
        words_ = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            words_[rng.randrange(len(words_))] = f"z{rng.randrange(50)}"
        if rng.random() < 0.4:
            half = len(words_) // 2
            words_ = words_[:half] + common.split() + words_[half:]
        number = 1000 + i - (rng.randrange(100) if rng.random() < 0.03 else 0)
        rows.append((number, " ".join(words_)))
    found = metric_join(table(spark, rows)).collect()
    assert Counter(tuple(r) for r in found) == Counter(joined_components(rows, 85, 4))


def test_metric_join_edges(edges, empty):
    assert metric_join(empty).count() == 0
    assert Counter(tuple(r) for r in metric_join(edges).collect()) == Counter(
        joined_components(EDGES, 85, 4)
    )


def test_histograms_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for _ in range(300):
        one = rng.integers(0, 1 << 62, rng.integers(1, 400))
        other = np.append(one[: rng.integers(0, len(one) + 1)], rng.integers(0, 1 << 62, rng.integers(0, 80)))
        if not len(other):
            continue
        bins = [np.bincount(s % metric.BINS, minlength=metric.BINS) for s in (one, other)]
        both = len(np.intersect1d(one, other))
        union = len(np.union1d(one, other))
        assert metric.distances(bins[0], bins[1][None])[0] <= 1 - both / union + 1e-9
        if 100 * both >= 85 * union:
            assert metric.may_link(bins[0], bins[1][None], 85)[0]
        packed = pa.array([metric.packed(b) for b in bins], pa.binary())
        assert (metric.unpacked(packed) == np.array(bins)).all()


# --- repeated ids and words that hash alike ---------------------------------------------------


def test_rows_with_one_id_are_one_document(spark):
    rows = [(1, "w"), (1, "v"), (2, "W"), (3, "v"), (4, "u"), (None, "u"), (None, "u"), (4, "u")]
    docs = table(spark, rows)
    near = {(r.doc_id, r.component_id) for r in minhash_dedup(docs).collect()}
    expected = {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)}
    assert near == expected
    assert {(r.doc_id, r.component_id) for r in metric_join(docs).collect()} == expected
    left = sorted((r.doc_id or 0, r.text) for r in drop_near_copies(docs).collect())
    assert len(left) == 3 and left[0] == (0, "u") and left[2] == (4, "u") and left[1][0] == 1


@pytest.mark.parametrize("k", [5])
def test_near_copies_with_repeated_ids(spark, k):
    rng = random.Random(9)
    rows = [(i if rng.random() < 0.9 else rng.randrange(60), t) for i, t in near_rows()]
    rows += [(None, t) for _, t in rows[:20]]
    found = Counter(tuple(r)[:3] for r in minhash_dedup(table(spark, rows)).collect())
    assert found == Counter(joined_components(rows, 75, k))


def test_exact_copies_keep_one_row(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (None, "b"), (None, None), (2, ""), (3, "a")]
    left = drop_exact_copies(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in left) == {(3, "a"): 1, (None, "b"): 1, (2, ""): 1}


def test_words_that_only_differ_in_order_are_different(spark):
    one, other = thue_morse(2048)
    data, offsets = utf8(pa.array([one, other, f"x {one}", one.upper()]))
    hashes, *_ = word_hashes(data, offsets)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[3] == hashes[4]
    docs = table(spark, [(1, one), (2, other), (3, one)])
    for found in (minhash_dedup(docs), metric_join(docs)):
        assert {(r.doc_id, r.component_id) for r in found.collect()} == {(1, 1), (2, 2), (3, 1)}


# --- contamination ----------------------------------------------------------------------


def hashed(text):
    data, offsets = utf8(pa.array([text]))
    return word_hashes(data, offsets, letters_only=True)[0].tolist()


def damaged(rng, words_, share):
    words_ = list(words_)
    for at in rng.sample(range(len(words_)), int(share * len(words_))):
        words_[at] = f"zz{rng.randrange(99)}"
    return words_


@pytest.mark.parametrize("common", [64, 3])
def test_contamination_equals_all_places(spark, monkeypatch, common):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(21)
    template = "which of the following is the best answer to".split()
    items = {}
    for i in range(14):
        body = [f"i{rng.randrange(400)}" for _ in range(rng.choice([5, 9, 14, 20, 34, 300]))]
        items[i] = (template + body) if i % 2 else body
    items[14], items[15] = template, [*template, "x"]
    docs = {}
    for d in range(60):
        words_ = [f"d{rng.randrange(500)}" for _ in range(rng.choice([0, 3, 40, 400]))]
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(16)]
            first = rng.randrange(max(1, len(item) - 40))
            words_ += damaged(rng, item[first : first + 60], rng.choice([0, 0.1, 0.2, 0.3]))
            words_ += [f"d{rng.randrange(500)}" for _ in range(rng.randrange(9))]
        docs[d] = " ".join(words_ + (template if d % 3 == 0 else []))
    texts = {i: " ".join(words_) for i, words_ in items.items()}
    tables = [
        spark.createDataFrame(list(t.items()), f"{name} long, text string")
        for t, name in ((docs, "doc_id"), (texts, "item_id"))
    ]
    found = {(r.doc_id, r.item_id) for r in find_contamination(*tables).collect()}
    seeded, everywhere = contamination(docs, texts, hashed, decontaminate.MASKS)
    assert seeded <= found <= everywhere and len(seeded) > 40


def test_long_items_and_a_phrase_that_all_items_share(spark):
    rng = random.Random(22)
    long_item = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    template = "which one of the following statements about it is right".split()
    items = [(i, " ".join([*template, *(f"t{rng.randrange(9999)}" for _ in range(14))]))
             for i in range(10_000)]
    items.append((10_000, " ".join(long_item)))
    docs = [(i, " ".join([*(f"d{rng.randrange(9999)}" for _ in range(60)),
                          *(template if i % 3 == 0 else []),
                          *(f"d{rng.randrange(9999)}" for _ in range(20))]))
            for i in range(3000)]
    docs[7] = (7, " ".join(["x"] * 30 + damaged(rng, long_item[70_000:70_050], 0.15)))
    docs[9] = (9, " ".join(["x"] * 30 + damaged(rng, items[4321][1].split(), 0.1) + ["y"] * 9))
    found = find_contamination(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(8),
        spark.createDataFrame(items, "item_id long, text string").repartition(8),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(7, 10_000), (9, 4321)}


# --- sharding ------------------------------------------------------------------------------


def test_pack_equals_plain_packing():
    rng = np.random.default_rng(2)
    for _ in range(40):
        vectors = rng.random((rng.integers(1, 60), 3))
        vectors /= vectors.sum(axis=0)
        shards = int(rng.integers(1, 7))
        room = [[1 / shards] * 3 for _ in range(shards)]
        expected = {}
        for i in sorted(range(len(vectors)), key=lambda i: (-max(vectors[i]), i)):
            scores = [sum(a * b for a, b in zip(r, vectors[i])) for r in room]
            for dimensions in (3, 1, 0):
                fit = [s for s in range(shards)
                       if all(room[s][d] >= vectors[i][d] for d in range(dimensions))]
                if fit:
                    break
            expected[i] = best = max(fit, key=lambda s: (scores[s], -s))
            room[best] = [a - b for a, b in zip(room[best], vectors[i])]
        assert pack(vectors, shards).tolist() == [expected[i] for i in range(len(vectors))]


def test_groups_that_fit_stay_whole(spark):
    rng = random.Random(5)
    rows = [(i, f"{i} " + "word " * rng.randrange(20, 60)) for i in range(20_000)]
    rows += [(100_000 + i, "the same text of one group " * 6) for i in range(200)]
    rows += [(None, "no id") for _ in range(50)]
    found = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({r.shard for r in found if r.doc_id and r.doc_id >= 100_000}) == 1
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(abs(s / mean - 1) for s in sizes.values()) < 0.01
    for shard in range(40):
        assert sorted(r.slot for r in found if r.shard == shard) == list(
            range(sum(r.shard == shard for r in found))
        )


# --- tokens and pieces --------------------------------------------------------------------


@pytest.mark.parametrize("known_bytes", [1 << 30, 2000])
def test_token_chunks_equal_library(known_bytes):
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), known_bytes)
    rng = random.Random(1)
    parts = ["the", "der", "a", " ", "  ", "\n", "\n\n", "\t", " \n", "\n ", " ", " ",
             " ", " ", "\x0b", "\x1c", "\x85", "it's", "don't", "42", ".", ",", "!?", "é", "日本",
             "😀", "<|endoftext|>", "_", "word", "\r\n", "'", " 's", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(5000)]
    texts += ["", LONG, "x" * 3000, " " * 50, "\n" * 50]
    for first in range(0, len(texts), 500):
        part = texts[first : first + 500]
        ids, counts = encoder.encode(pa.array(part, pa.string()))
        split = np.split(ids, np.cumsum(counts)[:-1])
        for text, found in zip(part, split):
            assert found.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


class Watched:
    """A tokenizer that keeps the strings it gets in batches."""

    def __init__(self, library):
        self.library, self.seen = library, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.library.encode_batch_fast(texts, **options)


def chunky_texts():
    """20,000 different words, in texts with line feeds, special tokens and white space."""
    rng = random.Random(7)
    ends = ["", ".", ",", "'s", "é", "日本", "😀", "<|endoftext|>", "\u200b", "\u180e"]
    texts = []
    for i in range(200):
        stems = ("".join(rng.choices("abcdefgé", k=9)) for _ in range(100))
        words = [f"{stem}{i}{rng.choice(ends)}" for stem in stems]
        words[9] += "\x85" if i % 8 == 7 else ""
        texts.append(rng.choice([" ", " ", " ", "\n"]).join(words))
    return texts


def test_library_gets_new_chunks_joined_and_once():
    encoder, texts = Encoder(public_tokenizers.path("byte_bpe_50k.json")), chunky_texts()
    library = encoder.tokenizer
    expected = [library.encode(text, add_special_tokens=False).ids for text in texts]
    encoder.tokenizer = watched = Watched(library)
    ids, counts = encoder.encode(pa.array(texts))
    assert [s.tolist() for s in np.split(ids, np.cumsum(counts)[:-1])] == expected
    assert len(watched.seen) < 12_000  # of over 19,000 chunks, a third is not sure to be visible
    watched.seen.clear()
    ids, counts = encoder.encode(pa.array(texts[::-1]))
    assert [s.tolist() for s in np.split(ids, np.cumsum(counts)[:-1])] == expected[::-1]
    assert not watched.seen
    plain = [f"the {'abcdefgh'[i % 8]}{i} word" for i in range(8000)]
    encoder.encode(pa.array(plain))
    assert len(watched.seen) < 400  # 8,000 new chunks


def test_words_are_known_whatever_signs_end_them():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    library = encoder.tokenizer
    encoder.encode(pa.array(["the word ends, don't né 42"]))
    encoder.tokenizer = watched = Watched(library)
    texts = ["the word. ends? don't!? word, né.", "the word!) ends's ends', né<|endoftext|>. 42.-",
             "the word×. 42, word_\n"]
    ids, counts = encoder.encode(pa.array(texts))
    assert [s.tolist() for s in np.split(ids, np.cumsum(counts)[:-1])] == [
        library.encode(text, add_special_tokens=False).ids for text in texts
    ]
    lines = {line.strip() for seen in watched.seen for line in seen.split("\n")}
    assert {"ends's", "né<|endoftext|>.", "word×."} <= lines
    assert not lines & {"word", "word.", "word!)", "word_", "ends?", "ends',", "né.", "42,"}


def test_joined_chunks_that_cannot_be_told_apart_are_encoded_apart():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [text for text in chunky_texts() if "\x85" not in text]
    texts += [text.replace("\x85", "") for text in chunky_texts()]
    expected = [encoder.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    encoder.tokenizer.enable_truncation(60)  # cuts joined strings, no single chunk
    ids, counts = encoder.encode(pa.array(texts))
    assert [s.tolist() for s in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_groups_of_batches_keep_all_rows_in_order():
    batches = [pa.RecordBatch.from_pydict({"n": range(i, i + 10)}) for i in range(0, 95, 10)]
    batches.insert(3, batches[0].slice(0, 0))
    whole = [n for batch in batches for n in batch["n"].to_pylist()]
    for most in (0, 100, 170, 1 << 20):
        groups = list(grouped(iter(batches), most))
        assert [n for group in groups for n in group["n"].to_pylist()] == whole
        assert all(group.nbytes <= max(most, 80) for group in groups)
    assert len(groups) == 1 and not list(grouped(iter([]), 100))


def test_very_long_words():
    import time

    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzé中\x00"
    pieces = Pieces(path)
    for n in (255, 256, 257, 3000, 80_000):
        text = "".join(rng.choices(letters, k=n))
        started = time.perf_counter()
        ids, counts = pieces.encode([text, "a" * n])
        taken = time.perf_counter() - started
        assert [s.tolist() for s in np.split(ids, [counts[0]])] == library.encode([text, "a" * n])
    assert taken < 5  # a second here, with room for slow machines


def test_shingle_sets_are_those_of_the_text():
    assert shingle_set("A b C", 4) == {("a", "b", "c")}
