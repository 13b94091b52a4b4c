"""Corpus operators on small tables: edge rows and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from brute import near_components, repeated_bytes
from pyspark.sql import functions as F

from pubweave.llm import graph, minhash, sharding, suffix_dedup as suffix
from pubweave.llm.decontaminate import drop_contaminated, find_contamination
from pubweave.llm.exact_dedup import drop_exact_copies, exact_dedup
from pubweave.llm.licenses import (
    NOTICES, Templates, _hash_words, _respelled, bigrams, scan_licenses,
)
from pubweave.llm.minhash import drop_near_copies, minhash_dedup
from pubweave.llm.pieces import Pieces, encode_pieces
from pubweave.llm.secrets import scan_secrets
from pubweave.llm.suffix_dedup import suffix_dedup
from pubweave.llm.token_files import ids_crc32, read_token_files, write_token_files
from pubweave.llm.toxicity import (
    LOOKALIKES, Model, Scorer, decode, drop_toxic, learn, score_toxicity, symbol_of, trigram_logs, weigh,
)

#: Names that operators use inside; a table may have columns of the same names.
CLASHES = ["digest", "keep_id", "n", "row", "rep", "key", "k1", "hash", "size", "unit", "__k"]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


LONG = prose(1, 30_000)
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Ünï €😀 cödé"), (6, LONG),
    (7, LONG), (None, "no id"), (None, None), (8, prose(2, 60)), (8, prose(2, 60)),
    (9, "one"), (10, prose(2, 60) + " end"), (-5, prose(3, 80)),
]


def table(spark, rows):
    """Rows of (doc_id, text) with further columns, some of clashing names."""
    extra = [F.lit(f"x{c}").alias(c) for c in CLASHES]
    return spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"),
        F.concat(F.lit("src"), F.col("doc_id") % 3).alias("source"), *extra,
    ).repartition(3)


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES)


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, EDGES).limit(0)


def sample(spark, name="documents"):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


# --- exact copies ---------------------------------------------------------------


def by_text(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return groups


@pytest.mark.parametrize("digest", [None, lambda text: (F.length(text) % 2).cast("string")])
def test_exact_dedup(edges, digest):
    options = {"digest": digest} if digest else {}
    found = exact_dedup(edges, salts=2, **options)
    groups = by_text(EDGES)
    expected = Counter()
    for i, text in EDGES:
        ids = [x for x in groups[text or ""] if x is not None]
        keep = max(ids, default=None)
        expected[i, keep, len(groups[text or ""]), i == keep] += 1
    assert Counter(
        (r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()
    ) == expected


def test_exact_dedup_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"text {i}") for i in range(3000)]
    found = {r.doc_id: r for r in exact_dedup(table(spark, rows)).collect()}
    assert len(found) == 3000
    assert {found[i].keep_id for i, t in rows if t == "same"} == {2999}
    assert sum(r.kept for r in found.values()) == 1001


def test_drop_exact_copies(edges, empty):
    left = drop_exact_copies(edges)
    assert left.columns == edges.columns
    texts = Counter(t or "" for t in (r.text for r in left.collect()))
    assert set(texts) == set(by_text(EDGES))
    # Of rows that repeat an id and its text, one stays.
    assert set(texts.values()) == {1}
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0


# --- licences -------------------------------------------------------------------


def test_licenses(spark, edges, empty):
    rows = [
        (1, "Foo bar.\nReleased under the MIT License.\nMore."),
        (2, "x " * 50 + "This work is LICENCED under the GNU General Public License, version 3!"),
        (3, "Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0."),
        (4, "Released under the moon and the sun."),
        (5, None),
        (6, LONG + " Licensed under the Apache License, Version 2.0. " + LONG),
    ]
    found = {
        r.doc_id: [(f.license, round(f.dice, 3)) for f in r.found]
        for r in scan_licenses(table(spark, rows)).collect()
    }
    assert found[1] == [("MIT", 1.0)] and found[2] == [("GPL-3.0", 1.0)]
    assert found[3] == [("CC-BY-NC-4.0", 1.0), ("CC-BY-4.0", 1.0)]
    assert found[4] == [] and found[5] == [] and found[6] == [("Apache-2.0", 1.0)]
    assert scan_licenses(edges).count() == len(EDGES) and scan_licenses(empty).count() == 0


def test_license_windows_equal_brute_force():
    rng = random.Random(5)
    for _ in range(40):
        template = [rng.randrange(12) for _ in range(rng.randrange(2, 12))]
        text = [rng.randrange(12) for _ in range(40)]
        known = Templates({}, 75)
        numbers = np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        known.names = ["t"]
        known.sets = [set(bigrams(numbers[template]).tolist())]
        known.of = {g: [0] for g in known.sets[0]}
        known.table[[g >> 44 for g in known.of]] = True
        grams = bigrams(numbers[text])
        best, size = 0.0, len(known.sets[0])
        for i in range(len(grams)):
            for j in range(i, len(grams)):
                shared = len(set(grams[i : j + 1].tolist()) & known.sets[0])
                best = max(best, 2 * shared / (j - i + 1 + size))
        found = known.best_windows(grams)
        assert bool(found) == (best >= 0.75)
        assert not found or max(f[0] for f in found) == pytest.approx(best)


def every_window(known, grams, similarity=75):
    """What best_windows finds, from the coefficients of all windows."""
    found = []
    for number, template in enumerate(known.sets):
        ends = [i for i, g in enumerate(grams.tolist()) if g in template]
        for i in ends:
            for j in ends:
                own = set(grams[i : j + 1].tolist())
                if own and 200 * len(own & template) >= similarity * (len(own) + len(template)):
                    score = 2 * len(own & template) / (len(own) + len(template))
                    found.append((score, number, i, j))
    chosen = []
    for one in sorted(found, key=lambda f: (-f[0], f[2] - f[3], f[2], f[1])):
        if all(one[3] < other[2] or one[2] > other[3] for other in chosen):
            chosen.append(one)
    return sorted(chosen, key=lambda f: f[2])


def test_license_windows_compare_sets():
    rng = random.Random(7)
    for kinds in (2, 3, 4, 6, 12):
        for _ in range(60):
            known = Templates({}, 75)
            numbers = np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for number in range(2):
                template = [rng.randrange(kinds) for _ in range(rng.randrange(2, 12))]
                known.sets.append(set(bigrams(numbers[template]).tolist()))
                for gram in known.sets[number]:
                    known.of.setdefault(gram, []).append(number)
                    known.table[gram >> 44] = True
            grams = bigrams(numbers[[rng.randrange(kinds) for _ in range(rng.randrange(60))]])
            assert known.best_windows(grams) == every_window(known, grams)


def grams_of(text):
    (words,) = _hash_words([text])
    return bigrams(_respelled(words))


def test_license_headers_get_their_own_names():
    known = Templates(NOTICES, 75)
    gnu = (
        "This program is free software{0} you can redistribute it and/or modify it under the"
        " terms of the GNU {1}General Public License as published by the Free Software"
        " Foundation{0} either version {2} of the License, or (at your option) any later"
        " version. This program is distributed in the hope that it will be useful, but WITHOUT"
        " ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A"
        " PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You"
        " should have received a copy of the GNU {1}General Public License along with this"
        " program."
    )
    bsd = NOTICES["BSD-3-Clause"][1]
    cases = {
        gnu.format(";", "", "2"): "GPL-2.0", gnu.format(":", "", "3"): "GPL-3.0",
        gnu.format(":", "Affero ", "3"): "AGPL-3.0", gnu.format(":", "Lesser ", "3"): "LGPL-3.0",
        gnu.format(";", "Lesser ", "2.1"): "LGPL-2.1", gnu.format(";", "Library ", "2"): "LGPL-2.0",
        bsd: "BSD-3-Clause", bsd[: bsd.index(" 3. Neither")]: "BSD-2-Clause",
    }
    for text, name in cases.items():
        (found,) = known.best_windows(grams_of(text))
        assert known.names[found[1]] == name


def test_license_templates_match_themselves():
    known = Templates(NOTICES, 75)
    for name, texts in NOTICES.items():
        for text in texts:
            (found,) = known.best_windows(grams_of(f"foo bar {text} baz qux"))
            assert (known.names[found[1]], found[0]) == (name, 1.0), text
    # 60 of the 75 different bigrams of the Apache notice are left, among 76.
    words = NOTICES["Apache-2.0"][2].split()
    for at in range(4, len(words), 9):
        words[at] = f"other{at}"
    (found,) = known.best_windows(grams_of(" ".join(words)))
    assert found[0] == 2 * 60 / (76 + 75)
    # A text that repeats itself is looked through once.
    assert known.best_windows(grams_of("under the License " * 30_000)) == []


# --- contamination ----------------------------------------------------------------


def replaced(text, share, seed):
    words, rng = text.split(), random.Random(seed)
    for at in rng.sample(range(len(words)), int(len(words) * share)):
        words[at] = f"other{at}"
    return " ".join(words)


def test_contamination(spark, edges, empty):
    item, short = prose(11, 40), prose(12, 14)
    items = spark.createDataFrame(
        [(1, item), (2, short), (3, item), (4, None), (5, "a b c")],
        "item_id long, text string",
    )
    around = prose(20, 100)
    rows = [
        (1, f"{around} {item} {around}"),
        (2, f"{around} {replaced(item, 0.2, 1)}, {around}"),
        (3, f"{replaced(short, 0.2, 2).upper()}; {around}"),
        (4, around),
        (5, f"{around} {replaced(item, 0.6, 3)} {around}"),
        (6, " ".join(item.split()[:12]) + around),
        (7, f"{item} {short} {item}"),
        (8, None), (9, ""), (None, short), (None, around), (1, around),
    ]
    found = find_contamination(table(spark, rows), items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {
        (1, 1), (2, 1), (3, 2), (7, 1), (7, 2), (None, 2)
    }
    left = drop_contaminated(table(spark, rows), items)
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 4, 5, 6, 8, 9]
    assert left.columns == edges.columns
    assert find_contamination(edges, items.limit(0)).count() == 0
    assert find_contamination(empty, items).count() == 0


# --- secrets ---------------------------------------------------------------------

KINDS = {
    "assign": (re.compile(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.I | re.A), 2, 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile("[0-9a-f]+"), 0, 32),
}


def test_secrets(spark, edges, empty):
    key, shared = "AKIA" + "Q7" * 8, "0123456789abcdef" * 2
    rows = [
        (1, f'é😀 Password = "hunter2hunter2" token:short {key}{key} x {shared}'),
        (2, f"API_KEY='{shared}' secret:token:abcdefghij {shared}z{shared}"),
        (3, f"token={shared}"), (4, "AKIAQ7 deadbeef"), (5, None), (6, ""),
        (7, "apikey=abc.DEF/12345 " * 3), (None, f"token={shared}"),
    ]
    docs = table(spark, rows)
    for r in scan_secrets(docs).collect():
        text = dict(rows)[r.doc_id] or ""
        expected = [
            (m.start(), list(KINDS).index(kind), m.end(), kind)
            for kind, (pattern, group, least) in KINDS.items()
            for m in pattern.finditer(text) if len(m.group(group)) >= least
        ]
        assert [(s.start, s.order, s.end, s.kind) for s in r.spans] == sorted(expected)
        for span in r.spans:
            value = text[span.start : span.end]
            assert span.live == (shared not in value or len(value) > 60)
    assert scan_secrets(edges).count() == len(EDGES) and scan_secrets(empty).count() == 0


# --- sharding ---------------------------------------------------------------------


def check_shards(rows, found, n_shards, tolerance):
    assert len(found) == len(rows)
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    bytes_of = Counter()
    for r in found:
        bytes_of[r.shard] += r.size
    assert max(bytes_of.values()) <= tolerance * sum(bytes_of.values()) / n_shards


def test_sharding(spark, edges, empty, monkeypatch):
    monkeypatch.setattr(sharding, "NUMBERED_ROWS", 100)
    rng = random.Random(4)
    rows = [(i, prose(i % 700, rng.randrange(5, 60))) for i in range(1500)]
    rows += [(i, "hot") for i in range(1500, 2200)]
    found = sharding.shard_documents(table(spark, rows), n_shards=8).collect()
    check_shards(rows, found, 8, 1.03)
    texts, shards = dict(rows), defaultdict(set)
    for r in found:
        text = texts[r.doc_id]
        assert r.size == len(text.encode()) + 16
        assert r.text_crc32 == zlib.crc32(text.encode())
        shards[text].add(r.shard)
    assert all(len(s) == 1 for text, s in shards.items() if text != "hot")
    assert len(shards["hot"]) > 1  # a group larger than a shard cannot stay in one
    found = sharding.shard_documents(edges, n_shards=4).collect()
    check_shards(EDGES, found, 4, 4)
    assert sharding.shard_documents(empty).count() == 0


# --- toxicity ---------------------------------------------------------------------


def small_model():
    counts = np.zeros((28, 28, 28))
    for word in ["idiot", "stupid", "moron", "loser", "the", "is", "an", "such", "you"] * 9:
        symbols = [0, 0, *map(symbol_of, word), 0]
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            counts[a, b, c] += 1
    evidence = {f"{w}$": 0.9 for w in ("idiot", "stupid", "moron", "loser")}
    return Model(evidence, trigram_logs(counts))


def test_disguised_words():
    model = small_model()
    for token in ("1d10t", "idiooot", "IDIOT".lower(), "idi0t"):
        assert decode(token, model.logs) == "idiot"
    assert decode("l.0.s.e.r", model.logs, spread=True) == "loser"
    scorer = Scorer(model)
    for text in ("you 1d10t", "such a L0SER!", "an i d i o t", "s-t-u-p-i-d", "m0r0n.",
                 "is stuuupid", "iddiot", "a i d i o t is"):
        assert scorer.score(text) >= 0.7, text
    for text in ("", "the is an", "1234 0x1d 10", "a b c d e f", "mail8", "losers"):
        assert scorer.score(text) < 0.7, text


def test_gate_drops_no_word_with_evidence(monkeypatch):
    rng, model = random.Random(9), small_model()
    marks = {x: [m for m, letters in LOOKALIKES.items() if x in letters] for x in "idotsuplerm"}
    tokens = ["_1d10t_", "foo_1d10t", "x²1d10t", "a_b_st00pid", "٣m0r0n"]
    for _ in range(3000):
        word = rng.choice(["idiot", "stupid", "moron", "loser", "such", "list"])
        letters = [rng.choice([x, x, *marks.get(x, [])]) * rng.choice([1, 1, 1, 2, 3]) for x in word]
        before, after = (rng.choice(["", "", "_", "__", "foo_", "x²", "٣", "4_", "é"]) for _ in "ab")
        tokens.append(before + "".join(letters) + after)
    gated = Scorer(model)
    found = [gated.of_token(token) for token in tokens]
    monkeypatch.setattr(Scorer, "could_be_strong", lambda self, form: True)
    ungated = Scorer(model)
    assert found == [ungated.of_token(token) for token in tokens]
    assert found[:3] == [0.9] * 3


def test_toxicity(spark, edges, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(i, 40).split()
        if toxic:
            for at in range(0, 40, 9):
                words[at] = rng.choice(["idiot", "stupid", "moron"])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, "what a 1d10t"), (901, None), (None, "stupid m0r0n"), (902, "")]
    given = spark.createDataFrame(
        [*labels, (901, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    docs = table(spark, rows)
    found = {r.doc_id: r for r in score_toxicity(docs, given).collect()}
    assert len(found) == len(rows)
    for i in range(900):
        assert found[i].predicted == int(i % 4 == 0)
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert found[900].predicted == 1 and found[None].predicted == 1
    assert found[901].score == 0 and found[902].score == 0
    left = drop_toxic(docs, given)
    assert left.columns == docs.columns and left.count() == 675 + 2
    # Labels of rows held out are never read.
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = given.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in score_toxicity(docs, flipped).collect()} == {
        i: r.score for i, r in found.items()
    }
    assert score_toxicity(empty, given).count() == 0
    assert {r.score for r in score_toxicity(edges, given.limit(0)).collect()} == {0.0}


def test_beginnings_count_without_their_words():
    hits = {"loser$": 100, "lose": 110, "idiot$": 90, "idio": 90, "vequ": 80, "dull": 5}
    found = weigh(hits, {"lose": 20, "dull": 50})
    assert set(found) == {"loser$", "idiot$", "idio", "vequ"}


def test_learning_ignores_copies(spark):
    """A rare word of one much copied toxic document is no evidence."""
    copy = prose(1, 60) + " rareword"
    rows = [(i, f"{copy} {i}") for i in range(40)]
    rows += [(100 + i, prose(i, 50) + " idiot") for i in range(40)]
    rows += [(200 + i, prose(i + 500, 50)) for i in range(100)]
    labels = spark.createDataFrame(
        [(i, int(i < 200)) for i, _ in rows], "doc_id long, toxic int"
    )
    evidence = learn(table(spark, rows), labels).evidence
    assert "idiot$" in evidence and "rareword$" not in evidence


# --- token files --------------------------------------------------------------------


def test_token_files(spark, edges, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rng = random.Random(1)
    parts = ["a", "th", " ", "  ", "\n", "\t", "é", "😀", "<|endoftext|>", "'s", "23", "The ",
             " \n", " ", "\x1c", "."]
    rows = EDGES + [
        (100 + i, "".join(rng.choices(parts, k=rng.randrange(25)))) for i in range(300)
    ]
    folder = str(tmp_path / "tokens")
    write_token_files(table(spark, rows), folder, path, end_id=2)
    found = read_token_files(spark, folder).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for i, text in ordered:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        expected.append((i, start, len(ids), ids))
        start += len(ids)
    assert sorted(
        ((r.doc_id, r.start, r.n_tokens, r.value) for r in found), key=lambda r: r[1]
    ) == expected
    sums = read_token_files(spark, folder, ids_crc32, "long").collect()
    assert {(r.start, r.value) for r in sums} == {
        (s, zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, _, ids in expected
    }
    write_token_files(empty, str(tmp_path / "none"), path, end_id=2)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


# --- near copies --------------------------------------------------------------------


def near_rows():
    """Groups of near copies, chains, short texts, and texts that share a part."""
    rng, rows = random.Random(2), []
    for group in range(12):
        base = prose(group, 60).split()
        for _ in range(6):
            words = list(base)
            for at in rng.sample(range(60), rng.randrange(0, 5)):
                words[at] = rng.choice(["X", "y", "Zed"])
            rows.append(" ".join(words))
    chain = prose(50, 120).split()
    rows += [" ".join(chain[i : i + 60]) for i in range(0, 60, 4)]
    shared = prose(60, 40)
    rows += [f"{shared} {prose(100 + i, 20)}" for i in range(30)]
    rows += ["a b c", "A  b\nc", "a b", "a b c d e", "", None, "A B C D E f", LONG, LONG + " x"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 3])
def test_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    label, sizes = near_components([t for _, t in rows])
    found = {r.doc_id: r for r in minhash_dedup(table(spark, rows)).collect()}
    for i, _ in rows:
        assert (found[i].component_id, found[i].n_shingles) == (label[i], sizes[i])
        assert found[i].kept == (label[i] == i)


def test_near_copies_edges(edges, empty):
    found = Counter((r.doc_id, r.component_id, r.kept) for r in minhash_dedup(edges).collect())
    assert found == Counter({
        (1, 1, True): 1, (2, 2, True): 1, (3, 3, True): 1, (4, 4, True): 1, (5, 5, True): 1,
        (6, 6, True): 1, (7, 6, False): 1, (None, None, True): 2, (8, 8, True): 2,
        (9, 4, False): 1, (10, 8, False): 1, (-5, -5, True): 1,
    })
    left = drop_near_copies(edges)
    # Three near copies go, and one of the rows that repeat an id and its text.
    assert left.columns == edges.columns and left.count() == len(EDGES) - 4
    assert minhash_dedup(empty).count() == 0


@pytest.mark.parametrize("few", [100_000, 0])
def test_components_of_long_chain(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW_LINKS", few)
    chain = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 201), (7, 3), (5, 5)]
    links = spark.createDataFrame(chain, "a long, b long")
    found = {r.id: r.component for r in graph.components(links).collect()}
    assert found == {i: 0 for i in range(101)} | {200: 200, 201: 200, 300: 200}


# --- repeated strings ------------------------------------------------------------------


def repeat_rows():
    rng = random.Random(6)
    parts = [prose(70 + i, 6) for i in range(8)]
    rows = []
    for i in range(40):
        chosen = rng.choices(parts, k=rng.randrange(1, 4)) + [prose(900 + i, rng.randrange(8))]
        rng.shuffle(chosen)
        rows.append(rng.choice(["", "é", "--"]).join(chosen))
    rows += ["a" * 300, "ab" * 90, "a" * 30, None, "", "ééé" * 20, rows[3], rows[3]]
    return list(enumerate(rows))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [100_000, 1])
def test_repeated_strings(spark, keep, hot):
    rows = repeat_rows()
    expected = repeated_bytes([t for _, t in rows], 40, keep == "first")
    docs = table(spark, rows)
    found = suffix_dedup(docs, length=40, gram=10, keep=keep, hot_contexts=hot).collect()
    assert len(found) == len(rows)
    for r in found:
        data, gone = (rows[r.doc_id][1] or "").encode(), set(expected[r.doc_id])
        assert bytes(r.kept) == bytes(b for i, b in enumerate(data) if i not in gone)
        assert [i for s in r.spans for i in range(s.start, s.end)] == sorted(gone)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_strings_large_buckets(spark, keep, monkeypatch):
    """A few long contexts of one bucket are not put into one suffix order."""
    halves = {}

    def spied(name):
        real = getattr(suffix, name)

        def spy(contexts, *rest):
            halves[name] = contexts
            return real(contexts, *rest)

        monkeypatch.setattr(suffix, name, spy)

    spied("_by_suffix_order")
    spied("_by_window")
    monkeypatch.setattr(suffix, "STRETCH_WINDOWS", 64)
    texts = ["a" * (900 + 37 * i) for i in range(6)] + ["abc" * (250 + i) for i in range(4)]
    rows = [*repeat_rows(), *enumerate(texts, 1000)]
    expected = dict(zip(
        [i for i, _ in rows], repeated_bytes([t for _, t in rows], 40, keep == "first")
    ))
    # A row that repeats an id and its text counts as one place.
    docs = table(spark, [*rows, rows[-1]])
    found = suffix_dedup(docs, length=40, gram=10, keep=keep, hot_bytes=2000).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert [i for s in r.spans for i in range(s.start, s.end)] == expected[r.doc_id]
    ordered, windows = Counter(), 0
    for r in halves["_by_suffix_order"].collect():
        ordered[r.bucket] += len(r.bytes)
    for r in halves["_by_window"].collect():
        assert r.windows <= 64 and len(r.bytes) == r.windows + 39
        windows += r.windows
    assert ordered and max(ordered.values()) <= 2000 and windows > 5000


def test_repeated_contexts_come_once():
    names = ["bucket", "k1", "k2", "start"]
    batches = [
        pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
        for rows in ([(1, 1, 1, 0)] * 3 + [(1, 1, 1, 5)], [(1, 1, 1, 5)] * 2 + [(2, 1, 1, 5)])
    ]
    found = [tuple(r.values()) for b in suffix._distinct_contexts(iter(batches))
             for r in b.to_pylist()]
    assert found == [(1, 1, 1, 0), (1, 1, 1, 5), (2, 1, 1, 5)]


def test_repeated_strings_edges(edges, empty):
    found = suffix_dedup(edges, keep="none").collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in EDGES)
    removed = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in found}
    assert removed[6] == removed[7] == len(LONG) and removed[8] == len(prose(2, 60))
    assert removed[10] == len(prose(2, 60)) and removed[-5] == removed[1] == 0
    assert suffix_dedup(empty).count() == 0


# --- pieces ------------------------------------------------------------------------------


def test_pieces_equal_library(spark, edges, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    parts = ["a", "b", "th", " ", "  ", "▁", "\n", "\t", "é", "😀", "<s>", "<0x41>", "aaaa",
             " " * 8, "1", "23", "\x00", "中", "...", "The ", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(3000)]
    texts += ["", " ", "  ", " a", "a ", "▁", "▁▁a", " " * 37 + "x", "x" * 5000, LONG]
    pieces = Pieces(path, known_words=2000)
    for first in range(0, len(texts), 400):
        part = texts[first : first + 400]
        ids, counts = pieces.encode(part)
        split = np.split(ids, np.cumsum(counts)[:-1])
        expected = library.encode(part, num_threads=1)
        assert [s.tolist() for s in split] == expected
        assert pieces.decode(ids, counts) == library.decode(expected)
    broken = [[rng.randrange(32000) for _ in range(rng.randrange(12))] for _ in range(500)]
    broken += [[rng.randrange(262) for _ in range(rng.randrange(12))] for _ in range(500)]
    flat = np.array([i for ids in broken for i in ids])
    assert pieces.decode(flat, np.array([len(b) for b in broken])) == library.decode(broken)

    found = encode_pieces(edges, path).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in EDGES)
    for r in found:
        if r.doc_id is not None:
            text = dict(EDGES)[r.doc_id] or ""
            assert (r.ids, r.decoded) == (library.encode(text), text)
    assert encode_pieces(empty, path).count() == 0


def test_sha_of_ids(spark):
    from pubweave.llm.queries import piece_digests

    path = public_tokenizers.path("piece_bpe_32k.model")
    row = piece_digests(encode_pieces(table(spark, [(1, "a b"), (2, None)]), path)).orderBy("doc_id")
    one, two = row.collect()
    ids = encode_pieces(table(spark, [(1, "a b")]), path).first().ids
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert two.n_tokens == 0 and two.ids_sha256 == hashlib.sha256(b"").hexdigest()
