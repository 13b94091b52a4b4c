"""The registered corpus queries and the pipeline on the smallest sample."""

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
from brute import joined_components, near_components, repeated_bytes, spelling

import __spark_entry__ as contract
from pubweave.llm.oracle import llm_oracles
from pubweave.llm.queries import llm_queries

QUERIES = llm_queries()
COLUMNS = {
    "op1": "doc_id keep_id group_size kept text_sha256",
    "op2": "doc_id licenses",
    "op3": "doc_id item_id",
    "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5": "doc_id size text_crc32 law shard slot grown_shard",
    "op6": "doc_id held_out score predicted",
    "op7": "doc_id start n_tokens ids_crc32",
    "op8": "doc_id n_shingles component_id kept",
    "op9": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11": "lang rank phrase a l r n score",
    "op12": "word form root n n_near form_n",
    "op13": "doc_id n_shingles component_id",
}
#: Queries whose rows are not documents, or not all of them.
OTHERS = {"op3", "op11", "op12"}


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return dict(sorted(map(tuple, rows)))


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    found = {}

    def result(name):
        if name not in found:
            (query,) = [q for n, q in QUERIES.items() if n.startswith(f"{name}_")]
            found[name] = query(spark, sf_dir).collect()
        return found[name]

    return result


def test_everything_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())
    assert set(llm_oracles()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(results, texts, name):
    rows = results(name)
    assert set(COLUMNS[name].split()) <= set(rows[0].__fields__)
    if name not in OTHERS:
        assert sorted(r.doc_id for r in rows) == list(texts)
    elif name == "op3":
        assert {r.doc_id for r in rows} <= set(texts)


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_query_equals_oracle(results, sf_dir, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    answer = connection.execute(llm_oracles()[name])
    columns = [c[0] for c in answer.description]
    rows = results(name.split("_")[0])
    assert sorted(columns) == sorted(rows[0].__fields__)
    assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(answer.fetchall())


def test_near_copies_and_repeats_equal_brute_force(results, texts):
    ids, values = list(texts), list(texts.values())
    label, sizes = near_components(values)
    assert {(r.doc_id, r.component_id, r.n_shingles) for r in results("op8")} == {
        (ids[i], ids[label[i]], sizes[i]) for i in range(len(ids))
    }
    gone = dict(zip(ids, repeated_bytes(values, 200)))
    for r in results("op9"):
        assert r.n_removed == len(gone[r.doc_id])
        assert r.n_spans == sum(
            i - 1 not in set(gone[r.doc_id]) for i in gone[r.doc_id]
        )


def test_words_and_joins_equal_brute_force(results, texts):
    rows = list(texts.items())
    assert Counter(tuple(r) for r in results("op12")) == Counter(spelling(rows))
    assert Counter(tuple(r) for r in results("op13")) == Counter(joined_components(rows, 85, 4))


def test_pipeline(spark):
    import sentencepiece

    sf_dir = "/root/testdata/sf0.01"  # the smallest sample has too few labels
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = dict(map(tuple, docs.collect()))
    scores = QUERIES["op6_toxicity"](spark, sf_dir).filter("predicted = 1")
    toxic = {r.doc_id for r in scores.collect()}
    leaks = {r.doc_id for r in QUERIES["op3_decontamination"](spark, sf_dir).collect()}
    assert toxic and leaks
    groups = defaultdict(list)
    for i, text in texts.items():
        if i not in toxic:
            groups[text].append(i)
    kept = sorted(max(ids) for ids in groups.values())
    label, _ = near_components([texts[i] for i in kept])
    left = [i for n, i in enumerate(kept) if label[n] == n and i not in leaks]
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model")
    )
    expected = set()
    for i in left:
        ids = library.encode(texts[i])
        digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        expected.add((i, len(ids), digest))
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in found} == expected
    assert len(found) == len(left)
