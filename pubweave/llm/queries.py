"""One query per corpus operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pubweave.llm.collocations import mine_collocations
from pubweave.llm.common import new_folder, read_table
from pubweave.llm.decontaminate import find_contamination
from pubweave.llm.exact_dedup import exact_dedup
from pubweave.llm.licenses import scan_licenses
from pubweave.llm.metric_join import metric_join
from pubweave.llm.minhash import minhash_dedup
from pubweave.llm.pieces import encode_pieces
from pubweave.llm.secrets import KINDS, scan_secrets
from pubweave.llm.sharding import shard_documents
from pubweave.llm.spelling import spelling_variants
from pubweave.llm.suffix_dedup import suffix_dedup
from pubweave.llm.toxicity import score_toxicity
from pubweave.llm.token_files import ids_crc32, read_token_files, write_token_files

#: Folder of the public tokenizer files; where it is differs between clusters.
TOKENIZERS = "spark.pubweave.tokenizers"

Query = Callable[[SparkSession, str], DataFrame]

_REGISTRY: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _REGISTRY[function.__name__] = function
    return function


def llm_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """A file of the folder in spark.pubweave.tokenizers, or of the installed package."""
    folder = spark.conf.get(TOKENIZERS, None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = exact_dedup(read_table(spark, sf_dir, "documents"))
    return verdicts.withColumnRenamed("digest", "text_sha256")


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licences of its passages, in order of place."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("found").cast("long").alias("n_passages"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.coalesce(F.round(F.array_max("found.dice"), 6), F.lit(0.0)).alias("best_dice"),
        F.col("found.first_word").alias("first_words"),
    )


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    ).drop("mark")


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans, and a ``live`` span for each whose value looks live; ``spread`` has the
    repositories and owners of every base span's value."""
    found = scan_secrets(read_table(spark, sf_dir, "documents"))

    def joined(spans):
        names = F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        )
        return F.array_join(names, ",")

    spans = F.col("spans")
    listed = F.transform(
        spans, lambda s: F.struct(s["start"], s["order"], s["kind"], s["end"])
    )
    live = F.transform(
        F.filter(spans, lambda s: s["live"]),
        lambda s: F.struct(
            s["start"], (s["order"] + len(KINDS)).alias("order"),
            F.lit("live").alias("kind"), s["end"],
        ),
    )
    return found.select(
        "doc_id",
        *[
            F.size(F.filter(spans, lambda s: s["kind"] == kind))
            .cast("long").alias(f"n_{kind}")
            for kind in KINDS
        ],
        F.sha2(joined(listed), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(listed, live))).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["n_repos"], s["n_owners"])), ","
        ).alias("spread"),
    )


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    )


@_query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-files")
    docs = read_table(spark, sf_dir, "documents")
    write_token_files(docs, folder, tokenizer_path(spark, "byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, folder, ids_crc32, "long").withColumnRenamed(
        "value", "ids_crc32"
    )


@_query
def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(read_table(spark, sf_dir, "documents")).drop("mark")


def span_digests(cut: DataFrame) -> DataFrame:
    """Numbers and digests of what ``suffix_dedup`` returns."""
    sizes = F.transform("spans", lambda s: s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of a repeated string goes, that of its first place, too."""
    return span_digests(suffix_dedup(read_table(spark, sf_dir, "documents"), keep="none"))


def piece_digests(encoded: DataFrame, *keep: str) -> DataFrame:
    """Numbers and digests of the ids and texts that ``encode_pieces`` returns, and the
    columns ``keep`` of it."""
    ids = F.col("ids").cast("array<string>")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids, ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *keep,
    )


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return piece_digests(encode_pieces(docs, tokenizer_path(spark, "piece_bpe_32k.model")))


@_query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(read_table(spark, sf_dir, "documents"))


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


@_query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join(read_table(spark, sf_dir, "documents"))
