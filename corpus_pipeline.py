"""A training corpus from `documents`: toxic texts out, near-duplicates down to one, repeated passages cut, sources
mixed to their weights, texts encoded to pieces. Each stage is written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatt.llm.common import materialize, small_batches, table
from tidewatt.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic."""
    from tidewatt.llm.toxicity import chain_for, score

    chain = chain_for(docs, table(spark, sf_dir, "labels"))
    return score(docs, chain).where(~F.col("is_toxic")).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more."""
    from tidewatt.llm.nearcopies import without_near_copies

    return without_near_copies(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes or more that another place has too."""
    from tidewatt.llm.repeats import texts_without_repeats

    cut = texts_without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each epoch that takes words of it."""
    from tidewatt.llm.mixing import mix, mixed_texts

    mixed = mixed_texts(docs.select(*COLUMNS), mix(docs))
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces, ids_crc32 and round_trip of every document of the mix."""
    from tidewatt.llm.unigram import encode, load_pieces

    coded = encode(docs, load_pieces(tokenizer_file("piece_bpe_32k.model")), keep=["source"])
    return coded.select("doc_id", "source", "ids", "n_pieces", "ids_crc32", "round_trip")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stage, with whole texts sent to Python workers in batches of bounded rows."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", in_small_batches(drop_toxic)),
    ("near_duplicates", in_small_batches(one_of_near_copies)),
    ("repeated_passages", in_small_batches(cut_repeats)),
    ("mix", in_small_batches(mix_sources)),
    ("pieces", in_small_batches(encode_pieces)),
]

#: A trained classifier and a Viterbi search are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
