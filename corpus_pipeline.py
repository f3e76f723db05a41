"""From raw documents to packed training sequences, by operators of waymark.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import bpe, langid, minhash, mixing, packing, substring
from waymark.llm.shared import Columns, heap_given_back, small_or_plain, written
from waymark.scratch import Stage

#: Bits a byte from which a text may be no language that the model knows; equal probabilities would cost 8.
NO_LANGUAGE = 7.0
#: Pieces of text that a Python worker remembers while it packs; the stages before it leave less memory than packing alone has.
WORDS = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or hardly shorter in code than random bytes and
    longer than any text of the language that the statistics were tried on.

    The language found replaces lang.  Statistics come from the rows with a lang
    that are not held out; without any, no language is known and all documents
    go.  A null doc_id is not held out; repeated rows are judged alike.
    """
    heap_given_back(spark)
    model, limits = langid.limited(docs.where(~langid.held_out("doc_id")), least=NO_LANGUAGE)
    own = Columns(docs)
    found = langid.predicted(own.df, model, text=own["text"])
    high = [(k, v) for k, v in limits.items() if v > NO_LANGUAGE]
    found = found.join(small_or_plain(spark.createDataFrame(high, "lang_pred string, most double"), len(high)), "lang_pred", "left")
    short = (F.col("bits_per_byte") < NO_LANGUAGE) | F.coalesce(F.col("bits_per_byte") <= F.col("most"), F.lit(False))
    return own.back(found.where((F.col("lang_pred") != langid.UNKNOWN) & short), lang="lang_pred")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates.

    Rows without a doc_id or without words are in no group and stay; so do all
    rows of a repeated doc_id if one does.
    """
    heap_given_back(spark)
    gone = written(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(small_or_plain(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes word sequences that an earlier document has; documents of which nothing is left go.

    What separates the words that stay is kept, so lines stay lines; a document
    that loses nothing keeps its text as it was.  A null text becomes empty; a row
    without a doc_id loses nothing, and rows that share one take nothing from
    each other.
    """
    heap_given_back(spark)
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats the documents of small sources, none more than four times; every document is used.

    A null source is one of its own, documents without words run once, and rows
    that agree in doc_id, source and text are used alike.
    """
    heap_given_back(spark)
    return mixing.mixed(docs, max_repeats=4)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 2,048; one row a piece.

    A null text is the end id alone; each row is a document of its own, also if
    its doc_id is null or repeated.
    """
    heap_given_back(spark)
    return packing.packed(docs, bpe.public_path("byte_bpe_50k.json"), end=1, table=WORDS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL has no byte-pair encoding and no such language models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each one's result written and read again as the next one's input.

    The tables that a stage wrote for itself go when its result is written; those
    of the last one stay until the driver ends, as its result reads them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Stage(spark) as own:
            docs = own.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
