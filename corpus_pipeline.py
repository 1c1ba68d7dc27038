"""Documents to training data, in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of documents. SQL cannot express the trained and encoding stages, so
ORACLE_SQL is None and the tests compare with brute force.

In all stages: other columns of docs are left out, whatever their names; an empty table gives an empty one; a null text counts as
an empty text and stays null; null languages and sources are values like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graniteer.llm import minhash, mixing, pieces, suffixes, toxicity
from graniteer.llm.queries import SHARES
from graniteer.llm.util import crc_of_id, ranked, row_key, staged

ORACLE_SQL = None
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; labels of held-out rows are not learnt.

    Rows without id are scored as others; rows that repeat an id are judged each by its own text; empty texts are clean.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) != 1)
    return toxicity.clean(docs.select(*COLUMNS), model, 0.7)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with row_id: doc_id, or a number after all ids for a text without id and for further texts of an id.

    Rows that agree in doc_id and text agree in row_id, others do not.
    """
    key = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("text_key")
    pairs = docs.select("doc_id", key).distinct()
    several = pairs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    more = pairs.join(several, "doc_id").where("text_key <> first").select("doc_id", "text_key")
    more = staged(more.unionByName(pairs.where("doc_id is null")), "further-texts")
    if not more.take(1):
        return docs.select(*COLUMNS, F.col("doc_id").alias("row_id"))
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("m")).first()["m"]
    own = ranked(more.withColumns({"all": F.lit(0), "__key": row_key(more), "__n": F.lit(1)}), ["all"])
    own = staged(own.select(F.col("doc_id").alias("own_id"), F.col("text_key").alias("own_key"), (F.col("__start") + top + 1).alias("own")), "own-numbers")
    found = docs.select(*COLUMNS, key).join(own, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_key") == F.col("own_key")), "left")
    return found.select(*COLUMNS, F.coalesce("own", "doc_id").alias("row_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, the one with the smallest id stays.

    Rows fold only where doc_id and text agree (the least lang, source and n_chars stay); a text without id, or a further
    text of an id, is a document of its own after all others. Null and empty texts are like nothing else and stay.
    """
    held = numbered(docs)
    gone = minhash.near_duplicates(held, id_col="row_id").where("id <> component_id").select(F.col("id").alias("row_id")).distinct()
    kept = held.join(gone, "row_id", "left_anti")
    return kept.groupBy("row_id").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars", "text")).alias("r")).select("r.*").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 50 and more that start in an earlier document go; every document stays.

    A text without id, or a further text of an id, is a document of its own after all others. Rows that repeat id and
    text are not each other's copies.
    """
    out = suffixes.dedup(numbered(docs), keep=("doc_id", "lang", "source"), id_col="row_id")
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def in_slots(docs: DataFrame) -> DataFrame:
    """Rows with slot and place, in their order; both follow from the rows alone, so every call gives the same."""
    mixed = mixing.mix(docs.select(*COLUMNS), SHARES)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*COLUMNS, "slot", "place")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come out in order of the mixture's slots, none left out: the file order is the decision, which `encode` keeps as columns.

    A null source is a source of its own; rows alike in all columns stay as many as they are; ids do not matter.
    """
    return in_slots(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text in the mixture's order, with a check that decoding gives the text back.

    A scan of the files does not keep their order, so slot and place are found again and kept:
    reading by (slot, place) gives the mixture. A null text has null token_ids, an empty one an empty list; repeated rows
    are encoded each.
    """
    return pieces.encode_rows(in_slots(docs), pieces.Codec.load(), keep=("doc_id", "lang", "source", "slot", "place"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("mixing", mix_sources),
    ("tokens", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return staged(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
