"""A training corpus from raw documents: quality, near duplicates, repeats, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet
and read again. All but the last return the columns of documents; the last returns packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, packing, simhash, site_quality, suffix_dedup
from tickloom.llm.common import materialize, table

#: SQL can't express the classifier, the fingerprints, the tokenizer or the packing; tests use brute force.
ORACLE_SQL = None


#: Bytes of a string that stage 3 looks for. A passage of more than 50 words is as long in all four
#: languages of the documents (their 50 words take 254 bytes at least, 400 in the mean).
PASSAGE = 240


def _own(docs: DataFrame) -> DataFrame:
    """The columns under names that no operator gives to a column of its own."""
    return docs.select(*(F.col(f"`{c}`").alias(f"own_{c}") for c in docs.columns))


def _back(found: DataFrame, docs: DataFrame, **new) -> DataFrame:
    return found.select(*(new.get(c, F.col(f"`own_{c}`")).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good.

    A null or empty text is judged by its looks, a null source or language is a site of its own, rows that
    repeat an id are judged each, and without labels or documents all that there is stays.
    """
    labels = site_quality.document_labels(spark, sf_dir).withColumnRenamed("doc_id", "own_doc_id")
    judged = site_quality.site_quality(_own(docs), labels, "own_doc_id", "own_text", "own_source", "own_lang")
    return _back(judged.where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that fingerprints or a similarity of 0.8 (shingles of five words) link, that of the smallest id.

    Null, empty and blank texts are one group; of a group without any id, one row stays; of rows that
    repeat the smallest id, one stays.
    """
    return _back(simhash.keep_one(_own(docs), "own_doc_id", "own_text", similarity=0.8), docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of ``PASSAGE`` bytes that start elsewhere too.

    A cut may fall within a character, which then goes as a whole. Texts of which nothing is left go; null,
    empty and shorter texts stay as they are. ``docs`` has the columns of documents; n_chars is counted anew where a text is cut.
    """
    cut = suffix_dedup.remove_repeats(_own(docs), "own_doc_id", "own_text", length=PASSAGE, whole_characters=True)
    touched = F.size("removed_spans") > 0
    text = F.when(touched, F.decode("kept_bytes", "UTF-8")).otherwise(F.col("own_text"))
    cut = cut.where(~touched | (F.octet_length("kept_bytes") > 0)).withColumn("__text", text)
    n_chars = F.when(touched, F.length("__text").cast("long")).otherwise(F.col("own_n_chars"))
    return _back(cut, docs, text=F.col("__text"), n_chars=n_chars)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it.

    Null and empty texts have no words, so their source's rate holds for them too; a null source is one of
    its own; a source without words goes; rows that repeat each other are taken alike.
    """
    return _back(mixing.emit_copies(mixing.mix_sources(_own(docs), "own_doc_id", "own_text", "own_source")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of up to 2048 ids: a row for each piece of a document.

    A null or empty text has just its end id; null ids and rows that repeat each other are packed like others.
    Spark keeps Python workers for later stages, so they give up the tokenizer's pieces here.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, keep=False)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing sources", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
