"""A five-stage corpus pipeline; each stage's result is written as Parquet and read as the next one's documents.

Documents without a recognised language go, then all but one document of each
near-duplicate class, then documents that hold a passage of the benchmark;
personal data get pseudonyms, and what is left is packed into sequences.

Defined results, for all stages: only `doc_id`, `text` and, for the language,
`lang` are read, `n_chars` is kept true, and all other columns go through
whatever their names; an empty table gives an empty result.  Rows that repeat id
and text count as documents of their own, but as copies to the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import scratch
from millrace.llm import decontaminate, jaccard_join, language_id, packing, pii


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language, inferred as op7 does, isn't `und`: texts without a letter (null, empty) go; all go if no document has a `lang` to learn from."""
    scratch.prepare(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.recognised(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; texts without words, null ones too, are no duplicates of anything."""
    scratch.prepare(spark)
    return jaccard_join.deduplicate(docs)


#: Consecutive benchmark words that make a leak.
WINDOW = 13


def _name(docs: DataFrame) -> Column:
    """Tells documents apart, those without an id or with the same one too."""
    return F.struct(docs["doc_id"].cast("string").alias("id"), F.xxhash64(docs["text"]).alias("text"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of WINDOW benchmark words, however long they are.

    Items of fewer words, which a clean text may hold by chance, count where op9's rule does
    (at least 5 % of a document's words).  Texts without words stay.
    """
    scratch.prepare(spark)
    found = decontaminate.search(docs.select(_name(docs).alias("name"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="name", window=WINDOW)
    leaked = F.exists("spans", lambda span: span["words"] >= WINDOW) | decontaminate.contaminated()
    gone = scratch.keep(found.where(leaked).select("name").distinct())
    return docs.join(gone, _name(docs).eqNullSafe(gone["name"]), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; null texts stay null."""
    count = scratch.fresh(docs, "replaced")
    out = pii.pseudonymise(docs, count_col=count)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(count) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(count)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, as `packing.pack` gives them; null and empty texts have their end token."""
    scratch.prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("sequences", sequences),
]
#: Language inference and packing can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.keep(docs)
    return docs
