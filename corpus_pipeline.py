"""A corpus pipeline of four stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
back as the next one's docs. All but the last return the columns of `documents`. Rows are told apart
by id and text together; of rows that are equal in both, near-dedup leaves one. Lists of rows to drop are joined as
Spark sees fit: broadcast where their size allows it, sorted and merged beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botlantern.llm.common import bit_filter, clean, filter_bits, named, passing, read_table, shared_folder, small_batches, stored
from botlantern.llm.decontam import contamination
from botlantern.llm.language import fit, has_letter, predicted, unknown
from botlantern.llm.minhash import surplus
from botlantern.llm.packing import packed_digest


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text) is not among `dropped` (doc_id, text_hash, and `first` or not).

    Where `first` is true, one row of that doc_id and text stays: the least by a hash of all columns.
    A bit filter, sized by the list within bounds, tells most rows that stay; only the others meet the list
    in a join, so whole texts are seldom shuffled.
    """
    first = F.col("first") if "first" in dropped.columns else F.lit(False)
    d = stored(dropped.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), first.alias("_first")).distinct(), "dropped")
    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(d.select(F.xxhash64("_id", "_text").alias("hash")), filter_bits(d.count())))
    doc_id, text = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    suspect = passing(F.xxhash64(doc_id, text), bits)
    same = docs["doc_id"].cast("long").eqNullSafe(d["_id"]) & (F.xxhash64(docs["text"].cast("string")) == d["_text"])
    left = docs.where(~suspect).unionAll(docs.where(suspect).join(d, same, "left_anti"))
    firsts = d.where("_first")
    if firsts.isEmpty():
        return left
    # Tasks reduce their own rows first, so the copies of one page do not meet in one task.
    row = F.struct(*[docs[c] for c in docs.columns])
    again = docs.where(suspect).join(firsts, same).groupBy("_id", "_text").agg(F.min_by(row, F.xxhash64(*[docs[c] for c in docs.columns])).alias("_row"))
    return left.unionAll(again.select("_row.*"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: the code of one language at least is shorter than the text's bytes, but for some slack.

    What no language's model codes so is in none of them, or noise, and goes; so do texts that are null
    or have no letter.

    If no language could be learnt (no labelled row that is not held out), none is told, and the text
    alone decides: those that are null or have no letter go.
    """
    small_batches(spark)
    text, model = F.col("text").cast("string"), fit(docs)
    if not model.langs:
        return docs.where(has_letter(text))
    found = predicted(text, model)
    return docs.withColumn("_language", found).where(~unknown(text, F.col("_language"))).drop("_language")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    That is the smallest id's, of a repeated id that of the least text hash, of equal texts one row. A
    row without an id stays only where the whole group has none. Texts without a word stay.
    """
    return _without(docs, surplus(docs, k=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stands in windows of benchmark items."""
    return _without(docs, contamination(docs, read_table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in windows of 4096 tokens."""
    return packed_digest(docs)


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The first stages are no SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, begun = read_table(spark, sf_dir, "documents"), named()
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = shared_folder(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        clean(spark, begun, keep=path)  # what the stage has read and stored
    return docs
