"""Training-data pipeline: score, deduplicate, decontaminate, redact and pack a table of documents.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it has kept.  All but the last
return the columns of ``docs``; extra columns travel along.  Stages that filter decide by their operator alone, so an
empty table, a null or empty text and a null id pass them: such rows are not toxic, alike or contaminated.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldgrid.llm import decontamination, neardup, packing, secrets, toxicity
from fieldgrid.llm.common import prepare, shared_folder, table, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labels outside the held-out fifth, gives less than one half.

    Without any labelled row there is nothing to judge by and all documents stay, as do those without words always.
    """
    prepare(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out()))
    if model.rows == 0:
        return docs
    return toxicity.score(docs, model, into="_toxic", words_into="_words").where("_toxic < 0.5 OR _words = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component, of least id; of rows that repeat an id and text, one.

    Rows without words are linked with nothing and stay.  Ids name rows unless they are null or repeated: such rows are
    told apart by their texts.
    """
    prepare(spark)
    found = neardup.judged(docs)
    gone = found.where("NOT chosen AND doc_id IS NOT NULL").select("doc_id").distinct()
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id")
    repeated, nameless = not twice.isEmpty(), not found.where("doc_id IS NULL").isEmpty()
    named = docs.where("doc_id IS NOT NULL")
    kept = (named.join(twice, "doc_id", "left_anti") if repeated else named).join(gone, "doc_id", "left_anti").select(*docs.columns)
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    if repeated:
        mine = found.where("chosen").join(twice, "doc_id", "left_semi").select("doc_id", "_text").distinct()
        again = hashed.join(mine, ["doc_id", "_text"], "left_semi").dropDuplicates(["doc_id", "_text"])
        kept = kept.unionByName(again.select(*docs.columns))
    if nameless:
        words = F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
        mine = found.where("chosen AND doc_id IS NULL AND n > 0").select("_text").distinct()
        one = hashed.where(F.col("doc_id").isNull() & words).join(mine, "_text", "left_semi").dropDuplicates(["_text"])
        kept = kept.unionByName(one.select(*docs.columns)).unionByName(docs.where(F.col("doc_id").isNull() & ~words))
    return kept


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than a twentieth lies in benchmark windows."""
    prepare(spark)
    found = decontamination.find_items(docs, table(spark, sf_dir, "benchmark"), into="_found")
    return found.where(~decontamination.contaminated("_found")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; ``n_chars`` follows where a text has changed."""
    prepare(spark)
    ratios = secrets.train(secrets.labelled_samples(docs))
    if "n_chars" not in docs.columns:
        return secrets.redact(docs, ratios).select(*docs.columns)
    clean = secrets.redact(docs.withColumn("_before", F.col("text")), ratios)
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    length = F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None  # scores and sketches are no SQL; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet to shared storage and read by the next."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
