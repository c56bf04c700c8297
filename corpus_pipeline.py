"""From raw documents to packed sequences, each stage an operator of ``stanzaline.llm``.

Every stage reads what the one before it wrote. All but the last return the columns of ``documents``, and
any further ones, whatever their names: names that a stage needs for itself are made to differ.

Defined cases, in every stage: a row with a null in any column goes through like any other; an empty text
is scored, has no lines to lose, is near nothing, is taken by no mix and packs as its end token; very long
texts are worked on whole; rows that tie on doc_id, or have none, are told apart by a hash of the text;
rows whose doc_id and text are equal share their fate, and the near-dedup stage keeps one of them; stages
on an empty table return no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stanzaline.llm import common, lines, mixing, neardup, packing, quality

#: No SQL states the scores of a network, so run() is tested against a brute-force version.
ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score at or above the threshold)."""
    model = quality.train(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    (score,) = common.fresh(docs.columns, "quality_score")
    return quality.score_documents(docs, model, score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; those of which nothing but blanks is left go."""
    removed, kept = (F.col(c) for c in common.fresh(docs.columns, "line_removed", "line_kept"))
    found = lines.dedup_lines(docs).where((removed == 0) | (F.trim(F.translate(kept, "\t\n\r", "   ")) != ""))
    changed = {"text": kept}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(removed > 0, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least doc_id, nulls last, and of a tie the least hash; of equal rows one."""
    row, kept_row, turn = common.fresh(docs.columns, "row_hash", "kept_row", "row_turn")
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("row").alias(kept_row)).distinct()
    rows = docs.withColumn(row, F.xxhash64("doc_id", "text")).join(kept, F.col(row) == F.col(kept_row))
    order = Window.partitionBy(row).orderBy(F.xxhash64(*[c for c in docs.columns if c != "text"]))
    return rows.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them. The one at a source's cut is taken whole if half of it fits."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents, with their token ids; other columns end here."""
    return packing.pack_documents(docs).drop("row")


STAGES = [
    ("quality", quality_filter),
    ("lines", line_dedup),
    ("neardup", near_dedup),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        common.clear(spark, keep=docs)
    return docs
