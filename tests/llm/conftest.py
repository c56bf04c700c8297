import pytest
from awkward import awkward_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with further columns named like those that the operators make."""
    from pyspark.sql import functions as F

    names = "row node bucket bands band score size part piece sequence_id offset length start group_id kept component text_a lines line_count mix_size mix_taken salt d tail fingerprint quality_score row_turn row_hash kept_row line_row line_all line_cut line_removed mix_target mix_key mix_note Mix_Bucket line_x".split()
    return docs.select("*", *(F.lit(1).alias(n) for n in names))
