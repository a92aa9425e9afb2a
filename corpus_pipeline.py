"""The corpus pipeline: from raw documents to packed training sequences.

Every stage takes all that its predecessor kept and is written as Parquet before
the next one reads it, so a lost executor costs the tasks it ran and no stage is
computed twice.

Edge cases, of every stage: a null text is empty, a very long one is read whole, an
empty table gives an empty table, and further columns, whatever their names, go
along up to the packing.  What else is special stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm.common import materialize, table
from lithoframe.llm.decontaminate import without_leaks
from lithoframe.llm.near_dedup import keep_one_of_similar
from lithoframe.llm.packing import pack_documents
from lithoframe.llm.quality import score_quality, train
from lithoframe.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte-level classifier, fitted on the labels' training folds, accepts.

    Rows of equal text get equal scores and stay or go together; a score of exactly
    0.5 is accepted; without labels of both kinds the share of label 1 decides for all.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model, carry=tuple(docs.columns)).where(F.col("__predicted") == 1).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of smallest id, of each group linked by a Jaccard similarity of 0.8 on 5-word shingles.

    Links are searched among SimHash codes by multi-index hashing and verified exactly.

    Empty texts are one group; of rows equal in id and text one stays, of rows that
    share an id one for each group; rows without an id all stay.
    """
    return keep_one_of_similar(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that documents of smaller ids have; n_chars follows.

    A document that loses all its text stays, as an empty one; rows that share an id
    take nothing from each other, and rows without an id take nothing from any.
    """
    carried = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    cut = remove_repeats(docs, with_kept=True, carry=carried)
    return cut.select(*[F.col("__carried." + c).alias(c) if c in carried else (F.col("kept").alias("text") if c == "text" else F.length("kept").cast(docs.schema["n_chars"].dataType).alias("n_chars")) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget; empty items match nothing."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 4096 tokens.

    An empty text is its end id alone; repeated rows are packed each for itself.
    """
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL cannot state a learned classifier, a byte-pair vocabulary or a packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
