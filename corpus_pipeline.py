"""From raw documents to packed training sequences: five stages over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs.  All but the last
return the columns of the documents, which no result of an operator replaces: rows are set aside
as one struct while an operator works.  ``n_chars`` follows the text where a stage changes it.
Near copies are dropped by id: ids of dropped rows, the smaller part, are broadcast while few and
joined by a shuffle beyond that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import lines, minhash, packing, quality, suffix
from fieldloom.llm.common import set_aside, stored

#: Dropped ids (8 bytes each) that may be broadcast.
BROADCAST_IDS = 1 << 20


def _with_text(result: DataFrame, docs: DataFrame, text: str, changed: str) -> DataFrame:
    """The rows set aside, with what an operator made of their text; n_chars follows where the text has changed."""
    new = {"doc_id": F.col("doc_id"), "text": F.col(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.expr(changed), F.char_length(text)).otherwise(F.col("_fl_row.n_chars"))
    return result.select(*(new.get(f.name, F.col(f"_fl_row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents of a source hold go, and documents that the quality rules reject.  A row is judged by its own text."""
    return _with_text(quality.cleaned(set_aside(docs), "_fl_row.source").where("kept"), docs, "text", "n_shared_words > 0")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the last of them alone; a null text stays null."""
    return _with_text(lines.drop_repeated_lines(set_aside(docs)), docs, "text", "n_dropped > 0")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8.

    Rows of the document that stays all stay, repeated ones too, as do rows without a doc_id.  Null and
    empty texts and texts without words are copies of nothing and stay.  A long text is compared whole.
    """
    dropped = stored(minhash.near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(*docs.columns)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least a hundred bytes that stand earlier in the corpus go.

    A null text stays null and an empty one empty; a document that loses all its text stays, with an
    empty one.  Repeated rows are one document and lose what it loses; rows without a doc_id lose
    nothing.  A character of which a passage takes a part goes with it.  Long texts are cut whole.
    """
    return _with_text(suffix.remove_repeats(set_aside(docs)), docs, "kept_text", "n_removed > 0")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences.

    Null and empty texts have the end token alone.  Every row is packed, repeated ones and those without
    a doc_id too; texts longer than a sequence are cut into pieces.
    """
    import public_tokenizers

    return packing.pack(stored(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [("quality rules", quality_stage), ("line dedup", line_stage), ("near dedup", near_duplicate_stage), ("passage dedup", passage_stage), ("packing", packing_stage)]
#: Near copies and repeated passages are beyond SQL on whole tables; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
