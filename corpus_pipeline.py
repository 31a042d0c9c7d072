"""A training corpus from the documents, in five stages.

Each stage reads what the one before it wrote: low-quality documents go, lines that many documents
hold go, one document of each group of near duplicates stays, documents that hold benchmark items
go, and the rest is packed into batches. A stage that meets an empty table returns one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablestory.llm import quality
from tablestory.llm.latent_search import without_items
from tablestory.llm.line_dedup import dedup_lines
from tablestory.llm.ngram_join import ngram_components
from tablestory.llm.packing import pack
from tablestory.llm.scratch import Scratch
from tablestory.llm.catalog import _table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model, trained on the labels, does not reject.

    A null text is judged as an empty one, of any length the whole text is; rows with equal ids are judged one by one, by
    their texts. Further columns stay as they are, whatever their names. Without labels every text scores alike.
    """
    return quality.keep_good(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more hold, but for the last of these.

    No row goes; a text may end up empty, and a null one ends up empty. Rows with equal ids are one document, rows
    without id are counted for no line and keep no repeated one. ``n_chars``, where there is one, is counted anew;
    further columns stay as they are, whatever their names.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("__none")).alias("rest")
    out = dedup_lines(docs.select("doc_id", "text", rest), carry=("rest",))
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*[made[c].alias(c) if c in made else F.col("rest").getField(c).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more.

    Of rows with one id one stays: that with the smallest hash of its text, null and empty ones first. Rows without
    id and texts without words are in no group and stay. Further columns stay as they are, whatever their names.
    """
    classes = ngram_components(docs.select("doc_id", "text"), size=5, percent=80)
    gone = classes.where("component_id <> doc_id").select("doc_id")
    repeated = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    single = docs.join(gone.union(repeated).distinct(), "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return single
    several = docs.join(repeated.join(gone.distinct(), "doc_id", "left_anti"), "doc_id", "left_semi").select(docs.columns)
    order = F.struct(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    one = several.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order).alias("row"))
    return single.unionAll(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))


def unseen_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none, nor do null and empty items count. Rows with equal ids are judged one by one;
    further columns stay as they are, whatever their names. Without items every row stays.
    """
    return without_items(docs, _table(spark, sf_dir, "benchmark"))


def batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a batch of one length bucket for every row, with its ``lang`` and ``source`` where there are such columns.

    A null text has length 0; ties and repeated rows are all packed. Other columns are left out.
    """
    return pack(docs, carry=tuple(c for c in ("lang", "source") if c in docs.columns))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", own_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", unseen_items),
    ("packing", batches),
]

#: The classifier and the latent search are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    with Scratch(spark) as s:
        for k, (_, stage) in enumerate(STAGES):
            docs = s.keep(stage(spark, docs, sf_dir), f"stage{k}")
            if k:
                s.drop(f"stage{k - 1}")
        return s.result(docs)
