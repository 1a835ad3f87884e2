"""From documents to token ids: language, near copies, secrets, source weights, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes every stage's result to the
shared folder and rereads it as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaframe.llm import jaccard, langid, mixing, pieces, secrets
from silvaframe.llm.common import Scratch, table

#: A text less like every language's landmarks than this is in none of the languages.
LEAST_SCORE = 0.1


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language (null, empty or no letters, or a score under LEAST_SCORE); fills missing langs.

    Learns from the rows that have a lang and are not held out. Where none has, no language is known that a document could
    be judged by, and all rows pass as they are. Ids and repeated rows do not matter, other columns stay whatever their
    names, and an empty table gives an empty one.
    """
    model = langid.train(docs, ~langid.held_out())
    if model is None:
        return docs
    plain = [f"c{k}" for k in range(len(docs.columns))]
    at = {c: plain[docs.columns.index(c)] for c in ("text", "lang")}
    out = langid.classify(docs.toDF(*plain), model, plain, text_col=at["text"])
    out = out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return out.withColumn(at["lang"], F.coalesce(at["lang"], "lang_pred")).select(*plain).toDF(*docs.columns)


def unused(docs: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of the documents has."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """The documents written with a number of each row, and the name of its column: ids may be null or repeat."""
    key = unused(docs, "_row")
    return scratch.save(docs.withColumn(key, F.monotonically_increasing_id())), key


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the row with the least id (null ids last), once.

    Near copies for a corpus: five words, similarity 0.8. Rows are compared, whatever their ids; rows
    without words are copies of nothing and stay. Only the numbers of rows that go are joined to the texts.
    """
    scratch = Scratch(spark, "pipeline-jaccard")
    rows, key = keyed(docs, scratch)
    found = scratch.save(jaccard.jaccard_components(rows, n=5, percent=80, id_col=key).select(F.col("doc_id").alias(key), "component_id"))
    groups = found.where(F.col("component_id") != F.col(key)).select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi").join(rows.select(key, "doc_id"), key)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("m")).select(F.col(f"m.{key}").alias(key))
    gone = scratch.save(members.select(key).join(first, key, "left_anti"))
    out = rows.join(gone, key, "left_anti").select(*docs.columns)
    out._reads = [rows]
    return out


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by [SECRET]."""
    return secrets.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each row as often as its source's weight asks for."""
    scratch = Scratch(spark, "pipeline-mixing")
    rows, key = keyed(docs, scratch)
    n = unused(rows, "_copies")
    copies = scratch.save(mixing.mix_sources(rows, row_col=key).where("copies <> 1").select(key, F.col("copies").alias(n)))
    out = rows.join(copies, key, "left").withColumn(n, F.coalesce(n, F.lit(1)))
    out = out.where(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    out._reads = [rows]
    return out


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: A kernel classifier and piece ids cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        last, docs = docs, scratch.save(out)
        if hasattr(last, "_scratch_path"):
            scratch.drop(last)
        scratch.drop(*getattr(out, "_reads", []))
    return docs
