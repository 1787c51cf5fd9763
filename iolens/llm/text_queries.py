"""Queries of problems 8, 9 and 10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iolens.llm import abuse, leakage, tokens
from iolens.runtime import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p8_source_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and the longest document per source."""
    n = tokens.encode_corpus(table(spark, d, "documents"), carried=("source",)).select("source", F.size("ids").cast("bigint").alias("n"))
    return n.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("longest"))


def _pairs(spark: SparkSession, d: str, renamed: bool = True) -> DataFrame:
    return leakage.matching_windows(table(spark, d, "documents"), table(spark, d, "eval_items"), renamed=renamed)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.verbatim(_pairs(spark, d, renamed=False)).select("doc_id", "item_id")


def p9_reparameterised(spark: SparkSession, d: str) -> DataFrame:
    return leakage.reparameterised(_pairs(spark, d))


def p9_reparameterised_best(spark: SparkSession, d: str) -> DataFrame:
    """The best item per document, a summary of p9_reparameterised."""
    return leakage.best_items(leakage.reparameterised(_pairs(spark, d)))


def _classifier(spark: SparkSession, d: str, anew: bool = False) -> abuse.Classifier:
    return abuse.fitted(spark, abuse.rated(table(spark, d, "documents"), table(spark, d, "doc_labels")), anew)


def _scored(spark: SparkSession, d: str, anew: bool = False) -> DataFrame:
    return abuse.score_documents(table(spark, d, "documents"), _classifier(spark, d, anew))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Always fits the classifier; the other queries take the one kept for the same ratings, if there is one."""
    return _scored(spark, d, anew=True).where("flagged").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "score", "flagged")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with text, flagged ones and their share per source."""
    n, k = F.count("score"), F.count_if("flagged")
    return _scored(spark, d).groupBy("source").agg(n.alias("n_docs"), k.alias("n_flagged"), F.try_divide(k, n).alias("rate"))


def p10_held_out(spark: SparkSession, d: str) -> DataFrame:
    """Per language, held-out rated documents against their ratings (which err now and then)."""
    c = _classifier(spark, d)
    rows = spark.createDataFrame(c.held_out, "lang string, n_rated int, n_abusive int, n_flagged int, n_right int")
    return rows.withColumns({"precision": F.try_divide("n_right", "n_flagged"), "recall": F.try_divide("n_right", "n_abusive")})


QUERIES = {f.__name__: f for f in (p8_ids, p8_source_tokens, p9_found, p9_reparameterised, p9_reparameterised_best, p10_found, p10_scores, p10_rates, p10_held_out)}

_GONE = "chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279)"
_WORDS = f"regexp_extract_all(lower(regexp_replace(text, '[' || {_GONE} || ']', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"


def _windows(name: str, key: str) -> str:
    return f"""(SELECT {key}, array_to_string(list_slice(w, i, i + 11), ' ') AS k FROM
      (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {name} WHERE text IS NOT NULL)))"""


SQL = {"p9_found": f"SELECT DISTINCT doc_id, item_id FROM {_windows('documents', 'doc_id')} a JOIN {_windows('eval_items', 'item_id')} b USING (k)"}
