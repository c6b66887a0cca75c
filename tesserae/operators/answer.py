"""Extractive answers with citations, for batches of queries.  Scores are this library's own definition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import text as txt

# Limits of an answer.
SENTENCES, TOKENS, LEAST_SCORE, CONTEXTS, QUOTE = 4, 110, 0.08, 5, 220


def scored_sentences(hits: DataFrame, chunks: DataFrame, queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank, ordinal, sentence, start, end, tokens, score): the idf share of the query's terms in each sentence of its hits.

    hits (query_id, chunk_id, rank), chunks (chunk_id, text), queries
    (query_id, tokens), terms (term, idf).
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).join(terms.select("term", "idf"), "term", "left").na.fill({"idf": 0.0})
    total = wanted.groupBy("query_id").agg(F.sum("idf").alias("total"), F.collect_list(F.struct("term", "idf")).alias("wanted"))
    texts = hits.filter(F.col("rank") <= CONTEXTS).select("query_id", "chunk_id", "rank").join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = texts.select("query_id", "chunk_id", "rank", F.posexplode(txt.split_sentences(F.col("text"))).alias("ordinal", "s"))
    rows = rows.select("query_id", "chunk_id", "rank", "ordinal", F.col("s.sentence").alias("sentence"), "s.start", "s.end", txt.tokens(F.col("s.sentence")).alias("toks"))
    covered = F.aggregate(F.filter("wanted", lambda w: F.array_contains("toks", w["term"])), F.lit(0.0), lambda a, w: a + w["idf"])
    scored = rows.join(total, "query_id").withColumn("score", F.when(F.col("total") > 0, covered / F.col("total")).otherwise(0.0))
    return scored.select("query_id", "chunk_id", "rank", "ordinal", "sentence", "start", "end", F.size("toks").alias("tokens"), "score")


def answers(sentences: DataFrame) -> DataFrame:
    """(query_id, text, citations, confidence, abstained): the best sentences, at most SENTENCES and TOKENS, in score order, each cited.

    A query whose sentences all score below LEAST_SCORE is abstained from.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "rank", "ordinal", "chunk_id")
    best = sentences.filter(F.col("score") >= LEAST_SCORE).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= SENTENCES)
    kept = best.withColumn("sum", F.sum("tokens").over(order)).filter((F.col("sum") <= TOKENS) | (F.col("n") == 1))
    marked = kept.withColumn("marker", F.concat(F.lit("["), F.dense_rank().over(W.partitionBy("query_id").orderBy("rank", "chunk_id")), F.lit("]")))
    cite = F.struct("n", "marker", "chunk_id", txt.truncate(F.col("sentence"), QUOTE).alias("quote"), F.col("start").alias("doc_start"), F.col("end").alias("doc_end"), "score", "sentence")
    grouped = marked.groupBy("query_id").agg(F.sort_array(F.collect_list(cite)).alias("citations"), F.max("score").alias("confidence"))
    text = F.array_join(F.transform("citations", lambda c: F.concat_ws(" ", c["sentence"], c["marker"])), " ")
    every = sentences.select("query_id").distinct()
    return every.join(grouped, "query_id", "left").select(
        "query_id", F.coalesce(text, F.lit("")).alias("text"), "citations", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("citations").isNull().alias("abstained")
    )
