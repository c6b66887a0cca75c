"""Corpus statistics: term statistics, idf, co-occurrence and PPMI.

Documents come as (doc_id, tokens), tokens being an array.  A doc_id names one
document; rows of one id count as one document of several parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions.text import stem
from tesserae.operators.blocks import dictionaries, repeated
from tesserae.operators.pairs import Pairs, pairs
from tesserae.sources.tables import stored


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, stem, df, tf): one shuffle by (document, term) that is summed beforehand, one by term."""
    each = docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return each.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf")).select("term", stem(F.col("term")).alias("stem"), "df", "tf")


def block_stats(docs: DataFrame, own: DataFrame) -> DataFrame:
    """term_stats of docs from their blocks, whose dictionaries know documents and places of each term, so that no row for a document and term is shuffled."""
    if repeated(own):
        return term_stats(docs)
    sums = dictionaries(own).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
    return sums.select("term", stem(F.col("term")).alias("stem"), "df", "tf")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, total_terms, avg_len)."""
    total = F.coalesce(F.sum(F.size("tokens")), F.lit(0)).cast("long")
    return docs.agg(F.count("*").alias("n_docs"), total.alias("total_terms")).withColumn("avg_len", F.when(F.col("n_docs") > 0, F.col("total_terms") / F.col("n_docs")).otherwise(0.0))


def idf(df: Column, n_docs: Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); a term of no document counts as one of a single document."""
    d = F.greatest(F.coalesce(df, F.lit(1)), F.lit(1))
    return F.log((n_docs - d + 0.5) / (d + 0.5) + 1.0)


def with_idf(terms: DataFrame, corpus: DataFrame) -> DataFrame:
    """terms with idf; corpus is the one row of corpus_stats."""
    return terms.crossJoin(F.broadcast(corpus.select("n_docs"))).withColumn("idf", idf(F.col("df"), F.col("n_docs"))).drop("n_docs")


def requested_terms(docs: DataFrame, wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of those of the wanted terms (term) that docs have; no other term is counted."""
    each = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    return with_idf(each.distinct().groupBy("term").agg(F.count("*").alias("df")), corpus)


def vocabulary(terms: DataFrame, min_df: int = 2) -> DataFrame:
    """Terms of at least min_df documents, or all if there is none."""
    kept = terms.filter(F.col("df") >= min_df)
    return terms if kept.isEmpty() else kept


def stem_surfaces(terms: DataFrame) -> DataFrame:
    """(stem, forms): the sorted terms of each stem."""
    return terms.groupBy("stem").agg(F.sort_array(F.collect_set("term")).alias("forms"))


def surface_forms(terms: DataFrame, queries: DataFrame) -> DataFrame:
    """(term, form) for each term of queries (term) and each corpus term with its stem."""
    wanted = queries.select("term", stem(F.col("term")).alias("stem")).distinct()
    return wanted.join(terms.select("stem", F.col("term").alias("form")), "stem").select("term", "form")


def cooccurrence(docs: DataFrame, vocab: DataFrame | None = None, window: int = 5) -> DataFrame:
    """(a, b, weight): for terms up to window places apart after the vocabulary filter, the sum of 1/distance; symmetric, no equal terms."""
    own = pairs(docs, vocab, window)
    return own.named(own.named(own.rows(), "a"), "b").select("a", "b", "weight")


def strongest_contexts(own: Pairs, max_contexts: int = 64, alpha: float = 0.75) -> DataFrame:
    """The rows of ppmi for pairs, whose terms are numbered: ties by number are ties by context, and terms are joined once contexts are cut."""
    packed = own.strongest(max_contexts, alpha)
    if packed is None:
        return ppmi(own.named(own.named(own.rows(), "a"), "b"), max_contexts, alpha)
    each = own.named(packed, "term").select("term", F.posexplode(F.arrays_zip("ctxs", "ws")).alias("k", "x")).select("term", F.col("x.ctxs").alias("ctx"), F.col("x.ws").alias("w"), (F.col("k") + 1).alias("rk"))
    return own.named(each, "ctx").select("term", "ctx", "w", "rk")


def ppmi(cooc: DataFrame, max_contexts: int = 64, alpha: float = 0.75) -> DataFrame:
    """(term, ctx, w, rk): positive PMI with a smoothed context distribution, the strongest contexts of each term; ties by context.

    The weights are stored, since the marginals and the totals are sums of them.
    """
    cooc = stored(cooc, "cooccurrence")
    marginal = stored(cooc.groupBy(F.col("a").alias("term")).agg(F.sum("weight").alias("m")), "marginals")
    totals = marginal.agg(F.sum("m").alias("total"), F.sum(F.pow("m", F.lit(alpha))).alias("smooth"))
    rows = cooc.join(marginal.select(F.col("term").alias("a"), F.col("m").alias("ma")), "a").join(marginal.select(F.col("term").alias("b"), F.col("m").alias("mb")), "b").crossJoin(F.broadcast(totals))
    p_ab, p_a, p_b = F.col("weight") / F.col("total"), F.col("ma") / F.col("total"), F.pow("mb", F.lit(alpha)) / F.col("smooth")
    scored = rows.select(F.col("a").alias("term"), F.col("b").alias("ctx"), F.log(p_ab / (p_a * p_b)).alias("w")).filter("w > 0")
    return scored.withColumn("rk", F.row_number().over(W.partitionBy("term").orderBy(F.desc(F.round("w", 9)), "ctx"))).filter(F.col("rk") <= max_contexts)
