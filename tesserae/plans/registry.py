"""Queries over the library's own operators, with DuckDB SQL for the same rows where SQL can express them.

Each query runs over whole tables.  Searches take as queries the stated set of
all benchmark texts, or the vectors whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.functions import similarity as sim
from tesserae.functions import text as txt
from tesserae.operators import answer, blocks, chunk, claims, embed, guard, index, retrieve, stats, trace, vector_store
from tesserae.plans import sqltext as q
from tesserae.sources import corpus
from tesserae.sources.tables import stored, table_path
from tesserae.streaming import spans as spans_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.evenly(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txt.token_rows(documents(spark, sf_dir), "doc_id")


def as_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", txt.content_tokens(F.col("text")).alias("tokens"))


def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(tokenized(spark, sf_dir), "tokens")
    return stats.with_idf(stats.term_stats(docs), stats.corpus_stats(docs))


D_TOK = f"d AS (SELECT doc_id, {q.content('text')} AS ts FROM documents)"
TERMS = f"{D_TOK}, occ AS (SELECT doc_id, unnest(ts) AS term FROM d), ts AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM occ GROUP BY term), cs AS (SELECT count(*) AS n, sum(len(ts)) AS total FROM d)"


# --- text functions --------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({q.tokens('text')}) AS INTEGER) AS n_tokens, CAST(len({q.content('text')}) AS INTEGER) AS n_content FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", txt.tokens(F.col("text")).alias("ts"))
    return own.select("doc_id", F.size("ts").alias("n_tokens"), F.size(txt.content(F.col("ts"))).alias("n_content"))


@query(f"WITH {TERMS}, v AS (SELECT '^' || term || '$' AS p FROM ts) SELECT gram, count(*) AS n FROM (SELECT unnest(flatten([list_transform(range(1, length(p) - n + 2), lambda i: p[i:i+n-1]) FOR n IN [3, 4, 5] IF length(p) >= n])) AS gram FROM v) GROUP BY gram")
def char_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = tokenized(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct()
    return terms.select(F.explode(txt.char_ngrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


#: Texts of other scripts, which the tables lack: id, text, script, language.
OTHER_SCRIPTS = (
    (-1, "नमस्ते दुनिया abc", "devanagari", "hi"), (-2, "東京都 a", "han", "zh"), (-3, "Привет, мир 12", "cyrillic", "ru"), (-4, "שלום", "hebrew", "he"), (-5, "αβγ abcd", "latin", "en"),
    (-6, "", "latin", "en"), (-7, "ひらがな漢", "kana", "ja"), (-8, "안녕 하세요", "hangul", "ko"), (-9, "மொழி xy", "tamil", "ta"), (-10, "ab αβ", "latin", "en"), (-11, "αβ ab", "greek", "el"), (-12, "12 ?!", "latin", "en"),
)


@query("SELECT doc_id, 'latin' AS script, 'en' AS lang FROM documents UNION ALL VALUES " + ", ".join(f"({i}, '{s}', '{lang}')" for i, _, s, lang in OTHER_SCRIPTS))
def detect_script_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents and of a few texts of other scripts."""
    rows = documents(spark, sf_dir).union(spark.createDataFrame([x[:2] for x in OTHER_SCRIPTS], "doc_id long, text string"))
    return rows.select("doc_id", txt.dominant_script(F.coalesce("text", F.lit(""))).alias("script"), txt.detect_lang(F.coalesce("text", F.lit(""))).alias("lang"))


@query(f"SELECT doc_id, md5({q.norm('text')}) AS normal FROM documents")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(F.coalesce(txt.normalize(F.col("text")), F.lit(""))).alias("normal"))


@query("SELECT doc_id, md5(strip_accents(coalesce(text, ''))) AS bare FROM documents")
def accents_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(F.coalesce(txt.strip_accents(F.col("text")), F.lit(""))).alias("bare"))


@query(f"SELECT conv_id, turn, {q.query_type('text')} AS query_type FROM conversations WHERE role = 'user'")
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", txt.classify_query(F.coalesce("text", F.lit(""))).alias("query_type"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '1[0-9]{3}|20[0-9]{2}')), ',') AS years FROM documents")
def extract_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.coalesce(F.array_join(txt.extract_years(F.col("text")), ","), F.lit("")).alias("years"))


@query()
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", txt.extract_numbers(F.coalesce("html", F.lit(""))).alias("numbers")).select("page_id", F.size("numbers").alias("n"), F.array_join("numbers", "|").alias("numbers"))


@query()
def extract_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.array_join(txt.extract_claims(F.coalesce("text", F.lit(""))), "|").alias("claims"))


@query(f"WITH RECURSIVE {q.sentences('documents')} SELECT doc_id, ordinal, start, stop, sentence FROM sents")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(txt.split_sentences(F.col("text"))).alias("ordinal", "s")).select("doc_id", "ordinal", "s.start", F.col("s.end").alias("stop"), "s.sentence")


@query(r"""WITH d AS (SELECT doc_id, replace(coalesce(text, ''), '. ', E'.\n\n') AS t FROM documents), p AS (SELECT doc_id, string_split_regex(t, '\n\s*\n') AS ps, regexp_extract_all(t, '\n\s*\n') AS ss FROM d),
u AS (SELECT doc_id, i, ps[i] AS b, length(coalesce(ss[i], '')) AS gap FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM p)),
w AS (SELECT *, sum(length(b) + gap) OVER (PARTITION BY doc_id ORDER BY i) - length(b) - gap AS at0 FROM u), s AS (SELECT doc_id, i, at0 + length(b) - length(regexp_replace(b, '^\s+', '')) AS start, regexp_replace(b, '^\s+|\s+$', '', 'g') AS b FROM w)
SELECT d.doc_id, CAST(count(i) AS INTEGER) AS n_paragraphs, coalesce(string_agg(CAST(start AS BIGINT) || '+' || length(b), ',' ORDER BY i), '') AS places FROM d LEFT JOIN (SELECT * FROM s WHERE b <> '') s ON s.doc_id = d.doc_id GROUP BY 1""")
def split_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of documents that have a blank line after each sentence, since the given ones have none."""
    spread = documents(spark, sf_dir).select("doc_id", txt.paragraph_spans(F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))).alias("ps"))
    return spread.select("doc_id", F.size("ps").alias("n_paragraphs"), F.array_join(F.transform("ps", lambda p: F.concat_ws("+", p["start"], p["end"] - p["start"])), ",").alias("places"))


@query("""WITH c AS (SELECT doc_id, text, text[1:80] AS c FROM documents), b AS (SELECT *, length(c) - instr(reverse(c), ' ') AS sp, instr(reverse(c), ' ') AS has FROM c)
SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE rtrim(CASE WHEN has > 0 AND sp > 48 THEN c[1:sp] ELSE c END, ' ,;:.') || '…' END AS short FROM b""")
def truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", txt.truncate(F.col("text"), 80).alias("short"))


MARKED = ("licensed", "license", "token", "version")


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+') AS ws, string_split_regex(coalesce(text, ''), '[\\p{{L}}\\p{{N}}_]+') AS gs FROM documents),
u AS (SELECT doc_id, i, lower(ws[i]) AS x, length(ws[i]) AS n, length(gs[i]) AS g FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
p AS (SELECT doc_id, x, n, sum(n + g) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM u),
h AS (SELECT doc_id, e - n AS s, e FROM p WHERE x IN ({q.quoted(MARKED)}) OR {q.stem('x')} IN (SELECT {q.stem('t')} FROM (SELECT unnest([{q.quoted(MARKED)}]) AS t))),
j AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY doc_id ORDER BY s) > 1, true) AS fresh FROM h), k AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM j)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS stop FROM k GROUP BY doc_id, island""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that share a stem with one of a few terms."""
    terms = F.array(*map(F.lit, MARKED))
    return documents(spark, sf_dir).select("doc_id", F.explode(txt.highlight_spans(F.col("text"), terms)).alias("s")).select("doc_id", "s.start", F.col("s.end").alias("stop"))


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'hi', 'bn', 'ta', 'te', 'mr') GROUP BY lang")
def language_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.of_languages(corpus.read_documents(spark, f"{sf_dir}/documents.parquet")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT md5(to_json({'doc_id': doc_id, 'lang': lang, 'source': source})::VARCHAR) AS line FROM documents")
def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines without the columns that are hidden, here their texts."""
    return corpus.to_json(corpus.read_documents(spark, f"{sf_dir}/documents.parquet"), hidden=("text",)).select(F.md5("json").alias("line"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'neither text nor audio' WHEN turn NOT BETWEEN 1 AND 50 THEN 'top_k out of range' ELSE '' END AS reason FROM conversations")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as requests, with their number as top_k."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(None).cast("string").alias("audio_b64"), F.col("turn").alias("top_k"))
    return rows.select("conv_id", "turn", F.coalesce(corpus.reason("request"), F.lit("")).alias("reason"))


@query(f"""WITH r AS (SELECT {q.norm('text')} AS k, conv_id || '-' || turn AS id, text FROM conversations WHERE role = 'user')
SELECT min(id) AS query_id, arg_min(text, id) AS text, count(*) AS n_asked FROM r GROUP BY k""")
def request_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.distinct_requests(_requests(spark, sf_dir))


@query("SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'text is empty' ELSE '' END AS reason FROM documents")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus.read_documents(spark, f"{sf_dir}/documents.parquet")
    good, bad = corpus.validated(rows, "passage")
    return good.select("doc_id", F.lit("").alias("reason")).unionByName(bad.select("doc_id", "reason"))


# --- statistics ------------------------------------------------------------------------------------------------------


@query(f"WITH {TERMS} SELECT term, {q.stem('term')} AS stem, df, tf, round({q.idf('df', 'n')}, 6) AS idf FROM ts, cs")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_table(spark, sf_dir).select("term", "stem", "df", "tf", F.round("idf", 6).alias("idf"))


@query(f"WITH {TERMS} SELECT n AS n_docs, CAST(total AS BIGINT) AS total_terms, round(total / n, 6) AS avg_len FROM cs")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.corpus_stats(tokenized(spark, sf_dir)).withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {TERMS} SELECT {q.stem('term')} AS stem, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS forms FROM ts GROUP BY 1")
def stem_surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stem_surfaces(stats.term_stats(tokenized(spark, sf_dir))).select("stem", F.size("forms").cast("long").alias("n"), F.array_join("forms", " ").alias("forms"))


CO = f"""{TERMS}, keep AS (SELECT term FROM ts WHERE df >= 2 OR NOT EXISTS (SELECT 1 FROM ts WHERE df >= 2)),
pos AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS p FROM d), kept AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS p FROM pos SEMI JOIN keep USING (term)),
half AS (SELECT a.term AS a, b.term AS b, 1.0 / (b.p - a.p) AS w FROM kept a JOIN kept b ON a.doc_id = b.doc_id AND b.p > a.p AND b.p <= a.p + 5 WHERE a.term <> b.term),
co AS (SELECT a, b, sum(w)::DOUBLE AS weight FROM (SELECT a, b, w::DOUBLE AS w FROM half UNION ALL SELECT b, a, w::DOUBLE FROM half) GROUP BY a, b)"""


def _pairs(spark: SparkSession, sf_dir: str) -> stats.Pairs:
    docs = stored(tokenized(spark, sf_dir), "tokens")
    return stats.pairs(docs, stats.vocabulary(stored(stats.block_stats(docs, blocks.blocks(docs)), "terms")))


@query(f"WITH {CO} SELECT a AS term, count(*) AS n_contexts, round(sum(weight), 4) AS weight FROM co GROUP BY a")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).contexts().select("term", "n_contexts", F.round("weight", 4).alias("weight"))


@query(f"""WITH {CO}, m AS (SELECT a AS t, sum(weight) AS m FROM co GROUP BY a), tt AS (SELECT sum(m) AS total, sum(pow(m, 0.75)) AS smooth FROM m),
s AS (SELECT co.a AS term, co.b AS ctx, ln((weight / total) / ((x.m / total) * (pow(y.m, 0.75) / smooth))) AS w FROM co JOIN m x ON x.t = co.a JOIN m y ON y.t = co.b, tt),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(w, 9) DESC, ctx) AS rk FROM s WHERE w > 0)
SELECT term, ctx, round(w, 5) AS w, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 64""")
def ppmi_top_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.strongest_contexts(_pairs(spark, sf_dir)).select("term", "ctx", F.round("w", 5).alias("w"), "rk")


# --- similarity and vectors ------------------------------------------------------------------------------------------


@query(f"""WITH {D_TOK}, b AS (SELECT item_id, {q.content('text')} AS ts FROM benchmark),
dx AS (SELECT doc_id, unnest(ts) AS t FROM d), dc AS (SELECT doc_id, t, count(*) AS c FROM dx GROUP BY 1, 2), bx AS (SELECT item_id, unnest(ts) AS t FROM b), bc AS (SELECT item_id, t, count(*) AS c FROM bx GROUP BY 1, 2),
j AS (SELECT item_id, doc_id, count(*) AS both_, sum(least(dc.c, bc.c)) AS same FROM dc JOIN bc USING (t) GROUP BY 1, 2),
dn AS (SELECT doc_id, count(*) AS n, sum(c) AS l FROM dc GROUP BY 1), bn AS (SELECT item_id, count(*) AS n, sum(c) AS l FROM bc GROUP BY 1)
SELECT item_id, doc_id, round(both_ / (dn.n + bn.n - both_), 6) AS jaccard, round(both_ / bn.n, 6) AS overlap, round(2 * same / (dn.l + bn.l), 6) AS f1
FROM j JOIN dn USING (doc_id) JOIN bn USING (item_id) WHERE both_ / bn.n >= 0.5""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark texts that share half of the text's tokens, found through their common tokens."""
    count = lambda rows, key: rows.select(key, F.explode("tokens").alias("t")).groupBy(key, "t").agg(F.count("*").alias("c"))
    dc = count(tokenized(spark, sf_dir), "doc_id")
    bc = count(benchmark_queries(spark, sf_dir).withColumnRenamed("query_id", "item_id"), "item_id")
    sizes = lambda rows, key, n, size: rows.groupBy(key).agg(F.count("*").alias(n), F.sum("c").alias(size))
    pairs = dc.join(bc.withColumnRenamed("c", "bc"), "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("both"), F.sum(F.least("c", "bc")).alias("same"))
    pairs = pairs.join(sizes(bc, "item_id", "bn", "bl"), "item_id").filter(F.col("both") / F.col("bn") >= 0.5).join(sizes(dc, "doc_id", "dn", "dl"), "doc_id")
    return pairs.select(
        "item_id", "doc_id",
        F.round(F.col("both") / (F.col("dn") + F.col("bn") - F.col("both")), 6).alias("jaccard"),
        F.round(F.col("both") / F.col("bn"), 6).alias("overlap"),
        F.round(2 * F.col("same") / (F.col("dl") + F.col("bl")), 6).alias("f1"),
    )


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), sim.l2_normalize(F.col("embedding")).alias("vector"))
    return rows, rows.filter(F.col("chunk_id") % 100 == 0).select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(sim.norm(F.col("embedding")), 5).alias("norm"))


VEC = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
NEAREST = f"""{VEC}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM v a, v b WHERE a.vec_id % 100 = 0),
nearest AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM s)"""
TOP_VECTORS = f"WITH {NEAREST} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM nearest WHERE rank <= 5"


@query(TOP_VECTORS)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.brute_force(*_vectors(spark, sf_dir)).withColumn("score", F.round("score", 5))


@query(TOP_VECTORS)
def ivf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search by clusters is exact, so it is held against all vectors; clusters are used at any size here."""
    return retrieve.ivf_search(*_vectors(spark, sf_dir), least=1).withColumn("score", F.round("score", 5))


@query(TOP_VECTORS)
def stored_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of cosine_topk from a store of two segments, the second of which was appended to the first's clusters."""
    vectors, queries = _vectors(spark, sf_dir)
    path, odd = table_path(spark, "vectors"), F.pmod(F.xxhash64("chunk_id"), F.lit(4)) == 0
    vector_store.create(vectors.filter(~odd), path)
    vector_store.append(vectors.filter(odd), path, 1)
    hits = vector_store.VectorSearch(spark, path, queries).hits
    return hits.select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def _mmr_sql(rounds: int) -> str:
    """Greedy choice, one CTE for each round: the candidates' largest similarity to what is chosen, and the best of the rest."""
    value = f"round({retrieve.MMR_LAMBDA} * score - {1 - retrieve.MMR_LAMBDA:.2f} * coalesce(most, 0), 9)"
    steps = ["m1 AS (SELECT query_id, chunk_id, score, NULL::DOUBLE AS most FROM nearest WHERE rank <= 40)"]
    for r in range(1, rounds + 1):
        steps.append(f"p{r} AS (SELECT query_id, chunk_id, score FROM m{r} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {value} DESC, chunk_id) = 1)")
        steps.append(
            f"m{r + 1} AS (SELECT m.query_id, m.chunk_id, m.score, greatest(coalesce(most, -2), list_dot_product(a.e, b.e) / (a.n * b.n)) AS most FROM m{r} m JOIN p{r} p ON p.query_id = m.query_id AND p.chunk_id <> m.chunk_id JOIN v a ON a.vec_id = m.chunk_id JOIN v b ON b.vec_id = p.chunk_id)"
        )
    chosen = " UNION ALL ".join(f"SELECT query_id, chunk_id, round(score, 5) AS score, {r} AS rank FROM p{r}" for r in range(1, rounds + 1))
    return f"WITH {NEAREST}, {', '.join(steps)} {chosen}"


@query(_mmr_sql(retrieve.TOP_K))
def mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, queries = _vectors(spark, sf_dir)
    return retrieve.mmr(retrieve.brute_force(vectors, queries, 40), vectors).withColumn("score", F.round("score", 5))


@query(f"""WITH {NEAREST}, c AS (SELECT n.*, label FROM nearest n JOIN embeddings ON vec_id = chunk_id WHERE rank <= 40)
SELECT query_id, chunk_id, label AS doc_id, round(score, 5) AS score FROM c QUALIFY row_number() OVER (PARTITION BY query_id, label ORDER BY round(score, 9) DESC, chunk_id) <= 2""")
def per_doc_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the 40 nearest vectors of each query at most two of a label, which stands for their document."""
    hits = retrieve.brute_force(*_vectors(spark, sf_dir), 40).withColumn("score", F.round("score", 9))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id"))
    return retrieve.per_doc_cap(hits.join(labels, "chunk_id")).select("query_id", "chunk_id", "doc_id", F.round("score", 5).alias("score"))


@query(f"""WITH {VEC} SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e) / (a.n * b.n), 5) AS dense
FROM v a JOIN embeddings x ON x.vec_id = a.vec_id JOIN embeddings y ON y.label = x.label JOIN v b ON b.vec_id = y.vec_id WHERE a.vec_id % 100 = 0""")
def dense_rescoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that another search gives, here vectors of the query's label, with their dense scores."""
    vectors, queries = _vectors(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    candidates = labels.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label").join(labels.withColumnRenamed("vec_id", "chunk_id"), "label").select("query_id", "chunk_id")
    return retrieve.dense_scores(candidates, vectors, queries).select("query_id", "chunk_id", F.round("dense", 5).alias("dense"))


@query(f"""WITH {NEAREST} SELECT query_id, round(max(score), 5) AS best, max(score) >= 0.065 AS passed, CASE WHEN max(score) >= 0.065 THEN 'allow' WHEN max(score) >= 0.055 THEN 'clarify' ELSE 'abstain' END AS action
FROM nearest WHERE chunk_id <> query_id GROUP BY 1""")
def retrieval_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each query vector has another vector near enough."""
    hits = retrieve.brute_force(*_vectors(spark, sf_dir), 2).filter("chunk_id <> query_id")
    return guard.retrieval_floor(hits).select("query_id", F.round("score", 5).alias("best"), "passed", "action")


@query()
def ppmi_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    return embed.fit_ppmi(docs).encode(docs).select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def char_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    own = blocks.blocks(docs)
    terms = stats.with_idf(stats.block_stats(docs, own), stats.corpus_stats(own.filter("codes is not null").select(F.col("codes").alias("tokens"))))
    return embed.encode_chars(own, terms).select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def composite_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenized(spark, sf_dir)
    return embed.encode_composite(embed.fit_ppmi(docs), docs).select("doc_id", F.transform("vector", lambda x: F.round(x, 4)).alias("vector"))


@query()
def term_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms nearest to each term of the benchmark's texts."""
    asked = benchmark_queries(spark, sf_dir).select(F.explode("tokens").alias("term")).distinct()
    return embed.fit_ppmi(tokenized(spark, sf_dir), direction=False).neighbours(asked).select("term", "other", F.round("score", 4).alias("score"))


# --- retrieval -------------------------------------------------------------------------------------------------------

BM25 = f"""{TERMS}, bq AS (SELECT DISTINCT item_id AS query_id, unnest({q.content('text')}) AS term FROM benchmark),
po AS (SELECT doc_id, term, count(*) AS tf FROM occ SEMI JOIN bq USING (term) GROUP BY 1, 2), dl AS (SELECT doc_id, len(ts) AS dl FROM d),
sc AS (SELECT query_id, doc_id AS chunk_id, sum({q.idf('df', 'cs.n')} * po.tf * {retrieve.K1 + 1} / (po.tf + {retrieve.K1} * ({1 - retrieve.B} + {retrieve.B} * dl / (total / cs.n)))) AS score, count(*) AS matched
  FROM bq JOIN po USING (term) JOIN ts USING (term) JOIN dl USING (doc_id), cs GROUP BY 1, 2)"""


def _bm25(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None) -> DataFrame:
    # ties are broken on rounded scores, which both engines share
    return retrieve.bm25(as_chunks(spark, sf_dir) if chunks is None else chunks, benchmark_queries(spark, sf_dir), terms=False).withColumn("score", F.round("score", 6))


def _asked(spark: SparkSession, sf_dir: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the queries ask of all documents, which are read once for it: (chunk_id, dl, tokens) and the terms with idf."""
    slim = stored(retrieve.wanted_tokens(as_chunks(spark, sf_dir), retrieve.query_terms(queries)), "wanted-tokens")
    terms = stats.requested_terms(slim.withColumnRenamed("chunk_id", "doc_id"), queries.select(F.explode("tokens").alias("term")), slim.agg(F.count("*").alias("n_docs")))
    return slim, stored(terms, "asked-terms")


@query(f"WITH {BM25}, s AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM sc) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.top_k(_bm25(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


BEST = "SELECT query_id, chunk_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 5"


def _pruned(spark: SparkSession, sf_dir: str) -> index.Search:
    """A search in an index of all documents, written for it."""
    path = table_path(spark, "index")
    index.write_segment(as_chunks(spark, sf_dir), path)
    return index.Search(index.Index.read(spark, path), benchmark_queries(spark, sf_dir))


@query(f"WITH {BM25}, s AS ({BEST}) SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s")
def bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of bm25_topk from a stored index, whose blocks are read only where they can matter."""
    return _pruned(spark, sf_dir).hits.select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {BM25}, h AS ({BEST}), ps AS (SELECT doc_id, unnest(ts) AS term, unnest(range(0, len(ts))) AS pos FROM d),
o AS (SELECT h.query_id, h.chunk_id, ps.term, ps.pos FROM h JOIN ps ON ps.doc_id = h.chunk_id JOIN bq ON bq.query_id = h.query_id AND bq.term = ps.term),
e AS (SELECT r.query_id, r.chunk_id, r.pos AS stop, o.term, max(o.pos) AS last FROM o r JOIN o ON o.query_id = r.query_id AND o.chunk_id = r.chunk_id AND o.pos <= r.pos GROUP BY 1, 2, 3, 4),
w AS (SELECT query_id, chunk_id, stop, min(last) AS start, count(*) AS n FROM e GROUP BY 1, 2, 3), m AS (SELECT query_id, chunk_id, count(DISTINCT term) AS n_terms FROM o GROUP BY 1, 2),
i AS (SELECT query_id, term, coalesce({q.idf('df', 'cs.n')}, 0) AS idf FROM bq JOIN ts USING (term), cs), tot AS (SELECT query_id, sum(idf) AS total FROM i GROUP BY 1),
cov AS (SELECT query_id, chunk_id, sum(idf) AS covered FROM (SELECT DISTINCT query_id, chunk_id, term FROM o) JOIN i USING (query_id, term) GROUP BY 1, 2)
SELECT query_id, chunk_id, CAST(n_terms AS INTEGER) AS n_terms, CAST(stop - start + 1 AS INTEGER) AS width, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop,
round(0.5 * covered / total + 0.5 * n_terms / (stop - start + 1), 6) AS rerank FROM w JOIN m USING (query_id, chunk_id) JOIN cov USING (query_id, chunk_id) JOIN tot USING (query_id) WHERE n = n_terms
QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY stop - start, stop) = 1""")
def proximity_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of bm25_pruned with the smallest window that has all of the query's terms that they have."""
    return _pruned(spark, sf_dir).reranked().select("query_id", "chunk_id", "n_terms", "width", "start", "stop", F.round("rerank", 6).alias("rerank"))


@query(f"""WITH {BM25}, s AS (SELECT query_id, chunk_id, round(score, 6) AS score, matched FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS r2 FROM s),
f AS (SELECT query_id, chunk_id, round(CASE WHEN r1 <= 120 THEN 1.0 / (60 + r1) ELSE 0 END + CASE WHEN r2 <= 120 THEN 1.0 / (60 + r2) ELSE 0 END, 9) AS fusion FROM r WHERE r1 <= 120 OR r2 <= 120)
SELECT query_id, chunk_id, fusion, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, chunk_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 and the number of matched terms, each cut to its candidates, fused."""
    fused = retrieve.fused(_bm25(spark, sf_dir), ("score", "matched"))
    return retrieve.top_k(fused.withColumn("fusion", F.round("fusion", 9)), by="fusion").select("query_id", "chunk_id", "fusion", "rank")


@query(f"""WITH {BM25}, h AS (SELECT query_id, chunk_id, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) <= 40),
w AS (SELECT query_id, term, coalesce({q.idf('df', 'cs.n')}, 0) AS idf FROM bq LEFT JOIN ts USING (term), cs), tot AS (SELECT query_id, sum(idf) AS total FROM w GROUP BY 1),
cov AS (SELECT h.query_id, h.chunk_id, sum(w.idf) AS c FROM h JOIN w ON w.query_id = h.query_id JOIN po ON po.doc_id = h.chunk_id AND po.term = w.term GROUP BY 1, 2)
SELECT query_id, chunk_id, round(c / total, 6) AS rerank FROM cov JOIN tot USING (query_id)""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    chunks, terms = _asked(spark, sf_dir, queries)
    return retrieve.rerank(stored(retrieve.top_k(_bm25(spark, sf_dir, chunks), 40).drop("rank"), "hits"), chunks, queries, terms).select("query_id", "chunk_id", F.round("rerank", 6).alias("rerank"))


@query(f"""WITH {BM25}, m AS (SELECT query_id, score, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM sc)
SELECT query_id, count(*) AS n FROM m WHERE round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 6) >= {retrieve.MIN_SCORE} GROUP BY 1""")
def minimum_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many hits of each query are above the floor once scaled."""
    # scores are rounded once they are scaled: rounded before, a hit at the floor may fall on its other side
    hits = retrieve.bm25(as_chunks(spark, sf_dir), benchmark_queries(spark, sf_dir), terms=False).select("query_id", "score")
    hits = retrieve.scaled(hits, "score").withColumn("score", F.round("score", 6))
    return retrieve.above_floor(hits).groupBy("query_id").agg(F.count("*").alias("n"))


@query(f"""WITH {BM25}, s AS (SELECT query_id, chunk_id, round(score, 6) AS score, matched FROM sc),
m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, min(matched) OVER w AS ml, max(matched) OVER w AS mh FROM s WINDOW w AS (PARTITION BY query_id)),
b AS (SELECT query_id, chunk_id, round(0.42 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END + 0.2 * CASE WHEN mh > ml THEN (matched - ml) / (mh - ml) ELSE 1 END, 6) AS score FROM m)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 5""")
def linear_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 as the lexical and the number of matched terms as the rerank column."""
    hits = _bm25(spark, sf_dir).select("query_id", "chunk_id", F.col("score").alias("lexical"), F.col("matched").cast("double").alias("rerank"))
    mixed = retrieve.blend(hits, {"lexical": retrieve.BLEND["lexical"], "rerank": retrieve.BLEND["rerank"]})
    return retrieve.top_k(mixed.withColumn("score", F.round("score", 6))).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {TERMS}, bq AS (SELECT DISTINCT item_id AS query_id, unnest({q.content('text')}) AS term FROM benchmark),
x AS (SELECT query_id, bq.term, o.term AS expansion, o.df FROM bq JOIN (SELECT *, {q.stem('term')} AS st FROM ts) o ON o.st = {q.stem('bq.term')} AND o.term <> bq.term)
SELECT query_id, term, expansion FROM x QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df DESC, expansion, term) <= 3""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.expand_terms(benchmark_queries(spark, sf_dir), stats.term_stats(tokenized(spark, sf_dir)))


def _letters(c: str) -> str:
    """A token with each accented letter as one sign that tokens lack: the other side counts edits of bytes."""
    return f"translate({c}, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"


@query(f"""WITH {TERMS}, rq AS (SELECT DISTINCT conv_id || '-' || turn AS query_id, unnest({q.content('text')}) AS term FROM conversations WHERE role = 'user'),
lost AS (SELECT * FROM rq ANTI JOIN ts USING (term)), x AS (SELECT DISTINCT term, {_letters('term')} AS k FROM lost), y AS (SELECT term, df, {_letters('term')} AS k FROM ts),
near AS (SELECT x.term, y.term AS repair, levenshtein(x.k, y.k) AS e, df FROM x JOIN y ON abs(length(y.k) - length(x.k)) <= 2),
best AS (SELECT term, repair FROM near WHERE e <= 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY e, df DESC, repair) = 1) SELECT query_id, term, repair FROM lost JOIN best USING (term)""")
def asr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of user turns that the documents lack, with the nearest one that they have."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), txt.content_tokens(F.col("text")).alias("tokens"))
    return retrieve.repair_terms(asked, stored(stats.term_stats(tokenized(spark, sf_dir)).select("term", "df"), "terms"))


@query()
def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = benchmark_queries(spark, sf_dir)
    slim, terms = _asked(spark, sf_dir, queries)
    hits = stored(retrieve.top_k(_bm25(spark, sf_dir, slim)), "hits")
    chunks = documents(spark, sf_dir).withColumnRenamed("doc_id", "chunk_id")
    made = answer.answers(stored(answer.scored_sentences(hits, chunks, queries, terms), "sentences"))
    return made.select("query_id", "text", F.size("citations").alias("n_citations"), F.round("confidence", 6).alias("confidence"), "abstained")


# --- chunking --------------------------------------------------------------------------------------------------------


@query(f"""WITH t AS (SELECT doc_id, {q.tokens('text')} AS ts FROM documents), c AS (SELECT doc_id, k, ts[k*68+1:k*68+90] AS s FROM (SELECT doc_id, ts, unnest(range(0, greatest(CAST(ceil((len(ts) - 90) / 68.0) AS INTEGER), 0) + 1)) AS k FROM t WHERE len(ts) > 0))
SELECT doc_id || '-fixed-0-' || k AS chunk_id, doc_id, array_to_string(s, ' ') AS text, CAST(len(s) AS INTEGER) AS token_count FROM c""")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed(documents(spark, sf_dir)).select("chunk_id", "doc_id", "text", "token_count")


@query(f"""WITH t AS (SELECT doc_id, {q.tokens('text')} AS ts FROM documents), p AS (SELECT doc_id, k, ts[k*220+1:k*220+220] AS s FROM (SELECT doc_id, ts, unnest(range(0, CAST(ceil(len(ts) / 220.0) AS INTEGER))) AS k FROM t WHERE len(ts) > 0)),
c AS (SELECT doc_id, k, j, s[j*55+1:j*55+55] AS s FROM (SELECT doc_id, k, s, unnest(range(0, CAST(ceil(len(s) / 55.0) AS INTEGER))) AS j FROM p))
SELECT doc_id || '-hierarchical-1-' || k AS chunk_id, 1 AS level, NULL AS parent_id, CAST(len(s) AS INTEGER) AS token_count FROM p
UNION ALL SELECT doc_id || '-hierarchical-0-' || (k * 4 + j), 0, doc_id || '-hierarchical-1-' || k, CAST(len(s) AS INTEGER) FROM c""")
def chunk_hierarchical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.hierarchical(documents(spark, sf_dir)).select("chunk_id", "level", "parent_id", "token_count")


def _strategy(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return chunk.STRATEGIES[name](documents(spark, sf_dir)).select("chunk_id", "doc_id", "ordinal", "text", "token_count", "window_before", "window_after")

    run.__name__ = f"chunk_{name}"
    query()(run)


for _name in ("recursive", "proposition"):
    _strategy(_name)

SENTENCE_ROWS = f"{q.sentences('documents')}, sc AS (SELECT doc_id, ordinal, sentence, CAST(len({q.tokens('sentence')}) AS INTEGER) AS token_count FROM sents)"
WINDOWED = f"""{SENTENCE_ROWS}, sw AS (SELECT *, coalesce(string_agg(sentence, ' ' ORDER BY ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS window_before,
coalesce(string_agg(sentence, ' ' ORDER BY ordinal) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS window_after FROM sc)"""


@query(f"WITH RECURSIVE {WINDOWED} SELECT doc_id || '-sentence_window-0-' || ordinal AS chunk_id, doc_id, ordinal, sentence AS text, token_count, window_before, window_after FROM sw WHERE token_count >= 4")
def chunk_sentence_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.sentence_window(documents(spark, sf_dir)).select("chunk_id", "doc_id", "ordinal", "text", "token_count", "window_before", "window_after")


@query(f"WITH RECURSIVE {WINDOWED} SELECT doc_id || '-sentence_window-0-' || ordinal AS chunk_id, md5(trim(window_before || ' ' || sentence || ' ' || window_after, ' ')) AS context FROM sw WHERE token_count >= 4")
def context_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk.sentence_window(documents(spark, sf_dir))
    return chunks.select("chunk_id", F.md5(chunk.context_text(chunks)).alias("context"))


@query(f"""WITH RECURSIVE {SENTENCE_ROWS}, sk AS (SELECT doc_id, ordinal, sentence, token_count, list_distinct({q.stems('sentence')}) AS st FROM sc),
sl AS (SELECT *, lag(st) OVER (PARTITION BY doc_id ORDER BY ordinal) AS bt FROM sk),
sn AS (SELECT doc_id, ordinal, token_count AS t, coalesce(CASE WHEN len(st) * len(bt) > 0 THEN len(list_intersect(st, bt)) / sqrt(len(st) * len(bt)) END, 0) AS near FROM sl),
walk(doc_id, ordinal, n, chunk) AS (SELECT doc_id, ordinal, t, 0 FROM sn WHERE ordinal = 0 UNION ALL
  SELECT sn.doc_id, sn.ordinal, CASE WHEN w.n = 0 OR w.n + t > 170 OR (w.n >= 30 AND near < 0.62) THEN t ELSE w.n + t END, w.chunk + CASE WHEN w.n > 0 AND (w.n + t > 170 OR (w.n >= 30 AND near < 0.62)) THEN 1 ELSE 0 END
  FROM walk w JOIN sn ON sn.doc_id = w.doc_id AND sn.ordinal = w.ordinal + 1),
kept AS (SELECT w.*, sentence FROM walk w JOIN sc USING (doc_id, ordinal))
SELECT doc_id || '-semantic-0-' || chunk AS chunk_id, doc_id, md5(string_agg(sentence, ' ' ORDER BY ordinal)) AS text FROM kept GROUP BY doc_id, chunk""")
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.semantic(documents(spark, sf_dir)).select("chunk_id", "doc_id", F.md5("text").alias("text"))


@query()
def chunk_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks by the vectors of the model that is fitted on the same documents."""
    model = embed.fit_ppmi(stored(tokenized(spark, sf_dir), "tokens"))
    return chunk.drift(documents(spark, sf_dir), model).select("chunk_id", "doc_id", "ordinal", "text", "token_count")


@query(f"""WITH t AS (SELECT doc_id, source, lang, {q.tokens('text')} AS ts FROM documents), c AS (SELECT doc_id, source, lang, k, ts[k*68+1:k*68+90] AS s FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((len(ts) - 90) / 68.0) AS INTEGER), 0) + 1)) AS k FROM t WHERE len(ts) > 0))
SELECT doc_id || '-metadata_aware-0-' || k AS chunk_id, doc_id, md5(concat_ws(' | ', nullif(source, ''), nullif(lang, '')) || ': ' || array_to_string(s, ' ')) AS text, CAST(len(s) AS INTEGER) AS token_count FROM c""")
def chunk_metadata_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the documents' source as title and their language as section."""
    rows = corpus.evenly(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("section"))
    return chunk.metadata_aware(rows).select("chunk_id", "doc_id", F.md5("text").alias("text"), "token_count")


@query(f"""WITH t AS (SELECT doc_id, {q.tokens('text')} AS ts FROM documents), p AS (SELECT doc_id, k, ts[k*220+1:k*220+220] AS s FROM (SELECT doc_id, ts, unnest(range(0, CAST(ceil(len(ts) / 220.0) AS INTEGER))) AS k FROM t WHERE len(ts) > 0)),
c AS (SELECT doc_id, k, CAST(len(s[j*55+1:j*55+55]) AS INTEGER) AS n FROM (SELECT doc_id, k, s, unnest(range(0, CAST(ceil(len(s) / 55.0) AS INTEGER))) AS j FROM p))
SELECT doc_id AS query_id, doc_id || '-hierarchical-1-' || k AS chunk_id, CAST(max(n) AS DOUBLE) AS score FROM c WHERE n BETWEEN 4 AND 320 GROUP BY doc_id, k""")
def small_to_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children within the guards on size as hits of their document, scored by their size, and the parents that stand for them."""
    chunks = chunk.hierarchical(documents(spark, sf_dir))
    hits = chunk.guarded(chunks.filter("level = 0")).select(F.col("doc_id").alias("query_id"), "chunk_id", F.col("token_count").cast("double").alias("score"))
    return retrieve.parents(hits, chunks)


@query(f"SELECT doc_id, CAST(greatest(ceil((len({q.tokens('text')}) - 90) / 68.0), 0) + 1 AS BIGINT) AS n FROM documents WHERE len({q.tokens('text')}) > 0")
def strategy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the chunks of two strategies those of one, counted by document."""
    docs = documents(spark, sf_dir)
    both = chunk.fixed(docs).unionByName(chunk.hierarchical(docs))
    return chunk.of_strategies(both, ("fixed",)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({q.content('text')})) AS s FROM documents), c AS (SELECT s, min(doc_id) AS rep FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM c), j AS (SELECT a.rep AS x, b.rep AS y, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.t = b.t AND a.rep < b.rep AND a.n >= 0.94 * b.n AND b.n >= 0.94 * a.n GROUP BY 1, 2, 3, 4),
gone AS (SELECT y AS doc_id FROM j WHERE k / (na + nb - k) >= 0.94 UNION SELECT s.doc_id FROM s JOIN c ON s.s = c.s AND s.doc_id <> c.rep)
SELECT doc_id FROM documents ANTI JOIN gone USING (doc_id)""")
def near_dup_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.collapsed(as_chunks(spark, sf_dir)).select(F.col("chunk_id").alias("doc_id"))


# --- guards ----------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")


@query(f"""WITH {TERMS}, rq AS (SELECT conv_id || '-' || turn AS query_id, list_distinct({q.content('text')}) AS ts FROM conversations WHERE role = 'user'), w AS (SELECT query_id, unnest(ts) AS term FROM rq),
s AS (SELECT query_id, sum(coalesce({q.idf('df', 'n')}, {q.idf('1', 'n')})) AS total, sum(CASE WHEN df IS NOT NULL THEN {q.idf('df', 'n')} ELSE 0 END) AS covered FROM w LEFT JOIN ts USING (term), cs GROUP BY 1)
SELECT rq.query_id, round(coalesce(covered / total, 0), 6) AS coverage, coalesce(covered / total, 0) >= 0.34 AS passed FROM rq LEFT JOIN s USING (query_id)""")
def coverage_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.coverage(_coverage(spark, sf_dir)).select("query_id", F.round("score", 6).alias("coverage"), "passed")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, requests = tokenized(spark, sf_dir), _requests(spark, sf_dir)
    corpus_row = stats.corpus_stats(docs).select("n_docs")
    wanted = requests.select(F.explode(txt.content_tokens(F.col("text"))).alias("term"))
    return guard.coverage_scores(requests, stats.requested_terms(docs, wanted, corpus_row), corpus_row.select(stats.idf(F.lit(1), F.col("n_docs")).alias("max_idf")))


@query(f"""WITH {TERMS}, rq AS (SELECT conv_id || '-' || turn AS query_id, list_distinct({q.content('text')}) AS ts FROM conversations WHERE role = 'user'), w AS (SELECT query_id, unnest(ts) AS term FROM rq),
s AS (SELECT query_id, sum(coalesce({q.idf('df', 'n')}, {q.idf('1', 'n')})) AS total, sum(CASE WHEN df IS NOT NULL THEN {q.idf('df', 'n')} ELSE 0 END) AS covered FROM w LEFT JOIN ts USING (term), cs GROUP BY 1)
SELECT rq.query_id, coalesce(covered / total, 0) >= 0.3 AS passed, CASE WHEN coalesce(covered / total, 0) >= 0.3 THEN 'allow' ELSE 'abstain' END AS action FROM rq LEFT JOIN s USING (query_id)""")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose coverage, taken as confidence, is below the floor."""
    return guard.confidence(_coverage(spark, sf_dir).withColumnRenamed("coverage", "confidence")).select("query_id", "passed", "action")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, with the turn before as what they must be grounded in."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("context", before).filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("context", F.lit("")).alias("context"))


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), s AS (SELECT conv_id || '-' || turn AS query_id, list_distinct({q.stems('text')}) AS a, {q.stems('context')} AS b FROM c WHERE role = 'assistant')
SELECT query_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS score, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END >= 0.52 AS passed FROM s""")
def grounding_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard.grounding(_replies(spark, sf_dir)).select("query_id", F.round("score", 6).alias("score"), "passed")


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations), s AS (SELECT conv_id || '-' || turn AS query_id, {q.tokens('text')} AS a, {q.tokens('context')} AS b FROM c WHERE role = 'assistant'),
ax AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(a) AS t FROM s) GROUP BY 1, 2), bx AS (SELECT query_id, t, count(*) AS n FROM (SELECT query_id, unnest(b) AS t FROM s) GROUP BY 1, 2),
m AS (SELECT query_id, sum(least(ax.n, bx.n)) AS same FROM ax JOIN bx USING (query_id, t) GROUP BY 1)
SELECT query_id, round(coalesce(2 * same / (len(a) + len(b)), 0), 6) AS f1 FROM s LEFT JOIN m USING (query_id)""")
def reply_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token F1 of each assistant turn and the turn before it."""
    rows = _replies(spark, sf_dir).select("query_id", txt.tokens(F.col("text")).alias("a"), txt.tokens(F.col("context")).alias("b"))
    return rows.select("query_id", F.round(sim.token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query()
def output_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _replies(spark, sf_dir)
    checks = guard.entity_support(rows).unionByName(guard.number_check(rows)).unionByName(guard.contradiction(rows))
    return checks.select("query_id", "name", "passed", F.round("score", 6).alias("score"), "action")


@query()
def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of whole documents against those of their first halves."""
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return claims.conflicts(documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), "text", half.alias("context"))).withColumnRenamed("query_id", "doc_id")


_PII_SQL = "coalesce(text, '')"
for _kind, _pattern in guard.PII.items():
    _PII_SQL = f"regexp_replace({_PII_SQL}, '{_pattern}', '[{_kind}]', 'g')"


@query(f"SELECT doc_id, md5({_PII_SQL}) AS redacted FROM documents")
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(guard.redact_pii(F.coalesce("text", F.lit("")))).alias("redacted"))


def _lexicon_sql(phrases: dict[str, float]) -> str:
    found = lambda p: f"regexp_matches({q.norm('text')}, '(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])')"
    return "least(1.0, " + " + ".join(f"CASE WHEN {found(p)} THEN {w} ELSE 0 END" for p, w in phrases.items()) + ")"


@query(f"""WITH c AS (SELECT conv_id || '-' || turn AS query_id, length(coalesce(text, '')) BETWEEN 2 AND 600 AS l, {_lexicon_sql(guard.UNSAFE_PHRASES)} < 0.5 AS u, {_lexicon_sql(guard.INJECTION_PHRASES)} < 0.5 AS i FROM conversations WHERE role = 'user')
SELECT query_id, CASE WHEN NOT u OR NOT i THEN 'refuse' WHEN NOT l THEN 'clarify' ELSE 'allow' END AS action, CAST(3 AS BIGINT) AS n_checks, CAST((NOT l)::INT + (NOT u)::INT + (NOT i)::INT AS BIGINT) AS n_tripped, l AND u AND i AS allowed FROM c""")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _requests(spark, sf_dir)
    return guard.verdicts(guard.length(rows).unionByName(guard.unsafe(rows)).unionByName(guard.injection(rows)))


@query(f"""WITH c AS (SELECT doc_id AS query_id, length(coalesce(text, '')) BETWEEN 2 AND 600 AS l, {_lexicon_sql(guard.UNSAFE_PHRASES)} < 0.5 AS u, {_lexicon_sql(guard.INJECTION_PHRASES)} < 0.5 AS i FROM documents)
SELECT query_id, 'length' AS name, 'clarify' AS action FROM c WHERE NOT l UNION ALL SELECT query_id, 'unsafe', 'refuse' FROM c WHERE NOT u UNION ALL SELECT query_id, 'injection', 'refuse' FROM c WHERE NOT i""")
def tripped_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input checks that documents, taken as requests, do not pass."""
    rows = documents(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return guard.tripped(guard.length(rows).unionByName(guard.unsafe(rows)).unionByName(guard.injection(rows))).select("query_id", "name", "action")


@query(f"""WITH c AS (SELECT doc_id AS query_id, length(coalesce(text, '')) BETWEEN 2 AND 600 AS l, {_lexicon_sql(guard.UNSAFE_PHRASES)} < 0.5 AS u, {_lexicon_sql(guard.INJECTION_PHRASES)} < 0.5 AS i FROM documents),
k AS (SELECT query_id, CASE WHEN NOT u THEN 'unsafe' WHEN NOT i THEN 'injection' WHEN NOT l THEN 'length' END AS name FROM c)
SELECT query_id, CASE WHEN name IS NULL THEN 'allow' WHEN name = 'length' THEN 'clarify' ELSE 'refuse' END AS action, name AS "check",
CASE name WHEN 'unsafe' THEN '{guard.MESSAGES["unsafe"].replace("'", "''")}' WHEN 'injection' THEN '{guard.MESSAGES["injection"].replace("'", "''")}' WHEN 'length' THEN '{guard.MESSAGES["empty"].replace("'", "''")}' END AS message FROM k""")
def policy_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said to documents, taken as requests."""
    rows = documents(spark, sf_dir).withColumnRenamed("doc_id", "query_id")
    return guard.policy(guard.length(rows).unionByName(guard.unsafe(rows)).unionByName(guard.injection(rows)))


@query(f"""WITH c AS (SELECT unnest(regexp_extract_all(html, '(?s).')) AS ch FROM pages UNION ALL SELECT unnest(regexp_extract_all(text, '(?s).')) FROM documents), n AS (SELECT ch, count(*) AS n FROM c GROUP BY 1)
SELECT ch, n, CASE WHEN regexp_matches(ch, '\\p{{Nd}}') THEN 'digit' WHEN regexp_matches(ch, '[\\p{{P}}\\p{{Z}}\\p{{S}}\\p{{C}}]') THEN 'other' {' '.join(f"WHEN unicode(ch) BETWEEN {lo} AND {hi} THEN '{name}'" for name, lo, hi in txt.SCRIPTS)} ELSE 'other' END AS script FROM n""")
def script_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of each character of documents and pages, with how often it occurs."""
    texts = documents(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "pages").select(F.col("html").alias("text")))
    chars = texts.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    return chars.withColumn("script", txt.script_of(F.col("ch")))


# --- traces: events as spans, their type as the stage and their value as the duration ---------------------------------


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("event_type").alias("name"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms"), F.col("value").alias("duration_ms"), F.when(F.col("value") > 100, "timeout").otherwise("ok").alias("status"), "ts",
    )


EVENT_STAGES = ("click", "view", "purchase", "signup", "error")


@query("""WITH r AS (SELECT event_type AS name, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT name, count(*) AS n, round(max(value) FILTER (i = round_even(0.5 * (n - 1), 0)), 4) AS p50, round(max(value) FILTER (i = round_even(0.9 * (n - 1), 0)), 4) AS p90, round(max(value) FILTER (i = round_even(0.95 * (n - 1), 0)), 4) AS p95,
round(max(value), 4) AS max, round(avg(value), 4) AS mean FROM r GROUP BY name""")
def span_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trace.exact_percentiles(_spans(spark, sf_dir), ["name"], "duration_ms")
    return out.select("name", "n", *(F.round(c, 4).alias(c) for c in ("p50", "p90", "p95", "max", "mean")))


@query("SELECT event_type AS name, count(*) AS n, round(avg(value), 4) AS mean_ms, CAST(count(*) FILTER (value > 100) AS BIGINT) AS errors FROM events GROUP BY 1")
def stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.stage_stats(_spans(spark, sf_dir)).withColumn("mean_ms", F.round("mean_ms", 4))


@query("SELECT user_id AS trace_id, event_type AS name, round(value, 4) AS duration_ms FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1")
def stage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.stage_map(_spans(spark, sf_dir)).select("trace_id", F.explode("stages").alias("name", "v")).select("trace_id", "name", F.round("v", 4).alias("duration_ms"))


@query("""SELECT user_id AS trace_id, round(sum(value), 3) AS total_ms, """ + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{s}'), 0), 3) AS {s}_ms" for s in EVENT_STAGES) + """,
round(sum(value), 3) AS pipeline_ms, round(greatest(sum(value) - coalesce(sum(value) FILTER (event_type IN ('click', 'view', 'purchase', 'signup', 'error')), 0), 0), 3) AS overhead_ms FROM events GROUP BY 1""")
def latency_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    out = trace.latency_rollup(spans, spans.groupBy("trace_id").agg(F.sum("duration_ms").alias("total_ms")), EVENT_STAGES)
    return out.select("trace_id", *(F.round(c, 3).alias(c) for c in out.columns if c != "trace_id"))


@query("SELECT event_id, epoch_us(ts) AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 400")
def recent_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.recent(table(spark, sf_dir, "events"), 400, by="ts", key="event_id").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


@query("""WITH e AS (SELECT event_type AS name, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) > 30), r AS (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM e WHERE value IS NOT NULL)
SELECT name, count(*) AS n, """ + ", ".join(f"round(max(value) FILTER (i = round_even({p / 100} * (n - 1), 0)), 4) AS p{p}" for p in trace.BENCH_PERCENTILES) + " FROM r GROUP BY name")
def bench_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trace.bench_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return out.select(F.col("event_type").alias("name"), "n", *(F.round(f"p{p}", 4).alias(f"p{p}") for p in trace.BENCH_PERCENTILES))


@query("SELECT event_type AS tool, count(*) AS calls, CAST(count(*) FILTER (value > 100) AS BIGINT) AS errors, round(avg(value), 4) AS mean_ms FROM events GROUP BY 1")
def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), F.when(F.col("value") > 100, "slow").alias("error"))
    return trace.tool_stats(calls).withColumn("mean_ms", F.round("mean_ms", 4))


@query("""WITH RECURSIVE s AS (SELECT event_id AS id, CASE WHEN event_id % 50 <> 0 THEN event_id - event_id % 7 % 3 - 1 END AS up, epoch_us(ts) / 1000 AS st FROM events),
t AS (SELECT s.id, p.id AS up, lpad(CAST(row_number() OVER (PARTITION BY s.up ORDER BY s.st, CAST(s.id AS VARCHAR)) AS VARCHAR), 12, '0') AS place FROM s LEFT JOIN s p ON p.id = s.up),
f(id, path) AS (SELECT id, place FROM t WHERE up IS NULL UNION ALL SELECT t.id, f.path || '.' || t.place FROM f JOIN t ON t.up = f.id)
SELECT CAST(id AS VARCHAR) AS span_id, md5(path) AS path, CAST(len(string_split(path, '.')) AS INTEGER) AS depth FROM f""")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans of one trace, each a child of an earlier one of its fifty; those whose parent is not there are roots."""
    e = F.col("event_id")
    parent = F.when(e % 50 != 0, e - e % 7 % 3 - 1)
    spans = table(spark, sf_dir, "events").select(F.lit("t").alias("trace_id"), e.cast("string").alias("span_id"), parent.cast("string").alias("parent_span_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms"))
    return trace.flattened(spans).select("span_id", F.md5("path").alias("path"), F.size(F.split("path", "[.]")).alias("depth"))


@query("SELECT event_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the traces of one segment's customers."""
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("trace_id"))
    return trace.by_id(_spans(spark, sf_dir), wanted).select(F.col("span_id").cast("long").alias("event_id"), F.col("name").alias("event_type"))


@query("SELECT epoch_us(time_bucket(INTERVAL 1 minute, ts)) AS at, event_type AS name, count(*) AS n, round(avg(value), 4) AS mean, round(max(value), 4) AS max FROM events GROUP BY 1, 2")
def windowed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's windowed statistics over a table, in which no row is late."""
    out = spans_stream.windowed_stats(_spans(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.unix_micros("window.start").alias("at"), "name", "n", F.round("mean", 4).alias("mean"), F.round("max", 4).alias("max"))
