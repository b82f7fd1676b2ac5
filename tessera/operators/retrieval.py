"""Vectors, score fusion, passages, assistants and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lexical import fold_sql, substring_rank, tokens_sql
from tessera.operators.relational import scope
from tessera.sources.tables import CHUNKS, DECISIONS, PARAGRAPHS, TRUSTED, chunks, decisions, paragraphs, table, trusted

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- vectors ---------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def calibrated(similarity: Column) -> Column:
    """A cosine between 0.55 and 0.9 as a score from 0 to 1."""
    return F.when(similarity <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity - 0.55) / 0.35)))


def fused(lexical: Column, similarity: Column, boosts: Column) -> Column:
    """The rerank score of a chunk."""
    raw = lexical * 0.42 + calibrated(similarity) * 0.23 + boosts
    return F.round(F.pow(F.greatest(F.lit(0.0), raw), F.lit(0.6)), 6)


#: The variants of a query: the first vector of each of these labels.
VARIANTS = (0, 1, 2)


def query_vectors(vectors: DataFrame) -> DataFrame:
    """(label, q): one vector for each variant, so a handful of rows."""
    wanted = vectors.where(F.col("label").isin(*VARIANTS))
    return wanted.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))


def best_similarity(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, similarity): the best over the query's variants, from 0 to 1.  The
    variants, a handful, go to every task as one row; no vector is shuffled."""
    asked = queries.agg(F.collect_list("q").alias("asked"))
    best = F.array_max(F.transform("asked", lambda q: cosine(F.col("embedding"), q)))
    found = vectors.crossJoin(F.broadcast(asked)).where(F.size("asked") > 0)
    return found.select("vec_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), best)), 6).alias("similarity"))


_SIMILAR = """q AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings WHERE label IN (0, 1, 2) GROUP BY label),
v AS (SELECT vec_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)))), 6) AS similarity FROM embeddings, q GROUP BY vec_id)"""


@query(f"WITH {_SIMILAR} SELECT vec_id, similarity FROM v ORDER BY similarity DESC, vec_id LIMIT 40")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest vectors to several variants of one query."""
    vectors = table(spark, sf_dir, "embeddings")
    return best_similarity(vectors, query_vectors(vectors)).orderBy(F.desc("similarity"), "vec_id").limit(40)


@query("""SELECT d.doc_id, e.vec_id IS NOT NULL AS present, CASE WHEN e.vec_id IS NULL THEN 'queued' ELSE 'completed' END AS state, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dimension FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def vector_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have a vector, and which a backfill would take."""
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("doc_id"), F.size("embedding").alias("d"))
    rows = table(spark, sf_dir, "documents", "doc_id").join(vectors, "doc_id", "left")
    present = F.col("d").isNotNull()
    return rows.select("doc_id", present.alias("present"), F.when(present, "completed").otherwise("queued").alias("state"), F.coalesce("d", F.lit(0)).alias("dimension"))


@query(f"""WITH {_SIMILAR}, l AS (SELECT doc_id, round(least(1.2::DOUBLE, len(regexp_extract_all(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)')) / 40.0::DOUBLE), 6) AS lexical FROM documents),
m AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(lexical, 0) AS lexical, coalesce(similarity, 0) AS similarity FROM l FULL JOIN v ON vec_id = doc_id)
SELECT id, lexical, similarity, round(pow(greatest(0.0::DOUBLE, 0.42::DOUBLE * lexical + 0.23::DOUBLE * CASE WHEN similarity <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (similarity - 0.55::DOUBLE) / 0.35::DOUBLE)) END
 + CASE WHEN similarity > 0 OR lexical > 0.3::DOUBLE THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END), 0.6::DOUBLE), 6) AS rerank FROM m""")
def calibrated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector candidates merged, calibrated and fused."""
    vectors = table(spark, sf_dir, "embeddings")
    similar = best_similarity(vectors, query_vectors(vectors)).withColumnRenamed("vec_id", "id")
    lexical = F.round(F.least(F.lit(1.2), tx.count_word(F.lower("text"), "the") / 40.0), 6)
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), lexical.alias("lexical")).join(similar, "id", "full")
    rows = rows.select("id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    trust = F.when((F.col("similarity") > 0) | (F.col("lexical") > 0.3), 0.02).otherwise(0.0)
    return rows.select("*", fused(F.col("lexical"), F.col("similarity"), trust).alias("rerank"))


# ---- ranking ---------------------------------------------------------------

#: Boost of a chunk type by intent, first pattern first.
INTENT_BOOSTS = {
    "authority": (("conclusions?_of_law", 0.22), ("authority|analysis", 0.16), ("findings?_of_fact|findings", 0.08), ("caption|issue_statement", -0.2)),
    "findings": (("findings?_of_fact|findings", 0.2), ("conclusions?_of_law", 0.12), ("analysis", 0.1), ("caption|issue_statement", -0.16)),
    "procedural": (("procedural|background|history|order|conclusions?_of_law", 0.2), ("caption|issue_statement", -0.18)),
    "analysis": (("conclusions?_of_law", 0.22), ("analysis|authority", 0.16), ("findings?_of_fact|findings", 0.1), ("caption|issue_statement", -0.18)),
    "disposition": (("holding|disposition|order|decision", 0.2), ("caption|issue_statement", -0.14)),
}


def intent_boost(intent: str, kind: Column) -> Column:
    found = None
    for pattern, boost in INTENT_BOOSTS.get(intent, ()):
        test = F.regexp_like(kind, F.lit(pattern))
        found = F.when(test, boost) if found is None else found.when(test, boost)
    return F.lit(0.0) if found is None else found.otherwise(0.0)


def section_boost(label: Column) -> Column:
    lowered = F.lower(label)
    return F.when(F.contains(lowered, F.lit("conclusions of law")), 0.24).when(F.contains(lowered, F.lit("findings of fact")), 0.14).otherwise(0.0)


_SLUG = "regexp_replace(lower(section_label), '[^a-z0-9]+', '_', 'g')"
_BOOST = "CASE " + " ".join(f"WHEN regexp_matches({_SLUG}, '{p}') THEN {b}::DOUBLE" for p, b in INTENT_BOOSTS["analysis"]) + " ELSE 0.0::DOUBLE END"


@query(f"""WITH {CHUNKS}, s AS (SELECT chunk_id, document_id, author, CASE WHEN section_label = 'Conclusions of Law' THEN 0.24::DOUBLE WHEN section_label = 'Findings of Fact' THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END AS section_boost, {_BOOST} AS intent_boost FROM chunks WHERE contains(lower(chunk_text), 'ertion')),
n AS (SELECT *, count(*) OVER (PARTITION BY document_id) AS n FROM s)
SELECT chunk_id, section_boost, intent_boost, round(least(0.12::DOUBLE, (n - 1) * 0.025::DOUBLE), 6) AS multi_match, round(-least(0.24::DOUBLE, (n - 1) * 0.03::DOUBLE), 6) AS repeat_penalty FROM n""")
def rank_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section, intent and repetition boosts of the chunks with a hit."""
    hits = chunks(decisions(spark, sf_dir)).where(F.contains(F.lower("chunk_text"), F.lit("ertion")))
    n = F.count("*").over(Window.partitionBy("document_id"))
    rows = hits.select("chunk_id", section_boost(F.col("section_label")).alias("section_boost"), intent_boost("analysis", tx.slug(F.col("section_label"))).alias("intent_boost"), n.alias("n"))
    return rows.select("chunk_id", "section_boost", "intent_boost", F.round(F.least(F.lit(0.12), (F.col("n") - 1) * 0.025), 6).alias("multi_match"), F.round(-F.least(F.lit(0.24), (F.col("n") - 1) * 0.03), 6).alias("repeat_penalty"))


@query(f"""WITH {CHUNKS}, s AS (SELECT document_id, chunk_id, section_label, round(length(chunk_text) / 500.0::DOUBLE + CASE WHEN contains(lower(chunk_text), 'the') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM chunks),
a AS (SELECT document_id, chunk_id AS authority FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN section_label = 'Conclusions of Law' THEN 1 ELSE 0 END DESC, score DESC, chunk_id) AS rn FROM s) WHERE rn = 1),
f AS (SELECT s.document_id, s.chunk_id AS fact, row_number() OVER (PARTITION BY s.document_id ORDER BY score DESC, s.chunk_id) AS rn FROM s JOIN a USING (document_id) WHERE s.chunk_id <> authority AND score >= 0.2::DOUBLE AND section_label <> 'Order')
SELECT document_id, authority, fact FROM a LEFT JOIN (SELECT * FROM f WHERE rn = 1) USING (document_id)""")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's authority passage, and the best acceptable other as its fact."""
    score = F.round(F.length("chunk_text") / 500.0 + F.when(F.contains(F.lower("chunk_text"), F.lit("the")), 0.5).otherwise(0.0), 6)
    rows = chunks(decisions(spark, sf_dir)).select("document_id", "chunk_id", "section_label", score.alias("score"))
    law = F.when(F.col("section_label") == "Conclusions of Law", 1).otherwise(0)
    w = Window.partitionBy("document_id")
    rows = rows.withColumn("authority", F.first("chunk_id").over(w.orderBy(law.desc(), F.desc("score"), "chunk_id")))
    acceptable = (F.col("chunk_id") != F.col("authority")) & (F.col("score") >= 0.2) & (F.col("section_label") != "Order")
    fact = F.min_by(F.when(acceptable, F.col("chunk_id")), F.when(acceptable, F.struct((-F.col("score")).alias("less"), "chunk_id")))
    return rows.groupBy("document_id").agg(F.min("authority").alias("authority"), fact.alias("fact"))


@query(f"""WITH {PARAGRAPHS}, h AS (SELECT id, paragraph_order, paragraph_text AS t, instr(lower(paragraph_text), 'ertion') AS pos FROM paragraphs)
SELECT id, paragraph_order, substr(t, CAST(greatest(1, pos - 60) AS BIGINT), 160) AS snippet, regexp_replace(substr(t, CAST(greatest(1, pos - 60) AS BIGINT), 160), '(?i)(ertion)', '<mark>\\1</mark>', 'g') AS highlighted FROM h WHERE pos > 0""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window around the first hit, and its marks."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", F.col("paragraph_text").alias("t"), F.instr(F.lower("paragraph_text"), "ertion").alias("at")).where("at > 0")
    snippet = F.substring(F.col("t"), F.greatest(F.lit(1), F.col("at") - 60), F.lit(160))
    return rows.select("id", "paragraph_order", snippet.alias("snippet"), F.regexp_replace(snippet, "(?i)(ertion)", "<mark>$1</mark>").alias("highlighted"))


_E2E_TERMS = ("ertion", "thention", "onthe")
_RANK = "round(" + " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {w}::DOUBLE ELSE 0 END" for t in _E2E_TERMS for c, w in (("title", 2.4), ("citation", 2.0), ("author", 1.9), ("section_label", 1.4), ("chunk_text", 1.0))) + ", 6)"


@query(f"""WITH {CHUNKS}, {TRUSTED}, {_SIMILAR},
h AS (SELECT c.*, {_RANK} AS lexical FROM chunks c WHERE jurisdiction = 'en' AND decision_date >= DATE '2024-01-15'),
s AS (SELECT h.document_id, chunk_id, citation, round(pow(greatest(0.0::DOUBLE, 0.42::DOUBLE * least(1.2::DOUBLE, lexical / 4.0::DOUBLE) + 0.23::DOUBLE * CASE WHEN coalesce(similarity, 0) <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (similarity - 0.55::DOUBLE) / 0.35::DOUBLE)) END
  + CASE WHEN section_label = 'Conclusions of Law' THEN 0.24::DOUBLE WHEN section_label = 'Findings of Fact' THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN t.document_id IS NOT NULL THEN 0.09::DOUBLE ELSE 0.02::DOUBLE END), 0.6::DOUBLE), 6) AS rerank
  FROM h LEFT JOIN v ON vec_id = h.document_id LEFT JOIN trusted t ON t.document_id = h.document_id WHERE lexical > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rerank DESC, chunk_id) AS rn, count(*) OVER (PARTITION BY document_id) AS n FROM s),
d AS (SELECT document_id, min(citation) AS citation, round(sum(rerank * CASE rn WHEN 1 THEN 1::DOUBLE WHEN 2 THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END) + least(0.12::DOUBLE, (max(n) - 1) * 0.025::DOUBLE), 6) AS score, min(CASE WHEN rn = 1 THEN chunk_id END) AS lead_chunk FROM r WHERE rn <= 3 GROUP BY document_id)
SELECT document_id, citation, score, lead_chunk FROM d ORDER BY score DESC, document_id LIMIT 20 OFFSET 20""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From scope to the second page: lexical and vector scores fused, documents
    ranked by their best chunks."""
    docs = decisions(spark, sf_dir).where(scope("en", since="2024-01-15"))
    vectors = table(spark, sf_dir, "embeddings")
    scoped = vectors.join(docs.select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    similar = best_similarity(scoped, query_vectors(vectors)).withColumnRenamed("vec_id", "document_id")
    active = trusted(spark, sf_dir).withColumn("active", F.lit(True))
    hits = chunks(docs).withColumn("lexical", substring_rank(_E2E_TERMS)).where("lexical > 0").join(similar, "document_id", "left").join(active, "document_id", "left")
    boosts = section_boost(F.col("section_label")) + F.when(F.col("active").isNotNull(), 0.09).otherwise(0.02)
    scored = hits.select("document_id", "chunk_id", "citation", fused(F.least(F.lit(1.2), F.col("lexical") / 4.0), F.coalesce("similarity", F.lit(0.0)), boosts).alias("rerank"))
    w = Window.partitionBy("document_id")
    top = scored.select("*", F.row_number().over(w.orderBy(F.desc("rerank"), "chunk_id")).alias("rn"), F.count("*").over(w).alias("n")).where("rn <= 3")
    weight = F.when(F.col("rn") == 1, 1.0).when(F.col("rn") == 2, 0.18).otherwise(0.08)
    found = top.groupBy("document_id").agg(F.min("citation").alias("citation"), F.round(F.sum(F.col("rerank") * weight) + F.least(F.lit(0.12), (F.max("n") - 1) * 0.025), 6).alias("score"), F.min(F.when(F.col("rn") == 1, F.col("chunk_id"))).alias("lead_chunk"))
    return found.orderBy(F.desc("score"), "document_id").offset(20).limit(20)


# ---- assistants ------------------------------------------------------------


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations),
u AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT r.conv_id, count(*) FILTER (WHERE back <= 8 AND trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '') AS kept_turns, md5(string_agg(CASE WHEN back <= 8 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) END, chr(10) ORDER BY turn)) AS digest, max(trim(regexp_replace(q, '\\s+', ' ', 'g'))) AS question FROM r LEFT JOIN u USING (conv_id) GROUP BY r.conv_id""")
def chat_recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread's last eight turns and its last question."""
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", squeezed.alias("t"))
    rows = rows.withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    recent = F.array_sort(F.collect_list(F.when(F.col("back") <= 8, F.struct("turn", "t"))))
    found = rows.groupBy("conv_id").agg(F.count_if((F.col("back") <= 8) & (F.col("t") != "")).alias("kept_turns"), recent.alias("recent"), F.max_by("t", F.when(F.col("role") == "user", F.col("turn"))).alias("question"))
    return found.select("conv_id", "kept_turns", F.md5(F.array_join(F.transform("recent", lambda r: r["t"]), "\n")).alias("digest"), "question")


_AUTHORITIES = f"""{CHUNKS}, a AS (SELECT chunk_id, section_label, {fold_sql('chunk_text')} AS f FROM chunks ORDER BY length(chunk_text) DESC, chunk_id LIMIT 8)"""


def _authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight retrieved authorities: a list of fixed length."""
    rows = chunks(decisions(spark, sf_dir)).orderBy(F.length("chunk_text").desc(), "chunk_id").limit(8)
    return rows.select("chunk_id", "section_label", tx.fold(F.col("chunk_text")).alias("f"))


@query(f"""WITH {_AUTHORITIES}, p0 AS (SELECT item_id, {tokens_sql('text')} AS l FROM benchmark), p AS (SELECT item_id, list_filter(l, lambda t, i: list_position(l, t) = i)[1:28] AS w FROM p0),
s AS (SELECT item_id, chunk_id, round(len(list_filter(w, lambda t: contains(f, t))) / CAST(len(w) AS DOUBLE) + CASE WHEN section_label = 'Conclusions of Law' THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END, 6) AS score FROM p, a WHERE len(w) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rn FROM s WHERE score > 0.08::DOUBLE)
SELECT item_id, chunk_id, score, rn FROM r WHERE rn <= 3""")
def paragraph_support_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three authorities that support each paragraph most."""
    words = F.slice(F.array_distinct(tx.tokens(F.col("text"))), 1, 28)
    asked = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where("size(w) > 0")
    pairs = asked.crossJoin(F.broadcast(_authorities(spark, sf_dir)))
    hits = F.size(F.filter("w", lambda t: F.contains(F.col("f"), t)))
    score = F.round(hits / F.size("w") + F.when(F.col("section_label") == "Conclusions of Law", 0.14).otherwise(0.0), 6)
    rows = pairs.select("item_id", "chunk_id", score.alias("score")).where("score > 0.08")
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "chunk_id")
    return rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3").withColumn("rn", F.col("rn").cast("bigint"))


_OUTCOMES = {"grant": ("ing", "oner"), "deny": ("les", "tion "), "partial": ("und", "para")}


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found |= F.contains(text, F.lit(w))
    return found


@query(f"""WITH {DECISIONS}, c AS (SELECT author, count(*) AS n, count(*) FILTER (WHERE contains(lower(title), 'ing') OR contains(lower(title), 'oner')) AS g, count(*) FILTER (WHERE contains(lower(title), 'les') OR contains(lower(title), 'tion ')) AS d, count(*) FILTER (WHERE contains(lower(title), 'und') OR contains(lower(title), 'para')) AS p FROM decisions GROUP BY author)
SELECT author, n, CASE WHEN g + d + p = 0 THEN 'unclear' WHEN abs(g - d) <= 1 AND g > 0 AND d > 0 THEN CASE WHEN p > 0 THEN 'partial' ELSE 'unclear' END WHEN p >= g AND p >= d THEN 'partial' WHEN g > d THEN 'grant' ELSE 'deny' END AS direction,
round(CASE WHEN greatest(g, d, p) = 0 THEN 0.7::DOUBLE ELSE least(1.0::DOUBLE, (g + d + p - greatest(g, d, p)) / CAST(greatest(g, d, p) AS DOUBLE)) END, 6) AS conflict FROM c""")
def direction_and_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vote of authorities and how far they are apart."""
    t = F.lower("title")
    votes = decisions(spark, sf_dir).groupBy("author").agg(F.count("*").alias("n"), *[F.count_if(_any(t, words)).alias(name) for name, words in _OUTCOMES.items()])
    g, d, p = (F.col(c) for c in _OUTCOMES)
    split = (F.abs(g - d) <= 1) & (g > 0) & (d > 0)
    direction = F.when(g + d + p == 0, "unclear").when(split & (p > 0), "partial").when(split, "unclear").when((p >= g) & (p >= d), "partial").when(g > d, "grant").otherwise("deny")
    most = F.greatest(g, d, p)
    conflict = F.when(most == 0, 0.7).otherwise(F.least(F.lit(1.0), (g + d + p - most) / most))
    return votes.select("author", "n", direction.alias("direction"), F.round(conflict, 6).alias("conflict"))


@query(f"""WITH {CHUNKS}, s AS (SELECT author, count(*) AS n, count(*) FILTER (WHERE section_label = 'Conclusions of Law') AS direct, count(*) FILTER (WHERE contains(chunk_text, 'the')) AS explicit FROM chunks GROUP BY author),
g AS (SELECT author, n, direct, round(explicit / CAST(n AS DOUBLE), 6) AS explicit_ratio FROM s),
c AS (SELECT *, round(least(1.0::DOUBLE, n / 800.0::DOUBLE) * 0.35::DOUBLE + least(1.0::DOUBLE, direct / 300.0::DOUBLE) * 0.2::DOUBLE + explicit_ratio * 0.2::DOUBLE, 4) AS strength FROM g)
SELECT author, explicit_ratio, strength, CASE WHEN n < 200 THEN 'low' WHEN strength >= 0.55::DOUBLE THEN 'high' WHEN strength >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS confidence,
array_to_string(list_filter([CASE WHEN n < 300 THEN 'sparse_authority' END, CASE WHEN direct = 0 THEN 'no_direct_conclusions' END, CASE WHEN explicit_ratio < 0.35::DOUBLE THEN 'thin_support' END], lambda x: x IS NOT NULL), ',') AS limitations FROM c""")
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals, confidence and limitations of a draft's support."""
    rows = chunks(decisions(spark, sf_dir)).groupBy("author").agg(F.count("*").alias("n"), F.count_if(F.col("section_label") == "Conclusions of Law").alias("direct"), F.count_if(F.contains("chunk_text", F.lit("the"))).alias("explicit"))
    rows = rows.withColumn("explicit_ratio", F.round(F.col("explicit") / F.col("n"), 6))
    one = F.lit(1.0)
    rows = rows.withColumn("strength", F.round(F.least(one, F.col("n") / 800.0) * 0.35 + F.least(one, F.col("direct") / 300.0) * 0.2 + F.col("explicit_ratio") * 0.2, 4))
    sure = F.when(F.col("n") < 200, "low").when(F.col("strength") >= 0.55, "high").when(F.col("strength") >= 0.4, "medium").otherwise("low")
    limits = F.array_compact(F.array(F.when(F.col("n") < 300, "sparse_authority"), F.when(F.col("direct") == 0, "no_direct_conclusions"), F.when(F.col("explicit_ratio") < 0.35, "thin_support")))
    return rows.select("author", "explicit_ratio", "strength", sure.alias("confidence"), F.array_join(limits, ",").alias("limitations"))


@query(f"""WITH {CHUNKS}, m AS (SELECT document_id, section_label, round(length(chunk_text) / 400.0::DOUBLE, 6) AS score, 'q1' AS q FROM chunks WHERE contains(lower(chunk_text), 'ertion') UNION ALL SELECT document_id, section_label, round(length(chunk_text) / 300.0::DOUBLE, 6), 'q2' FROM chunks WHERE contains(lower(chunk_text), 'onthe')),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, q, section_label) AS rn FROM m)
SELECT section_label AS theme, count(*) AS n, round(max(score), 6) AS best FROM r WHERE rn = 1 GROUP BY section_label ORDER BY n DESC, theme LIMIT 3""")
def merged_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries merged by best score, and the sections they rest on."""
    rows = chunks(decisions(spark, sf_dir)).select("document_id", "section_label", "chunk_text")
    lowered = F.lower("chunk_text")
    one = rows.where(F.contains(lowered, F.lit("ertion"))).select("document_id", "section_label", F.round(F.length("chunk_text") / 400.0, 6).alias("score"), F.lit("q1").alias("q"))
    two = rows.where(F.contains(lowered, F.lit("onthe"))).select("document_id", "section_label", F.round(F.length("chunk_text") / 300.0, 6).alias("score"), F.lit("q2").alias("q"))
    best = one.unionByName(two).groupBy("document_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "q", "section_label")).alias("b"))
    found = best.groupBy(F.col("b.section_label").alias("theme")).agg(F.count("*").alias("n"), F.round(F.max(-F.col("b.less")), 6).alias("best"))
    return found.orderBy(F.desc("n"), "theme").limit(3)


# ---- evaluation ------------------------------------------------------------

_RESULTS = """j AS (SELECT DISTINCT doc_id, quality FROM labels), r AS (SELECT lang AS query_id, d.doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, d.doc_id) AS rank, coalesce(quality, 0) AS grade, source FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id)"""


def _results(spark: SparkSession, sf_dir: str, newest: bool = False) -> DataFrame:
    """A run: for each language as query, documents by length (or id) to rank 20."""
    judged = table(spark, sf_dir, "labels", "doc_id", "quality").distinct()
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars", "source").join(judged, "doc_id", "left")
    order = [F.desc("doc_id")] if newest else [F.desc("n_chars"), F.asc("doc_id")]
    w = Window.partitionBy("lang").orderBy(*order)
    rows = docs.select(F.col("lang").alias("query_id"), "doc_id", F.row_number().over(w).alias("rank"), F.coalesce("quality", F.lit(0)).alias("grade"), "source")
    return rows.where("rank <= 20")


@query(f"""WITH {_RESULTS} SELECT query_id, round(count(*) FILTER (WHERE rank <= 5 AND grade > 0) / 5.0::DOUBLE, 4) AS p_at_5, round(coalesce(1.0::DOUBLE / min(CASE WHEN grade > 0 THEN rank END), 0.0::DOUBLE), 4) AS mrr FROM r WHERE rank <= 20 GROUP BY query_id""")
def p_at_5_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.when(F.col("grade") > 0, F.col("rank")))
    return _results(spark, sf_dir).groupBy("query_id").agg(F.round(F.count_if((F.col("rank") <= 5) & (F.col("grade") > 0)) / 5.0, 4).alias("p_at_5"), F.round(F.coalesce(1.0 / first, F.lit(0.0)), 4).alias("mrr"))


@query(f"""WITH {_RESULTS}, b AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rank FROM documents)
SELECT coalesce(x.query_id, y.query_id) AS query_id, count(*) FILTER (WHERE y.doc_id IS NULL) AS dropped, count(*) FILTER (WHERE x.doc_id IS NULL) AS added, count(*) FILTER (WHERE x.rank <> y.rank) AS moved, count(*) FILTER (WHERE x.rank = y.rank) = 20 AS golden
FROM (SELECT * FROM r WHERE rank <= 20) x FULL JOIN (SELECT * FROM b WHERE rank <= 20) y ON x.query_id = y.query_id AND x.doc_id = y.doc_id GROUP BY 1""")
def ranking_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs' top twenty: dropped, added and moved; golden if all the same."""
    left = _results(spark, sf_dir).select("query_id", "doc_id", F.col("rank").alias("x"))
    right = _results(spark, sf_dir, newest=True).select("query_id", "doc_id", F.col("rank").alias("y"))
    rows = left.join(right, ["query_id", "doc_id"], "full")
    return rows.groupBy("query_id").agg(F.count_if(F.col("y").isNull()).alias("dropped"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("x") != F.col("y")).alias("moved"), (F.count_if(F.col("x") == F.col("y")) == 20).alias("golden"))


@query(f"""WITH {_RESULTS}, t AS (SELECT * FROM r WHERE rank <= 10), s AS (SELECT query_id, source, count(*) AS n FROM t GROUP BY query_id, source), d AS (SELECT query_id, max(n) AS most, count(*) AS sources FROM s GROUP BY query_id)
SELECT t.query_id, round(30 * avg(CASE WHEN grade > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 15 * avg(CASE WHEN source IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 10 * max(sources) / 10.0::DOUBLE + 10 * (1 - max(most) / 10.0::DOUBLE), 2) AS quality_score, round(max(most) / 10.0::DOUBLE, 4) AS concentration,
round(30 * avg(CASE WHEN grade > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 15 * avg(CASE WHEN source IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) + 10 * max(sources) / 10.0::DOUBLE + 10 * (1 - max(most) / 10.0::DOUBLE), 2) >= 50 AND max(most) <= 4 AS passed FROM t JOIN d USING (query_id) GROUP BY t.query_id""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's weighted quality score, concentration and gate."""
    top = _results(spark, sf_dir).where("rank <= 10")
    spread = top.groupBy("query_id", "source").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("good"), F.count("source").alias("known"))
    rows = spread.groupBy("query_id").agg(F.max("n").alias("most"), F.count("*").alias("sources"), F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("known").alias("known"))
    score = F.round(30 * (F.col("good") / F.col("n")) + 15 * (F.col("known") / F.col("n")) + 10 * F.col("sources") / 10.0 + 10 * (1 - F.col("most") / 10.0), 2)
    rows = rows.withColumn("quality_score", score)
    return rows.select("query_id", "quality_score", F.round(F.col("most") / 10.0, 4).alias("concentration"), ((F.col("quality_score") >= 50) & (F.col("most") <= 4)).alias("passed"))


@query("""WITH k AS (SELECT unnest(['ertion', 'thention', 'und', 'que', 'zzqx']) AS keyword), c AS (SELECT keyword, count(*) FILTER (WHERE contains(lower(text), keyword)) AS corpus, count(*) FILTER (WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || keyword || '([^a-z0-9]|$)')) AS api FROM k, documents GROUP BY keyword)
SELECT keyword, corpus, api, round(CASE WHEN corpus = 0 THEN 1.0::DOUBLE ELSE api / CAST(corpus AS DOUBLE) END, 4) AS ratio FROM c""")
def keyword_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word results against substring occurrences, for fixed keywords, in
    one pass."""
    words = ("ertion", "thention", "und", "que", "zzqx")
    t = F.lower("text")
    counts = [F.struct(F.lit(w).alias("keyword"), F.count_if(F.contains(t, F.lit(w))).alias("corpus"), F.count_if(tx.has_word(t, w)).alias("api")) for w in words]
    rows = table(spark, sf_dir, "documents", "text").agg(F.array(*counts).alias("all")).select(F.inline("all"))
    return rows.select("*", F.round(F.when(F.col("corpus") == 0, 1.0).otherwise(F.col("api") / F.col("corpus")), 4).alias("ratio"))


# ---- queues and limits -----------------------------------------------------


@query("""SELECT user_id, time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY 1, 2""")
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a client in fixed windows, and where they pass a limit."""
    rows = table(spark, sf_dir, "events", "user_id", "ts").groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > 1).alias("limited"))


_STATES = {"click": "queued", "view": "processing", "purchase": "completed", "signup": "failed"}


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'processing' WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN 'failed' ELSE 'queued' END AS state FROM events),
l AS (SELECT user_id, arg_max(state, (ts, event_id)) AS state, max(ts) AS last_ts, count(*) FILTER (WHERE state = 'failed') AS attempts FROM s GROUP BY user_id)
SELECT user_id, state, attempts, state = 'queued' AND last_ts < TIMESTAMP '2024-01-30 00:00:00' AS requeue, CASE WHEN state <> 'failed' THEN NULL WHEN attempts > 4 THEN 0 ELSE least(60 * CAST(pow(2, attempts) AS BIGINT), 3600) END AS backoff FROM l""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by their latest event: state, attempts, stale ones and back-off."""
    pairs = [F.lit(x) for kv in _STATES.items() for x in kv]
    state = F.coalesce(F.create_map(*pairs)[F.col("event_type")], F.lit("queued"))
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").withColumn("state", state)
    latest = rows.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count_if(F.col("state") == "failed").alias("attempts"))
    stale = (F.col("state") == "queued") & (F.col("at") < F.lit("2024-01-30").cast("timestamp"))
    backoff = F.when(F.col("state") == "failed", F.when(F.col("attempts") > 4, 0).otherwise(F.least(60 * F.pow(F.lit(2), F.col("attempts")).cast("bigint"), F.lit(3600)))).cast("bigint")
    return latest.select("user_id", "state", "attempts", stale.alias("requeue"), backoff.alias("backoff"))
