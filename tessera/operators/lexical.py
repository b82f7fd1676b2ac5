"""Full-text operators over chunks: substring and whole-word scans, postings,
BM25, concept groups, phrases and coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import postings as index
from tessera.plans.lineage import settle
from tessera.sources import tables as tb

#: Weights of a term's hit by field.
WEIGHTS = {"title": 2.4, "citation": 2.0, "author": 1.9, "section_label": 1.4, "chunk_text": 1.0}

_FOLD = "trim(regexp_replace(strip_accents(lower({})), '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def fold_sql(column: str) -> str:
    return _FOLD.format(column)


def tokens_sql(column: str) -> str:
    return f"list_filter(string_split_regex({fold_sql(column)}, '[^a-z0-9_:-]+'), lambda t: length(t) > 1)"


def substring_rank(terms: Sequence[str], columns: dict[str, Column] | None = None) -> Column:
    """Sum over terms and fields of the field's weight where the term occurs."""
    hits = [F.when(F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())), w).otherwise(0.0) for t in terms for c, w in WEIGHTS.items()]
    return F.round(reduce(lambda a, b: a + b, hits), 6)


def substring_match(terms: Sequence[str]) -> Column:
    """Whether any term occurs in chunk, citation, title or author."""
    return reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())) for t in terms for c in ("chunk_text", "citation", "title", "author")])


def word_rank(terms: Sequence[str]) -> Column:
    """The same by whole words; citation and section still by substring."""
    out = []
    for t in terms:
        for c, w in WEIGHTS.items():
            hit = F.contains(F.lower(F.col(c)), F.lit(t)) if c in ("citation", "section_label") else F.contains(tx.padded(F.col(c)), F.lit(f" {t} "))
            out.append(F.when(hit, w).otherwise(0.0))
    return F.round(reduce(lambda a, b: a + b, out), 6)


def postings(chunks: DataFrame, columns: Sequence[str] = ("section_label", "chunk_text")) -> DataFrame:
    """(chunk_id, token, tf, length): one row for each token of each chunk."""
    words = tx.tokens(F.concat_ws(" ", *columns))
    listed = chunks.select("chunk_id", words.alias("words"))
    listed = listed.select("chunk_id", F.size("words").alias("length"), F.explode("words").alias("token"))
    return listed.groupBy("chunk_id", "length", "token").agg(F.count("*").alias("tf"))


def document_frequency(postings_: DataFrame) -> DataFrame:
    """(token, df)."""
    return postings_.groupBy("token").agg(F.count("*").alias("df"))


def bm25(chunks: DataFrame, terms: Sequence[str], k1: float = index.K1, b: float = index.B) -> DataFrame:
    """(chunk_id, score) of the chunks with any of the terms.  Only the terms'
    postings are shuffled, and kept, for their frequencies; the corpus is scanned
    once, and its totals are observed on the way."""
    words = tx.tokens(F.concat_ws(" ", "section_label", "chunk_text"))
    totals = Observation()
    sized = chunks.select("chunk_id", words.alias("words")).withColumn("length", F.size("words"))
    sized = sized.observe(totals, F.count("*").alias("n"), F.sum("length").alias("words"))
    hits = sized.where(F.arrays_overlap("words", F.array(*map(F.lit, terms)))).select("chunk_id", "length", F.explode("words").alias("token"))
    hits = settle(hits.where(F.col("token").isin(*terms)).groupBy("chunk_id", "length", "token").agg(F.count("*").alias("tf")))
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    if hits.isEmpty():  # then nothing may have been observed
        return hits.select("chunk_id", F.lit(0.0).alias("score"))
    scored = hits.join(F.broadcast(df), "token")
    n, mean = totals.get["n"], (totals.get["words"] or 0) / max(totals.get["n"], 1)
    idf = F.log(F.lit(1.0) + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    return scored.groupBy("chunk_id").agg(F.round(F.sum(part), 6).alias("score"))


def matched_groups(chunks: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """chunks with ``matched``: how many groups of variants have a token there.
    A threshold on it is a tier of a relaxed conjunction."""
    words = tx.tokens(F.concat_ws(" ", "section_label", "chunk_text"))
    hits = [F.arrays_overlap("__words", F.array(*map(F.lit, g))).cast("int") for g in groups]
    return chunks.withColumn("__words", words).withColumn("matched", reduce(lambda a, b: a + b, hits)).drop("__words")


TERMS = ("tion", "ment", "src1")
WORDS = ("the", "and", "les", "der")
GROUPS = (("the", "les"), ("and", "und"), ("with", "pour"), ("ertion",))


def lexical_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring scan of document and retrieval chunks, by weighted rank."""
    docs = tb.decisions(spark, sf_dir)
    chunks = tb.chunks(docs)
    active = tb.trusted(spark, sf_dir)
    retrieval = chunks.join(active, "document_id", "left_semi").withColumn("source_kind", F.lit("retrieval"))
    both = chunks.withColumn("source_kind", F.lit("document")).unionByName(retrieval)
    hits = both.where(substring_match(TERMS)).withColumn("lexical_rank", substring_rank(TERMS))
    return hits.orderBy(F.desc("lexical_rank"), F.desc("decision_date"), "order_rank", "chunk_id", "source_kind").limit(50).select("source_kind", "chunk_id", "document_id", "citation", "order_rank", "lexical_rank")


def _rank_sql(terms: Sequence[str]) -> str:
    return "round(" + " + ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{t}') THEN {w}::DOUBLE ELSE 0 END" for t in terms for c, w in WEIGHTS.items()) + ", 6)"


def _padded_sql(c: str) -> str:
    return f"(' ' || lower(translate(coalesce({c}, ''), chr(10) || chr(13) || '.,;:()-/', '          ')) || ' ')"


def whole_word_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word scan: the best chunk rank of each document that has a hit."""
    chunks = tb.chunks(tb.decisions(spark, sf_dir))
    hits = chunks.withColumn("rank", word_rank(WORDS)).where("rank > 0")
    return hits.groupBy("document_id").agg(F.max("rank").alias("best_rank"), F.count("*").alias("n_chunks"))


def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every token, with those too common for a query."""
    found = index.at_hand(spark, sf_dir).frequencies()
    return found.select("token", "df", (F.col("df") > 500).alias("common"))


def index_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored index holds of every token: chunks, occurrences, the most in a
    chunk, and the first and last chunk."""
    found = index.postings_of(index.of_tables(spark, sf_dir).rows)
    last = F.max(F.element_at("places", -1).cast("long")).alias("last_place")
    return found.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"), F.max(F.col("tf").cast("long")).alias("most"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"), last)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.bm25(index.of_tables(spark, sf_dir), ("the", "und", "ertion", "thention"), 50)


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = index.matched_groups(index.of_tables(spark, sf_dir), GROUPS)
    return found.select("chunk_id", index.document_of(F.col("chunk_id")).alias("document_id"), "matched")


def and_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relaxed conjunction: the chunks of the highest tier that has any."""
    found = settle(_matched(spark, sf_dir).where("matched >= 2"), narrow=True)
    top = found.agg(F.max("matched").alias("tier"))
    return found.join(F.broadcast(top), found["matched"] == top["tier"]).select("chunk_id", "document_id", "tier")


def relaxed_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks and documents each tier of the conjunction admits."""
    tiers = _matched(spark, sf_dir).select("document_id", "chunk_id", F.explode(F.sequence(F.lit(1), F.col("matched"))).alias("tier"))
    return tiers.groupBy("tier").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"))


PHRASES = (("in", "the"), ("the", "and", "of"), ("findings", "of", "fact"), ("und", "und"), ("the", "the", "the"))


def phrase_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often chunks have the tokens of each phrase side by side."""
    stored = index.of_tables(spark, sf_dir)
    found = [index.phrase(stored, words).select(F.lit(" ".join(words)).alias("phrase"), "chunk_id", "n_hits") for words in PHRASES]
    return reduce(DataFrame.unionByName, found)


def prefix_any_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a token that starts with any of some prefixes."""
    words = tx.tokens(F.col("chunk_text"))
    hit = F.exists(words, lambda w: F.startswith(w, F.lit("ouz")) | F.startswith(w, F.lit("thent")) | F.startswith(w, F.lit("keit")))
    found = tb.chunks(tb.decisions(spark, sf_dir)).where(hit)
    return found.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


def _grams(words: str, n: int) -> Column:
    """All runs of n tokens, in order."""
    return F.expr(f"CASE WHEN size({words}) >= {n} THEN transform(sequence(1, size({words}) - {n - 1}), i -> array_join(slice({words}, i, {n}), ' ')) ELSE array() END")


def phrase_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent tokens: where documents have all of an item's, in order.  A place where
    an item begins has all its runs of three tokens, or all tokens of a shorter one, at
    their distances from it: these are counted, so documents are read once."""
    items = tb.table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("wanted")).where("size(wanted) > 0").select("item_id", "wanted", F.least(F.size("wanted"), F.lit(3)).alias("n"))
    sizes = sorted(r.n for r in items.select("n").distinct().collect())
    grams = lambda words: F.coalesce(*[F.when(F.col("n") == n, _grams(words, n)) for n in (1, 2, 3)])
    keyed = items.withColumn("grams", grams("wanted")).select("item_id", "n", F.size("grams").alias("runs"), F.posexplode("grams").alias("offset", "gram"))
    docs = tb.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.tokens(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, sizes))).alias("n"))
    placed = docs.select("doc_id", "n", F.posexplode(grams("w")).alias("at", "gram"))
    starts = placed.join(keyed, ["n", "gram"]).groupBy("item_id", "doc_id", "runs", (F.col("at") - F.col("offset")).alias("start")).agg(F.count("*").alias("found"))
    return starts.where("found = runs").groupBy("item_id", "doc_id").agg(F.count("*").alias("n_hits"))


COVERAGE = (("the", "les"), ("and", "und"), ("that", "dans"))


def phrase_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concept coverage, proximity and score of an exact or partial phrase."""
    chunks = tb.chunks(tb.decisions(spark, sf_dir)).select("chunk_id", tx.fold(F.col("chunk_text")).alias("folded"))
    found = tx.coverage(F.col("places"), len(COVERAGE))
    rows = chunks.withColumn("places", tx.places(F.col("folded"), COVERAGE)).where("size(places) > 0").select("chunk_id", *[c.cast("double").alias(n) if n != "matched" else c.cast("long").alias(n) for n, c in found.items()], tx.has_word(F.col("folded"), "the and that").alias("exact"))
    score = F.when(F.col("exact"), 0.68).when(F.col("matched") >= len(COVERAGE), F.col("proximity") + 0.2).when(F.col("matched") >= 2, F.col("proximity") + 0.08).otherwise(0.0)
    return rows.withColumn("phrase_score", F.round(score, 6))


def _position_sql(term: str) -> str:
    p = tx.word_pattern(term)
    hit = f"regexp_extract(folded, '{p}', 0)"
    return f"CASE WHEN regexp_matches(folded, '{p}') THEN instr(folded, {hit}) - 1 + CASE WHEN regexp_matches({hit}, '^[^a-z0-9]') THEN 1 ELSE 0 END ELSE -1 END"


def _group_sql(group: Sequence[str]) -> str:
    return "coalesce(list_min(list_filter([" + ", ".join(_position_sql(v) for v in group) + "], lambda p: p >= 0)), -1)"


def sentence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of an item's meaningful tokens, all of them, that a document
    has, for every pair that scores.  A run that scores holds five tokens in a row:
    each five are looked up by the rarest of them, and the others then joined."""
    long = lambda c: F.filter(tx.tokens(c), lambda t: (F.length(t) > 2) & ~F.array_contains(F.array(*map(F.lit, tx.STOPWORDS)), t))
    items = tb.table(spark, sf_dir, "benchmark").select("item_id", long(F.col("text")).alias("wanted")).where("size(wanted) >= 5")
    places = items.select("item_id", F.posexplode("wanted").alias("place", "token"))
    words = tb.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(long(F.col("text")))).alias("token"))
    words = settle(words.join(places.select("token").distinct(), "token", "left_semi"), narrow=True)
    counts = words.groupBy("token").agg(F.count("*").alias("df"))
    owners = items.select("item_id", F.explode(F.expr("transform(sequence(1, size(wanted) - 4), i -> array_sort(array_distinct(slice(wanted, i, 5))))")).alias("five")).distinct()
    known = owners.select("five", F.explode("five").alias("token")).distinct().join(counts, "token")
    keys = known.groupBy("five").agg(F.min_by("token", F.struct("df", "token")).alias("token"), F.count("*").alias("n")).where("n = size(five)").select("token", "five")
    begun = words.join(keys, "token").select("doc_id", "five", F.size("five").alias("n"), F.explode("five").alias("token"))
    hits = begun.join(words, ["doc_id", "token"]).groupBy("doc_id", "five", "n").agg(F.count("*").alias("found")).where("found = n").select("doc_id", "five")
    pairs = hits.join(owners, "five").select("item_id", "doc_id").distinct()
    # places in a row keep their distance from their rank among those found
    found = pairs.join(places, "item_id").join(words, ["doc_id", "token"]).select("item_id", "doc_id", "place").distinct()
    ranked = found.withColumn("run", F.col("place") - F.row_number().over(Window.partitionBy("item_id", "doc_id").orderBy("place")))
    runs = ranked.groupBy("item_id", "doc_id", "run").agg(F.count("*").alias("n")).groupBy("item_id", "doc_id").agg(F.max("n").alias("run"))
    return runs.withColumn("overlap", F.when(F.col("run") >= 8, 0.12).when(F.col("run") >= 6, 0.08).otherwise(0.05))


def in_memory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage, density and phrase of a query's terms in each document."""
    terms = ("the", "and", "that", "les")
    docs = tb.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", tx.fold(F.col("text")).alias("folded"))
    hits = reduce(lambda a, b: a + b, [tx.has_word(F.col("folded"), t).cast("int") for t in terms])
    times = reduce(lambda a, b: a + b, [tx.count_word(F.col("folded"), t) for t in terms])
    phrase = F.when(tx.has_word(F.col("folded"), "the and that"), 0.18).otherwise(0.0)
    score = hits / len(terms) * 0.75 + F.least(F.lit(1.0), times / (len(terms) * 2)) * 0.25 + phrase
    return docs.select("doc_id", hits.cast("long").alias("hits"), times.cast("long").alias("occurrences"), F.round(F.least(F.lit(1.2), score), 6).alias("score"))


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planner's view of queries: lexical and phrase tokens, spelling, quotes.
    Conversation turns serve as queries."""
    q = tb.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    c = F.col("text")
    return q.select("conv_id", "turn", F.array_join(tx.lexical_tokens(c), " ").alias("lexical"), F.array_join(tx.phrase_tokens(c), " ").alias("phrase"), tx.slug(c).alias("slug"), tx.phrase_literal(c).alias("literal"))


_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
_DISTINCT = "list_filter({l}, lambda t, i: list_position({l}, t) = i)"

QUERIES = {f.__name__: f for f in (lexical_rank_topk, whole_word_rank, token_df, bm25_topk, and_of_groups, relaxed_tiers, prefix_any_token, phrase_adjacency, phrase_coverage, sentence_overlap, in_memory_score, query_terms, index_contents, phrase_in_chunks)}

_ANY = " OR ".join(f"contains(lower(coalesce({c}, '')), '{t}')" for t in TERMS for c in ("chunk_text", "citation", "title", "author"))
_WORD = "round(" + " + ".join(f"CASE WHEN {f'contains(lower({c}), {chr(39)}{t}{chr(39)})' if c in ('citation', 'section_label') else f'contains({_padded_sql(c)}, {chr(39)} {t} {chr(39)})'} THEN {w}::DOUBLE ELSE 0 END" for t in WORDS for c, w in WEIGHTS.items()) + ", 6)"
_WORDS_OF_CHUNK = tokens_sql("concat_ws(' ', section_label, chunk_text)")
_MATCHED = " + ".join(f"CAST(list_has_any(w, [{', '.join(repr(v) for v in g)}]) AS INTEGER)" for g in GROUPS)

SQL = {
    "lexical_rank_topk": f"""
WITH {tb.CHUNKS}, {tb.TRUSTED},
u AS (SELECT 'document' AS source_kind, * FROM chunks UNION ALL SELECT 'retrieval', * FROM chunks WHERE document_id IN (SELECT document_id FROM trusted))
SELECT source_kind, chunk_id, document_id, citation, order_rank, {_rank_sql(TERMS)} AS lexical_rank FROM u WHERE {_ANY}
ORDER BY lexical_rank DESC, decision_date DESC, order_rank, chunk_id, source_kind LIMIT 50""",
    "whole_word_rank": f"""
WITH {tb.CHUNKS}, r AS (SELECT document_id, {_WORD} AS rank FROM chunks)
SELECT document_id, max(rank) AS best_rank, count(*) AS n_chunks FROM r WHERE rank > 0 GROUP BY document_id""",
    "token_df": f"""
WITH {tb.CHUNKS}, t AS (SELECT DISTINCT chunk_id, unnest({_WORDS_OF_CHUNK}) AS token FROM chunks)
SELECT token, count(*) AS df, count(*) > 500 AS common FROM t GROUP BY token""",
    "bm25_topk": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, {_WORDS_OF_CHUNK} AS w FROM chunks), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
h AS (SELECT chunk_id, len(w) AS l, unnest(['the', 'und', 'ertion', 'thention']) AS token, w FROM w),
t AS (SELECT chunk_id, l, token, len(list_filter(w, lambda x: x = token)) AS tf FROM h WHERE list_contains(w, token)),
d AS (SELECT token, count(*) AS df FROM t GROUP BY token)
SELECT chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))), 6) AS score
FROM t JOIN d USING (token), s GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 50""",
    "and_of_groups": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, document_id, {_WORDS_OF_CHUNK} AS w FROM chunks), m AS (SELECT chunk_id, document_id, {_MATCHED} AS matched FROM w)
SELECT chunk_id, document_id, matched AS tier FROM m WHERE matched >= 2 AND matched = (SELECT max(matched) FROM m)""",
    "relaxed_tiers": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, document_id, {_WORDS_OF_CHUNK} AS w FROM chunks), m AS (SELECT document_id, {_MATCHED} AS matched FROM w)
SELECT CAST(tier AS INTEGER) AS tier, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents FROM m, range(1, 5) t(tier) WHERE tier <= matched GROUP BY tier""",
    "prefix_any_token": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, document_id, {tokens_sql('chunk_text')} AS w FROM chunks)
SELECT document_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM w WHERE len(list_filter(w, lambda t: starts_with(t, 'ouz') OR starts_with(t, 'thent') OR starts_with(t, 'keit'))) > 0 GROUP BY document_id""",
    "phrase_adjacency": f"""
WITH i AS (SELECT item_id, wanted, least(len(wanted), 3) AS n FROM (SELECT item_id, {tokens_sql('text')} AS wanted FROM benchmark) WHERE len(wanted) > 0),
d AS (SELECT doc_id, {tokens_sql('text')} AS w FROM documents),
g AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
SELECT item_id, doc_id, count(*) AS n_hits FROM g JOIN i ON i.n = g.n AND array_to_string(w[k:k + g.n - 1], ' ') = array_to_string(wanted[1:i.n], ' ')
WHERE w[k:k + len(wanted) - 1] = wanted GROUP BY item_id, doc_id""",
    "index_contents": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, {_WORDS_OF_CHUNK} AS w FROM chunks),
t AS (SELECT chunk_id, unnest(w) AS token, unnest(range(len(w))) AS place FROM w),
c AS (SELECT token, chunk_id, count(*) AS tf, max(place) AS place FROM t GROUP BY token, chunk_id)
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS most, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, max(place) AS last_place FROM c GROUP BY token""",
    "phrase_in_chunks": f"""
WITH {tb.CHUNKS}, w AS (SELECT chunk_id, {_WORDS_OF_CHUNK} AS w FROM chunks), q AS (SELECT unnest([{", ".join(repr(list(p)) for p in PHRASES)}]) AS p),
h AS (SELECT array_to_string(p, ' ') AS phrase, chunk_id, CAST(len(list_filter(range(1, len(w) - len(p) + 2), lambda k: w[k:k + len(p) - 1] = p)) AS BIGINT) AS n_hits FROM w, q WHERE list_contains(w, p[1]))
SELECT * FROM h WHERE n_hits > 0""",
    "phrase_coverage": f"""
WITH {tb.CHUNKS}, f AS (SELECT chunk_id, {fold_sql('chunk_text')} AS folded FROM chunks),
p AS (SELECT chunk_id, folded, list_filter([{', '.join(_group_sql(g) for g in COVERAGE)}], lambda x: x >= 0) AS p FROM f),
c AS (SELECT chunk_id, CAST(len(p) AS BIGINT) AS matched, round(len(p) / 3.0::DOUBLE, 4) AS coverage, regexp_matches(folded, '{tx.word_pattern("the and that")}') AS exact,
      CAST(CASE WHEN len(p) < 2 THEN 0 WHEN list_max(p) - list_min(p) <= 120 THEN 0.18 WHEN list_max(p) - list_min(p) <= 240 THEN 0.12 WHEN list_max(p) - list_min(p) <= 420 THEN 0.07 WHEN list_max(p) - list_min(p) <= 700 THEN 0.035 ELSE 0 END AS DOUBLE) AS proximity FROM p)
SELECT *, round(CASE WHEN exact THEN 0.68 WHEN matched >= 3 THEN 0.2 + proximity WHEN matched >= 2 THEN 0.08 + proximity ELSE 0 END, 6) AS phrase_score FROM c WHERE matched > 0""",
    "sentence_overlap": f"""
WITH i AS (SELECT item_id, list_filter({tokens_sql('text')}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)) AS wanted FROM benchmark),
d AS (SELECT doc_id, list_filter({tokens_sql('text')}, lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)) AS w FROM documents),
m AS (SELECT item_id, doc_id, list_transform(wanted, lambda t: CAST(list_contains(w, t) AS INTEGER)) AS f FROM i, d WHERE len(wanted) >= 5),
r AS (SELECT item_id, doc_id, CAST(list_max(list_transform(string_split(array_to_string(f, ''), '0'), lambda s: length(s))) AS BIGINT) AS run FROM m)
SELECT item_id, doc_id, run, CAST(CASE WHEN run >= 8 THEN 0.12 WHEN run >= 6 THEN 0.08 ELSE 0.05 END AS DOUBLE) AS overlap FROM r WHERE run >= 5""",
    "in_memory_score": f"""
WITH f AS (SELECT doc_id, {fold_sql('text')} AS folded FROM documents),
c AS (SELECT doc_id, folded, list_transform(['the', 'and', 'that', 'les'], lambda t: len(regexp_extract_all(folded, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) AS n FROM f),
s AS (SELECT doc_id, folded, CAST(len(list_filter(n, lambda x: x > 0)) AS BIGINT) AS hits, CAST(list_sum(n) AS BIGINT) AS occurrences FROM c)
SELECT doc_id, hits, occurrences, round(least(1.2::DOUBLE, hits / 4.0::DOUBLE * 0.75::DOUBLE + least(1.0::DOUBLE, occurrences / 8.0::DOUBLE) * 0.25::DOUBLE + CASE WHEN regexp_matches(folded, '{tx.word_pattern("the and that")}') THEN 0.18::DOUBLE ELSE 0 END), 6) AS score FROM s""",
    "query_terms": f"""
WITH t AS (SELECT conv_id, turn, text, {tokens_sql('text')} AS l FROM conversations),
u AS (SELECT *, {_DISTINCT.format(l='l')} AS d FROM t),
k AS (SELECT *, list_filter(d, lambda x: NOT list_contains({_STOP}, x)) AS k FROM u),
m AS (SELECT *, len(list_filter(k, lambda x: length(x) >= 4 AND NOT regexp_matches(x, '^[0-9]+$'))) > 0 AS longer FROM k)
SELECT conv_id, turn, array_to_string(list_filter(k, lambda x: length(x) >= 4 OR NOT longer OR regexp_matches(x, '[0-9]'))[1:8], ' ') AS lexical,
       array_to_string(list_filter(k, lambda x: length(x) >= 3)[1:8], ' ') AS phrase,
       regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug,
       CASE WHEN {_FOLD.format("regexp_replace(" + fold_sql('text') + ", '[^a-z0-9\\s]', ' ', 'g')")} <> '' THEN '"' || {_FOLD.format("regexp_replace(" + fold_sql('text') + ", '[^a-z0-9\\s]', ' ', 'g')")} || '"' ELSE '' END AS literal
FROM m""",
}
