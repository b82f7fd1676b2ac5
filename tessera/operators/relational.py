"""Filters, joins, aggregates, windows, sorts, sets and upserts of the catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import CHUNKS, DECISIONS, PARAGRAPHS, TRUSTED, chunks, decisions, paragraphs, table, trusted

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query and what it is in SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- filters ---------------------------------------------------------------


def scope(jurisdiction: str | None = None, title: str | None = None, authors: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> Column:
    """Conjunction of the filters given; a date filter excludes missing dates."""
    found = F.lit(True)
    if jurisdiction:
        found &= F.col("jurisdiction") == jurisdiction
    if title:
        found &= F.contains(F.lower(F.col("title")), F.lit(title.lower()))
    if authors:
        found &= F.lower("author").isin([a.lower() for a in authors])
    if since or until:
        found &= F.col("decision_date").isNotNull()
    if since:
        found &= F.col("decision_date") >= F.lit(since).cast("date")
    if until:
        found &= F.col("decision_date") <= F.lit(until).cast("date")
    return found


@query(f"""WITH {DECISIONS} SELECT id, citation, decision_date FROM decisions
WHERE jurisdiction = 'en' AND contains(lower(title), 'th') AND lower(author) IN ('src1', 'src2', 'src3', 'src0') AND decision_date >= DATE '2024-02-01' AND decision_date <= DATE '2024-10-31'""")
def scope_filters_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scope("en", "TH", ("SRC1", "src2", "src3", "src0"), "2024-02-01", "2024-10-31")
    return decisions(spark, sf_dir).where(found).select("id", "citation", "decision_date")


@query(f"""WITH {CHUNKS}, {TRUSTED}, c AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id), l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT d.id, coalesce(l.toxic, 0) = 0 AND coalesce(c.n, 0) > 0 AND d.author <> '' AND coalesce(d.title, '') <> '' OR t.document_id IS NOT NULL AS trusted_only,
       coalesce(c.n, 0) > 0 AND d.author <> '' AND coalesce(d.title, '') <> '' OR t.document_id IS NOT NULL AS plus_provisional
FROM decisions d LEFT JOIN c ON c.document_id = d.id LEFT JOIN l ON l.doc_id = d.id LEFT JOIN trusted t ON t.document_id = d.id""")
def corpus_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which corpus modes admit a decision: it is approved, has chunks, a source
    and a title, or is active; the provisional mode drops the approval."""
    docs = decisions(spark, sf_dir)
    counts = chunks(docs).groupBy("document_id").agg(F.count("*").alias("n")).withColumnRenamed("document_id", "id")
    toxic = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic"))
    active = trusted(spark, sf_dir).select(F.col("document_id").alias("id"), F.lit(True).alias("active"))
    rows = docs.join(counts, "id", "left").join(toxic, "id", "left").join(active, "id", "left")
    complete = (F.coalesce("n", F.lit(0)) > 0) & (F.col("author") != "") & (F.coalesce("title", F.lit("")) != "")
    is_active = F.col("active").isNotNull()
    return rows.select("id", ((F.coalesce("toxic", F.lit(0)) == 0) & complete | is_active).alias("trusted_only"), (complete | is_active).alias("plus_provisional"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (
  SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13'
  UNION SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type LIKE 'PROMO%' AND l_returnflag = 'R')""")
def code_filter_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that match a code directly, or by an alias with a prefix."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    direct = (F.col("p_brand") == "Brand#13") | F.startswith(F.col("p_type"), F.lit("PROMO")) & (F.col("l_returnflag") == "R")
    keys = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).where(direct).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").join(keys, "o_orderkey", "left_semi")


@query("""SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey
HAVING count(DISTINCT CASE WHEN l_returnflag IN ('A', 'N') THEN l_returnflag END) = 2""")
def code_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have all of several codes, in one aggregate without self-joins."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
    codes = ["A", "N"]
    have = [F.max((F.col("l_returnflag") == c).cast("int")).alias(c) for c in codes]
    found = lines.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), *have)
    return found.where(" AND ".join(f"{c} = 1" for c in codes)).select("l_orderkey", "n_lines")


@query("""WITH q AS (SELECT unnest(['PROMO', 'STANDARD', 'ECONOMY']) AS wanted)
SELECT wanted, p_partkey FROM part JOIN q ON p_type = wanted OR starts_with(p_type, wanted || ' ')""")
def section_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base citations match themselves and what extends them.  The join is on the
    base, so it stays an equi-join."""
    wanted = spark.createDataFrame([("PROMO",), ("STANDARD",), ("ECONOMY",)], "wanted string")
    parts = table(spark, sf_dir, "part", "p_partkey", "p_type").withColumn("base", F.substring_index("p_type", " ", 1))
    return parts.join(F.broadcast(wanted), F.col("base") == F.col("wanted")).select("wanted", "p_partkey")


@query(f"""WITH {DECISIONS}, f AS (SELECT id, lower(title || ' ' || citation) AS name FROM decisions)
SELECT id, name LIKE '%harness%' OR name LIKE '%fixture%' OR name LIKE '%seed%' OR name LIKE '%src1-%' AS is_fixture,
       NOT (name LIKE 'bee-%' OR name LIKE '%history%' OR name LIKE '%src1-%') AS is_real FROM f""")
def fixture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures by one pattern over title and citation."""
    docs = decisions(spark, sf_dir).select("id", F.lower(F.concat("title", F.lit(" "), "citation")).alias("name"))
    return docs.select("id", F.regexp_like("name", F.lit("harness|fixture|seed|src1-")).alias("is_fixture"), (~F.regexp_like("name", F.lit("^bee-|history|src1-"))).alias("is_real"))


@query("""WITH i AS (SELECT l_orderkey, count(*) AS issues FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(issues, 0) AS issues, CASE WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'P' THEN 'staged' ELSE 'pending' END AS status
FROM orders LEFT JOIN i ON l_orderkey = o_orderkey
WHERE coalesce(issues, 0) BETWEEN 1 AND 2 AND (o_orderpriority = '1-URGENT' OR o_totalprice < 50000) AND o_orderstatus <> 'O'""")
def qc_list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's filters on counts, status and an alternative in parentheses."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'")
    issues = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("issues"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    orders = orders.where("(o_orderpriority = '1-URGENT' OR o_totalprice < 50000) AND o_orderstatus <> 'O'")
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "staged").otherwise("pending")
    return orders.join(issues, "o_orderkey").where("issues BETWEEN 1 AND 2").select("o_orderkey", "issues", status.alias("status"))


# ---- joins -----------------------------------------------------------------


@query(f"""WITH {CHUNKS}, {TRUSTED} SELECT chunk_id, document_id, CAST(t.document_id IS NOT NULL AS INTEGER) AS is_trusted_tier FROM chunks LEFT JOIN trusted t USING (document_id)""")
def tier_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = trusted(spark, sf_dir).withColumn("active", F.lit(1))
    return chunks(decisions(spark, sf_dir)).join(active, "document_id", "left").select("chunk_id", "document_id", F.coalesce("active", F.lit(0)).alias("is_trusted_tier"))


@query("SELECT doc_id, source FROM documents d WHERE n_chars > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)")
def anti_not_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars").where("n_chars > 0")
    return docs.join(trusted(spark, sf_dir).withColumnRenamed("document_id", "doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query(f"""WITH {CHUNKS}, {TRUSTED} SELECT id, decision_date, CAST(t.document_id IS NOT NULL AS INTEGER) AS tier FROM decisions d LEFT JOIN trusted t ON t.document_id = d.id
WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = d.id AND contains(lower(chunk_text), 'ertion'))
ORDER BY tier DESC, decision_date DESC NULLS LAST, id LIMIT 200""")
def fts_semi_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a hit, by tier and recency."""
    docs = decisions(spark, sf_dir)
    hits = chunks(docs).where(F.contains(F.lower("chunk_text"), F.lit("ertion"))).select(F.col("document_id").alias("id"))
    active = trusted(spark, sf_dir).select(F.col("document_id").alias("id"), F.lit(1).alias("flag"))
    rows = docs.select("id", "decision_date").join(hits, "id", "left_semi").join(active, "id", "left")
    return rows.select("id", "decision_date", F.coalesce("flag", F.lit(0)).alias("tier")).orderBy(F.desc("tier"), F.desc_nulls_last("decision_date"), "id").limit(200)


@query("""SELECT o_orderkey, count(l_linenumber) AS valid_lines, coalesce(min(l_shipdate), TIMESTAMP '1970-01-01') AS first_ship
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'N' AND l_quantity > 25 GROUP BY o_orderkey""")
def left_join_extra_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate of the join's condition goes below it, to the right side."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate").where("l_returnflag = 'N' AND l_quantity > 25")
    lines = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_linenumber").alias("valid_lines"), F.min("l_shipdate").alias("first_ship"))
    rows = table(spark, sf_dir, "orders", "o_orderkey").join(lines, "o_orderkey", "left")
    return rows.select("o_orderkey", F.coalesce("valid_lines", F.lit(0)).alias("valid_lines"), F.coalesce("first_ship", F.lit("1970-01-01").cast("timestamp")).alias("first_ship"))


@query("""WITH s AS (SELECT l_suppkey, count(*) AS n_lines, count(DISTINCT l_orderkey) AS n_orders FROM lineitem GROUP BY l_suppkey),
n AS (SELECT s_nationkey, count(*) AS peers FROM supplier GROUP BY s_nationkey)
SELECT s_suppkey, coalesce(n_lines, 0) AS n_lines, coalesce(n_orders, 0) AS n_orders, peers, n_name, r_name
FROM supplier LEFT JOIN s ON l_suppkey = s_suppkey LEFT JOIN n USING (s_nationkey) JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def preaggregated_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each side is aggregated before it is joined, so rows never multiply."""
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n_lines"), F.countDistinct("l_orderkey").alias("n_orders"))
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    peers = suppliers.groupBy("s_nationkey").agg(F.count("*").alias("peers"))
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    rows = suppliers.join(lines, "s_suppkey", "left").join(peers, "s_nationkey", "left").join(places, "s_nationkey")
    return rows.select("s_suppkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "peers", "n_name", "r_name")


@query("""WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events)
SELECT event_type, k, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS malformed FROM e GROUP BY event_type, k""")
def json_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet counts from JSON; invalid JSON counts as malformed."""
    events = table(spark, sf_dir, "events", "event_type", "props")
    parsed = F.from_json("props", "k bigint")
    rows = events.select("event_type", F.get_json_object("props", "$.k").cast("bigint").alias("k"), parsed.isNull().alias("bad"))
    return rows.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.count_if("bad").alias("malformed"))


@query("""WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id), b AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta,
       CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.user_id = b.user_id""")
def before_after_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs side by side; one conditional aggregate replaces the full join."""
    events = table(spark, sf_dir, "events", "user_id", "ts").where("ts IS NOT NULL")
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    rows = events.groupBy("user_id").agg(F.count_if(~late).alias("before"), F.count_if(late).alias("after"))
    state = F.when(F.col("before") == 0, "added").when(F.col("after") == 0, "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return rows.select("user_id", "before", "after", (F.col("after") - F.col("before")).alias("delta"), state.alias("state"))


@query("""WITH k AS (SELECT c_custkey, c_nationkey, regexp_replace(c_name, '[0-9]$', '') AS base FROM customer)
SELECT a.c_custkey, min(b.c_custkey) AS companion, count(*) AS n FROM k a JOIN k b ON a.base = b.base AND a.c_custkey <> b.c_custkey AND a.c_nationkey = b.c_nationkey GROUP BY a.c_custkey""")
def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Siblings by a derived key; at most ten share one, by the key's making."""
    keyed = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_name").select("c_custkey", "c_nationkey", F.regexp_replace("c_name", "[0-9]$", "").alias("base"))
    other = keyed.select(F.col("c_custkey").alias("other"), "c_nationkey", "base")
    pairs = keyed.join(other, ["base", "c_nationkey"]).where("c_custkey <> other")
    return pairs.groupBy("c_custkey").agg(F.min("other").alias("companion"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT item_id, lower(text) AS phrase FROM benchmark WHERE length(text) > 0)
SELECT item_id, doc_id FROM i JOIN documents ON contains(lower(text), phrase)""")
def phrase_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole catalogue phrases of any length in documents.  The second and third
    of four words or more are whole in a document that holds the phrase, and are
    its key; shorter phrases meet every document."""
    from tessera.functions.text import squeeze

    items = table(spark, sf_dir, "benchmark", "item_id", "text").where("length(text) > 0").select("item_id", F.lower("text").alias("phrase"))
    items = items.withColumn("w", F.filter(F.split(squeeze(F.col("phrase")), " "), lambda t: t != ""))
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.lower("text").alias("folded")).where("folded IS NOT NULL")
    listed = docs.select("doc_id", F.split(squeeze(F.col("folded")), " ").alias("w")).where("size(w) > 1")
    grams = listed.select("doc_id", F.explode(F.array_distinct(F.expr("transform(sequence(1, size(w) - 1), i -> concat_ws(' ', w[i - 1], w[i]))"))).alias("key"))
    keyed = items.where("size(w) >= 4").select("item_id", F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))).alias("key"))
    long = grams.join(keyed, "key").select("item_id", "doc_id").distinct().join(items.select("item_id", "phrase"), "item_id").join(docs, "doc_id").where(F.contains("folded", F.col("phrase")))
    short = docs.join(items.where("size(w) < 4").select("item_id", "phrase"), F.contains("folded", F.col("phrase")))
    return long.select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id"))


# ---- aggregates ------------------------------------------------------------


@query(f"""WITH {CHUNKS}, r AS (SELECT document_id, chunk_id, length(chunk_text) AS rank FROM chunks)
SELECT document_id, max(rank) AS best, max(chunk_id) AS last_chunk, count(*) AS n FROM r GROUP BY document_id ORDER BY best DESC, last_chunk DESC LIMIT 100""")
def doc_max_rank_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(decisions(spark, sf_dir)).select("document_id", "chunk_id", F.length("chunk_text").cast("bigint").alias("rank"))
    found = rows.groupBy("document_id").agg(F.max("rank").alias("best"), F.max("chunk_id").alias("last_chunk"), F.count("*").alias("n"))
    return found.orderBy(F.desc("best"), F.desc("last_chunk")).limit(100)


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n_returned,
CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS n_discounted, round(sum(l_quantity), 2) AS quantity, min(l_shipmode_) AS sample FROM
(SELECT *, substr(l_linestatus || l_returnflag, 1, 2) AS l_shipmode_ FROM lineitem) GROUP BY l_suppkey""")
def conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_returnflag", "l_discount", "l_quantity", "l_linestatus")
    return lines.groupBy("l_suppkey").agg(
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("n_returned"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.min(F.substring(F.concat("l_linestatus", "l_returnflag"), 1, 2)).alias("sample"),
    )


@query("""SELECT count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars = 0 OR text IS NULL) AS empty, count(*) FILTER (WHERE n_chars > 10000) AS long,
count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.toxic = 1) AS toxic, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(DISTINCT source) AS sources FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def corpus_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a corpus in one pass."""
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return rows.agg(
        F.count("*").alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if((F.col("n_chars") == 0) | F.col("text").isNull()).alias("empty"), F.count_if(F.col("n_chars") > 10000).alias("long"),
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("labelled").isNull()).alias("unlabelled"), F.countDistinct("source").alias("sources"),
    )


@query("""SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities, count(*) AS n FROM orders GROUP BY o_custkey""")
def listagg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority")
    return orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS row_count FROM orders)
SELECT o_custkey, row_count, string_agg(rn || ':' || o_orderkey, '|' ORDER BY rn) AS ranked FROM r WHERE row_count > 1 GROUP BY o_custkey, row_count""")
def nested_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked rows of each group with more than one, as one value."""
    w = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").select("*", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"), F.count("*").over(w).alias("row_count"))
    item = F.struct("rn", F.concat_ws(":", F.col("rn").cast("string"), F.col("o_orderkey").cast("string")).alias("item"))
    found = rows.where("row_count > 1").groupBy("o_custkey", "row_count").agg(F.array_sort(F.collect_list(item)).alias("items"))
    return found.select("o_custkey", "row_count", F.array_join(F.transform("items", lambda x: x["item"]), "|").alias("ranked"))


@query("""SELECT o_orderpriority AS key, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, key LIMIT 3""")
def top_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderpriority").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(3)


@query("""WITH b AS (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'not_final' END, CASE WHEN o_totalprice > 200000 THEN 'too_large' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'low_priority' END], lambda x: x IS NOT NULL)) AS blocker FROM orders)
SELECT blocker, count(*) AS n FROM b GROUP BY blocker""")
def blocker_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice", "o_orderpriority")
    found = F.array_compact(F.array(F.when(F.col("o_orderstatus") != "F", "not_final"), F.when(F.col("o_totalprice") > 200000, "too_large"), F.when(F.startswith("o_orderpriority", F.lit("5")), "low_priority")))
    return orders.select(F.explode(found).alias("blocker")).groupBy("blocker").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS approved, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS staged,
count(*) FILTER (WHERE o_totalprice >= 100000) AS large, round(avg(o_totalprice), 4) AS mean_price, round(count(*) FILTER (WHERE o_orderstatus = 'F') / CAST(nullif(count(*), 0) AS DOUBLE), 6) AS approved_share, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders""")
def list_summary_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice", "o_orderdate").agg(
        F.count("*").alias("total"), F.count_if(s == "F").alias("approved"), F.count_if(s == "O").alias("pending"), F.count_if(s == "P").alias("staged"), F.count_if(F.col("o_totalprice") >= 100000).alias("large"),
        F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.round(F.try_divide(F.count_if(s == "F"), F.count("*")), 6).alias("approved_share"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"),
    )


@query("""WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn, sum(n) OVER (PARTITION BY c_nationkey) AS total FROM c)
SELECT c_nationkey, c_mktsegment AS dominant, n, round(n / CAST(total AS DOUBLE), 6) AS share FROM r WHERE rn = 1""")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode with a stated tie rule, by two aggregates."""
    counts = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    best = counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("less"), "c_mktsegment")).alias("best"), F.sum("n").alias("total"))
    n = -F.col("best.less")
    return best.select("c_nationkey", F.col("best.c_mktsegment").alias("dominant"), n.alias("n"), F.round(n / F.col("total"), 6).alias("share"))


@query("""SELECT c_nationkey, array_to_string(list_sort(list_distinct(flatten(list([c_mktsegment, left(c_name, 4)])))), ',') AS facets FROM customer GROUP BY c_nationkey""")
def facet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of each group's arrays, de-duplicated before it is shuffled."""
    rows = table(spark, sf_dir, "customer", "c_nationkey", "c_mktsegment", "c_name").select("c_nationkey", F.explode(F.array("c_mktsegment", F.substring("c_name", 1, 4))).alias("facet"))
    return rows.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("facet")), ",").alias("facets"))


@query(f"""WITH {PARAGRAPHS}, e AS (SELECT id, string_agg(paragraph_text, ' ' ORDER BY paragraph_order) AS joined, arg_min(paragraph_order, (-length(paragraph_text), paragraph_order)) AS lead_order FROM paragraphs GROUP BY id)
SELECT id, length(joined) AS n_chars, md5(joined) AS digest, lead_order FROM e""")
def document_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's paragraphs in order as one text, and its longest one."""
    rows = paragraphs(decisions(spark, sf_dir))
    found = rows.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("paragraph_order", "paragraph_text"))).alias("all"),
        F.min_by("paragraph_order", F.struct((-F.length("paragraph_text")).alias("less"), "paragraph_order")).alias("lead_order"),
    )
    joined = F.array_join(F.transform("all", lambda p: p["paragraph_text"]), " ")
    return found.select("id", F.length(joined).cast("bigint").alias("n_chars"), F.md5(joined).alias("digest"), "lead_order")


@query("""SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS only_role, count(*) AS n FROM conversations GROUP BY conv_id""")
def unique_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value that is the only one of its group; none where several differ."""
    return table(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.when(F.min("role") == F.max("role"), F.min("role")).alias("only_role"), F.count("*").alias("n"))


@query("""SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 6) AS slowest, round(avg(value), 6) AS mean FROM events GROUP BY event_type""")
def stage_bottlenecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_type", "value").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 6).alias("slowest"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT md5(text) AS key, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY md5(text)""")
def min_id_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n"))


#: Options of a family that a menu shows.
MENU = 200


@query(f"""SELECT p_brand AS family, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (WHERE rn <= {MENU}) AS options, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE contains(lower(p_name), '1') AND p_size <= 5) GROUP BY p_brand""")
def options_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first options of each family, and how many it has; the rank is cut
    before it is shuffled."""
    rows = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_size").where(F.contains(F.lower("p_name"), F.lit("1")) & (F.col("p_size") <= 5))
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    shown = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= MENU).groupBy(F.col("p_brand").alias("family")).agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    counts = rows.groupBy(F.col("p_brand").alias("family")).agg(F.count("*").alias("n"))
    return shown.join(counts, "family").select("family", F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("options"), "n")


# ---- windows ---------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, md5(text) AS key, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars DESC, doc_id DESC) AS rn, count(*) OVER (PARTITION BY md5(text)) AS row_count FROM documents)
SELECT doc_id, row_count, CASE WHEN rn = 1 THEN 'keep' ELSE 'remove' END AS action FROM r WHERE row_count > 1""")
def keep_newest_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep or remove in groups of equal keys; two aggregates and a join that may
    be split, so a key with very many rows stays no single task's."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars").select("doc_id", "n_chars", F.md5("text").alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("row_count"), F.max(F.struct("n_chars", "doc_id")).getField("doc_id").alias("kept")).where("row_count > 1")
    return rows.join(groups, "key").select("doc_id", "row_count", F.when(F.col("doc_id") == F.col("kept"), "keep").otherwise("remove").alias("action"))


@query(f"""WITH {CHUNKS}, s AS (SELECT document_id, chunk_id, round(length(chunk_text) / 1000.0::DOUBLE, 6) AS score FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS rn FROM s)
SELECT document_id, round(sum(score * CASE rn WHEN 1 THEN 1::DOUBLE WHEN 2 THEN 0.18::DOUBLE ELSE 0.08::DOUBLE END), 6) AS doc_score, min(CASE WHEN rn = 1 THEN chunk_id END) AS lead_chunk FROM r WHERE rn <= 3 GROUP BY document_id""")
def topn_weighted_doc_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's best three chunks, weighted 1, 0.18 and 0.08."""
    rows = chunks(decisions(spark, sf_dir)).select("document_id", "chunk_id", F.round(F.length("chunk_text") / 1000.0, 6).alias("score"))
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    top = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 3")
    weight = F.when(F.col("rn") == 1, 1.0).when(F.col("rn") == 2, 0.18).otherwise(0.08)
    return top.groupBy("document_id").agg(F.round(F.sum(F.col("score") * weight), 6).alias("doc_score"), F.min(F.when(F.col("rn") == 1, F.col("chunk_id"))).alias("lead_chunk"))


_RANKED = f"""WITH {CHUNKS}, s AS (SELECT document_id, chunk_id, order_rank, length(chunk_text) AS score FROM chunks ORDER BY score DESC, chunk_id LIMIT 300)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's worth of ranked chunks: what follows works on a bounded list."""
    rows = chunks(decisions(spark, sf_dir)).select("document_id", "chunk_id", "order_rank", F.length("chunk_text").alias("score"))
    return rows.orderBy(F.desc("score"), "chunk_id").limit(300)


@query(_RANKED + """, r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS rn FROM s)
SELECT document_id, chunk_id, score, rn FROM r WHERE rn <= 2 ORDER BY score DESC, chunk_id LIMIT 60""")
def diversify_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two chunks of a document on a page."""
    w = Window.partitionBy("document_id").orderBy(F.desc("score"), "chunk_id")
    return _ranked(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("document_id", "chunk_id", F.col("score").cast("bigint").alias("score"), F.col("rn").cast("bigint").alias("rn")).orderBy(F.desc("score"), "chunk_id").limit(60)


@query(_RANKED + """, f AS (SELECT *, order_rank % 3 = 0 AS low, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM s),
c AS (SELECT *, sum(CAST(low AS INTEGER)) OVER (ORDER BY place) AS lows FROM f)
SELECT chunk_id, CAST(row_number() OVER (ORDER BY CASE WHEN low AND lows > 60 THEN 1 ELSE 0 END, place) AS BIGINT) AS final_place FROM c""")
def low_signal_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-signal rows beyond a fifth of the page go to its end, in order."""
    everything = Window.partitionBy(F.lit(0))
    rows = _ranked(spark, sf_dir).select("*", (F.col("order_rank") % 3 == 0).alias("low"), F.row_number().over(everything.orderBy(F.desc("score"), "chunk_id")).alias("place"))
    rows = rows.withColumn("lows", F.sum(F.col("low").cast("int")).over(everything.orderBy("place")))
    late = F.when(F.col("low") & (F.col("lows") > 60), 1).otherwise(0)
    return rows.select("chunk_id", F.row_number().over(everything.orderBy(late, "place")).cast("bigint").alias("final_place"))


@query(_RANKED + """, p AS (SELECT document_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM s),
g AS (SELECT *, place - row_number() OVER (PARTITION BY document_id ORDER BY place) AS island FROM p), r AS (SELECT document_id, island, count(*) AS run FROM g GROUP BY document_id, island)
SELECT document_id, max(run) AS longest, CAST(sum(run) AS BIGINT) AS total, round(sum(run) / 300.0::DOUBLE, 6) AS share FROM r GROUP BY document_id""")
def streaks_and_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one document in a ranked list, and its share of it."""
    everything = Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "chunk_id")
    rows = _ranked(spark, sf_dir).select("document_id", F.row_number().over(everything).alias("place"))
    rows = rows.withColumn("island", F.col("place") - F.row_number().over(Window.partitionBy("document_id").orderBy("place")))
    runs = rows.groupBy("document_id", "island").agg(F.count("*").alias("run"))
    return runs.groupBy("document_id").agg(F.max("run").alias("longest"), F.sum("run").alias("total"), F.round(F.sum("run") / 300.0, 6).alias("share"))


#: What a fingerprint leaves out, and its characters.
CASE_MENTIONS, FINGERPRINT = (r"\b(?:case\s+no\.?|no\.?)\s*[a-z]?\d+\b", r"\be\d+\b"), 180


@query(f"""WITH {CHUNKS}, f AS (SELECT chunk_id, md5(left(trim(regexp_replace(regexp_replace(regexp_replace(lower(chunk_text), '{CASE_MENTIONS[0]}', ' ', 'g'), '{CASE_MENTIONS[1]}', ' ', 'g'), '\\s+', ' ', 'g')), {FINGERPRINT})) AS fingerprint FROM chunks), m AS (SELECT fingerprint, min(chunk_id) AS first FROM f GROUP BY fingerprint)
SELECT chunk_id, CASE WHEN chunk_id = first THEN 0.0::DOUBLE ELSE -0.26::DOUBLE END AS demotion FROM f JOIN m USING (fingerprint)""")
def fingerprint_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows with an earlier one's fingerprint lose 0.26: its first characters
    without case numbers, as the rule has it."""
    plain = F.lower("chunk_text")
    for mention in CASE_MENTIONS:
        plain = F.regexp_replace(plain, mention, " ")
    plain = F.substring(F.trim(F.regexp_replace(plain, r"\s+", " ")), 1, FINGERPRINT)
    rows = chunks(decisions(spark, sf_dir)).select("chunk_id", F.md5(plain).alias("fingerprint"))
    first = rows.groupBy("fingerprint").agg(F.min("chunk_id").alias("first"))
    return rows.join(first, "fingerprint").select("chunk_id", F.when(F.col("chunk_id") == F.col("first"), 0.0).otherwise(-0.26).alias("demotion"))


@query(f"""WITH {PARAGRAPHS}, h AS (SELECT id, paragraph_order, length(paragraph_text) AS n, CASE WHEN length(paragraph_text) < 40 THEN paragraph_text END AS heading FROM paragraphs),
w AS (SELECT id, paragraph_order, md5(coalesce(last_value(heading IGNORE NULLS) OVER o, 'Body')) AS section_digest, CAST(coalesce(sum(n + 2) OVER (PARTITION BY id ORDER BY paragraph_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n,
      count(heading) OVER o AS section_no FROM h WINDOW o AS (PARTITION BY id ORDER BY paragraph_order))
SELECT id, paragraph_order, section_digest, section_no, start, start + n AS "end" FROM w""")
def section_fill_and_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paragraph's heading, the last before it, and its place in the text."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", F.length("paragraph_text").alias("n"), F.when(F.length("paragraph_text") < 40, F.col("paragraph_text")).alias("heading"))
    w = Window.partitionBy("id").orderBy("paragraph_order")
    start = F.coalesce(F.sum(F.col("n") + 2).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    section = F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit("Body"))
    return rows.select("id", "paragraph_order", F.md5(section).alias("section_digest"), F.count("heading").over(w).alias("section_no"), start.alias("start"), (start + F.col("n")).alias("end"))


@query(f"""WITH {PARAGRAPHS}, d AS (SELECT id, paragraph_order, round(len(regexp_extract_all(paragraph_text, '[,.]')) * 1000.0::DOUBLE / length(paragraph_text), 4) AS density, section_label FROM paragraphs),
l AS (SELECT *, lag(density) OVER o AS before, lag(section_label) OVER o AS label_before FROM d WINDOW o AS (PARTITION BY id ORDER BY paragraph_order))
SELECT id, paragraph_order, CASE WHEN before IS NULL THEN 'start' WHEN greatest(density, before) >= 1.8::DOUBLE * least(density, before) AND abs(density - before) >= 0.25::DOUBLE THEN 'density_shift' WHEN section_label <> label_before THEN 'type_shift' ELSE 'none' END AS boundary FROM l""")
def boundary_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where neighbouring paragraphs differ in density or kind."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", "section_label", F.round(F.regexp_count("paragraph_text", F.lit("[,.]")) * 1000.0 / F.length("paragraph_text"), 4).alias("density"))
    w = Window.partitionBy("id").orderBy("paragraph_order")
    rows = rows.select("*", F.lag("density").over(w).alias("before"), F.lag("section_label").over(w).alias("label_before"))
    shift = (F.greatest("density", "before") >= 1.8 * F.least("density", "before")) & (F.abs(F.col("density") - F.col("before")) >= 0.25)
    kind = F.when(F.col("before").isNull(), "start").when(shift, "density_shift").when(F.col("section_label") != F.col("label_before"), "type_shift").otherwise("none")
    return rows.select("id", "paragraph_order", kind.alias("boundary"))


@query("""WITH k AS (SELECT o_orderkey, o_custkey || '|' || o_orderpriority AS batch FROM orders), g AS (SELECT batch, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM k GROUP BY batch)
SELECT o_orderkey, n - 1 AS peers, CASE WHEN n > 1 THEN CASE WHEN o_orderkey = lo THEN hi ELSE lo END END AS a_peer FROM k JOIN g USING (batch)""")
def batch_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many others share a signature, and one of them."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select("o_orderkey", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("batch"))
    groups = rows.groupBy("batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    peer = F.when(F.col("n") > 1, F.when(F.col("o_orderkey") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")))
    return rows.join(groups, "batch").select("o_orderkey", (F.col("n") - 1).alias("peers"), peer.alias("a_peer"))


@query("""SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_returnflag) > 1 AS is_duplicate FROM lineitem""")
def duplicate_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of one value within a document; documents bound the windows."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return lines.select("l_orderkey", "l_linenumber", (F.count("*").over(Window.partitionBy("l_orderkey", "l_returnflag")) > 1).alias("is_duplicate"))


# ---- sorts and pages -------------------------------------------------------

def order_of(name: str) -> list[Column]:
    """The columns of a named sort; all end in the key, so pages never overlap."""
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return {
        "newest": [F.desc("o_orderdate"), F.asc("o_orderkey")],
        "effort": [F.asc(rank), F.desc("o_totalprice"), F.asc("o_orderkey")],
        "priority": [F.asc("o_orderpriority"), F.asc(rank), F.asc("o_orderkey")],
    }[name]


@query("""WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders)
SELECT o_orderkey, (SELECT count(*) FROM orders) > 90 AS has_more FROM p WHERE place > 60 AND place <= 90""")
def page_with_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of thirty, and whether a fourth follows: one row beyond the
    page tells."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ahead = orders.orderBy(*order_of("effort")).offset(60).limit(31).select("o_orderkey", F.monotonically_increasing_id().alias("at"))
    everything = Window.partitionBy(F.lit(0))
    return ahead.select("o_orderkey", (F.count("*").over(everything) > 30).alias("has_more"), "at").orderBy("at").limit(30).drop("at")


@query("""WITH a AS (SELECT o_orderkey, 1 AS page, o_totalprice AS v FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40), b AS (SELECT o_orderkey, 2 AS page, o_totalprice + 1 AS v FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40 OFFSET 30),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT o_orderkey, max(page) AS page, arg_max(v, page) AS v FROM u GROUP BY o_orderkey""")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that overlap: of equal keys, the later page's row."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").orderBy(*order_of("newest")[:2])
    first = orders.limit(40).select("o_orderkey", F.lit(1).alias("page"), F.col("o_totalprice").alias("v"))
    second = orders.offset(30).limit(40).select("o_orderkey", F.lit(2).alias("page"), (F.col("o_totalprice") + 1).alias("v"))
    return first.unionByName(second).groupBy("o_orderkey").agg(F.max("page").alias("page"), F.max_by("v", "page").alias("v"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def best_per_group_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each group, and the best of those."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    best = orders.groupBy("o_custkey").agg(F.min(F.struct((-F.col("o_totalprice")).alias("less"), "o_orderkey")).alias("best"))
    return best.select(F.col("best.o_orderkey").alias("o_orderkey"), "o_custkey", (-F.col("best.less")).alias("o_totalprice")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


# ---- sets ------------------------------------------------------------------


@query("""WITH u AS (SELECT doc_id AS id, 0 AS priority, 'lexical' AS channel FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 1, 'provisional' FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY priority) AS rn FROM u) SELECT id, channel FROM r WHERE rn = 1""")
def union_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of channels, of equal keys the one that comes first."""
    one = table(spark, sf_dir, "documents", "doc_id", "lang").where("lang = 'fr'").select(F.col("doc_id").alias("id"), F.lit(0).alias("priority"), F.lit("lexical").alias("channel"))
    two = table(spark, sf_dir, "labels", "doc_id").select(F.col("doc_id").alias("id"), F.lit(1).alias("priority"), F.lit("provisional").alias("channel"))
    return one.unionByName(two).groupBy("id").agg(F.min_by("channel", "priority").alias("channel"))


@query("""WITH l AS (SELECT doc_id AS id, round(n_chars / 1000.0::DOUBLE, 6) AS lexical FROM documents WHERE lang = 'de'), v AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS vector FROM embeddings)
SELECT coalesce(l.id, v.id) AS id, coalesce(lexical, 0) AS lexical, coalesce(vector, 0) AS vector FROM l FULL JOIN v ON l.id = v.id""")
def full_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector candidates side by side, 0 where one is missing."""
    lexical = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars").where("lang = 'de'").select(F.col("doc_id").alias("id"), F.round(F.col("n_chars") / 1000.0, 6).alias("lexical"))
    vector = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("vector"))
    return lexical.join(vector, "id", "full").select("id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("vector", F.lit(0.0)).alias("vector"))


@query("""SELECT doc_id, 'missing_label' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'orphan_label' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id")
    missing = docs.join(labels, "doc_id", "left_anti").withColumn("state", F.lit("missing_label"))
    return missing.unionByName(labels.join(docs, "doc_id", "left_anti").withColumn("state", F.lit("orphan_label")))


@query("""WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size <= 10)
SELECT (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS only_left, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS only_right, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS both""")
def manifest_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two manifests are equal if both differences are empty; one grouped pass."""
    parts = table(spark, sf_dir, "part", "p_brand", "p_size")
    left = parts.where("p_size < 10").withColumn("side", F.lit(1))
    right = parts.where("p_size <= 10").withColumn("side", F.lit(2))
    rows = left.unionByName(right).groupBy("p_brand", "p_size").agg(F.min("side").alias("lo"), F.max("side").alias("hi"))
    return rows.agg(F.count_if(F.expr("hi = 1")).alias("only_left"), F.count_if(F.expr("lo = 2")).alias("only_right"), F.count_if(F.expr("lo < hi")).alias("both"))


# ---- upserts ---------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new, which replace those with equal keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


@query("""WITH n AS (SELECT c_custkey, 'VIP' AS c_mktsegment FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey + 1000000, 'NEW' FROM customer WHERE c_acctbal < 0)
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL FROM n""")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_acctbal > 5000").select("c_custkey", F.lit("VIP").alias("c_mktsegment"))
    new = new.unionByName(old.where("c_acctbal < 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment")))
    return upsert(old.drop("c_acctbal"), new, ["c_custkey"])


@query("""SELECT l_orderkey AS document_id, lower(l_returnflag || '-' || l_linestatus) AS normalized, min(l_returnflag || '-' || l_linestatus) AS value FROM lineitem GROUP BY 1, 2""")
def facets_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet rows, one for each document and normalised value."""
    value = F.concat_ws("-", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus")
    return lines.groupBy(F.col("l_orderkey").alias("document_id"), F.lower(value).alias("normalized")).agg(F.min(value).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 1000 THEN coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END, TIMESTAMP '2030-01-01') END AS searchable_at,
CASE WHEN o_orderstatus = 'P' THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'pending' END AS status FROM orders""")
def approve_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approval sets a time only where none is; rejection clears it."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    existing = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderdate"))
    approved = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 1000)
    status = F.when(F.col("o_orderstatus") == "P", "rejected").when(F.col("o_orderstatus") == "F", "approved").otherwise("pending")
    return orders.select("o_orderkey", F.when(approved, F.coalesce(existing, F.lit("2030-01-01").cast("timestamp"))).alias("searchable_at"), status.alias("status"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without those whose parent is deleted."""
    gone = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("""SELECT p_partkey, upper(p_brand) AS up, instr(lower(p_type), 'tin') AS at, trim(replace(lower(p_type), 'promo ', '')) AS stripped, greatest(p_size, 10) AS at_least, least(p_size, 10) AS at_most, round(p_retailprice / 7, 3) AS rounded,
CAST(floor(p_retailprice) AS INTEGER) AS whole, p_type ILIKE 'standard%' AS is_like, coalesce(nullif(p_size, 1), -1) AS not_one, translate(p_brand, '#', ' ') AS plain, p_brand || ':' || p_size AS joined, CAST(greatest(1, ceil(length(p_name) / 4.0)) AS BIGINT) AS token_estimate FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions that the operators build on."""
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.upper("p_brand").alias("up"), F.instr(F.lower("p_type"), "tin").cast("bigint").alias("at"), F.trim(F.replace(F.lower("p_type"), F.lit("promo "), F.lit(""))).alias("stripped"), F.greatest(c("p_size"), F.lit(10)).alias("at_least"), F.least(c("p_size"), F.lit(10)).alias("at_most"),
        F.round(c("p_retailprice") / 7, 3).alias("rounded"), F.floor("p_retailprice").cast("int").alias("whole"), c("p_type").ilike("standard%").alias("is_like"), F.coalesce(F.nullif(c("p_size"), F.lit(1)), F.lit(-1)).alias("not_one"), F.translate("p_brand", "#", " ").alias("plain"),
        F.concat_ws(":", "p_brand", c("p_size").cast("string")).alias("joined"), F.greatest(F.lit(1), F.ceil(F.length("p_name") / 4.0)).cast("bigint").alias("token_estimate"),
    )
