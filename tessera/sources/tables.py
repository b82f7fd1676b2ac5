"""Tables of a folder, and the views that the operators run on.

The SQL strings state the same views for an engine that has the tables
registered by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: All characters that Unicode counts as spaces: a line of these alone is blank, as in the
#: SQL, whose trim() takes them all.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def blank(line: str) -> Column:
    """Whether a line holds nothing but spaces."""
    return F.trim(F.col(line), F.lit(SPACES)) == ""


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small table over all cores.  A table of at least as many splits
    as cores stays as it is, so large inputs are never shuffled for this."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Tables whose rows take much work each.
_WIDE = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, pruned to some columns."""
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    found = found.select(*columns) if columns else found
    return spread(found) if name in _WIDE and (not columns or {"text", "html"} & set(columns)) else found


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as decisions: title, citation, author, jurisdiction and date."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("citation"),
        F.col("source").alias("author"),
        F.col("lang").alias("jurisdiction"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("decision_date"),
        "text",
    )


DECISIONS = """
decisions AS (
  SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, source || '-' || doc_id AS citation, source AS author, lang AS jurisdiction,
         CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS decision_date, text
  FROM documents)
"""

#: Headings that stand in for the sections of a decision, by a paragraph's place.
SECTION_LABELS = ("Findings of Fact", "Conclusions of Law", "Order", "Background")


def paragraphs(docs: DataFrame) -> DataFrame:
    """(id, paragraph_order, paragraph_text, section_label) of non-blank lines."""
    lines = docs.select("id", F.posexplode(F.split("text", "\n")).alias("paragraph_order", "paragraph_text"))
    label = F.element_at(F.array(*map(F.lit, SECTION_LABELS)), F.col("paragraph_order") % 4 + 1)
    return lines.where(~blank("paragraph_text")).withColumn("section_label", label)


PARAGRAPHS = """
paragraphs AS (
  SELECT id, paragraph_order, paragraph_text, ['Findings of Fact', 'Conclusions of Law', 'Order', 'Background'][paragraph_order % 4 + 1] AS section_label
  FROM (SELECT doc_id AS id, CAST(unnest(range(0, len(l))) AS INTEGER) AS paragraph_order, unnest(l) AS paragraph_text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE trim(paragraph_text) <> '')
"""


#: Lines that a document's chunk ids have room for: a longer text would be over
#: 128 MB; ids of documents may then go up to 2**37.
LINES = 1 << 26


def chunks(docs: DataFrame) -> DataFrame:
    """Paragraphs of decisions as chunks, with what a scan of chunks needs.  A
    document is cut in place, so neither a join nor a shuffle is needed."""
    kept = ["id", "title", "citation", "author", "jurisdiction", "decision_date"]
    found = docs.select(*kept, F.posexplode(F.split("text", "\n")).alias("order_rank", "chunk_text")).where(~blank("chunk_text"))
    chunk_id = F.col("id") * LINES + F.col("order_rank")
    label = F.element_at(F.array(*map(F.lit, SECTION_LABELS)), F.col("order_rank") % 4 + 1)
    return found.withColumn("section_label", label).select(chunk_id.alias("chunk_id"), F.col("id").alias("document_id"), "order_rank", "section_label", "chunk_text", "title", "citation", "author", "jurisdiction", "decision_date")


CHUNKS = f"""{DECISIONS}, {PARAGRAPHS},
chunks AS (
  SELECT id * {LINES} + paragraph_order AS chunk_id, id AS document_id, paragraph_order AS order_rank, section_label, paragraph_text AS chunk_text,
         title, citation, author, jurisdiction, decision_date
  FROM paragraphs JOIN decisions USING (id))
"""


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id of the trusted tier."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return labels.where("quality = 1").select(F.col("doc_id").alias("document_id")).distinct()


TRUSTED = "trusted AS (SELECT DISTINCT doc_id AS document_id FROM labels WHERE quality = 1)"
