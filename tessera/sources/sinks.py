"""Exports and stores."""

from __future__ import annotations

import json
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.lineage import release, settle


def csv_field(value: Column) -> Column:
    """A field of CSV: quoted if it has a quote, comma or line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.regexp_like(text, F.lit('[",\n\r]')), quoted).otherwise(text)


def csv_lines(rows: DataFrame) -> DataFrame:
    """(line): one line of CSV for each row."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(c)) for c in rows.columns]).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown_summary(rows: DataFrame, group: str, count: str) -> DataFrame:
    """(line): a table of a grouped report, in markdown, in order."""
    return rows.orderBy(F.desc(count), group).select(F.concat(F.lit("| "), F.col(group).cast("string"), F.lit(" | "), F.col(count).cast("string"), F.lit(" |")).alias("line"))


def html(text: Column) -> Column:
    """Text escaped for HTML."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def exported(paragraphs: DataFrame, kind: str) -> DataFrame:
    """(id, body): documents put together again from sections and paragraphs, as
    markdown, text or html.  A document's paragraphs bound its row."""
    p, h = F.col("paragraph_text"), F.col("section_label")
    line = {"markdown": F.concat(F.lit("## "), h, F.lit("\n\n"), p), "text": p, "html": F.concat(F.lit("<h2>"), html(h), F.lit("</h2><p>"), html(p), F.lit("</p>"))}[kind]
    rows = paragraphs.select("id", "paragraph_order", line.alias("line"))
    joined = F.array_sort(F.collect_list(F.struct("paragraph_order", "line")))
    glue = "" if kind == "html" else "\n\n"
    return rows.groupBy("id").agg(joined.alias("all")).select("id", F.array_join(F.transform("all", lambda x: x["line"]), glue).alias("body"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, for migrations that drop repeats."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


#: Parts of a store; a write touches those that its keys fall in.  Versions after which
#: what a write replaced is deleted: who began to read before can go on.
BUCKETS, KEPT_VERSIONS = 64, 3


def _files(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listing(spark: SparkSession, path: str) -> tuple[int, dict[int, str], list[tuple[int, str]]]:
    """The last version of a store, the folder of each of its buckets, and folders
    that were replaced, with the version that did."""
    place, files = _files(spark, f"{path}/_versions")
    if not files.exists(place):
        return 0, {}, []
    names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.getPath().getName().isdigit())
    if not names:
        return 0, {}, []
    listed = json.loads(spark.read.text(f"{path}/_versions/{names[-1]}", wholetext=True).first()[0])
    gone = [tuple(g) for g in listed.pop("gone", [])]
    return int(names[-1]), {int(k): v for k, v in listed.items()}, gone


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a store of overwrite_by_key, None if it has none yet."""
    folders = sorted(set(_listing(spark, path)[1].values()))
    return spark.read.option("mergeSchema", "true").parquet(*folders) if folders else None


def overwrite_by_key(spark: SparkSession, path: str, new: DataFrame, keys: list[str], buckets: int = BUCKETS) -> None:
    """A store with new rows in place of those with equal keys.

    Rows are dealt to buckets by a hash of the keys, always as many in a store; only
    buckets that new rows fall in are written, to a new folder.  The store changes
    when the listing of the next version takes its name, in one step: a failure
    before that leaves the old version whole, one after it only files that nothing
    lists.  Of two writers at a time, one fails."""
    version, folders, gone = _listing(spark, path)
    placed = settle(new.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")))
    touched = sorted(r.bucket for r in placed.select("bucket").distinct().collect())
    before = [folders[k] for k in touched if k in folders]
    rows = placed
    if before:
        old = spark.read.option("mergeSchema", "true").parquet(*before)
        old = old.join(placed.select(*keys).distinct(), keys, "left_anti").withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        rows = old.unionByName(placed, allowMissingColumns=True)
    folder = f"{path}/{uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    release(placed)
    folders |= {k: f"{folder}/bucket={k}" for k in touched}
    gone += [(version + 1, f) for f in before]
    kept = [g for g in gone if g[0] > version + 1 - KEPT_VERSIONS]
    draft, files = _files(spark, f"{path}/_versions/draft-{uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps({**folders, "gone": kept}).encode()))
    out.close()
    named, _ = _files(spark, f"{path}/_versions/{version + 1:012d}")
    if not files.rename(draft, named):
        raise RuntimeError(f"another writer changed {path}")
    for _, old_folder in gone[: len(gone) - len(kept)]:
        files.delete(_files(spark, old_folder)[0], True)
