"""Documents from files and uploads: office XML, PDF, markdown and plain text.

Files come through Spark's own readers, so any store that Spark can read will
do.  Binary formats are decoded in Arrow batches, the rest by Columns.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.arrow import add_columns

#: Bytes of an upload, and of what it unpacks to, at most.
MOST_UPLOAD, MOST_UNPACKED = 15 << 20, 40 << 20


def files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content, length) of the files in a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "content", "length")


def page_of_files(found: DataFrame, offset: int, limit: int) -> DataFrame:
    """Some of the files in order of their paths, for imports in steps."""
    return found.orderBy("path").offset(offset).limit(limit)


def uploads(rows: DataFrame, encoded: str = "content_base64") -> DataFrame:
    """Uploads with decoded ``content``; an invalid or too large one has none,
    and says why in ``error``."""
    content = F.try_to_binary(F.col(encoded), F.lit("base64"))
    size = F.octet_length(content)
    error = F.when(content.isNull(), "invalid_base64").when(size == 0, "empty").when(size > MOST_UPLOAD, "too_large")
    return rows.withColumn("error", error).withColumn("content", F.when(error.isNull(), content))


def xml_paragraphs(xml: str) -> list[str]:
    """Texts of the paragraphs of office XML."""
    out = []
    for paragraph in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        text = "".join(re.findall(r"<w:t(?: [^>]*)?>(.*?)</w:t>", paragraph, re.S))
        text = text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#39;", "'").replace("&amp;", "&")
        if text.strip():
            out.append(re.sub(r"[ \t ]+", " ", text).strip())
    return out


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs of an office document; none if it can't be unpacked or is too large."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            entry = archive.getinfo("word/document.xml")
            if entry.file_size > MOST_UNPACKED:
                return []
            return xml_paragraphs(archive.read(entry).decode("utf-8", "replace"))
    except (zipfile.BadZipFile, KeyError, OSError, NotImplementedError):
        return []


def pdf_paragraphs(content: bytes) -> list[str]:
    """Texts of the text operators of an uncompressed PDF."""
    if not content.startswith(b"%PDF"):
        return []
    found = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", content)
    texts = [re.sub(rb"\\([()\\])", rb"\1", f).decode("latin-1").strip() for f in found]
    return [t for t in texts if t]


def text_paragraphs(content: bytes) -> list[str]:
    """Paragraphs between blank lines."""
    text = content.decode("utf-8", "replace").replace("\r", "").replace(" ", " ")
    return [p for p in (re.sub(r"[ \t]+", " ", x).strip() for x in re.split(r"\n{2,}", text)) if p]


def markdown_paragraphs(content: bytes) -> list[str]:
    """Headings, table rows and paragraphs of markdown, one each."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        if current:
            out.append(" ".join(current))
            current.clear()

    for line in content.decode("utf-8", "replace").replace("\r", "").split("\n"):
        line = line.strip()
        if re.match(r"#{1,6}\s", line):
            flush()
            out.append(re.sub(r"^#+\s*", "", line))
        elif line.startswith("|"):
            flush()
            cells = [c.strip() for c in line.strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out.append(" | ".join(cells))
        elif line:
            current.append(line)
        else:
            flush()
    flush()
    return out


#: Readers by file ending; each falls back to the ones behind it.
READERS: dict[str, tuple[Callable[[bytes], list[str]], ...]] = {
    "docx": (docx_paragraphs, markdown_paragraphs, text_paragraphs),
    "pdf": (pdf_paragraphs, text_paragraphs),
    "md": (markdown_paragraphs, text_paragraphs),
    "": (text_paragraphs,),
}


def with_paragraphs(found: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Files with ``paragraphs`` array<string>: by the first reader for their
    ending that finds any.  Null or unreadable content has none."""

    def start() -> Callable:
        def read(name: str | None, data: bytes | None) -> list[str]:
            ending = (name or "").rpartition(".")[2].lower()
            for reader in READERS.get(ending, READERS[""]):
                if paragraphs := reader(data or b""):
                    return paragraphs
            return []

        def compute(paths: pa.Array, contents: pa.Array) -> list:
            return [[read(p.as_py(), c.as_py()) for p, c in zip(paths, contents, strict=True)]]

        return compute

    return add_columns(found, [path, content], [T.StructField("paragraphs", T.ArrayType(T.StringType()))], start, drop=[content])


def unseen(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the store yet, one for each key."""
    return found.dropDuplicates(keys).join(known, keys, "left_anti")


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with line breaks in fields."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_reports(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def missing_tables(spark: SparkSession, expected: list[str]) -> list[str]:
    """Those of the expected tables that the catalogue lacks."""
    return [name for name in expected if not spark.catalog.tableExists(name)]


def source_link(link: Column, key: Column, base: str) -> Column:
    """Links of stored objects, rewritten to a service that hands them out."""
    return F.when(F.startswith(link, F.lit("object://")), F.concat(F.lit(f"{base}/source/"), key)).otherwise(link)
