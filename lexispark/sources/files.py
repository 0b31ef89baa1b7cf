"""Sources and sinks: folders of files, uploads, TSV and JSONL, with what is left out and why."""

from __future__ import annotations

import base64
import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".json", ".csv", ".tsv", ".log", ".rst")
SUFFIXES = (*TEXT_SUFFIXES, ".docx", ".pdf")
# Folders that never hold documents.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "site-packages")
MAX_BYTES, MAX_FILES, MAX_XML = 25 << 20, 5000, 64 << 20
CASE_SCHEMA = "id string, suite string, category string, domain string, query string, doc string, label int, note string"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))


def why_skipped(path: Column, size: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Reason for leaving a file out, null for one that is taken: its folder, a leading dot, its type, its size."""
    parts = F.split(path, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*SKIPPED_FOLDERS))
    return F.when(path.isNull(), F.lit("no name")).when(hidden, F.lit("hidden folder")).when(~suffix(path).isin(*SUFFIXES), F.lit("type")).when(size > max_bytes, F.lit("file too large"))


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file that hold something, trimmed, a blank line between them."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        if archive.getinfo("word/document.xml").file_size > MAX_XML:
            raise ValueError("document.xml is too large")
        tree = ElementTree.fromstring(archive.read("word/document.xml"))
    marks = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
    found = ("".join(n.text or "" if n.tag == f"{w}t" else marks.get(n.tag, "") for n in p.iter()) for p in tree.iter(f"{w}p"))
    return "\n\n".join(filter(None, map(str.strip, found)))


def pdf_text(data: bytes) -> str:
    from pypdf import PdfReader

    return "\n\n".join((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(data)).pages)


def text_of(name: str, data: bytes) -> str:
    kind = "." + name.lower().rpartition(".")[2]
    if kind == ".docx":
        return docx_text(data)
    if kind == ".pdf":
        return pdf_text(data)
    if kind in TEXT_SUFFIXES:
        return data.decode("utf-8", "ignore")
    raise ValueError(f"unsupported type {kind}")


def _texts(batches):
    for batch in batches:
        texts, reasons = [], []
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                texts.append(text_of(name, data))
                reasons.append(None)
            except ImportError:
                texts.append(None)
                reasons.append("reader not installed")
            except Exception as e:  # a broken file is skipped, with the reason, and never ends the scan
                texts.append(None)
                reasons.append(f"unreadable: {type(e).__name__}")
        yield pa.record_batch({"path": batch.column("path"), "text": pa.array(texts, pa.string()), "reason": pa.array(reasons, pa.string())})


def scan_folder(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> tuple[DataFrame, DataFrame]:
    """(documents: path, file_name, text; skipped: path, reason) of all files below a folder.

    Spark's listing leaves out names that begin with a dot or an underscore. Names and sizes decide first, from the listing alone; contents are read of the files that are taken, the first
    ``max_files`` by path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/") + "/"
    relative = F.regexp_replace("path", "^.*" + re.escape(base), "")
    named = files.select(F.col("path").alias("url"), relative.alias("path"), "length").withColumn("reason", why_skipped(F.col("path"), F.col("length"), max_bytes))
    first = named.where("reason is null").orderBy("path").limit(max_files)
    chosen = files.select(F.col("path").alias("url"), "content").join(first.select("url", "path"), "url").select("path", "content")
    read = chosen.mapInArrow(_texts, "path string, text string, reason string")
    late = named.where("reason is null").join(first.select("path"), "path", "left_anti").select("path", F.lit("too many files").alias("reason"))
    documents = read.where("reason is null").select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "text")
    skipped = named.where("reason is not null").select("path", "reason").unionByName(read.where("reason is not null").select("path", "reason")).unionByName(late)
    return documents, skipped


def skipped_report(skipped: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` skipped files by path, with their reason and the number of all of them (``skipped_total``)."""
    name = skipped.columns[0]
    total = skipped.agg(F.count("*").alias("skipped_total"))
    return skipped.orderBy(name, "reason").limit(most).crossJoin(F.broadcast(total))


def unique_names(rows: DataFrame, name: str, order: str, bucket_rows: int = 100_000) -> DataFrame:
    """Rows with ``unique_name``: the base name, from the second row of a base name on as ``stem (n).suffix``.

    A null or empty name counts as ``document.txt``.  Rows are numbered in two steps: a name's rows are dealt to ranges of
    ``order`` (a number, unique), which are counted first, so that no name is sorted in one task.
    """
    path = F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("document.txt"))
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    span = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n"))
    width = F.greatest(F.lit(1.0), (F.col("high") - F.col("low") + 1) / F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)))
    limits = span.select(F.col("low").alias("_low"), width.alias("_width"))
    placed = rows.withColumn("_base", base).crossJoin(F.broadcast(limits)).withColumn("_range", F.floor((F.col(order) - F.col("_low")) / F.col("_width")))
    counts = placed.groupBy("_base", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_base").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_base", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    number = F.row_number().over(Window.partitionBy("_base", "_range").orderBy(order)) + F.col("_offset")
    numbered = placed.join(offsets, ["_base", "_range"]).withColumn("_number", number)
    parts = [F.regexp_extract("_base", r"^(.+?)(\.[^.]+)?$", k) for k in (1, 2)]
    unique = F.when(F.col("_number") == 1, F.col("_base")).otherwise(F.concat(parts[0], F.lit(" ("), F.col("_number").cast("string"), F.lit(")"), parts[1]))
    return numbered.withColumn("unique_name", unique).select(*rows.columns, "unique_name")


def _upload_texts(batches):
    for batch in batches:
        texts, reasons = [], []
        for name, data, text in zip(*(batch.column(c).to_pylist() for c in ("unique_name", "data", "text")), strict=True):
            found, reason = None, None
            if not name.lower().endswith(SUFFIXES):
                reason = "type"
            elif data is None:
                found = text
            else:
                try:
                    found = text_of(name, base64.b64decode(data, validate=True))
                except ImportError:
                    reason = "reader not installed"
                except Exception as e:  # one broken upload never ends the others
                    reason = f"unreadable: {type(e).__name__}"
            if reason is None and not (found or "").strip():
                found, reason = None, "no readable text"
            texts.append(found)
            reasons.append(reason)
        yield pa.record_batch({"unique_name": batch.column("unique_name"), "text": pa.array(texts, pa.string()), "reason": pa.array(reasons, pa.string())})


def uploads(rows: DataFrame, name: str = "name", data: str = "data", text: str = "text", order: str = "position") -> tuple[DataFrame, DataFrame]:
    """(documents: unique_name, text; skipped: unique_name, reason) of uploads: base64 data of any known type, or text.

    Data are read by the type that the name ends in; a row without data has its text taken as it is.  A name of another
    type, broken data and a text without anything to read are skipped, with the reason.
    """
    named = unique_names(rows, name, order).select("unique_name", F.col(data).alias("data"), F.col(text).alias("text"))
    read = named.mapInArrow(_upload_texts, "unique_name string, text string, reason string")
    return read.where("reason is null").select("unique_name", "text"), read.where("reason is not null").select("unique_name", "reason")


def read_tsv(spark: SparkSession, path: str, most: int = 500) -> DataFrame:
    """Records of a file of jurisdiction, title and content by tab (or a literal backslash t), see ``clean_records``."""
    from ..operators.training_pairs import clean_records

    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
    parts = F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\\t"))
    rows = lines.select("_line", parts.alias("p")).where(F.size("p") >= 3)
    return clean_records(rows.select("_line", *[F.col("p")[k].alias(n) for k, n in enumerate(("jurisdiction", "title", "content"))]), "_line", most=most)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of JSONL files; blank lines are skipped, a case without id has its line number for one.

    A label that isn't 0 or 1, or a line that isn't JSON, is an error that names the line.  Suites are small files, each
    read as a whole, since only that tells line numbers.
    """
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    lines = files.where(F.trim("line") != "").select("file", (F.col("at") + 1).alias("number"), F.from_json("line", CASE_SCHEMA).alias("x"))
    where = F.concat(F.col("file"), F.lit(":"), F.col("number"), F.lit(": the label must be 0 or 1"))
    label = F.when(F.col("x.label").isin(0, 1), F.col("x.label")).otherwise(F.raise_error(where).cast("int"))
    columns = {"id": F.coalesce("x.id", F.col("number").cast("string")), "category": F.coalesce("x.category", F.lit("uncategorized")), "label": label}
    names = [f.split()[0] for f in CASE_SCHEMA.split(", ")]
    return lines.select(*[columns.get(n, F.col(f"x.{n}")).alias(n) for n in names])


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)
