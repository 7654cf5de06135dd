"""File sources: JSON logs and documents, text and binary files, Word files, workflow plans."""

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Largest file that is read.
LARGEST = 50 * 1024 * 1024
USAGE_LOG = "type string, timestamp string, message struct<usage struct<input_tokens: bigint, output_tokens: bigint>>"
ENCODINGS = ("utf-8", "gbk", "gb2312", "utf-16", "latin-1")


def usage_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, rec_type, logged_at, message) of the ``*.jsonl`` files one level below; blank and malformed lines are dropped."""
    x = spark.read.schema(USAGE_LOG.replace("struct<usage", "struct<usage:") + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{folder}/*/*.jsonl")
    return x.where("_bad is null").select(F.col("_metadata.file_path").alias("file_path"), F.col("type").alias("rec_type"), F.col("timestamp").alias("logged_at"), "message")


def json_documents(spark: SparkSession, folder: str, schema: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``*.json`` file, with ``file_name`` and ``bad`` (the text of a file that doesn't parse)."""
    x = spark.read.schema(f"{schema}, bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "bad").json(f"{folder}/*.json")
    return x.withColumn("file_name", F.col("_metadata.file_name")).where(~F.col("file_name").isin(list(skip)))


def json_trees(spark: SparkSession, folder: str) -> DataFrame:
    """(folder_id, parent_id, folder_name, depth, docs) of nested folder files of any depth.

    Each round opens one level of children, kept as JSON text, so the tree needs no recursive schema.
    """
    from functools import reduce

    from quarryline.plans.lineage import cut

    node = "folder_id string, folder_name string, docs array<struct<type: string, id: string, name: string, url: string, edit_time: string>>, children map<string, string>"
    level = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.from_json("value", node).alias("n"), F.lit(None).cast("string").alias("parent_id")).where("n.folder_id is not null")
    out, depth = [], 0
    while True:
        level = cut(level.select("n", "parent_id"), loop=True)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out) if out else level.select("n.folder_id", "parent_id", "n.folder_name", F.lit(0).alias("depth"), "n.docs")
        out.append(level.select("n.folder_id", "parent_id", "n.folder_name", F.lit(depth).alias("depth"), "n.docs"))
        level = level.select(F.col("n.folder_id").alias("parent_id"), F.explode("n.children").alias("k", "v")).select(F.from_json("v", node).alias("n"), "parent_id").where("n is not null")
        depth += 1


def binary_files(spark: SparkSession, folder: str, extensions: tuple[str, ...], largest: int = LARGEST) -> DataFrame:
    """(path, length, ext, content) of files with a wanted extension, not larger than ``largest``; content is read after the filters."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1))
    return x.where(F.col("length") <= largest).withColumn("ext", ext).where(F.col("ext").isin(list(extensions))).select("path", "length", "ext", "content")


def scan_counts(spark: SparkSession, folder: str, extensions: tuple[str, ...], largest: int = LARGEST) -> DataFrame:
    """One row: files in all, with a wanted extension, and too large; no content is read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    want = F.lower(F.regexp_extract("path", r"(\.[^./\\]+)$", 1)).isin(list(extensions))
    return x.agg(F.count("*").alias("total_files"), F.count_if(want & (F.col("length") <= largest)).alias("scanned_files"), F.count_if(want & (F.col("length") > largest)).alias("skipped_large"))


def decode_cascade(data: bytes | None) -> str | None:
    """Text by the first encoding that decodes; null stays null."""
    if data is None:
        return None
    for e in ENCODINGS:
        try:
            return bytes(data).decode(e)
        except (UnicodeDecodeError, UnicodeError):
            continue
    return None


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    return content.map(decode_cascade)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def docx_text(data: bytes | None) -> str | None:
    """Paragraphs outside of tables, then table cells, joined by line ends; null for what is no Word file."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    return "\n".join([text(p) for p in body.findall(f"{_W}p")] + [text(c) for t in body.findall(f"{_W}tbl") for c in t.iter(f"{_W}tc")])


@F.pandas_udf(StringType())
def docx_texts(content: pd.Series) -> pd.Series:
    return content.map(docx_text)


def docx_images(files: DataFrame) -> DataFrame:
    """(path, image_no, embed_id, name, data) of the images embedded in Word files, each once, in the order of the body."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}
                        seen: list[str] = []
                        for e in ElementTree.fromstring(z.read("word/document.xml")).iter():
                            k = e.get(f"{_R}embed")
                            if k and k in rels and k not in seen:
                                seen.append(k)
                                rows.append((path, len(seen), k, f"image_{len(seen):03d}{rels[k][rels[k].rfind('.'):]}", z.read("word/" + rels[k].lstrip("/").removeprefix("word/"))))
                except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "image_no", "embed_id", "name", "data"])

    return files.select("path", "content").mapInPandas(run, "path string, image_no int, embed_id string, name string, data binary")


def text_files(spark: SparkSession, folder: str, pattern: str, skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(file_name, text) of whole text files whose names match a glob and start with none of the prefixes."""
    x = spark.read.text(folder, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    for p in skip_prefixes:
        x = x.where(~F.col("file_name").startswith(p))
    return x


def titled_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, title, url, text): 标题 and URL of the first ten lines, the last of each; the title falls back to the file name."""
    from quarryline.operators.textsearch import header_field

    x = text_files(spark, folder, pattern)
    return x.select("file_name", F.coalesce(header_field(F.col("text"), "标题"), "file_name").alias("title"), header_field(F.col("text"), "URL").alias("url"), "text")


def workflow(spark: SparkSession, path: str) -> DataFrame:
    """(phase_no, phase, step_no, name, value) of a small workflow file in YAML; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        plan = yaml.safe_load(f) or {}
    rows = []
    for i, ph in enumerate(plan.get("phases") or []):
        for j, sp in enumerate((ph or {}).get("speakers") or []):
            rows.append((i, str(ph.get("name") or ph.get("id") or ""), j, "speaker", str(sp if not isinstance(sp, dict) else sp.get("role") or sp.get("name"))))
    return spark.createDataFrame(rows, "phase_no int, phase string, step_no int, name string, value string")
