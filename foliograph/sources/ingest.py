"""Files to documents: discovery, parsing, hashing, incremental indexing, table snapshots."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constants import PATTERN_VERSION
from ..operators import extract as X
from .pdf import pdf_text

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
PARSED = "text string, title string, doc_type string, error string"
#: File types and excluded path parts of a new folder.
ENABLED = ("pdf", "docx", "txt", "md", "xlsx", "csv", "xls", "ods")
EXCLUDED = ("node_modules", ".git", "target", "__pycache__", ".DS_Store")
IMAGES = ("png", "jpg", "jpeg", "gif", "bmp", "tiff", "webp", "heic")
PREVIEW_BYTES = 5 << 20
Parser = Callable[[bytes], str]


def _plain(content: bytes) -> str:
    return content.decode("utf-8")


def _docx(content: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    name = lambda e: e.tag.rpartition("}")[2]
    paragraphs = (e for e in root.iter() if name(e) == "p")
    return "\n".join("".join(t.text or "" for t in p.iter() if name(t) == "t") for p in paragraphs)


def _xlsx(content: bytes) -> str:
    """Every sheet; a row's non-empty cells joined by blanks."""
    book = zipfile.ZipFile(io.BytesIO(content))
    name = lambda e: e.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in si.iter() if name(t) == "t"))
    lines = []
    for sheet in sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n))):
        for row in (e for e in ElementTree.fromstring(book.read(sheet)).iter() if name(e) == "row"):
            cells = []
            for c in row:
                value = next((v.text or "" for v in c.iter() if name(v) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                lines.append(" ".join(v for v in cells if v))
    return "\n".join(lines)


def _ods(content: bytes) -> str:
    """Every table; a row's non-empty cells joined by blanks."""
    name = lambda e: e.tag.rpartition("}")[2]
    lines = []
    for row in (e for e in ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("content.xml")).iter() if name(e) == "table-row"):
        cells = [" ".join("".join(p.itertext()) for p in c.iter() if name(p) == "p") for c in row if name(c) == "table-cell"]
        if any(cells):
            lines.append(" ".join(v for v in cells if v))
    return "\n".join(lines)


PARSERS: dict[str, Parser] = {"txt": _plain, "md": _plain, "csv": _plain, "docx": _docx, "xlsx": _xlsx, "ods": _ods, "pdf": pdf_text}


def register_parser(extension: str, parser: Parser) -> None:
    PARSERS[extension.lower()] = parser


def parse_bytes(path: str, content: bytes) -> dict:
    """Text, title and type of a file, or an error; parsers may raise anything on broken files."""
    title = path.rpartition("/")[2]
    extension = title.rpartition(".")[2].lower() if "." in title else ""
    out = {"text": None, "title": title, "doc_type": extension, "error": None}
    parser = PARSERS.get(extension)
    if parser is None:
        return out | {"error": "OCR not available" if extension in IMAGES else f"Unsupported file type: {extension}"}
    try:
        return out | {"text": parser(content)}
    except Exception as e:
        return out | {"error": f"{type(e).__name__}: {e}"}


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder, recursively, with content (only of those that later filters keep)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def accepted(path: Column, enabled: tuple[str, ...] = ENABLED, excluded: tuple[str, ...] = EXCLUDED) -> Column:
    """Not hidden, without an excluded part anywhere in the path, of an enabled type (none given: any)."""
    name = F.substring_index(path, "/", -1)
    out = ~name.startswith(".")
    for part in excluded:
        out = out & ~F.contains(path, F.lit(part))
    return out & F.lower(F.substring_index(name, ".", -1)).isin(*enabled) if enabled else out


def folder_of(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files with the deepest folder whose path begins theirs, by joining on every parent path."""
    parts = F.split("path", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    one = files.withColumn("_parent", F.explode(parents))
    hit = one.join(folders.select(F.col("id").alias("folder_id"), F.rtrim(F.col("path"), F.lit("/")).alias("_parent")), "_parent")
    best = hit.groupBy("path").agg(F.max_by("folder_id", F.length("_parent")).alias("folder_id"))
    return files.join(best, "path", "left")


def parse(files: DataFrame) -> DataFrame:
    """Files with text, title, type, error and content hash; the bytes stay behind."""

    @F.pandas_udf(PARSED)
    def run(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_bytes(p, c) for p, c in zip(paths, contents, strict=True)], columns=["text", "title", "doc_type", "error"])

    hashed = files.withColumn("content_hash", F.sha2("content", 256))
    return hashed.withColumn("p", run("path", "content")).select("path", "content_hash", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "p.*")


def changes(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """Parsed files with `change`: unchanged, replaced or new, by path and hash; `old_id` is the known id."""
    k = known.select("path", F.col("content_hash").alias("_h"), F.col("doc_id").alias("old_id"))
    out = parsed.join(k, "path", "left")
    return out.withColumn("change", F.when(F.col("_h").isNull(), "new").when(F.col("_h") == F.col("content_hash"), "unchanged").otherwise("replaced")).drop("_h")


def index(parsed: DataFrame, known: DataFrame, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Document rows of new and replaced files with text; unchanged files give none.

    Ids follow from path and hash, so a repeated run makes the same rows.
    """
    fresh = changes(parsed, known).where("change <> 'unchanged' and error is null and trim(text) <> ''")
    ided = fresh.withColumn("doc_id", F.sha2(F.concat_ws("\n", "path", "content_hash"), 256))
    found = X.extract(ided)
    iso = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    vector = (embed or hashing_embedder())(truncated(F.col("text")))
    return found.select(
        "doc_id", "title", "path", F.coalesce(T.normal_type(F.col("doc_type")), F.lit("other")).alias("doc_type"), "size", iso.alias("modified_at"),
        F.left("text", F.lit(200)).alias("excerpt"), "text", "extracted_entities", "content_hash", F.lit(PATTERN_VERSION).alias("entities_version"), vector.alias("embedding"), "old_id",
    )


def apply_index(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after a run: rows of replaced ids go, new rows come."""
    kept = known.join(fresh.where("old_id is not null").select(F.col("old_id").alias("doc_id")), "doc_id", "left_anti")
    return kept.unionByName(fresh.drop("old_id"))


def truncated(text: Column, most: int = 2000) -> Column:
    """The first 2000 characters of texts of more than 2000 bytes."""
    return F.when(F.octet_length(text) > most, F.left(text, F.lit(most))).otherwise(text)


def hashing_embedder(size: int = 64) -> Callable[[Column], Column]:
    """A deterministic embedder: signed hashed word counts, unit length, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros((len(texts), size))
        for n, text in enumerate(texts):
            codes = np.array([zlib.crc32(w.encode()) for w in (text or "").lower().split()], np.int64)
            np.add.at(out[n], codes % size, np.where(codes >> 20 & 1, 1.0, -1.0))
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return pd.Series(list(out.astype(np.float32)))

    return lambda text: run(text)


def preview(files: DataFrame, most: int = PREVIEW_BYTES) -> DataFrame:
    """(path, text, truncated, error): text of files up to the cap."""
    cap = min(most, PREVIEW_BYTES)
    big = F.col("length") > cap
    text = F.when(~big, F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("path", text.alias("text"), big.alias("truncated"), F.when(~big & text.isNull(), "not UTF-8").alias("error"))


def decode_rows(rows: DataFrame, raw: str = "metadata") -> DataFrame:
    """Stored JSON metadata with the defaults of missing keys."""
    schema = "name string, path string, docType string, size long, createdAt string, modifiedAt string, excerpt string, spaceIds array<string>, tags array<string>, isFavorite boolean, topic string, llmTags array<string>, entitiesVersion double"
    j, epoch, none = F.from_json(raw, schema), F.lit("1970-01-01T00:00:00Z"), F.expr("cast(array() as array<string>)")
    return rows.withColumn("_j", j).select(
        "id", F.coalesce("_j.name", F.lit("Unknown")).alias("title"), F.coalesce("_j.path", F.lit("")).alias("path"), F.coalesce("_j.docType", F.lit("other")).alias("doc_type"),
        F.coalesce("_j.size", F.lit(0)).alias("size"), F.coalesce("_j.createdAt", epoch).alias("created_at"), F.coalesce("_j.modifiedAt", epoch).alias("modified_at"),
        F.coalesce("_j.excerpt", F.lit("")).alias("excerpt"), F.coalesce("_j.spaceIds", none).alias("space_ids"), F.coalesce("_j.tags", none).alias("tags"),
        F.coalesce("_j.isFavorite", F.lit(False)).alias("is_favorite"), F.nullif("_j.topic", F.lit("")).alias("topic"), F.coalesce("_j.llmTags", none).alias("llm_tags"),
        F.coalesce("_j.entitiesVersion", F.lit(2.0)).alias("entities_version"),
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under a path; an empty one where there is no such path.  A path that cannot be read is an error."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def path_index(table: DataFrame) -> DataFrame:
    """(path, doc_id): where each file's document is."""
    return table.select("path", "doc_id")


#: Tables of the engine: vectors of 384 and of 1,536 dimensions have tables of their own.
TABLES = {
    "documents_384": "doc_id string, title string, path string, embedding array<float>",
    "documents_1536": "doc_id string, title string, path string, embedding array<float>",
}


def create_tables(spark: SparkSession, root: str, tables: dict[str, str] | None = None) -> list[str]:
    """Makes the tables that are not there yet under `root`, empty; returns their names."""
    made = []
    for name, schema in (TABLES if tables is None else tables).items():
        if not path_exists(spark, f"{root}/{name}"):
            save_table(spark.createDataFrame([], schema), f"{root}/{name}")
            made.append(name)
    return made
