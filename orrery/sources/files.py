"""Scans of file trees: categories, caps, hashes and what has changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.text import glob_regex, glob_variants

#: Languages of code by extension, and extensions of text.
CODE = {
    "py": "python", "rs": "rust", "go": "go", "java": "java", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rb": "ruby", "swift": "swift", "html": "html", "htm": "html", "xml": "xml", "bsl": "bsl",
}
TEXT = ("md", "txt", "json", "yaml", "yml", "toml", "ini", "cfg", "csv", "sql", "sh", "css")
#: Languages that are searched as text as well as parsed; caps of size; folders that are never entered.
DUAL = ("html", "php", "c", "cpp", "csharp", "ruby", "swift")
TEXT_CAP, CODE_CAP = 1 << 20, 5 << 20
EXCLUDED = (".git", "node_modules", "target", "__pycache__", ".venv", "dist", "build")


def extension(path: Column) -> Column:
    """Lower-case ending after the last dot of the file's name; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def category(path: Column, cpp: bool = False, extra_text: Iterable[str] = ()) -> Column:
    """struct(category, language): code, text or binary; `.h` is C++ in a C++ repository."""
    end = extension(path)
    table = F.create_map(*[F.lit(x) for k, v in CODE.items() for x in (k, "cpp" if cpp and k == "h" else v)])
    language = table[end]
    kind = F.when(language.isNotNull(), "code").when(end.isin(*TEXT, *extra_text), "text").otherwise("binary")
    return F.struct(kind.alias("category"), F.coalesce(language, F.when(kind == "text", "text")).alias("language"))


def scan(spark: SparkSession, root: str, excluded: Iterable[str] = EXCLUDED, globs: Iterable[str] = (), most: int | None = None) -> DataFrame:
    """(path, mtime, file_size, uri) below a folder: a listing, no file is opened."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    path = F.regexp_replace("path", rf"^[a-z0-9]*:?/{{0,2}}[^/]*\Q{base}\E/", "")
    out = rows.select(path.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("file_size"), F.col("path").alias("uri"))
    segments = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    out = out.filter(~F.arrays_overlap(segments, F.array(*[F.lit(x) for x in excluded])))
    for g in globs:
        for v in glob_variants(g):
            out = out.filter(~F.col("path").rlike(glob_regex(v)))
    return out.orderBy("path").limit(most) if most else out


def weight(scanned: DataFrame) -> DataFrame:
    """One row: files and bytes, from the listing alone."""
    return scanned.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"))


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop path, and the file's place in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, slash, path = rest.removeprefix("//").partition("/")
    store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return store, base.rstrip("/") + slash + path


def contents(listed: DataFrame, most: int = CODE_CAP) -> DataFrame:
    """`listed` with content_hash, content and binary, of files of at most `most` bytes; of larger ones only the hash.

    Executors open the files that are listed and no others, one after the other. A file that can't be read, any more or at all, has nulls
    there; the others go on.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema] + ["content_hash string", "content binary", "binary boolean"])
    names = [*listed.columns, "content_hash", "content", "binary"]

    def one(uri: str) -> tuple[str | None, bytes | None, bool | None]:
        digest, held, size, binary = hashlib.sha256(), [], 0, False
        try:
            store, place = _opened(uri)
            with store.open_input_stream(place) as file:
                while part := file.read(1 << 20):
                    binary = binary or (size == 0 and b"\0" in part[:8000])
                    digest.update(part)
                    size += len(part)
                    if size <= most:
                        held.append(part)
                    else:
                        held.clear()
        except OSError:
            return None, None, None
        return digest.hexdigest(), b"".join(held) if size <= most else None, binary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.binary(), pa.bool_())
        for batch in batches:
            uris = batch.column("uri").to_pylist()
            for lo in range(0, len(uris), 20):
                read = [one(u) for u in uris[lo : lo + 20]]
                made = [pa.array([r[k] for r in read], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, 20).columns, *made], names=names)

    return listed.mapInArrow(run, schema)


def loaded(scanned: DataFrame, cpp: bool = False, exempt: Iterable[str] = ()) -> DataFrame:
    """(path, mtime, file_size, category, language, content_hash, content, oversize) of what is code or text.

    Binary files (by name, or with a zero byte at the beginning) and text beyond its cap are left out; code beyond its cap
    stays without content, and so does what can't be read. Names and sizes are judged by the listing, before any file is opened.
    """
    rows = scanned.withColumn("_c", category(F.col("path"), cpp)).filter(F.col("_c.category") != "binary")
    name = F.element_at(F.split("path", "/"), -1)
    rows = rows.filter((F.col("_c.category") == "code") | (F.col("file_size") <= TEXT_CAP) | name.isin(*exempt))
    listed = rows.select("path", "mtime", "file_size", "_c.category", "_c.language", "uri")
    read = contents(listed).filter(~F.coalesce("binary", F.lit(False)))
    over = (F.col("category") == "code") & (F.col("file_size") > CODE_CAP)
    text = F.when(~over, F.try_validate_utf8(F.col("content").cast("string"))).alias("content")
    return read.select("path", "mtime", "file_size", "category", "language", "content_hash", text, over.alias("oversize"))


def parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that are parsed, and files that are searched as text: languages of DUAL are in both."""
    return files.filter("category = 'code'"), files.filter((F.col("category") == "text") | F.col("language").isin(*DUAL))


def dominant_language(paths: DataFrame, most: int = 4_000, aliases: Mapping[str, str] = {}) -> DataFrame:  # noqa: B006
    """One row: the language of most files, among the first `most` by path; ties by name."""
    language = category(F.col("path"))["language"]
    first = paths.orderBy("path").limit(most).select(language.alias("language")).filter("language IS NOT NULL AND language <> 'text'")
    return first.groupBy("language").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "language").limit(1)
