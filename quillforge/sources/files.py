"""Source trees as tables: which files count, their language, and the entry points that files name."""

from __future__ import annotations

import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..io import importable, written

#: Directories and extensions that never count; the most bytes of a file.
IGNORED_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".next", ".turbo", "target", "vendor", ".idea", ".vscode"]
BINARY_EXTENSIONS = (
    ".png .jpg .jpeg .gif .ico .bmp .svg .pdf .zip .tar .gz .bz2 .7z .rar .woff .woff2 .ttf .eot .otf "
    ".mp4 .mp3 .wav .mov .avi .exe .dll .so .dylib .class .pyc .jar .wasm .db .sqlite .sqlite3 .lock"
).split()
MOST_BYTES = 1 << 20
#: Languages by extension and by interpreter.
LANGUAGES = {".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
INTERPRETERS = {"python": "python", "node": "javascript"}
#: What starts a service or a worker in a container command, in this order.
HTTP_COMMANDS = ["uvicorn", "gunicorn", "flask run", "npm start", "npm run dev"]
WORKER_COMMANDS = ["celery", "arq", "worker"]


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """SRC-04: (path, content, length) of all regular files below a directory or address, path from there, in order of paths.

    Spark's own readers leave out names that begin with a dot or underscore. So
    directories are listed here, one level after the other, each by a task; then
    tasks read the contents (null beyond most_bytes). Symbolic links are not followed.
    """
    importable(spark)
    uri = root if "://" in root else f"file://{os.path.abspath(root)}"

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        base, local = base.rstrip("/"), isinstance(system, fs.LocalFileSystem)
        for batch in batches:
            for folder in batch["path"]:
                rows = []
                for f in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
                    if f.type in (fs.FileType.File, fs.FileType.Directory) and not (local and os.path.islink(f.path)):
                        rows.append((f.path[len(base) :].lstrip("/"), f.size, f.type == fs.FileType.Directory))
                yield pd.DataFrame(rows, columns=["path", "length", "folder"]).astype({"length": "Int64"})

    folders, levels = spark.createDataFrame([("",)], "path string"), []
    while not folders.isEmpty():
        levels.append(written(folders.mapInPandas(listed, "path string, length long, folder boolean"), "listing"))
        folders = levels[-1].where("folder").select("path").repartition("path")
    names = levels[0]
    for level in levels[1:]:
        names = names.unionByName(level)
    names = names.where("NOT folder").select("path", "length").repartitionByRange("path").sortWithinPartitions("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for path, length in zip(batch["path"], batch["length"], strict=True):
                content = None
                if length <= most_bytes:
                    with system.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        content = f.read()
                yield pd.DataFrame({"path": [path], "content": [content], "length": [length]})

    return names.mapInPandas(run, "path string, content binary, length long")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last extension with its dot, lower-cased; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def in_ignored_dir(path: Column) -> Column:
    """SRC-05: a directory of the path (not the file's name) is among the ignored ones."""
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, IGNORED_DIRS)))


def looks_binary(path: Column, content: Column) -> Column:
    """SRC-07: by extension, or a NUL among the first 8,192 bytes."""
    return extension(path).isin(BINARY_EXTENSIONS) | F.hex(F.substring(content, 1, 8192)).rlike("^(?:..)*00")


def language(path: Column, content: Column) -> Column:
    """SRC-08, SRC-09: by extension; by the interpreter of the first line for a file without extension."""
    line = F.trim(F.regexp_extract(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), r"^#!([^\n]*)", 1))
    words = F.split(line, r"\s+")
    program = F.substring_index(F.when(F.get(words, F.lit(0)).endswith("env"), F.element_at(words, -1)).otherwise(F.get(words, F.lit(0))), "/", -1)
    by_line = F.lit(None).cast("string")
    for name, lang in INTERPRETERS.items():
        by_line = F.when(program.startswith(name), lang).otherwise(by_line)
    by_extension = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(extension(path) != "", F.try_element_at(by_extension, extension(path))).otherwise(by_line)


def _rules(text: str) -> list[tuple[str, bool]]:
    """The lines of a .gitignore file as patterns of whole paths, and whether they take a path in again; the last line that matches decides."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:].lstrip("\\")
        dirs = line.endswith("/")
        anchored = "/" in line.rstrip("/")
        line = line.strip("/")
        parts = ["(?:.*/)?" if p == "**" else "/".join([re.sub(r"\(\?s:(.*)\)\\[zZ]", r"\1", fnmatch.translate(p)).replace(".*", "[^/]*")]) + "/" for p in line.split("/")]
        pattern = "".join(parts).removesuffix("/")
        rules.append((("" if anchored else "(?:.*/)?") + pattern + ("/.*" if dirs else "(?:/.*)?") + "$", keep))

    return rules


def _matcher(text: str):
    """The rules of a .gitignore text as a function of a path."""
    rules = [(re.compile(pattern, re.S), keep) for pattern, keep in _rules(text)]

    def ignored(path: str) -> bool:
        out = False
        for rule, keep in rules:
            if rule.match(path):
                out = not keep
        return out

    return ignored


def gitignored(text: str, path: Column) -> Column:
    """SRC-06: whether the root .gitignore text excludes a path; the last rule that fits decides."""
    out = F.lit(False)
    for pattern, keep in _rules(text):
        out = F.when(path.rlike(f"(?s)^(?:{pattern})"), F.lit(not keep)).otherwise(out)
    return out


def walk(files: DataFrame, gitignore: str | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """SRC-04..09: the files that count, with their language, by (path, content, length)."""
    importable(files.sparkSession)
    kept = files.where(~in_ignored_dir(F.col("path")) & (F.col("length") > 0) & (F.col("length") <= most_bytes) & ~looks_binary(F.col("path"), F.col("content")))
    if gitignore:
        kept = kept.where(~gitignored(gitignore, F.col("path")))
    return kept.withColumn("language", language(F.col("path"), F.col("content")))


def unzip(archives: DataFrame, max_files: int = 5000, max_bytes: int = 50 << 20) -> DataFrame:
    """SRC-02, SRC-03: (archive, path, content, length, verdict) of the members of zip files; one row without member for a refused archive.

    archives(archive, content). The directory is judged before anything is unpacked.
    """
    importable(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                rows, verdict = [], "ok"
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        members, total = z.infolist(), 0
                        if len(members) > max_files:
                            verdict = "too many files"
                        for m in members if verdict == "ok" else ():
                            total += m.file_size
                            depth = 0
                            for p in m.filename.split("/"):
                                depth += -1 if p == ".." else p not in ("", ".")
                                if depth < 0:
                                    break
                            if total > max_bytes:
                                verdict = "too large"
                            elif depth < 0 or m.filename.startswith("/"):
                                verdict = "outside"
                            if verdict != "ok":
                                break
                        if verdict == "ok":
                            rows = [(name, m.filename, z.read(m), m.file_size, "ok") for m in members if not m.is_dir()]
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    verdict = "not a zip file"
                yield pd.DataFrame(rows if verdict == "ok" else [(name, None, None, 0, verdict)], columns=["archive", "path", "content", "length", "verdict"])

    return archives.select("archive", "content").mapInPandas(run, "archive string, path string, content binary, length long, verdict string")


MANIFEST = "description string, clips array<struct<id string, reference string, category string, source string, expected_identifiers array<string>, vocabulary array<string>>>"


def manifests(spark: SparkSession, path: str, schema: str = MANIFEST, items: str = "clips") -> DataFrame:
    """SRC-19: (file, hash, description, item..., broken) of evaluation manifests, one JSON document a file, below a path: a row for each item, with the first 12 digits of its file's SHA-256; a file that is no such document gives one row with broken = true and no item."""
    docs = spark.read.schema(f"{schema}, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path).select("*", F.col("_metadata.file_path").alias("file"))
    bytes_ = spark.read.format("binaryFile").load(path).select(F.col("path").alias("_path"), F.left(F.sha2("content", 256), F.lit(12)).alias("hash"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = docs.join(bytes_, plain(F.col("file")) == plain(F.col("_path")))
    return joined.select("file", "hash", "description", F.explode_outer(items).alias("_i"), F.col("_broken").isNotNull().alias("broken")).select("file", "hash", "description", "_i.*", "broken")


def package_json_entry_points(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """SRC-12: main and the scripts start, dev and serve; nothing for malformed documents."""
    doc = F.try_parse_json(F.col(text))
    string = lambda p: F.when(F.schema_of_variant(F.try_variant_get(doc, p, "variant")) == "STRING", F.try_variant_get(doc, p, "string"))
    rows = [F.struct(F.lit("cli").alias("kind"), F.concat(F.lit('package.json "main": "'), string("$.main"), F.lit('"')).alias("reason"))]
    rows += [F.struct(F.lit("http").alias("kind"), F.concat(F.lit(f'package.json script "{s}": "'), string(f"$.scripts.{s}"), F.lit('"')).alias("reason")) for s in ("start", "dev", "serve")]
    return files.select(F.col(path).alias("file"), F.explode(F.array(*rows)).alias("p")).select("file", "p.kind", "p.reason").where("reason IS NOT NULL")


def command_kind(command: Column) -> Column:
    """FLT-12: http before worker before cli."""
    low, some = F.lower(command), lambda words: "|".join(map(re.escape, words))
    return F.when(low.rlike(some(HTTP_COMMANDS)), "http").when(low.rlike(some(WORKER_COMMANDS)), "worker").otherwise("cli")


def dockerfile_entry_points(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """SRC-13: every CMD and ENTRYPOINT line."""
    lines = files.select(F.col(path).alias("file"), F.explode(F.regexp_extract_all(text, F.lit(r"(?m)^(\s*(?:CMD|ENTRYPOINT)\s+.*)$"), 1)).alias("line"))
    command = F.trim(F.regexp_extract("line", r"(?:CMD|ENTRYPOINT)\s+(.*)$", 1))
    return lines.select("file", command_kind(command).alias("kind"), F.concat(F.lit("Dockerfile "), F.regexp_extract("line", r"(CMD|ENTRYPOINT)", 1), F.lit(" "), command).alias("reason"))


def audio_format(content: Column) -> Column:
    """SRC-20: the container by its first 12 bytes; null for none."""
    head = F.hex(F.substring(content, 1, 12))
    at = lambda i, n: F.substring(head, 2 * i + 1, 2 * n)
    return F.when(at(0, 4) == "1A45DFA3", "webm").when(at(4, 4) == "66747970", "mp4").when((at(0, 4) == "52494646") & (at(8, 4) == "57415645"), "wav").when(at(0, 4) == "4F676753", "ogg")


def audio_verdict(content: Column, most_bytes: int) -> Column:
    """SRC-20: ok, or why a recording is refused."""
    n = F.octet_length(content)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > most_bytes, "too large").when(audio_format(content).isNull(), "unsupported").otherwise("ok")


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """BIN-01: float samples, clipped to [-1, 1], as 16-bit PCM with a 44-byte header."""
    import struct

    import numpy as np

    def one(x, r):
        body = (np.clip(np.asarray(x, dtype=np.float64), -1, 1) * 32767).astype("<i2").tobytes()
        return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, int(r), int(r) * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body

    return pd.Series([one(x, r) for x, r in zip(samples, rate, strict=True)])


def resample(samples: Column, source: int, target: int) -> Column:
    """MTH-03: linear interpolation to another rate, clipped to [-1, 1]."""
    n = F.size(samples)
    count = F.floor(n * F.lit(target) / source).cast("int")
    at = lambda i: F.get(samples, F.least(i, n - 1))

    def value(i):
        x = i * F.lit(source / target)
        low = F.floor(x).cast("int")
        y = at(low) + (x - low) * (at(low + 1) - at(low))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), value)).otherwise(F.array().cast("array<double>"))


def prompts(files: DataFrame) -> DataFrame:
    """UDF-06, SRC-16: (name, version, system, user) of prompt files `name.v1.md`, each with two fenced blocks at least; files(path, text). A file without them is an error when it is read."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?ms)^```[^\n]*\n(.*?)^```"), 1)
    block = lambda n: F.when(F.size(blocks) >= 2, F.trim(F.regexp_replace(F.get(blocks, F.lit(n)), r"^\s+|\s+$", ""))).otherwise(F.raise_error(F.concat(F.lit("a prompt needs two fenced blocks: "), "path")))
    stem = F.regexp_extract("path", r"([^/]*)\.v(\d+)\.md$", 1)
    return files.where(F.col("path").rlike(r"\.v\d+\.md$")).select(stem.alias("name"), F.regexp_extract("path", r"\.v(\d+)\.md$", 1).cast("int").alias("version"), block(0).alias("system"), block(1).alias("user"))


def prompt_blocks(text: str) -> tuple[str, str]:
    """SRC-16: the two fenced blocks of a prompt file; an error if they lack."""
    found = re.findall(r"^```[^\n]*\n(.*?)^```", text, re.S | re.M)
    if len(found) < 2:
        raise ValueError("a prompt needs two fenced blocks")
    return found[0].strip(), found[1].strip()


def load_prompt(folder: str, name: str, version: str = "v1") -> tuple[str, str]:
    """UDF-06, SRC-16: the blocks of a prompt's version, read on the driver."""
    with open(os.path.join(folder, f"{name}.{version}.md"), encoding="utf-8") as f:
        return prompt_blocks(f.read())
