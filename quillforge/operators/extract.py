"""Units, imports and calls from source text, as table-valued functions."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..io import importable
from . import javascript

UNITS = "path string, unit_type string, name string, line_start int, line_end int, signature string, docstring string"
FACTS = "path string, main_guard boolean, calls array<string>, imports array<struct<raw:string,kind:string,names:array<string>,level:int>>, units array<struct<unit_type:string,name:string,line_start:int,line_end:int,signature:string,docstring:string>>"
#: Constructors and calls that make a file an entry point.
CONSTRUCTORS = {"FastAPI": ("http", "instantiates FastAPI()"), "Flask": ("http", "instantiates Flask()"), "Celery": ("worker", "instantiates Celery()")}
DOTTED_CALLS = {"uvicorn.run": ("http", "calls uvicorn.run()")}


def _doc(node) -> str | None:
    body = getattr(node, "body", None) or []
    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        return body[0].value.value.strip() or None
    return None


def _dotted(f) -> str | None:
    parts = []
    while isinstance(f, ast.Attribute):
        parts.append(f.attr)
        f = f.value
    return ".".join([f.id, *reversed(parts)]) if isinstance(f, ast.Name) else None


def _unit(kind: str, name: str, node, lines: list[str]) -> dict:
    """A unit from its first decorator to its end; the signature is what stands before the colon, on one line."""
    body = node.body[0]
    last = min([body.lineno, *[d.lineno for d in getattr(body, "decorator_list", [])]])
    head = lines[node.lineno - 1 : last]
    if last == body.lineno:
        head[-1] = head[-1].encode()[: body.col_offset].decode(errors="ignore")
    elif len(head) > 1:
        head.pop()
    kept = (x.strip() for x in head)
    signature = " ".join(x for x in kept if x and not x.startswith("#")).rstrip(": ")
    first = min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])
    return {"unit_type": kind, "name": name, "line_start": first, "line_end": node.end_lineno, "signature": signature, "docstring": _doc(node)}


def parse_python(text: str) -> dict:
    """TVF-01..06: top-level functions, classes and methods, calls in order, imports, and a __main__ guard at module level. Nested functions are part of their unit."""
    out = {"main_guard": False, "calls": [], "imports": [], "units": []}
    if not text.strip():
        return out
    lines = text.split("\n")
    out["units"].append({"unit_type": "module", "name": "", "line_start": 1, "line_end": text.count("\n") + 1, "signature": None, "docstring": None})
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    out["units"][0]["docstring"] = _doc(tree)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for node in tree.body:
        if isinstance(node, functions):
            out["units"].append(_unit("function", node.name, node, lines))
        elif isinstance(node, ast.ClassDef):
            out["units"].append(_unit("class", node.name, node, lines))
            out["units"] += [_unit("function", f"{node.name}.{m.name}", m, lines) for m in node.body if isinstance(m, functions)]
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare):
            sides = [node.test.left, *node.test.comparators]
            out["main_guard"] |= any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(isinstance(s, ast.Constant) and s.value == "__main__" for s in sides)
    for node in sorted((n for n in ast.walk(tree) if isinstance(n, (ast.Call, ast.Import, ast.ImportFrom))), key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Call):
            if (name := _dotted(node.func)) and name not in out["calls"]:
                out["calls"].append(name)
        elif isinstance(node, ast.Import):
            out["imports"] += [{"raw": a.name, "kind": "py_plain", "names": [], "level": 0} for a in node.names]
        else:
            out["imports"].append({"raw": "." * node.level + (node.module or ""), "kind": "py_from", "names": [a.name for a in node.names], "level": node.level})
    return out


def parse_javascript(text: str) -> dict:
    """TVF-07..09: top-level functions, classes, methods and functions given to names, with documentation comments; import statements and single-string requires."""
    out = {"main_guard": False, "calls": [], "imports": [], "units": []}
    if not text.strip():
        return out
    module = {"unit_type": "module", "name": "", "line_start": 1, "line_end": text.count("\n") + 1, "signature": None, "docstring": None}
    try:
        units, raws = javascript.parse(text)
    except RecursionError:  # templates and elements nested by the hundred
        units, raws = [], []
    out["units"] = [module, *units]
    out["imports"] = [{"raw": raw, "kind": "js_relative" if raw.startswith(".") else "js_bare", "names": [], "level": 0} for raw in raws]
    return out


def parse(files: DataFrame) -> DataFrame:
    """One row of facts for each of files(path, language, text); a blank file has no units.

    The work is a parse for each file, however few bytes they have as a table, so files are dealt to
    as many parts as a shuffle has, four for each core at least; a small table would be one task.
    """
    spark = files.sparkSession
    importable(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"path": p, **(parse_python(t or "") if lang == "python" else parse_javascript(t or ""))} for p, lang, t in zip(batch["path"], batch["language"], batch["text"], strict=True)], columns=["path", "main_guard", "calls", "imports", "units"])

    return files.where(F.col("language").isNotNull()).select("path", "language", "text").repartition(parts, "path").mapInPandas(run, FACTS)


def units(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("units").alias("u")).select("path", "u.*")


def imports(parsed: DataFrame) -> DataFrame:
    return parsed.select("path", F.explode("imports").alias("i")).select("path", "i.*")


def entry_points(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """TVF-10, JON-11: (file, kind, reason) of Python files."""
    py = files.where(F.col("path").endswith(".py"))
    manage = py.where(F.substring_index("path", "/", -1) == "manage.py").select(F.col("path").alias("file"), F.lit("cli").alias("kind"), F.lit("manage.py (Django management entrypoint)").alias("reason"))
    facts = parsed.join(py.select("path"), "path", "left_semi")  # files that share a path stay apart
    guard = facts.where("main_guard").select(F.col("path").alias("file"), F.lit("cli").alias("kind"), F.lit('if __name__ == "__main__": guard').alias("reason"))
    called = facts.select("path", F.explode("calls").alias("call"))
    known = F.create_map(*[x for k, (a, b) in {**CONSTRUCTORS}.items() for x in (F.lit(k), F.struct(F.lit(a).alias("kind"), F.lit(b).alias("reason")))])
    dotted = F.create_map(*[x for k, (a, b) in DOTTED_CALLS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("kind"), F.lit(b).alias("reason")))])
    hits = called.select("path", F.explode(F.array(F.try_element_at(known, F.substring_index("call", ".", -1)), F.try_element_at(dotted, F.col("call")))).alias("p")).where("p IS NOT NULL").select(F.col("path").alias("file"), "p.kind", "p.reason")
    worker = facts.where(F.exists("units", lambda u: (u["unit_type"] == "class") & (u["name"] == "WorkerSettings"))).select(F.col("path").alias("file"), F.lit("worker").alias("kind"), F.lit("defines an arq WorkerSettings class").alias("reason"))
    return manage.unionByName(guard).unionByName(hits).unionByName(worker)


def html_units(pages: DataFrame) -> DataFrame:
    """The same idea for web pages: headings and paragraphs as units, in order, found by patterns."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<((?:h1|p|title)>[^<]*)<"), 1)).alias("ord", "raw"))
    return found.select("page_id", "ord", F.substring_index("raw", ">", 1).alias("unit_type"), F.expr("substring(raw, length(substring_index(raw, '>', 1)) + 2)").alias("name")).where("name <> ''")
