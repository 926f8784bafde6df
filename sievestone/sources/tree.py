"""A source tree as a table of files, and the symbols of its Python files."""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Extension to language; of several languages with one extension the first counts.
LANGUAGES = (("py", "python"), ("js", "javascript"), ("jsx", "javascript"), ("ts", "typescript"), ("tsx", "typescript"), ("java", "java"), ("go", "go"), ("rs", "rust"), ("cpp", "cpp"), ("cc", "cpp"), ("hpp", "cpp"), ("h", "cpp"), ("c", "c"), ("rb", "ruby"), ("md", "markdown"), ("yaml", "yaml"), ("yml", "yaml"), ("json", "json"))
SYMBOL_SCHEMA = "file_id string, path string, symbol_id string, name string, kind string, start_line int, end_line int, signature string, decorators array<string>, parent_id string, parse_error boolean"


def ignore_pattern(globs: Sequence[str]) -> str:
    """One expression for all globs, each also at any depth."""
    parts = [fnmatch.translate(g).replace("\\Z", "$").replace("\\z", "$") for g in globs for g in (g, f"*/{g}")]
    return "|".join(f"(?:^{p})" for p in parts) if parts else "(?!)"


def language_of(path):
    ext = F.lower(F.element_at(F.split(path, "\\."), -1))
    out = F.lit(None).cast("string")
    for name, language in reversed(LANGUAGES):
        out = F.when(ext == name, language).otherwise(out)
    return out


def scan_tree(spark: SparkSession, root: str, ignore: Sequence[str] = ()) -> DataFrame:
    """(file_id, path, language, content_hash, line_count, text) of the files under root with
    a known extension and no ignored path; path is relative to root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").split("://")[-1]) + "/", "")
    x = files.select(rel.alias("path"), F.col("content")).filter(~F.col("path").rlike(ignore_pattern(ignore)))
    text = F.decode("content", "UTF-8")
    digest = F.sha2("content", 256)
    return x.select(tx.file_id(F.col("path"), digest).alias("file_id"), "path", language_of(F.col("path")).alias("language"), digest.alias("content_hash"), tx.line_count(text).alias("line_count"), text.alias("text")).filter("language is not null")


def _walk(tree: ast.AST, prefix: str, parent: str | None) -> Iterator[dict]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            sid = f"{prefix}:{node.name}:{node.lineno - 1}"
            is_class = isinstance(node, ast.ClassDef)
            yield {
                "symbol_id": sid, "name": node.name, "kind": "class" if is_class else "function", "start_line": node.lineno, "end_line": node.end_lineno,
                "signature": None if is_class else f"def {node.name}({ast.unparse(node.args)})", "decorators": [ast.unparse(d) for d in node.decorator_list], "parent_id": parent,
            }
            yield from _walk(node, prefix, sid)
        else:
            yield from _walk(node, prefix, parent)


def _symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    names = [x.split()[0] for x in SYMBOL_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for file_id, path, text in zip(batch["file_id"], batch["path"], batch["text"], strict=True):
            try:
                found = list(_walk(ast.parse(text), hashlib.sha256(path.encode()).hexdigest()[:16], None))
            except (SyntaxError, ValueError, RecursionError):
                rows.append({"file_id": file_id, "path": path, "parse_error": True})
                continue
            rows += [{"file_id": file_id, "path": path, "parse_error": False, **x} for x in found]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        yield out.where(out.notna(), None)


def python_symbols(files: DataFrame) -> DataFrame:
    """Functions and classes of Python files; a file that can't be parsed is one row with parse_error."""
    return files.filter("language = 'python'").select("file_id", "path", "text").mapInPandas(_symbols, SYMBOL_SCHEMA)


def _calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import hashlib

    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            try:
                tree = ast.parse(text)
            except (SyntaxError, ValueError, RecursionError):
                continue
            prefix = hashlib.sha256(path.encode()).hexdigest()[:16]

            def visit(node, owner, path=path, prefix=prefix):
                for child in ast.iter_child_nodes(node):
                    inner = f"{prefix}:{child.name}:{child.lineno - 1}" if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else owner
                    if isinstance(child, ast.Call) and owner:
                        f = child.func
                        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                        if name:
                            rows.append((path, owner, name, child.lineno))
                    visit(child, inner)

            visit(tree, None)
        yield pd.DataFrame(rows, columns=["path", "caller_id", "callee_name", "line"])


def call_edges(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_id, callee_id, line): calls within functions, resolved by name to a function of
    the same file, else to the only one of that name."""
    calls = files.filter("language = 'python'").select("path", "text").mapInPandas(_calls, "path string, caller_id string, callee_name string, line int")
    funcs = symbols.filter("kind = 'function'").select(F.col("path").alias("callee_path"), F.col("name").alias("callee_name"), F.col("symbol_id").alias("callee_id"))
    n = funcs.groupBy("callee_name").agg(F.count("*").alias("n"))
    hit = calls.join(funcs.join(n, "callee_name"), "callee_name").filter((F.col("path") == F.col("callee_path")) | (F.col("n") == 1))
    same = (F.col("path") == F.col("callee_path")).cast("int")
    best = F.max_by("callee_id", F.struct(same, F.col("callee_id")))
    return hit.groupBy("caller_id", "callee_name", "line").agg(best.alias("callee_id")).select("caller_id", "callee_id", "line").distinct()
