"""Entities, imports and JavaScript symbols of source files, and the resolution of imports."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_SCHEMA = "path string, name string, entity_type string, line int, module string, imported string, level int"
JS_SCHEMA = "path string, symbol_id string, name string, kind string, start_line int"
_JS = (
    ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)")),
    ("function", re.compile(r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>")),
    ("method", re.compile(r"^\s+(?:static\s+|async\s+|get\s+|set\s+)*([A-Za-z_$][\w$]*)\s*\([^;]*\)\s*\{\s*$")),
)
#: Words that look like methods to the last pattern.
_JS_WORDS = frozenset("if for while switch catch function return with else do".split())


def _entities_of(path: str, text: str) -> Iterator[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield path, a.asname or a.name.split(".")[0], "alias" if a.asname else "import", node.lineno, a.name, None, 0
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield path, a.asname or a.name, "alias" if a.asname else "import", node.lineno, node.module or "", a.name, node.level
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign)) else []
        for t in targets:
            if isinstance(t, ast.Name) and not t.id.startswith("__"):
                yield path, t.id, "config_constant" if t.id.upper() == t.id and any(map(str.isalpha, t.id)) else "variable", node.lineno, None, None, 0


def _entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in ENTITY_SCHEMA.split(", ")]
    for batch in batches:
        rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in _entities_of(p, t)]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        yield out.where(out.notna(), None)


def python_entities(files: DataFrame) -> DataFrame:
    """Imports, aliases, module-level variables and upper-case constants of Python files."""
    return files.filter("language = 'python'").select("path", "text").mapInPandas(_entities, ENTITY_SCHEMA)


def _js(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, text in zip(batch["path"], batch["text"], strict=True):
            prefix = hashlib.sha256(path.encode()).hexdigest()[:16]
            for i, line in enumerate(text.split("\n")):
                for kind, pattern in _JS:
                    m = pattern.match(line)
                    if m and m[1] not in _JS_WORDS:
                        rows.append((path, f"{prefix}:{m[1]}:{i}", m[1], kind, i + 1))
                        break
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in JS_SCHEMA.split(", ")])


def javascript_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and methods of JavaScript and TypeScript files, found line by line."""
    return files.filter("language in ('javascript', 'typescript')").select("path", "text").mapInPandas(_js, JS_SCHEMA)


def module_names(files: DataFrame) -> DataFrame:
    """(module, path): the dotted name of each Python file; a package is named by its folder."""
    dotted = F.translate(F.regexp_replace(F.regexp_replace("path", "\\.py$", ""), "(^|/)__init__$", ""), "/", ".")
    return files.filter("language = 'python'").select(dotted.alias("module"), "path")


def resolve_imports(entities: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, line, name, target_path, symbol_id): imports with the file, and where there is one
    the symbol, that they name. A relative import starts at its file's package; `from a
    import b` is the module a.b if there is one, else b of module a."""
    imports = entities.filter("entity_type in ('import', 'alias')")
    parts = F.split("path", "/")
    # One dot is the file's own folder, each further one its parent.
    home = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - F.col("level"), F.lit(0))), ".")
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.when(home != "", home), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    x = imports.withColumn("base", base).withColumn("inner", F.when(F.col("imported").isNotNull(), F.concat_ws(".", F.when(F.col("base") != "", F.col("base")), "imported")))
    m = module_names(files)
    x = x.join(m.select(F.col("module").alias("inner"), F.col("path").alias("inner_path")), "inner", "left")
    x = x.join(m.select(F.col("module").alias("base"), F.col("path").alias("base_path")), "base", "left")
    x = x.withColumn("target_path", F.coalesce("inner_path", "base_path")).filter("target_path is not null")
    top = symbols.filter("parent_id is null and not parse_error").groupBy(F.col("path").alias("target_path"), F.col("name").alias("imported")).agg(F.min_by("symbol_id", "start_line").alias("symbol_id"))
    x = x.join(top, ["target_path", "imported"], "left")
    return x.select("path", "line", "name", "target_path", F.when(F.col("inner_path").isNull(), F.col("symbol_id")).alias("symbol_id"))


def base_classes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst): class to base class by name, within the file or where the name is the only one."""
    classes = symbols.filter("kind = 'class'").select("path", "name", "symbol_id", "start_line")
    bases = files.filter("language = 'python'").select("path", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    bases = bases.select("path", (F.col("p") + 1).alias("start_line"), F.regexp_extract("line", "^\\s*class\\s+\\w+\\s*\\(([^)]*)\\)", 1).alias("b")).filter("b <> ''")
    each = classes.join(bases, ["path", "start_line"]).select("path", F.col("symbol_id").alias("src"), F.explode(F.split("b", "\\s*,\\s*")).alias("base"))
    each = each.withColumn("base", F.element_at(F.split(F.trim("base"), "\\."), -1))
    one = classes.groupBy("name").agg(F.count("*").alias("n"))
    target = classes.join(one, "name").select(F.col("name").alias("base"), F.col("path").alias("base_path"), F.col("symbol_id").alias("dst"), "n")
    return each.join(target, "base").filter((F.col("path") == F.col("base_path")) | (F.col("n") == 1)).select("src", "dst").distinct()
