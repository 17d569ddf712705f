"""Import specifiers of source files, their resolution to files and packages, and the nodes and edges that follow.

Files are told apart by repository_id and path. A lexer in tasks finds the specifiers, a fold over path parts normalises them,
and one equi-join on the candidate paths resolves them, so no file meets all other files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import edge_id, package_name
from lodestone.operators import lexer
from lodestone.sources.tables import dealt, stage

#: What may follow a relative specifier, in order of preference (fixed values).
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
#: Scripts that may hold markup.
MARKUP = (".tsx", ".js", ".jsx", ".mjs", ".cjs")
FILE = ["repository_id", "path"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def specifiers(files: DataFrame) -> DataFrame:
    """(repository_id, path, ext, ordinal, specifier) of files (repository_id, path, content); other languages and null contents give none.

    They come in the order of the file, from a lexer that knows strings, comments, templates, regular expressions and markup, so text inside those
    is no import. `from x import y` gives x and `import a, b as c` gives a and b."""

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for t, e in zip(texts, kinds, strict=True):
            text, ext = t.as_py() or "", e.as_py()
            out.append(lexer.python_imports(text) if ext == ".py" else lexer.script_imports(text, ext in MARKUP))
        return pa.array(out, pa.list_(pa.string()))

    x = files.select(*FILE, extension(F.col("path")).alias("ext"), "content").filter(F.col("ext").isin(".py", *SCRIPTS))
    x = dealt(x, *FILE)  # a file's lexing costs far more than moving it
    return x.select(*FILE, "ext", F.posexplode(found("content", "ext")).alias("ordinal", "specifier"))


def normal_path(path: Column) -> Column:
    """Folds . and .. ; a .. beyond the root is dropped."""
    add = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add), "/")


def _relative_base(ext: Column, spec: Column) -> Column:
    """What follows the folder of a file: a script's specifier, or for Python the parents that the leading dots name and the module's path."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.concat(F.repeat(F.lit("../"), dots - 1), F.replace(F.regexp_extract(spec, r"^\.*(.*)$", 1), F.lit("."), F.lit("/")))
    return F.when(ext == ".py", module).otherwise(spec)


def resolved(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, specifier, target): the first candidate that is a file of the same repository, for each relative
    specifier; the others drop out. A Python package is the __init__.py of its folder."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    relative = specs.filter(F.col("specifier").startswith(".")).select(*FILE, "ext", "specifier").distinct()
    base = normal_path(F.concat(folder, _relative_base(F.col("ext"), F.col("specifier"))))
    scripts, python = F.array(*map(F.lit, SUFFIXES)), F.array(F.lit(".py"), F.lit("/__init__.py"))
    tails = F.when(F.col("ext") == ".py", python).otherwise(scripts)
    tried = relative.select(*FILE, "specifier", F.posexplode(F.transform(tails, lambda s: F.ltrim(F.concat(base, s), F.lit("/")))).alias("choice", "target"))
    known = tried.join(files.select("repository_id", F.col("path").alias("target")).distinct(), ["repository_id", "target"])
    return known.groupBy(*FILE, "specifier").agg(F.min_by("target", "choice").alias("target"))


def _packages(specs: DataFrame) -> DataFrame:
    bare = specs.filter(~F.col("specifier").startswith("."))
    return bare.select(*FILE, package_name(F.col("specifier"), F.col("ext")).alias("package"))


def package_nodes(specs: DataFrame) -> DataFrame:
    """(repository_id, id, type, label): one node for each package that a repository imports."""
    x = _packages(specs).select("repository_id", "package").distinct()
    return x.select("repository_id", F.concat(F.lit("package:"), "package").alias("id"), F.lit("package").alias("type"), F.col("package").alias("label"))


def import_edges(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, id, source, target, type): file to file for resolved relative specifiers, file to package for bare ones; distinct."""
    file = lambda c: F.concat(F.lit("file:"), c)
    specs = stage(specs)  # files are read once for both kinds
    inner = resolved(specs, files).select("repository_id", file(F.col("path")).alias("source"), file(F.col("target")).alias("target"))
    outer = _packages(specs).select("repository_id", file(F.col("path")).alias("source"), F.concat(F.lit("package:"), "package").alias("target"))
    x = inner.unionByName(outer).distinct()
    return x.select("repository_id", edge_id(F.col("source"), F.lit("imports"), F.col("target")).alias("id"), "source", "target", F.lit("imports").alias("type"))
