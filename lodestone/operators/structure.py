"""Chunks that follow a file's declarations: classes, functions and methods, and windows over what lies between.

Python is read with its own parser. Scripts are read from the tokens of a lexer by matching brackets, which finds classes, named functions and
methods, with type parameters, defaults, return types and decorators; arrow functions stay in the windows. A file that can't be read,
whose brackets don't match or that declares nothing falls back to overlapping line windows. Files are dealt over tasks once; each row carries its ranges."""

from __future__ import annotations

import ast
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.imports import FILE, MARKUP, SCRIPTS, extension
from lodestone.operators.lexer import Script
from lodestone.sources.tables import dealt

_KIND = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))
#: Words that a bracket may follow although they name no method.
_NOT_METHODS = frozenset(("if", "for", "while", "switch", "catch", "with", "function", "return", "await", "typeof", "new", "super"))
#: Words that a declaration may follow.
_BEFORE = frozenset(("export", "default", "async", "else", "do", "abstract", "declare"))

Range = tuple[str, str, int, int]


def of_python(source: str) -> list[Range]:
    """Functions outside functions, methods of classes, and classes without methods; decorators belong to them."""
    first = lambda n: min([n.lineno, *(d.lineno for d in n.decorator_list)])

    def visit(body: list, owner: str | None) -> list[Range]:
        out: list[Range] = []
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("method", f"{owner}.{n.name}", first(n), n.end_lineno) if owner else ("function", n.name, first(n), n.end_lineno))
            elif isinstance(n, ast.ClassDef):
                inner = visit(n.body, n.name)
                out += inner if any(r[0] == "method" for r in inner) else [("class", n.name, first(n), n.end_lineno)]
            else:
                for part in ("body", "handlers", "cases", "orelse", "finalbody"):
                    out += visit(getattr(n, part, None) or [], owner) if isinstance(getattr(n, part, None), list) else []
        return out

    return visit(ast.parse(source).body, None)


class _Declarations:
    """Ranges of a script's declarations, from its tokens; each is visited once, and bodies of functions are stepped over."""

    def __init__(self, t: Script):
        if not t.balanced:
            raise ValueError("brackets don't match")
        self.t, self.out = t, []
        self.words = [t.word(i) if k in "wp" else "" for i, k in enumerate(t.kind)]
        self.breaks = [i for i, c in enumerate(t.text) if c == "\n"] if "\n" in t.text else []
        self.line = [bisect_right(self.breaks, s) + 1 for s in t.start]

    def at(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def named(self, i: int) -> bool:
        return 0 <= i < len(self.words) and self.t.kind[i] == "w"

    def newline(self, i: int) -> bool:
        """Whether token i begins on a later line than the one before."""
        return 0 < i < len(self.line) and self.line[i] > self.line[i - 1]

    def add(self, kind: str, name: str, first: int, last: int) -> None:
        self.out.append((kind, name, self.line[first], self.line[last]))

    def past_types(self, i: int) -> int:
        """The token after type parameters that begin at i; i where none do."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.words):
            w = self.words[i]
            if w in ("(", "[", "{"):
                i = self.t.close[i]
            elif w == "<":
                depth += 1
            elif w == ">" and self.at(i - 1) != "=":
                depth -= 1
                if not depth:
                    return i + 1
            elif w in (";", "function", "class", ")", "]", "}"):
                return i
            i += 1
        return i

    def body(self, i: int) -> int:
        """The brace that opens the body after a list of parameters that begins at i; -1 where none does."""
        if self.at(i) != "(":
            return -1
        i = self.t.close[i] + 1
        if self.at(i) != ":":
            return i if self.at(i) == "{" else -1
        i += 1
        open_type = True  # a type is awaited, so a brace belongs to it
        while i < len(self.words):
            w = self.words[i]
            if w == "{" and not open_type:
                return i
            if w in (";", ",", ")", "]", "}", "=", "function", "class") and not (w == "=" and self.at(i + 1) == ">"):
                return -1
            if w == "<":
                i, open_type = self.past_types(i), False
                continue
            if w in ("(", "[", "{"):
                i = self.t.close[i]
                open_type = False
            elif w == "=":
                i, open_type = i + 1, True
            else:
                if self.newline(i) and not open_type and w not in ("|", "&"):
                    return -1
                open_type = w in ("|", "&", ":", "?", "is", "keyof", "typeof", "readonly", "extends", "asserts")
            i += 1
        return -1

    def declares(self, i: int) -> bool:
        """Whether the word at i begins a declaration and not a value."""
        if i == 0:
            return True
        if self.t.kind[i - 1] == "w" and self.words[i - 1] in _BEFORE:
            return self.words[i - 1] != "async" or self.declares(i - 1)
        if self.t.kind[i - 1] == "p":
            return self.words[i - 1] in ";{})" or self.words[i - 1] == "]" and self.newline(i)
        return self.newline(i)

    def walk(self, i: int, end: int, owner: str | None) -> None:
        """Tokens i to end; owner: the class around them."""
        while i < end:
            if self.t.kind[i] != "w" or self.at(i - 1) == ".":
                i += 1
                continue
            w = self.words[i]
            if w == "function":
                name = i + 2 if self.at(i + 1) == "*" else i + 1
                if self.named(name):
                    open_ = self.body(self.past_types(name + 1))
                    if open_ >= 0 and self.declares(i):
                        first = i - 1 if self.at(i - 1) == "async" else i
                        self.add("method" if owner else "function", f"{owner}.{self.words[name]}" if owner else self.words[name], first, self.t.close[open_])
                        i = self.t.close[open_]
            elif w == "class":
                open_ = self.class_body(i + 1)
                if open_ >= 0:
                    last = self.t.close[open_]
                    declared = self.declares(i) and self.named(i + 1) and self.words[i + 1] not in ("extends", "implements")
                    before = len(self.out)
                    self.members(open_ + 1, last, self.words[i + 1] if declared else owner)
                    if declared and not any(r[0] == "method" for r in self.out[before:]):
                        del self.out[before:]
                        self.add("class", self.words[i + 1], i - 1 if self.at(i - 1) == "abstract" else i, last)
                    i = last
            elif self.at(i + 1) == "(" and w not in _NOT_METHODS:
                first = i
                while self.at(first - 1) in ("async", "get", "set", "static", "*"):
                    first -= 1
                open_ = self.body(i + 1) if self.at(first - 1) in ("{", ",") else -1
                if open_ >= 0 and not self.newline(open_):
                    self.add("method" if owner else "function", f"{owner}.{w}" if owner else w, first, self.t.close[open_])
                    i = self.t.close[open_]
            i += 1

    def class_body(self, i: int) -> int:
        while i < len(self.words):
            w = self.words[i]
            if w == "{":
                return i
            if w in ("(", "["):
                i = self.t.close[i] + 1
            elif w == "<":
                i = max(self.past_types(i), i + 1)
            elif w in (";", ")", "]", "}", "=", ",") and not (w == "," and self.named(i + 1)) or w in ("class", "function"):
                return -1
            else:
                i += 1
        return -1

    def members(self, i: int, end: int, owner: str | None) -> None:
        while i < end:
            while self.at(i) == "@":  # decorators stay before the method
                i += 2
                while self.at(i) == ".":
                    i += 2
                if self.at(i) == "(":
                    i = self.t.close[i] + 1
            first, name = i, ""
            while i < end:
                w = self.words[i]
                if self.t.kind[i] in "ws":
                    name = ("#" if self.at(i - 1) == "#" else "") + self.t.word(i)
                elif w == "[":
                    name = self.t.text[self.t.start[i] : self.t.end[self.t.close[i]]]
                    i = self.t.close[i]
                elif w not in ("*", "#", "?", "!"):
                    break
                i += 1
                if i < end and self.newline(i) and self.at(i) not in ("(", "<", "=", ":", "{", "?", "!") and self.at(i - 1) not in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "*"):
                    break  # a field without a value
            if self.at(i) == "<":
                i = max(self.past_types(i), i + 1)
            if self.at(i) == "(" and i < end:
                open_ = self.body(i)
                if open_ >= 0:
                    self.add("method" if owner else "function", f"{owner}.{name}" if owner else name, first, self.t.close[open_])
                    i = self.t.close[open_] + 1
                    continue
                i = self.t.close[i] + 1
            if self.at(i) == "{" and i < end:
                self.walk(i, self.t.close[i], owner)
                i = self.t.close[i] + 1
            elif self.at(i) in (":", "=") and i < end:
                i = self.field(i, end, owner)
            elif first == i:
                i += 1

    def field(self, i: int, end: int, owner: str | None) -> int:
        """The end of a field whose type or value begins after i; declarations inside its value are found."""
        first, i = i + 1, i + 1
        while i < end and self.at(i) != ";":
            if self.newline(i) and i > first and (self.t.kind[i] in "ws" or self.at(i) in ("@", "#", "[", "*")) and (self.t.kind[i - 1] != "p" or self.at(i - 1) in (")", "]", "}", ">")) and self.at(i - 1) not in ("new", "await", "extends", "typeof", "keyof", "as", "is", "in", "of", "instanceof"):
                break
            i = self.t.close[i] + 1 if self.at(i) in ("(", "[", "{") else i + 1
        self.walk(first, min(i, end), owner)
        return i


def of_script(source: str, markup: bool = True) -> list[Range]:
    """The same for scripts, without decorators; raises ValueError if the brackets don't match."""
    d = _Declarations(Script(source, markup))
    d.walk(0, len(d.words), None)
    return d.out


def declared(content: Column, ext: Column) -> Column:
    """array<struct<kind, name, start_line, end_line>> in order; empty where nothing is found."""

    @F.arrow_udf("array<struct<kind: string, name: string, start_line: int, end_line: int>>")
    def found(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        out = []
        for t, e in zip(texts, kinds, strict=True):
            try:
                text, ext = t.as_py() or "", e.as_py()
                rows = of_python(text) if ext == ".py" else of_script(text, ext in MARKUP) if ext in SCRIPTS else []
            except (SyntaxError, ValueError, RecursionError, MemoryError):  # MemoryError: the parser's word for too deep a nesting
                rows = []
            out.append([dict(zip(("kind", "name", "start_line", "end_line"), r, strict=True)) for r in sorted(rows, key=lambda r: (r[2], r[3]))])
        return pa.array(out, _KIND)

    return found(content, ext)


def chunks(files: DataFrame, window: int = 40, overlap: int = 5) -> DataFrame:
    """(repository_id, path, kind, name, start_line, end_line, chunk) of files (repository_id, path, content); blank files and chunks give none."""
    x = files.select(*FILE, "content", extension(F.col("path")).alias("ext")).filter(F.col("content").rlike(r"\S"))
    x = dealt(x, *FILE)
    x = x.select(*FILE, declared(F.col("content"), F.col("ext")).alias("found"), F.split("content", "\n", -1).alias("lines"))
    n = F.size("lines")
    piece = lambda a, b: F.struct(F.lit("window").alias("kind"), F.lit(None).cast("string").alias("name"), a.alias("start_line"), b.alias("end_line"))
    none = F.array().cast("array<struct<kind: string, name: string, start_line: int, end_line: int>>")
    gap = lambda a, b: F.when(a > b, none).otherwise(F.transform(F.sequence(a, F.greatest(a, b), F.lit(window)), lambda s: piece(s, F.least(s + window - 1, b))))
    start = F.struct(F.lit(1).alias("next"), none.alias("out"))
    step = lambda acc, r: F.struct(F.greatest(acc["next"], r["end_line"] + 1).alias("next"), F.concat(acc["out"], gap(acc["next"], r["start_line"] - 1), F.array(r)).alias("out"))
    between = F.aggregate("found", start, step, lambda acc: F.concat(acc["out"], gap(acc["next"], n)))
    plain = F.transform(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(max(1, window - overlap))), lambda s: piece(s + 1, F.least(s + window, n)))
    x = x.select(*FILE, "lines", F.explode(F.when(F.size("found") > 0, between).otherwise(plain)).alias("__range"))
    x = x.select(*FILE, "__range.*", F.array_join(F.slice("lines", F.col("__range.start_line"), F.col("__range.end_line") - F.col("__range.start_line") + 1), "\n").alias("chunk"))
    return x.filter(F.col("chunk").rlike(r"\S"))
