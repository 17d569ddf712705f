"""Tokens of scripts and statements of Python, read in one pass over a file.

A script is read with a stack of modes: code, templates with their substitutions, tags of markup and what stands between
them. Strings, comments and regular expressions are one token or none, so what they hold is never taken for code. Each character is
looked at a bounded number of times, whatever the file holds."""

from __future__ import annotations

import re

#: Words after which an expression begins, so that a slash begins a regular expression and < a tag.
BEFORE_VALUES = frozenset("return typeof case in of delete void throw new instanceof do else yield await default extends".split())
_PAIR = {")": "(", "]": "[", "}": "{"}
_CODE = re.compile(r"\s++|(?P<w>[\w$]++)|(?P<c>//[^\n]*+)|(?P<p>[\s\S])")
_STRING = {q: re.compile(rf"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+{q}") for q in "'\""}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/\w*+")
_TEMPLATE = re.compile(r"`|\$\{|\\[\s\S]")
_TAG = re.compile(r"\s++|/>|/\*|[{>'\"]|[^\s{>'\"/]++|/")
_CHILD = re.compile(r"[{<]")
_OPENS_TAG = re.compile(r"<(?:>|[A-Za-z_$])")
_GENERIC = re.compile(r"<\s*[\w$.]+\s*(?:,|extends\b|=)|<[A-Z]\d?>\s*\(")


class Script:
    """kind, start and end of each token: w word or number, s string, r other value (template, regular expression, element), p character.

    close: the number of each bracket's partner; balanced: whether every bracket has one."""

    def __init__(self, text: str, markup: bool = False):
        self.text, self.kind, self.start, self.end = text, [], [], []
        self.close: dict[int, int] = {}
        self.balanced = True
        self._read(markup)

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]] if 0 <= i < len(self.kind) else ""

    def _add(self, kind: str, start: int, end: int) -> int:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        return end

    def _value_follows(self) -> bool:
        if not self.kind:
            return True
        last = self.word(len(self.kind) - 1)
        return last in BEFORE_VALUES if self.kind[-1] == "w" else self.kind[-1] == "p" and last not in ")]"

    def _read(self, markup: bool) -> None:
        text, n, pos = self.text, len(self.text), 0
        modes: list[tuple[str, int]] = []  # brackets, ` for templates, T for tags, C for what elements hold; with the number of the token
        dead = dict.fromkeys("'\"/", 0)  # up to there no such literal ends
        while pos < n:
            mode = modes[-1][0] if modes else ""
            if mode == "`":
                m = _TEMPLATE.search(text, pos)
                if not m:
                    break
                pos = m.end()
                if m[0] == "`":
                    modes.pop()
                    self._add("r", m.start(), pos)
                elif m[0] == "${":
                    modes.append(("{", len(self.kind)))
                    self._add("p", pos - 1, pos)
                continue
            if mode == "T":
                m = _TAG.match(text, pos)
                c, pos = m[0], m.end()
                if c == "{":
                    modes.append(("{", len(self.kind)))
                    self._add("p", pos - 1, pos)
                elif c in "'\"":
                    pos = text.find(c, pos) + 1 or n
                elif c == "/*":
                    pos = text.find("*/", pos) + 2 if text.find("*/", pos) >= 0 else n
                elif c == "/>":
                    modes.pop()
                    self._add("r", pos - 2, pos)
                elif c == ">":
                    modes[-1] = ("C", modes[-1][1])
                continue
            if mode == "C":
                m = _CHILD.search(text, pos)
                if not m:
                    break
                pos = m.end()
                if m[0] == "{":
                    modes.append(("{", len(self.kind)))
                    self._add("p", pos - 1, pos)
                elif text.startswith("/", pos):
                    pos = text.find(">", pos) + 1 or n
                    modes.pop()
                    self._add("r", pos - 1, pos)
                else:
                    modes.append(("T", len(self.kind)))
                continue
            m = _CODE.match(text, pos)
            at, pos = pos, m.end()
            if m.lastgroup == "w":
                self._add("w", at, pos)
            elif m.lastgroup == "p":
                c = m[0]
                if c in "'\"":
                    k = _STRING[c].match(text, at) if at >= dead[c] else None
                    if k:
                        pos = self._add("s", at, k.end())
                    else:
                        dead[c] = dead[c] if at < dead[c] else text.find("\n", at) + 1 or n
                        self._add("p", at, pos)
                elif c == "/" and text.startswith("*", pos):
                    pos = text.find("*/", pos + 1) + 2 if text.find("*/", pos + 1) >= 0 else n
                elif c == "/" and at >= dead["/"] and self._value_follows():
                    k = _REGEX.match(text, at)
                    if k:
                        pos = self._add("r", at, k.end())
                    else:
                        dead["/"] = text.find("\n", at) + 1 or n
                        self._add("p", at, pos)
                elif c == "`":
                    modes.append(("`", len(self.kind)))
                elif c in "([{":
                    modes.append((c, len(self.kind)))
                    self._add("p", at, pos)
                elif c in _PAIR:
                    if modes and modes[-1][0] == _PAIR[c]:
                        self.close[modes.pop()[1]] = len(self.kind)
                    else:
                        self.balanced = False
                    self._add("p", at, pos)
                elif c == "<" and markup and self._value_follows() and _OPENS_TAG.match(text, at) and not _GENERIC.match(text, at):
                    modes.append(("T", len(self.kind)))
                else:
                    self._add("p", at, pos)
        self.balanced &= not modes


def script_imports(text: str, markup: bool = False) -> list[str]:
    """Specifiers of import statements and of calls of require, in order; `export … from` and dynamic imports are none."""
    t = Script(text, markup)
    n, out = len(t.kind), []
    string = [n] * (n + 1)  # the first string from each token on
    for i in range(n - 1, -1, -1):
        string[i] = i if t.kind[i] == "s" and t.end[i] - t.start[i] > 2 else string[i + 1]
    i = 0
    while i < n:
        word, i = t.word(i) if t.kind[i] == "w" else "", i + 1
        if word not in ("import", "require") or i > 1 and t.kind[i - 2] == "p" and t.word(i - 2) == ".":
            continue
        if word == "require":
            if t.word(i) == "(" and string[i] < t.close.get(i, 0):
                out.append(text[t.start[string[i]] + 1 : t.end[string[i]] - 1])
            continue
        while i < n and (t.kind[i] == "w" and t.word(i) != "import" or t.kind[i] == "p" and t.word(i) in "{},*"):
            i += 1
        if i < n and t.kind[i] == "s" and t.word(i - 1) in ("import", "from") and t.end[i] - t.start[i] > 2:
            out.append(text[t.start[i] + 1 : t.end[i] - 1])
    return out


_PYTHON = re.compile(r"""(?:[ \t\f\r]++|\\\r?\n|\#[^\n]*+)++|(?P<w>\.*+\w++(?:\.\w++)*+|\.++)|(?P<q>"{3}|'{3}|["'])|(?P<p>[\s\S])""")
_LONG = {q * 3: re.compile(rf"{q}{{3}}[^{q}\\]*+(?:(?:\\[\s\S]|{q}(?!{q}{q}))[^{q}\\]*+)*+{q}{{3}}") for q in "'\""}
_RESTARTS = re.compile(r"from[ \t]+[.\w]+[ \t]+import\b|import[ \t]+\w")


def _imported(words: list[str] | None) -> list[str]:
    """The modules of a statement, whose words are given up to the first that can't belong to an import."""
    if not words or words[0] not in ("import", "from"):
        return []
    if words[0] == "from":
        at = words.index("import") if "import" in words else 0
        return ["".join(words[1:at])] if at > 1 else []
    return [w for before, w in zip(words, words[1:], strict=False) if before in ("import", ",") and w != ","]


def python_imports(text: str) -> list[str]:
    """Modules of import statements, in order: `from x import y` gives x, and `import a, b as c` gives a and b.

    A statement begins at a line outside brackets and after ; and :, outside strings and comments. A line that begins like an import inside
    brackets ends them, as no valid file has such a line."""
    n, pos, depth, out = len(text), 0, 0, []
    words: list[str] | None = []  # of the statement; None where it is none that imports
    while pos < n:
        m = _PYTHON.match(text, pos)
        at, pos = pos, m.end()
        if m.lastgroup == "w":
            if words is not None and not depth:
                w = m[0]
                if not words and w not in ("import", "from"):
                    words = ["from", w[4:]] if w.startswith("from.") else None
                else:
                    words.append(w)
        elif m.lastgroup == "q":
            k = (_LONG if len(m[0]) == 3 else _STRING)[m[0]].match(text, at)
            words = words if words and words[0] == "from" else None
            if k:
                pos = k.end()
            elif len(m[0]) == 3:
                break
            else:  # it isn't closed: the rest of the line
                pos = text.find("\n", at) if text.find("\n", at) >= 0 else n
        elif m.lastgroup == "p":
            c = m[0]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            elif c == "\n" and depth and _RESTARTS.match(text, pos) or c in "\n;" and not depth:
                out += _imported(words)
                words, depth = [], 0
            elif c == ":" and not depth:
                words = []
            elif c == "," and words:
                words.append(c)
            elif c not in "\n," and not depth:
                words = None
    return out + _imported(words)
