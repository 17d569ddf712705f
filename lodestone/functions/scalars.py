"""Scalar functions over columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.sources.tables import LANGUAGES


def canonical_path(p: Column) -> Column:
    return F.array_join(F.filter(F.split(p, r"[\\/]+"), lambda x: x != ""), "/")


#: Types of nodes by what names them besides the type (fixed values): a path, a path and a symbol, or a plain name. A route has a method and a path.
PATH_TYPES = ("folder", "file", "service", "controller", "dbModel", "cache", "queue", "event", "configuration", "authComponent")
SYMBOL_TYPES = ("class", "interface", "function", "method")
NAME_TYPES = ("repository", "package")


def node_id(kind: Column, parts: Column, strict: bool = False) -> Column:
    """The id of a node from its type and the parts that name it (array<string>): type:path, type:path#symbol, route:METHOD:path or
    type:name. An unknown type gives null, or an error if strict; so does a type without the parts that it needs, but as null only."""
    part = lambda i: F.get(parts, F.lit(i))
    head = F.concat(kind, F.lit(":"))
    unknown = F.raise_error(F.concat(F.lit("no identity for nodes of type "), F.coalesce(kind, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return (
        F.when(kind.isin(*PATH_TYPES), F.concat(head, canonical_path(part(0))))
        .when(kind.isin(*SYMBOL_TYPES), F.concat(head, canonical_path(part(0)), F.lit("#"), part(1)))
        .when(kind == "route", F.concat(head, F.upper(part(0)), F.lit(":"), part(1)))
        .when(kind.isin(*NAME_TYPES), F.concat(head, part(0)))
        .otherwise(unknown)
    )


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("edge:"), source, F.lit("->"), kind, F.lit("->"), target)


def language_label(ext: Column) -> Column:
    out = F.lit("Plaintext")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def package_name(spec: Column, ext: Column) -> Column:
    two = F.substring_index(spec, "/", 2)
    return F.when(ext == ".py", F.substring_index(spec, ".", 1)).when(spec.startswith("@"), two).otherwise(F.substring_index(spec, "/", 1))


def normal_url(url: Column) -> Column:
    """One trailing .git goes first, then trailing slashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"\.git$", ""), "/+$", "")


def redacted_url(text: Column) -> Column:
    return F.regexp_replace(text, r"https://[^\s/@]+@", "https://[REDACTED]@")


#: The rules that class questions, in this order, on lower-cased text (fixed values). Word boundaries are ASCII ones.
WHY = r"(why|explain|how does)"
CYCLE = r"(cycle|cycles|circular|cyclic)"
PATH = r"\bpath\b.*\bfrom\b|\bfrom\b.*\bto\b.*\bpath\b"
DEPENDS = r"(depend(s|ency|encies)?|imports?)"
TRANSITIVE = r"(transitive(ly)?|all|indirect(ly)?|everything|entire)"
OUTGOING, INCOMING = r"what does .+ (imports?|depends? on)", r"(what|who) (imports?|depends? on)"
#: Categories that a question can have (fixed values).
CATEGORIES = ("pure_graph", "pure_semantic", "intelligence", "hybrid")


def _has(text: Column, pattern: str, whole: bool = True) -> Column:
    """Whether a text holds the pattern; the boundaries of Java's patterns are Unicode's, so they are spelled out. Patterns have them beside word
    characters only, so one look back or ahead will do."""
    pattern = rf"\b{pattern}\b" if whole else pattern
    return text.rlike(re.sub(r"\\b(?=[(\w])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])"))


def question_class(text: Column) -> Column:
    """The ordered rules on lower-cased text, as struct<category, mode, direction>."""
    t = F.lower(text)
    row = lambda c, m=None, d=None: F.struct(F.lit(c).alias("category"), (m if m is not None else F.lit(None).cast("string")).alias("mode"), (d if d is not None else F.lit(None).cast("string")).alias("direction"))
    mode = F.when(_has(t, TRANSITIVE), "transitive").otherwise("direct")
    way = F.when(_has(t, OUTGOING, False), "outgoing").when(_has(t, INCOMING, False), "incoming")
    return (
        F.when(_has(t, WHY), row("hybrid"))
        .when(_has(t, CYCLE), row("intelligence"))
        .when(_has(t, PATH, False), row("pure_graph", F.lit("path")))
        .when(_has(t, DEPENDS), row("pure_graph", mode, way))
        .otherwise(row("hybrid"))
    )


def is_category(name: Column) -> Column:
    """Whether a name is one of the categories; error isn't, and null isn't."""
    return F.coalesce(name.isin(*CATEGORIES), F.lit(False))


def email_key(email: Column) -> Column:
    return F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))


def location_label(path: Column, start: Column, end: Column) -> Column:
    """path:start-end."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def symbol_label(name: Column, kind: Column) -> Column:
    """name (kind), or the kind of a chunk without a name."""
    return F.when(F.length(name) > 0, F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(kind)


def citations(answer: Column) -> Column:
    """array<string> of the distinct path:start-end of [path:start-end], in order. A path holds neither : nor ]."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([^\]:]+:\d+-\d+)\]"), F.lit(1)))


#: Fields of a log record that are hidden: a name below any field, or below a chain of fields (fixed values).
SECRETS = ("password", "passwordHash", "accessToken", "refreshToken", "token", "encryptedToken", "authTag")
SECRET_PATHS = {("req", "headers"): ("authorization", "cookie")}
CENSORED = "[Redacted]"


def redacted_fields(record: Column) -> Column:
    """A JSON object with the values of SECRETS, one level down, and of SECRET_PATHS hidden; the fields of changed objects are sorted.

    Other JSON and texts that aren't JSON stay as they are."""
    hidden = F.parse_json(F.lit(f'"{CENSORED}"'))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    hide = lambda m, names: F.transform_values(m, lambda k, v: F.when(k.isin(*names), hidden).otherwise(v))
    again = lambda m: F.to_variant_object(m)

    def deeper(here: Column, second: str, names: tuple[str, ...]):
        return lambda name, x: F.when(here & (name == second) & fields(x).isNotNull(), again(hide(fields(x), names))).otherwise(x)

    def below(k: Column, v: Column) -> Column:
        out = F.transform_values(fields(v), lambda name, x: F.when(name.isin(*SECRETS), hidden).otherwise(x))
        for (first, second), names in SECRET_PATHS.items():
            out = F.transform_values(out, deeper(k == first, second, names))
        return F.when(fields(v).isNull(), v).otherwise(again(out))

    top = fields(F.try_parse_json(record))
    return F.coalesce(F.to_json(F.transform_values(top, below)), record)


#: What a stream's error event says without a message of its own (fixed value).
INTERRUPTED = "The response was interrupted."


def stream_event(block: Column) -> Column:
    """struct<kind, text> of a block of an event stream: token, done or error; null for malformed and other blocks."""
    lines = F.split(block, "\n")
    first = lambda prefix: F.get(F.filter(lines, lambda x: x.startswith(prefix)), F.lit(0))
    raw = F.substring(first("data: "), 7, 1 << 30)
    kind = F.coalesce(F.trim(F.substring(first("event: "), 8, 1 << 30)), F.lit("message"))
    data = F.try_parse_json(raw)
    text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(data, f"$.{name}", "variant")) == "STRING", F.try_variant_get(data, f"$.{name}", "string"))
    row = lambda k, t: F.struct(F.lit(k).alias("kind"), t.alias("text"))
    known = F.when(kind == "done", row("done", F.lit(None).cast("string"))).when(kind == "error", row("error", F.coalesce(text("message"), F.lit(INTERRUPTED))))
    return F.when(data.isNotNull(), F.coalesce(known, F.when(~kind.isin("done", "error") & text("token").isNotNull(), row("token", text("token")))))


#: Texts of errors that no repetition mends (fixed values).
PERMANENT = ("repository not found", "invalid username or token", "authentication failed", "not found", "permission denied")


def failure_class(message: Column) -> Column:
    """permanent or retryable; a null message is retryable."""
    m = F.lower(message)
    permanent = F.lit(False)
    for text in PERMANENT:
        permanent = permanent | m.contains(text)
    return F.when(permanent, "permanent").otherwise("retryable")


#: Accepted addresses of repositories (fixed value).
REPOSITORY = r"^https://github\.com/([\w.-]+)/([\w.-]+?)(\.git)?/?$"


def repository_name(url: Column) -> Column:
    """struct<owner, name> of an accepted address; null for any other text."""
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, REPOSITORY, i)
    return F.when(u.rlike(REPOSITORY), F.struct(part(1).alias("owner"), part(2).alias("name")))


def chars_per_second(chars: Column, ms: Column) -> Column:
    """Rounded to whole characters; null unless ms is positive."""
    return F.when(ms > 0, F.round(chars / ms * 1000).cast("long"))
