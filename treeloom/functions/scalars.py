"""Column functions of the library; all run in the JVM."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: Every separator of str.splitlines().
LINE_END = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """A quarter of the code points, at least 1; 0 for no text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def lines(text: Column) -> Column:
    """The lines of a text; one empty last line is dropped."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)^[\\s\\x{1c}-\\x{1f}]+|[\\s\\x{1c}-\\x{1f}]+$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last extension of a path with its dot, or empty."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in C.LANGUAGES.items() for x in kv])
    ext = suffix(path)
    return F.coalesce(F.try_element_at(known, ext), F.nullif(F.regexp_replace(ext, r"^\.+", ""), F.lit("")), F.lit("text"))


def is_test(path: Column, dirs: Sequence[str] = (), patterns: Sequence[str] = ()) -> Column:
    """By file name pattern, or by a parent directory whatever its case."""
    name = "|".join(f"(?:{fnmatch.translate(p)})" for p in (*C.TEST_PATTERNS, *patterns)).replace(r"\Z", "$").replace(r"\z", "$")
    parents = F.transform(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    return base_name(path).rlike(name) | F.arrays_overlap(parents, F.array(*[F.lit(d) for d in (*C.TEST_DIRS, *dirs)]))


def role(path: Column, test: Column) -> Column:
    """What a file is for: a test, else the first role of which its path holds a word."""
    low = F.lower(path)
    out = F.when(test, C.TEST_ROLE)
    for words, label in C.ROLES:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), label)
    return out.otherwise(C.OTHER_ROLE)


def precision(analyzer: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in C.CONFIDENCE.items() for x in (k, v[0])]), analyzer)


def confidence(analyzer: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in C.CONFIDENCE.items() for x in (k, v[1])]), analyzer)


def precision_label(analyzer: Column) -> Column:
    """How far an answer can be trusted, in one word pair."""
    p, c = precision(analyzer), confidence(analyzer)
    return F.when((analyzer == "python_ast") & (c == "high"), "python_ast/high").when((p == "heuristic") | (c == "low"), "heuristic/low").otherwise(F.concat_ws("/", p, c))


def without_receiver(name: Column) -> Column:
    """(*T).method and (T).method as T.method."""
    return F.regexp_replace(name, r"\(\*?([A-Za-z_]\w*)\)\.", "$1.")


def bare(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def body(text_lines: Column, line: Column, end_line: Column) -> Column:
    return F.array_join(F.slice(text_lines, line, F.greatest(end_line - line + 1, F.lit(0))), "\n")


_STRING = lambda q: rf"{q}[^{q}\\\n]*(?:\\.[^{q}\\\n]*)*{q}"
_SLASHES = (r"/\*[\s\S]*?\*/", r"//[^\n]*")
_HASH = (r"#[^\n]*",)
_LONG_STRINGS = (_STRING('"'), _STRING("'"))
#: By file type: strings, which are kept, then comments, which go. Other types have double-quoted strings and single characters.
LEXEMES = {
    (".js", ".jsx", ".ts", ".tsx"): ((*_LONG_STRINGS, r"`[^`\\]*(?:\\.[^`\\]*)*`"), _SLASHES),
    (".rb",): (_LONG_STRINGS, _HASH),
    (".php",): (_LONG_STRINGS, (*_SLASHES, *_HASH)),
}
OTHER_LEXEMES = ((_STRING('"'), r"'(?:\\[^'\n]+|[^'\\\n])'"), _SLASHES)


def stripping(strings: Sequence[str], comments: Sequence[str]) -> str:
    """The regex whose matches, replaced by their first group, leave a text without comments; one inside a string is none."""
    return f"({'|'.join(strings)})|{'|'.join(comments)}"


def without_comments(text: Column, ext: Column) -> Column:
    """A text without the comments of its file type (an extension with its dot); what stands in strings stays."""
    out = F.when(F.lit(False), text)
    for types, parts in LEXEMES.items():
        out = out.when(ext.isin(*types), F.regexp_replace(text, stripping(*parts), "$1"))
    return out.otherwise(F.regexp_replace(text, stripping(*OTHER_LEXEMES), "$1"))


def labels(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Sorted distinct labels of the rules whose regex occurs."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike("(?U)" + p), l) for p, l in rules], F.lit(None).cast("string")))))


def side_effects(code: Column, custom: Sequence[tuple[str, str]] = ()) -> Column:
    return labels(code, (*C.SIDE_EFFECTS, *custom))


def findings(code: Column) -> Column:
    first, second, label = C.RANDOMNESS
    both = F.when(code.rlike(first) & code.rlike(second), F.array(F.lit(label))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(labels(code, C.FINDINGS), both))


def routes(text: Column) -> Column:
    """map of "VERB /path" to handler; later matches win (needs spark.sql.mapKeyDedupPolicy=LAST_WIN for repeated keys)."""
    e = lambda p, g: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    table = F.transform(F.arrays_zip(e(C.ROUTE_DICT, 1).alias("k"), e(C.ROUTE_DICT, 2).alias("v")), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v")))
    calls = F.transform(F.arrays_zip(e(C.ROUTE_CALL, 1).alias("a"), e(C.ROUTE_CALL, 2).alias("b"), e(C.ROUTE_CALL, 3).alias("v")), lambda x: F.struct(F.concat_ws(" ", F.upper(x["a"]), x["b"]).alias("k"), x["v"].alias("v")))
    return F.concat(table, calls)


def per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0).otherwise(F.floor(1000 * part / whole)).cast("long")


def meter(per_mille_: Column, width: int = 24) -> Column:
    full = F.floor(per_mille_ * width / 1000).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))


def metacharacters(command: Column) -> Column:
    return command.rlike(r"&&|\|\||;|\||`|\$\(|>|<|\n")


def failure_line(line: Column) -> Column:
    return F.lower(line).rlike("failed|error|traceback|assert|panic|exception")


def summary_line(line: Column) -> Column:
    return F.lower(line).rlike(" passed|passed in| failed|failed in| tests|coverage| error")
