"""One parse of each file: symbols, imports, references and calls as nested rows.

Python goes through its own parser. Other languages go through a scanner that follows brackets (Ruby: indentation) from each
declaration; where it finds nothing, and for Python that does not parse, line patterns remain. `analyzer` tells which:
python_ast, syntax_scan or regex.
"""

from __future__ import annotations

import ast
import io
import os
import re
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import scalars as S

SYMBOL = "struct<pos:int,name:string,kind:string,line:int,end_line:int,methods:array<string>,signature:string>"
REF = "struct<line:int,ident:string,alias_of:string,attribute:boolean,shadowed:boolean>"
CALL = "struct<symbol:string,class_name:string,method_name:string,inferred:boolean>"
NEW = f"analyzer string, code string, symbols array<{SYMBOL}>, imports array<string>, raw_imports array<struct<pos:int,level:int,target:string>>, refs array<{REF}>, calls array<{CALL}>"


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)

    def one(arg: ast.arg, default: ast.expr | None) -> str:
        note = f": {ast.unparse(arg.annotation)}" if arg.annotation else ""
        return arg.arg + note + ("" if default is None else f" = {ast.unparse(default)}")

    parts = [one(x, d) for x, d in zip(plain, defaults, strict=True)]
    if a.posonlyargs:
        parts.insert(len(a.posonlyargs), "/")
    if a.vararg:
        parts.append("*" + one(a.vararg, None))
    elif a.kwonlyargs:
        parts.append("*")
    parts += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
    if a.kwarg:
        parts.append("**" + one(a.kwarg, None))
    return f"def {node.name}({', '.join(parts)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def bound(*targets: ast.expr | None) -> set[str]:
    """The names that assignment to these targets binds; not those of subscripts, attributes or starred parts."""
    return {t.id for t in targets if isinstance(t, ast.Name)}.union(*(bound(*t.elts) for t in targets if isinstance(t, (ast.Tuple, ast.List))))


class References(ast.NodeVisitor):
    """Every read of a name and every attribute, with whether a function around rebinds the name."""

    def __init__(self, aliases: dict[str, str]) -> None:
        self.aliases, self.hidden, self.rows = aliases, [], []

    def visit_FunctionDef(self, node) -> None:
        a = node.args
        names = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg) if x}
        for n in ast.walk(node):
            match n:
                case ast.Assign(targets=found) | ast.Delete(targets=found):
                    names |= bound(*found)
                case ast.For(target=one) | ast.AsyncFor(target=one) | ast.NamedExpr(target=one):
                    names |= bound(one)
                case ast.With(items=items) | ast.AsyncWith(items=items):
                    names |= bound(*(i.optional_vars for i in items))
                case ast.ExceptHandler(name=str(name)):
                    names.add(name)
        self.hidden.append(names)
        self.generic_visit(node)
        self.hidden.pop()

    visit_AsyncFunctionDef = visit_Lambda = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for part in (*node.bases, *node.keywords, *node.body):  # a class's decorators are no uses
            self.visit(part)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.rows.append((node.lineno, node.id, self.aliases.get(node.id), False, any(node.id in h for h in self.hidden)))

    def visit_Attribute(self, node: ast.Attribute) -> None:
        self.rows.append((node.lineno, node.attr, None, True, False))
        self.generic_visit(node)


def calls_of(node: ast.AST, symbol: str) -> set[tuple]:
    """Cls().m(), Cls.m() and v = Cls(); v.m() inside a function; a class is a name with a capital first."""
    made = {t.id: n.value.func.id for n in ast.walk(node) if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name) and n.value.func.id[:1].isupper() for t in n.targets if isinstance(t, ast.Name)}
    out = {}
    for n in ast.walk(node):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
            owner = n.func.value
            name, inferred = None, False
            if isinstance(owner, ast.Call) and isinstance(owner.func, ast.Name):
                name = owner.func.id
            elif isinstance(owner, ast.Name):
                name, inferred = (made[owner.id], True) if owner.id in made else (owner.id, False)
            if name and name[:1].isupper():
                out[name, n.func.attr] = out.get((name, n.func.attr), True) and inferred
    return {(symbol, c, m, i) for (c, m), i in out.items()}


def python_file(text: str) -> dict:
    tree = ast.parse(text)
    symbols, imports, raw, calls, aliases = [], [], [], set(), {}
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                imports.append(f"import {a.name}")
                raw.append((0, a.name))
        elif isinstance(node, ast.ImportFrom):
            imports.append(f"from {'.' * node.level}{node.module or ''} import {', '.join(a.name for a in node.names)}")
            raw.append((node.level, node.module or ""))
            raw += [(node.level, f"{node.module}.{a.name}" if node.module else a.name) for a in node.names if a.name != "*"]
        elif isinstance(node, ast.ClassDef):
            functions = [n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
            bases = f"({', '.join(map(ast.unparse, node.bases))})" if node.bases else ""
            symbols.append((node.name, "class", node.lineno, node.end_lineno, [f.name for f in functions], f"class {node.name}{bases}"))
            for f in functions:
                symbols.append((f"{node.name}.{f.name}", "method", f.lineno, f.end_lineno, [], signature(f)))
                calls |= calls_of(f, f"{node.name}.{f.name}")
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            symbols.append((node.name, "function", node.lineno, node.end_lineno, [], signature(node)))
            calls |= calls_of(node, node.name)
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            aliases |= {a.asname: a.name.rsplit(".", 1)[-1] for a in node.names if a.asname}
    refs = References(aliases)
    refs.visit(tree)
    return {"symbols": symbols, "imports": imports, "raw": raw, "refs": refs.rows, "calls": sorted(calls)}


def python_code(text: str) -> str:
    """The text without docstrings and comments; as much as can be told where it does not parse."""
    lines = text.splitlines()
    try:
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) and node.body and isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str):
                for i in range(node.body[0].lineno - 1, node.body[0].end_lineno):
                    lines[i] = ""
    except (SyntaxError, ValueError, RecursionError, IndexError):
        pass
    try:
        for tok in tokenize.generate_tokens(io.StringIO("\n".join(lines)).readline):
            if tok.type == tokenize.COMMENT:
                lines[tok.start[0] - 1] = lines[tok.start[0] - 1][: tok.start[1]]
    except (tokenize.TokenError, SyntaxError, IndexError):
        pass
    return "\n".join(lines)


NAME = r"([A-Za-z_$][\w$]*)"
MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|readonly|partial|export|default|pub(?:\([^)]*\))?|unsafe|const)\s+)*"
#: (kind, regex with the name in group 1, a receiver or owner in group 2 where there is one) of each language.
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    ".go": [("method", rf"^func\s+\(\s*(?:\w+\s+)?(?P<owner>\*?\w+)[^)]*\)\s+{NAME}"), ("function", rf"^func\s+{NAME}"), ("type", rf"^type\s+{NAME}")],
    ".rs": [("function", rf"^\s*{MODIFIERS}fn\s+{NAME}"), ("class", rf"^\s*{MODIFIERS}struct\s+{NAME}"), ("enum", rf"^\s*{MODIFIERS}enum\s+{NAME}"), ("trait", rf"^\s*{MODIFIERS}trait\s+{NAME}")],
    ".rb": [("class", rf"^\s*class\s+{NAME}"), ("module", rf"^\s*module\s+{NAME}"), ("function", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")],
}
DECLARATIONS[".js"] = [("class", rf"^\s*{MODIFIERS}class\s+{NAME}"), ("interface", rf"^\s*{MODIFIERS}interface\s+{NAME}"), ("enum", rf"^\s*{MODIFIERS}enum\s+{NAME}"), ("type", rf"^\s*{MODIFIERS}type\s+{NAME}\s*="), ("function", rf"^\s*{MODIFIERS}function\s*\*?\s*{NAME}"), ("function", rf"^\s*{MODIFIERS}(?:const|let|var)\s+{NAME}\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", rf"^\s+{MODIFIERS}(?:get\s+|set\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){NAME}\s*\([^;]*\)\s*(?::[^{{;]+)?\{{")]
DECLARATIONS[".java"] = [("class", rf"^\s*{MODIFIERS}(?:class|record|struct)\s+{NAME}"), ("interface", rf"^\s*{MODIFIERS}interface\s+{NAME}"), ("enum", rf"^\s*{MODIFIERS}enum\s+{NAME}"), ("method", rf"^\s+{MODIFIERS}(?!return\b|new\b|else\b|throw\b)(?:[\w<>\[\],.?]+\s+)?(?!if\b|for\b|while\b|switch\b|catch\b|using\b|lock\b){NAME}\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{{?\s*$")]
DECLARATIONS[".php"] = [("class", rf"^\s*{MODIFIERS}class\s+{NAME}"), ("interface", rf"^\s*interface\s+{NAME}"), ("trait", rf"^\s*trait\s+{NAME}"), ("function", rf"^\s*{MODIFIERS}function\s+&?{NAME}")]
for _x, _y in ((".jsx", ".js"), (".ts", ".js"), (".tsx", ".js"), (".cs", ".java")):
    DECLARATIONS[_x] = DECLARATIONS[_y]
_COMPILED = {k: [(kind, re.compile(p)) for kind, p in v] for k, v in DECLARATIONS.items()}
OWNERS = ("class", "interface", "enum", "module", "trait")


def end_of(lines: list[str], at: int, ruby: bool) -> int:
    """The last line (from 1) of the declaration on line `at` (from 0): its bracket's, or the `end` at its indentation."""
    if ruby:
        indent = len(lines[at]) - len(lines[at].lstrip())
        return next((i + 1 for i in range(at + 1, len(lines)) if re.match(rf"\s{{{indent}}}end\b", lines[i])), at + 1)
    depth, seen = 0, False
    for i in range(at, len(lines)):
        for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[i]):
            depth += (c == "{") - (c == "}")
            seen |= c == "{"
        if seen and depth <= 0 or not seen and i > at and not lines[i].strip() or not seen and lines[i].rstrip().endswith(";"):
            return i + 1
    return len(lines)


def scanned_file(text: str, ext: str) -> list[tuple]:
    lines, found = text.splitlines(), []
    for i, line in enumerate(lines):
        for kind, regex in _COMPILED.get(ext, ()):
            if m := regex.match(line):
                owner = m.groupdict().get("owner")
                name = m[m.lastindex]
                found.append([f"({owner}).{name}" if owner else name, kind, i + 1, end_of(lines, i, ext == ".rb"), [], re.sub(r"\s+", " ", line).strip().rstrip("{").strip()])
                break
    for s in found:  # what stands inside a class is its method
        inside = [o for o in found if o[1] in OWNERS and o[2] < s[2] and s[3] <= o[3]]
        if inside and s[1] in ("function", "method"):
            owner = max(inside, key=lambda o: o[2])
            owner[4].append(s[0])
            s[0], s[1] = f"{owner[0]}.{s[0]}", "method"
        elif m := re.match(r"\(\*?(\w+)\)\.(\w+)", s[0]):
            for o in found:
                if o[0] == m[1]:
                    o[4].append(m[2])
    return [tuple(s) for s in found]


def generic_symbols(text: str) -> list[tuple]:
    out = []
    for i, line in enumerate(text.splitlines(), 1):
        for kind, p in C.LINE_SYMBOLS:
            if m := re.search(p, line):
                out.append((m[1], kind, i, 0, [], ""))
    return out


def without_strings(text: str, ext: str) -> str:
    """The text with strings and comments blanked out, line by line the same."""
    strings, comments = next((parts for types, parts in S.LEXEMES.items() if ext in types), S.OTHER_LEXEMES)
    return re.sub("|".join((*strings, *comments)), lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def line_calls(text: str, symbols: list[tuple]) -> set[tuple]:
    """Calls of classes' methods in the lines of each function or method, told by capitals. A name made from a class anywhere
    above the end of the function stands for that class."""
    lines, out = text.splitlines(), set()
    for name, kind, line, end, *_ in symbols:
        if kind not in ("function", "method"):
            continue
        last = end or next((i for i in range(line, len(lines)) if re.match(r"\s*(?:async\s+def|def|class|function)\s", lines[i])), len(lines))
        made = {m[1]: m[2] for own in lines[:last] for m in re.finditer(C.MADE_OF_CLASS, own)}
        found: dict[tuple, bool] = {}
        for own in lines[line:last] if last > line else lines[line - 1 : line]:
            said = [(m[1], m[2], False) for p in (C.CALL_OF_NEW, C.CALL_OF_CLASS) for m in re.finditer(p, own)]
            said += [(made[m[1]], m[2], True) for m in re.finditer(C.CALL_OF_NAME, own) if m[1] in made]
            for owner, method, inferred in said:
                found.setdefault((owner, method), inferred)
        out |= {(name, c, m, i) for (c, m), i in found.items()}
    return out


def line_imports(text: str, ext: str, scanned: bool) -> tuple[list[str], list[tuple]]:
    """Import targets by line. Where a scanner gave the symbols, lines that look like comments are skipped and the import is its target's
    name; else it is the line."""
    imports, raw = [], []
    for line in text.splitlines():
        if scanned and line.lstrip().startswith(("//", "#", "/*", "*")):
            continue
        for p in (C.REQUIRE, C.IMPORT_FROM, *([C.RUST_USE] if ext == ".rs" else []), *([C.GO_IMPORT] if ext == ".go" else [])):
            for m in re.finditer(p, line):
                target = m[1].replace("::", ".") if p is C.RUST_USE and not scanned else m[1]
                if scanned or p is not C.GO_IMPORT or "/" in target or "." not in target:
                    imports.append(target if scanned else line.strip())
                    raw.append((0, target))
    return imports, raw


def analyze(path: str, text: str) -> tuple:
    ext = os.path.splitext(path)[1]
    info = {"symbols": [], "imports": [], "raw": [], "refs": [], "calls": []}
    analyzer = "regex"
    if ext == ".py":
        try:
            info, analyzer = python_file(text), "python_ast"
        except (SyntaxError, ValueError, RecursionError):
            pass
    if analyzer == "regex":
        info["symbols"] = scanned_file(text, ext)
        analyzer = "syntax_scan" if info["symbols"] and ext in _COMPILED else "regex"
        info["symbols"] = info["symbols"] or generic_symbols(text)
        info["imports"], info["raw"] = line_imports(text, ext, analyzer == "syntax_scan")
        info["calls"] = sorted(line_calls(text, info["symbols"]))
        declared = {(s[2], s[0].rsplit(".", 1)[-1]) for s in info["symbols"]}
        seen = without_strings(text, ext) if analyzer == "syntax_scan" else text
        info["refs"] = [(i, w, None, False, False) for i, line in enumerate(seen.splitlines(), 1) for w in re.findall(r"[A-Za-z_$][\w$]*", line) if (i, w) not in declared]
    code = python_code(text) if ext == ".py" else None
    return path, analyzer, code, [(i, *s) for i, s in enumerate(info["symbols"])], info["imports"], [(i, *r) for i, r in enumerate(info["raw"])], info["refs"], info["calls"]


def analyzed(files: DataFrame) -> DataFrame:
    """files (path, text, …) with what one parse of each gives, in one pass; comments of other languages are stripped in the JVM."""
    new = T.StructType.fromDDL(NEW)
    kept = T.StructType([f for f in files.schema.fields if f.name not in new.fieldNames()])
    fields = {f.name: f.dataType.elementType.fieldNames() for f in new.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = pd.DataFrame([analyze(p, t or "")[1:] for p, t in zip(part["path"], part["text"], strict=True)], columns=new.fieldNames(), index=part.index)
            for c, names in fields.items():
                out[c] = [[dict(zip(names, x, strict=True)) for x in xs] for xs in out[c]]
            yield pd.concat([part, out], axis=1)

    found = files.select(*kept.fieldNames()).mapInPandas(run, T.StructType([*kept.fields, *new.fields]))
    return found.withColumn("code", F.coalesce("code", S.without_comments(F.col("text"), S.suffix(F.col("path")))))
