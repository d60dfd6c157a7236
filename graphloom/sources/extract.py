"""From source text to graph rows: a registry of extractors run over files in Arrow batches."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.code import strip_comments

ROW = "row_type string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, source string, target string, line int"
_FIELDS = [x.split() for x in ROW.split(", ")]
_ARROW = {"string": pa.string(), "int": pa.int32()}

Extractor = Callable[[str, str], Iterator[dict]]


def node_id(kind: str, path: str, name: str, line: int) -> str:
    return kind + ":" + hashlib.sha256(f"{path}:{kind}:{name}:{line}".encode()).hexdigest()[:32]


def _node(path: str, language: str, kind: str, name: str, qualified: str, start: int, end: int, doc: str | None = None, signature: str | None = None) -> dict:
    return {
        "row_type": "node", "id": node_id(kind, path, name, start), "kind": kind, "name": name, "qualified_name": qualified, "file_path": path, "language": language,
        "start_line": start, "end_line": end, "docstring": doc, "signature": signature,
    }


def _edge(kind: str, source: str, target: str, line: int | None = None) -> dict:
    return {"row_type": "edge", "kind": kind, "source": source, "target": target, "line": line}


def _ref(kind: str, source: str, name: str, path: str, language: str, line: int) -> dict:
    return {"row_type": "ref", "kind": kind, "source": source, "name": name, "file_path": path, "language": language, "line": line}


def _dotted(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = _dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return None


def python_rows(path: str, text: str) -> Iterator[dict]:
    """Modules, classes, functions, imports, calls and bases of a Python file, by its own parser."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    lines = text.count("\n") + 1
    file = _node(path, "python", "file", path.rsplit("/", 1)[-1], path, 1, lines, ast.get_docstring(tree))
    yield file
    stack: list[tuple[ast.AST, str, str]] = [(tree, file["id"], path)]
    while stack:
        parent, parent_id, prefix = stack.pop()
        for child in ast.iter_child_nodes(parent):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if isinstance(parent, ast.ClassDef) else "function"
                head = text.split("\n")[child.lineno - 1].strip()
                row = _node(path, "python", kind, child.name, f"{prefix}::{child.name}", child.lineno, child.end_lineno or child.lineno, ast.get_docstring(child), head.rstrip(":"))
                yield row
                yield _edge("contains", parent_id, row["id"])
                for d in child.decorator_list:
                    if name := _dotted(d.func if isinstance(d, ast.Call) else d):
                        yield _ref("decorates", row["id"], name, path, "python", d.lineno)
                if isinstance(child, ast.ClassDef):
                    for b in child.bases:
                        if name := _dotted(b):
                            yield _ref("extends", row["id"], name, path, "python", b.lineno)
                stack.append((child, row["id"], row["qualified_name"]))
                continue
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                base = getattr(child, "module", None)
                for a in child.names:
                    yield _ref("imports", parent_id, f"{base}.{a.name}" if base else a.name, path, "python", child.lineno)
            elif isinstance(child, ast.Call) and (name := _dotted(child.func)):
                yield _ref("calls", parent_id, name, path, "python", child.lineno)
            stack.append((child, parent_id, prefix))


# Declarations of brace languages: kind, pattern with the group name.
_BRACES = (
    ("class", r"\b(?:class|struct)\s+(?P<name>[A-Za-z_]\w*)[^;{]*\{"),
    ("interface", r"\b(?:interface|trait|protocol)\s+(?P<name>[A-Za-z_]\w*)[^;{]*\{"),
    ("enum", r"\benum\s+(?:class\s+)?(?P<name>[A-Za-z_]\w*)[^;{]*\{"),
    ("function", r"\b(?:function|func|fn|fun)\s+(?:\([^)]*\)\s*)?(?P<name>[A-Za-z_]\w*)\s*(?:<[^>]*>)?\s*\([^)]*\)[^;{]*\{"),
    ("function", r"\b(?:const|let|var)\s+(?P<name>[A-Za-z_]\w*)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>\s*\{"),
    ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|internal|static|final|async|override|virtual|abstract|export)\s+)*(?:[\w<>\[\],.*&]+\s+)?(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|else\b|do\b)[A-Za-z_]\w*)\s*\([^)]*\)\s*(?:->?\s*[\w<>\[\], ]+|:\s*[\w<>\[\], |]+)?\s*\{"),
)
_CALL = re.compile(r"\b(?P<name>[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function func fn fun else do new sizeof typeof await throw class super this".split())


def brace_rows(path: str, text: str, language: str = "typescript") -> Iterator[dict]:
    """Declarations, containment and calls of a language with braces; comments and strings do not count."""
    clean = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: '"' + " " * (len(m[0]) - 2) + '"', strip_comments(text, language))
    file = _node(path, language, "file", path.rsplit("/", 1)[-1], path, 1, text.count("\n") + 1)
    yield file
    spans, seen = [], set()
    for kind, pattern in _BRACES:
        for m in re.finditer(pattern, clean):
            start = m.start("name")
            if start in seen:
                continue
            seen.add(start)
            depth, i = 1, m.end()
            while i < len(clean) and depth:
                depth += {"{": 1, "}": -1}.get(clean[i], 0)
                i += 1
            spans.append((m.start(), i, kind, m["name"], text[m.start() : m.end() - 1].strip()[:400]))
    spans.sort(key=lambda s: (s[0], -s[1]))
    open_: list[tuple[int, dict]] = []
    placed = []
    for a, b, kind, name, signature in spans:
        while open_ and open_[-1][0] <= a:
            open_.pop()
        owner = open_[-1][1] if open_ else file
        if kind == "method" and owner["kind"] not in ("class", "interface", "enum"):
            kind = "function"
        row = _node(path, language, kind, name, f"{owner['qualified_name']}::{name}", clean.count("\n", 0, a) + 1, clean.count("\n", 0, b) + 1, None, signature)
        yield row
        yield _edge("contains", owner["id"], row["id"])
        open_.append((b, row))
        placed.append((a, b, row))
    for m in _CALL.finditer(clean):
        if m["name"] in _KEYWORDS or m.start() in seen:
            continue
        around = [r for a, b, r in placed if a < m.start() < b]
        line = clean.count("\n", 0, m.start()) + 1
        yield _ref("calls", (around[-1] if around else file)["id"], m["name"], path, language, line)


EXTRACTORS: dict[str, Extractor] = {"python": python_rows}
for _language in ("typescript", "tsx", "javascript", "jsx", "arkts", "java", "kotlin", "go", "rust", "csharp", "c", "cpp", "dart"):
    EXTRACTORS[_language] = lambda path, text, language=_language: brace_rows(path, text, language)


def register(language: str, extractor: Extractor) -> None:
    """Adds or replaces the extractor of a language."""
    EXTRACTORS[language] = extractor


def extract(files: DataFrame) -> DataFrame:
    """Node, edge, reference and error rows of files (path, text, language).

    A file its extractor cannot read gives one error row; null texts give nothing.
    """
    table = dict(EXTRACTORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text, language in zip(*(c.to_pylist() for c in batch.columns)):
                f = table.get(language or "")
                if f is None or text is None:
                    continue
                try:
                    rows.extend(list(f(path, text)))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"row_type": "error", "file_path": path, "language": language, "name": f"{type(e).__name__}: {e}"[:400]})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], _ARROW[t]) for n, t in _FIELDS], names=[n for n, _ in _FIELDS])

    return files.select("path", "text", "language").where(F.col("text").isNotNull()).mapInArrow(run, ROW)
