"""Source files that do not parse (problem 4).

A text is tried against all supported grammars in the order its tokens rank
them.  A parse under a foreign grammar points at a wrong extension; when no
grammar fits, the text itself is broken.  Where only an indexer's records of a
file are kept (its diagnostics, the language it took the file for, the path),
the same procedure runs over these records: each diagnostic is parsed against
the grammars of diagnostics, and the language against the extensions' families.
"""

from __future__ import annotations

import ast
import json
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.lookalike import skeleton

# Other spellings of language names.
ALIASES = {
    "golang": "go", "py": "python", "python3": "python", "js": "javascript", "node": "javascript", "ts": "typescript", "c++": "cpp", "cxx": "cpp",
    "c#": "csharp", "cs": "csharp", "objective-c": "objc", "objectivec": "objc", "objective-c++": "objc", "obj-c": "objc", "kt": "kotlin", "rs": "rust",
    "rb": "ruby", "sh": "shell", "bash": "shell", "zsh": "shell", "yml": "yaml", "md": "markdown", "ets": "arkts", "javascriptreact": "jsx", "typescriptreact": "tsx",
}
# Dialects of one family share its name.
FAMILY = {
    "javascript": "web", "jsx": "web", "typescript": "web", "tsx": "web", "arkts": "web", "vue": "web", "svelte": "web", "astro": "web",
    "c": "c", "cpp": "c", "objc": "c", "cuda": "c", "arduino": "c", "cython": "python", "scss": "css", "sass": "css", "less": "css", "jsonc": "json", "json5": "json", "xhtml": "html",
}
# The families whose files carry an extension.
EXTENSIONS = {
    "web": "js mjs cjs jsx ts mts cts tsx ets vue svelte astro es es6", "python": "py pyi pyw pyx", "c": "c h cc cpp cxx hpp hxx hh inl ipp tpp m mm cu ino c++ h++",
    "go": "go", "java": "java", "kotlin": "kt kts", "rust": "rs", "csharp": "cs csx", "dart": "dart", "swift": "swift", "ruby": "rb rake", "php": "php phtml",
    "scala": "scala sc", "lua": "lua", "shell": "sh bash zsh", "sql": "sql", "css": "css scss sass less", "html": "html htm xhtml vue svelte", "json": "json jsonc json5",
    "yaml": "yaml yml", "markdown": "md markdown", "perl": "pl pm", "haskell": "hs", "r": "r", "julia": "jl", "elixir": "ex exs", "matlab": "m", "prolog": "pl", "xml": "xml svg ts",
}
_BY_EXTENSION: dict[str, set[str]] = {}
for _family, _names in EXTENSIONS.items():
    for _e in _names.split():
        _BY_EXTENSION.setdefault(_e, set()).add(_family)


def language_of(label: str | None) -> str:
    """The plain name of a language; '' for null, blank and unknown."""
    name = (label or "").strip().lower()
    name = ALIASES.get(name, name)
    return "" if name in ("unknown", "none", "null", "other", "text", "plaintext", "plain text", "txt") else name


def family_of(label: str | None) -> str:
    name = language_of(label)
    return FAMILY.get(name, name)


def extension_of(path: str | None) -> str:
    last = regex.split(r"[\\/]", path or "")[-1]
    return last.rpartition(".")[2].lower() if "." in last[1:] else ""


# ---- grammars of source texts -------------------------------------------------------------------------------------

# Per family: what starts a comment to the end of the line, block comments, string delimiters (a trailing * may span lines).
_LEXICAL = {
    "web": ("//", (("/*", "*/"),), ('"', "'", "`*")),
    "c": ("//", (("/*", "*/"),), ('"', "'")),
    "go": ("//", (("/*", "*/"),), ('"', "'", "`*")),
    "java": ("//", (("/*", "*/"),), ('"""*', '"', "'")),
    "kotlin": ("//", (("/*", "*/"),), ('"""*', '"', "'")),
    "rust": ("//", (("/*", "*/"),), ('"*',)),
    "csharp": ("//", (("/*", "*/"),), ('"""*', '"', "'")),
    "dart": ("//", (("/*", "*/"),), ("'''*", '"""*', '"', "'")),
}
# Per family: patterns of which each match is evidence, and patterns no text of the family has outside strings and comments.
_EVIDENCE = {
    "web": (r"\b(?:function|const|let|var|export|import .* from|=>|async|await|typeof|interface|console)\b|=>|===", r"^\s*(?:def \w+\(.*\).*:|elif\b|package \w+$|func \w+\(|fn \w+|#include|use \w+::|public (?:static )?(?:final )?class\b|using \w[\w.]*;)"),
    "python": (r"^\s*(?:def|class|elif|from \w+ import|import \w+$|@\w+|with .*:|except\b)|\bself\b|\bNone\b|:\s*$", None),
    "c": (r"#include|#define|\b(?:struct|void|int|char|static|const|unsigned|sizeof|typedef|namespace|template|std::)\b|->|::", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|fn \w+|package \w+;?$|import \w+|function \w+\(|let \w+ ?=)"),
    "go": (r"^package \w+$|\bfunc\b|:=|\b(?:chan|defer|go|range|interface|nil)\b", r"^\s*(?:def \w+\(.*\).*:|elif\b|class \w+|fn \w+|#include|use \w+::|public |let \w+|function \w+\()"),
    "java": (r"\b(?:public|private|protected|class|extends|implements|final|static|void|new|throws|import java)\b|^package [\w.]+;", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|fn \w+|#include|use \w+::|function \w+\(|let \w+ ?=|package \w+$)"),
    "kotlin": (r"\b(?:fun|val|var|object|companion|when|override|data class|suspend)\b|\?:|^package [\w.]+$", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|fn \w+|#include|use \w+::|function \w+\(|public static)"),
    "rust": (r"\b(?:fn|let mut|impl|pub|match|trait|mod|crate|use \w+::|Self|&mut|unwrap)\b|->|::", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|class \w+|#include|package \w+|function \w+\(|public )"),
    "csharp": (r"\b(?:using|namespace|public|private|internal|class|string|var|async|get;|set;|override|sealed)\b", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|fn \w+|#include|use \w+::|function \w+\(|let \w+ ?=|package \w+)"),
    "dart": (r"\b(?:import 'package|Widget|final|late|void|extends|required|Future|const)\b|=>", r"^\s*(?:def \w+\(.*\).*:|elif\b|func \w+\(|fn \w+|#include|use \w+::|package \w+)"),
}
_CONFLICT = regex.compile(r"^(?:<{7} \S.*|={7}|>{7} \S.*)$", regex.M)
_PAIRS = {")": "(", "]": "[", "}": "{"}


@lru_cache(maxsize=32)
def _scanner(family: str):
    line, blocks, strings = _LEXICAL[family]
    parts = [regex.escape(line) + r"[^\n]*+"]
    parts += [regex.escape(a) + r"[\s\S]*?" + regex.escape(b) for a, b in blocks] + [f"(?P<open{i}>{regex.escape(a)})" for i, (a, _) in enumerate(blocks)]
    for i, s in enumerate(strings):
        q, many = regex.escape(s.rstrip("*")), s.endswith("*")
        parts += [rf"{q}(?:\\[\s\S]|(?!{q}){'[\\s\\S]' if many else '[^\\n]'})*+{q}", f"(?P<quote{i}>{q})"]
    return regex.compile("|".join(parts) + r"|(?P<bracket>[()\[\]{}])")


def parses(text: str, family: str) -> bool:
    """Whether a text fits the grammar of a family: closed strings and comments, balanced brackets, no foreign statements.

    Python texts go through Python's own parser, JSON through its own.
    """
    if _CONFLICT.search(text):
        return False
    if family == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True
    if family == "json":
        try:
            json.loads(text)
        except (ValueError, RecursionError):
            return False
        return True
    if family not in _LEXICAL:
        return False
    stack, code, last = [], [], 0
    for m in _scanner(family).finditer(text):
        code.append(text[last : m.start()])
        last = m.end()
        mark = m["bracket"]
        if mark is None:
            if m.lastgroup:  # an opening mark that is never closed
                return False
            code.append(" ")
        else:
            code.append(mark)
            if mark in "([{":
                stack.append(mark)
            elif not stack or stack.pop() != _PAIRS[mark]:
                return False
    if stack:
        return False
    code.append(text[last:])
    foreign = _EVIDENCE[family][1]
    return foreign is None or regex.search(foreign, "".join(code), regex.M) is None


def rank_families(text: str) -> list[str]:
    """All families, the likeliest first, by evidence per token; ties in name order."""
    return sorted(_EVIDENCE, key=lambda f: (-len(regex.findall(_EVIDENCE[f][0], text, regex.M)), f))


# A line that declares or imports something in one of the families' languages.
_DECLARATION = regex.compile(
    r"""(?xm) ^[ \t]*+ (?: (?:export|public|private|protected|internal|static|async|abstract|final|override|pub|default|suspend|data|open|sealed)[ ]+ )*+
    (?: def[ ]\w+[ ]*\( | class[ ]\w+(?:[ ]*[:{(<]|[ ](?:extends|implements)[ ]) | func[ ](?:\(\w+[ ][^)]*\)[ ])?\w+\( | fn[ ]\w+[(<] | function\*?[ ]?\w*\( | fun[ ][\w.<>]+\( | interface[ ]\w+[ ]\{
      | (?:struct|enum)[ ]\w+[ ]*\{ | impl\b[^\n]*\{ | (?:const|let|var)[ ]\w+[ ]*(?::[^=\n]+)?= | [\w<>\[\],*&:]+[ ]\w+\([^()\n]*\)[ ]*(?:const[ ]*)?\{ )
    | ^(?: import[ ][\w.{}*,\ "'@/]+;?$ | from[ ][\w.]+[ ]import\b | \#include[ ][<"] | package[ ][\w.]+;?$ | using[ ][\w.]+; | use[ ][\w:]+; )"""
)


def is_source(text: str | None) -> bool:
    """Whether a text holds source code: a line of it declares something, its characters taken by their looks."""
    return bool(text) and _DECLARATION.search(skeleton(text)) is not None


def source_texts(df: DataFrame, text: str) -> DataFrame:
    """The rows of ``df`` whose text is source code; null and empty texts are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([is_source(t) for t in batch.column(text).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def diagnose(text: str | None, family: str) -> tuple[bool, str | None]:
    """(fits its own grammar, the foreign family it fits instead or None).

    Null and blank texts fit any grammar.
    """
    if not (text or "").strip() or parses(text, family):
        return True, None
    return False, next((f for f in rank_families(text) if f != family and regex.search(_EVIDENCE[f][0], text, regex.M) and parses(text, f)), None)


# ---- grammars of diagnostics ---------------------------------------------------------------------------------------

# The terminals of diagnostics and the words that stand for them.
TERMINALS = {
    "Y": "syntaxerror syntaxfehler",
    "S": "syntax parse parser parsing parsed unparsable grammar 语法 解析",
    "R": "error errors fehler mismatch 错误 无法",
    "E": "token tokens identifier statement character characters sequence literal string comment block bracket brace parenthesis klammer quote indentation marker markers conflict "
    "declaration expression keyword operator semicolon comma line lines column node tree input rest 行 标记 合并",
    "B": "unexpected invalid illegal unbalanced unterminated unclosed unmatched stray leftover malformed incomplete premature missing 意外 残留 缺少",
    "T": "end eof dateiende stops ends ran open partner swallows spans closing closed truncated 结束",
    "W": "expected found",
    "Z": "no not nothing never without cannot",
    "V": "valid allowed recognised recognized",
    "C": "complete",
    "M": "worker plugin instance extractor daemon process server scan table heap memory colouring highlighter indexer cache",
    "G": "file path project root permission limit kind 文件",
    "F": "died crashed vanished refused answer written read opened reached failed skipped covered supported installed free larger leaves stopped killed cancelled timeout",
    "K": "import symbol symbols member type check module package reference variable name",
    "D": "declared twice defined deprecated unused undefined unresolved duplicate ambiguous",
    "X": "recovered tolerated",
    "f": "a an the this that its of at on in near after before inside during for from to by where was is were has have had be been could since than but and here still out vor 第 处 在",
}
_TERMINAL = {word: letter for letter, words in TERMINALS.items() for word in words.split()}
_LEXEME = regex.compile(
    r"""(?x) (?P<Q>'[^'\n]*'|"[^"\n]*"|`[^`\n]*`|“[^”]*”|«[^»]*»|「[^」]*」|‘[^’]*’) | (?P<n>\p{N}+(?:[.:-]\p{N}+)*)
    | (?P<w>"""
    + "|".join(sorted((w for w in _TERMINAL if not w.isascii()), key=len, reverse=True))
    + r"""|[\p{L}--\p{Han}][[\p{L}\p{M}\p{N}_]--\p{Han}]*) | (?P<p>[,:;，：；.。]) | (?P<x>\S)""",
    regex.V1,
)


def terminals(message: str) -> str:
    """A diagnostic as a string of terminals: one letter a word, Q a quotation, n a number, a comma a mark between clauses, x any other word or sign."""
    out = []
    for m in _LEXEME.finditer(message):
        out.append(_TERMINAL.get(m["w"].lower(), "x") if m["w"] else "," if m["p"] else "x" if m["x"] else m.lastgroup)
    return "".join(out)


# Productions over terminals.  Operands (fxQn) may stand between the parts of a complaint; a word of another grammar ends the derivation.
_RULES = r"""(?(DEFINE)
    (?P<o> [fxQn]*+ )
    (?P<thing> [EGK] (?&o) (?: [EGK] (?&o) )*+ )
    (?P<flaw> B (?&o) (?&thing)?+ (?: T (?&o) )?+ | (?&thing) (?: R (?&o) )?+ (?: [TB]++ | Z (?&o) [TV] ) | T (?&o) (?&thing) | R (?&o) (?&thing) T
        | W (?&o) (?: (?&thing) W )?+ | Z (?&o) V | S (?&o) R | R (?&o) S | Y )
    (?P<complaint> [fxQn,]*+ (?&flaw) (?: (?&flaw) | [,EGfxQn] )*+ )
    (?P<agent> [MGSEKxQfn]* )
    (?P<failure> (?: Z (?&o) )? (?&agent) (?: Z (?&o) )? F [^XD]*+ )
    (?P<nonsense> (?: [,f]* (?: K [^FX]*? (?: D | Z (?&o) [KW] ) | S (?&o) D ) [^X]*+ ) )
    (?P<recovery> [fxQn,]*+ X (?&o) (?&flaw) (?&o) ,? (?: E (?&o) C )?+ [fxQn,]*+ )
)"""
#: What each kind of diagnostic must derive to, from end to end, and the terminals that speak for it.
GRAMMARS = {
    "tool": (regex.compile(_RULES + "(?&failure)", regex.X), "MFG"),
    "meaning": (regex.compile(_RULES + "(?&nonsense)", regex.X), "KD"),
    "recovered": (regex.compile(_RULES + "(?&recovery)", regex.X), "XC"),
    "grammar": (regex.compile(_RULES + "(?&complaint)", regex.X), "YSREBTWV"),
}


@lru_cache(maxsize=100_000)
def kind_of(message: str) -> str:
    """tool, meaning, recovered, grammar, or '' for a message that no grammar derives.

    The grammars are ranked by the message's terminals and tried in that order;
    the first that derives the whole message names its kind.
    """
    letters = terminals(message)
    ranked = sorted(GRAMMARS, key=lambda k: -sum(letters.count(t) for t in GRAMMARS[k][1]))
    return next((k for k in ranked if GRAMMARS[k][0].fullmatch(letters)), "")


_OBJECT = regex.compile(r"\{(?:[^{}\"]++|\"(?:[^\"\\]|\\.)*+(?:\"|\Z)|(?R))*+(?:\}|\Z)")
_MESSAGE = regex.compile(r"\"(?:message|msg|text|description)\"\s*:\s*\"((?:[^\"\\]|\\.)*+)", regex.I)
_SEVERITY = regex.compile(r"\"(?:severity|level)\"\s*:\s*\"((?:[^\"\\]|\\.)*+)", regex.I)
_PREFIX = regex.compile(r"^\s*\[?(fatal|critical|error|err|warning|warn|info|hint|note)\]?\s*[:：]\s*", regex.I)
#: Severities under which an entry counts; '' stands for none stated.
_COUNTS = ("", "error", "err", "fatal", "critical", "severe", "1")


def _unescape(text: str) -> str:
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text


def entries(errors: str | None, depth: int = 0) -> Iterator[tuple[str, str]]:
    """(severity in lower case or '', message) of each entry, well-formed or not.

    Arrays, single objects, arrays of strings, text wrapped as JSON text again,
    arrays cut off anywhere, and bare messages are all read; null and blank give none.
    """
    if not (errors or "").strip() or depth > 4:
        return
    try:
        value = json.loads(errors)
    except (ValueError, RecursionError):
        found = _OBJECT.findall(errors) if "{" in errors else []
        if found:
            for part in found:
                message, severity = _MESSAGE.search(part), _SEVERITY.search(part)
                if message:
                    yield (severity[1].strip().lower() if severity else "", _unescape(message[1]))
            return
        value = errors if errors.lstrip()[:1] not in "[{" else None
        if value is None:
            return
        stated = _PREFIX.match(value)
        yield (stated[1].lower() if stated else "", value[stated.end() :] if stated else value)
        return
    for x in value if isinstance(value, list) else [value]:
        if isinstance(x, dict):
            low = {str(k).lower(): v for k, v in x.items()}
            message = next((low[k] for k in ("message", "msg", "text", "description") if low.get(k) is not None), None)
            severity = low.get("severity", low.get("level"))
            if message is not None:
                yield (str(severity).strip().lower() if severity is not None else "", str(message))
        elif isinstance(x, str):
            yield from entries(x, depth + 1)


def breaks_grammar(errors: str | None) -> bool:
    return any((s in _COUNTS or s[:1] in ("e", "f") and not s.startswith("fine")) and kind_of(m) == "grammar" for s, m in entries(errors))


def contradicts(language: str | None, path: str | None) -> bool:
    """Whether the extension belongs to families other than the language's; unknown ones never contradict."""
    families, family = _BY_EXTENSION.get(extension_of(path)), family_of(language)
    return bool(families) and family in EXTENSIONS and family not in families


def unparsed_files(df: DataFrame, path: str = "path", language: str = "language", errors: str = "errors") -> DataFrame:
    """(path, repository, language, broken, foreign) for every row with a path.

    broken: an entry of severity error or of none stated says that the text
    breaks its grammar; foreign: the language contradicts the extension.  Null
    errors have no entries, null or unknown languages contradict nothing.  One
    row comes back per row given.
    """
    rows = df.select(F.col(path).alias("path"), F.col(language).alias("language"), F.col(errors).alias("errors")).where("path is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, languages, errors = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([regex.split(r"[\\/]", p, maxsplit=1)[0] for p in paths], pa.string()),
                    pa.array([language_of(x) or "unknown" for x in languages], pa.string()),
                    pa.array([breaks_grammar(e) for e in errors], pa.bool_()),
                    pa.array([contradicts(x, p) for x, p in zip(languages, paths)], pa.bool_()),
                ],
                names=["path", "repository", "language", "broken", "foreign"],
            )

    return rows.mapInArrow(run, "path string, repository string, language string, broken boolean, foreign boolean")


def parse_texts(df: DataFrame, id_column: str, text: str, language: str) -> DataFrame:
    """(id, family, ok, foreign_family) for source texts in families with a grammar; other rows are left out.

    A null or unknown language is taken to be the family that the text's tokens rank first.
    """
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text"), F.col(language).alias("language"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, body, label in zip(*(c.to_pylist() for c in batch.columns)):
                family = family_of(label) or (rank_families(body)[0] if body else "")
                if family in _LEXICAL or family in ("python", "json"):
                    out.append((key, family, *diagnose(body, family)))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "family", "ok", "foreign_family"])

    return rows.mapInArrow(run, "id string, family string, ok boolean, foreign_family string")
