"""Functions over source text that SQL expressions cannot carry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Per family: comment marks to the end of the line, block comments, string delimiters.
_FAMILIES = {
    "c": (("//",), (("/*", "*/"),), ('"', "'", "`")),
    "hash": (("#",), (), ('"""', "'''", '"', "'")),
    "lua": (("--",), (("--[[", "]]"),), ('"', "'")),
    "sql": (("--",), (("/*", "*/"),), ("'",)),
    "markup": ((), (("<!--", "-->"),), ('"', "'")),
    "lisp": ((";",), (), ('"',)),
    "percent": (("%",), (), ('"',)),
}
_OF = {"python": "hash", "ruby": "hash", "shell": "hash", "yaml": "hash", "terraform": "hash", "properties": "hash", "nix": "hash", "lua": "lua", "sql": "sql", "html": "markup", "xml": "markup", "clojure": "lisp", "erlang": "percent"}


def _pattern(family: str) -> re.Pattern:
    lines, blocks, strings = _FAMILIES[family]
    keep = "|".join(rf"{re.escape(q)}(?:\\[\s\S]|(?!{re.escape(q)})[\s\S])*?(?:{re.escape(q)}|\Z)" for q in strings)
    drop = [rf"{re.escape(a)}[\s\S]*?(?:{re.escape(b)}|\Z)" for a, b in blocks] + [rf"{re.escape(x)}[^\n]*" for x in lines]
    return re.compile(f"(?P<keep>{keep})|(?P<drop>{'|'.join(drop)})")


_PATTERNS = {f: _pattern(f) for f in _FAMILIES}


def strip_comments(text: str, language: str) -> str:
    """Comments become blanks of the same lines; strings stay."""
    pattern = _PATTERNS[_OF.get(language, "c")]
    return pattern.sub(lambda m: m["keep"] if m["keep"] is not None else re.sub(r"[^\n]", " ", m["drop"]), text)


@F.pandas_udf(T.StringType())
def without_comments(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else strip_comments(t, g or "") for t, g in zip(text, language)])


# Forms by which a program picks what it calls at run time.
DISPATCH = {
    "computed-member": r"\b\w+\[[^\]\d'\"][^\]]*\]\s*\(",
    "reflection": r"\b(?:getattr|setattr|__import__|importlib\.import_module|Class\.forName|Method\.invoke|Reflect\.\w+|reflect\.\w+)\s*\(",
    "event": r"\.(?:emit|dispatchEvent|dispatch|publish|trigger|fire)\s*\(\s*['\"]([\w:.\-]+)['\"]",
    "listener": r"\.(?:on|once|addListener|addEventListener|subscribe|connect)\s*\(\s*['\"]([\w:.\-]+)['\"]",
    "callback-field": r"\b(?:this|self)\.(?:on[A-Z]\w*|\w*(?:[Cc]allback|[Hh]andler|[Ll]istener)s?)\b\s*\(",
    "function-pointer": r"\(\s*\*\s*\w+\s*\)\s*\(|->\s*\w+\s*\([^)]*\)",
}


def dispatch_sites(text: str, language: str) -> list[tuple[str, int, str]]:
    """(form, line, matched text) outside comments."""
    clean = strip_comments(text, language)
    found = [(form, clean.count("\n", 0, m.start()) + 1, m.group(0)[:120]) for form, p in DISPATCH.items() for m in re.finditer(p, clean)]
    return sorted(found, key=lambda x: (x[1], x[0]))


def truncate_lines(text: str, most: int) -> str:
    """At most ``most`` characters, cut at the end of a line where one lies in the last half."""
    if len(text) <= most:
        return text
    cut = text.rfind("\n", most // 2, most)
    return text[: cut if cut > 0 else most]
