"""Functions paired with their documentation (problem 2).

A recursive pattern takes comment, signature and balanced body of a function
together; strings and comments inside are stepped over whole, so brackets in
them do not count.  A second pattern of the same groups takes the comment apart,
line by line: sections, directives, placeholders, tags, fields and code (calls
with balanced arguments) are captured apart from prose.  A function is paired
only if the first pattern captures it whole and the second captures prose that
tells more than the name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups that both patterns call: strings, remarks and balanced brackets around them.
_SHARED = r"""
    (?(DEFINE)
      (?P<string> "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' | `(?:[^`\\]|\\.)*+` )
      (?P<remark> /\*(?:[^*]|\*(?!/))*+\*/ | //[^\n]*+ )
      (?P<round>  \( (?: [^()"'`/]++ | (?&string) | (?&remark) | (?&round) | ["'`/] )*+ \) )
      (?P<curly>  \{ (?: [^{}"'`/]++ | (?&string) | (?&remark) | (?&curly) | ["'`/] )*+ \} )
    )
"""
# One unit of source: documentation, then a signature with balanced parentheses, then a balanced body if there is one.
_UNIT = regex.compile(
    _SHARED
    + r"""
    (?P<doc> /\*(?:[^*]|\*(?!/))*+\*/ | (?: ^[ \t]*(?://|\#|--)[^\n]*+(?:\n|\Z) )++ )
    [ \t]*\n*+
    (?P<signature> (?: ^[ \t]*+@[\w.]++(?&round)?\s*+ )*+
        (?: [^\n(){};"'`]++ )?+ (?&round) (?: [^\n{};()"'`] | (?&round) | (?&string) )*+ )
    \s*+ (?P<body> (?&curly) | : [ \t]*+\n (?: (?:[ \t]++[^\n]*+)? \n? (?=[ \t\n]) )*+ (?: [ \t]++[^\n]++ )? )?+
    """,
    regex.VERBOSE | regex.MULTILINE,
)
_PY_DOC = regex.compile(
    r"""
    (?(DEFINE)
      (?P<string> "(?:[^"\\\n]|\\.)*+" | '(?:[^'\\\n]|\\.)*+' )
      (?P<round>  \( (?: [^()"'#]++ | (?&string) | \#[^\n]*+ | (?&round) | ["'] )*+ \) )
    )
    ^(?P<indent>[ \t]*+) (?P<signature> (?:async[ ]+)?def[ ]+\w++\s*+(?&round)(?:\s*->[^\n:]++)?+ ) : [ \t]*+ (?:\#[^\n]*+)?\n
    \s*+ (?P<doc> (?P<q>\"{3}|'{3}) (?: (?!(?P=q)) (?:\\.|.|\n) )*+ (?P=q) )
    (?P<body> (?: \n (?: [ \t]*+ (?=\n|\Z) | (?P=indent)[ \t]++[^\n]*+ ) )*+ )
    """,
    regex.VERBOSE | regex.MULTILINE,
)


def units(source: str | None) -> list[tuple[str, str, str]]:
    """(documentation, signature, body) of each documented function in a source text."""
    if not source:
        return []
    found = [(m.start(), m["doc"], m["signature"].strip(), m["body"] or "") for p in (_UNIT, _PY_DOC) for m in p.finditer(source)]
    return [f[1:] for f in sorted(found)]


# Words and phrases that by themselves tell nothing about a symbol.
_GENERIC = frozenset(
    "a an the this that these it its of for to in on is are be and or with function method constructor procedure routine "
    "func fn def class object member helper utility wrapper implementation impl callback handler getter setter accessor "
    "returns return returned gets get sets set does do doc docs documentation description comment summary brief name "
    "void none null nil undefined string number int integer bool boolean float double any object array list type value param "
    "result default overridden override inherited here".split()
)
_PLACEHOLDER = r"""^\W*(?:
      (?:todo|fixme|xxx|hack|tbd|tba|wip)\b.* | n/?a | none | null | nil | tbd | undocumented | placeholder | stub | lorem\ ipsum.*
      | (?:no|missing|add|insert|write|needs?|put|enter|your|some)\s+(?:a\s+|the\s+|some\s+|your\s+|method\s+|function\s+)*(?:description|documentation|docs?|docstring|comments?|javadoc|jsdoc|summary|text)(?:\s+(?:here|yet|available|provided|given|needed|missing|goes\s+here|to\s+be\s+(?:added|done|written)))*
      | (?:description|documentation|docs?|docstring|comments?|text|summary)(?:\s+(?:goes|is|to\s+be|will\s+be|here|missing|pending|needed|added|follows|later|written|done|todo))*
      | to\ be\ (?:done|written|documented|added|defined|filled(?:\ in)?|completed).* | (?:not\s+(?:yet\s+)?|un)documented(?:\s+yet)? | coming\ soon | same\ as\ above | see\ above | see\ (?:base|super|parent|interface)(?:\ ?class)?
      | (?:beschreibung|dokumentation|kommentar|doku)\s+(?:fehlt|folgt|ergänzen|ausstehend)(?:\s+noch)? | keine\s+(?:beschreibung|dokumentation) | siehe\ oben
      | (?:description|documentation)\s+(?:manquante|à\s+venir|à\s+compléter|absente) | (?:à|a)\s+(?:compléter|documenter|faire)\b.* | sin\s+(?:descripción|documentación) | pendiente | por\s+documentar
      | (?:нет|без)\s+(?:описания|документации) | описание\s+отсутствует | (?:добавить|дописать)\s+описание
      | (?:暂无|没有|无|缺少|待补充?|待写|待完善|待定|请?(?:补充|添加|填写)|此处)?(?:说明|描述|文档|注释|简介)?(?:待补充|缺失|待写|待定|待完善|略|暂无)? | 待(?:补充|定|办|完善|写) | (?:未記入|説明なし|説明未記入|未記載|なし)
    )\W*$"""
_DIRECTIVE = r"""^\W*(?:
      (?:pylint|flake8|mypy|pyright|pyre|pytype|isort|yapf|fmt|ruff|black|bandit|nosec|eslint|eslint-env|jshint|jslint|tslint|stylelint|standard|xo|rslint|biome|deno|rustfmt|clippy|golangci|gofmt|swiftlint|swiftformat|ktlint|detekt|checkstyle|spotless|pmd|findbugs|spotbugs|sonar|resharper|codespell|cspell|spell-?checker|shellcheck|markdownlint|prettier|clang-format|clang-tidy|cppcheck|lint|uncrustify|astyle|doxygen|phpcs|phpstan|psalm|rubocop|istanbul|c8|v8|nyc|coverage|lcov|gcov|jacoco|webpack[a-z]*|vite|rollup|globals?|exported|language|vim?|ex|emacs|kate|analysis|dart|ignore_for_file)\s*(?:[:=]|\s(?:ignore|disable|enable|off|on|next|file|skip|format|push|pop)|[-_.]?(?:ignore|disable|enable|format|lint|off|on)\b).*
      | (?:noqa|nolint(?:next(?:line)?|begin|end)?|nosec|nosonar|nocheck|noinspection|no-op|noop|prettier-ignore(?:-\w+)*|pragma|region|endregion|end\s?region|istanbul|type:\s*ignore|go:\w+|\+build|line\s\d+|biome-ignore|deno-(?:lint|fmt)-ignore\S*|formatter:\s*(?:on|off)|checkstyle:\s*(?:on|off)|eslint-\S+|tslint:\S+|stylelint-\S+|cspell:\S+|jscs:\S+|jshint\S*|c8\s\S+|fall-?through|ts-(?:ignore|nocheck|check|expect-error)|use\s+strict|clang-format\s+(?:on|off)|coding[:=]\s*\S+|-\*-.*-\*-|NOLINT\S*|(?:vi|vim|ex):\s*\S+|swiftlint:\S+|sourcery:\S+|mark:|lint:\S+|spell-?checker:\S+|keep-sorted\s+\S+)(?:[\s:(\[].*)?
    )$"""
_NOTICE = r"""
      \bspdx-license-identifier\b | \bcopyright\b | © | \(c\)\s*(?:19|20)\d\d | \ball\s+rights\s+reserved\b | \blicen[cs]ed?\s+(?:under|to)\b | \blicen[cs]e\b.*\b(?:terms|file|details|agreement|compliance|copy)\b | \b(?:mit|bsd|apache|gpl|lgpl|mpl|isc)[-\s]+(?:public\s+)?licen[cs]e | ^\W*licen[cs]e\W*\S*\W*$
      | \bpermission\s+is\s+hereby\s+granted\b | \bthe\s+software\s+is\s+provided\b | \bas\s+is\W+(?:basis|without) | \bredistribution\s+and\s+use\b | \bredistributions?\s+(?:of|in)\b | \bwarrant(?:y|ies)\b.*\b(?:merchantability|express|implied|kind|any)\b | \bwithout\s+warrant | \bfree\s+software\s+foundation\b | \bthis\s+program\s+is\s+free\s+software\b | \bunless\s+required\s+by\s+applicable\s+law\b | \bin\s+compliance\s+with\s+the\s+licen[cs]e\b | \bmerchantability\b | \bliable\s+for\s+any\b
      | ^\W*this\s+(?:file|code|software|program|library|module|source)\s+(?:belongs\s+to|is\s+part\s+of|may\s+(?:only\s+)?be\s+(?:used|copied|distributed)|is\s+(?:distributed|released|provided|subject)) | ^\W*(?:it|the\s+(?:software|code|program|file|work))\s+(?:may|can|must)\s+(?:not\s+)?(?:only\s+)?be\s+(?:used|copied|distributed|redistributed|modified)\b | ^\W*the\s+(?:software|program|work|code)\s+is\s+(?:provided|distributed|supplied|delivered|given|offered|licen[cs]ed)\b | ^\W*you\s+(?:may|should)\s+(?:not\s+)?(?:obtain|have\s+received|use\s+this|copy) | \bterms\s+of\s+the\s+licen[cs]e\b | \bthis\s+(?:notice|header|licen[cs]e)\b | \bsee\s+(?:the\s+)?(?:file\s+)?licen[cs]e\b
      | ^\W*(?:auto(?:matically)?[-\s]?)?(?:created|generated|written|developed|authored|maintained|modified|added|scaffolded|produced|made)\s+(?:automatically|by|with|using|from|on|at|via)\b | ^\W*auto(?:matically)?[-\s]?generated\b | ^\W*(?:this\s+)?(?:file|code|class|method|function|stub|it)\s+(?:is|was|has\s+been)\s+(?:auto(?:matically)?[-\s]?)?(?:generated|created)\b | \bdo\s+not\s+(?:edit|modify)\b | ^\W*(?:authors?|maintainers?|contributors?|e-?mail|created|date|since|version|revision|origin|source|file(?:name)?|project|company|vendor)\s*[:：]\s
    """
# A tag that has no text of its own, a tag with the text after it, a heading of a list of fields, a field without text, and code.
_TAG_ALONE = r"""^\W*[@\\:{]\s*[@\\]?(?:see|link|linkplain|author|since|version|date|file|copyright|license|licence|module|package|namespace|memberof|alias|name|kind|type|access|public|private|protected|internal|static|readonly|abstract|async|override|overrides|inheritdoc|inheritDoc|export|exports|api|category|group|ingroup|defgroup|addtogroup|hidden|ignore|generated|beta|alpha|experimental|virtual|final|function|func|fn|method|class|constructor|constructs|event|fires|mixin|enum|typedef|template|tparam|suppress|nocollapse|ts-\w+|jsx\w*|flow|format|preserve|test|group)\b.*$ | ^\s*@[\w.\-]+(?:\(.*\))?\s*$ | ^\s*:\w+(?:\s+\w+)?:\s*$"""
_TAG_TEXT = r"""^\W*(?:@|\\|:)(?P<name>param|parameter|arg|argument|property|prop|field|raises|throws|throw|exception|except|return|returns|result|retval|yield|yields|deprecated|note|warning|example|details|brief|summary|remarks|description|desc|todo|since|precondition|postcondition|invariant|pre|post|apiNote|implNote|implSpec)\b(?P<rest>.*)$"""
_SECTION = r"""^\W*(?:args|arguments|params|parameters|returns?|raises|throws|yields?|attributes|examples?|notes?|keyword\ args|kwargs|usage|see\ also|todo|references)\s*[:：]?\s*[-=~]*$"""
_FIELD = r"""^\s*[`*]*\w+[`*]*\s*(?:\([^)]*\))?\s*[:：–-]\s*(?:[\w\[\], .|<>?]{0,24})?$"""
_CODE = r"""^\s*(?:
        .*[;{}]\s*$ | \}.* | [\w.$\[\]>-]+\s*(?:=|\+=|-=|:=|\*=|\+\+|--)(?!=)\s*\S.* | (?:return|await|yield|throw|raise|new|delete|echo)\s+[\w.$]+\s*[(\[.].* | (?:return|break|continue|pass)\s*\w*\s*;?
        | (?:const|let|var|val|int|auto|final|static|public|private)\s+\w+.*[=;(].* | (?:if|for|while|switch|elif|else\ if|foreach|catch|with)\s*\(.*\).* | (?:if|for|while|elif|with)\s.*:\s*$ | else\s*[:{]?\s*$ | try\s*[:{]\s*$
        | (?:async\s+)?(?:def|fn|func|function|fun)\s+\w+\s*\(.*\).* | (?:from\s+\S+\s+)?import\s+[\w.{}*,\s"'/@]+$ | \#\s*include\b.* | using\s+[\w.]+\s*;? | package\s+[\w.]+\s*;?
        | [\w.$]+(?:::\w+)*\s*(?&round)\s*(?:\.\w+(?&round))*\s*;?\s*$ | assert\s.*[=<>(].* | print\s+["'].* | >>>\s.* | \$\s\S.* | @\w+\(.*\)\s*$ | <\/?\w+[^>]*>\s*$ | (?:[\w.]+\s*,\s*)*[\w.]+\s*=>\s*.* | lambda\s+\w+\s*:.*
    )$"""
_SENTENCE_LIKE = r"""^\p{Lu}\p{Ll}+\s\p{Ll}+\s.*[.!?]$"""


def _lines_of(*kinds: str) -> regex.Pattern:
    """A pattern that captures a line of a comment as the first of the kinds it fits, else as prose."""
    rules = {
        "section": f"(?i:{_SECTION})", "directive": f"(?i:{_DIRECTIVE})", "placeholder": f"(?i:{_PLACEHOLDER})", "tagged": f"(?i:{_TAG_TEXT})", "tag": f"(?i:{_TAG_ALONE})", "field": _FIELD,
        "told": _SENTENCE_LIKE, "code": _CODE, "notice": f"(?= .*? (?i:{_NOTICE}) ) .*", "prose": ".*",
    }
    return regex.compile(_SHARED + " | ".join(f"(?P<{k}> {rules[k]} )" for k in (*kinds, "prose")), regex.VERBOSE)


_LINE = _lines_of("section", "directive", "placeholder", "tagged", "tag", "told", "code")
_LINE_OF_SECTION = _lines_of("section", "directive", "placeholder", "tagged", "tag", "field", "told", "code")
_TEXT_OF_TAG = _lines_of("told", "code")
_SAID, _SAID_PLAINLY = _lines_of("notice", "placeholder", "directive"), _lines_of("placeholder", "directive")
_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’]\p{L}+)?")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")
_CAMEL = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
_LINE_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!\*)|//+[!<]?|#+!?|--+|;+|\"{3}|'{3}|<!--|%+|r\"{3})\s?|\s*(?:\*+/|\"{3}|'{3}|-->)\s*$")
_XML = regex.compile(r"</?(?:summary|remarks|para|param|returns|value|see|seealso|typeparam|inheritdoc|example|exception|code|c|p|br|b|i|em|strong|pre|ul|li|ol|tt)\b[^<>]*>", regex.I)
_INLINE_TAG = regex.compile(r"\{@(?:inherit\w*|link\w*|see|code|literal|value)\b[^{}]*\}", regex.I)
_SENTENCE = regex.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])")


_TYPE, _OPERAND = regex.compile(r"^\s*(?:\{[^{}]*\})?"), regex.compile(r"^(?:\[[^\]]*\]|[\w.$]+)\s*:?\s*[-–—]?\s*")
# No notice is without one of these, so most sentences need no search for one.
_NOTICE_HINTS = ("copyright", "licen", "rights", "©", "(c)", "permission", "software", "as is", "redistribut", "warrant", "program", "law", "merchant", "liable", "this", "notice", "header", "edit", "modify")
_NOTICE_FIRST = regex.compile(r"\W*(?:this|it|the|you|auto|created|generated|written|developed|authored|maintained|modified|added|scaffolded|produced|made|file|code|class|method|function|stub|author|maintainer|contributor|e-?mail|date|since|version|revision|origin|source|project|company|vendor)", regex.I)


def _tells(sentence: str) -> bool:
    low = sentence.lower()
    pattern = _SAID if any(h in low for h in _NOTICE_HINTS) or _NOTICE_FIRST.match(low) else _SAID_PLAINLY
    return pattern.fullmatch(sentence).lastgroup == "prose"


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    for end in ("ing", "ies", "ed", "es", "s"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            word = word[: -len(end)]
            break
    word = word.rstrip("e")
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


@lru_cache(maxsize=200_000)
def _name_stems(name: str) -> frozenset[str]:
    runs = [*_WORD.findall(name.replace("_", " ")), *regex.findall(r"[A-Za-z]+", name)]
    parts = [p.lower() for run in runs for p in _CAMEL.split(run) if p]
    return frozenset(_stem(p) for p in parts) | {name.lower()} | {"".join(parts)}


def _lines(doc: str) -> Iterator[str]:
    for line in doc.replace("\r", "\n").split("\n"):
        before = None
        while before != line:
            before, line = line, _LINE_MARKS.sub("", line)
        if "<" in line:
            line = _XML.sub(" ", line)
        if "{@" in line:
            line = _INLINE_TAG.sub(" ", line)
        yield line.strip()


def description(doc: str | None, name: str | None) -> str:
    """What a documentation comment tells about its symbol beyond the name; '' if nothing.

    Dropped: comment marks, rules, placeholders, tags without text of their own,
    tool directives, notices of licence or origin, code, and words that only
    repeat the name.
    """
    if not doc or not doc.strip():
        return ""
    said = []
    section = False
    for line in _lines(doc):
        if not any(c.isalpha() for c in line):
            continue
        found = (_LINE_OF_SECTION if section else _LINE).fullmatch(line)
        kind = found.lastgroup  # groups inside a kind close before it
        if kind == "section":
            section = True
        elif kind == "tagged":
            line = _TYPE.sub("", found["rest"]).strip()
            tag = found["name"].lower()
            if tag in ("param", "parameter", "arg", "argument", "property", "prop", "field", "throws", "throw", "raises", "exception", "except"):
                line = _OPERAND.sub("", line)
            if tag == "todo" or len(_WORD.findall(line)) < 2 and not _CJK.search(line):
                continue
            kind = _TEXT_OF_TAG.fullmatch(line).lastgroup
        if kind in ("prose", "told"):
            said += [sentence for sentence in _SENTENCE.split(line) if sentence and _tells(sentence)]
    text = " ".join(said).strip()
    if not text:
        return ""
    if not text.isascii() and len(_CJK.findall(text)) >= 2:
        return text
    stems = _name_stems(name or "")
    for word in _WORD.findall(text):
        low = word.lower()
        if low in _GENERIC or low.isdigit():
            continue
        if low in stems or _stem(low) in stems:
            continue
        parts = [p.lower() for p in _CAMEL.split(word) if p]
        if len(parts) > 1 and all(_stem(p) in stems for p in parts):
            continue
        return text
    return ""


def _as_source(doc: str, signature: str) -> str:
    """The function as a source text: its comment, then its signature."""
    bare = doc.strip()
    if regex.match(r"^(?:/\*[\s\S]*\*/|(?:\s*(?://|#|--)[^\n]*(?:\n|$))+)$", bare):
        return bare + "\n" + signature
    return "/**\n" + doc.replace("*/", "* /") + "\n*/\n" + signature


def _capture(doc: str, signature: str) -> str | None:
    """The documentation that the recursive pattern captures in front of the signature, or None.

    A signature that was cut off, or has no parentheses, is still one: the comment
    is captured in front of an empty one.
    """
    m = _UNIT.fullmatch(_as_source(doc, signature.strip())) or _UNIT.match(_as_source(doc, "()"))
    return m and m["doc"]


def newest(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per non-null key: the one with the greatest ``order`` (nulls last; ties by the other columns).

    Combined in the map tasks, so a key with a third of all rows is no burden.
    """
    row = F.struct(F.col(order).alias("__o"), *[F.col(c) for c in columns])
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(row).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])


def describe_pairs(df: DataFrame, id_column: str, name: str, docstring: str, signature: str) -> DataFrame:
    """(id, signature, description): rows whose documentation says something beyond the name.

    Rows with a null or blank docstring or signature give nothing; a null name
    counts as empty; whole texts are read; rows repeated give repeated pairs.
    """
    rows = df.select(
        F.col(id_column).cast("string").alias("id"), F.col(name).alias("name"), F.col(docstring).alias("docstring"), F.col(signature).alias("signature")
    ).where(F.col("docstring").rlike(r"\p{L}") & F.col("signature").rlike(r"\S"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (key, signature, said)
                for key, name, doc, signature in zip(*(c.to_pylist() for c in batch.columns))
                if (captured := _capture(doc, signature)) and (said := description(captured, name))
            ]
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "signature", "description"])

    return rows.mapInArrow(run, "id string, signature string, description string")


def extract_units(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, documentation, signature, body) of the documented functions in source texts.

    Null and empty texts give nothing; a text may give many rows.
    """
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(text).alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (key, said, signature, body)
                for key, text in zip(*(c.to_pylist() for c in batch.columns))
                for doc, signature, body in units(text)
                if (said := description(doc, (regex.findall(r"(\w+)\s*\(", signature) or [""])[0]))
            ]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "documentation", "signature", "body"])

    return rows.mapInArrow(run, "id string, documentation string, signature string, body string")
