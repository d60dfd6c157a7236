"""Column expressions over names, paths and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other spellings of language names.
LANGUAGE_ALIASES = {"golang": "go", "py": "python", "js": "javascript", "ts": "typescript", "c++": "cpp", "c#": "csharp"}
# Score added for a symbol's kind.
KIND_BONUS = {
    "function": 10, "method": 10, "class": 8, "interface": 9, "type_alias": 6, "struct": 6, "trait": 9, "enum": 5, "component": 8, "route": 9, "module": 4,
    "property": 3, "field": 3, "variable": 2, "constant": 3, "import": 1, "export": 1, "parameter": 0, "namespace": 4, "file": 0, "protocol": 9, "enum_member": 3,
}
# Languages that may resolve into each other.
LANGUAGE_FAMILY = {
    "java": "jvm", "kotlin": "jvm", "scala": "jvm", "swift": "apple", "objc": "apple", "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web",
    "arkts": "web", "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet",
}
#: Java and RE2 both read these: paths that hold tests, and paths of examples and fixtures.
TEST_FILE = (
    r"(^|/)(test_|[Tt]est\.)[^/]*$|[._-]([Tt]ests?|[Ss]pecs?)\.[A-Za-z0-9]+$|(Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$"
    r"|/(tests?|__tests__|specs?|testlib|testing|ohostest)/|^(tests?|specs?)/|(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/"
    r"|(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
)
GENERATED_FILE = r"(\.(pb|g|gen|generated|freezed|designer|Designer)\.[A-Za-z]+|_pb2(_grpc)?\.pyi?|_generated\.[a-z]+|\.min\.(js|mjs|css)|\.bundle\.js)$|/(__generated__|generated)/"


def map_of(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def plain_kind(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def plain_language(language: Column) -> Column:
    low = F.lower(F.trim(language))
    return F.coalesce(map_of(LANGUAGE_ALIASES, low), low, F.lit("unknown"))


def plain_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def directory(path: Column) -> Column:
    """Everything before the last slash; ``.`` for a file at the root."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(folder == "", ".").otherwise(folder)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def is_generated_file(path: Column) -> Column:
    return path.rlike(GENERATED_FILE)


def low_value_file(path: Column) -> Column:
    return is_test_file(path) | is_generated_file(path)


def name_tail(name: Column) -> Column:
    """What follows the last ``.`` or ``:``."""
    return F.regexp_extract(name, r"([^.:]*)$", 1)


def node_id(kind: Column, file_path: Column, name: Column, line: Column) -> Column:
    """kind:32 hex digits of sha256(path:kind:name:line)."""
    return F.concat_ws(":", kind, F.substring(F.sha2(F.concat_ws(":", file_path, kind, name, line.cast("string")), 256), 1, 32))


def kind_bonus(kind: Column) -> Column:
    return F.coalesce(map_of(KIND_BONUS, kind), F.lit(0))


def segments(name: Column, longest: int = 32, most: int = 12) -> Column:
    """Lower-cased words of an identifier, 2 to ``longest`` characters, not of digits only, the first ``most`` distinct ones."""
    cut = F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2")
    cut = F.regexp_replace(cut, r"(\p{Lu})(\p{Lu}\p{Ll})", "$1 $2")
    words = F.transform(F.regexp_extract_all(cut, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.lower(w))
    kept = F.filter(words, lambda w: (F.length(w) >= 2) & (F.length(w) <= longest) & ~w.rlike(r"^\p{N}+$"))
    return F.slice(F.array_distinct(kept), 1, most)


def folder_parts(path: Column) -> tuple[Column, Column]:
    """The folder of a path, empty at the top, and how many parts it has, 1 at least."""
    folder = F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1, F.lit(0)))
    return folder, F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1


def shared_directories(a: Column, b: Column, weight: int = 15, cap: int = 80) -> Column:
    """Leading folders two paths share, times ``weight``, at most ``cap``; none if a path is unknown."""
    (da, na), (db, nb) = folder_parts(a), folder_parts(b)
    parts = F.least(na, nb)
    same = [((parts >= k) & (F.substring_index(da, "/", k) == F.substring_index(db, "/", k))).cast("int") for k in range(1, -(-cap // weight) + 1)]
    return F.least(sum((F.coalesce(x, F.lit(0)) for x in same), F.lit(0)) * weight, F.lit(cap)).cast("int")


def cjk_spaced(text: Column) -> Column:
    """A space between neighbouring CJK ideographs, so each becomes a term."""
    return F.regexp_replace(text, r"(?<=[一-鿿])(?=[一-鿿])", " ")
