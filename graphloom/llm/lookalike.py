"""One form for texts that look the same (problem 8).

1. Ignorable characters are deleted and compatibility forms that look like (or
   join) ordinary letters, digits and spaces are replaced by these; forms a
   reader can tell apart (raised digits, circled or bold letters) stay.
2. Every letter is replaced by the name of its look-alike class.
3. Each word is a lattice of the letters its classes allow.  Viterbi picks the
   path with the best character bigram score, where a path pays for leaving
   its script.  The letters of a class look the same in print, so the stored one
   has no say.
4. Characters that are alike but not the same in print (0 and o, 1, l and I) are
   lattices too, where they stand between letters; here a path pays for leaving
   the stored character, and only the score can make two such texts equal.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.skew import skew_join
from graphloom.runtime import staged

# Letters of other scripts whose usual glyph is that of the Latin letter named.
LOOKALIKES = {
    "A": "АΑᎪⲀ", "B": "ВΒᏴⲂ", "C": "СϹᏟⲤ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻⲎ", "I": "ІΙӀⲒ",
    "J": "ЈᎫͿ", "K": "КΚᏦⲔK", "L": "Ꮮ", "M": "МΜᎷⲘϺ", "N": "ΝⲚ", "O": "ОΟՕⲞ", "P": "РΡᏢⲢ", "Q": "Ԛ",
    "S": "ЅՏᏚ", "T": "ТΤᎢⲦ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧⲬ", "Y": "УΥҮⲨ", "Z": "ΖᏃⲌ",
    "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո",
    "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "хⲭ", "y": "у",
    "æ": "ӕ", "Æ": "Ӕ", "ə": "ә", "Ə": "Ә", "þ": "ϸ", "Þ": "Ϸ", "μ": "µ", "-": "‐‑", "/": "⁄∕",
}

#: Format characters that are drawn (Arabic and Kaithi number signs and the like).
_DRAWN_FORMATS = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD])
_JOINED = ("<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")


def _ignorable(cp: int, category: str) -> bool:
    if cp in (9, 10, 11, 12, 13, 0x85):
        return False
    return (
        (category == "Cf" and cp not in _DRAWN_FORMATS)
        or category == "Cc"
        or cp in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
        or 0x180B <= cp <= 0x180F
        or 0xFE00 <= cp <= 0xFE0F
        or 0xE0000 <= cp <= 0xE0FFF
    )


def _replacement(ch: str, category: str) -> str | None:
    """What a compatibility form is replaced by, or None if it stays."""
    if category == "Zs":
        return " "
    if category in ("Zl", "Zp") or ch in "\r\x0b\x0c\x85":
        return "\n"
    kind, _, codes = unicodedata.decomposition(ch).partition(" ")
    if not kind.startswith("<"):
        return None
    plain = "".join(chr(int(c, 16)) for c in codes.split())
    if kind in _JOINED:
        return plain
    letters = all(unicodedata.category(c)[0] == "L" for c in plain)
    # Joined letters (ligatures, numerals made of letters, radicals); not the letter variants a reader tells apart.
    if kind == "<compat>" and letters and (len(plain) > 1 or category in ("Nl", "So")):
        return plain
    return None


@lru_cache(maxsize=1)
def _tables() -> tuple[dict, dict]:
    """(replacements before decomposition, class of each letter after it)."""
    before: dict[int, str | None] = {}
    for cp in (*range(0x3000), *range(0x3000, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x11200), *range(0x1D000, 0x20000), *range(0xE0000, 0xE1000)):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        category = unicodedata.category(ch)
        if _ignorable(cp, category):
            before[cp] = None
        elif (to := _replacement(ch, category)) is not None and to != ch:
            before[cp] = to
    after = {ord(c): name for name, others in LOOKALIKES.items() for c in unicodedata.normalize("NFKD", others) + others if c != name}
    return before, after


def skeleton(text: str) -> str:
    """The looks of a text: decomposed, letters replaced by the names of their classes."""
    if text.isascii():
        return text.replace("\r\n", "\n").translate(_tables()[0]) if _ASCII_ODD.search(text) else text
    before, after = _tables()
    odd, alike = _charsets()
    plain = text.replace("\r\n", "\n")
    plain = unicodedata.normalize("NFD", plain.translate(before) if odd.search(plain) else plain)
    return plain.translate(after) if alike.search(plain) else plain


_ASCII_ODD = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


@lru_cache(maxsize=1)
def _charsets() -> tuple[re.Pattern, re.Pattern]:
    """Character sets of the two tables: most texts have none of the first and are not rewritten."""

    def charset(points: list[int]) -> re.Pattern:
        runs: list[list[int]] = []
        for p in sorted(points):
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]")

    before, after = _tables()
    return charset(list(before)), charset(list(after))


_WORD = regex.compile(r"[\p{L}\p{M}]+")
_PIECES, _ASCII_PIECES = regex.compile(r"([\p{L}\p{M}]+)"), re.compile(r"([A-Za-z]+)")
_SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee")}


@lru_cache(maxsize=100_000)
def script_of(ch: str) -> str:
    return next((s for s, p in _SCRIPTS.items() if p.match(ch)), "")


@lru_cache(maxsize=1)
def _lattice() -> dict[str, tuple[str, ...]]:
    """Class name -> the letters that may stand there."""
    return {name: (name, *dict.fromkeys(c for c in others if c.isalpha())) for name, others in LOOKALIKES.items() if name.isalpha()}


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter = Counter()
    pairs: Counter = Counter()

    def fold() -> None:
        for word, n in words.items():
            bare = [c for c in unicodedata.normalize("NFD", word) if unicodedata.category(c)[0] == "L"]
            scripts = {script_of(c) for c in bare}
            if len(scripts) == 1 and "" not in scripts:
                for pair in zip(["^", *bare], [*bare, "$"]):
                    pairs[pair] += n
        words.clear()

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                words.update((_ASCII_PIECES if text.isascii() else _PIECES).findall(text))
            if len(words) > 200_000:
                fold()
    fold()
    yield pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string()), pa.array(list(pairs.values()), pa.int64())],
        names=["a", "b", "n"],
    )


def fit_scripts(df: DataFrame, text: str) -> dict[str, dict]:
    """Character bigram counts of the words written in one script, over all rows.

    Only letters of six alphabets are counted, so the table that reaches the
    driver is bounded by the squares of their sizes, whatever the corpus.
    """
    counts = df.select(text).mapInArrow(_bigram_counts, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    model: dict[str, dict] = {"pair": {}, "one": {}}
    for a, b, n in counts.collect():
        model["pair"][a + b] = n
        model["one"][a] = model["one"].get(a, 0) + n
    return model


#: What a path pays, in nats, for a step from one script into another.
SCRIPT_CHANGE = 12.0


#: What a path pays for another reading than the stored character, and for a step between letter and digit.
REREAD, DIGIT_STEP = 9.0, 7.0
# Characters that are alike in many typefaces, as they may be read between letters.
READINGS = {"0": "0oO", "1": "1lI", "I": "Il"}
_UNSURE = re.compile(r"[01I](?:(?<=[^\W\d_][01])(?=[^\W\d_])|(?<=[a-z]I)(?=[a-z]))")

_CODE = re.compile(r"[2-9]|^[0-9a-fA-F]+$")


class Speller:
    """Picks the letters of a word from its look-alike lattice; ``scored`` off keeps every stored character that could be read otherwise."""

    def __init__(self, model: dict[str, dict], scored: bool = True):
        self.pair, self.one, self.scored = model["pair"], model["one"], scored
        # Besides a class's own name only letters that the corpus's words of one script use can win.
        kept = {name: (name, *[c for c in letters[1:] if c in self.one]) for name, letters in _lattice().items()}
        self.lattice = {name: letters for name, letters in kept.items() if len(letters) > 1}
        self.memo: dict[str, str] = {}
        self.steps: dict[str, float] = {}

    def _step(self, a: str, b: str) -> float:
        """The score of ``b`` after ``a``; there are as many as pairs of letters."""
        found = self.steps.get(a + b)
        if found is None:
            found = self.steps[a + b] = self._score(a, b)
        return found

    def _score(self, a: str, b: str) -> float:
        change = SCRIPT_CHANGE if a != "^" and b != "$" and script_of(a) != script_of(b) else 0.0
        return math.log((self.pair.get(a + b, 0) + 0.01) / (self.one.get(a, 0) + 3.0)) - change

    def _viterbi(self, word: str) -> str:
        lattice, steps, step = self.lattice, self.steps, self._step
        paths = [(0.0, "^", "")]  # (score, last letter, letters so far)
        for ch in word:
            if unicodedata.category(ch)[0] == "M":
                paths = [(s, last, done + ch) for s, last, done in paths]
                continue
            letters = lattice.get(ch)
            if letters is None and len(paths) == 1:
                s, last, done = paths[0]
                paths = [(s - (steps.get(last + ch) or step(last, ch)), ch, done + ch)]
                continue
            # Among equal scores the lesser path wins, so the choice never depends on the input's characters.
            paths = [min([(s - (steps.get(last + c) or step(last, c)), c, done + c) for s, last, done in paths]) for c in letters or (ch,)]
        return min((s - self._step(last, "$"), done) for s, last, done in paths)[1]

    def word(self, word: str) -> str:
        out = self.memo.get(word)
        if out is None:
            if len(self.memo) > 300_000:  # bounds the memory of a worker
                self.memo.clear()
            lattice = self.lattice
            out = self.memo[word] = self._viterbi(word) if any(c in lattice for c in word) else word
        return out

    def _sure(self, looks: str) -> str:
        """A text with the words re-read that hold unsure characters; words with other digits, or of hexadecimal digits only, are codes and stay."""
        out, last, n = [], 0, len(looks)
        for m in _UNSURE.finditer(looks):
            a, b = m.start(), m.end()
            if a < last:
                continue
            while a > last and looks[a - 1].isalnum():
                a -= 1
            while b < n and looks[b].isalnum():
                b += 1
            word = looks[a:b]
            out += [looks[last:a], word if _CODE.search(word) else self._reread(word)]
            last = b
        return "".join([*out, looks[last:]]) if out else looks

    def _reread(self, word: str) -> str:
        """A word with characters between letters that could be read in several ways, as it scores best."""
        out = self.memo.get("\0" + word)
        if out is None:
            paths = [(0.0, "^", "")]
            for i, ch in enumerate(word):
                inside = 0 < i < len(word) - 1 and word[i - 1].isalpha() and word[i + 1].isalpha()
                steps = []
                for c in READINGS.get(ch, ch) if inside else ch:
                    for s, last, done in paths:
                        cost = -self._step(last, c) if c.isalpha() and (last == "^" or last.isalpha()) else DIGIT_STEP if c.isalpha() != last.isalpha() and last != "^" else 0.0
                        steps.append((s + cost + (REREAD if c != ch else 0.0), c, done + c))
                best = {c: min(x for x in steps if x[1] == c) for _, c, _ in steps}
                paths = list(best.values())
            out = self.memo["\0" + word] = min((s, done) for s, _, done in paths)[1]
        return out

    def text(self, text: str) -> str:
        looks = skeleton(text)
        if self.scored:
            looks = self._sure(looks)
        pieces = (_ASCII_PIECES if looks.isascii() else _PIECES).split(looks)
        known, word = self.memo.get, self.word
        pieces[1::2] = [known(p) or word(p) for p in pieces[1::2]]
        formed = "".join(pieces)
        return formed if formed.isascii() else unicodedata.normalize("NFC", formed)


def normalise(df: DataFrame, text: str, out: str = "text_form", model: dict | None = None, scored: bool = True) -> DataFrame:
    """``df`` with the column ``out``: the form of ``text`` that all look-alike texts share.

    Null stays null, an empty text stays empty, whole texts are read whatever
    their length; other columns pass unchanged (an existing ``out`` is an error).
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {out} exists")
    model = fit_scripts(df, text) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, scored)
        for batch in batches:
            forms = [None if t is None else speller.text(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def _hashed(df: DataFrame, id_column: str, text: str, model: dict | None, scored: bool = True) -> DataFrame:
    """(id, class_id, stored): hashes of the shared form and of the stored text, for each non-null text."""
    formed = normalise(df.select(F.col(id_column).alias("id"), F.col(text).alias("text")).where("text is not null"), "text", "form", model, scored)
    return staged(formed.select("id", F.unhex(F.sha2("form", 256)).alias("class_id"), F.unhex(F.sha2("text", 256)).alias("stored")), "lookalikes")


def lookalike_classes(df: DataFrame, id_column: str, text: str, model: dict | None = None, scored: bool = True) -> DataFrame:
    """(id, class_id, stored, n_rows, n_links): one row per non-null text with the class of texts that look like it.

    class_id and stored are hashes of the shared form and of the stored text;
    n_rows counts the rows of the class, n_links those among them whose stored text
    is another one.  Counted by sums only, so a class of any size is no burden.
    """
    rows = _hashed(df, id_column, text, model, scored)
    same = rows.groupBy("class_id", "stored").agg(F.count(F.lit(1)).alias("n_same"))
    sizes = same.groupBy("class_id").agg(F.sum("n_same").alias("n_rows"), F.count(F.lit(1)).alias("n_forms")).where("n_forms > 1")
    mixed = same.join(sizes, "class_id").select(F.col("class_id").alias("m_class"), F.col("stored").alias("m_stored"), "n_rows", (F.col("n_rows") - F.col("n_same")).alias("n_links"))
    joined = rows.join(mixed, (F.col("class_id") == F.col("m_class")) & (F.col("stored") == F.col("m_stored")), "left")
    return joined.select("id", F.hex("class_id").alias("class_id"), F.hex("stored").alias("stored"), "n_rows", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def lookalike_pairs(df: DataFrame, id_column: str, text: str, model: dict | None = None) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows whose stored texts differ but look the same.

    Null texts take no part; rows with equal stored texts are no pair.  A view of
    the classes for callers who need pairs: only classes with two different stored
    texts are joined, and a hot class is spread.  Its rows grow with the square of a class's different
    texts; ``lookalike_classes`` says the same in one row per text.
    """
    rows = _hashed(df, id_column, text, model)
    mixed = rows.groupBy("class_id").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("class_id")
    members = staged(rows.join(mixed, "class_id", "left_semi").select("id", F.hex("class_id").alias("class_id"), "stored"), "twins")
    a = members.select(F.col("id").alias("id_a"), F.col("stored").alias("stored_a"), F.col("class_id").alias("key_a"))
    b = members.select(F.col("id").alias("id_b"), F.col("stored").alias("stored_b"), F.col("class_id").alias("key_b"))
    joined = skew_join(a, b, "key_a", "key_b", share=0.05)
    return joined.where("id_a < id_b and stored_a <> stored_b").select("id_a", "id_b").distinct()
