"""Text primitives as Column expressions (JVM side, no Python per row)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardmill.functions import fixed

# Unicode white space spelled out: Java's \s is ASCII only. LINE_SPACE leaves the newline out.
LINE_SPACE = (
    r"\t\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = r"\n" + LINE_SPACE
#: SPACE as characters: cutting them off the ends needs no expression.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_LETTER_OR_DIGIT = r"[^\p{L}\p{N}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and reuse it inside ``body``, instead of repeating its expression."""
    return F.transform(F.array(value), body).getItem(0)


def trim(col: Column) -> Column:
    return F.btrim(col, F.lit(SPACE_CHARS))


def blank_to_null(col: Column) -> Column:
    return F.when(trim(col) != "", col)


def collapse_space(col: Column) -> Column:
    return F.regexp_replace(trim(col), f"[{SPACE}]+", " ")


# --- digits ------------------------------------------------------------------------------------


def to_latin(col: Column) -> Column:
    return F.when(has_bengali_digits(col), F.translate(col, fixed.BENGALI_DIGITS, fixed.LATIN_DIGITS)).otherwise(col)


def has_bengali_digits(col: Column) -> Column:
    return col.rlike(f"[{fixed.BENGALI_DIGITS}]")


def repair_confusables(col: Column) -> Column:
    return F.translate(col, fixed.CONFUSABLE_LETTERS, fixed.CONFUSABLE_DIGITS)


def digits_only(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def digit_ratio(col: Column) -> Column:
    def ratio(bare: Column) -> Column:
        return F.when(bare == "", F.lit(0.0)).otherwise(F.length(digits_only(bare)) / F.length(bare))

    return let(F.regexp_replace(col, f"[{SPACE}\\-().+/]", ""), ratio)


# --- words -------------------------------------------------------------------------------------


def terms(col: Column) -> Column:
    """Lower-cased letter/digit runs in text order, duplicates kept."""
    return F.filter(F.split(F.lower(col), NOT_LETTER_OR_DIGIT), lambda t: t != "")


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accented letter -> base letter, derived from Unicode decomposition of the letter blocks."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = "".join(p for p in parts if not unicodedata.combining(p))
        if base != char and len(base) == 1 and char.lower() == char:
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def fold_letters(col: Column) -> Column:
    """Lower case, precomposed accented letters to their base letter."""
    source, target = _fold_table()
    return F.translate(F.lower(col), source, target)


def fold(col: Column) -> Column:
    """Case and diacritics removed, as the index side of the lexical arm stores its terms."""
    return F.regexp_replace(fold_letters(col), r"[\x{0300}-\x{036F}]", "")


def index_terms(col: Column) -> Column:
    return terms(fold(col))


def matched_terms(query: Column, text: Column) -> Column:
    """Query terms that start some word of ``text``: each once, in query order."""
    return let(
        F.array_distinct(terms(text)),
        lambda words: F.filter(
            F.array_distinct(terms(query)),
            lambda term: F.exists(words, lambda word: word.startswith(term)),
        ),
    )


def any_word_pattern(words: Iterable[str]) -> str:
    return "(?:^|[^a-z0-9])(?:" + "|".join(re.escape(w).replace("\\ ", " ") for w in words) + ")(?:[^a-z0-9]|$)"


def word_tree(words: Iterable[str]) -> str:
    """The alternatives ``words`` by common beginnings: a place in a text is tried once per letter, not once per word."""
    tree: dict = {}
    for word in words:
        node = tree
        for char in word:
            node = node.setdefault(char, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(char).replace("\\ ", " ") + pattern(below) for char, below in sorted(node.items()) if char]
        if len(ways) == 1 and "" not in node:
            return ways[0]
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}" if ways else ""

    return pattern(tree)


def first_letters(words: Iterable[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted({word[0] for word in words})) + "]"


def contains_word(col: Column, words: Iterable[str]) -> Column:
    """``any_word_pattern`` finds something; a space in front of the text stands for its start."""
    words = list(words)
    pattern = f"[^a-z0-9](?={first_letters(words)}){word_tree(words)}(?![a-z0-9])"
    return F.concat(F.lit(" "), F.lower(col)).rlike(pattern)


NUMBERED_UNIT = (
    f"(?i)(?={first_letters(fixed.UNIT_WORDS)})(?<![A-Za-z0-9_]){word_tree(fixed.UNIT_WORDS)}(?![A-Za-z0-9_])"
    rf"\.?[{SPACE}]*(?:no(?![A-Za-z0-9_])\.?)?[{SPACE}]*[:#.\-]?[{SPACE}]*[0-9]"
)
POSTCODE = rf"[A-Za-z][{SPACE}]*-[{SPACE}]*[0-9]{{4}}(?![A-Za-z0-9_])"
#: What every post code holds and few texts do; found without trying each letter.
DASH_DIGITS = rf"-[{SPACE}]*[0-9]{{4}}"


def looks_like_address(col: Column) -> Column:
    numbered = col.rlike("[0-9]") & (col.rlike(NUMBERED_UNIT) | (col.rlike(DASH_DIGITS) & col.rlike(POSTCODE)))
    return contains_word(col, fixed.ADDRESS_WORDS) | numbered


def matches_domain(text: Column, domain: Column) -> Column:
    """The line and the first label of the domain contain one another once squashed."""
    label = F.substring_index(domain, ".", 1)
    squashed = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    return (
        (squashed != "") & (F.length(label) >= 4) & (squashed.contains(label) | label.contains(squashed))
    )


# --- names -------------------------------------------------------------------------------------


def _name_key(col: Column, drop: list[str]) -> Column:
    words = F.split(F.regexp_replace(F.lower(col), "[^a-z0-9]+", " "), " ")
    return F.nullif(
        F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(drop)), " "), F.lit("")
    )


def person_key(col: Column) -> Column:
    return _name_key(col, fixed.HONORIFICS)


def org_key(col: Column) -> Column:
    return _name_key(col, fixed.LEGAL_SUFFIXES)


def initials(col: Column) -> Column:
    """First and last initial without honorifics; '?' when there is no name at all."""

    def pick(parts: Column) -> Column:
        real = F.filter(parts, lambda p: ~F.lower(p).isin(fixed.INITIALS_SKIP))
        return let(F.when(F.size(real) > 0, real).otherwise(parts), letters)

    def letters(use: Column) -> Column:
        first = F.substring(F.element_at(use, 1), 1, 1)
        last = F.substring(F.element_at(use, -1), 1, 1)
        return F.upper(F.when(F.size(use) == 1, first).otherwise(F.concat(first, last)))

    parts = F.filter(F.split(F.coalesce(col, F.lit("")), f"[{SPACE}]+"), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.lit("?")).otherwise(let(parts, pick))


def parse_rect(col: Column) -> Column:
    """'l,t,r,b' -> struct; null unless it is exactly four numbers."""
    numbers = F.transform(F.split(col, ","), lambda p: trim(p).try_cast("double"))
    return let(
        numbers,
        lambda n: F.when(
            (F.size(n) == 4) & F.forall(n, lambda x: x.isNotNull()),
            F.struct(*[n.getItem(i).alias(s) for i, s in enumerate(["left", "top", "right", "bottom"])]),
        ),
    )


def rect_text(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.concat_ws(",", *[F.round(c).cast("long").cast("string") for c in (left, top, right, bottom)])


def keep_first(items: Column, key: Callable[[Column], Column], element_type: str) -> Column:
    """First element per key, order kept (``array_distinct`` compares whole elements); null keys are all kept.

    Sorted by key and place, an element is a first one where its neighbour has another key: n log n steps.
    """
    placed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    firsts = let(
        F.array_sort(placed),
        lambda s: F.filter(s, lambda e, j: (j == 0) | e["k"].isNull() | ~F.coalesce(F.get(s, j - 1)["k"] == e["k"], F.lit(False))),
    )
    back = F.array_sort(F.transform(firsts, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return F.transform(back, lambda e: e["x"]).cast(f"array<{element_type}>")
