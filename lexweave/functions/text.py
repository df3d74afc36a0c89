"""Text scalars as ``Column -> Column`` expressions.

Everything stays in the JVM. Inputs are expected in composed Unicode form; decomposed input goes
through :mod:`lexweave.functions.compose` once, when it is read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.compose import COMPATIBLE
from lexweave.functions.stage import let, literal

# Letters, digits and underscore. Java's ``\w`` differs on marks and numerals, so say it outright.
WORD = r"\p{L}\p{N}_"


def java(pattern: str) -> str:
    """A pattern written with Unicode ``\\w \\s \\d \\b`` for Java's regular expressions."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair == r"\w":
            out.append(WORD if in_class else f"[{WORD}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = pattern[i] == "[" or (in_class and pattern[i] != "]")
            out.append(pattern[i])
            i += 1
    return "(?U)" + "".join(out)


def quote(value: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|&~#-])", r"\\\1", value)


def whole_word(value: Column) -> Column:
    """Pattern column matching ``value`` literally, between non-word characters."""
    quoted = F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit(f"(?<![{WORD}])\\Q"), quoted, F.lit(f"\\E(?![{WORD}])"))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Accented letters and their plain forms, derived from Unicode decomposition."""
    accented, plain = [], []
    for code in range(0x80, 0x10000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) < 2:
            continue
        kept = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        kept = unicodedata.normalize("NFC", kept)
        if len(kept) == 1 and kept != char:
            accented.append(char)
            plain.append(kept)
    return "".join(accented) + "đĐ", "".join(plain) + "dD"


@lru_cache(maxsize=1)
def _casefold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Where full case folding differs from lower case: one-to-one, then one-to-many."""
    source, target, wide = [], [], []
    for code in range(0x80, min(sys.maxunicode, 0x1FFFF)):
        char = chr(code)
        lowered, folded = char.lower(), char.casefold()
        if lowered != char or lowered == folded:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        else:
            wide.append((char, folded))
    return "".join(source), "".join(target), tuple(wide)


@lru_cache(maxsize=1)
def _compatible_tables() -> tuple[str, str, list[dict[str, str]]]:
    """Characters that compatibility normalisation replaces: by one, and by several."""
    source, target, wide = [], [], []
    for code in range(0x80, 0x2FA20):
        char = chr(code)
        plain = unicodedata.normalize("NFKC", char)
        if plain == char or "\ud800" <= char <= "\udfff":
            continue
        if len(plain) == 1:
            source.append(char)
            target.append(plain)
        else:
            wide.append({"a": char, "b": plain})
    return "".join(source), "".join(target), wide


def compatible(x: Column) -> Column:
    """Compatibility normal form of composed text: full-width letters, ligatures, special spaces.

    Stays in the JVM and so works inside lambdas. Letters followed by combining marks are composed
    at the edge of a job (:mod:`lexweave.functions.compose`).
    """
    source, target, wide = _compatible_tables()
    pairs = literal(wide, "array<struct<a:string,b:string>>")
    narrow = F.translate(x, source, target)
    spelled = F.aggregate(pairs, narrow, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    return F.when(x.rlike(_beyond(r"\x9f", COMPATIBLE)), spelled).otherwise(x)


# Covers every letter whose folded form is longer than one letter; a wider net is harmless.
_WIDE_FOLDS = r"[\u0149\u01f0\u0390\u03b0\u0587\u1e96-\u1e9a\u1f50-\u1ffc\ufb00-\ufb17]"


def _beyond(first: str, letters: str) -> str:
    """A class of letters from ``first`` on. Java tries a class range by range, so most letters are told by
    one comparison before."""
    return rf"[[^\x00-{first}]&&{letters}]"


@lru_cache(maxsize=1)
def _rare_letters() -> str:
    """Letters whose folded or compatibility form is more than lower case, with a few others."""
    source, _, _ = _casefold_tables()
    folds = {c for c in map(chr, range(0x80, 0x1FFFF)) if any(x in source for x in c.lower())}
    codes = sorted({ord(c) for c in folds} | {ord("Σ"), *map(ord, source)})
    spans: list[list[int]] = []
    for code in codes:
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    own = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans)
    return _beyond(r"\x9f", f"[{COMPATIBLE}{_WIDE_FOLDS}{own}]")


def casefold(x: Column) -> Column:
    source, target, wide = _casefold_tables()
    folded = F.replace(F.translate(F.lower(x), source, target), F.lit("ß"), F.lit("ss"))
    rare = [{"a": a, "b": b} for a, b in wide if a != "ß"]
    pairs = literal(rare, "array<struct<a:string,b:string>>")
    unfolded = F.aggregate(pairs, folded, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    return F.when(x.rlike(_beyond(r"\x9f", _WIDE_FOLDS)), unfolded).otherwise(folded)


def _spaced(x: Column, gap: str) -> Column:
    """Each run of ``gap``, a class with white space, becomes one space. Single spaces are no match,
    so that little is copied."""
    return F.trim(F.regexp_replace(x, rf"(?U){gap}(?:{gap}+|(?<! ))", " "))


def collapse(x: Column) -> Column:
    return _spaced(x, r"\s")


def _folded(x: Column) -> Column:
    """``casefold(compatible(x))``; a text without rare letters, by one test, takes the short way."""
    plain = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.when(x.rlike(_rare_letters()), let(compatible(x), casefold)).otherwise(plain)


def normalize_surface(x: Column) -> Column:
    """Compatibility form, case folded, white space squeezed; punctuation stays."""
    return collapse(_folded(x))


def first_word(x: Column) -> Column:
    """The first word of :func:`normalize_surface`, from the text up to the white space after it."""
    head = F.regexp_extract(x, r"(?U)^\s*+(\S++)", 1)
    return F.get(F.split(normalize_surface(head), " ", -1), F.lit(0))


def normalize_text(x: Column) -> Column:
    """Squeeze white space; case stays."""
    return collapse(x)


def _drop_punctuation(x: Column) -> Column:
    return _spaced(x, rf"[^{WORD}:/]")


def canonical_text(x: Column) -> Column:
    return _drop_punctuation(_folded(x))


def strip_diacritics(x: Column) -> Column:
    accented, plain = _accent_table()
    bare = F.regexp_replace(F.translate(x, accented, plain), r"\p{Mn}+", "")
    return F.when(F.octet_length(x) == F.char_length(x), x).otherwise(bare)


def fold(x: Column) -> Column:
    """Case-folded, accent-free text."""
    return let(casefold(x), strip_diacritics)


def text_fingerprint(x: Column) -> Column:
    """Accent-free, case-free, punctuation-free key for duplicate detection."""
    return _drop_punctuation(fold(x))


def folded_canonical(x: Column) -> Column:
    return let(canonical_text(x), strip_diacritics)


def mask_numbers(x: Column) -> Column:
    return collapse(F.regexp_replace(x, r"(?U)\b\d[\d\s]*\d\b", "<number>"))


def mask_slots(text: Column, slots: Column, folded: Column | None = None) -> Column:
    """Replace slot values by ``<slot>``, longest value first, then digit runs by ``<number>``.

    ``folded`` is the text's :func:`folded_canonical` where a query has it already.
    """
    entries = F.transform(
        F.map_entries(slots),
        lambda e, i: F.transform(
            F.transform(e["value"], folded_canonical),
            lambda v, j: F.struct(
                (-F.char_length(v)).alias("rank"),
                i.alias("i"),
                j.alias("j"),
                v.alias("value"),
                F.concat(F.lit("<"), e["key"], F.lit(">")).alias("mask"),
            ),
        ),
    )
    ordered = F.array_sort(F.filter(F.flatten(entries), lambda r: r["value"] != ""))
    masked = F.aggregate(
        F.coalesce(ordered, F.array().cast(_MASK_TYPE)),
        folded_canonical(text) if folded is None else folded,
        lambda acc, r: F.replace(acc, r["value"], r["mask"]),
    )
    return mask_numbers(masked)


_MASK_TYPE = "array<struct<rank:int,i:int,j:int,value:string,mask:string>>"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D+", "")


def slot_in_text(
    slot: Column, value: Column, text: Column, folded: Column | None = None, digits: Column | None = None
) -> Column:
    """Can the slot value be traced back to the text? Phone numbers compare by digits.

    A text that holds the value as it is holds its folded form too. ``folded`` and ``digits`` are those of the
    text where a caller has them already.
    """
    own = digits_of(value)
    plain = folded_canonical(value)
    whole = folded_canonical(text) if folded is None else folded
    return F.when(
        slot == "phone_number", (own != "") & F.contains(digits_of(text) if digits is None else digits, own)
    ).otherwise((plain != "") & (F.contains(text, value) | F.contains(whole, plain)))


def stable_order_key(x: Column, seed: int = 42) -> Column:
    """Hash that orders rows the same way on every run."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), x.cast("string")), 256)


def slot_pairs(slots: Column) -> Column:
    """Slot map to a set of ``(slot, surface value)`` pairs."""
    nested = F.transform(
        F.map_entries(slots),
        lambda e: F.transform(
            e["value"],
            lambda v: F.struct(e["key"].alias("slot"), normalize_surface(v).alias("value")),
        ),
    )
    return F.array_distinct(F.flatten(nested))


def words(x: Column) -> Column:
    """White-space tokens of collapsed text; no tokens for blank text."""
    return F.filter(F.split(x, " ", -1), lambda t: t != "")
