"""Text rules as column expressions: words, size estimates, section and path arithmetic.

Two size estimators exist on purpose. The one that chunks documents counts wide scripts by character; the
one that trims a context window does not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
#: A sign that is neither a word's nor a space; the frequent letters stand singly, as a table, and are looked up first.
ODD = r"[[^abcdefghijklmnopqrstuvwxyz0123456789_ ]&&[^\p{L}\p{N}]]"
ATOM = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
#: Scripts counted by character, scripts whose estimate is uncalibrated, and the factor.
WIDE = r"[\x{3000}-\x{303f}\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}]"
UNCALIBRATED = (
    r"[\x{0370}-\x{03ff}\x{0400}-\x{04ff}\x{0530}-\x{058f}\x{0590}-\x{05ff}\x{0600}-\x{06ff}\x{0900}-\x{097f}\x{0e00}-\x{0e7f}\x{10a0}-\x{10ff}]"
)
SUBWORD = 1.3
PATH_SEP = " > "


def words(text: Column) -> Column:
    return cut(F.lower(text))


def cut(lowered: Column) -> Column:
    """The words of a text in lower case."""
    return F.regexp_extract_all(lowered, F.lit(WORD), 0)


def parts(lowered: Column) -> Column:
    """The words of a short text in lower case, by what lies between them."""
    return F.array_remove(F.split(lowered, NO_WORD), "")


def plain(text: Column) -> Column:
    """A text in lower case with a space for each sign and the space that follows it, and no space at its ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{ODD} ?", " "))


def joined(plain_text: Column, cutter: Callable[[Column], Column]) -> Column:
    """The words of a plain text with one space between them. Most prose is that already and is not cut."""
    return F.when(F.contains(plain_text, F.lit("  ")), F.array_join(cutter(plain_text), " ")).otherwise(plain_text)


def word_count(joined_text: Column) -> Column:
    """How many words a text has that are joined by one space."""
    spaces = F.octet_length(joined_text) - F.octet_length(F.replace(joined_text, F.lit(" "), F.lit("")))
    return F.when(joined_text == "", 0).otherwise(spaces + 1)


def times_held(wide: Column, word: str) -> Column:
    """How often a word stands in words with a space between them and at either end.

    Each find takes the space after the word as well, so where the word stands twice in a row spaces are doubled first.
    """
    without = lambda text, left: F.octet_length(text) - F.octet_length(F.replace(text, F.lit(f" {word} "), F.lit(left)))
    once = (without(wide, " ") / (len(word.encode()) + 1)).cast("int")
    return F.when(F.contains(wide, F.lit(f" {word} {word} ")), without(F.replace(wide, F.lit(" "), F.lit("  ")), f" {word}")).otherwise(once)


def atoms(text: Column) -> Column:
    """Words and signs, each wide character as 1 / 1.3 atom, rounded half to even as a whole.

    A wide character has three bytes or more, so a text with less than two bytes beyond its characters has none.
    """
    count = lambda t: F.size(F.regexp_extract_all(t, F.lit(ATOM), 0))
    wide = F.regexp_count(text, F.lit(WIDE))
    whole = (count(F.regexp_replace(text, WIDE, " ")) + F.rint(wide / F.lit(SUBWORD))).cast("long")
    none = (F.octet_length(text) - F.char_length(text) < 2) | ~text.rlike(WIDE)
    return F.when(none, count(text).cast("long")).otherwise(whole)


def tokens_of(atom_count: Column) -> Column:
    return F.floor(atom_count * F.lit(SUBWORD)).cast("long")


def token_estimate(text: Column) -> Column:
    return tokens_of(atoms(text))


def query_token_estimate(text: Column) -> Column:
    """The context window's estimator: every word and sign counts one, wide or not."""
    return tokens_of(F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0B\f\r]"), 0)))


def script_share(text: Column) -> Column:
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(UNCALIBRATED)) / letters).otherwise(F.lit(0.0))


def path_parts(path: Column) -> Column:
    return F.split(path, PATH_SEP, -1)


def leaf(path: Column) -> Column:
    return F.element_at(path_parts(path), -1)


def top(path: Column) -> Column:
    return F.element_at(path_parts(path), 1)


def depth(path: Column) -> Column:
    """Parts of the joined path; a blank path is one deep."""
    return F.size(path_parts(path))


def ancestors(section: Column) -> Column:
    """A dotted section and all sections above it, shortest first."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


def section_covers(reference: Column, section: Column) -> Column:
    """Whether a section is the reference or lies under it; an empty one on either side covers nothing."""
    held = (section == reference) | F.startswith(section, F.concat(reference, F.lit(".")))
    return F.coalesce((F.length(reference) > 0) & (F.length(section) > 0) & held, F.lit(False))


def section_key(section: Column) -> Column:
    """Sorts dotted sections by number; one that is not all numbers sorts first."""
    parts = F.split(section, r"\.")
    return F.when(section.rlike(r"^[0-9]+(\.[0-9]+)*$"), F.transform(parts, lambda x: x.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def within_section(path: Column, wanted: str) -> Column:
    """A heading path that is the wanted one or lies under it; the wanted text has no wildcards."""
    return (path == F.lit(wanted)) | F.startswith(path, F.lit(wanted + PATH_SEP))


def line_key(line: Column) -> Column:
    """The spelling under which repeated lines count as one: runs of white space, then of digits, folded.

    Single spaces stay as they are, so most lines have nothing to fold.
    """
    spaced = F.when(line.rlike(r"[\t\n\f\r]|  "), F.regexp_replace(line, r"[\t\n\f\r ]+", " ")).otherwise(line)
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, "[0-9]+", "#")).otherwise(spaced)


def bare(line: Column) -> Column:
    """A line without white space at its ends; it holds no line end."""
    outer = F.concat(F.substring(line, 1, 1), F.substring(line, -1, 1))
    return F.when(outer.rlike(r"[\s\x{a0}]"), F.regexp_replace(line, r"^[\s\x{a0}]+|[\s\x{a0}]+$", "")).otherwise(line)


def normal_title(text: Column) -> Column:
    """Lower case, with single spaces for all that is no letter, digit or underscore."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def truncated(text: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(text, 1, n)


def thousands(n: Column) -> Column:
    """A count with commas."""
    return F.format_number(n, 0)


def percent(share: Column) -> Column:
    """A share as whole percents, halves to even."""
    return F.concat(F.rint(share * 100).cast("long").cast("string"), F.lit("%"))


def round3(x: Column) -> Column:
    """Three places of the exact binary value, halves to even; for values below 10**9.

    F.round and F.bround go by the decimal text, so 1.0005 (a little less, in binary) would round up. The value is
    split into two halves of its bits, so that a thousand times either, and the distance to the tie, are exact.
    """
    scaled = x * 134217729.0
    high = scaled - (scaled - x)
    below = F.floor(x * 1000).cast("double")
    past = (high * 1000 - (below + 0.5)) + (x - high) * 1000
    return (below + F.when(past > 0, 1.0).when(past < 0, 0.0).otherwise(F.pmod(below, F.lit(2.0)))) / 1000
