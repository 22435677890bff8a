"""Column functions shared by the operators: blanks, numbers and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of formats, endings of album names, and a misspelling that are taken out of stems.
FORMAT_WORDS = "aiff|mp3|flac|wav|lossless|high-res|digital|official"
NAME_ENDINGS = "soundtrack|original soundtrack|ost"
STEM_ENDINGS = "ost|soundtrack|original soundtrack"
MISSPELT, SPELT = "artifical", "artificial"


def blank_to_null(c: Column) -> Column:
    """Null for null, empty and white-space text."""
    return F.when(F.trim(c) != "", c)


def junk_to_null(c: Column) -> Column:
    """Null for the words that stand for nothing: empty, none, unknown, 0."""
    return F.when(~F.lower(F.trim(c)).isin("", "none", "unknown", "0"), c)


def first_int(c: Column, part: int = 1) -> Column:
    """n of text n/N as a number, or null."""
    return F.split_part(c, F.lit("/"), F.lit(part)).try_cast("int")


def strip_zeros(c: Column) -> Column:
    """Digits without leading zeros; 0 if nothing is left."""
    return F.when(c.isNotNull(), F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0")))


def fold(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def four_digits(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "([0-9]{4})", 1), F.lit(""))


def norm_stem(stem: Column, album: Column | None = None, ascii_only: bool = False) -> Column:
    """A file's stem as a comparable title: album name, leading numbers, format words and signs removed.

    By default letters and digits of every script are kept and zeros are
    stripped at the start of a word only.
    """
    s = stem
    if album is not None:
        short = F.regexp_replace(album, rf"(?i)\s*({NAME_ENDINGS})\s*$", "")
        # Every sign of the name is escaped for itself, so that no name ends a quotation.
        quoted = lambda a: F.concat(F.lit("(?i)"), F.regexp_replace(a, r"([^\p{L}\p{N}])", r"\\$1"))
        s = F.when(F.length(album) > 0, F.regexp_replace(s, quoted(album), F.lit(""))).otherwise(s)
        s = F.when(F.length(short) > 0, F.regexp_replace(s, quoted(short), F.lit(""))).otherwise(s)
    s = F.regexp_replace(s, r"^(?:[0-9]++[\s._-]++)++", "")
    s = F.regexp_replace(s, rf"(?i)\b({FORMAT_WORDS})\b", "")
    s = F.regexp_replace(F.trim(s), rf"(?i)\b({STEM_ENDINGS})$", "")
    s = F.regexp_replace(s, "[^a-zA-Z0-9]" if ascii_only else r"[^\p{L}\p{N}]", " ")
    s = F.replace(F.lower(F.trim(F.regexp_replace(s, " +", " "))), F.lit(MISSPELT), F.lit(SPELT))
    return F.trim(F.regexp_replace(s, r"\s*0+([0-9]+)" if ascii_only else r"(^| )0+([0-9]+)", " $1" if ascii_only else "$1$2"))


def clean_title(title: Column, track: Column) -> Column:
    """Drop a leading number that repeats the track number; decimals such as 14.3 stay."""
    number, sign = F.regexp_extract(title, r"^([0-9]+)([\s.-]+)", 1), F.regexp_extract(title, r"^([0-9]+)([\s.-]+)", 2)
    rest = F.substring(title, F.length(number) + F.length(sign) + 1, F.length(title))
    decimal = (sign == ".") & rest.rlike("^[0-9]")
    same = strip_zeros(number) == strip_zeros(track.cast("string"))
    return F.when((number != "") & ~decimal & same, F.trim(rest)).otherwise(F.trim(title))
