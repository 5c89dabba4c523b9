"""Names, designators, codes and slugs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER = r"[\p{L}]"


def norm_name(c: Column) -> Column:
    """Lower case, bracketed parts and punctuation to blanks, letters and digits parted, blanks collapsed; null gives ''.

    Java's lower() stands for case folding: only letters such as the sharp s differ.
    """
    c = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    c = F.regexp_replace(c, r"[\(\[\{][^\)\]\}]*[\)\]\}]", " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s]+", " ")
    c = F.regexp_replace(c, rf"(?<={_LETTER})(?=\p{{Nd}})", " ")
    c = F.regexp_replace(c, rf"(?<=\p{{Nd}})(?={_LETTER})", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    """norm_name with null for an empty result, as SQL callers want it."""
    return F.nullif(norm_name(c), F.lit(""))


_COSPAR = r"^\s*(\d{4})[-\s]?(\d{1,3})\s*([A-Za-z]{1,3})\s*$"


def norm_cospar(c: Column) -> Column:
    """Designator as YYYY-NNNP; other text upper-cased; blank gives null."""
    raw = F.nullif(F.trim(c), F.lit(""))
    good = F.concat(F.regexp_extract(raw, _COSPAR, 1), F.lit("-"), F.lpad(F.regexp_extract(raw, _COSPAR, 2), 3, "0"), F.upper(F.regexp_extract(raw, _COSPAR, 3)))
    return F.when(raw.rlike(_COSPAR), good).otherwise(F.upper(raw))


def is_standard_cospar(c: Column) -> Column:
    return F.coalesce(c.rlike(_COSPAR), F.lit(False))


def launch_key(c: Column) -> Column:
    """YYYY-NNN of a designator, null where there is none."""
    return F.nullif(F.regexp_extract(norm_cospar(c), r"^(\d{4}-\d{3})", 1), F.lit(""))


#: Coarse class letter → object type. Fixed values.
OBJECT_TYPES = {"P": "PAYLOAD", "S": "PAYLOAD", "R": "ROCKET_BODY", "C": "DEBRIS", "D": "DEBRIS", "X": "UNKNOWN", "Z": "UNKNOWN"}


def object_type(c: Column) -> Column:
    """Type by the first visible letter, UNKNOWN otherwise."""
    first = F.upper(F.substring(F.trim(c), 1, 1))
    out = F.lit("UNKNOWN")
    for kind in ("PAYLOAD", "ROCKET_BODY", "DEBRIS"):
        out = F.when(first.isin(*(k for k, v in OBJECT_TYPES.items() if v == kind)), kind).otherwise(out)
    return out


#: Country spellings → one code each. Fixed values.
COUNTRIES = {"us": "US", "usa": "US", "united states": "US", "ru": "RU", "cis": "RU", "russia": "RU", "su": "RU", "prc": "CN", "cn": "CN", "china": "CN", "uk": "GB", "gb": "GB", "united kingdom": "GB", "fr": "FR", "france": "FR", "jpn": "JP", "jp": "JP", "japan": "JP", "ind": "IN", "in": "IN", "india": "IN"}


def country(c: Column) -> Column:
    """One code per country, null for a spelling that is not known."""
    known = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.try_element_at(known, F.lower(F.trim(c)))


def slugify(c: Column, plus: bool = False) -> Column:
    """Lower case, runs of other characters to one dash, no outer dashes; empty gives null. plus: '+' reads '-plus'."""
    c = F.lower(F.coalesce(c, F.lit("")))
    if plus:
        c = F.regexp_replace(c, r"\+", "-plus")
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))


#: Product strings that mean that none is recorded. Fixed values.
PLACEHOLDERS = ("unk", "unknown", "tba", "none")


def is_uncertain(c: Column) -> Column:
    return F.coalesce(c.endswith("?"), F.lit(False))


def certain(c: Column) -> Column:
    """Without trailing question marks, outer blanks and a leading apostrophe; placeholders and blanks give null."""
    x = F.nullif(F.regexp_replace(F.trim(F.regexp_replace(c, r"\?+$", "")), "^'+", ""), F.lit(""))
    return F.when(F.lower(x).isin(*PLACEHOLDERS), None).otherwise(x)


def codes(c: Column) -> Column:
    """The '/'-parted codes of a joint build, markers stripped; an empty place stays a null element."""
    return F.transform(F.split(c, "/"), lambda t: F.nullif(F.trim(F.regexp_replace(F.trim(t), r"\?+$", "")), F.lit("")))


def is_placeholder_name(c: Column) -> Column:
    return F.coalesce(F.upper(c).rlike(r"\bOBJECT\b"), F.lit(False))


def name_gate(provisional: Column, anchored: Column) -> Column:
    """Whether two names allow a merge: the anchored one says nothing, or both normalise to the same key."""
    return is_placeholder_name(anchored) | ((norm_name(provisional) != "") & (norm_name(provisional) == norm_name(anchored)))


def display_name(name: Column, english: Column, short: Column, code: Column) -> Column:
    """The name if it is ASCII, else the English name, the short name, the code."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(F.when(name.rlike(r"^\p{ASCII}*$"), blank(name)), blank(english), blank(short), code)


def subject_ref(norad: Column, jcat: Column, sat: Column) -> Column:
    return F.coalesce(F.concat(F.lit("norad:"), norad.cast("string")), F.concat(F.lit("jcat:"), jcat), F.concat(F.lit("sat:"), sat.cast("string")))


def dashed_file_number(c: Column) -> Column:
    """SATTTTYYYYMMDDNNNNN as SAT-TTT-YYYYMMDD-NNNNN, null for another shape."""
    return F.when((F.length(c) == 19) & c.startswith("SAT"), F.concat_ws("-", F.substring(c, 1, 3), F.substring(c, 4, 3), F.substring(c, 7, 8), F.substring(c, 15, 5)))


def like_literal(text: str) -> str:
    """A LIKE pattern that holds text anywhere, its wildcards taken as characters."""
    return "%" + text.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_") + "%"
