"""Name, dose and quantity expressions (all native columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxframe import constants as K

# White space of any script, as pattern class and as plain letters. Printable ASCII, most of any name, leaves the class at its first test.
BLANK = r"[[^!-~]&&[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def _blanks(c: Column) -> Column:
    return F.regexp_replace(c, f"{BLANK}+", " ")


def _simple(c: Column) -> Column:
    """Whether a text is ASCII with no blanks but single spaces: most are, and need none of the patterns of blanks."""
    simple = F.octet_length(c) == F.length(c)
    for odd in [*filter(str.isascii, BLANKS.replace(" ", "")), "  "]:
        simple &= ~F.contains(c, F.lit(odd))
    return simple


def _formless(c: Column, prefixes: list[str]) -> Column:
    """Whether the first word of a simple text is no dosage form."""
    words = {w for p in prefixes for w in ((p[:-2], p[:-1]) if p.endswith("?") else (p,))}
    first = F.lower(F.substring_index(F.trim(c), " ", 1))
    return ~first.isin(sorted(words | {f"{w}." for w in words}))


def strip(c: Column) -> Column:
    """Trim any Unicode white space at both ends; null becomes ''."""
    # Printable ASCII at both ends: there is nothing to trim.
    done = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(done, c).otherwise(F.trim(F.coalesce(c, F.lit("")), F.lit(BLANKS)))


def _norm(c: Column) -> Column:
    lowered = F.translate(F.lower(F.coalesce(c, F.lit(""))), "-", " ")
    return F.trim(_blanks(lowered))


def norm(c: Column) -> Column:
    """Lower case, hyphens as spaces, one space between words; null becomes ''."""
    return F.when(_simple(c) & ~F.contains(c, F.lit("-")), F.trim(F.lower(c))).otherwise(_norm(c))


def strip_form_prefix(c: Column, prefixes: list[str] = K.FORM_PREFIXES) -> Column:
    return F.regexp_replace(c, rf"(?i)^({'|'.join(prefixes)})\.?{BLANK}+", "")


def strip_form_suffix(c: Column) -> Column:
    qualifiers, forms = "|".join(K.FORM_SUFFIX_QUALIFIERS), "|".join(K.FORM_SUFFIXES)
    pattern = rf"(?i)({BLANK}+({qualifiers}))*{BLANK}+({forms}){BLANK}*$"
    return F.trim(F.regexp_replace(c, pattern, ""))


def clean_name(c: Column) -> Column:
    """Drop a leading dosage form and surplus blanks, keep the case."""
    done = _simple(c) & _formless(c, K.FORM_PREFIXES)
    return F.when(done, F.trim(c)).otherwise(F.trim(_blanks(strip_form_prefix(strip(c)))))


def query_term(c: Column, prefixes: list[str] = K.FORM_PREFIXES) -> Column:
    """The text a name is looked up by."""
    done = _simple(c) & ~F.contains(c, F.lit("-")) & _formless(c, prefixes)
    return F.when(done, F.trim(F.lower(c))).otherwise(_norm(strip_form_prefix(strip(c), prefixes)))


def block_key(c: Column, prefixes: list[str] = K.FORM_PREFIXES_SHORT) -> Column:
    return F.substring(strip_form_prefix(norm(c), prefixes), 1, K.BLOCK_LENGTH)


def dose_number(c: Column) -> Column:
    """Digits and dots of the first number standing before a unit, '' if there is none."""
    return F.regexp_extract(c, K.DOSE_PATTERN, 1)


def number_value(number: Column) -> Column:
    """The value of digits and dots; an unreadable number gives null, without the cost of a failed cast."""
    one = (number != "") & (F.length(F.translate(number, "0123456789", "")) <= 1)
    return F.when(one, number.try_cast("double"))


def dose_value(c: Column) -> Column:
    """First number standing before a unit; an unreadable number gives null."""
    return number_value(dose_number(c))


def unit_text(c: Column) -> Column:
    """The unit of that number, '' if there is none."""
    return F.lower(F.regexp_extract(c, K.DOSE_PATTERN, 2))


def dose_unit(c: Column) -> Column:
    return F.nullif(unit_text(c), F.lit(""))


def quantity(c: Column) -> Column:
    # '' is not cast: a cast that fails costs more than the pattern.
    return F.nullif(F.regexp_extract(c, K.QUANTITY_PATTERN, 1), F.lit("")).try_cast("int")


def confidence(c: Column) -> Column:
    label = F.lower(c)
    out = F.lit(K.DEFAULT_CONFIDENCE)
    for name, value in reversed(list(K.CONFIDENCE_LABELS.items())):
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def title(c: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest."""
    padded = F.regexp_replace(F.lower(c), r"(\p{L}+|\P{L}+)", "$1\u0000")
    pieces = F.split(padded, "\u0000")
    return F.array_join(
        F.transform(
            pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))
        ),
        "",
    )


def aliases(brand: Column, extras: Column) -> Column:
    """Look-up aliases of a brand: without its trailing dose, plus given extras, brand left out."""
    low = F.lower(brand)
    short = F.trim(F.regexp_replace(low, K.TRAILING_DOSE_PATTERN, ""))
    generated = F.filter(F.array(short), lambda a: a != "")
    given = F.transform(F.coalesce(extras, F.array().cast("array<string>")), F.lower)
    return F.array_sort(F.array_remove(F.array_union(generated, given), low))
