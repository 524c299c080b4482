"""Text cleaning, join keys, codes, labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

# Three commune names whose spelling differs from the master.
COMMUNE_ALIASES = {"LACALERA": "CALERA", "LLAYLLAY": "LLAILLAY", "PUERTOAYSEN": "AYSEN"}

CODE_WIDTH = 5


def _accent_pairs() -> tuple[str, str]:
    """Precomposed Latin letters whose canonical base is one ASCII letter."""
    accented, plain = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for point in block:
            base = unicodedata.normalize("NFD", chr(point))
            if len(base) > 1 and base[0].isascii():
                accented.append(chr(point))
                plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()


def fold_ascii(c: Column) -> Column:
    """Drop accents, then whatever is still not ASCII."""
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"[^\x00-\x7F]", "")


def clean_text(c: Column) -> Column:
    """Hard spaces and runs of blanks become one space; empty becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)[\s ]+", " ")), F.lit(""))


def alnum_key(c: Column) -> Column:
    """Accent-free upper-case letters and digits only."""
    return F.upper(F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), "[^A-Za-z0-9]+", ""))


def name_key(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """``alnum_key`` with commune aliases applied; empty becomes NULL."""
    key = alnum_key(c)
    out = key
    for alias, name in (COMMUNE_ALIASES if aliases is None else aliases).items():
        out = F.when(key == alias, F.lit(name)).otherwise(out)
    return F.nullif(out, F.lit(""))


def norm_name(c: Column) -> Column:
    """Accent-free upper case with single spaces."""
    return F.trim(F.regexp_replace(F.upper(fold_ascii(c)), r"\s+", " "))


def search_key(c: Column) -> Column:
    return F.lower(fold_ascii(c))


def matches_search(name: Column, typed: str, least: int = 3) -> Column:
    """Accent-insensitive prefix search that needs ``least`` typed letters."""
    if len(typed.strip()) < least:
        return F.lit(False)
    return search_key(name).startswith(search_key(F.lit(typed.strip())))


def zero_pad(c: Column, width: int = CODE_WIDTH) -> Column:
    """Left-pad with zeros without ever truncating (``lpad`` alone would)."""
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def strip_decimal(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\.0$", "")


def repair_code(c: Column, width: int = CODE_WIDTH) -> Column:
    """Trim, drop a trailing ``.0`` and pad; NULL stays NULL."""
    return zero_pad(strip_decimal(c.cast("string")), width)


def code_text(c: Column) -> Column:
    """Numeric code to text without decimals; bad values become NULL."""
    return c.cast("string").try_cast("double").try_cast("bigint").cast("string")


def region_of(code: Column) -> Column:
    return F.substring(code, 1, 2)


def year_of(c: Column) -> Column:
    """First four-digit run as a number."""
    return F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).try_cast("int")


def clip(c: Column, n: int) -> Column:
    """Display label: NULL shows as empty, long text is cut for display."""
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def label_of(c: Column, labels: dict[str, str], missing: str = "sin dato") -> Column:
    """Dictionary label, else the code itself, with its first letter raised."""
    shown = F.coalesce(c, F.lit(missing))
    for code, label in labels.items():
        shown = F.when(c == code, F.lit(label)).otherwise(shown)
    return F.concat(F.upper(F.substring(shown, 1, 1)), F.substr(shown, F.lit(2)))


def ordinal_of(c: Column, order: list[str], unknown: int) -> Column:
    """Position of a code in a custom order."""
    out = F.lit(unknown)
    for i, code in enumerate(order):
        out = F.when(c == code, F.lit(i)).otherwise(out)
    return out


def cl_number(c: Column, decimals: int = 0) -> Column:
    """Chilean number format: dot for thousands, comma for decimals."""
    return F.when(c.isNotNull(), F.translate(F.format_number(c, decimals), ",.", ".,")).otherwise("s/d")


def cl_percent(c: Column, decimals: int = 1) -> Column:
    return F.when(c.isNotNull(), F.concat(cl_number(c, decimals), F.lit(" %"))).otherwise("s/d")
