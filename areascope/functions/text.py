"""String normalisation expressions (state, district, pincode, display names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import STATE_ALIASES

# (?U) makes \s match Unicode blanks such as NBSP, like Python's str.strip.
_EDGE_BLANKS = r"(?U)^\s+|\s+$"
_INNER_BLANKS = r"(?U)\s+"
# What that pattern finds in ASCII text, besides a single space.
_ASCII_BLANKS = ("  ", "\t", "\n", "\x0b", "\f", "\r")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _squash(c) -> Column:
    """lower -> strip -> collapse runs of blanks to one space.

    Collapsing every (Unicode) blank run to one space first makes the strip a
    plain trim of spaces: one regex per value instead of two. ASCII values
    whose only blanks are single spaces, which nearly all are, need none.
    """
    c = _col(c).cast("string")
    plain = F.octet_length(c) == F.length(c)
    for blank in _ASCII_BLANKS:
        plain = plain & ~c.contains(blank)
    low = F.lower(c)
    return F.trim(F.when(plain, low).otherwise(F.regexp_replace(low, _INNER_BLANKS, " ")))


def strip(c) -> Column:
    """Without blanks at either end, Unicode blanks (tab, NBSP) included."""
    return F.regexp_replace(_col(c), _EDGE_BLANKS, "")


def normalise_state(c) -> Column:
    """Lower, strip, collapse blanks, then ' & ' -> ' and ' and '&' -> 'and'."""
    c = _squash(c)
    c = F.replace(c, F.lit(" & "), F.lit(" and "))
    return F.replace(c, F.lit("&"), F.lit("and"))


def apply_aliases(c, aliases: dict | None = None) -> Column:
    """Whole-value alias lookup, one pass (not chained); unknown values pass through."""
    aliases = STATE_ALIASES if aliases is None else aliases
    if not aliases:
        return _col(c)
    lookup = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, _col(c)), _col(c))


def normalise_district(c, final_trim: bool = False) -> Column:
    """Lower, strip, collapse blanks, delete '*'.

    The original keeps the blank left in front of a removed '*'
    ('Dhalai  *' -> 'dhalai '); ``final_trim=True`` strips it.
    """
    c = F.replace(_squash(c), F.lit("*"), F.lit(""))
    if final_trim:
        c = strip(c)
    return c


def valid_pincode(c) -> Column:
    """Six-digit code: integer value in 100000..999999 (false for null/garbage)."""
    v = _col(c).cast("string").try_cast("int")
    return F.coalesce(v.between(100000, 999999), F.lit(False))


def pincode_region(c) -> Column:
    """Leading digit of a pincode (integer division by 100000)."""
    return F.floor(_col(c).cast("double") / 100000).cast("int")


def title_case(c) -> Column:
    """Python ``str.title``: capital after any non-letter, rest lower case.

    ``initcap`` only capitalises after blanks; splitting into letter / non-letter
    runs and capitalising each run reproduces 'Y.S.R. Kadapa' and 'North-East'.
    """
    runs = F.regexp_extract_all(_col(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                           F.lower(F.substr(r, F.lit(2))))), "")


def whitespace_issue(c) -> Column:
    """Double blank inside or blanks (Unicode ones too) at either end."""
    col = _col(c)
    return col.contains("  ") | (col != strip(col))


def visible_blanks(c) -> Column:
    """Show blanks as a middle dot for reports."""
    return F.replace(_col(c), F.lit(" "), F.lit("·"))
