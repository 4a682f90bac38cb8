"""Text normalization with Unicode whitespace and case folding, and canonical JSON."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as whitespace, as code point ranges.
_WHITESPACE_RANGES = (
    (0x09, 0x0D),
    (0x1C, 0x20),
    (0x85, 0x85),
    (0xA0, 0xA0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(c) for low, high in _WHITESPACE_RANGES for c in range(low, high + 1))
# The same set as the inside of a Java regex character class.
WHITESPACE_CLASS = "".join(f"\\u{low:04x}-\\u{high:04x}" for low, high in _WHITESPACE_RANGES)


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def strip(c: Column) -> Column:
    """Remove whitespace of any script from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def strip_column(c: Column) -> Column:
    """The same as :func:`strip` for a plain column, which is mentioned several times.

    Text that begins and ends with a visible ASCII character is left alone at the cost of
    looking at those two.
    """
    ends = (F.ascii(c), F.ascii(F.substring(c, -1, 1)))
    bare = ends[0].between(0x21, 0x7F) & ends[1].between(0x21, 0x7F)
    return F.when(bare, c).otherwise(strip(c))


def collapse_spaces(c: Column) -> Column:
    """Strip, then turn every whitespace run into one blank."""
    return F.regexp_replace(strip(c), f"[{WHITESPACE_CLASS}]+", " ")


@cache
def _fold_exceptions() -> dict[str, str]:
    """Lower-case characters whose case folding is something else (``ß`` -> ``ss``...)."""
    return {
        ch: ch.casefold()
        for ch in map(chr, range(sys.maxunicode + 1))
        if ch.lower() == ch and ch.casefold() != ch
    }


def casefold(c: Column) -> Column:
    """Full Unicode case folding.

    ASCII text and text without exceptional letters only pays for ``lower``. Pass a plain
    column: the expression mentions its argument several times.
    """
    table = _fold_exceptions()
    folded = _replace_chars(F.lower(c), table)
    exceptional = ~is_ascii(c) & F.lower(c).rlike("[" + "".join(table) + "]")
    return F.when(exceptional, folded).otherwise(F.lower(c))


def fold_key(c: Column) -> Column:
    """Strip and case-fold; null becomes the empty string."""
    return casefold(strip(F.coalesce(c, F.lit(""))))


def optional_text(c: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def _char_map(pairs: dict[str, str]) -> Column:
    """A constant map column; the separators cannot occur in the pairs used here."""
    text = "\ue001".join(f"{key}\ue000{value}" for key, value in pairs.items())
    return F.str_to_map(F.lit(text), F.lit("\ue001"), F.lit("\ue000"))


def _replace_chars(c: Column, pairs: dict[str, str]) -> Column:
    """Replace single characters by texts; one pass, meant for the few rows that need it."""
    mapping = _char_map(pairs)
    return F.array_join(
        F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(mapping, ch), ch)), ""
    )


# JSON escapes; other control characters use lower-case hex.
_JSON_ESCAPES = {
    '"': '\\"',
    "\\": "\\\\",
    "\n": "\\n",
    "\r": "\\r",
    "\t": "\\t",
    "\b": "\\b",
    "\f": "\\f",
}


def json_string(c: Column) -> Column:
    """A JSON string literal with raw UTF-8; control characters in lower-case hex."""
    escapes = {chr(code): f"\\u{code:04x}" for code in range(0x20)} | _JSON_ESCAPES
    body = F.when(c.rlike(r'[\x00-\x1f"\\]'), _replace_chars(c, escapes)).otherwise(c)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))


def json_ascii_string(c: Column) -> Column:
    """A JSON string literal in pure ASCII, using surrogate pairs above U+FFFF."""

    def escape(ch: Column) -> Column:
        code = F.ascii(ch)
        above = code - F.lit(0x10000)
        pair = F.concat(
            _hex4(F.lit(0xD800) + F.shiftright(above, 10)),
            _hex4(F.lit(0xDC00) + above.bitwiseAND(F.lit(0x3FF))),
        )
        return F.when(code < 0x7F, ch).when(code < 0x10000, _hex4(code)).otherwise(pair)

    quoted = json_string(c)
    escaped = F.array_join(F.transform(F.split(quoted, ""), escape), "")
    return F.when(c.rlike(r"[^\x00-\x7e]"), escaped).otherwise(quoted)


def json_object(fields: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys; values are JSON texts already."""
    parts: list[Column] = []
    for position, key in enumerate(sorted(fields)):
        lead = "{" if position == 0 else ","
        parts += [F.lit(f'{lead}"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def json_number(x: Column) -> Column:
    """A value with at most four decimals in [0, 1] as Python prints it (0.0001 -> 0.0001)."""
    text = F.rtrim(F.format_string("%.4f", x))
    trimmed = F.regexp_replace(text, r"0+$", "")
    plain = F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)
    return plain


def sha256_prefixed(prefix: str, canonical: Column, length: int = 24) -> Column:
    """Prefix and the first hex digits of the hash; never null, so joins need no null check."""
    return F.coalesce(
        F.concat(F.lit(prefix), F.substring(F.sha2(canonical, 256), 1, length)), F.lit(prefix)
    )


def title_case(c: Column) -> Column:
    """First letter of every run of letters in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def escape_label(c: Column) -> Column:
    """Escape backslash, newline and quote for a metric label."""
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("\n"), F.lit("\\n"))
    return F.replace(out, F.lit('"'), F.lit('\\"'))


def preview(c: Column, width: int) -> Column:
    """One-line preview cut to ``width`` characters with a trailing ellipsis."""
    line = collapse_spaces(c)
    return F.when(
        F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))
    ).otherwise(line)
