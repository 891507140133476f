"""String expressions: whitespace, HTML text, hashes, display formats."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Unicode calls white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class.
WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# A word never starts right after one of these.
WORD_CHAR = r"\p{L}\p{N}_"
# A tag starts with a letter, so "a < b" stays text.
TAG = r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>"
# Content that is never text.
INVISIBLE = (
    r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<head\b.*?</head>"
)

# The entities html_to_text knows, in the order they are replaced.
PLAIN_ENTITIES = (
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&middot;", " · "),
    ("&rarr;", " -> "),
    ("&ndash;", "-"),
    ("&sect;", "§"),
    ("&ge;", ">="),
)

def _written(value) -> str:
    """A text, number or list of texts as an SQL literal."""
    if isinstance(value, list):
        return f"cast(array({', '.join(map(_written, value))}) as array<string>)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _map_text(table: dict) -> str:
    return f"map({', '.join(_written(x) for pair in table.items() for x in pair)})"


def literal_map(table: dict) -> Column:
    """A constant map from text to text, number or list of texts, as one expression."""
    return F.expr(_map_text(table))


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends (`trim` alone drops blanks only)."""
    return F.trim(col, F.lit(WHITESPACE))


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, WS + "+", " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text, blind to case and to the amount of white space."""
    return F.sha2(squeeze(F.lower(text)), 256)


def _standard_names(closed: bool) -> dict[str, str]:
    """Entity names of the HTML standard: those written with a semicolon, or those that need none."""
    return {n.rstrip(";"): c for n, c in html.entities.html5.items() if n.endswith(";") == closed}


def _constant_map(table: dict[str, str]) -> str:
    """A map as one text literal, which is quicker to parse than thousands of them."""
    return f"str_to_map({_written(chr(1).join(n + chr(2) + c for n, c in table.items()))}, '\\u0001', '\\u0002')"


# Decoding is written as SQL text: it is part of every piece of markup read, and one
# parsed expression is much quicker to build than some hundred column calls.
# Numbers that the standard reads as a character of windows-1252, or as none.
_WINDOWS = {str(b): bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (129, 141, 143, 144, 157)}
_NO_CHARACTER = """q BETWEEN 1 AND 8 OR q = 11 OR q BETWEEN 14 AND 31 OR q = 127 OR q BETWEEN 64976 AND 65007
    OR q % 65536 >= 65534"""
_LEGACY = "|".join(sorted(_standard_names(False), key=lambda n: (-len(n), n)))
# Number of the reference m, "#337" or "#x151", with any number of leading zeros.
_NUMBER = """CASE WHEN lower(substring(m, 2, 1)) = 'x'
    THEN if(length(z) > 6, 1114112, CAST(conv(if(z = '', '0', z), 16, 10) AS bigint))
    ELSE if(length(z) > 7, 1114112, CAST(if(z = '', '0', z) AS bigint)) END"""
_NUMBERED = f"""element_at(transform(array(regexp_replace(m, '^#[xX]?0*', '')), z ->
    element_at(transform(array({_NUMBER}), q -> CASE
        WHEN q = 0 OR q > 1114111 OR q BETWEEN 55296 AND 57343 THEN '\\uFFFD'
        WHEN q BETWEEN 128 AND 159 THEN coalesce(try_element_at({_constant_map(_WINDOWS)}, CAST(q AS string)), chr(CAST(q AS int)))
        WHEN {_NO_CHARACTER} THEN ''
        ELSE decode(unhex(lpad(hex(q), 8, '0')), 'UTF-32') END), 1)), 1)"""
# Piece p after an ampersand: m is a number or what may be a name, l the legacy name it begins with.
_DECODED_PIECE = f"""(p, i) -> CASE WHEN i = 0 THEN p ELSE
    element_at(transform(array(regexp_extract(p, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)', 1)), m -> CASE
        WHEN m LIKE '#%' THEN concat({_NUMBERED}, substring(p, length(m) + if(substring(p, length(m) + 1, 1) = ';', 2, 1)))
        WHEN m = '' THEN concat('&', p)
        ELSE element_at(transform(array(if(substring(p, length(m) + 1, 1) = ';',
            try_element_at({_constant_map(_standard_names(True))}, m), NULL)), c -> CASE
            WHEN c IS NOT NULL THEN concat(c, substring(p, length(m) + 2))
            ELSE element_at(transform(array(regexp_extract(m, '^({_LEGACY})', 1)), l -> CASE
                WHEN l = '' THEN concat('&', p)
                ELSE concat(try_element_at({_constant_map(_standard_names(False))}, l), substring(p, length(l) + 1)) END), 1)
            END), 1) END), 1) END"""
_NODE = f"""t -> trim(BOTH {_written(WHITESPACE)} FROM
    CASE WHEN contains(t, '&') THEN array_join(transform(split(t, '&'), {_DECODED_PIECE}), '') ELSE t END)"""


def decode_entities(text: Column) -> Column:
    """Decode character references by the HTML standard, each once: numbers, all names, and the old names
    without a semicolon; what is none stays as written."""
    pieces = F.call_function("transform", F.split(text, "&"), F.expr(_DECODED_PIECE))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def node_text(markup: Column) -> Column:
    """Text of a piece of markup: each text between tags stripped, joined by one blank."""
    texts = F.call_function("transform", F.split(markup, TAG), F.expr(_NODE))
    return F.array_join(F.array_remove(texts, ""), " ")


def html_to_text(html: Column) -> Column:
    """Readable text of a whole HTML body, line breaks kept."""
    out = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</p>|</div>|</li>|</h\d>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in PLAIN_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n[ \t]+", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


# -- display formats ---------------------------------------------------------

NO_TOPICS = "(nincs)"
LABEL_PREFIX = "Magyar Közlöny"


def score_text(score: Column) -> Column:
    return F.format_number(score, 2)


def topics_text(topics: Column) -> Column:
    joined = F.array_join(topics, ", ")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit(NO_TOPICS)).otherwise(joined)


def label_text(issue_number: Column) -> Column:
    """The publication's name in front of the number, once."""
    return F.when(F.startswith(issue_number, F.lit(LABEL_PREFIX)), issue_number).otherwise(
        F.concat(F.lit(LABEL_PREFIX + " "), issue_number))


def short_summary(summary: Column, width: int = 60) -> Column:
    return F.substring(F.coalesce(summary, F.lit("")), 1, width)


def escape_html(text: Column) -> Column:
    # The characters HTML escapes, ampersand first.
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


# -- landed bytes ------------------------------------------------------------

# Charsets Spark decodes itself.
NATIVE_CHARSETS = {
    "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}
# Single-byte charsets decoded by a table, with the aliases seen in headers.
SINGLE_BYTE = {
    "iso-8859-1": ("iso-8859-1", "latin-1", "latin1", "us-ascii", "ascii"),
    "iso-8859-2": ("iso-8859-2", "latin-2", "latin2"),
    "windows-1250": ("windows-1250", "cp1250"),
    "windows-1252": ("windows-1252", "cp1252"),
}


def high_half(charset: str) -> str:
    """The characters of bytes 0x80..0xFF of a single-byte charset."""
    return bytes(range(0x80, 0x100)).decode(charset, errors="replace")


def decode_bytes(content: Column, charset: Column) -> Column:
    """Text of landed bytes by declared charset; no charset means ISO-8859-1.

    A single-byte charset is read as ISO-8859-1 (byte = code point) and its upper
    half mapped, which needs no session setting. Invalid UTF-8 becomes U+FFFD.
    """
    name = F.lower(F.coalesce(charset, F.lit("iso-8859-1")))
    raw = F.decode(content, "ISO-8859-1")
    out = F.when(F.lit(False), F.lit(""))
    for canonical, aliases in SINGLE_BYTE.items():
        text = raw if canonical == "iso-8859-1" else F.translate(
            raw, high_half("iso-8859-1"), high_half(canonical))
        out = out.when(name.isin(*aliases), text)
    for alias, native in NATIVE_CHARSETS.items():
        out = out.when(name == alias, F.decode(content, native))
    return out.otherwise(F.make_valid_utf8(content.cast("string")))


def encode_single_byte(text: Column, charset: str) -> Column:
    """Bytes of a text in a single-byte charset, "?" for what it cannot hold."""
    high = high_half(charset)
    safe = F.regexp_replace(text, "[^\\x00-\\x7f" + high[0x20:] + "]", "?")
    return F.encode(F.translate(safe, high[0x20:], high_half("iso-8859-1")[0x20:]), "ISO-8859-1")


# -- list columns at the edges -----------------------------------------------

def list_to_json(items: Column) -> Column:
    """JSON text of a string list, ", " between elements, non-ASCII kept."""
    element = F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[|\]$", ""))
    return F.concat(F.lit("["), F.array_join(element, ", ", "null"), F.lit("]"))


def json_to_list(text: Column) -> Column:
    return F.from_json(text, "array<string>")
