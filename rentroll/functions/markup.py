"""HTML bodies to plain text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rentroll.functions.text import trimmed

# Named character references that bodies commonly carry.
NAMED_REFERENCES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©", "&reg;": "®",
    "&trade;": "™", "&middot;": "·", "&bull;": "•", "&hellip;": "…", "&ndash;": "–",
    "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”",
    "&laquo;": "«", "&raquo;": "»", "&euro;": "€", "&pound;": "£", "&cent;": "¢",
}

# Elements whose edges separate words.
BLOCK_ELEMENTS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
    "h[1-6]|head|header|hr|html|legend|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)

UNSEEN = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
)
BLOCK_TAG = rf"(?i)</?(?:{BLOCK_ELEMENTS})\b[^>]*>"
OTHER_TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
BLANK_RUN = "[ \\t\\n\\f\\r ]+"


def _code_point(part: Column) -> Column:
    """Text after ``&#``: its number becomes a character, anything else gets the mark back."""
    decimal = F.regexp_extract(part, r"^(\d{1,7});", 1)
    hexa = F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,6});", 1)
    digits = F.when(decimal != "", F.hex(decimal.try_cast("bigint"))).when(hexa != "", hexa)
    # code points end at 10FFFF and leave out the surrogate block D800-DFFF
    value = F.conv(digits, 16, 10).try_cast("bigint")
    valid = value.between(1, 0xD7FF) | value.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    return F.when(valid, F.concat(char, F.substr(part, F.instr(part, ";") + 1))).otherwise(
        F.concat(F.lit("&#"), part)
    )


def _numeric_references(c: Column) -> Column:
    parts = F.split(c, "&#")
    decoded = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(_code_point(p)))
    return F.when(c.contains("&#"), F.concat_ws("", decoded)).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Visible words, one space between them; scripts, styles and comments dropped."""
    out = c
    for pattern in UNSEEN:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(out, BLOCK_TAG, " ")
    out = F.regexp_replace(out, OTHER_TAG, "")
    out = _numeric_references(out)
    for name, char in NAMED_REFERENCES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    # the ampersand comes last, so that an escaped reference stays as written
    out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    return trimmed(F.regexp_replace(out, BLANK_RUN, " "))
