"""Text of HTML as column expressions: tags with quoted attributes, raw text, comments and every character reference.

Markup is found in one pass of a pattern with a state for each kind; what it matches becomes a mark, and the text between
two marks is a node. Character references of a node are found by another pattern and looked up in the table of named
ones, which is Python's own (html.entities), not a list here. All of it runs in the JVM.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from rejoinder.functions.text import col, strip

#: Stands for markup; a code point that Unicode keeps out of texts.
MARK = "﷐"
#: What stands inside a tag: quoted values may hold any character.
_INSIDE = r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+"""
MARKUP = "(?is)" + "|".join([
    r"<!--(?:-?>|.*?(?:--!?>|\z))",  # a comment, to the end of the text if it isn't closed
    rf"<(script|style)(?=[\s/>]){_INSIDE}>.*?(?:</\1(?=[\s/>])[^>]*>|\z)",  # raw text
    rf"</?[a-z]{_INSIDE}>",
    r"</?[a-z][^>]*>",  # a tag with a quote that isn't closed ends at the first >
    r"<[!?][^>]*>|</[^>]*>",
    r"<(?:[a-z!?]|/[a-z])[^>]*\z",  # cut off
])
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that count without their semicolon, also at the begin of a longer word.
SHORT = {k: v for k, v in html5.items() if not k.endswith(";")}


def _table(names: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _number(ref: Column) -> Column:
    """The character of #123 or #x7B. Those of 128 to 159 mean Windows-1252's, invalid ones nothing or the mark for unknown."""
    hexa = F.lower(F.substring(ref, 2, 1)) == "x"
    digits = F.ltrim(F.rtrim(F.substr(ref, F.when(hexa, 3).otherwise(2)), F.lit(";")), F.lit("0"))
    small = F.when(F.length(digits) > 0, F.when(hexa, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long")).otherwise(F.lit(0))
    n = F.when(F.length(digits) <= 8, F.least(small, F.lit(0x110000))).otherwise(F.lit(0x110000))
    windows = F.array(*[F.lit(bytes([b]).decode("cp1252", "replace").replace("�", chr(b))) for b in range(128, 160)])
    low16 = n.bitwiseAND(0xFFFF)
    nothing = n.between(1, 8) | n.isin(0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | low16.isin(0xFFFE, 0xFFFF)
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(n.between(128, 159), F.get(windows, (n - 128).cast("int"))).when(nothing, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _named(ref: Column) -> Column:
    """The characters of a name; of one that isn't known, those of the longest known begin and the rest."""
    known = F.element_at(_table(html5), ref)
    begins = F.filter(F.sequence(F.length(ref) - 1, F.lit(2), F.lit(-1)), lambda n: F.element_at(_table(SHORT), F.substr(ref, F.lit(1), n)).isNotNull())
    size = F.when(F.length(ref) > 2, F.get(begins, F.lit(0)))
    part = F.concat(F.element_at(_table(SHORT), F.substr(ref, F.lit(1), size)), F.substr(ref, size + 1))
    return F.coalesce(known, part, F.concat(F.lit("&"), ref))


def _character(ref: Column) -> Column:
    """The common names first: the table is searched for the others only."""
    out = F.when(ref == "amp;", "&").when(ref == "lt;", "<").when(ref == "gt;", ">").when(ref == "quot;", '"').when(ref == "nbsp;", " ")
    return out.when(F.startswith(ref, F.lit("#")), _number(ref)).otherwise(_named(ref))


def unescaped(x: Column) -> Column:
    """Text with its character references resolved, once."""
    pieces, found = F.split(x, REFERENCE, -1), F.regexp_extract_all(x, F.lit(REFERENCE), F.lit(1))
    all_ = F.concat(F.array(F.element_at(pieces, 1)), F.transform(found, lambda r, i: F.concat(_character(r), F.get(pieces, i + 1))))
    return F.when(F.contains(x, F.lit("&")), F.array_join(all_, "")).otherwise(x)


def html_nodes(x: Column | str) -> Column:
    """The text nodes of HTML, stripped, without blank ones, joined by a space. Null gives ''.

    Scripts, styles, comments and declarations have no text; a tag that is cut off at the end is none either.
    """
    nodes = F.split(F.regexp_replace(F.coalesce(col(x), F.lit("")), MARKUP, MARK), MARK, -1)
    return F.array_join(F.filter(F.transform(nodes, lambda n: strip(unescaped(n))), lambda n: n != ""), " ")
