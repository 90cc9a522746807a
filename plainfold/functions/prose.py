"""Reflow of plain prose as Spark columns: a few regular-expression replacements, all within whole-stage code.

Plain prose is text in which no byte means anything to Markdown (``is_plain``), so that only white space and
punctuation decide. Everything here is a function of one row, hence needs no shuffle and works on streams too.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plainfold.options import Options

#: Stands for a newline that must stay (of a blank line, or at either end of a text) while lines are joined.
KEPT = "\x01"

MARKED = r"[`*_\[\]<>&${}\\~|#=+@\x00-\x09\x0b-\x1f]|://|www\.|:::"
WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACED_LINE = r"(^|\n) |  "
MARKER_TOKEN = r"(^|[ \n])([-:]*-[-:]*|[0-9]{1,9}[.)])([ \n]|$)"
IMPORT_LINE = r"(^|\n)(import|export)([^0-9A-Za-z_]|$)"
ADMONITION_LINE = r"(^|\n)(!!!|\?\?\?)"

#: For speed: MARKED without its literals, WIDE_SPACE with a look at the range first, and how a MARKER_TOKEN ends.
_MARKED_CHAR = MARKED.partition("|://")[0]
_WIDE_CHAR = rf"[\x{{80}}-\x{{ffff}}&&{WIDE_SPACE}]"
_MARKER_END = r"[-0-9](?:(?<=-)[-:]*|(?<=[0-9])[.)])(?:[ \n]|$)"

STARTER = r"[\"'“‘(\[\p{Lu}\p{Nd}]"


def _any(found) -> Column:
    return reduce(Column.__or__, found)


def is_plain(text: Column, dialect: str = "gfm") -> Column:
    """Whether a text needs no Markdown kernel. Null is not plain; nor are double spaces, which would have to be kept.

    The same as none of the patterns above being found. Literals are looked for as bytes, and what takes long only where
    something short that it needs is found."""
    line = lambda *words: _any(x for w in words for x in (text.startswith(w), text.contains("\n" + w)))
    bad = _any([
        line(" "), *map(text.contains, ("  ", "://", "www.", ":::")), text.rlike(_MARKED_CHAR), text.rlike(_WIDE_CHAR),
        text.rlike(_MARKER_END) & text.rlike(MARKER_TOKEN), line("import", "export") & text.rlike(IMPORT_LINE),
    ])
    if dialect == "mkdocs":
        bad = bad | line("!!!", "???")
    return F.coalesce(~bad, F.lit(False))


def joined(text: Column) -> Column:
    """Each paragraph of a plain text on one line; newlines that stay are KEPT. No blank stands beside another one in it."""
    marked = F.replace(F.replace(text, F.lit("\n\n"), F.lit(KEPT * 2)), F.lit(f"{KEPT}\n"), F.lit(KEPT * 2))
    marked = F.regexp_replace(marked, r"\A\n|\n\z", KEPT)
    return F.replace(F.replace(marked, F.lit(" \n"), F.lit(" ")), F.lit("\n"), F.lit(" "))


def restored(text: Column) -> Column:
    return F.replace(text, F.lit(KEPT), F.lit("\n"))


def split_sentences(line: Column, abbreviations=None) -> Column:
    """A newline for the blank between sentences of a joined line. A sentence doesn't end in an abbreviation or a lone initial."""
    words = "|".join(re.escape(a.lower()) for a in sorted(Options().abbreviations if abbreviations is None else abbreviations))
    held = rf"(?<!(?:^|[ \n{KEPT}])(?:(?i:{words})|\p{{Lu}}\.))" if words else rf"(?<!(?:^|[ \n{KEPT}])\p{{Lu}}\.)"
    ended = F.regexp_replace(line, rf"[!.?…][\"')’”\]]*{held}(?= {STARTER})", "$0\n")  # no group: most places are passed over
    return F.replace(ended, F.lit("\n "), F.lit("\n"))


def _tidied(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, r"\n+", "\n"), rf"\n(?={KEPT}|\z)", "")


def wrapped(line: Column, width: int) -> Column:
    """Greedy lines of at most width characters; a longer word stands alone."""
    return _tidied(F.regexp_replace(line, rf"([^{KEPT}\n]{{1,{width}}}|[^ {KEPT}\n]+)(?: |(?=[{KEPT}\n])|\z)", "$1\n"))


def wrapped_at_clauses(line: Column, width: int) -> Column:
    """Lines longer than width are cut after the last comma or semicolon that fits, else at the last space that does."""
    rest, clause, word = rf"[^{KEPT}\n]{{1,{width}}}(?=[{KEPT}\n]|\z)", rf"[^{KEPT}\n]{{0,{width - 1}}}[,;](?= )", rf"[^{KEPT}\n]{{1,{width}}}(?= )"
    return _tidied(F.regexp_replace(line, rf"({rest}|{clause}|{word}|[^ {KEPT}\n]+)(?: |(?=[{KEPT}\n])|\z)", "$1\n"))


def reflowed(text: Column, options: Options = Options()) -> Column:
    """A plain text, reflowed. Null gives null."""
    line = joined(text)
    if options.mode == "wrap":
        line = wrapped(line, options.width)
    elif options.mode == "sentence":
        line = split_sentences(line, options.abbreviations)
        if options.width:
            line = wrapped_at_clauses(line, options.width)
    return restored(line)


def normalised_html(html: Column) -> Column:
    """HTML up to white space and the spelling of line breaks, to compare renderings."""
    out = F.regexp_replace(html, r"[\t\n\f\r ]+", " ")
    out = F.regexp_replace(out, r"(?i)<br *\/?>", "<br>")
    return F.regexp_replace(F.replace(out, F.lit(" <br>"), F.lit("<br>")), r"^ | $", "")


def has_control(text: Column) -> Column:
    return text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def canonical_width(text: Column) -> Column:
    """Characters, a run of spaces, tabs and returns counted as one."""
    return F.char_length(F.regexp_replace(text, r"[ \t\r]+", " ")).cast("long")


def front_matter_lines(text: Column) -> Column:
    """Lines up to and with the closing rule of a front matter, 0 without one. Only a return may follow the dashes."""
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)
    end = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "---")
    return F.when((F.size(lines) > 1) & (lines[0] == "---") & (end > 0), end + 1).otherwise(0).cast("long")
