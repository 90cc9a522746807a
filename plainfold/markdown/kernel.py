"""Reflow of one Markdown text, without Spark."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from functools import lru_cache

from plainfold.functions.rules import DIALECT_RULES
from plainfold.markdown import blocks as B
from plainfold.markdown import inline as I
from plainfold.markdown import render
from plainfold.options import Options

_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RULES = [(name, re.compile(p, re.A), kind, quoted) for name, p, kind, quoted in DIALECT_RULES]
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
_LABEL = r"(?:[^\\\[\]^]|\\.)(?:[^\\\[\]]|\\.)*"
_SHAPE = re.compile(rf"\\?\[(?:{_LABEL}|\^(?:[\t ](?:[^\\\[\]]|\\.)*)?)?\]:")
_MARKERS = r"[>\t ]*(?:(?:[0-9]{1,9}[).]|[*+-])[\t ]+[>\t ]*)*"
_CHAIN = re.compile("^" + _MARKERS + _SHAPE.pattern)
_FOOTNOTE = re.compile(r"^\\?\[\^[^\]\s][^\]]*\]:")
_BARE_CARET = re.compile(r"\\?\[\^[^\]\s][^\]]*\]:[ \t\r]*$")
_ORPHAN = re.compile(r"^(?:[^\\\[\]]|\\.)*\]:")
_ADMONITION_HEAD = re.compile(r"(?:!!!|\?\?\?\+?)[ \t]+\S")
_CHECKBOX = re.compile(r"\[[ \txX]\][ \t\r]*")
_ADMONITION = re.compile(r"^(?:!!!|\?\?\?\+?)")
_ALERTS = "|".join(("CAUTION", "WARNING", "NOTE", "IMPORTANT", "TIP"))
_MARKER_START = re.compile(r"[\t ]*(?:" + "|".join(map(re.escape, ("$$", "+++", ":::", "{{%", "{{<"))) + rf"|\[!(?:{_ALERTS})\]|\{{[^}}{{]*\}})")
_MAILBOX = "[0-9a-z" + re.escape("-!#$%&'*+./=?^_`{|}~") + "]+"
_HOST = r"[0-9a-z-]+(?:\.[0-9a-z-]+)+"
_LINK_START = re.compile(rf"www\.|[a-z][0-9a-z.+-]*://|{_MAILBOX}@{_HOST}", re.I | re.A)
_BREAK_TAG = re.compile(r"[\r\t ]*<br(?:[\t ]*/)?>[\r\t ]*$", re.I | re.A)
_END_TAG = re.compile(r"<br[\t ]*/?>[\t\r ]*$", re.I | re.A)
_SENTENCE_END = re.compile("[!.?…]+['\")’”\\]]*(?=[\t\r ])")
_RUN = re.compile(r"[ \t\r]+")
_BLANKS = re.compile(r"\r*[ \t][ \t\r]*")
_EACH_BLANK = re.compile(r"[\t\r\n]")
_FENCE_RUN = re.compile(r"`{3,}|~{3,}")
_CLAUSE = re.compile(r"[,;](?=[ \t\r])")
_ENTITY = re.compile(r"&#?[A-Za-z0-9]+;")
_WIDE = re.compile(r"[ \t\r]{2,}")
_FENCE_START = re.compile(r"[`~]*")
_ORDERED = re.compile(r"([0-9]{1,9})([.)])([ \t\n\f\r]|$)")
_TRIGGER = re.compile(rf"#{{1,6}}([ \t\n\f\r]|$)|>|[-*+]([ \t\n\f\r]|$)|<[!?]|{B.BLOCK_TAG.pattern}", re.I | re.A)
_LONE_TAG = re.compile(r"<(?:/ *)?[a-zA-Z][-0-9a-zA-Z]*(?: [^\t<>]*)?/?> *$")
_BARE_DEF = re.compile(r"[\t ]{0,3}\[[^\]\[]*\]:[\t\v\f\r ]*$")
_QUOTES = re.compile(r"(?:[\t ]{,3}>[\t ]?)+")
_LIST_MARK = re.compile(r"(?:\+|[0-9]{1,9}[).])[\t ]")


def _odd_tail(text: str) -> int:
    return len(text) - len(text.rstrip("\\"))


# --- selection ---------------------------------------------------------------------------------------------------


def front_matter_end(lines: list[str]) -> int:
    if lines and lines[0].rstrip("\r") == "---":
        for n, line in enumerate(lines[1:], 1):
            if line.rstrip("\r") == "---":
                return n + 1
    return 0


def _facts(lines: list[str]):
    """For each line: whether a definition may begin on it, and whether one may on an earlier line of its run."""
    own, above, seen = [], [], False
    for line in lines:
        fact = "]:" in line and bool(_CHAIN.search(line) or _ORPHAN.search(line) or _BARE_CARET.search(line) or B.definition(re.sub("^" + _MARKERS, "", line)))
        if line.strip(" \t\r") == "":
            seen = fact = False
        above.append(seen)
        own.append(fact)
        seen = seen or fact
    return own, above


def _unclosed(lines: list[str]) -> bool:
    if not any("[" in x for x in lines):
        return False
    depth = 0
    for n, line in enumerate(lines):
        for c in line:
            depth = depth + 1 if c == "[" else max(0, depth - 1) if c == "]" else depth
        if depth and n < len(lines) - 1:
            return True
    return depth > 0


def _open_target(lines: list[str]) -> bool:
    if not any("](" in x for x in lines):
        return False
    stack: list[bool] = []
    for n, line in enumerate(lines):
        for j, c in enumerate(line):
            if c == "(":
                stack.append(j > 0 and line[j - 1] == "]")
            elif c == ")" and stack:
                stack.pop()
        if n < len(lines) - 1 and any(stack):
            return True
    return any(">" not in m.group(1) for line in lines for m in re.finditer(r"\]\([ \t]*(<.*)$", line))


def _masked(lines: list[str]) -> list[str]:
    if not any("`" in x for x in lines):
        return lines
    text = list("\n".join(lines))
    for a, b in I.code_spans("".join(text)):
        for k in range(a, b):
            if text[k] not in "`\n":
                text[k] = "x"
    return "".join(text).split("\n")


def _reached(before: str, first: str) -> bool:
    """Whether a label that begins on the line before a paragraph closes in it, or may begin a definition above it."""
    if "[" not in before:
        return False
    found = _SHAPE.finditer(before + "\n" + first)
    return any(m.end() > len(before) or not before[: m.start()].strip(" \t>+*.)0123456789-") for m in found)


def _frozen(block: B.Block, lines: list[str], own, above, defs: list[B.Block]) -> str | None:
    """Why a paragraph stays as it is, in order of precedence."""
    if block.depth > 2:
        return "deep-nesting"
    texts = [lines[n][o:].strip(_SPACE) for n, o in block.lines]
    if any(not t for t in texts):
        return "degenerate-blank"
    for _, p, kind, quoted in _RULES:
        if kind != "line" and (block.in_quote or not quoted):
            hits = [bool(p.search(t)) for t in texts]
            if any(hits) if kind == "any" else all(hits):
                return "dialect-block"
    numbers = [n for n, _ in block.lines]
    if any(b - a > 1 for a, b in zip(numbers, numbers[1:])):
        return "hidden-line-gap"
    if any(set(numbers) & {n for n, _ in d.lines} for d in defs):
        return "duplicate-def-line"
    raw = "\n".join(lines[n][o:] for n, o in block.lines)
    if _CONTROL.search(raw):
        return "control-bytes"
    if "]:" in raw and any(_SHAPE.search(t) or _BARE_CARET.search(t) or _ORPHAN.search(t) for t in texts):
        return "link-ref-def-shape"
    first = numbers[0]
    if above[first] or first and (own[first - 1] or _reached(lines[first - 1].rstrip("\r"), texts[0])):
        return "link-ref-def-neighbor"
    masked = _masked(texts)
    if any("<?" in t or "<!" in t for t in masked):
        return "raw-html-decl-opener"
    if _unclosed(masked) and "]:" in "\n".join(texts) or _open_target(masked):
        return "possible-link-ref-def"
    if re.match(r"<[A-Za-z]", texts[0]) and ">" not in texts[0]:
        return "unterminated-tag"
    if block.previous == "table" and not block.blank_before:
        return "table-adjacency"
    return None


def _boundary(text: str, in_quote: bool, dialect: str, first: bool) -> bool:
    t = text.strip(_SPACE)
    if t[:1] not in ":{[!?":
        return False
    return any(kind == "line" and (in_quote or not quoted) and p.search(t) for _, p, kind, quoted in _RULES) or dialect == "mkdocs" and first and bool(_ADMONITION.match(t))


def _following(prefix: str, first_text: str, dialect: str) -> str:
    """What stands before each line after the first: quote marks stay, all else is room."""
    out = ""
    for c in prefix:
        out += ">" if c == ">" else " " * (4 - len(out) % 4) if c == "\t" else " "
    if _FOOTNOTE.match(first_text):
        out += "    "
    elif dialect == "mkdocs" and re.match(r"(?:!!!|\?\?\?\+?)[\t ]+\S", first_text):
        out += "    "
    return out


# --- escapes -----------------------------------------------------------------------------------------------------


def _is_rule(line: str) -> bool:
    t = line.replace(" ", "").replace("\t", "").replace("\r", "")
    return len(t) >= 3 and t[0] in "-*_" and set(t) == {t[0]} and len(line) - len(line.lstrip(" ")) <= 3


def _fence(line: str) -> int:
    m = re.match(r"`{3,}|~{3,}", line)
    return len(m.group()) if m and (line[0] == "~" or "`" not in line[m.end() :]) else 0


def _unfenced(line: str) -> str:
    k = _fence(line)
    return ("&#96;" if line[:1] == "`" else "\\~") * k + line[k:] if k else line


def escaped(line: str, first: bool = True, prefix: str = "", after_text: bool = True) -> str:
    """The line with a backslash before whatever would begin a block where it stands."""
    if line[:1].isalpha():
        return line
    if m := _ORDERED.match(line):
        return m.group(1) + "\\" + line[m.end(1) :]
    if _fence(line):
        return _unfenced(line)
    indent = len(line) - len(line.lstrip(" "))
    put = line[:indent] + "\\" + line[indent:]
    if _is_rule(line) or first and prefix and _is_rule(prefix + line):
        return put
    if re.fullmatch(r" {0,3}=+[ \t\r]*", line) or _TRIGGER.match(line):
        return put
    d = B.definition(line)
    if d and d[1] >= len(line) or _BARE_DEF.match(line):
        return put
    if after_text and line and B._DELIMITERS.match(line.lstrip(" ")) and "-" in line:
        return put
    if first and _LONE_TAG.match(line):
        return put
    return line


# --- breaks ------------------------------------------------------------------------------------------------------


def _starts(c: str) -> bool:
    return c in "\"'“‘([" or unicodedata.category(c) in ("Lu", "Nd")


def sentence_breaks(text: str, abbreviations) -> list[tuple[int, int]]:
    """White space between sentences."""
    out, opens = [], None
    spaced = _EACH_BLANK.sub(" ", text)  # of the same length
    for m in _SENTENCE_END.finditer(text):
        end = m.end()
        after = _RUN.match(text, end).end()
        if after >= len(text):
            continue
        c = text[after]
        if c == "\\" and after + 1 < len(text) and text[after + 1] in I.PUNCT:
            c = text[after + 1] if after + 1 < len(text) else " "
            at = None
        else:
            at = after
        if not _starts(c):
            if at is None or c not in "`*_":
                continue
            opens = I.openers(text) if opens is None else opens
            if at not in opens:
                continue
        begin = spaced.rfind(" ", 0, end) + 1
        word = text[begin:end]
        if word.lower() in abbreviations or len(word) == 2 and word[1] == "." and unicodedata.category(word[0]) == "Lu":
            continue
        out.append((end, after))
    return out


def _hazard(text: str, at: int) -> bool:
    """Whether no line may begin at ``at``."""
    if text[at : at + 1] in "$+:{[`~\t " and (_MARKER_START.match(text, at) or _FENCE_RUN.match(text, at)):
        return True
    return text[at - 1] != " " and bool(_LINK_START.match(text, at))


def _cuttable(breaks, held, text: str, line_end: bool):
    """Breaks where a line may end and one begin; breaks and held spans are both in order."""
    out, k = [], 0
    for a, b in breaks:
        while k < len(held) and held[k][1] <= a:
            k += 1
        if k < len(held) and held[k][0] < b or _hazard(text, b):
            continue
        if line_end and (text[a - 1] in "\r\\>" if a else False):
            before = text[max(0, a - 64) : a]
            if before[-1] == "\r" or _odd_tail(before) == 1 or _END_TAG.search(before):
                continue
        out.append((a, b))
    return out


class _Widths:
    """Widths of stretches of one text, a run of blanks counted as one character: one pass, then subtractions.

    What may not be cut is told from the whole text, also for a stretch of it, so that every pass measures alike."""

    def __init__(self, text: str, held: list[tuple[int, int]]):
        self.text, self.runs, saved, k = text, [], 0, 0
        self.before = [0]  # characters saved before each run, and by all of them
        for m in _WIDE.finditer(text):
            a, b = m.span()
            while k < len(held) and held[k][1] <= a:
                k += 1
            if not (k < len(held) and held[k][0] <= a) and m.group().strip("\r"):
                saved += b - a - 1
                self.runs.append(a)
                self.before.append(saved)

    def __call__(self, a: int, b: int) -> int:
        if not self.runs:
            return b - a
        return b - a - self.before[bisect_left(self.runs, b)] + self.before[bisect_left(self.runs, a)]

    def _shown(self, a: int, b: int) -> str:
        out, at = [], a
        for k in range(bisect_left(self.runs, a), bisect_left(self.runs, b)):
            run = self.runs[k]
            out += self.text[at:run], " "
            at = run + 1 + self.before[k + 1] - self.before[k]
        return "".join(out) + self.text[at:b]

    def fits(self, a: int, b: int, width: int) -> bool:
        """Whether a line of this stretch fits, with whatever its start makes it escape."""
        w = self(a, b)
        if w > width:
            return False
        m = _FENCE_START.match(self.text, a)
        most = max(1, sum(4 if c == "`" else 1 for c in m.group()))
        return w + most <= width or len(escaped(self._shown(a, b))) <= width

    def last(self, cuts: list[tuple[int, int]], start: int, width: int) -> tuple[int, int] | None:
        """The last cut after ``start`` that leaves a line that fits."""
        first = bisect_right(cuts, (start, len(self.text)))
        k = bisect_right(cuts, width, first, key=lambda x: self(start, x[0])) - 1
        while k >= first and not self.fits(start, cuts[k][0], width):
            k -= 1  # only lines that an escape makes too long come here
        return cuts[k] if k >= first else None


def _ranked(text: str, held, first, second, width: int) -> list[str]:
    """Each line ends at the last first-class cut that fits, else the last second-class one, else the next of any."""
    out, start, n, widths = [], 0, len(text), _Widths(text, held)
    while start < n and not widths.fits(start, n, width):
        cut = widths.last(first, start, width) or widths.last(second, start, width)
        if cut is None:
            later = [found[k] for found in (first, second) if (k := bisect_right(found, (start, n))) < len(found)]
            if not later:
                break
            cut = min(later)
        out.append(text[start : cut[0]])
        start = cut[1]
    if text[start:]:
        out.append(text[start:])
    return out


def _clause(text: str, at: int) -> bool:
    """Whether a clause ends before ``at``: a comma, or a semicolon that is not an entity's."""
    return text[at - 1] == "," or text[at - 1] == ";" and not _ENTITY.fullmatch(text, max(0, text.rfind("&", max(0, at - 64), at)), at)


def _lines_of(text: str, options: Options) -> list[str]:
    if options.mode == "para":
        return [text]
    held = I.no_break_spans(text)
    if options.mode == "wrap":
        return _ranked(text, held, _cuttable(list(map(re.Match.span, _BLANKS.finditer(text))), held, text, True), [], options.width)
    found = options.segmenter(text) if options.segmenter else sentence_breaks(text, set(options.abbreviations))
    pieces, at = [], 0
    for a, b in _cuttable(found, held, text, False):
        pieces.append(text[at:a])
        at = b
    pieces.append(text[at:])
    if not options.width:
        return pieces
    out = []
    for s in pieces:
        held = I.no_break_spans(s)
        if _Widths(s, held).fits(0, len(s), options.width):
            out.append(s)
            continue
        words = _cuttable(list(map(re.Match.span, _BLANKS.finditer(s))), held, s, True)
        out += _ranked(s, held, [x for x in words if _clause(s, x[0])], words, options.width)
    return out


# --- paragraphs --------------------------------------------------------------------------------------------------


def _marker(line: str, has_next: bool, in_code: bool, dialect: str) -> tuple[str, str]:
    """A line without its hard break, and how the break is written."""
    if in_code:
        return line, ""
    if ">" in line[-64:] and (m := _BREAK_TAG.search(line)) and not (m.start() and line[: line.lower().rfind("<br")].endswith("\\")):
        return line[: m.start()], "<br>"
    if has_next and line.endswith("\\") and _odd_tail(line) == 1:
        return line[:-1].rstrip(" \t\r"), "\\"
    bare = line.rstrip("\r")
    if has_next and bare.endswith("  "):
        return bare.rstrip(" \t"), "\\" if dialect == "gfm" else "  "
    return line, ""


def _attached(text: str, marker: str) -> str:
    tail = _odd_tail(text)
    if marker == "\\" and tail:
        return text + "  " if tail % 2 == 0 else text + " \\"
    return text + marker


def _folded(text: str) -> bool:
    """Whether a line has several returns at its end, and they alone keep what stands before them from breaking it."""
    bare = text.rstrip("\r")
    return len(text) - len(bare) > 1 and (_odd_tail(bare) == 1 or bare.endswith("  "))


def _paragraph(block: B.Block, lines: list[str], options: Options, literal: bool = False) -> list[str] | None:
    """New lines of a paragraph, with what stands before them; None to leave it, as where ``literal`` text needs an escape."""
    texts = [lines[n][o:] for n, o in block.lines]
    if any(map(_folded, texts)):
        return None
    prefix = lines[block.lines[0][0]][: block.lines[0][1]]
    texts[-1] = texts[-1].rstrip(" \t\r")
    cont = prefix if literal else _following(prefix, texts[0], options.dialect)
    stripped = [t.rstrip("\r") for t in texts]
    whole, ends, at = "\n".join(stripped), [], 0
    code = I.code_spans(whole)
    for t in stripped:
        at += len(t)
        ends.append(any(a <= at < b for a, b in code))
        at += 1
    reduced = _LIST_MARK.sub("", _QUOTES.sub("", prefix).lstrip(" \t")).lstrip(" \t")
    out: list[tuple[str, bool]] = []  # text, verbatim
    held: list[str] = []
    protected: list[bool] = []

    def flush(marker: str) -> None:
        if not held:
            return
        text, keep = "", False
        for t, code_after in zip(held, protected):
            left = t if keep else t.lstrip(" \t\r")
            right = left if code_after else left.rstrip(" \t\r")
            if right or keep:
                text = text + (" " if text else "") + right
            keep = code_after
        held.clear()
        protected.clear()
        if not marker:
            text, marker = _marker(text, False, False, options.dialect)
        new = _lines_of(_unfenced(text), options) if text else [""]
        new[-1] = _attached(new[-1], marker)
        out.extend((x, False) for x in new)

    for i, t in enumerate(stripped):
        if _boundary(t, block.in_quote, options.dialect, i == 0):
            flush("")
            n, o = block.lines[i]
            out.append((t if i == 0 else lines[n][:o] + t, True))
            continue
        last = i == len(stripped) - 1
        body, marker = _marker(t, not last, ends[i], options.dialect)
        if marker and i == 0 and block.path[-1:] == ("item",) and not block.previous and _CHECKBOX.fullmatch(t):
            body, marker = t.rstrip(" \t\r"), ""  # a checkbox takes the blanks after it, and the line's end
        if i == 0 and not body.strip() and marker == "<br>" and not last:
            out.append(("<br>", True))
            continue
        held.append(body)
        protected.append(ends[i])
        if marker or last:
            flush(marker)
    result, before = [], True
    for i, (t, verbatim) in enumerate(out):
        line = t if verbatim else escaped(t, i == 0, reduced, before if i else False)
        if literal and line != t:
            return None
        result.append(line if i == 0 or verbatim else cont + line)
        before = bool(t.strip())
    return result


def _definitions(text: str) -> set[str]:
    return {b.text for b in B.scan(text.split("\n")) if b.kind == "def"} if "]:" in text else set()


@lru_cache(maxsize=4)
def _scanned(text: str) -> tuple[list[str], list[str], list[B.Block]]:
    """A text's lines, the same with those of a front matter blank, and the blocks of these. A pass and a rendering share it."""
    lines = text.split("\n")
    start = front_matter_end(lines)
    seen = ["" if n < start else x for n, x in enumerate(lines)] if start else lines
    return lines, seen, B.scan(seen)


def rendered(text: str) -> str:
    """What a text comes out as, up to white space; a front matter is no part of it."""
    _, seen, found = _scanned(text)
    return render.html(seen, found)


def _admonition_body(found: list[B.Block], at: int, lines: list[str]) -> B.Block | None:
    """The indented body of an admonition as a paragraph: one run of lines, all four columns in, below its marker line."""
    b, marker = found[at], found[at - 1] if at else None
    if marker is None or b.previous != "para" or marker.kind != "para" or marker.path != b.path or len(marker.lines) != 1:
        return None
    n, o = marker.lines[0]
    if not _ADMONITION_HEAD.match(lines[n][o:]):
        return None
    body = list(b.lines)
    while body and not lines[body[-1][0]][body[-1][1] :].strip():
        body.pop()
    out = []
    for n, o in body:
        m = re.compile(r" {4}(?=[^ \t\r\n])" if lines[n][:o].strip(" ") or o % 4 else r"(?: {4}|\t)(?=[^ \t\r\n])").match(lines[n], o)
        if not m or _FENCE_RUN.match(lines[n], m.end()) or lines[n][:o].strip(" \t"):
            return None
        out.append((n, m.end()))
    return B.Block("para", out, b.depth, b.path, b.inside, b.in_quote) if out else None


def _pass(text: str, options: Options) -> str:
    lines, _, found = _scanned(text)
    own, above = _facts(lines)
    defs = [b for b in found if b.kind == "def"]
    out, at = [], 0
    for k, b in enumerate(found):
        body = _admonition_body(found, k, lines) if b.kind == "indent" and options.dialect == "mkdocs" else None
        if body is None and (b.kind != "para" or _frozen(b, lines, own, above, defs)):
            continue
        b = body or b
        first, last = b.lines[0][0], b.lines[-1][0]
        new = _paragraph(b, lines, options, body is not None)
        if new is None:
            continue
        tail = lines[last][b.lines[-1][1] :]
        new[0] = lines[first][: b.lines[0][1]] + new[0]
        new[-1] += tail[len(tail.rstrip(" \t\r")) :]
        if not _definitions("\n".join(new)) <= _definitions("\n".join(lines[first : last + 1])):
            continue
        out += lines[at:first] + new
        at = last + 1
    return "\n".join(out + lines[at:])


def reflow(text: str | None, options: Options = Options()) -> str | None:
    """The text reflowed: passes until one changes nothing (at most four), and the source if it would render differently."""
    if text is None:
        return None
    if not options.settle:
        return _pass(text, options)
    now = text
    for _ in range(4):
        new = _pass(now, options)
        if new == now:
            break
        now = new
    else:
        return text
    return now if now == text or not options.render_check or rendered(now) == rendered(text) else text


def explain(text: str | None, options: Options = Options()) -> list[tuple[int, int, str]]:
    """(first line, last line, reason) of paragraphs that stay as they are, 1-based, of the text as given."""
    if text is None:
        return []
    lines, _, found = _scanned(text)
    own, above = _facts(lines)
    defs = [b for b in found if b.kind == "def"]
    reasons = ((b, _frozen(b, lines, own, above, defs)) for b in found if b.kind == "para")
    return [(b.lines[0][0] + 1, b.lines[-1][0] + 1, r) for b, r in reasons if r]
