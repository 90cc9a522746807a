"""Block structure of a Markdown text, as far as reflow needs it: its paragraphs, and what stands around them.

A container stack is carried from line to line, as the specification of CommonMark tells, with tables as an extension.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import count

_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ATX = re.compile(r"#{1,6}(?:[ \t]|$)")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")
_SETEXT = re.compile(r"(?:=+|-+)[ \t\r]*$")
_ITEM = re.compile(r"(?:([-+*])|(\d{1,9})([.)]))(?=[ \t\r]|$)", re.A)
_BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem meta nav noframes ol optgroup option p param search section summary table tbody td tfoot th "
    "thead title tr track ul"
)
BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(_BLOCK_TAGS.split())})(?:[ \t\r]|/?>|$)", re.I)
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:[ \t\r>]|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (BLOCK_TAG, None),
]
_ANY_TAG = re.compile(r"(?:<[a-zA-Z][-0-9a-zA-Z]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[a-zA-Z][-0-9a-zA-Z]*\s*>)[ \t\r]*$", re.A)
_DELIMITERS = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t\r]*$")
_DEF = re.compile(r"[ ]{0,3}\[((?:[^\\\[\]]|\\.)+)\]:[ \t]*\n?[ \t]*(<(?:\\.|[^<>\n\\])*>|[^\s<][^\s]*)(?:(?:[ \t]+|[ \t]*\n[ \t]*)(\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|\((?:\\.|[^()\\])*\)))?[ \t\r]*(?:\n|\Z)", re.S)


@dataclass
class Block:
    kind: str
    lines: list[tuple[int, int]] = field(default_factory=list)  # line number, offset of the content in it
    depth: int = 0
    path: tuple = ()
    inside: tuple = ()  # (number, kind) of each container around it
    in_quote: bool = False
    blank_before: bool = True
    previous: str = ""  # kind of the sibling before
    text: str = ""


def definition(text: str) -> tuple[tuple, int] | None:
    """A link definition at the start of a text: (label, target, title), and where it ends."""
    m = _DEF.match(text)
    if not m or not m.group(1).strip():
        m2 = None
    else:
        m2 = m
    if m2 is None:
        return None
    return (" ".join(m2.group(1).lower().split()), m2.group(2), m2.group(3) or ""), m2.end()


class _Container:
    def __init__(self, kind: str, indent: int = 0, marker: str = "", number: int = 0):
        self.kind, self.indent, self.marker, self.number, self.last, self.blank = kind, indent, marker, number, "", True


def _columns(line: str, at: int, col: int) -> tuple[int, int]:
    """Place and column after white space from ``at`` on."""
    while at < len(line) and line[at] in " \t":
        col += 4 - col % 4 if line[at] == "\t" else 1
        at += 1
    return at, col


def _cells(row: str) -> int:
    row = row.strip().removeprefix("|")
    row = re.sub(r"\\.", "x", row)
    return len(row.removesuffix("|").split("|"))


def scan(lines: list[str]) -> list[Block]:
    """All leaf blocks, in order; lines come without their newlines."""
    root, numbers = _Container("root"), count(1)
    stack, out = [root], []
    leaf: Block | None = None  # open leaf
    ends = None  # what ends an open HTML block or fence
    owner = root

    def close():
        nonlocal leaf
        if leaf is not None and leaf.kind == "para":
            text = "\n".join(lines[n][o:] for n, o in leaf.lines)
            had = False
            while (d := definition(text)) is not None:
                used = text[: d[1]].count("\n") + (0 if text[: d[1]].endswith("\n") else 1)
                if 0 < used <= len(leaf.lines):
                    out.append(Block("def", leaf.lines[:used], leaf.depth, leaf.path, leaf.inside, leaf.in_quote, leaf.blank_before, leaf.previous, text[: d[1]].strip()))
                    leaf.lines, text, had = leaf.lines[used:], text[d[1] :], True
                    leaf.previous, leaf.blank_before = "def", False
                if not leaf.lines:
                    break
            if leaf.lines:
                out.append(leaf)
                owner.last = "para"
            elif had:
                owner.last = "def"
        elif leaf is not None:
            out.append(leaf)
            owner.last = leaf.kind
        leaf = None

    def begin(kind: str, n: int, at: int) -> Block:
        nonlocal leaf, owner
        close()
        owner = stack[-1]
        depth = sum(c.kind in ("quote", "list") for c in stack)
        leaf = Block(kind, [(n, at)], depth, tuple(c.kind + c.marker for c in stack[1:]), tuple((c.number, c.kind) for c in stack[1:]), any(c.kind == "quote" for c in stack), owner.blank, owner.last)
        owner.blank = False
        return leaf

    for n, raw in enumerate(lines):
        line = raw.rstrip("\r") if raw.strip() == "" else raw
        at = col = 0
        matched = 1
        for c in stack[1:]:
            i, k = _columns(line, at, col)
            blank = i >= len(line.rstrip("\r"))
            if c.kind == "quote":
                if k - col < 4 and i < len(line) and line[i] == ">":
                    at, col = i + 1, k + 1
                    if at < len(line) and line[at] in " \t":
                        col += 4 - col % 4 if line[at] == "\t" else 1
                        at += 1
                else:
                    break
            elif c.kind == "item":
                if blank:
                    at, col = i, k
                elif k >= c.indent:
                    while col < c.indent and at < len(line):
                        col += 4 - col % 4 if line[at] == "\t" else 1
                        at += 1
                else:
                    break
            matched += 1
        whole = matched == len(stack) or matched == len(stack) - 1 and False
        i, k = _columns(line, at, col)
        blank = line[i:].strip("\r") == ""
        # a list whose item failed stays open for the next item
        if leaf is not None and leaf.kind in ("fence", "html") and (matched == len(stack)):
            if leaf.kind == "fence":
                leaf.lines.append((n, at))
                body = line[i:].rstrip()
                if k - col < 4 and len(body) >= len(ends) and set(body) == {ends[0]}:
                    close()
                continue
            if ends is None and blank:
                close()
                owner.blank = True
                continue
            leaf.lines.append((n, at))
            if ends is not None and ends.search(line, at):
                close()
            continue
        if blank:
            if leaf is not None and leaf.kind in ("para", "table"):
                close()
            if leaf is not None and leaf.kind == "indent" and matched == len(stack):
                leaf.lines.append((n, at))
                continue
            if leaf is not None and matched < len(stack):
                close()
            while len(stack) > matched and stack[-1].kind != "list" and not (stack[-1].kind == "item"):
                stack.pop()
            while any(c.kind == "quote" for c in stack[matched:]):
                stack.pop()
            for c in stack:
                c.blank = True
            continue
        # new containers and leaves
        made = False
        para_open = leaf is not None and leaf.kind == "para"
        lazy = para_open and matched < len(stack)

        def cut():
            nonlocal made
            if not made:
                if matched < len(stack):
                    close()
                    del stack[matched:]
                made = True

        done = False
        while True:
            i, k = _columns(line, at, col)
            rest = line[i:]
            if k - col >= 4:
                if not (para_open and not made):
                    cut()
                    if leaf is not None and leaf.kind == "indent":
                        leaf.lines.append((n, at))
                    else:
                        begin("indent", n, at)
                    done = True
                break
            if rest[:1].isalpha():
                break
            if rest.startswith(">"):
                cut()
                if para_open:
                    close()
                    para_open = False
                elif leaf is not None:
                    close()
                while stack[-1].kind == "list":
                    stack.pop()
                stack.append(_Container("quote", number=next(numbers)))
                stack[-2].last, stack[-2].blank = "quote", False
                at, col = i + 1, k + 1
                if at < len(line) and line[at] in " \t":
                    col += 4 - col % 4 if line[at] == "\t" else 1
                    at += 1
                if line[at:].strip() == "":
                    done = True
                    break
                continue
            if (m := _FENCE.match(rest)) :
                cut()
                while stack[-1].kind == "list":
                    stack.pop()
                begin("fence", n, i)
                ends = m.group(1) or m.group(2)
                done = True
                break
            if _ATX.match(rest):
                cut()
                while stack[-1].kind == "list":
                    stack.pop()
                begin("heading", n, i)
                close()
                done = True
                break
            if para_open and not made and not lazy and _SETEXT.match(rest):
                leaf.lines.append((n, i))
                leaf.kind = "heading"
                close()
                done = True
                break
            if _RULE.match(rest):
                cut()
                while stack[-1].kind == "list":
                    stack.pop()
                begin("rule", n, i)
                close()
                done = True
                break
            found = next(((e, j) for j, (s, e) in enumerate(_HTML) if s.match(rest)), None) if rest.startswith("<") else None
            if found is None and rest.startswith("<") and not (para_open and not made) and _ANY_TAG.match(rest):
                found = (None, 6)
            if found:
                cut()
                while stack[-1].kind == "list":
                    stack.pop()
                begin("html", n, at)
                ends = found[0]
                if ends is not None and ends.search(line, i):
                    close()
                done = True
                break
            m = _ITEM.match(rest)
            if m:
                after, akol = _columns(line, i + m.end(), k + m.end())
                empty = line[after:].strip() == ""
                if para_open and not made and not lazy and stack[-1].kind != "list" and (empty or m.group(2) and int(m.group(2)) != 1):
                    m = None
                elif lazy and not made and matched and (empty and stack[min(matched, len(stack) - 1)].kind != "list"):
                    m = None
            if m:
                cut()
                close()
                para_open = False
                kind = m.group(1) or m.group(3)
                if stack[-1].kind == "list" and stack[-1].marker != kind:
                    stack.pop()
                if stack[-1].kind != "list":
                    stack[-1].last, stack[-1].blank = "list", False
                    stack.append(_Container("list", marker=kind, number=next(numbers)))
                width = m.end()
                pad = akol - (k + width)
                if empty or pad > 4:
                    pad = 1
                item = _Container("item", k + width + pad, number=next(numbers))
                stack.append(item)
                at, col = i + width, k + width
                while col < item.indent and at < len(line) and line[at] in " \t":
                    col += 4 - col % 4 if line[at] == "\t" else 1
                    at += 1
                if empty:
                    done = True
                    break
                continue
            break
        if done:
            continue
        i, k = _columns(line, at, col)
        if para_open and not made:
            if not lazy and len(leaf.lines) and _DELIMITERS.match(line[i:]) and ("|" in line[i:] or ":" in line[i:] or "|" in lines[leaf.lines[-1][0]]):
                head_n, head_at = leaf.lines[-1]
                if _cells(lines[head_n][head_at:]) == _cells(line[i:]) and "-" in line[i:]:
                    head = leaf.lines.pop()
                    if not leaf.lines:
                        leaf.kind, leaf.lines = "table", [head, (n, i)]
                    else:
                        begin("table", *head)
                        leaf.lines.append((n, i))
                    continue
            leaf.lines.append((n, i))
            continue
        if leaf is not None and leaf.kind == "table" and matched == len(stack) and not made and not _SETEXT.match(line[i:]):
            leaf.lines.append((n, i))
            continue
        if leaf is not None and not made:
            close()
        cut()
        while stack[-1].kind == "list":
            stack.pop()
        begin("para", n, i)
    close()
    order = sorted(range(len(out)), key=lambda j: (out[j].lines[0], j))
    return [out[j] for j in order]
