"""Inline structure of one paragraph: where lines may not be cut, and where code and emphasis open."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache

PUNCT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TAG = re.compile(
    r"<(?:[a-zA-Z][-0-9a-zA-Z]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[a-zA-Z][-0-9a-zA-Z]*\s*|!--(?:>|->|.*?--)|\?.*?\?|![A-Z]+\s[^>]*|!\[CDATA\[.*?\]\])>", re.S | re.A
)
_AUTO = re.compile(r"<(?:[a-zA-Z][-+.0-9a-zA-Z]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[-0-9a-zA-Z]+(?:\.[-0-9a-zA-Z]+)*)>", re.A)
_BARE = re.compile(r"(?:https?://|ftp://|www\.)[^\s<]+|[A-Za-z0-9.+_-]+@[-0-9a-zA-Z]+(?:\.[-0-9a-zA-Z]+)+", re.A)
#: What is kept whole besides, and what it begins with: footnote marks, maths, shortcodes, braces, anything like a tag.
_KEPT = [(k, re.compile(p)) for k, p in (("[^", r"\[\^[^\]\n]+\]"), ("$", r"\$[^$\n]+\$"), ("{{", r"\{{2}[%<].*?[>%]\}{2}"), ("{", r"\{[^{}\n]+\}"), ("<", r"</?[A-Za-z][^>\n]*>?"))]
#: Places where something may begin or end; the text between them is passed over at once.
_MARK = re.compile(r"[\\*_]")
_NEXT = re.compile(r"[\\`<\[\]]|!(?=\[)")
_NEXT_OR_LINK = re.compile(_NEXT.pattern + r"|(?<![^ \t\n\r*_~(])(?:https?://|ftp://|www\.|[A-Za-z0-9][A-Za-z0-9.+_-]*@)")


def code_spans(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, kind in spans(text) if kind == "code"]


def _link_tail(text: str, at: int) -> int | None:
    """End of "(target "title")" that begins at ``at``."""
    n, i = len(text), at + 1
    while i < n and text[i] in " \t\n\r":
        i += 1
    if i < n and text[i] == "<":
        i += 1
        while i < n and text[i] not in ">\n<":
            i += 2 if text[i] == "\\" else 1
        if i >= n or text[i] != ">":
            return None
        i += 1
    else:
        depth = 0
        while i < n and text[i] not in " \t\n\r" and text[i] >= " ":
            if text[i] == "\\" and i + 1 < n:
                i += 2
                continue
            if text[i] == "(":
                depth += 1
            elif text[i] == ")":
                if not depth:
                    break
                depth -= 1
            i += 1
    gap = i
    while i < n and text[i] in " \t\n\r":
        i += 1
    if i < n and text[i] in "\"'(" and i > gap:
        close = ")" if text[i] == "(" else text[i]
        i += 1
        while i < n and text[i] != close:
            i += 2 if text[i] == "\\" else 1
        i += 1
        while i < n and text[i] in " \t\n\r":
            i += 1
    return i + 1 if i < n and text[i] == ")" else None


@lru_cache(maxsize=16)
def spans(text: str) -> tuple[tuple[int, int, str], ...]:
    """Code, raw tags, autolinks, bare links, inline links and images, in order; none inside another but links' labels."""
    out: list[tuple[int, int, str]] = []
    brackets: list[tuple[int, bool]] = []
    runs: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        runs.setdefault(len(m.group()), []).append(m.start())
    i, n = 0, len(text)
    following = (_NEXT_OR_LINK if "@" in text or "://" in text or "www." in text else _NEXT).search
    while m := following(text, i):
        i = m.start()
        c = text[i]
        if c == "\\":
            i += 2 if i + 1 < n and text[i + 1] in PUNCT else 1
        elif c == "`":
            k = 1
            while text[i + k : i + k + 1] == "`":
                k += 1
            same = runs.get(k, [])
            after = bisect_right(same, i)
            end = same[after] if after < len(same) else None
            if end is None:
                i += k
            else:
                out.append((i, end + k, "code"))
                i = end + k
        elif c == "<" and (m := _AUTO.match(text, i) or _TAG.match(text, i)):
            out.append((i, m.end(), "html" if m.re is _TAG else "auto"))
            i = m.end()
        elif c == "!":
            brackets.append((i, True))
            i += 2
        elif c == "[":
            brackets.append((i, False))
            i += 1
        elif c == "]" and brackets:
            at, image = brackets.pop()
            end = _link_tail(text, i + 1) if text[i + 1 : i + 2] == "(" else None
            if end is None:
                i += 1
                continue
            while out and out[-1][0] >= at:
                out.pop()
            out.append((at, end, "image" if image else "link"))
            if not image:
                brackets = [b for b in brackets if b[1]]
            i = end
        elif c not in "<]" and (m := _BARE.match(text, i)):
            end = m.end()
            while text[end - 1] in "?!.,:*_~'\"" or text[end - 1] == ")" and text[i:end].count(")") > text[i:end].count("("):
                end -= 1
            out.append((i, end, "auto"))
            i = max(end, i + 1)
        else:
            i += 1
    return tuple(out)


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def no_break_spans(text: str) -> list[tuple[int, int]]:
    """Where no line may be cut: everything but plain and emphasised text."""
    found = [(a, b) for a, b, _ in spans(text)]
    for mark, p in _KEPT:
        if mark in text:
            found += [m.span() for m in p.finditer(text)]
    return _merged(found)


def _paired(text: str) -> tuple[list[list], list[tuple[int, int, int]]]:
    """Runs of emphasis marks, and the pairs they make: where one opens, where it closes, and with how many marks."""
    if "*" not in text and "_" not in text:
        return [], []
    covered = spans(text)
    runs, pairs = [], []  # a run: position, char, marks left, can open, can close, marks, marks used to close
    i, n, k = 0, len(text), 0
    while i < n:
        while k < len(covered) and covered[k][1] <= i:
            k += 1
        if k < len(covered) and covered[k][0] <= i:
            i = covered[k][1]
            continue
        m = _MARK.search(text, i)
        if not m:
            break
        if k < len(covered) and covered[k][0] <= m.start():
            i = covered[k][0]
            continue
        i = m.start()
        c = text[i]
        if c == "\\":
            i += 2 if i + 1 < n and text[i + 1] in PUNCT else 1
            continue
        j = i
        while j < n and text[j] == c:
            j += 1
        before, after = text[i - 1] if i else " ", text[j] if j < n else " "
        space = lambda x: x.isspace()
        punct = lambda x: x in PUNCT or unicodedata.category(x)[0] in "PS"
        left = not space(after) and (not punct(after) or space(before) or punct(before))
        right = not space(before) and (not punct(before) or space(after) or punct(after))
        opens = left and (c == "*" or not right or punct(before))
        closes = right and (c == "*" or not left or punct(after))
        runs.append([i, c, j - i, opens, closes, j - i, 0])
        i = j
    stack: list[list] = []
    for run in runs:
        if run[4]:
            while run[2]:
                at = next((x for x in range(len(stack) - 1, -1, -1) if stack[x][1] == run[1] and not ((stack[x][4] or run[3]) and (stack[x][5] + run[5]) % 3 == 0 and (stack[x][5] % 3 or run[5] % 3))), None)
                if at is None:
                    break
                opener = stack[at]
                use = 2 if opener[2] > 1 and run[2] > 1 else 1
                opener[2] -= use
                pairs.append((opener[0] + opener[6] + opener[2], run[0] + run[6], use))
                run[2] -= use
                run[6] += use
                del stack[at + 1 :]
                if not opener[2]:
                    stack.pop()
        if run[3] and run[2]:
            stack.append(run)
    return runs, pairs


def emphasis(text: str) -> dict[int, tuple[int, str]]:
    """For each place where emphasis opens or closes, how many marks stand there and the tag."""
    out = {}
    for a, b, size in _paired(text)[1]:
        name = "strong" if size == 2 else "em"
        out[a], out[b] = (size, f"<{name}>"), (size, f"</{name}>")
    return out


def openers(text: str) -> set[int]:
    """Where code spans and emphasis open; nested ones count where the outermost does."""
    runs, pairs = _paired(text)
    starts = {a for a, _, kind in spans(text) if kind == "code"} | {a for a, _, _ in pairs}
    # an opener whose delimiters touch those of an outer one opens where that does
    out = set()
    for s in starts:
        while s and text[s - 1] in "*_" and s - 1 in starts:
            s -= 1
        out.add(s)
    for run in runs:
        inner = [s for s in starts if run[0] <= s < run[0] + run[5]]
        out |= {min(inner)} if inner else set()
    return out | starts
