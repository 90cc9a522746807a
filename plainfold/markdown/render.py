"""HTML of a Markdown text up to white space, to compare a text with its reflow.

It is written for comparison: every paragraph gets its own tag, also in tight lists; a link by reference stays as its
brackets, and each definition is written where it stands, so that texts that differ in either differ here.
"""

from __future__ import annotations

import html as H
import re

from plainfold.markdown import blocks as B
from plainfold.markdown import inline as I

_BLANK = re.compile(r"\s+")
_BREAK = re.compile(r"<br\s*/?>", re.I)
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_SPECIAL = re.compile(r"[\\&]| {2,}(?=\r?\n)")
_CHECKBOX = re.compile(r"\[[ \txX]\][ \t\r]*\n")


def normalised(html: str) -> str:
    """White space and the spelling of line breaks evened out."""
    out = _BREAK.sub("<br>", _BLANK.sub(" ", html))
    return out.replace(" <br>", "<br>").strip()


def _plain(text: str) -> str:
    """Text without any construct but escapes, entities and line ends."""
    out, at = [], 0
    while m := _SPECIAL.search(text, at):
        out.append(H.escape(text[at : m.start()]))
        c, at = m.group()[0], m.end()
        if c == "\\":
            following = text[at : at + 1]
            if following == "\n" or text[at : at + 2] == "\r\n":
                out.append("<br>")
            elif following in I.PUNCT and following:
                out.append(H.escape(following))
                at += 1
            else:
                out.append("\\")
        elif c == "&":
            e = _ENTITY.match(text, m.start())
            out.append(H.escape(H.unescape(e.group())) if e else "&amp;")
            at = e.end() if e else at
        else:
            out.append("<br>")
    return "".join(out) + H.escape(text[at:])


def _label_end(text: str, a: int, end: int) -> int:
    """Where the label of a link that spans [a, end) closes."""
    k = text.find("](", a, end)
    while k >= 0 and I._link_tail(text, k + 1) != end:
        k = text.find("](", k + 1, end)
    return k


def inline(text: str) -> str:
    """HTML of a paragraph's text."""
    out, at = [], 0
    marks = I.emphasis(text)
    places = sorted(marks)
    k = 0

    def flow(to: int) -> None:
        """Plain text and the emphasis in it, up to ``to``."""
        nonlocal at, k
        while k < len(places) and places[k] < to:
            size, tag = marks[places[k]]
            out.append(_plain(text[at : places[k]]))
            out.append(tag)
            at = places[k] + size
            k += 1
        out.append(_plain(text[at:to]))
        at = to

    for a, b, kind in I.spans(text):
        flow(a)
        if kind == "code":
            n = len(text[a:b]) - len(text[a:b].lstrip("`"))
            body = text[a + n : b - n].replace("\r", "").replace("\n", " ")
            if body[:1] == body[-1:] == " " and body.strip():
                body = body[1:-1]
            out.append(f"<code>{H.escape(body)}</code>")
        elif kind == "html":
            out.append(text[a:b])
        elif kind == "auto":
            out.append(f"<a>{H.escape(text[a:b].strip('<>'))}</a>")
        else:
            end = _label_end(text, a, b)
            target = " ".join(text[end + 1 : b].split())
            label = text[a + (2 if kind == "image" else 1) : end]
            out.append(f"<{kind} {H.escape(target)}>{inline(label)}</{kind}>")
        at = b
        while k < len(places) and places[k] < b:
            k += 1
    flow(len(text))
    return "".join(out)


def _body(b: B.Block, lines: list[str]) -> str:
    texts = [lines[n][o:] for n, o in b.lines]
    if b.kind == "para":
        text = "\n".join([x.lstrip(" \t") for x in texts[:-1]] + [texts[-1].strip(" \t\r")])
        box = _CHECKBOX.match(text) if b.path[-1:] == ("item",) and not b.previous else None
        return f"<p>{(H.escape(box.group().strip()) + ' ' if box else '') + inline(text[box.end() if box else 0 :])}</p>"
    if b.kind == "heading":
        return f"<h>{H.escape(chr(10).join(texts))}</h>"
    if b.kind == "html":
        return "\n".join(texts)
    return f"<{b.kind}>{H.escape(chr(10).join(texts))}</{b.kind}>"


def html(lines: list[str], blocks: list[B.Block] | None = None) -> str:
    """HTML of a text's lines, normalised; blocks: what a scan of them gives, if it is at hand."""
    out: list[str] = []
    inside: tuple = ()
    for b in B.scan(lines) if blocks is None else blocks:
        same = 0
        while same < len(inside) and same < len(b.inside) and inside[same] == b.inside[same]:
            same += 1
        out += [f"</{kind}>" for _, kind in reversed(inside[same:])]
        out += [f"<{kind}>" for _, kind in b.inside[same:]]
        inside = b.inside
        out.append(_body(b, lines))
    return normalised("\n".join(out))
