"""Normalisation of text as SentencePiece models ask for it: a map of characters, white space, and the prefix."""

from __future__ import annotations

import re

import numpy as np

SPACE = "▁"


def charsmap(blob: bytes) -> dict[str, str]:
    """Every rule of a precompiled map: a double-array trie whose values are places in a list of strings that end in zero."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
    strings = blob[4 + size :]
    label, leaf = units & ((1 << 31) | 0xFF), (units >> 8) & 1
    offset = (units >> 10) << ((units & (1 << 9)) >> 6)
    octets = np.arange(1, 256)
    out: dict[str, str] = {}
    todo = [(int(offset[0]), b"")]
    while todo:
        at, key = todo.pop()
        place = at ^ octets
        ok = place < len(units)
        place, c = place[ok], octets[ok]
        hit = label[place] == c
        for p, c in zip(place[hit].tolist(), c[hit].tolist()):
            below = p ^ int(offset[p])
            if leaf[p]:
                value = int(units[below]) & ((1 << 31) - 1)
                out[(key + bytes([c])).decode("utf-8", "surrogateescape")] = strings[value : strings.index(b"\0", value)].decode("utf-8", "replace")
            todo.append((below, key + bytes([c])))
    return out


class Normaliser:
    """``prefix``: a space goes before the text; ``squeeze``: runs of spaces become one, those at the ends none;
    ``kept``: symbols that come through as they are."""

    def __init__(self, rules: dict[str, str], prefix: bool, squeeze: bool, kept: list[str] = ()):
        self.rules, self.prefix, self.squeeze = rules, prefix, squeeze
        symbols = "|".join(map(re.escape, sorted(kept, key=len, reverse=True)))
        self.symbols = re.compile(f"({symbols})") if symbols else None
        self.lengths: dict[str, list[int]] = {}
        for n in sorted({len(key) for key in rules}, reverse=True):
            for head in {key[0] for key in rules if len(key) == n}:
                self.lengths.setdefault(head, []).append(n)
        # where a rule may begin: at a character that has one, or at the first two characters of a longer one
        some = lambda chars: "[" + "".join(map(re.escape, sorted(chars))) + "]"
        single, longer = {key for key in rules if len(key) == 1}, [key for key in rules if len(key) > 1]
        parts = [some({k[0] for k in longer}) + some({k[1] for k in longer})] if longer else []
        parts += [some(single)] if single else []
        self.begins = re.compile("|".join(parts)) if parts else None

    def _map(self, text: str) -> str:
        if self.begins is None:
            return text
        pieces = self.symbols.split(text) if self.symbols else [text]
        return "".join(p if k % 2 else self._mapped(p) for k, p in enumerate(pieces))

    def _mapped(self, text: str) -> str:
        """At each place the longest rule, from the left on."""
        out, done, at = [], 0, 0
        while m := self.begins.search(text, at):
            at = m.start()
            for n in self.lengths[text[at]]:
                new = self.rules.get(text[at : at + n])
                if new is not None:
                    out += [text[done:at], new]
                    done = at = at + n
                    break
            else:
                at += 1
        return "".join([*out, text[done:]])

    def __call__(self, text: str) -> str:
        out = self._map(text)
        if self.squeeze:
            out = re.sub(" {2,}", " ", out).strip(" ")
        if self.prefix and out:
            out = " " + out
        return out.replace(" ", SPACE)
