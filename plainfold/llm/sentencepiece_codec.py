"""SentencePiece encoding and decoding by one pass over an Aho-Corasick automaton of the pieces.

At each character the automaton's state lists, by its output links, all pieces that end there, and these relax the best
path to that place. What is best depends on the kind of model: in a unigram model the highest sum of scores (Viterbi);
in a BPE model, where scores are ranks of merges and their sum means nothing, the one piece that merging would leave
there: the longest that starts after a place already reached and that merging would not fuse or split with the piece
before it. Both give exactly the identifiers that the model's own library gives. Characters that no piece holds become
byte pieces, or the unknown piece in a model without them.

Defined results: a null text gives null, an empty one no identifiers. The character U+2581, which stands for a space in
pieces, comes back as a space; ``round_trip`` is false then. New columns replace columns of the same names. Identifiers
that the model doesn't have, and null ones, are decoded as U+FFFD. A model that normalises gives back the normalised text.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C
from .normalise import Normaliser, charsmap

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: What a worker keeps of its work, whatever the corpus: words (of two generations; none longer than LONG_WORD), and answers on pieces.
CACHED_WORDS, LONG_WORD, CACHED_ANSWERS = 50_000, 64, 1 << 18
NEVER = float("-inf")


def load(path: str) -> dict:
    """Pieces of a model file, as plain values that travel with a task."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if m.trainer_spec.model_type not in (1, 2) or m.trainer_spec.treat_whitespace_as_suffix or not spec.escape_whitespaces:
        raise ValueError("only unigram and BPE models that write spaces before words are supported")
    return {
        "pieces": [p.piece for p in m.pieces], "scores": [p.score for p in m.pieces], "types": [p.type for p in m.pieces], "unigram": m.trainer_spec.model_type == 1,
        "prefix": spec.add_dummy_prefix, "squeeze": spec.remove_extra_whitespaces, "charsmap": spec.precompiled_charsmap,
    }


class Automaton:
    """Aho-Corasick over the pieces; ``outputs[s]`` are (identifier, length) of all that end in state s, longest first."""

    def __init__(self, pieces: dict[str, int]):
        self.next: list[dict[str, int]] = [{}]
        own = {}
        for piece, pid in pieces.items():
            s = 0
            for ch in piece:
                t = self.next[s].get(ch)
                if t is None:
                    t = len(self.next)
                    self.next[s][ch] = t
                    self.next.append({})
                s = t
            own[s] = (pid, len(piece))
        self.fail = [0] * len(self.next)
        self.outputs: list[tuple] = [()] * len(self.next)
        order = list(self.next[0].values())
        for s in order:  # breadth first; grows as it goes
            found = self.outputs[self.fail[s]]
            self.outputs[s] = (own[s], *found) if s in own else found
            for ch, t in self.next[s].items():
                f = self.fail[s]
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                self.fail[t] = self.next[f].get(ch, 0)
                order.append(t)
        self.known: dict[tuple[int, str], int] = {}  # moves that went by failure links

    def step(self, s: int, ch: str) -> int:
        t = self.next[s].get(ch)
        if t is None:
            t = self.known.get((s, ch))
            if t is None:
                f = s
                while f and ch not in self.next[f]:
                    f = self.fail[f]
                if len(self.known) >= CACHED_ANSWERS:
                    self.known.clear()
                t = self.known[s, ch] = self.next[f].get(ch, 0)
        return t


class Codec:
    def __init__(self, model: dict):
        self.pieces, self.scores, types = model["pieces"], model["scores"], model["types"]
        self.unigram, self.prefix = model["unigram"], model["prefix"]
        own = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == 4}
        self.normal = {p: i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == 1 or t == 4 and self.unigram}
        if self.unigram and own:  # a user's own pieces win over any path
            top = max((self.scores[i] for i in self.normal.values() if types[i] == 1), default=0.0)
            self.scores = [len(p) * top - 0.1 if t == 4 else x for p, x, t in zip(self.pieces, self.scores, types)]
        #: in a BPE model they are cut out before anything is merged
        self.own = None if self.unigram or not own else (own, re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")"))
        self.normalise = Normaliser(charsmap(model.get("charsmap", b"")), self.prefix, model.get("squeeze", False), [p.replace(SPACE, " ") for p in own])
        self.automaton = Automaton(self.normal)
        self.unk = next((i for i, t in enumerate(types) if t == 2), 0)
        self.bytes = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(self.pieces, types)) if t == 6}
        self.unk_score = min((self.scores[i] for i in self.normal.values() if types[i] == 1), default=0) - 10
        self.alphabet = {p for p in self.normal if len(p) == 1}
        joint = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.normal)
        apart = "".join(c for c in "\n\t\r" if not any(c in p for p in self.normal))
        # Text may be cut wherever no piece holds the two characters that meet: before spaces, between letters and others.
        others = {chr(i) for i in range(33, 127) if not chr(i).isalpha()}
        met = {frozenset(p[i : i + 2]) for p in self.normal for i in range(len(p) - 1)}
        while more := {c for pair in met if pair & others for c in pair - others if unicodedata.category(c)[0] not in "LM" and c != SPACE}:
            others |= more
        mixed = any(pair & others and pair - others - {SPACE} for pair in met)
        marks = re.escape("".join(sorted(others - set(apart))))
        words = f"{SPACE}*[^{SPACE}{apart}]+" if mixed else f"{SPACE}*[^{SPACE}{apart}{marks}]+|{SPACE}*[{marks}]+"
        # a piece with a space inside, or unknown pieces that run together, forbid it
        self.cut = None if joint or not self.bytes else re.compile(words + f"|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.out = [p.replace(SPACE, " ").encode() if t not in (3, 6) else bytes([int(p[1:-1], 16)]) if t == 6 else b"" for p, t in zip(self.pieces, types)]
        self.out[self.unk] = " ⁇ ".encode()
        self.fits: dict[int, bool] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def merged(self, text: str) -> list[int]:
        """Merging as BPE defines it: again and again the adjacent pair with the best score, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = NEVER, -1
            for i in range(len(parts) - 1):
                pid = self.normal.get(parts[i] + parts[i + 1])
                if pid is not None and self.scores[pid] > best:
                    best, at = self.scores[pid], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.normal.get(p, self.unk) for p in parts]

    def halves(self, pid: int) -> tuple[int, int] | None:
        """The two pieces whose merge made this one; None for a character, or where merging never makes the piece."""
        got = self.made.get(pid, False)
        if got is False:
            parts = list(self.pieces[pid])
            while len(parts) > 2:
                best, at = NEVER, -1
                for i in range(len(parts) - 1):
                    q = self.normal.get(parts[i] + parts[i + 1])
                    if q is not None and self.scores[q] > best:
                        best, at = self.scores[q], i
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ids = [self.normal.get(x, -1) for x in parts]
            got = self.made[pid] = tuple(ids) if len(ids) == 2 and -1 not in ids else None
        return got

    def fit(self, a: int, b: int) -> bool:
        """Whether merging leaves piece b as it is, after piece a (or at the start, for a = -1).

        Undoes the later of the two last merges, again and again: the pieces that then touch must not merge before it."""
        key = (a + 1) << 32 | b
        got = self.fits.get(key)
        if got is None:
            got = self.merged(self.pieces[b]) == [b] if a < 0 else self.apart(a, b)
            if len(self.fits) >= CACHED_ANSWERS:
                self.fits.clear()
            self.fits[key] = got
        return got

    def apart(self, a: int, b: int) -> bool:
        pieces, normal, scores = self.pieces, self.normal, self.scores
        if not (self.fit(-1, b) and self.fit(-1, a)):
            return False
        # a merge at the seam happens before a merge of score `than`; of equals, the one further left goes first
        than, seam_first = NEVER, True
        while True:
            c = normal.get(pieces[a] + pieces[b])
            if c is not None and (scores[c] > than or seam_first and scores[c] == than):
                return False
            x = self.halves(a) if len(pieces[a]) > 1 else None
            y = self.halves(b) if len(pieces[b]) > 1 else None
            if x is None and y is None:
                return True
            if y is None or x is not None and scores[a] <= scores[b] and not scores[a] == scores[b]:
                than, seam_first, a = scores[a], False, x[1]
            else:
                than, seam_first, b = scores[b], True, y[0]

    def known(self, text: str) -> list[int]:
        """Identifiers of a BPE text whose characters are all pieces."""
        step, outputs, fits, moves = self.automaton.step, self.automaton.outputs, self.fits, self.automaton.next
        last, size, s = [-1], [0], 0
        for i, ch in enumerate(text, 1):
            t = moves[s].get(ch)
            s = step(s, ch) if t is None else t
            for pid, n in outputs[s]:
                before = last[i - n]
                ok = fits.get((before + 1) << 32 | pid)
                if ok or ok is None and self.fit(before, pid):
                    last.append(pid)
                    size.append(n)
                    break
            else:
                raise AssertionError(f"no path through {text!r}")
        out, i = [], len(text)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def viterbi(self, text: str) -> list[int]:
        step, outputs, scores, unk = self.automaton.step, self.automaton.outputs, self.scores, self.unk_score
        best, came, by, s = [0.0], [0], [-1], 0
        for i, ch in enumerate(text, 1):
            s = step(s, ch)
            top, start, pid = NEVER, i - 1, -1
            single = False
            for p, n in outputs[s]:
                single |= n == 1
                x = best[i - n] + scores[p]
                if x > top:
                    top, start, pid = x, i - n, p
            if not single and best[i - 1] + unk > top:
                top, start, pid = best[i - 1] + unk, i - 1, self.unk
            best.append(top)
            came.append(start)
            by.append(pid)
        out, i = [], len(text)
        while i:
            out.append((came[i], i, by[i]))
            i = came[i]
        ids, unknown = [], False
        for a, b, pid in reversed(out):
            if pid != self.unk:
                ids.append(pid)
            elif self.bytes:
                ids.extend(self.bytes[x] for x in text[a:b].encode())
            elif not unknown:
                ids.append(pid)
            unknown = pid == self.unk
        return ids

    def segment(self, text: str) -> list[int]:
        if self.unigram:
            return self.viterbi(text)
        out, at, unknown = [], 0, False
        for i, ch in enumerate([*text, ""]):
            if ch and ch in self.alphabet:
                continue
            if at < i:
                out += self.known(text[at:i])
                unknown = False
            if ch and self.bytes:
                out += [self.bytes[x] for x in ch.encode()]
            elif ch and not unknown:
                out.append(self.unk)
                unknown = True
            at = i + 1
        return out

    def word(self, w: str) -> tuple:
        ids = self.old.get(w)
        if ids is None:
            ids = tuple(self.segment(w))
            if len(w) > LONG_WORD:
                return ids
        if len(self.young) >= CACHED_WORDS:
            self.old, self.young = self.young, {}
        self.young[w] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        t = self.normalise(text)
        if not t:
            return []
        if self.own is None:
            return self.piecewise(t)
        return [i for k, part in enumerate(self.own[1].split(t)) for i in ([self.own[0][part]] if k % 2 else self.piecewise(part) if part else [])]

    def piecewise(self, t: str) -> list[int]:
        if self.cut is None:
            return self.segment(t)
        get, word = self.young.get, self.word
        if len(self.young) < CACHED_WORDS // 2:
            return list(chain.from_iterable([get(w) or word(w) for w in self.cut.findall(t)]))
        return list(chain.from_iterable([self.young.get(w) or word(w) for w in self.cut.findall(t)]))

    def decode(self, ids) -> str:
        out = self.out
        if not all(i is not None and 0 <= i < len(out) for i in ids):
            ids, out = [i if i is not None and 0 <= i < len(out) else len(out) for i in ids], [*out, "\ufffd".encode()]
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(model: dict, name: str) -> Codec:
    """One codec a worker and model; its cache of words lives on between tasks."""
    if name not in _codecs:
        _codecs[name] = Codec(model)
    return _codecs[name]


_CODED = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("round_trip", pa.bool_())])


def coder(path: str = MODEL):
    model = load(path)

    def coded(text: pa.Array) -> pa.Array:
        c = codec(model, path)
        ids, sizes, same = array("i"), [], []
        for part in C.slices([pa.RecordBatch.from_arrays([text], names=["text"])]):  # few texts at once are Python's
            for t in part.column(0).to_pylist():
                if t is None:
                    sizes.append(-1)
                    same.append(None)
                    continue
                x = c.encode(t)
                same.append(c.decode(x) == t)
                ids.extend(x)
                sizes.append(len(x))
        n = np.array(sizes, np.int64)
        null = n < 0
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(np.maximum(n, 0), out=ends[1:])
        flat = pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)])
        lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array(null) if null.any() else None)
        return pa.StructArray.from_arrays([lists, pa.array(np.maximum(n, 0).astype(np.int32), mask=null), pa.array(same, pa.bool_())], fields=list(_CODED))

    return C.once(F.arrow_udf(coded, "ids array<int>, n_tokens int, round_trip boolean"))


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with ids, n_tokens and round_trip."""
    rows = C.packed(docs).withColumn("c", coder(path)(F.col("row.text").cast("string")))
    new = ["ids", "n_tokens", "round_trip"]
    kept = [F.col(f"row.`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in new]
    return rows.select(*kept, *[F.col(f"c.{n}") for n in new])


def decode(coded: DataFrame, path: str = MODEL) -> DataFrame:
    """coded with its column ``ids`` written out as ``text``; null stays null."""
    model = load(path)

    def decoded(ids: pa.Array) -> pa.Array:
        c = codec(model, path)
        return pa.array([None if x is None else c.decode(x) for x in ids.to_pylist()], pa.string())

    return coded.withColumn("text", F.arrow_udf(decoded, "string")(F.col("ids")))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids", "n_tokens", "round_trip")
