"""Secret scans with a character convolutional network in numpy.

A candidate is every run of MIN_LENGTH or more key characters that holds a digit or two capitals, and every value of
MIN_VALUE or more characters, of whatever kind, that a credential's name and an assignment sign stand before (up to the
closing quote, or to a blank where there is none). The network reads the whole candidate and CONTEXT bytes on either side: embedded characters (and whether they belong to the candidate), one
convolution, its greatest and its mean value within the candidate, and a dense layer. It is trained on labelled findings
(``labelled_findings``, or any list of one's own) by ``python -m plainfold.llm.secret_scan``, which writes its weights
beside this file; scans read these. Its scores are calibrated on findings held out from training, and the
threshold is the highest that still finds MIN_RECALL of these.

Defined results: null and empty texts have no candidates. Several findings of a document are rows of their own, in whatever
number; repeated rows are scanned each. Offsets count characters. The secret itself is not in the result, only its
first characters, a quarter of them at most. A null doc_id stays null. Not looked for: secrets under MIN_LENGTH
characters that no name stands before, and single lower-case words as passwords, which look like any other word.
"""

from __future__ import annotations

import random
import re
import string
import time
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plainfold.sources.tables import table

from . import common as C

MIN_LENGTH, CONTEXT, MIN_RECALL, SEED, FINDINGS = 16, 40, 0.998, 11, 12_000
MIN_VALUE, SHOWN = 6, 4
WEIGHTS = Path(__file__).with_name("secret_scan_weights.npz")

_ASSIGNED = re.compile(
    rb"(?i)(?:pass(?:word|wd|phrase|code)|(?<![a-z])pass|pwd|secret|token|credentials?|(?:api|access|auth|private|signing|secret|encryption)[_-]?key)s?[\"']?"
    rb"[ \t]*(?::=|=>|[:=])[ \t]*(?:\"([^\"\n]{6,})\"|'([^'\n]{6,})'|([^\s\"'<>,;]{6,}))"
)

_KEY = np.zeros(256, bool)
_KEY[[ord(c) for c in string.ascii_letters + string.digits + "+/_-"]] = True
_CHAR = np.full(256, 97, np.int64)  # other bytes; 98 pads
_CHAR[32:127] = np.arange(95)
_CHAR[[9, 10, 13]] = 95
_PAD, _KINDS = 98, 99


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and rows."""
    start, end, row = C.runs(_KEY[data], offsets)
    long = end - start >= MIN_LENGTH
    start, end, row = start[long], end[long], row[long]
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data < 58))])
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data < 91))])
    ok = (digits[end] > digits[start]) | (capitals[end] - capitals[start] > 1)
    start, end, row = start[ok], end[ok], row[ok]
    at, to, of = assigned(data, offsets)
    if not len(at):
        return start, end, row
    k = np.searchsorted(at, end) - 1  # the last value that begins before a run's end
    apart = (k < 0) | (to[k] <= start)
    start, end, row = (np.concatenate([x[apart], y]) for x, y in ((start, at), (end, to), (row, of)))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], row[order]


def assigned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes) and rows of the values that credentials' names stand before."""
    raw = data.tobytes()
    apart = b"\n".join([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())])  # no value goes beyond its line
    found = [m.span(m.lastindex) for m in _ASSIGNED.finditer(apart)]
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, z
    at, to = np.array(found, np.int64).T
    row = np.searchsorted(offsets + np.arange(len(offsets)), at, side="right") - 1
    return at - row, to - row, row


# --- labelled findings -------------------------------------------------------------------------------------------


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[bytes, int, int, bool]]:
    """(text, start, end, is a secret): written secrets and look-alikes of common kinds among words of no language."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexes, upper, mixed = "0123456789abcdef", string.ascii_uppercase + "234567" + string.digits, string.ascii_letters + string.digits
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la el que ción der und sch ein les eau ai é ü ñ".split()

    def words(k: int) -> str:
        out = []
        for _ in range(k):
            w = "".join(r.choice(parts) for _ in range(r.randint(1, 5)))
            w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.04 else w
            out.append(w + (r.choice(",.;:!") if r.random() < 0.15 else ""))
        return " ".join(out)

    def named(names: str, value: str) -> tuple[str, str, str]:
        name, q = r.choice(names.split()), r.choice(["", '"', "'"])
        name = r.choice([name, name.upper(), name.capitalize()])
        name = f'"{name}"' if r.random() < 0.15 else name
        return name + r.choice(["=", " = ", ": ", ":", " := ", "=> "]) + q, value, q

    def syllables(k: int) -> str:
        return "".join(r.choice(parts[:30]) for _ in range(k))

    def short() -> str:
        k = r.randrange(6)
        if k == 5:  # figures for letters
            w = syllables(r.randint(3, 5)).translate(str.maketrans("aeios", "43105"))
            return (w if any(c.isdigit() for c in w) else w + "7") + r.choice(["", "!", "#", "$$", "word", "#word!", "_x"])
        if k == 0:  # a word with figures or signs
            w = syllables(r.randint(2, 4))
            return (w.capitalize() if r.random() < 0.5 else w) + pick(string.digits, r.randint(1, 4)) + r.choice(["", "!", "#", "$", "x", "?", "Secret!", "@home"])
        if k == 1:
            return pick(mixed + "!@#$%^&*+-_", r.randint(4, 8)) + r.choice(string.digits) + pick(mixed + "!@#$%^&*+-_", r.randint(3, 6))
        if k == 2:
            return r.choice("-_.").join(syllables(r.randint(2, 3)) for _ in range(r.randint(4, 5)))
        if k == 3:
            return pick(string.ascii_lowercase, r.randint(16, 24))
        return pick(string.ascii_lowercase, 4) + pick(string.ascii_uppercase, 4) + pick(string.digits, 4)

    def placeholder() -> str:
        k = r.randrange(6)
        name = r.choice(["password", "DB_PASSWORD", "API_KEY", "token", "secret", "AUTH_TOKEN", "value"])
        if k < 2:
            return syllables(r.randint(3, 5)) + r.choice(["", ".", "!", ")"])
        if k == 2:
            return r.choice(["*", "x", "X", "•", "-", ".", "#"]) * r.randint(6, 14)
        if k == 3:
            return r.choice(["${%s}", "$%s-", "{{%s}}", "os.environ[%s]", "process.env.%s", "getenv(%s)", "%%%s%%", "config.%s", "args.%s", "self.%s", "your_%s", "[%s]", "my-%s-here", "vault:%s"]) % name
        if k == 4:
            return r.choice(["required", "optional", "changeme", "[REDACTED]", "(hidden)", "undefined", "string", "redacted", "example", "missing", "invalid", "expired", "forgotten", "Required", "REQUIRED", "incorrect", "function(x)", "str|None"])
        return r.choice(["/etc/", "./", "https://", "../", "file://"]) + "/".join(syllables(r.randint(2, 3)) for _ in range(r.randint(2, 4))) + r.choice(["", ".txt", ".yaml", "/"])

    def secret() -> tuple[str, str, str]:
        if r.random() < 0.2:
            return named("password passwd pwd db_password pass secret token api_key passphrase access_key user_password", short())
        k = r.randrange(9) if r.random() < 0.8 else 2 + r.randrange(4)
        if k < 2:
            return "", "AKIA" + pick(upper, 16), ""
        if k < 4:
            return named("password passwd pwd db_password pass", pick(r.choice([hexes, mixed, mixed + "_-"]), r.randint(16, 28)))
        if k < 6:
            return named("token auth_token access_token api_token secret client_secret api_key apikey private_key", pick(r.choice([hexes, mixed, mixed + "+/"]), r.choice([20, 24, 32, 40, 48, 64])))
        if k == 6:
            return "", r.choice(["ghp_", "gho_", "sk_live_", "rk_live_", "xoxb-", "glpat-", "AIza"]) + pick(mixed, r.randint(24, 40)), ""
        if k == 7:
            return r.choice(["Bearer ", "Authorization: Bearer ", "Authorization: Basic "]), pick(mixed + "-_", r.randint(24, 80)), ""
        return named("aws_secret_access_key secret_key signing_key", pick(mixed + "+/", 40))

    def other() -> tuple[str, str, str]:
        if r.random() < 0.2:
            return named("password passwd pwd db_password pass secret token api_key passphrase access_key tokens secrets", placeholder())
        k = min(r.randrange(18), 12) if r.random() < 0.7 else r.choice([1, 5])
        if k == 0:
            return r.choice(["", "card ", "nr. ", "id ", "ISBN "]), pick(string.digits, r.randint(16, 20)), ""
        if k == 1:
            return r.choice(["commit ", "rev ", "sha1: ", "md5 ", "checksum ", "sha256:", "blob ", "tree ", "etag: "]), pick(hexes, r.choice([32, 40, 64])), ""
        if k == 2:
            return r.choice(["", "id ", "uuid: ", "urn:uuid:"]), "-".join(pick(hexes, j) for j in (8, 4, 4, 4, 12)), ""
        if k == 3:
            return r.choice(["https://", "http://www.", ""]), "/".join(pick(string.ascii_lowercase, r.randint(3, 9)) for _ in range(r.randint(2, 4))) + "/" + pick(string.digits, r.randint(1, 4)), ""
        if k == 4:
            return "", r.choice(["IMG_", "DSC-", "scan_", "report-", "backup_"]) + "20" + pick(string.digits, 6) + r.choice("_-") + pick(string.digits, 6), r.choice(["", ".jpg", ".pdf"])
        if k == 5:
            return "", "".join(r.choice(parts) for _ in range(r.randint(7, 12))).upper(), r.choice(["", "!!", ".", ",!!"])
        if k == 6:
            return "", "-".join("".join(r.choice(parts[:30]) for _ in range(2)) for _ in range(5)) + "-" + pick(string.digits, r.randint(1, 3)), ""
        if k == 7:
            return r.choice(["", "0x"]), r.choice(["0", "1", "-1", "01", "ab1", "A1"]) * r.randint(10, 20), ""
        if k == 8:
            return "data:image/png;base64,", "iVBORw0KGgo" + pick(mixed + "+/", r.randint(30, 120)), ""
        if k == 9:
            return "", pick("ACGT", r.randint(18, 60)) + r.choice(["", "1"]), ""
        if k == 10:
            return "", "20" + pick(string.digits, 2) + "-" + pick("01", 2) + "-" + pick("012", 2) + "T" + pick("01", 2) + "-" + pick("012345", 2) + "-" + pick(string.digits, r.randint(2, 6)), ""
        if k == 11:
            return "", "".join(w.capitalize() for w in words(r.randint(3, 5)).replace(",", "").split() if w.isascii() and w.isalpha()) + "HandlerFactory" + r.choice(["", "2", "V2"]), ""
        if k == 12 and r.random() < 0.5:
            return named("commit sha digest hash checksum revision md5 build", pick(hexes, r.choice([32, 40, 64])))
        return named("user_id session page sku model order", pick(string.digits, r.randint(16, 20)))

    out = []
    while len(out) < n:
        yes = r.random() < 0.5
        before, value, after = secret() if yes else other()
        loud = value.isupper() and value.isalpha() and r.random() < 0.6  # capitals amid capitals
        head = (words(r.randint(0, 9)).upper().replace(" ", "!! ") if loud else words(r.randint(0, 9))) + r.choice([" ", "\n", " "]) + before
        text = (head + value + after + r.choice([" ", "\n", ". ", ""]) + words(r.randint(0, 9))).encode()
        at = len(head.encode())
        data = np.frombuffer(text, np.uint8)
        start, end, _ = candidates(data, np.array([0, len(text)]))
        for a, b in zip(start.tolist(), end.tolist()):
            if b > at and a < at + len(value.encode()):
                out.append((text, a, b, yes))
                break
    return out


# --- the network -------------------------------------------------------------------------------------------------


def encoded(texts: list[bytes], starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Characters, and whether they are the candidate's, padded to the longest."""
    windows = [(t[max(0, a - CONTEXT) : b + CONTEXT], min(a, CONTEXT), b - a) for t, a, b in zip(texts, starts, ends)]
    size = max(len(w) for w, _, _ in windows) + 2
    x, inside = np.full((len(windows), size), _PAD), np.zeros((len(windows), size), bool)
    for i, (w, a, k) in enumerate(windows):
        x[i, : len(w)] = _CHAR[np.frombuffer(w, np.uint8)]
        inside[i, a : a + k] = True
    return x, inside


class Network:
    WIDTH, EMBED, FILTERS, HIDDEN = 7, 12, 48, 24

    def __init__(self, seed: int = SEED):
        g = np.random.default_rng(seed)
        d = self.EMBED + 1
        shapes = {"e": (_KINDS, self.EMBED), "w": (self.WIDTH * d, self.FILTERS), "b": (self.FILTERS,), "h": (2 * self.FILTERS, self.HIDDEN), "c": (self.HIDDEN,), "o": (self.HIDDEN, 1), "z": (1,)}
        self.p = {k: (g.normal(0, (2 / s[0]) ** 0.5 if k != "e" else 0.3, s) if len(s) > 1 else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.p["e"][_PAD] = 0
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray, inside: np.ndarray):
        p, pad = self.p, self.WIDTH // 2
        v = np.concatenate([p["e"][x], inside[..., None].astype(np.float32)], 2)
        v = np.pad(v, ((0, 0), (pad, pad), (0, 0)))
        cols = np.lib.stride_tricks.sliding_window_view(v, self.WIDTH, 1).transpose(0, 1, 3, 2).reshape(x.shape[0], x.shape[1], -1)
        a = np.maximum(cols @ p["w"] + p["b"], 0)
        a = a * (x != _PAD)[..., None]
        top = a.argmax(1)
        share = inside / np.maximum(inside.sum(1, keepdims=True), 1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], (share.astype(np.float32)[:, None] @ a)[:, 0]], 1)
        hidden = np.maximum(pooled @ p["h"] + p["c"], 0)
        return (hidden @ p["o"] + p["z"])[:, 0], (cols, a, top, share, pooled, hidden)

    def gradients(self, x, inside, y):
        p, f = self.p, self.FILTERS
        out, (cols, a, top, share, pooled, hidden) = self.forward(x, inside)
        err = ((1 / (1 + np.exp(-out)) - y) / len(y)).astype(np.float32)[:, None]
        g = {"o": hidden.T @ err, "z": err.sum(0)}
        dh = err @ p["o"].T * (hidden > 0)
        g["h"], g["c"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ p["h"].T
        da = share[..., None].astype(np.float32) * dp[:, None, f:]
        at = np.arange(len(y))[:, None], top, np.arange(f)[None]
        da[at] += dp[:, :f]
        da *= a > 0
        flat = da.reshape(-1, f)
        g["w"], g["b"] = cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0)
        dc = (da @ p["w"].T).reshape(*x.shape, self.WIDTH, -1)[..., : self.EMBED]
        pad, at, parts = self.WIDTH // 2, [], []
        for k in range(self.WIDTH):  # column k of a place is the character k - pad further on
            lo, hi = max(0, k - pad), x.shape[1] + min(0, k - pad)
            at.append(x[:, lo:hi].ravel())
            parts.append(dc[:, lo - (k - pad) : hi - (k - pad), k].reshape(-1, self.EMBED))
        at, parts = np.concatenate(at), np.concatenate(parts)
        ge = np.stack([np.bincount(at, weights=parts[:, j], minlength=_KINDS) for j in range(self.EMBED)], 1).astype(p["e"].dtype)
        ge[_PAD] = 0
        return g | {"e": ge}

    def train(self, texts, starts, ends, y, epochs: int = 9, rate: float = 3e-3, batch: int = 64, seed: int = SEED):
        g = np.random.default_rng(seed)
        m, v, t = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        for _ in range(epochs):
            order = g.permutation(len(y))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                x, inside = encoded([texts[j] for j in i], [starts[j] for j in i], [ends[j] for j in i])
                t += 1
                for k, d in self.gradients(x, inside, y[i].astype(np.float32)).items():
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def raw(self, texts, starts, ends) -> np.ndarray:
        """Scores before calibration; those of a length are taken together."""
        out = np.zeros(len(texts))
        order = np.argsort([e - s for s, e in zip(starts, ends)], kind="stable")
        for at in range(0, len(order), 128):
            i = order[at : at + 128]
            long = int(ends[i[-1]] - starts[i[-1]])
            for k in np.array_split(i, min(len(i), max(1, long // 2048))):  # long candidates a few at a time
                x, inside = encoded([texts[j] for j in k], [starts[j] for j in k], [ends[j] for j in k])
                out[k] = self.forward(x, inside)[0]
        return out

    def calibrate(self, raw: np.ndarray, y: np.ndarray, min_recall: float = MIN_RECALL):
        """Platt scaling by Newton's method; then the highest threshold that keeps the recall."""
        a, b = 1.0, 0.0
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
        t = np.where(y, hi, lo)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - t) * raw).sum() + 1e-3 * a, (p - t).sum()])
            hess = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(a), float(b)
        found = np.sort(self.probability(raw)[y])
        self.threshold = float(found[int(np.floor((1 - min_recall) * len(found)))])
        return self

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def fitted(findings: list[tuple[bytes, int, int, bool]] | None = None, min_recall: float = MIN_RECALL) -> Network:
    """A network trained on four fifths of the findings and calibrated on the rest."""
    findings = labelled_findings() if findings is None else findings
    texts, starts, ends, y = (list(c) for c in zip(*findings))
    y = np.array(y)
    cut = len(y) * 4 // 5
    net = Network().train(texts[:cut], starts[:cut], ends[:cut], y[:cut])
    return net.calibrate(net.raw(texts[cut:], starts[cut:], ends[cut:]), y[cut:], min_recall)


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("shown", pa.string()), ("score", pa.float64())])


def save(net: Network, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, slope=net.slope, shift=net.shift, threshold=net.threshold, **{f"p_{k}": v for k, v in net.p.items()})


def load(path: Path = WEIGHTS) -> Network:
    net = Network()
    with np.load(path) as f:
        net.p = {k[2:]: f[k] for k in f.files if k.startswith("p_")}
        net.slope, net.shift, net.threshold = (float(f[k]) for k in ("slope", "shift", "threshold"))
    return net


@cache
def default_network() -> Network:
    return load()


def scan(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, start, end, shown, score) of each finding."""
    net = default_network() if net is None else net

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.slices(batches):
            data, offsets, _ = C.text_buffers(batch.column(1))
            start, end, row = candidates(data, offsets)
            if not len(start):
                continue
            lo, hi = offsets[row], offsets[row + 1]
            texts = [data[max(a, s - CONTEXT) : min(b, e + CONTEXT)].tobytes() for a, b, s, e in zip(lo, hi, start, end)]
            left = np.minimum(start - lo, CONTEXT)
            score = net.probability(net.raw(texts, left.tolist(), (left + end - start).tolist()))
            good = np.flatnonzero(score >= net.threshold)
            if len(good):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = [chars[x[good]] - chars[lo[good]] for x in (start, end)]
                shown = [data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(start[good], end[good])]
                shown = [x[: min(SHOWN, len(x) // 4)] for x in shown]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[good])), pa.array(at[0]), pa.array(at[1]), pa.array(shown, pa.string()), pa.array(score[good])], schema=_FOUND)

    return C.doc_text(docs).mapInArrow(scanned, "doc_id long, start long, end long, shown string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


if __name__ == "__main__":
    began = time.perf_counter()
    save(fitted())
    print(f"trained in {time.perf_counter() - began:.0f} s: {WEIGHTS}, threshold {load().threshold:.4f}")
