"""Where Markdown files come from: directory walks, excludes, configuration, and what is refused.

Enumeration runs on the driver, over names only; contents are read where the tasks run. Spark's own file source can't
stand in for the walk: it leaves out names that begin with an underscore or a dot.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plainfold.functions.rules import MARKDOWN, REFUSED
from plainfold.options import Options, merged

CONFIG_NAMES = (".plainfold.yaml",)
CONFIG_BYTES, CONFIG_DEPTH, CONFIG_ALIASES = 1 << 20, 64, 50
CONFIG_KEYS = {"mode": str, "dialect": str, "max-width": int, "abbreviations": list, "exclude": list}
ALWAYS_EXCLUDED = (".git", "node_modules", "vendor")
HEAD = 8192


class ConfigError(ValueError):
    pass


def extension(path: str) -> str:
    name = os.path.basename(path)
    return name[name.rfind(".") + 1 :].lower() if "." in name else ""


def is_markdown(path: str) -> bool:
    return extension(path) in MARKDOWN


def repo_root(start: str) -> str | None:
    """The nearest folder upwards with a .git in it, be that a folder or a file."""
    at = os.path.abspath(start)
    at = at if os.path.isdir(at) else os.path.dirname(at)
    while True:
        if os.path.exists(os.path.join(at, ".git")):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


# --- excludes ----------------------------------------------------------------------------------------------------


def _glob(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    only_folders: bool


def ignore_patterns(lines: list[str]) -> list[Pattern]:
    """Lines of an ignore file; a pattern with a slash before its end holds from the file's own folder on."""
    out = []
    for line in lines:
        line = line.rstrip("\n\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        folders = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        out.append(Pattern(re.compile(("" if anchored else "(?:.*/)?") + body + r"\Z", re.S), negated, folders))
    return out


def _verdict(patterns: list[Pattern], rel: str, folder: bool) -> bool | None:
    """The last pattern that matches decides."""
    found = None
    for p in patterns:
        if (folder or not p.only_folders) and p.regex.match(rel):
            found = not p.negated
    return found


class Excluder:
    """Built-in names, then ignore files (nested ones win), then configured patterns; the first source that matches names it."""

    def __init__(self, root: str, configured: list[str] = (), ignore_files: bool = True):
        self.root, self.ignore_files = os.path.abspath(root), ignore_files
        self.configured = ignore_patterns(list(configured))
        self._read = cache(self._read)

    def _read(self, folder: str) -> list[Pattern]:
        try:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                return ignore_patterns(f.readlines())
        except OSError:
            return []

    def reason(self, path: str, folder: bool = False) -> str | None:
        rel = os.path.relpath(os.path.abspath(path), self.root).replace(os.sep, "/")
        if rel == "." or rel.startswith("../"):
            return None
        parts = rel.split("/")
        for name in parts:
            if name in ALWAYS_EXCLUDED:
                return f"built-in: {name}"
        for k in range(1, len(parts) + 1):  # what lies in an ignored folder stays ignored
            sub, is_dir = "/".join(parts[:k]), folder or k < len(parts)
            if self.ignore_files:
                for depth in range(k - 1, -1, -1):
                    got = _verdict(self._read(os.path.join(self.root, *parts[:depth])), "/".join(parts[depth:k]), is_dir)
                    if got is not None:
                        if got:
                            return ".gitignore"
                        break
            if _verdict(self.configured, sub, is_dir):
                return "config"
        return None


def walk(folder: str, excluder: Excluder) -> Iterator[str]:
    """Markdown files below a folder, sorted; links and whatever is excluded are passed over, excluded folders unseen."""
    for at, folders, files in os.walk(folder):
        folders[:] = sorted(d for d in folders if not os.path.islink(os.path.join(at, d)) and not excluder.reason(os.path.join(at, d), True))
        for name in sorted(files):
            path = os.path.join(at, name)
            if is_markdown(path) and not os.path.islink(path) and stat.S_ISREG(os.lstat(path).st_mode) and not excluder.reason(path):
                yield path


# --- configuration -----------------------------------------------------------------------------------------------


def load_config(path: str) -> dict:
    """A configuration file, strictly: known keys of the right kind, no deep nesting, few aliases, one MiB at most."""
    import yaml

    with open(path, "rb") as f:
        raw = f.read(CONFIG_BYTES + 1)
    if len(raw) > CONFIG_BYTES:
        raise ConfigError(f"{path}: larger than {CONFIG_BYTES} bytes")
    text = raw.decode("utf-8", "replace")
    depth = deepest = 0
    for c in text:
        depth += (c in "[{") - (c in "]}")
        deepest = max(deepest, depth)
    deepest = max([deepest, *((len(x) - len(x.lstrip(" "))) // 2 for x in text.split("\n"))])
    if deepest > CONFIG_DEPTH or len(re.findall(r"(?<![\w*])\*\w", text)) > CONFIG_ALIASES:
        raise ConfigError(f"{path}: nested too deeply, or too many aliases")
    try:
        got = yaml.safe_load(text) or {}
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(got, dict) or set(got) - set(CONFIG_KEYS):
        raise ConfigError(f"{path}: unknown keys {sorted(map(str, set(got) - set(CONFIG_KEYS))) if isinstance(got, dict) else got!r}")
    for k, v in got.items():
        if not isinstance(v, CONFIG_KEYS[k]) or isinstance(v, bool):
            raise ConfigError(f"{path}: {k} must be {CONFIG_KEYS[k].__name__}")
    return got


def boundary_of(root: str | None) -> str | None:
    """How far up a configuration may lie: the repository, else the user's home; None, anywhere, without either."""
    home = os.path.expanduser("~")
    return root or (home if home != "~" else None)


def discover(folder: str, boundary: str | None) -> str | None:
    """The nearest configuration upwards, no further than the boundary (which may not lie above the folder at all)."""
    at = os.path.abspath(folder)
    while True:
        for name in CONFIG_NAMES:
            if os.path.isfile(os.path.join(at, name)):
                return os.path.join(at, name)
        up = os.path.dirname(at)
        if up == at or boundary is not None and at == os.path.abspath(boundary):
            return None
        at = up


def options_for(path: str, flags: dict, boundary: str | None, config: str | None = None) -> tuple[Options, list[str]]:
    """The options of one file, and the patterns that its configuration excludes."""
    found = config or discover(os.path.dirname(os.path.abspath(path)), boundary)
    got = _cached_config(found, os.stat(found).st_mtime_ns) if found else {}
    if isinstance(got, ConfigError):
        raise got
    return merged(flags, {k.replace("-", "_"): v for k, v in got.items() if k != "exclude"}), got.get("exclude", [])


@cache
def _cached_config(path: str, changed: int) -> dict | ConfigError:
    """Read once as long as the file stays as it is; errors too."""
    try:
        return load_config(path)
    except ConfigError as e:
        return e


# --- contents ----------------------------------------------------------------------------------------------------


def irregular(path: str) -> str | None:
    """What a path is, if not a regular file."""
    mode = os.lstat(path).st_mode
    for test, name in ((stat.S_ISLNK, "symbolic link"), (stat.S_ISDIR, "directory"), (stat.S_ISFIFO, "pipe"), (stat.S_ISSOCK, "socket")):
        if test(mode):
            return name
    return None if stat.S_ISREG(mode) else "device"


def refusal(path: Column, content: Column) -> Column:
    """Why a file isn't Markdown, or null: its type, a NUL or broken UTF-8 among its first 8192 bytes."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    cuts = [F.is_valid_utf8(F.substring(content, 1, HEAD - k).cast("string")) for k in range(4)]
    valid = cuts[0] | ((F.octet_length(content) > HEAD) & (cuts[1] | cuts[2] | cuts[3]))
    return (
        F.when(~ext.isin(*MARKDOWN) & ext.isin(*REFUSED), F.concat(F.lit("not Markdown: ."), ext))
        .when(F.instr(F.substring(content, 1, HEAD).cast("string"), "\0") > 0, "binary: it holds a NUL")
        .when(~valid, "not UTF-8")
    )


def refused_text(content: bytes) -> str | None:
    """As refusal, for contents without a path."""
    if b"\0" in content[:HEAD]:
        return "binary: it holds a NUL"
    try:
        content.decode()
    except UnicodeDecodeError:
        return "not UTF-8"
    return None


def read(spark: SparkSession, paths: list[str], explicit: frozenset[str] = frozenset()) -> DataFrame:
    """(path, explicit, content) of files, read by the tasks."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                with open(batch.column(0)[k].as_py(), "rb") as f:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([f.read()], pa.binary())], names=["path", "explicit", "content"])

    schema = "path string, explicit boolean"
    if not paths:
        return spark.createDataFrame([], schema + ", content binary")
    rows = [(p, p in explicit) for p in paths]
    table = spark.createDataFrame(spark.sparkContext.parallelize(rows, min(len(rows), spark.sparkContext.defaultParallelism * 4)), schema)
    return table.mapInArrow(load, schema + ", content binary")


