"""Quality rules by distribution divergence.

A document's histogram of character classes, and its histogram of its language's common words, are compared with the
language's own reference (all documents of that language, pooled) by Jensen-Shannon distance. Short documents are not
judged by a histogram that they cannot fill.

Defined results: a null text counts as empty, an empty or short text is kept, unjudged (``judged`` false). A null
language is a language of its own. Repeated rows are each judged, alike. A reference that is empty judges nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plainfold.sources.tables import table

from . import common as C

MIN_CHARS, MIN_WORDS = 100, 60
#: A distance may reach base + slope / sqrt(length): short texts stray further from the reference by chance alone.
CHAR_BASE, CHAR_SLOPE, WORD_BASE, WORD_SLOPE = 0.12, 3.5, 0.10, 2.9
COMMON_WORDS = 40
CLASSES = ("lower", "upper", "digit", "space", "punct", "other")

_CLASS = np.full(256, 5, np.int64)  # other ASCII
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0x80:0xC0] = 6  # continuation bytes are not characters
_CLASS[0xC0:] = 0  # any other letter


def char_histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Characters of each class by row."""
    n = len(offsets) - 1
    kind = _CLASS[data]
    if len(data) > 1:
        kind[:-1][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)] = 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(row * 7 + kind, minlength=n * 7).reshape(n, 7)[:, :6]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance, base 2; rows of p or q that sum to 0 give 0."""
    ps, qs = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    p, q = p / np.maximum(ps, 1), q / np.maximum(qs, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((ps[:, 0] > 0) & (qs[:, 0] > 0), np.sqrt(np.maximum((a + b) / 2, 0)), 0.0)


def _lang_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_COUNTS = pa.schema([("lang", pa.string()), ("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.slices(batches):
        langs = batch.column(0).dictionary_encode()
        lang, names = np.asarray(langs.indices), langs.dictionary.to_pylist()
        data, offsets, _ = C.text_buffers(batch.column(1))
        chars = char_histograms(data, offsets)
        codes, distinct = C.coded_words(words_rows[0]) if (words_rows := C.letter_words(data, offsets)) and len(words_rows[0]) else (np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        of = lang[words_rows[1]] if len(codes) else np.zeros(0, np.int64)
        both, n = np.unique(of.astype(np.int64) * max(len(distinct), 1) + codes, return_counts=True)
        out_lang = [names[i] for i in range(len(names)) for _ in CLASSES]
        yield C.batch_of(_COUNTS, out_lang, list(range(6)) * len(names), pa.nulls(len(out_lang), pa.binary()), np.concatenate([chars[lang == i].sum(0) for i in range(len(names))]).astype(np.int64))
        if len(both):
            word = distinct.take(pa.array(both % len(distinct))).cast(pa.binary())
            by = pa.array(names, pa.string()).take(pa.array(both // len(distinct)))
            yield pa.RecordBatch.from_arrays([by, pa.nulls(len(both), pa.int32()), word, pa.array(n.astype(np.int64))], schema=_COUNTS)


def references(docs: DataFrame, common: int = COMMON_WORDS) -> dict[str, tuple[np.ndarray, list[bytes], np.ndarray]]:
    """By language: characters by class, its most frequent words, and their counts with all others' count at the end.

    Counted over all documents. One row a language and class, and ``common`` a language, come to the driver."""
    counts = C.materialise(_lang_text(docs).mapInArrow(_count, "lang string, class int, word binary, n long").groupBy("lang", "class", "word").agg(F.sum("n").alias("n")), "quality-counts")
    words = counts.where("word is not null")
    top = words.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common)
    chars, rest = {}, {}
    for r in counts.where("word is null").collect():
        chars.setdefault(r["lang"], np.zeros(6))[r["class"]] = r["n"]
    for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect():
        rest[r["lang"]] = r["n"]
    best: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        best.setdefault(r["lang"], []).append((bytes(r["word"]), r["n"]))
    out = {}
    for lang, c in chars.items():
        pairs = best.get(lang, [])
        n = [x for _, x in pairs]
        out[lang] = (c, [w for w, _ in pairs], np.array([*n, rest.get(lang, 0) - sum(n)], float))
    return out


class Judge:
    """Distances of batches of documents to the references."""

    def __init__(self, refs):
        self.refs = refs

    def __call__(self, langs: pa.Array, text: pa.Array):
        data, offsets, _ = C.text_buffers(text)
        n = len(offsets) - 1
        chars = char_histograms(data, offsets).astype(float)
        words, row = C.letter_words(data, offsets)
        n_words = np.bincount(row, minlength=n)
        codes, distinct = C.coded_words(words)
        enc = langs.dictionary_encode()
        lang, names = np.asarray(enc.indices), enc.dictionary.to_pylist()
        char_d, word_d = np.zeros(n), np.zeros(n)
        for i, name in enumerate(names):
            if name not in self.refs:
                continue
            ref, common, counts = self.refs[name]
            at = np.flatnonzero(lang == i)
            char_d[at] = js_distance(chars[at], np.repeat(ref[None], len(at), 0))
            if not common:
                continue
            k = len(common)
            found = pc.index_in(distinct, value_set=pa.array(common, pa.large_binary())).fill_null(k) if len(distinct) else pa.array([], pa.int32())
            pick = lang[row] == i
            which = np.asarray(found)[codes[pick]]
            place = np.full(n, -1)
            place[at] = np.arange(len(at))
            hist = np.bincount(place[row[pick]] * (k + 1) + which, minlength=len(at) * (k + 1)).reshape(len(at), k + 1)
            word_d[at] = js_distance(hist.astype(float), np.repeat(counts[None], len(at), 0))
        return chars.sum(1).astype(np.int64), n_words, char_d, word_d


_VERDICT = T.StructType([T.StructField("n_chars", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("judged", T.BooleanType()), T.StructField("keep", T.BooleanType())])


def verdict(refs, min_chars=MIN_CHARS, min_words=MIN_WORDS, char_limit=(CHAR_BASE, CHAR_SLOPE), word_limit=(WORD_BASE, WORD_SLOPE)):
    """A column function of (lang, text)."""
    judge = Judge(refs)

    @F.arrow_udf(_VERDICT)
    def judged(lang: pa.Array, text: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([lang, text], names=["lang", "text"])
        parts = [judge(s.column(0), s.column(1)) for s in C.slices([batch])]
        if not parts:
            return pa.array([], pa.struct([(f.name, pa.bool_() if f.name in ("judged", "keep") else pa.float64() if "distance" in f.name else pa.int64()) for f in _VERDICT]))
        chars, words, cd, wd = (np.concatenate(x) for x in zip(*parts))
        by_char, by_word = chars >= min_chars, words >= min_words
        far = [d > base + slope / np.sqrt(np.maximum(n, 1)) for d, n, (base, slope) in ((cd, chars, char_limit), (wd, words, word_limit))]
        keep = ~((by_char & far[0]) | (by_word & far[1]))
        return pa.StructArray.from_arrays([pa.array(chars), pa.array(words.astype(np.int64)), pa.array(cd), pa.array(wd), pa.array(by_char | by_word), pa.array(keep)], names=[f.name for f in _VERDICT])

    return C.once(judged)


def _inputs(row: str):
    return F.coalesce(F.col(f"{row}lang").cast("string"), F.lit("")), F.coalesce(F.col(f"{row}text").cast("string"), F.lit(""))


def judge(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, the distances and the verdict for every row of docs."""
    v = verdict(references(docs), **limits)
    return docs.select(F.col("doc_id"), v(*_inputs("")).alias("v")).select("doc_id", "v.*")


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules don't reject, with all their columns."""
    v = verdict(references(docs), **limits)
    return C.unpacked(C.packed(docs).withColumn("v", v(*_inputs("row."))).where("v.keep"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs).where("keep").select("doc_id", F.round("char_distance", 3).alias("char_distance"), F.round("word_distance", 3).alias("word_distance"), "judged")


_CHAR_SQL = [r"[^A-ZÀ-ÖØ-Þ0-9\x09-\x0d .,;:!?'\x22()\-\x00-\x08\x0e-\x1f#$%&*+/<=>@\[\]\x5c^_`{|}~\x7f]", r"[A-ZÀ-ÖØ-Þ]", r"[0-9]", r"[\x09-\x0d ]", r"[.,;:!?'\x22()\-]", r"[\x00-\x08\x0e-\x1f#$%&*+/<=>@\[\]\x5c^_`{|}~\x7f]"]


def _oracle() -> str:
    quoted = [p.replace("'", "''") for p in _CHAR_SQL]
    classes = " union all ".join(f"select rid, lang, {i} as k, length(text) - length(regexp_replace(text, '{p}', '', 'g')) as n from d" for i, p in enumerate(quoted))

    def distance(doc: str, ref: str) -> str:
        return f"""select rid, sqrt(greatest(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 0)) as dist from
          (select s.rid, coalesce({doc}.n, 0) / s.total as p, {ref}.share as q from {doc}_sum s join {ref} on {ref}.lang = s.lang left join {doc} on {doc}.rid = s.rid and {doc}.k = {ref}.k where s.total > 0) group by rid"""

    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
    c as ({classes}), c_sum as (select rid, lang, sum(n)::double as total from c group by all),
    c_ref as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) as share from c group by lang, k),
    w as (select rid, lang, unnest(regexp_extract_all(lower(text), '[^\\x00-\\x60\\x7b-\\x7f]+')) as word from d),
    wn as (select lang, word, count(*) as n from w group by all),
    ranked as (select *, row_number() over (partition by lang order by n desc, encode(word)) as r from wn),
    w_ref as (select lang, k, sum(n) / sum(sum(n)) over (partition by lang) as share from (select lang, n, least(r, {COMMON_WORDS} + 1) as k from ranked) group by lang, k),
    x as (select w.rid, coalesce(ranked.r, {COMMON_WORDS} + 1) as k, count(*) as n from w left join ranked on ranked.lang = w.lang and ranked.word = w.word and ranked.r <= {COMMON_WORDS} group by all),
    x_sum as (select w.rid, w.lang, count(*)::double as total from w group by all),
    cd as ({distance('c', 'c_ref')}), wd as ({distance('x', 'w_ref')})
    select doc_id, round(coalesce(cd.dist, 0), 3) as char_distance, round(coalesce(wd.dist, 0), 3) as word_distance,
      coalesce(c_sum.total, 0) >= {MIN_CHARS} or coalesce(x_sum.total, 0) >= {MIN_WORDS} as judged
    from d left join cd using (rid) left join wd using (rid) left join c_sum on c_sum.rid = d.rid left join x_sum on x_sum.rid = d.rid
    where not (coalesce(c_sum.total, 0) >= {MIN_CHARS} and coalesce(cd.dist, 0) > {CHAR_BASE} + {CHAR_SLOPE} / sqrt(c_sum.total)) and not (coalesce(x_sum.total, 0) >= {MIN_WORDS} and coalesce(wd.dist, 0) > {WORD_BASE} + {WORD_SLOPE} / sqrt(x_sum.total))"""


ORACLE = _oracle()
