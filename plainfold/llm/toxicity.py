"""Toxicity by two Kneser-Ney word models, one of labelled toxic documents and one of ordinary ones.

Bigrams are interpolated with words, and these with counts that both classes share. The discounts are absolute: what a
class has seen in no more ways than the discount falls back, and what discounting takes from the words of both classes
makes up the shared counts, so that rare expressions speak for neither class. The larger class has a larger discount, in
proportion to its counts: a word must then be as frequent in either class to speak for it. Each language has models of
its own, else a language that is commoner among toxic documents would itself be evidence; a document whose language lacks
labelled documents of either class is scored by models of all languages together. All orders use continuation
counts (in how many ways something is preceded), which copies of a passage don't raise. A document's
score is the difference of its two log-likelihoods over its length, (log P(toxic) - log P(ordinary)) / (words + PRIOR_WORDS);
at or above the threshold it is toxic. The threshold is the one of best F1 on labelled documents held out from the counts.

Counts cover every labelled document, up to ``max_docs`` a class; a class that has more is sampled by a hash of doc_id.
This bounds the model, which every task holds; scoring covers all documents and whole texts. What is counted is sent
once, by bigram: the counts of a language and those of all together are taken from the same sorted rows.

Defined results: a null language is one of its own. A null or empty text, and one without words, scores 0 and is not
toxic. A document labelled twice is toxic if any label says so; null labels are left out. Without labels of both classes
nothing is toxic, nor where no toxic document is held out (the threshold is infinite then). Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plainfold.sources.tables import table

from . import common as C

MAX_DOCS, HELD_OUT, DISCOUNT, PAIR_DISCOUNT, PRIOR_WORDS = 20_000, 5, 4, 8, 100
POOLED = np.uint64(0x5DEECE66D1234567)  # stands for all languages together
START = np.uint64(0x9E3779B9)  # stands before a document's first word
GATHERED, SENT = 1 << 20, 1 << 16  # words among which a task drops copies, and rows it passes on at once


def _languages(col: pa.Array) -> np.ndarray:
    d = col.fill_null("").dictionary_encode()
    return np.array([xxhash.xxh3_64_intdigest(x) for x in d.dictionary.to_pylist()], np.uint64)[np.asarray(d.indices)]


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """32-bit hashes of words, of the word before each (at a start, START), rows, and which are first."""
    words, row = C.letter_words(data, offsets)
    if not len(words):
        z = np.zeros(0, np.uint64)
        return z, z, row, np.zeros(0, bool)
    codes, distinct = C.coded_words(words)
    w = (C.mix(C.word_hashes(distinct)) >> np.uint64(32))[codes]
    first = np.diff(row, prepend=-1) != 0
    before = np.empty_like(w)
    before[1:] = w[:-1]
    before[first] = START
    return w, before, row, first


def labelled(labels: DataFrame, max_docs: int = MAX_DOCS) -> tuple[DataFrame, float]:
    """(doc_id, toxic, held) of the labelled documents that are used, about ``max_docs`` a class at most; and how many
    ordinary ones one of these stands for, against a toxic one."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    share = {c: min(1.0, max_docs / n) for c, n in sizes.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    used = own.where(place < F.when(F.col("toxic") == 1, F.lit(share.get(1, 1.0))).otherwise(F.lit(share.get(0, 1.0))) * (1 << 20))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(HELD_OUT)) == 0
    return used.select("doc_id", (F.col("toxic") == 1).alias("toxic"), held.alias("held")), share.get(1, 1.0) / share.get(0, 1.0)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _marked(key: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Words, contexts or pairs of a language, as the model's tables hold them."""
    return C.mix(key ^ lang)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    """Rows without copies, in order of the first column, then of the second, and so on."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return [c[new] for c in cols]


def _sent(names: list[str], cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in cols], names=names)
    for at in range(0, batch.num_rows, SENT):
        yield batch.slice(at, SENT)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word with the two before it, its document's language and class. Words are the same in all languages, so that
    counts of all together need no rows of their own; sorted rows take less room in a shuffle."""
    held, n = [], 0
    for batch in C.slices(batches):
        data, offsets, _ = C.text_buffers(batch.column(1))
        w, before, row, first = _tokens(data, offsets)
        third = np.zeros_like(before)
        third[1:] = before[:-1]
        third[first] = 0
        held.append((_languages(batch.column(2))[row], np.asarray(batch.column(3))[row], before << np.uint64(32) | w, third))
        n += len(w)
        if n >= GATHERED:
            yield from _sent(["lang", "toxic", "key", "third"], _distinct(*map(np.concatenate, zip(*held))))
            held, n = [], 0
    if n:
        yield from _sent(["lang", "toxic", "key", "third"], _distinct(*map(np.concatenate, zip(*held))))


def _tally(key: np.ndarray, lang: np.ndarray, toxic: np.ndarray, third: np.ndarray) -> list[np.ndarray]:
    """(key, lang, t, o): after how many words each key comes, in either class."""
    key, lang, toxic, third = _distinct(key, lang, toxic, third)
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (lang[1:] != lang[:-1])])
    t = np.add.reduceat(toxic.astype(np.int64), start)
    return [key[start], lang[start], t, np.diff(start, append=len(key)) - t]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bigrams from rows in order of their keys: by language, and for all together where a key is in several;
    ``alone`` are keys in one language only, whose counts are those of all together too."""

    def counted(key, lang, toxic, third):
        own = _tally(key, lang, toxic, third)
        alone = np.r_[True, own[0][1:] != own[0][:-1]] & np.r_[own[0][1:] != own[0][:-1], True]
        yield from _sent(["key", "lang", "t", "o", "alone"], [*own, alone])
        mixed = np.isin(key, own[0][~alone])
        if mixed.any():
            all_of = _tally(key[mixed], np.full(int(mixed.sum()), POOLED), toxic[mixed], third[mixed])
            yield from _sent(["key", "lang", "t", "o", "alone"], [*all_of, np.zeros(len(all_of[0]), bool)])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns]
        cols = [c.view(np.uint64) if c.dtype == np.int64 else c for c in cols]
        n += batch.num_rows
        # the last key may go on in the next batch
        cut = int(np.searchsorted(cols[0].view(np.int64), cols[0].view(np.int64)[-1])) if n >= SENT else 0
        new = cut > 0 or bool(held) and held[-1][0][-1] != cols[0][0]
        if n >= SENT and new:
            whole = [*held, [c[:cut] for c in cols]]
            yield from counted(*map(np.concatenate, zip(*whole)))
            held, n = [], batch.num_rows - cut
        held.append([c[cut:] for c in cols])
    if held:
        yield from counted(*map(np.concatenate, zip(*held)))


def bigrams(text: DataFrame) -> DataFrame:
    """(key, lang, t, o) of (doc_id, text, lang, toxic), for each language and for POOLED.

    The words before a bigram meet in one place, whatever their language: one shuffle gives counts of both kinds."""
    grams = text.mapInArrow(_grams, "lang long, toxic boolean, key long, third long").select("key", "lang", "toxic", "third")
    counts = grams.repartition("key").sortWithinPartitions("key").mapInArrow(_counts, "key long, lang long, t long, o long, alone boolean")
    counts = C.materialise(counts, "bigrams")
    pooled = F.lit(int(POOLED.view(np.int64)))
    return counts.select("key", F.explode(F.when(F.col("alone"), F.array("lang", pooled)).otherwise(F.array("lang"))).alias("lang"), "t", "o")


class Model:
    """log P(toxic) - log P(ordinary) of a word after another: ``seen`` pairs have their own, others back[w] + open[h]."""

    def __init__(self, words, back, unseen, contexts, opened, pairs, seen):
        self.words, self.back, self.unseen, self.contexts, self.opened, self.pairs, self.seen = words, back, unseen, contexts, opened, pairs, seen

    def scores(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        lang = np.where(np.isin(lang, self.unseen[0]), lang, POOLED)
        w, before, row, _ = _tokens(data, offsets)
        own = lang[row]
        uw, iw = np.unique(_marked(w, own), return_inverse=True)
        at, found = _find(self.words, uw)
        at, found = at[iw], found[iw]
        x = self.unseen[1][_find(self.unseen[0], lang)[0]][row]
        x[found] = self.back[at[found]]
        ub, ib = np.unique(_marked(before, own), return_inverse=True)
        at, found = _find(self.contexts, ub)
        opened = np.zeros(len(ub))
        opened[found] = self.opened[at[found]]
        x += opened[ib]
        at, found = _find(self.pairs, _marked(before << np.uint64(32) | w, own))
        x[found] = self.seen[at[found]]
        words = np.bincount(row, minlength=n)
        return np.bincount(row, weights=x, minlength=n) / (words + PRIOR_WORDS), words


def estimate(pairs: DataFrame) -> Model | None:
    """The model from bigram counts (key, lang, t, o).

    Only words and contexts that some count beyond a discount sets apart come to the driver; all others have the value
    of an unseen word, or none, which totals by language give."""
    h, w = F.shiftrightunsigned("key", 32).alias("h"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("w")
    some = lambda c: F.sum((F.col(c) > 0).cast("long")).alias(c)
    words = C.materialise(pairs.groupBy(w, "lang").agg(some("t"), some("o")), "continuations")
    langs = words.groupBy("lang").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).where("t > 0 and o > 0").toPandas()
    if not len(langs):
        return None
    least = langs[["t", "o"]].min(axis=1)
    for c in "to":
        langs[f"d{c}"], langs[f"p{c}"] = DISCOUNT * langs[c] / least, PAIR_DISCOUNT * langs[c] / least
    sizes = F.broadcast(pairs.sparkSession.createDataFrame(langs[["lang", "dt", "do", "pt", "po"]]))  # a row a language
    lows = lambda prefix: [F.sum(F.least(F.col(c).cast("double"), F.col(prefix + c))).alias(f"{c}_low") for c in "to"]
    langs = langs.merge(words.join(sizes, "lang").groupBy("lang").agg(*lows("d")).toPandas(), on="lang")
    langs = langs.iloc[np.argsort(langs["lang"].to_numpy(np.int64).view(np.uint64))].reset_index(drop=True)
    often = pairs.join(sizes, "lang").where("t > pt or o > po").select("key", "lang", "t", "o")
    ends = often.select(w, "lang").distinct()
    cont = words.join(sizes, "lang").where("t > dt or o > do").select("w", "lang", "t", "o").unionByName(words.join(ends, ["w", "lang"], "left_semi")).distinct().toPandas()
    starts = often.select(h, "lang").distinct()
    ctx = pairs.join(sizes, "lang").select(h, "lang", "t", "o", "pt", "po").join(starts, ["h", "lang"], "left_semi").groupBy("h", "lang").agg(*[F.sum(c).alias(c) for c in "to"], *lows("p")).toPandas()
    often = often.toPandas()
    unsigned = lambda table, c: table[c].to_numpy(np.int64).view(np.uint64)
    known = unsigned(langs, "lang")
    of = lambda table: _find(known, unsigned(table, "lang"))[0]

    def ordered(table, c):
        keys, first = np.unique(_marked(unsigned(table, c), unsigned(table, "lang")), return_index=True)  # of two that share a hash, one
        return keys, table.iloc[first]

    vocabulary, cont = ordered(cont, "w")
    contexts, ctx = ordered(ctx, "h")
    keys, often = ordered(often, "key")
    pair, lang = unsigned(often, "key"), unsigned(often, "lang")
    hi, _ = _find(contexts, _marked(pair >> np.uint64(32), lang))
    wi, _ = _find(vocabulary, _marked(pair & np.uint64(0xFFFFFFFF), lang))
    number = lambda table, c: table[c].to_numpy(float)
    wl, cl, kl = of(cont), of(ctx), of(often)
    freed = number(langs, "t_low") + number(langs, "o_low") + 1  # one for words never seen
    shared = sum(np.minimum(number(cont, c), number(langs, "d" + c)[wl]) for c in "to") / freed[wl]
    back, unseen, opened, seen = np.zeros(len(cont)), np.zeros(len(langs)), np.zeros(len(ctx)), np.zeros(len(often))
    for c, sign in (("t", 1), ("o", -1)):
        total = number(langs, c)
        rest = number(langs, c + "_low") / total  # what discounting frees goes to the shared counts
        p = np.maximum(number(cont, c) - number(langs, "d" + c)[wl], 0) / total[wl] + rest[wl] * shared
        back += sign * np.log(p)
        unseen += sign * np.log(rest)
        size = number(ctx, c)
        left = np.where(size > 0, number(ctx, c + "_low") / np.maximum(size, 1), 1.0)
        opened += sign * np.log(left)
        m = number(often, c)
        if len(often):
            seen += sign * np.log(np.maximum(m - number(langs, "p" + c)[kl], 0) / np.maximum(size[hi], 1) + left[hi] * p[wi])
    return Model(vocabulary, back, (known, unseen), contexts, opened, keys, seen)


_SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_words", pa.int64())])


def _scorer(shipped):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in C.slices(batches):
            data, offsets, _ = C.text_buffers(batch.column(1))
            s, n = model.scores(data, offsets, _languages(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(n.astype(np.int64))], schema=_SCORED)

    return score


def best_threshold(score: np.ndarray, toxic: np.ndarray, ordinary_weight: float = 1.0) -> float:
    """The score from which on calling documents toxic has the best F1, halfway to the next lower score.

    An ordinary document stands for ``ordinary_weight`` of them, as many as the choice of documents left out."""
    order = np.argsort(-score, kind="stable")
    s, y = score[order], toxic[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.cumsum(np.where(y, 1, ordinary_weight)) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1  # no cut between equal scores
    k = int(f1.argmax())
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


class Detector:
    """Trained once; ``scores`` and ``toxic`` are then plans over any documents."""

    def __init__(self, docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS):
        self.threshold, self.shipped, self.held_out = float("inf"), None, None
        used, weight = labelled(labels, max_docs)
        used = C.materialise(used, "labelled")
        # the few labelled texts, told apart in the JVM: 2 max_docs identifiers at most
        text = _texts(docs).join(F.broadcast(used), "doc_id")
        model = estimate(bigrams(text.where("not held").select("doc_id", "text", "lang", "toxic")))
        if model is None:
            return
        self.shipped = docs.sparkSession.sparkContext.broadcast(model)
        scored = text.where("held").select("doc_id", "text", "lang").mapInArrow(_scorer(self.shipped), "doc_id long, score double, n_words long")
        out = scored.join(F.broadcast(used), "doc_id").select("doc_id", "score", "n_words", "toxic").toPandas()
        if len(out):
            self.held_out = out
            if out["toxic"].any():
                self.threshold = best_threshold(out["score"].to_numpy(), out["toxic"].to_numpy(bool), weight)

    def scores(self, docs: DataFrame) -> DataFrame:
        if self.shipped is None:
            return C.doc_text(docs).select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"))
        return _texts(docs).mapInArrow(_scorer(self.shipped), "doc_id long, score double, n_words long")

    def toxic(self, docs: DataFrame) -> DataFrame:
        return self.scores(docs).where((F.col("score") >= self.threshold) & (F.col("n_words") > 0))


def query(spark, sf_dir: str) -> DataFrame:
    """The toxic ones among all documents, with their scores."""
    docs = table(spark, sf_dir, "documents")
    found = Detector(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.toxic(docs)
