"""Language identification by words first, then ever shorter character n-grams.

A known word adds its log frequency in each language. An unseen word falls back to the n-grams of the longest order of
which any is known (ORDERS, longest first, of the word between boundary marks): it adds the mean of their log
frequencies and a penalty for each order stepped down. All languages are compared by the sum.

The model is fitted on a bounded sample of labelled rows: about PER_LANGUAGE documents of each language, chosen by a
hash of doc_id (the share is PER_LANGUAGE over the language's count, which is taken over all rows). Words and n-grams are
counted in Spark; a language keeps its most frequent ones, and what it does not keep counts as not occurring there. How
many it keeps is WORDS words and GRAMS n-grams, or less with many languages, so that ENTRIES of each are kept in all: the
model's size depends neither on the input nor on the number of languages. No label is left out. Predictions see every
whole text, and nothing but the text; they are map-only.

Defined results: a text that is null or has no letter gets und with score 0; so do all texts if there is nothing to
learn from. Ties go to the language that sorts first. Null labels and null identifiers are never learned from. An empty
table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ._common import drop_folder, fresh_name, map_texts, materialise, small, work_folder

ORDERS = (5, 4, 3, 2, 1)
PER_LANGUAGE, WORDS, GRAMS = 800, 50_000, 60_000
#: Words, and n-grams, that all languages keep together; times that a word or n-gram must occur in a language.
ENTRIES, LEAST = 1_000_000, 2
#: Added for each order that an unseen word steps down.
STEP = math.log(0.4)
#: Numbers (words times languages) that a task remembers of unseen words, and those that it looks at together.
MEMO, TOGETHER = 500_000, 200_000
UNKNOWN = "und"
_word = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(max(1, len(marked) - n + 1))]


class Logs:
    """Log frequencies, add-one smoothed, of names in languages, sparse: a name has a slice of (language, log of count + 1);
    where a language is not in it the log is 0. floor is what all names of a language share: minus the log of all counts."""

    def __init__(self, names: list[str], bounds: np.ndarray, langs: np.ndarray, logs: np.ndarray, floor: np.ndarray):
        self.names, self.bounds, self.langs, self.logs, self.floor = names, bounds, langs, logs, floor
        self.row = {x: i for i, x in enumerate(names)}

    @staticmethod
    def of(rows: list[tuple[int, str, int]], totals: np.ndarray) -> Logs:
        """rows: (language, name, count); totals: the sum of all counts of each language, kept or not."""
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        new = [i for i, r in enumerate(rows) if i == 0 or rows[i - 1][1] != r[1]]
        langs = np.fromiter((r[0] for r in rows), np.int32, len(rows))
        logs = np.log1p(np.fromiter((r[2] for r in rows), float, len(rows)))
        return Logs([rows[i][1] for i in new], np.array([*new, len(rows)]), langs, logs, -np.log(totals + max(1, len(new))))

    def summed(self, rows: np.ndarray, weights: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
        """For each group and language the weighted sum over the group's names of what they have above the floor."""
        first, n = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        cells = np.repeat(groups * len(self.floor), n) + self.langs[at]
        return np.bincount(cells, self.logs[at] * np.repeat(weights, n), n_groups * len(self.floor)).reshape(n_groups, len(self.floor))

    def parts(self) -> tuple:
        return self.names, self.bounds, self.langs, self.logs, self.floor


class LanguageModel:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, langs: list[str], words: Logs, grams: Logs):
        self.langs, self.words, self.grams = langs, words, grams

    @staticmethod
    def of_rows(rows) -> LanguageModel:
        """The model of (lang, text) in memory, as fit makes it in Spark."""
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in rows:
            words[lang].update(words_of(text))
        langs = sorted(k for k in words if words[k])
        grams = {k: Counter(g for w in words[k] for g in all_grams(w)) for k in langs}

        def logs(counts, most):
            kept = [(j, x, n) for j, k in enumerate(langs) for x, n in sorted(counts[k].items(), key=lambda p: (-p[1], p[0]))[:most] if n >= LEAST]
            return Logs.of(kept, np.array([float(sum(counts[k].values())) for k in langs]))

        return LanguageModel(langs, logs(words, kept_of(WORDS, langs)), logs(grams, kept_of(GRAMS, langs)))

    def unseen(self, word: str) -> np.ndarray:
        """What a word that is not known adds to each language."""
        return self.all_unseen([word])[0]

    def all_unseen(self, words: list[str]) -> np.ndarray:
        """A row a word, with what it adds to each language; the n-grams of many words are summed together."""
        out, begun, found = np.empty((len(words), len(self.langs))), 0, []
        row, most, waiting = self.grams.row.get, max(1, TOGETHER // max(1, len(self.langs))), 0
        for at, word in enumerate(words, 1):
            for n in ORDERS:
                known = [i for i in map(row, grams_of(word, n)) if i is not None]
                if known:
                    break
            found.append((known, ORDERS.index(n) if known else len(ORDERS)))
            waiting += len(known)
            if waiting >= most or at == len(words):
                sizes = np.array([len(k) for k, _ in found])
                sums = self.grams.summed(np.fromiter(chain.from_iterable(k for k, _ in found), np.int64, waiting), np.repeat(1 / np.maximum(sizes, 1), sizes), np.repeat(np.arange(len(found)), sizes), len(found))
                out[begun:at] = np.array([d for _, d in found])[:, None] * STEP + np.where(sizes[:, None] > 0, self.grams.floor, 0) + sums
                begun, found, waiting = at, [], 0
        return out


def kept_of(most: int, langs: list[str]) -> int:
    return max(1, min(most, ENTRIES // max(1, len(langs))))


def all_grams(word: str) -> list[str]:
    return [g for n in ORDERS for g in grams_of(word, n)]


class Predictor:
    """Predicts by a model, many texts at a time; remembers what unseen words add, MEMO numbers at most."""

    def __init__(self, model: LanguageModel):
        self.model, self.seen = model, {}
        n_langs = max(1, len(model.langs))
        self.memo, self.most = np.zeros((max(1, MEMO // n_langs), len(model.langs))), max(1, min(MEMO, TOGETHER) // n_langs)

    def _unseen(self, words: list[str]) -> np.ndarray:
        """The row in the memo of each of these unseen words, self.most at most."""
        if len(self.seen) + len(words) > len(self.memo):
            self.seen = {}
        if new := [w for w in dict.fromkeys(words) if w not in self.seen]:
            at = len(self.seen)
            self.memo[at : at + len(new)] = self.model.all_unseen(new)
            self.seen.update(zip(new, range(at, at + len(new)), strict=True))
        return np.array([self.seen[w] for w in words])

    def _totals(self, counts: list[Counter]) -> np.ndarray:
        """For each text's words and their numbers, the sum by language."""
        n, n_langs, words = len(counts), len(self.model.langs), [*chain.from_iterable(counts)]
        times = np.fromiter(chain.from_iterable(c.values() for c in counts), float, len(words))
        text, total = np.repeat(np.arange(n), [len(c) for c in counts]), np.zeros((n, n_langs))
        for at in range(0, len(words), self.most):
            part, weights, groups = words[at : at + self.most], times[at : at + self.most], text[at : at + self.most]
            rows = [*map(self.model.words.row.get, part)]
            new = [i for i, r in enumerate(rows) if r is None]
            if new:
                memo = self.memo[self._unseen([part[i] for i in new])] * weights[new][:, None]
                cells = (groups[new] * n_langs)[:, None] + np.arange(n_langs)
                total += np.bincount(cells.ravel(), memo.ravel(), n * n_langs).reshape(n, n_langs)
            old = np.array([r is not None for r in rows])
            total += self.model.words.summed(np.array([r for r in rows if r is not None], np.int64), weights[old], groups[old], n)
            total += np.bincount(groups[old], weights[old], n)[:, None] * self.model.words.floor
        return total

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out, places, counts, lengths, waiting = [(UNKNOWN, 0.0)] * len(texts), [], [], [], 0
        for at, text in enumerate(texts, 1):
            words = words_of(text)
            if self.model.langs and any(c.isalpha() for w in words for c in w):
                places.append(at - 1)
                counts.append(Counter(words))
                lengths.append(len(words))
                waiting += 1 + len(counts[-1])
            if places and (waiting >= self.most or at == len(texts)):
                total = self._totals(counts)
                # The share of the best, tempered by the root of the number of words: neighbouring words are not independent.
                p = np.exp((total - total.max(axis=1, keepdims=True)) / np.sqrt(lengths)[:, None])
                best = total.argmax(axis=1)
                scores = p[np.arange(len(p)), best] / p.sum(axis=1)
                for i, j, score in zip(places, best.tolist(), scores.tolist(), strict=True):
                    out[i] = self.model.langs[j], score
                places, counts, lengths, waiting = [], [], [], 0
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null identifier is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(rows: DataFrame, names, text: str) -> DataFrame:
    """lang, name, n: names(text) of the rows (lang, text), counted in each batch, then in all."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            for part in small(b, 2_000_000):
                found: dict[str, Counter] = defaultdict(Counter)
                for lang, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found[lang].update(names(t))
                flat = [(k, x, n) for k, c in found.items() for x, n in c.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())], names=["lang", "name", "n"])

    return rows.select("lang", text).mapInArrow(run, "lang string, name string, n long").groupBy("lang", "name").agg(F.sum("n").alias("n"))


def _logs(counts: DataFrame, langs: list[str], most: int) -> Logs:
    totals = {r.lang: float(r.t) for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}  # a row a language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "name"))
    top = counts.filter(F.col("n") >= LEAST).withColumn("place", place).filter(F.col("place") <= most).select("lang", "name", "n").toArrow()  # ENTRIES rows at most
    at = {k: j for j, k in enumerate(langs)}
    rows = [(at[k], x, n) for k, x, n in zip(*(c.to_pylist() for c in top.columns), strict=True)]
    return Logs.of(rows, np.array([totals.get(k, 0.0) for k in langs]))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from labelled rows outside the held-out part; per_language bounds the sample (in the mean)."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = materialise(rows.groupBy("lang").count(), f"{folder}/counts")  # Spark sees its size, and broadcasts it if small
    place = (F.shiftrightunsigned(F.xxhash64("doc_id"), 11)) / float(1 << 53)  # even in 0 to 1
    chosen = rows.withColumn("place", place).join(counts, "lang").filter(F.col("place") * F.col("count") < per_language)
    words = materialise(_counted(chosen, words_of, "text"), f"{folder}/words")
    langs = sorted(r.lang for r in words.select("lang").distinct().collect())
    grams = materialise(_counted(words, all_grams, "name"), f"{folder}/grams")  # each word once: n-grams stand for words that were not seen
    model = LanguageModel(langs, _logs(words, langs, kept_of(WORDS, langs)), _logs(grams, langs, kept_of(GRAMS, langs)))
    drop_folder(spark, folder)
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",), lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns in keep, the predicted language, and a score of 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.words.parts(), model.grams.parts()))  # ENTRIES entries of each at most

    def start():
        langs, words, grams = sent.value
        return Predictor(LanguageModel(langs, Logs(*words), Logs(*grams))).predict_all

    return map_texts(docs, start, [T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())], list(keep), most=1_000_000)


def with_known_language(docs: DataFrame) -> DataFrame:
    """docs without those in no language (no letters, or no text), with their own columns. Where nothing is labelled,
    nothing can be learned: then all documents with letters stay."""
    names, model = docs.columns, fit(docs)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh_name("lang_pred", names), fresh_name("score", [*names, "lang_pred"])
    return identify(docs, model, tuple(names), lang, score).filter(F.col(lang) != UNKNOWN).select(*names)
