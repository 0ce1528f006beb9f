"""Language spans and document language.

Every word is scored under the languages that its script allows, from letter-sequence counts
that Spark gathers over all training rows. Viterbi with a penalty for each change of language
labels the words; runs of one label are the spans, and the language of most letters is the
document's.

The languages only compete with each other, so a text must also look like the one it gets: its
mean log share of a letter sequence is compared with those of that language's training rows, all
of them, and a text far below their median scores 0.

Defined results: null, empty and letterless texts are UNKNOWN with score 0 and without spans; a
text whose script no learned language uses gets the most frequent language with score 0; without
training rows everything is UNKNOWN. Ties go to the language that sorts first. Repeated rows get
equal results. Only the text (and in training the language) is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.llm.words import chunks, lists, mix, text_bytes
from apportion.session import cut

UNKNOWN = "und"
ORDERS = (2, 3, 4)  # bytes in a letter sequence, word borders included
BUCKETS = 1 << 16  # counters of each order and language: the model's size has this bound
SWITCH = 9.0  # nats that a change of language costs
SMOOTH = 0.5
FAR, LEAST_FAR = 8.0, 1.5  # median absolute deviations, and nats, that a text may lie below the median
RARE_SCRIPT = 0.01  # a language is a candidate for scripts with this share of its words
BATCH = 8 << 20  # bytes of text labelled in lockstep
STRETCH = 1 << 19  # bytes whose words are scored at a time
_LETTER = re.compile(r"[^\W\d_]")

# Script of a word by the first byte of its UTF-8 form. 0 Latin, 1 Greek,
# 2 Cyrillic, 3 Armenian and Hebrew, 4 Arabic and kin, 5 Indic and south-east Asian,
# 6 Latin and Greek extended, symbols, 7 Kana and Han, 8 Hangul, 9 beyond the basic plane.
SCRIPTS = ((0x00, 0), (0xCD, 1), (0xD0, 2), (0xD4, 3), (0xD8, 4), (0xE0, 5), (0xE1, 6), (0xE3, 7), (0xEA, 8), (0xF0, 9))
N_SCRIPTS = 10
_SCRIPT = np.zeros(256, dtype=np.int64)
for _first, _script in SCRIPTS:
    _SCRIPT[_first:] = _script
_LETTERS_ONLY = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes with everything but letters blanked, the start and end of each word, the
    borders of each text's words, and where each text begins."""
    data = np.frombuffer(b" " + b" ".join(t.lower().translate(_LETTERS_ONLY) for t in texts) + b" ", dtype=np.uint8).copy()
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    data[upper] += 0x20
    edges = np.flatnonzero(np.diff(data != 32, prepend=False))
    starts, ends = edges[0::2], edges[1::2]
    begins = np.concatenate(([1], np.cumsum([len(t) + 1 for t in texts]) + 1))
    return data, starts, ends, np.searchsorted(starts, begins), begins


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """Bucket of the n bytes that begin at each position (the last positions wrap)."""
    key = np.zeros(len(data), dtype=np.uint64)
    for j in range(n):
        key = key * np.uint64(257) + np.roll(data, -j)
    return (mix(key) & np.uint64(BUCKETS - 1)).astype(np.int64)


def gram_range(starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and beyond-last position of the sequences of each word, its two borders included."""
    first = starts - 1
    return first, np.maximum(first, ends + 2 - n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (text, lang) to (lang, feature, n), summed over each batch."""
    for batch in batches:
        texts, langs = text_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            total = np.zeros(len(ORDERS) * BUCKETS + N_SCRIPTS, dtype=np.int64)
            for lo, hi in chunks(own, STRETCH):
                data, starts, ends, _, _ = letters(own[lo:hi])
                for o, n in enumerate(ORDERS):
                    first, stop = gram_range(starts, ends, n)
                    inside = np.zeros(len(data) + 1, dtype=np.int64)
                    np.add.at(inside, first, 1)
                    np.add.at(inside, stop, -1)
                    used = np.cumsum(inside)[:-1] > 0
                    total[o * BUCKETS : (o + 1) * BUCKETS] += np.bincount(grams(data, n)[used], minlength=BUCKETS)
                total[-N_SCRIPTS:] += np.bincount(_SCRIPT[data[starts]], minlength=N_SCRIPTS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "feature", "n"],
            )


@dataclass
class LanguageModel:
    langs: list[str]
    tables: list[np.ndarray]  # for each order, log shares by bucket and language
    allowed: np.ndarray  # script by language
    default: int
    least: np.ndarray  # by language, lowest mean log share of a sequence

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        scores = np.zeros((len(starts), len(self.langs)))
        sums = np.zeros((len(data) + 1, len(self.langs)))
        for n, table in zip(ORDERS, self.tables, strict=True):
            np.cumsum(table[grams(data, n)], axis=0, out=sums[1:])
            first, stop = gram_range(starts, ends, n)
            scores += sums[stop] - sums[first]
        scores /= len(ORDERS)
        may = self.allowed[_SCRIPT[data[starts]]]
        return np.where(may, scores, np.where(may.any(axis=1), -1e3, 0.0)[:, None]).astype(np.float32)


def sequences(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letter sequences of each word, in the mean over the orders as word scores are."""
    return sum(np.subtract(*gram_range(starts, ends, n)[::-1]) for n in ORDERS) / len(ORDERS)


def viterbi(scores: np.ndarray, border: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; all texts take a step at a time together, longest first."""
    sizes = np.diff(border)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(len(scores), dtype=np.int16)
    if not len(order):
        return labels
    begin, size = border[order], sizes[order]
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than t words
    jumped = np.zeros(scores.shape, dtype=bool)
    source = np.zeros(len(scores), dtype=np.int16)
    best = scores[begin].astype(np.float64)
    for t in range(1, size[0]):
        k = active[t]
        v = best[:k]
        top = v.argmax(axis=1)
        jump = (v[np.arange(k), top] - switch)[:, None]
        at = begin[:k] + t
        jumped[at] = jump > v
        source[at] = top
        best[:k] = np.maximum(v, jump) + scores[at]
    state = best.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        if t:
            state[:k] = np.where(jumped[at, state[:k]], source[at], state[:k])
    return labels


def _labelled(texts: list[bytes], model: LanguageModel) -> Iterator[tuple[list, list, list, list, list]]:
    """Language, score and the spans' languages, starts and ends (code points) of texts."""
    langs = np.array(model.langs, dtype=object)
    for lo, hi in chunks(texts, BATCH):
        own = texts[lo:hi]
        # Scores are found over short stretches, which keeps the tables in the cache.
        words, lengths, sizes, points, ends_at, per_text = [], [], [], [], [], []
        for a, b in chunks(own, STRETCH):
            data, starts, ends, border, begins = letters(own[a:b])
            words.append(model.word_scores(data, starts, ends))
            point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            base = point[np.repeat(begins[:-1], np.diff(border))]
            points.append(point[starts] - base)
            ends_at.append(point[ends] - base)
            lengths.append(ends - starts)
            sizes.append(sequences(starts, ends))
            per_text.append(np.diff(border))
        scores, length = np.concatenate(words), np.concatenate(lengths)
        start, end = np.concatenate(points), np.concatenate(ends_at)
        words.clear()
        counts = np.concatenate(per_text)
        border = np.concatenate(([0], np.cumsum(counts)))
        owner = np.repeat(np.arange(len(own)), counts)
        labels = viterbi(scores, border, SWITCH)
        n = len(model.langs)
        mass = np.bincount(owner * n + labels, weights=length, minlength=len(own) * n).reshape(-1, n)
        total = np.column_stack([np.bincount(owner, weights=scores[:, j], minlength=len(own)) for j in range(n)])
        pick = mass.argmax(axis=1)
        share = mass.max(axis=1) / np.maximum(mass.sum(axis=1), 1)
        rival = np.where(np.arange(n) == pick[:, None], -np.inf, total).max(axis=1) if n > 1 else np.full(len(own), -np.inf)
        lead = np.minimum(np.maximum(total[np.arange(len(own)), pick] - rival, 0), 50)
        score = share * (1 - 0.5 * np.exp(-lead))
        blind = ~(total != 0).any(axis=1)
        # Words of the text's language: others count in its share already.
        mine = labels == pick[owner]
        mine &= scores.any(axis=1)
        fit = np.bincount(owner[mine], weights=scores[mine, pick[owner[mine]]], minlength=len(own))
        fit /= np.maximum(np.bincount(owner[mine], weights=np.concatenate(sizes)[mine], minlength=len(own)), 1)
        # Words of scripts that no language uses are not in the language that they are labelled.
        seen = np.bincount(owner[mine], weights=length[mine], minlength=len(own)) / np.maximum(mass.sum(axis=1), 1)
        score = np.where(blind | (fit < model.least[pick]), 0.0, np.minimum(score, seen))
        pick = np.where(blind, model.default, pick)
        change = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])))) if len(labels) else np.empty(0, np.int64)
        stop = np.concatenate((change[1:] - 1, [len(labels) - 1])).astype(np.int64) if len(change) else change
        cuts = np.searchsorted(owner[change], np.arange(len(own) + 1)) if len(change) else np.zeros(len(own) + 1, dtype=int)
        known = [bool(_LETTER.search(t.decode("utf-8", "replace"))) if counts[i] else False for i, t in enumerate(own)]
        rows = [(cuts[i], cuts[i + 1]) if k else (0, 0) for i, k in enumerate(known)]
        yield (
            [langs[p] if k else UNKNOWN for p, k in zip(pick, known, strict=True)],
            [float(s) if k else 0.0 for s, k in zip(score, known, strict=True)],
            [list(langs[labels[change[a:b]]]) for a, b in rows],
            [start[change[a:b]] for a, b in rows],
            [end[stop[a:b]] for a, b in rows],
        )


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows of df that have a text and a language. What the driver receives is
    one counter table for each language."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts = rows.mapInArrow(_count, "lang string, feature int, n long")
    found = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(found["lang"].to_pylist(), dtype=object)
    langs = sorted(set(names))
    table = np.zeros((len(ORDERS) * BUCKETS + N_SCRIPTS, len(langs)))
    column = np.searchsorted(np.array(langs, dtype=str), names.astype(str)) if langs else np.empty(0, int)
    table[found["feature"].to_numpy(), column] = found["n"].to_numpy()
    tables = []
    for o in range(len(ORDERS)):
        part = table[o * BUCKETS : (o + 1) * BUCKETS]
        # Smoothing mass goes to sequences that some language has shown.
        size = max(1, int((part.sum(axis=1) > 0).sum()))
        tables.append(np.log((part + SMOOTH) / (part.sum(axis=0) + SMOOTH * size)).astype(np.float32))
    scripts = table[-N_SCRIPTS:]
    words = scripts.sum(axis=0)
    default = int(words.argmax()) if langs else 0
    model = LanguageModel(langs, tables, scripts >= np.maximum(RARE_SCRIPT * words, 1), default, np.full(len(langs), -np.inf))
    shared = df.sparkSession.sparkContext.broadcast(model)
    fits = cut(rows.mapInArrow(_fits(shared), "lang string, fit double"))
    middle = fits.groupBy("lang").agg(F.percentile_approx("fit", 0.5, 10000).alias("mid"))
    away = fits.join(F.broadcast(middle), "lang").groupBy("lang", "mid").agg(F.percentile_approx(F.abs(F.col("fit") - F.col("mid")), 0.5, 10000).alias("mad"))
    # One row for each language.
    for r in away.collect():
        model.least[langs.index(r["lang"])] = r["mid"] - max(FAR * r["mad"], LEAST_FAR)
    shared.unpersist()
    return model


def _fits(shared):
    """Rows of (text, lang) to (lang, mean log share of a letter sequence in that language)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts, langs = text_bytes(batch.column(0)), np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                j = model.langs.index(lang) if lang in model.langs else None
                if j is None:
                    continue
                # Its own column alone, in one-language tables.
                alone = LanguageModel([lang], [t[:, j : j + 1] for t in model.tables], model.allowed[:, j : j + 1], 0, model.least[j : j + 1])
                own = [texts[i] for i in np.flatnonzero(langs == lang)]
                for lo, hi in chunks(own, STRETCH):
                    data, starts, ends, border, _ = letters(own[lo:hi])
                    scores = alone.word_scores(data, starts, ends)[:, 0]
                    use = scores != 0
                    owner = np.repeat(np.arange(hi - lo), np.diff(border))[use]
                    size = np.bincount(owner, weights=sequences(starts, ends)[use], minlength=hi - lo)
                    fit = np.bincount(owner, weights=scores[use], minlength=hi - lo)[size > 0] / size[size > 0]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(fit), pa.string()), pa.array(fit, pa.float64())], names=["lang", "fit"])

    return run


RESULT = "struct<lang:string,score:double,span_langs:array<string>,span_starts:array<long>,span_ends:array<long>>"


def language(text: Column, model: LanguageModel, spark) -> Column:
    """Struct column: lang, score (0 to 1: share of letters in the language, less if another
    language explains the text as well, 0 if it does not look like the language) and the spans with code point ranges."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def label(column: pa.Array) -> pa.Array:
        model, texts = shared.value, text_bytes(column)
        parts: tuple[list, ...] = ([], [], [], [], [])
        if model.langs:
            for got in _labelled(texts, model):
                for whole, part in zip(parts, got, strict=True):
                    whole.extend(part)
        else:
            none = np.empty(0, np.int64)
            parts = ([UNKNOWN] * len(texts), [0.0] * len(texts), [[]] * len(texts), [none] * len(texts), [none] * len(texts))
        return pa.StructArray.from_arrays(
            [
                pa.array(parts[0], pa.string()),
                pa.array(parts[1], pa.float64()),
                pa.array(parts[2], pa.list_(pa.string())),
                lists(parts[3], pa.int64()),
                lists(parts[4], pa.int64()),
            ],
            names=["lang", "score", "span_langs", "span_starts", "span_ends"],
        )

    return label(text.cast("string"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_known_language(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: float = 0.25) -> DataFrame:
    """Rows of df whose text scores at least this much for its language, so that those without
    letters, without a leading language or in none that is learned go; the language model
    is learned from df's own labelled rows. Columns are those of df."""
    model = learn(df, text_col, lang_col)
    mark = fresh(df, "language")
    # Letterless rows go in any case; where nothing can be learned, nothing else is rejected.
    found = df.withColumn(mark, language(F.col(text_col), model, df.sparkSession))
    if not model.langs:
        return df.filter(F.coalesce(F.col(text_col).cast("string"), F.lit("")).rlike(r"\p{L}"))
    return found.filter((F.col(f"{mark}.lang") != UNKNOWN) & (F.col(f"{mark}.score") >= least)).drop(mark)
