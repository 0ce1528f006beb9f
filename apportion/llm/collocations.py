r"""Phrase collocations by Rabin-Karp fingerprints.

Texts lose the case of A-Z, fall into pieces at `[.,;:!?\x0A-\x0D]` and pieces into words
`[^\x20\x09]+`. The bytes of a stretch of texts become one stream with a space between words;
prefix sums of byte times power, modulo a prime, give the fingerprint of any n-gram as one
difference (numpy, exact in 64 bits). Two such polynomials and the language make the key, a
third one is the check.

A shuffle adds up keys: occurrences, the smallest row that holds one (the pointer), and the
smallest and largest check. Lengths go up one at a time: an n-gram can only be frequent if both
n-grams of one word less are, so a Bloom filter of the frequent ones keeps most others from the
shuffle. Its size is fixed and a false hit only costs a row, so results never depend on it.

Only what is frequent is written out. Pointed rows are read again, their n-grams hashed, and those
of a wanted key and check become text. A key with two checks is a collision; the n-grams of such
keys are all written out and counted by text.

Defined results: null texts are empty and count nothing; a null language is `und`; repeated rows
and ids count as often as they stand; scores are exact integers; ties are ordered by count and
phrase, so that ranks are unique; an empty table gives an empty result. Only the language and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apportion.llm.words import mix, signed, small_batches, text_bytes
from apportion.operators.skew import lookup_join
from apportion.session import cut, shuffle_width

PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353, 1_234_567_891)  # two of the key, one of the check
STRETCH = 256 << 10  # bytes of text hashed together
BLOOM_BITS = 1 << 26  # 8 MB
PROBES = 2
UNKNOWN = "und"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, size: int) -> np.ndarray:
    """base ** i modulo PRIME, doubled up."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.ones(1, dtype=np.uint32)
        while len(table) < max(size, STRETCH + 1):
            more = table * np.uint64(pow(base, len(table), PRIME)) % np.uint64(PRIME)
            table = np.concatenate((table, more.astype(np.uint32)))
        if size <= 2 * STRETCH:
            _powers[base] = table
    return table


@dataclass
class Stream:
    """Words of some texts in order, as stretches of one byte stream."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    piece: np.ndarray  # number of the piece that a word is in
    owner: np.ndarray  # number of the text that a word is in

    @classmethod
    def of(cls, texts: list[bytes]) -> Stream:
        raw = np.frombuffer(b"\n".join(t.translate(_LOWER) for t in texts) + b"\n", dtype=np.uint8)
        stop = _BREAK[raw]
        gap = stop | _SPACE[raw]
        edges = np.flatnonzero(np.diff(~gap, prepend=False))
        first, last = edges[0::2], edges[1::2]
        # One byte of each gap stays, as a space: equal phrases are equal bytes.
        keep = ~gap
        keep[last] = True
        at = np.cumsum(keep) - keep
        data = np.where(gap, np.uint8(32), raw)[keep]
        piece = np.cumsum(stop)[first] if len(first) else first
        border = np.cumsum([len(t) + 1 for t in texts])
        return cls(data, at[first], at[last], piece, np.searchsorted(border, first, side="right"))

    def grams(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie within a piece."""
        size = len(self.starts) - n + 1
        if size <= 0:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.piece[:size] == self.piece[n - 1 :])

    def prints(self) -> list[Prints]:
        return [Prints(self, base) for base in BASES]

    def text(self, word: int, n: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word + n - 1]].tobytes()


class Prints:
    """Prefix polynomial of a stream for one base."""

    def __init__(self, stream: Stream, base: int):
        size, self.stream = len(stream.data), stream
        self.sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((stream.data + np.uint64(1)) * powers(base, size)[:size] % np.uint64(PRIME), out=self.sums[1:])
        self.sums %= np.uint64(PRIME)
        self.back = powers(pow(base, -1, PRIME), size)

    def of(self, words: np.ndarray, n: int) -> np.ndarray:
        lo, hi = self.stream.starts[words], self.stream.ends[words + n - 1]
        return (self.sums[hi] + np.uint64(PRIME) - self.sums[lo]) % np.uint64(PRIME) * self.back[lo] % np.uint64(PRIME)


def keyed(stream: Stream, prints: list[Prints], words: np.ndarray, n: int, seeds: np.ndarray, bits: int) -> np.ndarray:
    """Keys of the n-grams that begin at words; seeds are those of the texts' languages."""
    pair = prints[0].of(words, n) << np.uint64(31) | prints[1].of(words, n)
    return mix(pair ^ mix(seeds[stream.owner[words]] + np.uint64(n))) >> np.uint64(64 - bits)


def checks(stream: Stream, prints: list[Prints], words: np.ndarray, n: int, seeds: np.ndarray) -> np.ndarray:
    return (prints[2].of(words, n) + seeds[stream.owner[words]] % np.uint64(PRIME)) % np.uint64(PRIME)


def language_seeds(langs: list[str]) -> np.ndarray:
    """A number for each row's language, the same in every task."""
    known = {x: int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], dtype=np.uint64)


def _slots(keys: np.ndarray) -> list[np.ndarray]:
    return [(mix(keys + np.uint64(p + 1)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64) for p in range(PROBES)]


def _set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(_slots(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
        word, inverse = np.unique(at >> 6, return_inverse=True)
        bits = np.zeros(len(word), dtype=np.uint64)
        np.bitwise_or.at(bits, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(signed(bits))], names=["word", "bits"])


def bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of a column of keys; its fixed size bounds what the driver gets and sends."""
    words = keys.mapInArrow(_set_bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(BLOOM_BITS // 64, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for at in _slots(keys):
        hit &= table[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) > 0
    return hit


def _streams(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Stream, np.ndarray]]:
    """Stretches of the rows of (lang, text, ...) with their languages' seeds. Only one stretch of
    a batch's texts is copied at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(sizes):
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + STRETCH, side="right")))
        stream = Stream.of(text_bytes(batch.column(1).slice(lo, hi - lo)))
        if len(stream.starts):
            yield lo, hi, stream, language_seeds(batch.column(0).slice(lo, hi - lo).to_pylist())
        lo = hi


def _counted(n: int, bits: int, shared):
    """Rows of (lang, text, pointer) to (key, lang, n, pointer, low, high) of their n-grams, added
    up over stretches of text; the language is told for single words only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value if shared else None
        for batch in batches:
            pointers, langs = batch.column(2).to_numpy(zero_copy_only=False), batch.column(0)
            codes = langs.dictionary_encode().indices.to_numpy()
            for lo, hi, stream, seeds in _streams(batch):
                prints = stream.prints()
                words = stream.grams(n)
                if table is not None and len(words):
                    shorter = keyed(stream, prints, np.arange(len(stream.starts) - n + 2), n - 1, seeds, bits)
                    known = _maybe(table, shorter)
                    words = words[known[words] & known[words + 1]]
                if not len(words):
                    continue
                keys, check = keyed(stream, prints, words, n, seeds, bits), checks(stream, prints, words, n, seeds)
                own = lo + stream.owner[words]
                lang = codes[own] if n == 1 else np.zeros(len(words), np.int64)
                order = np.lexsort((keys, lang)) if n == 1 else np.argsort(keys)
                keys, check, own, lang = keys[order], check[order], own[order], lang[order]
                first = np.flatnonzero((np.diff(keys, prepend=~keys[:1]) != 0) | (np.diff(lang, prepend=lang[:1]) != 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(keys[first])),
                        langs.take(pa.array(own[first])) if n == 1 else pa.nulls(len(first), pa.string()),
                        pa.array(np.diff(first, append=len(keys)).astype(np.int64)),
                        pa.array(np.minimum.reduceat(pointers[own], first)),
                        pa.array(np.minimum.reduceat(check, first).astype(np.int32)),
                        pa.array(np.maximum.reduceat(check, first).astype(np.int32)),
                    ],
                    names=["key", "lang", "n", "pointer", "low", "high"],
                )

    return run


def _written(bits: int):
    """Rows of (lang, text, wanted), wanted being (key, check, size, f), to the phrases of these
    keys with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts, wanted = batch.columns
            for i in range(batch.num_rows):
                stream, lang = Stream.of(text_bytes(texts.slice(i, 1))), langs[i].as_py()
                prints, seeds = stream.prints(), language_seeds([lang])
                want = {c: wanted[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("key", "check", "size", "f")}
                order = np.argsort(want["key"])
                out: list[tuple[str, int, int, str]] = []
                for n in np.unique(want["size"]).tolist():
                    mine = order[want["size"][order] == n]
                    words, known = stream.grams(n), want["key"][mine]
                    keys = signed(keyed(stream, prints, words, n, seeds, bits))
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    same = (known[at] == keys) & (want["check"][mine][at] == checks(stream, prints, words, n, seeds).astype(np.int64))
                    at, first = np.unique(at[same], return_index=True)
                    for k, w in zip(mine[at].tolist(), words[same][first].tolist(), strict=True):
                        out.append((lang, n, int(want["f"][k]), stream.text(w, n).decode()))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "size", "f", "phrase"])

    return run


def _spelled(n: int, bits: int, shared):
    """Rows of (lang, text, pointer) to (lang, key, phrase, n) of n-grams that may have a shared key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, _, stream, seeds in _streams(batch):
                words = stream.grams(n)
                keys = keyed(stream, stream.prints(), words, n, seeds, bits)
                hit = np.flatnonzero(_maybe(shared.value, keys))
                counts: dict[tuple[str, int, str], int] = {}
                for k, w in zip(signed(keys[hit]).tolist(), words[hit].tolist(), strict=True):
                    row = (langs[lo + stream.owner[w]], k, stream.text(w, n).decode())
                    counts[row] = counts.get(row, 0) + 1
                columns = list(zip(*counts, strict=True)) or [[], [], []]
                kinds = (pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(counts.values()), pa.int64())],
                    names=["lang", "key", "phrase", "n"],
                )

    return run


def frequent_phrases(rows: DataFrame, longest: int, least: int, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to longest words that occur least times or
    more, and (lang, n) with all words of a language. rows holds lang and text."""
    spark = rows.sparkSession
    # Rows with equal language and text share a pointer: either shows the phrase.
    rows = rows.withColumn("pointer", F.xxhash64("lang", "text"))
    counts: list[DataFrame] = []
    exact: list[DataFrame] = []
    shared, totals = None, None
    for n in range(1, longest + 1):
        added = rows.mapInArrow(_counted(n, bits, shared), "key long, lang string, n long, pointer long, low int, high int")
        added = added.groupBy("key", "lang") if n == 1 else added.groupBy("key")
        added = added.agg(F.sum("n").alias("f"), F.min("pointer").alias("pointer"), F.min("low").alias("low"), F.max("high").alias("high"))
        if n == 1:
            added = cut(added)
            totals = added.groupBy("lang").agg(F.sum("f").alias("n"))
            added = added.groupBy("key").agg(F.sum("f").alias("f"), F.min("pointer").alias("pointer"), F.min("low").alias("low"), F.max("high").alias("high"))
        level = cut(added.filter(F.col("f") >= least).withColumn("size", F.lit(n)))
        clashing = level.filter("low <> high").select("key")
        if not clashing.isEmpty():
            exact.append(_recounted(rows, clashing, n, least, bits))
        counts.append(level.filter("low = high").select("key", F.col("low").cast("long").alias("check"), "size", "f", "pointer"))
        if n < longest:
            shared = spark.sparkContext.broadcast(bloom(level.select("key")))
    found = _spelled_out(rows, reduce(DataFrame.unionByName, counts), bits)
    return cut(reduce(DataFrame.unionByName, exact, found)), totals


def _recounted(rows: DataFrame, clashing: DataFrame, n: int, least: int, bits: int) -> DataFrame:
    """Phrases whose key is shared by several, counted by their text."""
    shared = rows.sparkSession.sparkContext.broadcast(bloom(clashing))
    spelled = rows.mapInArrow(_spelled(n, bits, shared), "lang string, key long, phrase string, n long")
    counted = spelled.groupBy("lang", "key", "phrase").agg(F.sum("n").alias("f"))
    counted = counted.filter(F.col("f") >= least).join(clashing, "key", "left_semi")
    return cut(counted.select("lang", F.lit(n).alias("size"), "f", "phrase"))


def _spelled_out(rows: DataFrame, counts: DataFrame, bits: int) -> DataFrame:
    """Counted keys with their phrase, read from the rows that they point to."""
    wanted = cut(counts.groupBy("pointer").agg(F.collect_list(F.struct("key", "check", "size", "f")).alias("wanted")))
    near = rows.sparkSession.sparkContext.broadcast(bloom(wanted.select("pointer")))
    # Copies meet once; a second hash tells texts apart that a pointer does not.
    pointed = rows.filter(_known(near)(F.col("pointer"))).withColumn("mark", F.hash("text", "lang"))
    pointed = pointed.groupBy("pointer", "mark").agg(F.first("lang").alias("lang"), F.first("text").alias("text"))
    texts = pointed.join(wanted, "pointer").select("lang", "text", "wanted")
    phrases = texts.mapInArrow(_written(bits), "lang string, size int, f long, phrase string")
    return phrases.dropDuplicates(["lang", "phrase"])


def _known(shared):
    @F.arrow_udf("boolean")
    def known(pointer: pa.Array) -> pa.Array:
        return pa.array(_maybe(shared.value, pointer.to_numpy(zero_copy_only=False).view(np.uint64)))

    return known


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of phrases of two words or more, by their lowest cut."""
    rows = counts.count()
    words = F.split("phrase", " ")
    cuts = counts.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns(
        {
            "head": F.array_join(F.slice(words, F.lit(1), F.col("k")), " "),
            "tail": F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " "),
        }
    )
    # Parts occur at least as often as the phrase, so they were counted too.
    for part, name in (("head", "l"), ("tail", "r")):
        f = counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
        cuts = lookup_join(cuts, f, ["lang", part], rows, ["phrase"], row_bytes=128)
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}  # a product has 36 digits
    cuts = cuts.withColumns({"top": wide["a"] * wide["a"] * F.lit(1_000_000).cast("decimal(7,0)"), "below": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("top div below").cast("long"))
    best = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def within_longer(counts: DataFrame, share: int) -> DataFrame:
    """Phrases that stand in a longer one with that percentage of their count. The phrases of one
    more word are enough: whatever is longer still holds one of them, as frequent as itself."""
    words = F.split("phrase", " ")
    ends = [F.array_join(F.slice(words, F.lit(at), F.col("size") - 1), " ") for at in (1, 2)]
    longer = counts.filter("size > 2").select("lang", F.explode(F.array(*ends)).alias("phrase"), F.col("f").alias("longer"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = counts.filter("size > 1").join(longer, ["lang", "phrase"])
    return held.filter(100 * F.col("longer") >= share * F.col("f")).select("lang", "phrase")


def collocations(
    docs: DataFrame,
    longest: int = 3,
    least: int = 10,
    first: int = 2000,
    share: int = 50,
    lang_col: str = "lang",
    text_col: str = "text",
    bits: int = 64,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases by score, count and
    phrase. bits is the width of a fingerprint."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        counts, totals = frequent_phrases(rows.filter("text is not null"), longest, least, bits)
    kept = cut(scored(counts).join(within_longer(counts, share), ["lang", "phrase"], "left_anti"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are ranked in parts first, each part of a bounded number of tasks' heads.
    parts = shuffle_width(docs.sparkSession)
    while parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= first)
        parts //= 64
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= first)
    return kept.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


# Every occurrence by plain lists; parts are looked up among all phrases.
SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents WHERE text IS NOT NULL),
grams AS (
  SELECT lang, unnest(w) AS phrase, 1 AS size FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM pieces
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM pieces),
f AS MATERIALIZED (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cand AS (SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, size, a, w, unnest(range(1, size)) AS k FROM cand),
parts AS (SELECT c.lang, c.phrase, c.size, c.a, c.k, h.f AS l, t.f AS r, CAST(1000000::HUGEINT * c.a * c.a // (h.f::HUGEINT * t.f) AS BIGINT) AS score
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.size = c.k AND h.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f t ON t.lang = c.lang AND t.size = c.size - c.k AND t.phrase = array_to_string(c.w[c.k + 1:c.size], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT b.lang, b.phrase FROM best b JOIN cand c ON c.lang = b.lang AND b.size = 2 AND c.size = 3
  AND b.phrase IN (c.w[1] || ' ' || c.w[2], c.w[2] || ' ' || c.w[3]) AND 100 * c.a >= 50 * b.a),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.lang = b.lang AND h.phrase = b.phrase))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000"""
