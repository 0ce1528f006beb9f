r"""Benchmark decontamination by spaced seeds.

Texts become lower-case words `[\p{L}\p{N}]+`. Fixed masks over a window of words ignore some of
its positions: the positions fall into SUBSTITUTIONS + 2 interleaved groups, and each mask looks
at two of them. However the allowed substitutions fall, two groups stay whole, so every window
that differs from a benchmark window in at most that many words shares a seed with it. Seeds of
both tables are joined and each hit is verified word by word.

Items shorter than the window but of at least SHORTEST words are matched whole and exactly;
shorter items are no evidence and match nothing.

A Bloom filter of the benchmark's seeds goes to the tasks so that only document windows that may
hit are shuffled. Its size is fixed; however full it gets, the join decides, so results never
depend on it.

Defined results: null and empty texts match nothing; repeated rows with equal id and text are
one result; rows with equal id and different text are told apart by the text's hash; a null id
is kept. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.llm.jaccard import arrow_field
from apportion.llm.langid import fresh
from apportion.llm.words import chunks, lists, mix, signed, word_hashes
from apportion.session import cut, hinted

WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST = 8
BLOOM_BITS = 1 << 24  # 2 MB
PROBES = 2
_WORD = re.compile(r"[^\W_]+")


def masks(window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> list[list[int]]:
    groups = substitutions + 2
    return [[i for i in range(window) if i % groups in pair] for pair in combinations(range(groups), 2)]


def _words(column: pa.Array) -> list[bytes]:
    return [" ".join(_WORD.findall(t.lower())).encode("utf-8", "surrogatepass") if t else b"" for t in column.to_pylist()]


def seeds(words: np.ndarray, positions: list[int], tag: int) -> np.ndarray:
    """Hash of the words at the given positions of the window that begins at each word."""
    size = len(words) - tag % 1000 + 1
    out = np.full(max(size, 0), tag, dtype=np.uint64)
    for p in positions:
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[p : p + max(size, 0)]
    return mix(out)


def _plans(lengths: list[int]) -> list[tuple[int, list[int], int]]:
    """(window, positions, tag) of every seed: the masks, then whole short items by length."""
    spaced = [(WINDOW, m, (i + 1) * 1000 + WINDOW) for i, m in enumerate(masks())]
    return spaced + [(n, list(range(n)), n) for n in lengths]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (item, text) to (item, seed, window) of every window and mask."""
    for batch in batches:
        texts, out, at = _words(batch.column(1)), [], []
        for i, text in enumerate(texts):
            words, _ = word_hashes([text])
            n = len(words)
            if n < SHORTEST:
                continue
            for window, positions, tag in _plans([])[:] if n >= WINDOW else _plans([n])[-1:]:
                for j, s in enumerate(seeds(words, positions, tag)):
                    out.append((s, words[j : j + window]))
                    at.append(i)
        keys = np.array([s for s, _ in out], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(signed(keys), pa.int64()),
                lists([signed(w) for _, w in out], pa.int64()),
            ],
            names=["item", "seed", "window"],
        )


def probe_bits(keys: np.ndarray) -> list[np.ndarray]:
    keys = keys.view(np.uint64)
    return [((mix(keys + np.uint64(p)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)) for p in range(PROBES)]


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of seed to the (word, bits) of the Bloom filter that they set."""
    for batch in batches:
        at = np.concatenate(probe_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))
        word, bit = at >> 5, at & 31
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(np.int64(1) << bit, pa.int64())], names=["word", "bits"])


def bloom(keys: DataFrame) -> np.ndarray:
    """Bloom filter of a column of seeds, as booleans; the driver gets at most its fixed size."""
    words = keys.mapInArrow(_filter_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    got = words.toArrow()
    table = np.zeros(BLOOM_BITS // 32, dtype=np.uint32)
    table[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return table


def _maybe(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), dtype=bool)
    for at in probe_bits(keys):
        hit &= (table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 > 0
    return hit


def _document_windows(id_field: pa.Field, shared, lengths: list[int]):
    """Rows of (id, text_key, text) to (id, text_key, at, seed, window) that may hit."""
    plans = _plans(lengths)
    schema = pa.schema([id_field, ("text_key", pa.int64()), ("at", pa.int64()), ("seed", pa.int64()), ("window", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            texts = _words(batch.column(2))
            for lo, hi in chunks(texts):
                words, border = word_hashes(texts[lo:hi])
                rows, at, found, windows = [], [], [], []
                for window, positions, tag in plans:
                    keys = seeds(words, positions, tag)
                    hit = np.flatnonzero(_maybe(table, keys)) if len(keys) else np.empty(0, np.int64)
                    own = np.searchsorted(border, hit, side="right") - 1
                    inside = hit + window <= border[own + 1]
                    hit, own = hit[inside], own[inside]
                    rows.extend(own + lo)
                    at.extend(hit - border[own])
                    found.append(keys[hit])
                    windows.extend(signed(words[h : h + window]) for h in hit)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pick),
                        batch.column(1).take(pick),
                        pa.array(at, pa.int64()),
                        pa.array(signed(np.concatenate(found)) if found else [], pa.int64()),
                        lists(windows, pa.int64()),
                    ],
                    schema=schema,
                )

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row for each (id, text) that overlaps the benchmark: id_col, text_key (xxhash64 of the
    text), item_id (smallest item with a window in the text), n_windows (places of the text whose
    window is an item's with at most SUBSTITUTIONS other words), n_exact (those without any),
    first_word and end_word of the stretch from the first to the last such window."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    found = items.mapInArrow(_item_windows, f"item {kind}, seed long, window array<long>")
    # Windows that several items share are one row, so shared passages give no extra pairs.
    known = cut(found.groupBy("seed", "window").agg(F.min("item").alias("item_id")))
    lengths = [r[0] for r in known.select(F.size("window").alias("n")).filter(F.col("n") < WINDOW).distinct().orderBy("n").collect()]
    shared = spark.sparkContext.broadcast(bloom(known.select("seed")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter("text is not null").select("id", F.xxhash64("text").alias("text_key"), "text")
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T._parse_datatype_string("text_key long, at long, seed long, window array<long>").fields])
    hits = rows.mapInArrow(_document_windows(arrow_field(rows, "id"), shared, lengths), schema)
    k = known.select("seed", F.col("window").alias("item_window"), "item_id")
    pairs = hits.join(hinted(k, known.count(), 256), "seed")
    wrong = F.aggregate(F.zip_with("window", "item_window", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)
    pairs = pairs.withColumn("wrong", wrong).filter(F.col("wrong") <= SUBSTITUTIONS)
    places = pairs.groupBy("id", "text_key", "at").agg(F.min("wrong").alias("wrong"), F.min("item_id").alias("item_id"), F.max(F.size("window")).alias("size"))
    out = places.groupBy("id", "text_key").agg(
        F.min("item_id").alias("item_id"),
        F.count(F.lit(1)).alias("n_windows"),
        F.sum((F.col("wrong") == 0).cast("long")).alias("n_exact"),
        F.min("at").alias("first_word"),
        F.max(F.col("at") + F.col("size")).alias("end_word"),
    )
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that overlap the benchmark; columns are those of docs."""
    key, text_key = fresh(docs, "bad_id"), fresh(docs, "bad_text_key")
    bad = cut(contaminated(docs, benchmark, id_col, text_col).select(F.col(id_col).alias(key), F.col("text_key").alias(text_key)))
    rows = bad.count()
    if not rows:
        return docs
    on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text_key))
    return docs.join(hinted(bad, rows, 48), on, "left_anti")


def _sql() -> str:
    """The same windows by plain joins, for an engine with lists."""
    seeded = [
        f"SELECT {i} AS m, list_select(w, {[p + 1 for p in mask]}) AS k, w, {{cols}} FROM {{t}} WHERE len(w) = {WINDOW}"
        for i, mask in enumerate(masks())
    ]
    whole = "SELECT -1 AS m, w AS k, w, {cols} FROM {t} WHERE len(w) < " + str(WINDOW)
    both = " UNION ALL ".join([*seeded, whole])
    return rf"""WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(t), {WINDOW}) AS n FROM b WHERE len(t) >= {SHORTEST}),
iw AS (SELECT item_id, t[i:i + least(len(t), {WINDOW}) - 1] AS w FROM (SELECT item_id, t, unnest(range(1, len(t) - least(len(t), {WINDOW}) + 2)) AS i FROM b WHERE len(t) >= {SHORTEST})),
dw AS (SELECT doc_id, text, i - 1 AS place_at, t[i:i + n - 1] AS w FROM (SELECT doc_id, text, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, sizes WHERE len(t) >= n)),
ik AS ({both.format(cols="item_id", t="iw")}),
dk AS ({both.format(cols="doc_id, text, place_at", t="dw")}),
hit AS (SELECT dk.doc_id, dk.text, dk.place_at, len(dk.w) AS n, ik.item_id, list_sum(list_transform(range(1, len(dk.w) + 1), lambda x: CASE WHEN dk.w[x] <> ik.w[x] THEN 1 ELSE 0 END)) AS wrong
  FROM dk JOIN ik USING (m, k)),
place AS (SELECT doc_id, text, place_at, min(wrong) AS wrong, min(item_id) AS item_id, max(n) AS n FROM hit WHERE wrong <= {SUBSTITUTIONS} GROUP BY doc_id, text, place_at)
SELECT doc_id, min(item_id) AS item_id, count(*) AS n_windows, CAST(sum(CASE WHEN wrong = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_exact,
  min(place_at) AS first_word, max(place_at + n) AS end_word FROM place GROUP BY doc_id, text"""


SQL = _sql()
