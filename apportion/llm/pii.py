"""Personal data: fixed forms, and identifiers found by bootstrapped contexts.

The fixed forms (email, ip, card, phone) are seeds. Words that look like identifiers occur in
lexical contexts: the two words before, and the words on both sides. Contexts and identifiers
form a bipartite graph. A context's score for a kind is the share of its identifiers that are of
that kind; an identifier that is no seed scores by the reliable contexts it occurs in; some
rounds spread scores over the graph. High-confidence contexts then mark unseen identifiers.

Defined results: null and empty texts have no spans; repeated rows get equal results; a span
never overlaps a base span of its text if the method adds it, while base spans of different
kinds may overlap; offsets are code points, the end exclusive. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.llm.jaccard import arrow_field
from apportion.llm.langid import fresh
from apportion.session import cut, hinted

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
CONTEXT_SEEDS = 5  # distinct identifiers of a kind that a context must have
CONTEXT_SCORE = 0.8
FOUND_SCORE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# The look-behind keeps runs of digits linear: a match cannot begin inside a run that failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LIKELY = re.compile(r"[0-9@]")
_WRAP = "\"'()[]{}<>,;:!?.*#$%&|=`"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed forms, by start and then kind."""
    out = []
    if "@" in text:
        floor, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((start, 0, m.end()))
                floor = m.end()
            at = text.find("@", max(at + 1, floor))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(start, end, kind or -1, identifier, contexts) of the words that look like identifiers.

    A base span is a candidate with its kind. Another word is one if its core, without the
    punctuation around it, holds an @ or at least four digits and overlaps no base span.
    """
    if not spans and not _LIKELY.search(text):
        return []
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words], dtype=np.int64)
    found = [(s, e, k) for s, k, e in spans]
    # Spans by start with the furthest end so far: the last one that starts before a word ends
    # tells whether any span reaches into the word.
    begin = np.array([s for s, _, _ in spans], dtype=np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, e in spans], dtype=np.int64)) if spans else begin
    for a, b in words:
        if not _LIKELY.search(text, a, b):
            continue
        core = text[a:b].strip(_WRAP)
        if len(core) < 5 or ("@" not in core and len(_DIGIT.findall(core)) < 4):
            continue
        s = a + text[a:b].index(core)
        e = s + len(core)
        last = int(np.searchsorted(begin, e, side="left")) - 1
        if last < 0 or reach[last] <= s:
            found.append((s, e, -1))
    if not found:
        return []
    out = []
    shape = lambda w: re.sub(r"[0-9]+", "9", text[w[0] : w[1]].lower())
    for s, e, kind in found:
        i = int(np.searchsorted(starts, s, side="right")) - 1
        j = int(np.searchsorted(starts, e - 1, side="right"))
        before = [shape(w) for w in words[max(0, i - 2) : i]]
        after = shape(words[j]) if j < len(words) else ""
        around = []
        if len(before) == 2:
            around.append(_hash("before", *before))
        if before and after:
            around.append(_hash("around", before[-1], after))
        out.append((s, e, kind, _hash("id", text[s:e].lower()), around))
    return out


_CANDIDATE = "array<struct<start:long,end:long,kind:int,item:long,contexts:array<long>>>"
_SPAN = "array<struct<start:long,kind:int,end:long>>"


def _scanned(id_field: pa.Field):
    """Rows of (id, text) to (row, id, text_key, spans, candidates); row numbers are unique in
    the table that the result is written to."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    some = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("item", pa.int64()), ("contexts", pa.list_(pa.int64()))]))
    schema = pa.schema([("row", pa.int64()), id_field, ("text_key", pa.int64()), ("spans", span), ("candidates", some)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans, marks = [], []
            for text in batch.column(2).to_pylist():
                own = base_spans(text) if text else []
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
                marks.append([{"start": s, "end": e, "kind": k, "item": i, "contexts": c} for s, e, k, i, c in candidates(text, own)] if text else [])
            n = len(spans)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(spans, span), pa.array(marks, some)], schema=schema
            )
            row += n

    return run


def reliable_contexts(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Score the graph of edges (context, item, kind), kind -1 for identifiers to be judged.

    Returns (context, kind, score) of the contexts kept, and (item, kind, score) of the unseen
    identifiers accepted. Sums are combined before they are shuffled, so a context or an
    identifier that holds many of the rows is no larger than others.
    """
    seeds = edges.filter("kind >= 0").groupBy("item").agg(F.min("kind").alias("kind")).withColumn("score", F.lit(1.0))
    links = cut(edges.select("context", "item").distinct())
    sizes = links.groupBy("context").agg(F.count(F.lit(1)).alias("size"))
    # Only contexts that can reach the score at all are carried on.
    sizes = cut(sizes.filter(F.col("size") >= CONTEXT_SEEDS))
    links = cut(links.join(hinted(sizes, sizes.count(), 24), "context"))
    seeds = cut(seeds)
    scored, kept = seeds, None
    for _ in range(ROUNDS):
        votes = links.join(hinted(scored, scored.count(), 32), "item").groupBy("context", "kind", "size").agg(
            F.sum("score").alias("mass"), F.count(F.lit(1)).alias("support")
        )
        kept = votes.withColumn("score", F.col("mass") / (F.col("size") + 1))
        kept = cut(kept.filter((F.col("score") >= CONTEXT_SCORE) & (F.col("support") >= CONTEXT_SEEDS)).select("context", "kind", "score"))
        met = links.select("context", "item").join(hinted(kept, kept.count(), 32), "context")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        judged = met.groupBy("item", "kind").agg((1 - doubt).alias("score"))
        best = judged.groupBy("item").agg(F.max(F.struct("score", (-F.col("kind")).alias("order"))).alias("best"))
        best = best.select("item", (-F.col("best.order")).alias("kind"), F.col("best.score").alias("score"))
        fresh = best.join(seeds.select("item"), "item", "left_anti")
        scored = cut(seeds.unionByName(fresh))
    accepted = scored.filter(F.col("score") >= FOUND_SCORE).join(seeds.select("item"), "item", "left_anti")
    return kept, cut(accepted)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id_col, text_key (xxhash64 of the text), base and added, both
    arrays of (start, kind number, end)."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("id", rows.schema["id"].dataType),
            *T._parse_datatype_string(f"text_key long, spans {_SPAN}, candidates {_CANDIDATE}").fields,
        ]
    )

    scanned = cut(rows.mapInArrow(_scanned(arrow_field(rows, "id")), schema))
    marks = scanned.filter(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    edges = marks.select(F.explode("contexts").alias("context"), "item", "kind")
    kept, accepted = reliable_contexts(edges)
    unseen = marks.filter("kind < 0")
    hits = unseen.join(hinted(accepted.select("item", F.col("kind").alias("as")), accepted.count(), 24), "item")
    hits = hits.select("row", "start", "end", "as", F.explode("contexts").alias("context"))
    hits = hits.join(hinted(kept.select("context", F.col("kind").alias("as")), kept.count(), 24), ["context", "as"], "left_semi")
    added = hits.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", F.col("as").alias("kind"), "end"))).alias("added"))
    added = cut(added)
    joined = scanned.select("row", "id", "text_key", F.col("spans").alias("base")).join(hinted(added, added.count(), 256), "row", "left")
    empty = F.array().cast(_SPAN)
    return joined.select(F.col("id").alias(id_col), "text_key", "base", F.coalesce("added", empty).alias("added"))


def _names(spans):
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans, their digest, and all spans written out."""
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    every = F.sort_array(F.concat("base", "added"))
    return found.select(id_col, *counts, F.sha2(_names(F.col("base")), 256).alias("base_sha256"), _names(every).alias("spans"))


def _redacted(text: pa.Array, added: pa.Array) -> pa.Array:
    out = []
    for t, more in zip(text.to_pylist(), added.to_pylist(), strict=True):
        if not t:
            out.append(t)
            continue
        spans = base_spans(t) + [(s["start"], s["kind"], s["end"]) for s in more or ()]
        parts, at = [], 0
        for s, k, e in sorted(spans):
            if e <= at:
                continue
            if s >= at:
                parts += [t[at:s], f"<{KINDS[k].upper()}>"]
            at = e
        out.append("".join([*parts, t[at:]]))
    return pa.array(out, pa.string())


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """df with every span replaced by its kind in angle brackets; chars_col, if df has it, is the
    new length where the text changed. Columns and rows are those of df."""
    spans, new, key, text_key = (fresh(df, c) for c in ("added_spans", "clean_text", "found_id", "found_text_key"))
    more = find(df, id_col, text_col).filter(F.size("added") > 0)
    more = more.select(F.col(id_col).alias(key), F.col("text_key").alias(text_key), "added")
    more = cut(more.groupBy(key, text_key).agg(F.min("added").alias(spans)))
    rows = more.count()
    if rows:
        on = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(text_key))
        df = df.join(hinted(more, rows, 512), on, "left").drop(key, text_key)
    else:
        df = df.withColumn(spans, F.array().cast(_SPAN))
    clean = F.arrow_udf(_redacted, "string")
    df = df.withColumn(new, clean(F.col(text_col).cast("string"), F.col(spans)))
    columns = []
    for c in df.columns:
        if c == text_col:
            columns.append(F.col(new).alias(c))
        elif c == chars_col:
            changed = ~F.col(new).eqNullSafe(F.col(text_col))
            columns.append(F.when(changed, F.length(new).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        elif c not in (new, spans):
            columns.append(F.col(c))
    return df.select(*columns)
