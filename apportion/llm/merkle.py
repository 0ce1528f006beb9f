r"""Merkle manifest of a dataset as a persistent, path-copying tree.

Every row is a leaf: the sha256 of its fields, each written as its UTF-8 byte count, a colon and
its value, or a dash for null. The leaves of a group ascend by id; every FANOUT consecutive nodes
become a node of the next level until one is left, the subroot. The subroots, ordered by group,
become the root the same way. Digests are hashed as hex text.

Positions come from a written range order and small counts of its partitions, so no group passes
through one task. A stage takes aligned blocks of FANOUT ** LEVELS nodes; each block is one small
group that becomes a block root, and the block roots are the next stage's nodes. Stages shrink by
that factor until every group has one node.

The stored tree is never changed. A tampered row is a version of it: within its block only the
nodes above the leaf are copied, all others are shared; then the version goes on through the
upper stages, whose nodes beside its path were joined to the block from above. Versions of
different rows are independent of each other, so they are made where the rows are.

Defined results: null fields are dashes; the null group is a group, the first one, and differs
from an empty string; a null id comes first in its group and is never tampered with; equal ids
of a group are ordered by their leaves, so equal rows give equal results up to their order, and
each row is a leaf of its own; tampering that changes nothing gives the stored root; an empty
table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apportion.llm.jaccard import arrow_field
from apportion.operators.skew import lookup_join
from apportion.session import cut, hinted

FANOUT = 3
LEVELS = 7  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RANK = "array<struct<left:string,right:string>>"  # siblings beside a path, level by level


def field(value: Column) -> Column:
    """A field as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def without_lines(text: Column) -> Column:
    """The tampering: a text without its line feeds."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def _join(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def height(nodes: Column) -> Column:
    """Levels above that many nodes: the least h with FANOUT ** h nodes or more, in integers."""
    powers = [FANOUT**h for h in range(40)]
    return F.size(F.filter(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p: p < nodes))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with pos, their place from 0 in the order of their group, and nodes, the group's
    number of rows. Written in range order; the place in a partition and counts of partitions
    give the rest, so a group may span any number of tasks."""
    rows = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    at = F.monotonically_increasing_id()
    rows = cut(rows.withColumns({"part": F.shiftright(at, 33), "row": at.bitwiseAND((1 << 33) - 1)}))
    counts = cut(rows.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    offsets = counts.select("grp", "part", shift.alias("shift"), F.sum("n").over(group).alias("nodes"))
    rows = rows.join(hinted(offsets, counts.count(), 128), ["grp", "part"])
    return rows.withColumn("pos", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _levels(digests: list[str], height: int) -> list[list[str]]:
    """All levels of a block, from its nodes up to its root; the lowest levels of the tree."""
    out = [digests]
    for _ in range(height):
        low = out[-1]
        out.append([_join(low[i : i + FANOUT]) for i in range(0, len(low), FANOUT)])
    return out


def _beside(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """Digests left and right of the path from node at to the block's root, joined by level."""
    out = []
    for level in levels[:-1]:
        run = at - at % FANOUT
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + FANOUT])))
        at //= FANOUT
    return out


def _copied(digest: str, beside: list[tuple[str, str]]) -> list[str]:
    """The nodes that a version copies: those above a changed node, up to the root."""
    out = []
    for left, right in beside:
        digest = _join([left, digest, right])
        out.append(digest)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Runs of rows of one (grp, block) of a partition that is sorted by them and pos."""
    key, wait = None, None
    for batch in batches:
        columns = batch.to_pydict()
        keys = list(zip(columns["grp"], columns["block"], strict=True))
        lo = 0
        while lo < len(keys):
            if keys[lo] != key:
                if wait:
                    yield wait
                key, wait = keys[lo], {c: [] for c in columns}
            hi = lo
            while hi < len(keys) and keys[hi] == key:
                hi += 1
            for c, values in columns.items():
                wait[c].extend(values[lo:hi])
            lo = hi
    if wait:
        yield wait


def _dealt(nodes: DataFrame) -> DataFrame:
    """Blocks of nodes whole in one task each, in order."""
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The block root of every block."""
    out: dict[str, list] = {"grp": [], "block": [], "nodes": [], "digest": []}
    for block in _blocks(batches):
        out["grp"].append(block["grp"][0])
        out["block"].append(block["block"][0])
        out["nodes"].append(block["blocks"][0])
        out["digest"].append(_levels(block["digest"], block["rise"][0])[-1][0])
        if len(out["grp"]) >= 1000:
            yield pa.RecordBatch.from_pydict(out)
            out = {k: [] for k in out}
    if out["grp"]:
        yield pa.RecordBatch.from_pydict(out)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is beside the path of every node within its block."""
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for block in _blocks(batches):
        levels = _levels(block["digest"], block["rise"][0])
        beside = [[{"left": x, "right": y} for x, y in _beside(levels, i)] for i in range(len(block["digest"]))]
        rows = {c: pa.array(block[c]) for c in ("grp", "block", "pos")}
        yield pa.RecordBatch.from_pydict(rows | {"beside": pa.array(beside, kind)})


def _blocked(nodes: DataFrame, levels: int) -> DataFrame:
    size = FANOUT**levels
    rise = F.least(height(F.col("nodes")), F.lit(levels))
    blocks = F.floor((F.col("nodes") + size - 1) / size).cast("long")
    return nodes.withColumns({"block": F.floor(F.col("pos") / size).cast("long"), "rise": rise, "blocks": blocks})


class Tree:
    """Stages of one forest. A stage holds the nodes (grp, pos, nodes, digest, block, rise)."""

    def __init__(self, nodes: DataFrame, levels: int = LEVELS):
        self.stages: list[DataFrame] = []
        stage = _blocked(nodes, levels)
        while True:
            self.stages.append(stage)
            found = _dealt(stage.select("grp", "block", "pos", "blocks", "rise", "digest")).mapInArrow(
                _roots, "grp string, block long, nodes long, digest string"
            )
            roots = cut(found.withColumnRenamed("block", "pos"))
            if roots.filter("nodes > 1").isEmpty():
                self.roots = roots.select("grp", "digest")
                return
            stage = _blocked(roots, levels)

    def above(self) -> DataFrame:
        """beside: siblings of each lowest block's path from its root to its group's root."""
        found: DataFrame | None = None
        for stage in reversed(self.stages[1:]):
            own = _dealt(stage.select("grp", "block", "pos", "rise", "digest")).mapInArrow(
                _paths, f"grp string, block long, pos long, beside {_RANK}"
            )
            if found is not None:
                own = own.join(found.withColumnRenamed("beside", "upper"), ["grp", "block"])
                own = own.withColumn("beside", F.concat("beside", "upper"))
            found = cut(own.select("grp", F.col("pos").alias("block"), "beside"))
        if found is not None:
            return found
        blocks = self.stages[0].select("grp", "block").distinct()
        return blocks.withColumn("beside", F.array().cast(_RANK))


def _versions(id_type: pa.DataType):
    """Blocks, each led by a row of what is above it, to leaves with proofs and versions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _versioned(block, id_type)

    return run


def _versioned(block: dict[str, list], id_type: pa.DataType) -> pa.RecordBatch:
    above = [(x["left"], x["right"]) for x in block["above"][0]]
    rows = {c: block[c][1:] for c in ("id", "digest", "changed")}
    levels = _levels(rows["digest"], block["rise"][1])
    root = [levels[-1][0], *_copied(levels[-1][0], above)][-1]
    proofs, copies = [], []
    for i, changed in enumerate(rows["changed"]):
        beside = _beside(levels, i) + above
        proofs.append("".join(x + y for x, y in beside))
        copies.append(None if changed is None else _copied(changed, beside))
    size = len(proofs)
    rows |= {"subroot": [block["subroot"][0]] * size, "root": [root] * size}
    fixed = {c: pa.array(v, pa.string()) for c, v in rows.items() if c != "id"}
    return pa.RecordBatch.from_pydict({"id": pa.array(rows["id"], id_type), **fixed, "proof": pa.array(proofs), "copied": pa.array(copies, pa.list_(pa.string()))})


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    text_col: str = "text",
    tampered: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root, proof (siblings from the leaf to
    the root as joined hex), changed (the tampered leaf, null where the row is as stored) and
    copied (the nodes of the row's version, its root last; null without a version).

    tampered says which rows are tampered with; by default those with an even crc32 of the id.
    levels is the height of a block.
    """
    # An equals sign keeps the empty group apart from, and behind, the null one.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    if tampered is None:
        tampered = F.crc32(F.col(id_col).cast("string")) % 2 == 0
    stored = leaf([F.col(c) for c in fields])
    other = leaf([without_lines(F.col(c)) if c == text_col else F.col(c) for c in fields])
    rows = docs.select(
        F.col(id_col).alias("id"),
        grp.alias("grp"),
        stored.alias("digest"),
        F.when(F.coalesce(tampered, F.lit(False)), other).alias("changed"),
    )
    # Hashed once: finding the ranges reads the rows another time.
    lower = Tree(ranked(cut(rows), ["id", "digest", "changed"]), levels)
    groups = ranked(lower.roots.select(F.lit("").alias("grp"), F.col("grp").alias("own"), "digest"), ["own"])
    upper = Tree(groups, levels)
    # From a group's root to the root: within its block of groups, then above that.
    top = upper.stages[0]
    within = _dealt(top.select("grp", "block", "pos", "rise", "digest")).mapInArrow(_paths, f"grp string, block long, pos long, beside {_RANK}")
    high = within.join(upper.above().withColumnRenamed("beside", "upper"), ["grp", "block"])
    high = high.select("pos", F.concat("beside", "upper").alias("high"))
    known = cut(top.select("pos", F.col("own").alias("grp"), F.col("digest").alias("subroot")).join(high, "pos").drop("pos"))
    paths = lookup_join(lower.above(), known, ["grp"], known.count(), ["block"], row_bytes=4096)
    leads = paths.select("grp", "block", F.lit(-1).cast("long").alias("pos"), "subroot", F.concat("beside", "high").alias("above"))
    # What is above a block travels once, as the row that leads it.
    nodes = lower.stages[0].select("grp", "block", "pos", "rise", "id", "digest", "changed")
    dealt = _dealt(nodes.unionByName(leads, allowMissingColumns=True))
    kind = nodes.schema["id"].dataType.simpleString()
    found = dealt.mapInArrow(
        _versions(arrow_field(nodes, "id").type), f"id {kind}, digest string, changed string, subroot string, root string, proof string, copied array<string>"
    )
    return found.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "proof", "changed", "copied")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of a check of the manifest: every row's root as recomputed from its tampered
    or stored leaf."""
    folded = F.when(F.col("changed").isNull(), F.col("root")).otherwise(F.coalesce(F.try_element_at("copied", F.lit(-1)), F.col("changed")))
    return found.select(
        id_col, "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


# crc32 of the id's digits, a byte at a time and in it a bit at a time.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
)
# Levels by recursion: lv holds every node, climb goes up from every leaf.
SQL = f"""WITH RECURSIVE tampered AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN crc_even THEN replace(text, chr(10), '') ELSE text END AS other FROM
    (SELECT *, coalesce({_CRC} % 2 = 0, false) AS crc_even FROM documents)),
fields AS (SELECT doc_id, source,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS t, coalesce(strlen(other) || ':' || other, '-') AS o FROM tampered),
leaves AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || t) AS leaf, sha256(head || o) AS changed FROM fields),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos FROM leaves),
lv AS (
  SELECT g, 0 AS h, pos, leaf AS d, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, h + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM lv WHERE n > 1 GROUP BY g, h, pos // 3),
low AS MATERIALIZED (SELECT * FROM lv),
subs AS MATERIALIZED (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE n = 1),
tv AS (
  SELECT 0 AS h, pos, subroot AS d, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT h + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM tv WHERE n > 1 GROUP BY h, pos // 3),
top AS MATERIALIZED (SELECT * FROM tv),
base AS MATERIALIZED (SELECT p.*, s.subroot, s.pos AS spot, (SELECT d FROM top WHERE n = 1) AS root, row_number() OVER () AS id FROM placed p JOIN subs s USING (g)),
beside_low AS MATERIALIZED (SELECT a.g, a.h, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM low a JOIN low b ON a.g = b.g AND a.h = b.h AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.g, a.h, a.pos),
beside_top AS MATERIALIZED (SELECT a.h, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.h = b.h AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.h, a.pos),
climb AS (
  SELECT id, g, 0 AS h, pos, changed AS d, '' AS proof FROM base
  UNION ALL
  SELECT c.id, c.g, c.h + 1, c.pos // 3, sha256(s.l || c.d || s.r), c.proof || s.l || s.r FROM climb c JOIN beside_low s ON c.g = s.g AND c.h = s.h AND c.pos = s.pos),
mid AS MATERIALIZED (SELECT id, arg_max(d, h) AS d, arg_max(proof, h) AS proof FROM climb GROUP BY id),
rise AS (
  SELECT id, 0 AS h, spot AS pos, m.d, m.proof FROM base JOIN mid m USING (id)
  UNION ALL
  SELECT c.id, c.h + 1, c.pos // 3, sha256(s.l || c.d || s.r), c.proof || s.l || s.r FROM rise c JOIN beside_top s ON c.h = s.h AND c.pos = s.pos),
ended AS (SELECT id, arg_max(d, h) AS d, arg_max(proof, h) AS proof FROM rise GROUP BY id)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.d AS folded_root, e.d = root AS verified FROM base JOIN ended e USING (id)"""
