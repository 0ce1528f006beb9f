"""N-gram Jaccard join by parity sketches.

A text is the set of its word shingles. XOR of the shingles' hashes is a sketch: that of two
sets' symmetric difference is the XOR of their sketches. Two sets of a size band that are
similar enough differ in at most D shingles; with the shingles dealt to more than D blocks, at
least one block of the two is the same (pigeonhole). Its 64-bit sketch is the join key. What
meets in a block is tested by sketches in which every shingle toggles a single bit, whose
Hamming distance is never more than the symmetric difference, and then exactly.

Defined results: a text that is null or has no word has no shingle, no class and is linked with
nothing (its component is its own id); a text with fewer words than a shingle has one shingle;
equal sets share a class and a component; repeated rows and repeated ids are rows of their own;
a null id takes part like any other and is never the name of a component that has another id.
Only the id and the text column are read, whatever else the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apportion.llm.langid import fresh
from apportion.llm.words import chunks, lists, mix, rolling, signed, text_bytes, word_hashes
from apportion.operators.graph import connected_components
from apportion.operators.skew import lookup_join
from apportion.session import cut, discard, hinted

STEP = 1.25  # width of a size band
PART = 8 << 20  # bytes of text sketched together
FOLD = 8  # times that the short sketch, which tells unrelated sets apart, is shorter
DEALS = 4  # shares of the keys that are grouped one after the other
TURNS = 4  # times that keys get another center before their classes are tested pair by pair
BEFORE = 8  # smaller keys of a class that a row carries, so that a pair is made at few of its keys


class Bands:
    """Size bands of a similarity of num / den or more, as integer arithmetic.

    The smaller of two similar sets lies in band k and the larger one has at most reach(k)
    elements; they differ in at most diff(k). Blocks go beyond that by some, so that weak blocks,
    those of at most one shingle, need not be keys: many texts share them by chance.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        while self.low[-1] < 1 << 40:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * STEP)))

    def top(self, k: int) -> int:
        return self.low[k + 1] - 1

    def reach(self, k: int) -> int:
        return self.top(k) * self.den // self.num

    def diff(self, k: int) -> int:
        return self.top(k) * (self.den - self.num) // self.num

    @cache
    def blocks(self, k: int) -> tuple[int, int]:
        """Number of blocks of band k and how many of them may be left out if weak.

        Similar sets agree in more blocks than are spare, so in one that neither leaves out.
        """
        least = self.diff(k) + 1
        spare = 0
        for _ in range(8 if least > 1 else 0):
            load = self.low[k] / (least + spare)
            weak = (least + spare) * np.exp(-load) * (1 + load)
            spare = min(least, int(weak + 3 * np.sqrt(weak)) + 1)
        return least + spare, spare

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n elements can be the smaller or the larger one."""
        own = int(np.searchsorted(self.low, n, side="right")) - 1
        out = [own]
        while out[-1] > 0 and self.reach(out[-1] - 1) >= n:
            out.append(out[-1] - 1)
        return out

    def bits(self, n: int) -> int:
        """Length of the long sketch: a power of two, 32 to 64 times the possible difference of
        sets of this size, so that few bits meet and the bound is within some hundredths."""
        return 1 << max(9, int(64 * max(1, 2 * n * (self.den - self.num) // (self.den + self.num))).bit_length() - 1)


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for lo, hi in chunks(texts):
        hashes, border = word_hashes(texts[lo:hi])
        grams = rolling(hashes, n)
        for a, b in zip(border[:-1], border[1:], strict=True):
            yield np.unique(grams[a : b - n + 1] if b - a >= n else rolling(hashes[a:b], int(b - a)) if b > a else hashes[:0])


def set_class(s: np.ndarray) -> int | None:
    """64-bit fingerprint of a shingle set; None for the empty one."""
    if not len(s):
        return None
    return int(signed(mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(len(s))))])))[0])


def parity(s: np.ndarray, bits: int) -> np.ndarray:
    """Sketch of bits bits, as 64-bit words."""
    ones = np.bincount((s >> np.uint64(8)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return signed(np.packbits(ones.astype(np.uint8), bitorder="little").view(np.uint64))


def folded(sketch: np.ndarray, times: int = FOLD) -> np.ndarray:
    """The parity sketch of an 1 / times of the length: parts on top of each other."""
    return np.bitwise_xor.reduce(sketch.reshape(times, -1), axis=0)


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Join keys of a set: the blocks of its sketch in each of its bands, without the weak ones
    if there are no more of them than are spare."""
    out = []
    for k in bands.of(len(s)):
        m, spare = bands.blocks(k)
        # The sets are sorted, and so are their blocks.
        block = (((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        load = np.bincount(block, minlength=m)
        sketch = np.zeros(m, dtype=np.uint64)
        sketch[load > 0] = np.bitwise_xor.reduceat(mix(s), np.concatenate(([0], np.cumsum(load)))[:-1][load > 0])
        keys = mix(sketch ^ mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 40)))
        strong = load > 1
        out.append(keys[strong] if m - strong.sum() <= spare else keys)
    return signed(np.concatenate(out))


PARTS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("class", T.LongType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
        T.StructField("short", T.ArrayType(T.LongType())),
        T.StructField("keys", T.ArrayType(T.LongType())),
        T.StructField("near_keys", T.ArrayType(T.LongType())),
        T.StructField("near", T.ArrayType(T.LongType())),
    ]
)


def _sketched(ids: pa.Field, n: int, bands: Bands):
    """Rows of (id, text) to (id, PARTS).

    Of equal sets in a stretch of PART bytes only the first has a sketch and keys. Of equal keys
    the first stays in keys; the others go to near_keys, with the class that has the first one in
    near. So a group of copies gives each key once for each stretch, however large it is.
    """
    i64 = pa.list_(pa.int64())
    schema = pa.schema([ids, ("n", pa.int64()), ("class", pa.int64()), ("sketch", i64), ("short", i64), ("keys", i64), ("near_keys", i64), ("near", i64)])

    def part(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        sizes, classes, sketches, short, keys, seen = [], [], [], [], [], set()
        for s in shingle_sets(texts, n):
            c = set_class(s)
            fresh = c is not None and c not in seen
            seen.add(c)
            sizes.append(len(s))
            classes.append(c)
            sketches.append(parity(s, bands.bits(len(s))) if fresh else None)
            short.append(folded(sketches[-1]) if fresh else None)
            keys.append(block_keys(s, bands) if fresh else None)
        owner = np.repeat(np.arange(len(keys)), [0 if k is None else len(k) for k in keys])
        flat = np.concatenate([k for k in keys if k is not None] or [np.empty(0, np.int64)])
        _, first, back = np.unique(flat, return_index=True, return_inverse=True)
        head = first[back]
        rest = head != np.arange(len(flat))
        order = np.array([c or 0 for c in classes], dtype=np.int64)

        def split(values: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
            counts = np.bincount(owner[mask], minlength=len(keys))
            return np.split(values[mask], np.cumsum(counts)[:-1]) if len(keys) else []

        return pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(sizes, pa.int64()),
                pa.array(classes, pa.int64()),
                lists(sketches, pa.int64()),
                lists(short, pa.int64()),
                lists(split(flat, ~rest), pa.int64()),
                lists(split(flat, rest), pa.int64()),
                lists(split(order[owner[head]], rest), pa.int64()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for lo, hi in chunks(texts, PART):
                yield part(batch.column(0).slice(lo, hi - lo), texts[lo:hi])

    return run


def arrow_field(df: DataFrame, name: str) -> pa.Field:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.field(name, to_arrow_type(df.schema[name].dataType))


def _hamming_ok(bands: Bands, a: str, b: str, sketch: str = "sketch"):
    """Whether the sketches of a and b leave room for the wanted similarity. A longer sketch is
    folded to the length of the shorter one first, which keeps it a parity sketch."""
    x, y = F.col(f"{a}.{sketch}"), F.col(f"{b}.{sketch}")

    def as_short(long, short):
        half = F.size(long) / 2
        pair = F.zip_with(F.slice(long, 1, half.cast("int")), F.slice(long, half.cast("int") + 1, half.cast("int")), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(long) > F.size(short), pair).otherwise(long)

    bits = F.aggregate(F.zip_with(as_short(x, y), as_short(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    fits = low * bands.den >= high * bands.num
    return F.when(fits, bits * (bands.den + bands.num) <= (low + high) * (bands.den - bands.num)).otherwise(False)


def _verifier(n: int, bands: Bands):
    """Rows of (low, high, left, right), two classes with their texts, to the linked (lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = shingle_sets(text_bytes(batch.column(2)), n)
            right = shingle_sets(text_bytes(batch.column(3)), n)
            keep = []
            for a, b in zip(left, right, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both * bands.den >= (len(a) + len(b) - both) * bands.num)
            out = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["lo", "hi"])

    return run


def _class_of(n: int):
    """Rows of text to (class, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = [set_class(s) for s in shingle_sets(text_bytes(batch.column(0)), n)]
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), batch.column(0)], names=["class", "text"])

    return run


def _ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct classes of two columns."""
    return pairs.select(F.col(a).alias("class")).distinct().union(pairs.select(F.col(b).alias("class")).distinct()).distinct()


def _ordered(met: DataFrame) -> DataFrame:
    """Pairs (low, high) of (class, center), each once."""
    return met.select(F.least("class", "center").alias("low"), F.greatest("class", "center").alias("high")).distinct()


def _near(a: DataFrame, b: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """Join with a table of counted rows, which is broadcast if small enough."""
    return a.join(hinted(b, rows, 32), keys, how)


class JaccardJoin:
    """The join over one table; groups() has the classes' components, rows() every row's."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int):
        self.bands, self.n = Bands(num, den), n
        self.docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        schema = T.StructType([T.StructField("id", self.docs.schema["id"].dataType), *PARTS.fields])
        self.parts = cut(self.docs.mapInArrow(_sketched(arrow_field(self.docs, "id"), n, self.bands), schema))

    def _members(self) -> tuple[DataFrame, list[DataFrame]]:
        """(key, class, center) of keys that several classes have, center being one of them, and
        the tables that hold it.

        Most keys are of one class only, and a shuffle is needed to know it. They go through it
        in DEALS equal shares, whose files are freed in turn. The parts then lose their keys.
        """
        here = self.parts.select(F.explode(F.arrays_zip("near_keys", "near")).alias("x"), "class")
        here = here.select(F.col("x.near_keys").alias("key"), "class", F.col("x.near").alias("center"))
        tables = [cut(here.union(here.select("key", F.col("center").alias("class"), "center")))]
        w = F.min("class").over(_by("key")), F.max("class").over(_by("key"))
        for deal in range(DEALS):
            there = self.parts.select(F.explode("keys").alias("key"), "class").filter(F.pmod("key", F.lit(DEALS)) == deal)
            there = there.select("key", "class", w[0].alias("center"), w[1].alias("last"))
            tables.append(cut(there.filter("center < last").drop("last")))
        parts, self.parts = self.parts, cut(self.parts.select("id", "n", "class", "sketch", "short"))
        discard(parts)
        return reduce(DataFrame.union, tables), tables

    def _texts(self, pairs: DataFrame) -> DataFrame:
        """(class, text) of every class in pairs, one text for each."""
        need = cut(_ends(pairs, "low", "high"))
        rows = need.count()
        ids = cut(_near(self.parts.select("id", "class"), need, ["class"], rows).groupBy("class").agg(F.min("id").alias("id")))
        # An id can name several rows, so the class is found anew from the text.
        wanted = ids.select(F.col("id").alias("wanted")).distinct()
        wanted = hinted(wanted, rows, 32)
        found = self.docs.join(wanted, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
        found = found.mapInArrow(_class_of(self.n), "class long, text string")
        texts = cut(_near(found, need, ["class"], rows, "left_semi").dropDuplicates(["class"]))
        discard(need, ids)
        return texts

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Links (lo, hi) among pairs (low, high) of classes."""
        texts = self._texts(pairs)
        left = texts.select(F.col("class").alias("low"), F.col("text").alias("left"))
        right = texts.select(F.col("class").alias("high"), F.col("text").alias("right"))
        both = pairs.join(right, "high").join(left, "low").select("low", "high", "left", "right")
        links = cut(both.mapInArrow(_verifier(self.n, self.bands), "lo long, hi long"))
        discard(texts)
        return links

    def groups(self) -> DataFrame:
        """(class, component) of all classes that meet others; component is a class.

        First every class is tested against one class it meets, then against the centers of all
        its blocks that are still in another component, then some times against other centers,
        drawn by hash. That joins groups of near copies without their pairs. What still meets
        across components is then tested pair by pair, so no link that would join two components
        is missed.
        """
        members, tables = self._members()
        met = cut(members.filter("class <> center").groupBy("class", "center").count())
        need = cut(_ends(met, "class", "center"))
        size = need.count()
        nodes = need.select(F.col("class").alias("node"))

        def labelled(links: DataFrame) -> DataFrame:
            return connected_components(links, nodes).select(F.col("node").alias("class"), "component")

        best = met.groupBy("class").agg(F.max_by("center", F.struct("count", "center")).alias("center"))
        tried = cut(_ordered(best))
        links = self._verified(self._possible(tried))
        label = labelled(links)
        apart = cut(self._apart(_ordered(met), label, size))
        more = cut(apart.join(tried, ["low", "high"], "left_anti"))
        tried = tried.union(more)
        more = self._possible(more)
        if more.limit(1).count():
            links = links.union(self._verified(more))
            label = labelled(links)
            apart = cut(self._apart(apart, label, size))

        # The rows of a key link all its classes by way of centers, so a key whose classes lie in
        # several components has a row that does.
        n_apart = apart.count()
        if not n_apart:
            discard(met, *tables)
            return label
        both = members.withColumns({"low": F.least("class", "center"), "high": F.greatest("class", "center")})
        open_keys = cut(_near(both, apart, ["low", "high"], n_apart, "left_semi").select("key").distinct())
        rest = cut(_near(members.select("key", "class"), open_keys, ["key"], open_keys.count(), "left_semi").distinct())
        discard(met, open_keys, *tables)
        for turn in range(TURNS):
            rest = self._open(rest, label, size, turn)
            more = rest.filter(F.col("component") != F.col("lead.component"))
            more = more.select("class", F.col("lead.class").alias("center"))
            more = cut(_ordered(more).join(tried, ["low", "high"], "left_anti"))
            tried = tried.union(more)
            more = self._possible(more)
            found = self._verified(more) if more.limit(1).count() else more
            if not found.limit(1).count():
                break
            links = links.union(found)
            label = labelled(links)
        rest = self._open(rest, label, size, TURNS)
        pairs = self._possible(self._across(rest, size).distinct().join(tried, ["low", "high"], "left_anti"))
        return labelled(links.union(self._verified(pairs))) if pairs.limit(1).count() else label

    @staticmethod
    def _open(rest: DataFrame, label: DataFrame, size: int, turn: int) -> DataFrame:
        """(key, class, component, lead) of the keys whose classes lie in several components; lead
        is the class and component of one of the key's rows, drawn anew each turn. Takes the place
        of the table rest."""
        rows = lookup_join(rest.select("key", "class"), label, ["class"], size, ["key"], row_bytes=16)
        lead = F.max(F.struct(F.xxhash64("key", "class", F.lit(turn)).alias("draw"), "class", "component"))
        ends = {"first": F.min("component"), "last": F.max("component"), "lead": lead}
        rows = rows.withColumns({name: x.over(_by("key")) for name, x in ends.items()})
        rows = cut(rows.filter("first < last").drop("first", "last"))
        discard(rest)
        return rows

    def _across(self, rest: DataFrame, size: int) -> DataFrame:
        """Pairs (low, high) of classes that have a key of rest but not the component in common and
        that the short sketches leave room for. Takes the place of the table rest.

        Similar classes have many keys in common. A pair is made at its smallest common key, and at
        another one only if none of the last BEFORE keys of either class is common as well.
        """
        before = F.collect_list("key").over(_by("class").orderBy("key").rowsBetween(-BEFORE, -1))
        rows = rest.select("key", "class", "component", before.alias("before"))
        known = self._sketches(rest.select("class").distinct(), "short")
        own = known.select("class", F.struct("n", "short").alias("own"))
        rows = cut(lookup_join(rows, own, ["class"], size, ["key"], row_bytes=512))
        discard(rest, known)
        a, b = rows.alias("a"), rows.alias("b")
        apart = (F.col("a.key") == F.col("b.key")) & (F.col("a.component") < F.col("b.component"))
        fresh = ~F.arrays_overlap("a.before", "b.before")
        across = a.join(b, apart & _hamming_ok(self.bands, "a.own", "b.own", "short") & fresh)
        return across.select(F.least("a.class", "b.class").alias("low"), F.greatest("a.class", "b.class").alias("high"))

    def _sketches(self, classes: DataFrame, sketch: str) -> DataFrame:
        """(class, n, sketch) of distinct classes."""
        classes = cut(classes)
        own = self.parts.filter(F.col(sketch).isNotNull()).select("class", "n", sketch)
        known = cut(_near(own, classes, ["class"], classes.count(), "left_semi").dropDuplicates(["class"]))
        discard(classes)
        return known

    def _possible(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (low, high) that the short and then the long sketches leave room for."""
        pairs = cut(pairs)
        for sketch, row_bytes in (("short", 512), ("sketch", 2048)):
            known = self._sketches(_ends(pairs, "low", "high"), sketch)
            size = known.count()
            out = pairs
            for end in ("low", "high"):
                own = known.select(F.col("class").alias(end), F.struct("n", sketch).alias(f"{end}_set"))
                out = lookup_join(out, own, [end], size, ["low" if end == "high" else "high"], row_bytes=row_bytes)
            out = cut(out.filter(_hamming_ok(self.bands, "low_set", "high_set", sketch)).select("low", "high"))
            discard(known, pairs)
            pairs = out
        return pairs

    @staticmethod
    def _apart(pairs: DataFrame, label: DataFrame, rows: int) -> DataFrame:
        """Pairs (low, high) of classes that are in different components."""
        for end in ("low", "high"):
            own = label.select(F.col("class").alias(end), F.col("component").alias(f"{end}_in"))
            pairs = lookup_join(pairs, own, [end], rows, ["low" if end == "high" else "high"], row_bytes=16)
        return pairs.filter("low_in <> high_in").select("low", "high")

    def rows(self) -> DataFrame:
        """(id, n_shingles, class, component, component_id) of every row of the table; component
        is one of the linked classes, so that it tells groups apart also where ids repeat."""
        groups = self.groups()
        own = self.parts.select("id", "n", "class")
        own = lookup_join(own, groups, ["class"], groups.count(), ["id"], how="left", row_bytes=16)
        own = cut(own.withColumn("component", F.coalesce("component", "class")))
        discard(self.parts)
        names = cut(own.filter("component is not null").groupBy("component").agg(F.min("id").alias("name")))
        named = lookup_join(own, names, ["component"], names.count(), ["id"], how="left", row_bytes=16)
        return named.select("id", F.col("n").alias("n_shingles"), "class", "component", F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"))


def _by(key: str):
    from pyspark.sql import Window

    return Window.partitionBy(key)


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row for each row of df: id_col, n_shingles, class (fingerprint of the shingle set,
    the same for copies), component (one class of the linked ones) and component_id, the smallest
    id reachable by links of a Jaccard similarity of num / den or more."""
    rows = JaccardJoin(df, id_col, text_col, n, num, den).rows()
    return rows.withColumnRenamed("id", id_col)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """df with one row of each group of linked rows: the one with the smallest id, and of
    several with that id the first by the other columns. Rows without words all stay.

    Columns are those of df. Decisions are keyed by id and shingle class, so repeated ids do
    no harm.
    """
    own = cut(jaccard_groups(df, id_col, text_col, n, num, den))
    own = own.select(F.col(id_col).alias("_id"), F.col("class").alias("_class"), F.col("component").alias("_component"))
    own = own.filter("_class is not null")
    lead = own.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_class")).alias("lead"))
    counts = own.groupBy("_id", "_class", "_component").agg(F.count(F.lit(1)).alias("times"))
    lead = lead.select(F.col("_component").alias("_to"), F.col("lead._class").alias("lead_class"), F.col("lead._id").alias("lead_id"))
    judged = counts.join(lead, F.col("_component") == F.col("_to"))
    stays = F.col("_id").eqNullSafe(F.col("lead_id")) & (F.col("_class") == F.col("lead_class"))
    judged = cut(judged.select("_id", "_class", stays.alias("stays"), "times").filter("not stays or times > 1"))
    n_judged = judged.count()
    if not n_judged:
        return df
    own, key, cls = (fresh(df, c) for c in ("own_class", "judged_id", "judged_class"))
    marked = df.withColumn(own, _class_column(n)(F.col(text_col).cast("string")))
    judged = judged.withColumnsRenamed({"_id": key, "_class": cls})
    on = (F.col(own) == F.col(cls)) & F.col(id_col).eqNullSafe(F.col(key))
    single = marked.join(hinted(judged.drop("stays", "times"), n_judged, 48), on, "left_anti").drop(own)
    again = judged.filter("stays").drop("stays", "times")
    repeated = marked.join(hinted(again, n_judged, 48), on, "left_semi")
    # One of the repeated rows with the lead's id and class, by the order of the other columns.
    order = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    one = repeated.groupBy(own).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row"))
    return single.union(one.select("row.*"))


def _class_column(n: int):
    @F.pandas_udf("long")
    def classes(texts):
        import pandas as pd

        data = ["" if t is None else t for t in texts]
        found = [set_class(s) for s in shingle_sets([t.encode("utf-8", "surrogatepass") for t in data], n)]
        return pd.Series(found, dtype="Int64")

    return classes
