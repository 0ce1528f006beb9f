"""Token counts, collocations and manifest against brute-force versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from apportion.llm import collocations, merkle, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, phrase string, digest int, pos string, grp int, pointer string"


def frame(spark, rows):
    """Documents (doc_id, text, lang, source) with extra columns named like internal ones."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "p", 2, "q", 3, "r") for i, t, lang, s in rows], DOCS)


def odd_texts(n, seed, longest=40):
    rnd = random.Random(seed)
    parts = [*"ab Ab  \n\t\r.,;(){}/*▁\x00é中😀0123 ", "the ", "    ", " тест", "<s>", "▁▁", "　", "\xa0", "ing", "\x0b", "\x0c"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, longest))) for _ in range(n)]


AWKWARD = [
    (None, "one two. one two", "en", None),
    (2, None, "en", ""),
    (3, "", None, ""),
    (4, " \n\t ", "en", "é"),
    (1, "same row twice", "en", "a"),
    (1, "same row twice", "en", "a"),
    (1, "same id\nother text", "de", "a"),
    (7, "word " * 60_000 + "\n", None, "a"),
]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts(300, 3)
    return AWKWARD + [(10 + i, t, ("en", "de", None)[i % 3], ("a", "a", "b", None)[i % 4]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def same(got, want):
    key = lambda r: [(x is not None, x if x is not None else 0) for x in r]
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


# Token counts


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_token_counts_are_the_library_s(docs, rows):
    got = token_counts.token_counts(docs, MODEL)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    lib = library()
    want = []
    for i, t, *_ in rows:
        n = len(lib.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert same(got.collect(), want) and any(w[3] for w in want)
    assert token_counts.token_counts(docs.limit(0), MODEL).count() == 0


def test_both_tiers_agree_with_whole_texts():
    """With a full table, an empty one, and one so full that look-ups have to go on."""
    texts = [t.encode() for t in odd_texts(3000, 4)]
    known, want = token_counts.encoder(open(MODEL, "rb").read()), [len(x) for x in library().encode([t.decode() for t in texts])]
    assert known.splits
    units = token_counts.split([t for t in texts if t])
    words = sorted({units.bytes_at(i) for i in range(len(units.starts)) if units.sizes[i] <= 8 * token_counts.WORDS})
    for chosen in ([], words, words[::2]):
        table = token_counts.Table.of(chosen, known.counts(chosen))
        assert known.totals(texts, table).tolist() == want
        found = table.look_up(units)
        inside = np.array([units.bytes_at(i) in set(chosen) for i in range(len(units.starts))])
        assert ((found >= 0) == inside).all()


def test_colliding_slots_are_told_apart(monkeypatch):
    monkeypatch.setattr(token_counts, "SLOTS", 64)
    units = [b" " + bytes([97 + i % 26]) * (1 + i // 26) for i in range(60)]
    table = token_counts.Table.of(units, list(range(60)))
    assert table.probes > 1
    ends = np.cumsum([len(u) for u in units])
    sizes = np.array([len(u) for u in units])
    assert table.look_up(token_counts.Units(b"".join(units), ends - sizes, sizes, ends[:0])).tolist() == list(range(60))


def test_cache_stays_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 8)
    known = token_counts.Encoder(open(MODEL, "rb").read())
    texts = [t.encode() for t in odd_texts(200, 5)]
    assert known.totals(texts, token_counts.Table.of([], [])).tolist() == [len(x) for x in library().encode([t.decode() for t in texts])]
    assert len(known.cache) <= 8


# Collocations


def phrases(rows, longest=3, least=10, first=2000, share=50):
    f, totals = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            f.update((lang, *w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    long = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    held = {(p[0], *q) for p in long for n in range(2, len(p) - 1) for i in range(1, len(p) - n + 1) for q in [p[i : i + n]] if 100 * long[p] >= share * f[(p[0], *q)]}
    best = []
    for p, a in long.items():
        lang, w = p[0], p[1:]
        cuts = [(1_000_000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if p not in held:
            best.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    out, place = [], Counter()
    for lang, score, a, phrase, l, r in sorted(best):
        place[lang] += 1
        if place[lang] <= first:
            out.append((lang, place[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return out


@pytest.fixture(scope="module")
def wordy():
    rnd = random.Random(8)
    words = ["the", "of", "New", "york", "city", "über", "a", "b", "Straße", "東京", "x-y"]
    def text():
        out = []
        for _ in range(rnd.randint(0, 60)):
            out += ["New", "york", "city"] if rnd.random() < 0.1 else [rnd.choice(words)]
            out.append(rnd.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", " \n", ";"]))
        return "".join(out)
    return AWKWARD + [(10 + i, text(), ("en", "de", None)[i % 3], "s") for i in range(120)]


@pytest.mark.parametrize("bits", [64, 7])
def test_collocations(spark, wordy, bits):
    """7 bits make nearly every fingerprint that of several phrases."""
    got = collocations.collocations(frame(spark, wordy), bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert same(got.collect(), phrases(wordy))


def test_collocations_of_four_words_and_few_ranks(spark, wordy):
    got = collocations.collocations(frame(spark, wordy), longest=4, least=5, first=7)
    assert same(got.collect(), phrases(wordy, longest=4, least=5, first=7))
    assert collocations.collocations(frame(spark, wordy).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", 1, big, "a"), ("en", 1, big - 1, "b"), ("en", 2, big - 2, "a b")], "lang string, size int, f long, phrase string")
    row = collocations.scored(counts).first()
    assert row.score == 10**6 * (big - 2) ** 2 // (big * (big - 1))


def test_fingerprints_do_not_depend_on_what_surrounds_a_phrase():
    texts = [b"a New\tYork b", b"new  york", b"x. NEW york, y"]
    stream = collocations.Stream.of(texts)
    seeds = collocations.language_seeds(["en"] * 3)
    keys = collocations.keyed(stream, stream.prints(), stream.grams(2), 2, seeds, 64)
    at = [i for i, w in enumerate(stream.grams(2)) if stream.text(w, 2) == b"new york"]
    assert len(at) == 3 and len(set(keys[at])) == 1 and len(set(keys)) == len(keys) - 2


# Manifest


def joined(xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(row, text):
    i, t, lang, source = row
    fields = (i, source, lang, None if t is None else len(t), text)
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([joined(levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 3 * 3
        out.append((level[run:i], level[i + 1 : run + 3]))
        i //= 3
    return out


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    ordered = [sorted(groups[k], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))) for k in keys]
    trees = [tree([leaf(r, r[1]) for r in g]) for g in ordered]
    top = tree([t[-1][0] for t in trees])
    out = []
    for j, (g, t) in enumerate(zip(ordered, trees, strict=True)):
        for i, r in enumerate(g):
            path = beside(t, i) + beside(top, j)
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            d = leaf(r, r[1].replace("\n", "") if even and r[1] else r[1])
            for left, right in path:
                d = joined([*left, d, *right])
            proof = joined(x for left, right in path for x in left + right)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], proof, d, d == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(docs, rows, levels):
    """Low blocks make several stages of a small table."""
    found = merkle.manifest(docs, levels=levels)
    assert same(merkle.digest(found).collect(), manifest(rows))


def test_versions_copy_only_the_path(docs, rows):
    found = merkle.manifest(docs, levels=2).filter("doc_id >= 10").collect()
    longest = max(len(tree([""] * n)) for n in Counter(r[3] for r in rows).values()) + len(tree([""] * len({r[3] for r in rows})))
    made = [r for r in found if r.changed is not None]
    assert made and all(len(r.copied) <= longest and r.copied[-1] != r.root for r in made if r.changed != r.leaf)
    assert all(r.copied is None for r in found if r.changed is None)


def test_small_manifests(spark):
    assert merkle.manifest(frame(spark, AWKWARD).limit(0)).count() == 0
    for rows in (AWKWARD[:1], AWKWARD[4:6], [(i, "a\nb", "en", f"s{i}") for i in range(11)]):
        assert same(merkle.digest(merkle.manifest(frame(spark, rows), levels=1)).collect(), manifest(rows))


def test_groups_beyond_the_broadcast_limit(spark, docs, rows):
    spark.conf.set("apportion.broadcast.bytes", "0")
    spark.conf.set("apportion.group.rows", "5")
    try:
        assert same(merkle.digest(merkle.manifest(docs, levels=1)).collect(), manifest(rows))
        got = collocations.collocations(docs)
        assert same(got.collect(), phrases(rows))
    finally:
        spark.conf.unset("apportion.broadcast.bytes")
        spark.conf.unset("apportion.group.rows")
