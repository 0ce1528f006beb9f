"""Corpus operators against brute-force versions, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import prose, vocabulary

from apportion.llm import compression, decontaminate, html_text, jaccard, langid, mixing, perplexity, pii, quotes, suffix_tree
from apportion.llm.words import rolling, word_hashes
from apportion.session import cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `key` string, class int, row double, n string, low int"


def frame(spark, rows):
    """Documents with extra columns named like internal ones."""
    full = [(i, t, lang, "s", None if t is None else len(t), "k", 7, 0.5, None, 3) for i, t, lang in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (None, "one two three four five six seven", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \n\t ", "en"),
    (5, "12345 !!! ###", "de"),
    (6, "x", None),
    (1, "same row twice here in this table", "en"),
    (1, "same row twice here in this table", "en"),
    (1, "same id but another text in this table", "de"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    rnd = random.Random(5)
    words = vocabulary(1, "abcdefghij")
    long = (7, " ".join(rnd.choice(words) for _ in range(60_000)), "en")
    more = [(100 + i, prose(rnd, words, 80), "en") for i in range(8)]
    return frame(spark, AWKWARD + [long, *more])


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


def test_words_follow_the_definition():
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("aB é\t\n\x0b\x0c\r  x") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    hashes, border = word_hashes([t.encode() for t in texts])
    seen = {}
    for t, a, b in zip(texts, border[:-1], border[1:], strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert b - a == len(words)
        for w, h in zip(words, hashes[a:b], strict=True):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            assert seen.setdefault(low, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(rolling(hashes[:3], 4)) == 0


def brute_components(rows, n, num, den):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            names[find(i)] = min(names.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), names.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_jaccard_matches_brute_force(spark, n, num, den):
    rnd = random.Random(9)
    words = vocabulary(3, "abcdef", 60)
    rows, i = [], 0
    for size in (3, 4, 6, 12, 30, 70, 150, 400):
        for _ in range(5):
            base = [rnd.choice(words) for _ in range(size)]
            for edits in (0, 0, 1, 2, 3, 6, size // 12, size // 9):
                copy = list(base)
                for _ in range(edits):
                    if not copy:
                        break
                    at = rnd.randrange(len(copy))
                    copy[at : at + 1] = rnd.choice(([], [rnd.choice(words)], [copy[at], rnd.choice(words)]))
                rows.append((i, " ".join(copy), "en"))
                i += 1
    rows += AWKWARD
    rnd.shuffle(rows)
    got = jaccard.jaccard_groups(frame(spark, rows), n=n, num=num, den=den)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(brute_components(rows, n, num, den))


def test_near_duplicate_stage(spark, awkward, nothing):
    rows = [tuple(r)[:3] for r in awkward.collect()]
    kept = jaccard.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    got = Counter(r.text for r in kept.collect())
    want = Counter(t for _, t, _ in rows)
    want["same row twice here in this table"] = 1
    assert got == want
    copies = frame(spark, [(i, "a text that occurs many times over in all of this small table", "en") for i in (9, 3, None, 4)] * 2)
    assert [(r.doc_id, r.lang) for r in jaccard.drop_near_duplicates(copies).collect()] == [(3, "en")]
    assert jaccard.drop_near_duplicates(nothing).count() == 0


def test_jaccard_looks_again_only_at_open_keys(spark, monkeypatch):
    """Keys whose classes are joined already are not placed in components again."""
    rnd = random.Random(7)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    base = words(200)
    joined = [(i, " ".join([*base[: 10 * i], f"x{i}", *base[10 * i + 1 :]]), "en") for i in range(1, 9)]
    written = []

    def spy(df):
        out = cut(df)
        if {"key", "class", "component"} <= set(df.columns) and "short" not in df.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", spy)

    got = jaccard.jaccard_groups(frame(spark, joined), n=1, num=4, den=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(joined, 1, 4, 5))
    assert {r.component_id for r in got} == {1}
    assert written == []


def test_pigeonhole_holds():
    bands = jaccard.Bands(85, 100)
    for n in (1, 2, 5, 6, 7, 13, 40, 100, 999, 5000):
        for k in bands.of(n):
            assert bands.low[k] <= n <= bands.reach(k)
            m, spare = bands.blocks(k)
            assert m - spare > bands.diff(k)
        for other in range(n, n * 100 // 85 + 1):
            assert set(bands.of(n)[:1]) <= set(bands.of(other))


def test_language(spark, awkward, nothing):
    rnd = random.Random(4)
    one, two = vocabulary(5, "abcdefgh"), vocabulary(6, "stuvwxyzé")
    rows = [(i, prose(rnd, one if i % 2 else two, 60), "aa" if i % 2 else "bb") for i in range(40)]
    mixed = prose(rnd, one, 30) + " " + prose(rnd, two, 50)
    docs = frame(spark, rows)
    model = langid.learn(docs)
    got = frame(spark, [*rows, (99, mixed, "aa"), (98, "привет мир", None), *AWKWARD])
    got = got.select("doc_id", "text", "lang", langid.language(F.col("text"), model, spark).alias("x")).collect()
    for r in got:
        if r.doc_id is not None and 8 <= r.doc_id < 98:
            assert r.x.lang == r.lang and 0.9 < r.x.score <= 1
        if not r.text or not re.search(r"[^\W\d_]", r.text):
            assert (r.x.lang, r.x.score, r.x.span_langs) == ("und", 0.0, [])
    m = next(r.x for r in got if r.doc_id == 99)
    assert m.lang == "bb" and m.span_langs == ["aa", "bb"]
    assert mixed[m.span_starts[1] :].startswith(mixed.split(" ")[30])
    assert next(r.x for r in got if r.doc_id == 98).lang in ("aa", "bb")
    kept = langid.keep_known_language(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()}.isdisjoint({2, 3, 4, 5})
    assert langid.keep_known_language(nothing).count() == 0
    assert langid.learn(nothing).langs == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 4, 6, 2]
    border = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(sum(sizes), 3)) * 4
    labels = langid.viterbi(scores, border, 2.0)
    from itertools import product

    for a, b in zip(border[:-1], border[1:], strict=True):
        if a == b:
            continue
        value = lambda path: sum(scores[a + i, p] for i, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(product(range(3), repeat=int(b - a)), key=value)
        assert value(labels[a:b]) == pytest.approx(value(best))


def test_decontamination_matches_brute_force(spark, awkward, nothing):
    rnd = random.Random(8)
    words = vocabulary(7, "abcdefgh", 300)
    items = [(i, prose(rnd, words, n)) for i, n in enumerate((40, 25, 13, 12, 9, 7, 2))] + [(90, None), (91, ""), (92, None)]
    items.append((50, items[0][1]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, prose(rnd, words, 120), "en") for i in range(20)]
    for i, (_, text) in enumerate(items[:6]):
        for changes in range(4):
            part = text.upper().split(" ")
            for at in rnd.sample(range(len(part)), min(changes, len(part))):
                part[at] = "changed"
            rows.append((100 + 10 * i + changes, f"{prose(rnd, words, 30)} -- {' '.join(part)} ## {prose(rnd, words, 30)}", "en"))
    rows += AWKWARD
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    want = {}
    for d, t, _ in rows:
        doc = split(t)
        for item, text in items:
            it = split(text)
            size = min(len(it), decontaminate.WINDOW)
            if len(it) < decontaminate.SHORTEST:
                continue
            allowed = decontaminate.SUBSTITUTIONS if size == decontaminate.WINDOW else 0
            for a in range(len(doc) - size + 1):
                for b in range(len(it) - size + 1):
                    wrong = sum(x != y for x, y in zip(doc[a : a + size], it[b : b + size], strict=True))
                    if wrong <= allowed:
                        old = want.setdefault(d, {}).get(a, (9, 999))
                        want[d][a] = (min(old[0], wrong), min(old[1], item))
    got = {r.doc_id: (r.n_windows, r.n_exact, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {d: (len(x), sum(w == 0 for w, _ in x.values()), min(i for _, i in x.values())) for d, x in want.items()}
    kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert kept.count() == sum(d not in want for d, *_ in rows) and kept.columns == awkward.columns
    assert decontaminate.drop_contaminated(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()


def test_masks_meet_every_allowed_difference():
    from itertools import combinations

    seeds = [set(m) for m in decontaminate.masks()]
    for wrong in combinations(range(decontaminate.WINDOW), decontaminate.SUBSTITUTIONS):
        assert any(not s & set(wrong) for s in seeds)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_base_spans_match_the_patterns():
    rnd = random.Random(6)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", ".", "..", "+", "12", "0.0.0.0.1", "é", " ", "-", "\n", "a@b.c@d.e.f", "%"]
    for _ in range(4000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 200_000 + "@") == [] and len(pii.base_spans("1" * 200_000 + " 4111111111111111")) <= 1


def test_pii_finds_unseen_identifiers(spark, awkward, nothing):
    rows = [(i, f"please write to user{i}@mail.example.org today, thank you", "en") for i in range(12)]
    rows += [(50, "please write to agent7745[at]mail.example.org today, thank you", "en"), (51, "the number 123456 stands alone here", "en")]
    found = {r.doc_id: r for r in pii.find(frame(spark, rows + AWKWARD)).collect()}
    assert all(len(found[i].base) == 1 and not found[i].added for i in range(12) if i not in (1, 2, 3, 4, 5, 6))
    (added,) = found[50].added
    assert (added.kind, rows[12][1][added.start : added.end]) == (0, "agent7745[at]mail.example.org")
    assert not found[51].added
    table = {(r.doc_id, r.spans): r for r in pii.digest(pii.find(frame(spark, rows))).collect()}
    assert (50, "email:16:45") in table and table[(50, "email:16:45")].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(frame(spark, rows + AWKWARD))
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[50].text == "please write to <EMAIL> today, thank you" and by_id[50].n_chars == len(by_id[50].text)
    assert by_id[51].text == rows[13][1] and by_id[2].text is None and clean.columns == awkward.columns
    assert clean.count() == len(rows) + len(AWKWARD) and pii.redact(nothing).count() == 0 and pii.find(nothing).count() == 0


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_mixing_meets_its_targets(spark, awkward, nothing):
    rnd = random.Random(3)
    good, bad, rude = vocabulary(11, "abcdef", 60), vocabulary(12, "uvwxyz", 60), vocabulary(13, "klmnop", 60)
    rows, labels = [], []
    for i in range(240):
        kind = i % 4
        rows.append((i, prose(rnd, (good, good, bad, rude)[kind], 40 + i % 17), "en"))
        if i < 160:
            labels.append((i, int(kind < 2), int(kind == 3)))
    plan, domains = mixing.mixed(frame(spark, rows), labelled(spark, labels + [(0, 1, 0), (None, 1, 1), (7777, None, None)]))
    got = plan.collect()
    assert domains == ["clean", "low_quality", "toxic"] and all(r.rate >= 0 and r.copies >= 0 for r in got)
    mass = [sum(r.n_tokens * r.rate * r[f"p{i}"] for r in got) for i in range(3)]
    assert [m / sum(mass) for m in mass] == pytest.approx([0.93, 0.05, 0.02], abs=0.01)
    hits = sum(max(range(3), key=lambda k, r=r: r[f"p{k}"]) == (0, 0, 1, 2)[r.id % 4] for r in got)
    assert hits > 0.97 * len(got) and abs(sum(r.copies for r in got) - sum(r.rate for r in got)) < 30
    none = labelled(spark, [])
    for docs, table in ((awkward, none), (awkward, labelled(spark, labels)), (nothing, labelled(spark, labels)), (nothing, none)):
        out = mixing.mix(docs, table)
        assert out.columns == [*awkward.columns, "rate", "copies"] and out.count() <= docs.count()
    assert mixing.mix(awkward, none).count() == awkward.count()


def test_mixing_splits_a_text_once(spark):
    """No test of the marks is put below them, where it would split every text again."""
    marks = mixing.each_mark(mixing.features(frame(spark, [(1, "a b a", "en"), (2, None, "en")]), "doc_id", "text"), "id")
    assert marks._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    plain = [r.mark for r in marks.filter("id = 1 and mark not like '\x01%'").collect()]
    assert sorted(plain) == ["a", "b"]
    assert marks.filter("id = 2").count() == 4  # bias, size, share of distinct words, the empty word


def test_compression_tells_labels_apart(spark, awkward, nothing):
    rnd = random.Random(4)
    good, bad = vocabulary(21, "abcdefgh"), vocabulary(22, "stuvwxyz")
    rows = [(i, prose(rnd, good if i % 3 else bad, 150), "en") for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 1)]
    model = compression.learn(frame(spark, rows), labelled(spark, labels))
    docs = frame(spark, rows + AWKWARD)
    scored = docs.select("doc_id", "text", compression.score(F.col("text"), model, spark).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scored)
    unseen = [(r.s, r.doc_id % 3 > 0) for r in scored if r.doc_id is not None and r.doc_id >= 200]
    assert sum((s >= 0.7) == y for s, y in unseen) >= 0.97 * len(unseen)
    empty = {r.s for r in scored if not r.text}
    assert len(empty) == 1
    lonely = compression.learn(awkward, labelled(spark, [(1, 1, 0), (7, 1, 0)]))
    assert 0.5 < compression.CompressionScorer(lonely).scores([b"text"])[0] < 1
    assert compression.learn(nothing, labelled(spark, [])).good == b""


def test_suffix_tree_counts_and_sums(spark, awkward, nothing):
    rnd = random.Random(5)
    words = vocabulary(31, "abcdef", 60)
    rows = []
    for i in range(150):
        text = []
        while len(text) < 60:
            w = rnd.choice(words)
            text += [w, words[(words.index(w) * 7 + 1) % 60]] if rnd.random() < 0.7 else [w]
        rows.append((i, " ".join(text), "en"))
    rows += AWKWARD
    docs = frame(spark, rows)
    out = suffix_tree.held_out(F.col("doc_id"), 7, 2)
    tree, counts = suffix_tree.fit(docs.filter(~out))
    got = suffix_tree.score(docs, tree, counts).collect()
    split = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), None]
    c = Counter(w for d, t, _ in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2 for w in split(t))
    total, kinds = sum(c.values()), len(c)
    assert (tree.total, tree.distinct) == (total, kinds) and any(k.any() for k in tree.kept)
    base = Counter()
    for d, t, _ in rows:
        w = split(t)
        base[(d, len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == base
    long = [r for r in got if r.n_tokens > 50]
    assert sum(r.score for r in long) > sum(r.base_score for r in long)
    # The next-word distributions of all kept contexts sum to one.
    vocabulary_hashes = np.array(tree.words)
    root = (tree.counts - tree.discount) / tree.total
    assert root.sum() + tree.discount * tree.distinct / tree.total == pytest.approx(1, abs=0.02)
    numbers = tree.frequent(tree.place(vocabulary_hashes))
    context, last = np.divmod(tree.keys[1], tree.n_frequent)
    for s in np.flatnonzero(tree.kept[0])[:20]:
        mine = context == s
        direct = (10 ** tree.score[1][mine]).sum()
        covered = np.isin(numbers, last[mine])
        others = 10 ** tree.rest[0][s] * (1 - root[covered].sum())
        assert direct + others == pytest.approx(1, abs=1e-6)
    empty, words = suffix_tree.fit(nothing)
    assert empty.total == 0 and all(r.n_known == 0 for r in suffix_tree.score(awkward, empty, words).collect())
    assert suffix_tree.score(nothing, tree, counts).count() == 0


def test_quality_rules(spark, awkward, nothing):
    rnd = random.Random(6)
    words = vocabulary(41, "abcdefgh", 300)
    rows = [(i, prose(rnd, words, 120), "en") for i in range(60)]
    rows += [(70, "".join(chr(rnd.randint(33, 126)) if rnd.random() < 0.85 else " " for _ in range(900)), "en")]
    rows += [(71, "a b c d\n" * 40, "en"), (72, "#one *two $three\n\n \nx\nx\nx <y>", "en")]
    rows += AWKWARD
    got = {(r.doc_id, r.n_words): r for r in perplexity.judge(frame(spark, rows)).collect()}
    for d, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + j for i in range(len(w) - 2) if grams[(w[i], w[i + 1], w[i + 2])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[(d, len(w))]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert sum(got[(i, 120)].kept for i in range(60)) >= 58 and not next(r for (d, _), r in got.items() if d == 70).kept
    assert perplexity.judge(awkward).count() == awkward.count() and perplexity.judge(nothing).count() == 0


def test_language_model_sums_to_one(spark):
    rnd = random.Random(7)
    words = vocabulary(42, "abcd", 50)
    model = perplexity.train(frame(spark, [(i, prose(rnd, words, 50), "en") for i in range(20)]))
    symbols = np.arange(256)
    for context in (0, ord("a"), ord("a") << 8 | ord("b"), ord("q")):
        total = (10 ** model.symbol_scores((np.int64(context) << 8) | symbols)).sum()
        assert total == pytest.approx(1, abs=0.01)


def test_page_text(spark):
    pages = [
        (1, "u", "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title &amp; more</h1><p>First  paragraph,\nwith   text &eacute;. <p>Second <b>bold<br>line</b>.</article><footer>&copy; 1</footer>"),
        (2, "u", None),
        (3, "u", ""),
        (4, "u", "<body><script>var a='<p>no</p>';</script><div class=ad>Buy now</div></body>"),
        (1, "u", "<article><p>" + "word " * 50_000 + "</p></article>"),
    ]
    rows = [*pages, *[(10 + i, "u", h) for i, h in enumerate(html_text.layouts(60, seed=5))]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    trees = html_text.learn(df)
    got = [r.text for r in df.select(html_text.main_text(F.col("html"), trees, spark).alias("text")).collect()]
    assert got[0] == "Title & more\n\nFirst paragraph, with text é.\n\nSecond bold line."
    assert got[1:4] == ["", "", ""] and got[4] == " ".join(["word"] * 50_000)
    right = total = 0
    for source in html_text.layouts(60, seed=77):
        page = html_text.parse(source)
        label = html_text.examples(page)
        kept = html_text.decode(page, trees.log_odds(html_text.features(page)))
        right += sum(k == (label[v] == 1) for (v, _), k in zip(page.texts, kept, strict=True))
        total += len(kept)
    assert right >= 0.97 * total
    assert html_text.learn(df.limit(0)).feature.shape[0] == html_text.TREES


def test_quotes(spark):
    rows = [
        (1, 1, "user", "Hello there.\nHow do I sort a list?"),
        (1, 2, "assistant", "Use sorted().\n\nIt returns a new list."),
        (1, 3, "user", "On Monday A wrote:\n> It returns a NEW list.\nAnd in place?"),
        (1, 4, "user", "> How do I sort a list?\n\nSame question here"),
        (1, 5, "assistant", ">> It returns a new list.\n> And in place?\nlist.sort() does.\n> unknown text"),
        (1, 5, "assistant", ">> It returns a new list.\n> And in place?\nlist.sort() does.\n> unknown text"),
        (2, 1, "user", None),
        (2, 3, "user", "> nothing"),
        (None, 1, "user", "x"),
        (3, None, "user", "> y"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("x"))
    got = Counter((r.conv_id, r.turn, r.parent_turn, r.depth, r.n_quotes, r.n_linked, r.text) for r in quotes.reply_order(df).collect())
    assert got == Counter(
        [
            (1, 1, None, 0, 0, 0, rows[0][3]),
            (1, 2, 1, 1, 0, 0, rows[1][3]),
            (1, 3, 2, 2, 1, 1, "And in place?"),
            (1, 4, 1, 1, 1, 1, "Same question here"),
            (1, 5, 3, 3, 3, 2, "list.sort() does."),
            (1, 5, 3, 3, 3, 2, "list.sort() does."),
            (2, 1, None, 0, 0, 0, ""),
            (2, 3, 1, 1, 1, 0, ""),
            (None, 1, None, 0, 0, 0, "x"),
            (3, None, None, 0, 0, 0, ""),
        ]
    )
    import duckdb

    con = duckdb.connect()
    con.register("conversations", df.select("conv_id", "turn", "role", "text").toArrow())
    want = con.sql(quotes.SQL).fetchall()
    columns = [d[0] for d in con.sql(quotes.SQL).description]
    assert Counter(tuple(r) for r in quotes.reply_order(df).select(*columns).collect()) == Counter(want)
    assert quotes.reply_order(df.limit(0)).count() == 0


def test_suffix_tree_has_no_relative_threshold(spark, monkeypatch):
    """Sequences below P_MIN and contexts of more than two words count, by a plain version."""
    monkeypatch.setattr(suffix_tree, "P_MIN", 0.02)
    rnd = random.Random(15)
    words = vocabulary(32, "abcdef", 25)
    rows = []
    for i in range(120):
        t = [rnd.choice(words) for _ in range(3)]
        while len(t) < 80:  # the next word follows from the sum of the last three, mostly
            sure = words[sum(words.index(x) % 2 for x in t[-3:]) * 5 % 25]
            t.append(sure if rnd.random() < 0.6 else rnd.choice(words))
        rows.append((i, " ".join(t), "en"))
    docs = frame(spark, rows)
    tree, tables = suffix_tree.fit(docs)
    got = {r.doc_id: r.score for r in suffix_tree.score(docs, tree, tables).collect()}
    texts = [[*t.split(" "), None] for _, t, _ in rows]
    counts = [Counter(tuple(t[i : i + k]) for t in texts for i in range(len(t) - k + 1)) for k in range(1, 9)]
    c1 = Counter(counts[0].values())
    d = c1[1] / (c1[1] + 2 * c1[2]) if c1[1] and c1[2] else 0.5
    total = sum(counts[0].values())
    p = {s: (n - d) / total for s, n in counts[0].items()}
    contexts, passed = [], []
    for k in range(1, 8):
        after = {}
        for s, n in counts[k].items():
            if n >= 2:
                after.setdefault(s[:-1], {})[s[-1]] = n
        ok, new = set(), {}
        for c, f in after.items():
            of = counts[k - 1][c]
            lower = {w: p[(*c[1:], w)] for w in f}
            left, before = max(1 - sum(f.values()) / of, 1e-12), max(1 - sum(lower.values()), 1e-12)
            gain = sum(n / of * math.log(n / of / lower[w]) for w, n in f.items()) + left * math.log(left / before)
            good = 2 * of * gain > len(f) + 4 * math.sqrt(2 * len(f))
            rest = max(1 - sum((n - d) / of for n in f.values()), 1e-12)
            ok |= {c} if good else set()
            new |= {(*c, w): (n - d) / of + rest * lower[w] if good else lower[w] for w, n in f.items()}
        if not ok:
            break
        p |= new
        contexts.append(after)
        passed.append(ok)
    assert len(passed) > 2 and tree.depth == len(passed) + 1
    for k in range(len(passed) - 1, 0, -1):
        passed[k - 1] |= {c[1:] for c in passed[k]}

    def value(history, w):
        x = (counts[0][(w,)] - d) / total
        for k in range(1, min(len(history), len(passed)) + 1):
            c = tuple(history[-k:])
            if c in passed[k - 1]:
                f, of = contexts[k - 1][c], counts[k - 1][c]
                x = max(1 - sum((n - d) / of for n in f.values()), 1e-12) * x + (max(f[w] - d, 0) / of if w in f else 0)
        return x

    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(sum(math.log10(value(t[:j], w)) for j, w in enumerate(t)), abs=1e-6)


def test_bands_keep_clean_texts_of_any_length(spark):
    """Texts differ by topic, which does not average out in long ones."""
    rnd = random.Random(16)
    topics = [vocabulary(100 + i, "abcdefgh"[: 5 + i % 4], 60) for i in range(12)]
    common = vocabulary(99, "abcdefgh", 200)
    text = lambda i, n: prose(rnd, common + topics[i % 12] * 2, n)
    rows = [(i, text(i, 120), "en") for i in range(120)]
    long = [(1000 + i, text(5 * i, n), "en") for i, n in enumerate((1_200, 1_200, 1_200, 12_000, 12_000, 120_000))]
    noise = "".join(chr(rnd.randint(33, 126)) if rnd.random() < 0.85 else " " for _ in range(90_000))
    got = {r.doc_id: r.kept for r in perplexity.judge(frame(spark, [*rows, *long, (2000, noise, "en")])).collect()}
    assert all(got[i] for i, *_ in long) and sum(got[i] for i, *_ in rows) >= 114 and not got[2000]
    a2, b2 = perplexity.spread(np.sqrt(0.0004 + 0.3 / np.array([200.0, 2_000, 20_000])), 1 / np.array([200.0, 2_000, 20_000]), np.array([5.0, 50, 5]))
    assert (a2, b2) == (pytest.approx(0.0004), pytest.approx(0.3))


def test_perplexity_sees_the_order_of_words(spark):
    rnd = random.Random(17)
    words = vocabulary(43, "abcdefgh", 80)

    def clean(n):
        out = [rnd.choice(words)]
        while len(out) < n:
            out.append(words[(words.index(out[-1]) * 7 + rnd.randrange(3)) % 80])
        return out

    texts = [clean(150) for _ in range(200)]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join(rnd.sample(texts[i], 150)), "en") for i in range(5)]
    got = {r.doc_id: r for r in perplexity.judge(frame(spark, rows)).collect()}
    assert all(got[1000 + i].log_ppl > 1.2 * got[i].log_ppl and not got[1000 + i].kept for i in range(5))
    assert sum(r.low <= r.log_ppl <= r.high for r in got.values() if r.doc_id < 1000) >= 190


def test_word_model_matches_a_plain_one(spark, monkeypatch):
    """Modified Kneser-Ney over three words, with and without sequences sent to the tasks."""
    rnd = random.Random(18)
    words = vocabulary(44, "abcd", 12)
    rows = [(i, prose(rnd, words, rnd.randint(1, 60)), "en") for i in range(40)]
    docs = frame(spark, rows)
    model = perplexity.train(docs)
    spellings = sorted({w for _, t, _ in rows for w in t.split(" ")})
    data, at, back, _ = perplexity.distinct_words([" ".join(spellings).encode()])
    base = dict(zip(spellings, 10 ** (model.word_scores(data, at)[back, 0]) * (1 - 1 / 257), strict=True)) | {"</s>": 1 / 257}
    half = lambda t: zlib.crc32(t.encode()) & 1
    probability = []
    for h in (0, 1):
        three = Counter()
        for _, t, _ in rows:
            w = ["<s>", "<s>", *t.split(" "), "</s>"]
            three.update(zip(w, w[1:], w[2:], strict=False) if half(t) == h else [])
        two, one = Counter(), Counter()
        for (u, v, w), n in three.items():
            two[(v, w)] += n if u == v == "<s>" else 1
        for _, w in two:
            one[(w,)] += 1
        counts = [one, two, three]
        off = [perplexity._discounts(*(float(sum(x == i for x in c.values())) for i in (1, 2, 3, 4))) for c in counts]

        def p(seq, counts=counts, off=off):
            if not seq[1:]:
                lower = base[seq[-1]]
            else:
                lower = p(seq[1:], counts, off)
            c, d = counts[len(seq) - 1], off[len(seq) - 1]
            own = {s: n for s, n in c.items() if s[:-1] == seq[:-1]}
            if not own:
                return lower
            less = {s: max(n - d[min(n, 3)], 0) for s, n in own.items()}
            total = sum(own.values())
            return less.get(seq, 0) / total + max(1 - sum(less.values()) / total, 1e-9) * lower

        probability.append(p)
    for head in (2e-6, 0.02):
        monkeypatch.setattr(perplexity, "HEAD", head)
        got = {r.doc_id: r for r in perplexity.judge(docs).collect()}
        for i, t, _ in rows:
            w = ["<s>", "<s>", *t.split(" "), "</s>"]
            want = -sum(math.log10(probability[1 - half(t)](s)) for s in zip(w, w[1:], w[2:], strict=False))
            assert got[i].log_ppl == pytest.approx(want / (len(t) + 1), abs=1e-9)


def test_unlearned_languages_do_not_pass(spark):
    rnd = random.Random(19)
    one, two, other = vocabulary(45, "abcdefgh"), vocabulary(46, "stuvwxyz"), vocabulary(47, "ahijklmnopsz")
    rows = [(i, prose(rnd, one if i % 2 else two, 60), "aa" if i % 2 else "bb") for i in range(60)]
    mixed = prose(rnd, one, 50) + " " + prose(rnd, other, 12)
    strange = [(100, "привет мир и всем доброго дня", None), (101, prose(rnd, other, 60), None), (102, "".join(rnd.choice("qwrtzpkjh") for _ in range(300)), None), (103, "שלום עולם", None)]
    for known in (rows, [r for r in rows if r[2] == "aa"]):
        docs = frame(spark, [*known, (99, mixed, None), *strange])
        model = langid.learn(docs)
        got = {r.doc_id: r.x for r in docs.select("doc_id", langid.language(F.col("text"), model, spark).alias("x")).collect()}
        assert all(got[i].score == 0 for i, *_ in strange) and all(got[i].score > 0.9 for i, *_ in known)
        assert {r.doc_id for r in langid.keep_known_language(docs).collect()} == {i for i, *_ in known} | {99}


def test_cut_frees_its_shuffle(spark):
    from apportion.session import discard

    def files():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(held.apply(i).getName().startswith("shuffle_") for i in range(held.size()))

    before = files()
    counted = cut(spark.range(10000).groupBy(F.col("id") % 3000).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert counted.count() == 3000
    discard(counted)
    with pytest.raises(Exception):
        counted.count()


def test_near_copies_join_without_their_pairs(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(400):
        words = base[:]
        for at in rng.sample(range(200), 2):
            words[at] = f"x{i}_{at}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    lead = list(range(len(sets)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                lead[b] = a
    tested = []
    possible = jaccard.JaccardJoin._possible

    def counted(self, pairs):
        tested.append(pairs.count())
        return possible(self, pairs)

    monkeypatch.setattr(jaccard.JaccardJoin, "_possible", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = jaccard.JaccardJoin(docs, "doc_id", "text", 4, 85, 100).rows().collect()
    assert {r["id"]: r["component_id"] for r in rows} == {i: top(i) for i in range(len(texts))}
    assert sum(tested) < 20 * len(texts), tested


def test_jaccard_pairs_meet_once(spark):
    """Classes that have many keys in common are one pair, not one for each key."""
    rng = random.Random(4)
    join = jaccard.JaccardJoin(frame(spark, []), "doc_id", "text", 4, 85, 100)
    common, part = rng.sample(range(-(10**9), 10**9), 40), {c: rng.sample(range(10**9, 2 * 10**9), 6) for c in (1, 2, 3)}
    keys = {1: common + part[1], 2: common + part[2], 3: common[:1] + part[3]}
    sketch = [5] * 16
    rows = [(None, 100, c, sketch, sketch[:2]) for c in keys]
    join.parts = cut(spark.createDataFrame(rows, "id long, n long, class long, sketch array<long>, short array<long>"))
    rest = cut(spark.createDataFrame([(k, c, c) for c in keys for k in keys[c]], "key long, class long, component long"))
    got = [tuple(r) for r in join._across(rest, 3).collect()]
    assert Counter(got) == Counter([(1, 2), (1, 3), (2, 3)])


def test_jaccard_frees_its_tables(spark, monkeypatch):
    """Keys and sketches are deleted once groups are known, and rows of a key carry no sketch in turns."""
    made = []

    def spy(df):
        out = cut(df)
        made.append((out.columns, [f.removeprefix("file:").replace("///", "/") for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(jaccard, "cut", spy)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"x{i}_{k}" if rng.random() < 0.012 else w for k, w in enumerate(base)) for i in range(14)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[3], "en"), (7, texts[3], "en")]
    got = jaccard.jaccard_groups(frame(spark, rows), n=4, num=85, den=100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(brute_components(rows, 4, 85, 100))
    gone = [files for columns, files in made if {"keys", "sketch", "text", "center"} & set(columns)]
    assert len(gone) > 4 and all(gone)
    left = [columns for columns, files in made if {"keys", "sketch", "text"} & set(columns) and any(os.path.exists(f) for f in files)]
    assert left == []
    turns = [columns for columns, _ in made if {"key", "component", "lead"} <= set(columns)]
    assert turns and not any({"own", "short"} & set(columns) for columns in turns)


def test_suffix_tree_frees_superseded_tables(spark, monkeypatch):
    made = []

    def spy(df):
        out = cut(df)
        made.append((out.columns, [f.removeprefix("file:").replace("///", "/") for f in out.inputFiles()]))
        return out

    monkeypatch.setattr(suffix_tree, "cut", spy)
    rng = random.Random(3)
    texts = [(" ".join(rng.choice("a b c d e".split()) + " then follows" for _ in range(40)),) for _ in range(60)]
    suffix_tree.fit(spark.createDataFrame(texts, "text string"))
    counted = [files for columns, files in made if columns == ["seq", "context", "suffix", "n"]]
    assert len(counted) > 1 and all(counted)
    assert not any(os.path.exists(f) for files in counted for f in files)
    assert any(os.path.exists(f) for _, files in made for f in files)
