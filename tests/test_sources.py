import struct
import time
import zlib

import numpy as np
import pytest
from simulation import revcomp, simulate
from pyspark.sql import functions as F

from apportion.config import Options
from apportion.operators.bias import target_bias
from apportion.operators.markov import cell_table, encode, encode_all, log_window_scores, window_weight_sums
from apportion.operators.pairing import pair_mates
from apportion.operators.windows import overlapping
from apportion.plans.estimation import estimate
from apportion.plans.export import fragment_lines, fragment_records, target_lines, target_records
from apportion.plans.likelihood import aligned_reads
from apportion.plans.sites import site_table
from apportion.sources.alignments import check_contiguous, check_headers, read_alignments, read_header
from apportion.session import cut
from apportion.sources.bam import BASES, CIGAR_OPS, is_bam, read_bam, record_borders
from apportion.sources.lines import numbered_lines
from apportion.sources.params import AuxModel, read_params, write_params
from apportion.sources.priors import read_priors
from apportion.sources.targets import read_fasta, read_fasta_chunks, read_target_sets, validate_targets, whole_sequences


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = write(tmp_path / "x.txt", "".join(f"row {i} {'y' * (i % 50)}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000b")
    try:
        rows = numbered_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.value.startswith(f"row {r.line_no} ") for r in rows)


def test_fasta(spark, tmp_path):
    path = write(tmp_path / "a.fa", ">one first target\nACGT\nAC\n\n>two\ttab stays\nGG\n>three\nTTT\n")
    got = {r["name"]: (r.seq, r.length) for r in read_fasta(spark, path).collect()}
    assert got == {"one": ("ACGTAC", 6), "two\ttab": ("GG", 2), "three": ("TTT", 3)}
    with pytest.raises(ValueError, match="more than once"):
        read_fasta(spark, write(tmp_path / "b.fa", ">a\nAC\n>a\nAC\n"))
    with pytest.raises(ValueError, match="no targets"):
        read_fasta(spark, write(tmp_path / "c.fa", "\n"))


def test_fasta_in_chunks(spark, tmp_path):
    """Lines of any width, records over many splits, chunks far shorter and longer than lines."""
    rnd = np.random.default_rng(3)
    seqs = {f"t{i}": "".join(rnd.choice(list("ACGTN"), int(n))) for i, n in enumerate([1, 59, 60, 61, 5000, 0, 777])}
    text = "\n".join(f">{n} what it is\r\n" + "\n\n".join(s[i : i + w] for i in range(0, len(s), w)) for (n, s), w in zip(seqs.items(), (60, 60, 60, 60, 37, 5, 9000)))
    path = write(tmp_path / "a.fa", text + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        for chunk in (16, 1000):
            records, chunks = read_fasta_chunks(spark, path, chunk)
            assert {r["name"]: r.length for r in records.collect()} == {n: len(s) for n, s in seqs.items()}
            got = {(r["name"], r.chunk_no): (r.length, r.bases) for r in chunks.collect()}
            assert got == {(n, k): (len(s), s[k * chunk : (k + 1) * chunk]) for n, s in seqs.items() for k in range(-(-len(s) // chunk))}
            for overlap in (1, 15, 40, 2500):
                wide = overlapping(chunks.withColumnRenamed("name", "target_id"), overlap, chunk)
                assert {(r.target_id, r.chunk_no): r.bases for r in wide.collect()} == {(n, k): seqs[n][k * chunk : (k + 1) * chunk + overlap] for n, k in got}
        ids = records.withColumnRenamed("name", "target_id")
        whole = whole_sequences(ids, chunks.withColumnRenamed("name", "target_id"))
        assert {r.target_id: r.seq for r in whole.collect()} == seqs
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for bad, what in ((">a\nAC\n>a\nAC\n", "more than once"), ("\n", "no targets"), ("AC\n>a\nAC\n", "does not begin")):
        with pytest.raises(ValueError, match=what):
            read_fasta_chunks(spark, write(tmp_path / "b.fa", bad))


def test_target_bias_over_chunks(spark):
    """Sums over chunks equal those over whole sequences, at every length around their borders."""
    rnd, order = np.random.default_rng(5), 3
    prob = lambda *shape: np.log(rnd.random(shape) + 0.1)
    tables = {e: (prob(21, 64, 4), prob(4, 64, 4)) for e in ("5", "3")}
    lengths = [0, 1, 5, 13, 4095, 4096, 4097, 4096 + 12, 4096 + 13, 4096 + 14, 9000]
    rows = [(i, n, "".join(rnd.choice(list("ACGTNacgt"), n))) for i, n in enumerate(lengths)]

    def mean(seq):
        sums = []
        for end in ("5", "3"):
            codes = encode(seq) if end == "5" else (3 - encode(seq))[::-1]
            sums.append(np.exp(log_window_scores(codes, tables[end][0], order, 10) - log_window_scores(codes, tables[end][1], order, 10)).sum())
        return sums[0] * sums[1] / len(seq) ** 2

    got = {r.target_id: r.avg_bias for r in target_bias(spark.createDataFrame(rows, "target_id long, length long, seq string"), tables, order).collect()}
    assert got == {i: pytest.approx(mean(s)) for i, n, s in rows if n}


def test_pieces_of_sequences_are_scored_together():
    """Sums over many short pieces equal those of one sequence after the other, in far less time."""
    rnd, order = np.random.default_rng(6), 3
    obs, exp = np.log(rnd.random((21, 64, 4)) + 0.1), np.log(rnd.random((4, 64, 4)) + 0.1)
    cells = tuple(cell_table(obs, order, 21, masked) - cell_table(exp, order, 21, masked) for masked in (True, False))
    texts = ["".join(rnd.choice(list("ACGTNacgt\u00e9"), n)) for n in [*range(1, 60), *[2000] * 60]]
    sizes, none = np.array([len(t) for t in texts]), np.zeros(len(texts), dtype=int)

    def together():
        return window_weight_sums(encode_all(texts), sizes, none, none, sizes, cells, order, 10)

    def each():
        pairs = ((log_window_scores(encode(t), obs, order, 10), log_window_scores(encode(t), exp, order, 10)) for t in texts)
        return [np.exp(a - b).sum() for a, b in pairs]

    def seconds(run):
        begun = time.process_time()
        return run(), time.process_time() - begun

    (got, fast), (want, slow) = seconds(together), seconds(each)
    assert got == pytest.approx(want, rel=1e-12)
    assert min(fast, seconds(together)[1]) < slow / 4


def test_validation(spark, tmp_path):
    fasta = read_fasta(spark, write(tmp_path / "a.fa", ">a\nACGT\n>b\nAC\n>c\nA\n"))
    header = lambda rows: spark.createDataFrame(rows, "target_id long, name string, length long")
    kept, dropped = validate_targets(header([(0, "b", 2), (1, "a", 4)]), fasta)
    assert {r["name"]: r.target_id for r in kept.collect()} == {"b": 0, "a": 1}
    assert [r["name"] for r in dropped.collect()] == ["c"]
    with pytest.raises(ValueError, match="header says 5"):
        validate_targets(header([(0, "a", 5)]), fasta)
    with pytest.raises(ValueError, match="no sequence"):
        validate_targets(header([(0, "z", 5)]), fasta)


def test_headers_priors_and_sets(spark, tmp_path):
    a = write(tmp_path / "a.sam", "@HD\tVN:1\n@SQ\tSN:x\tLN:5\n@SQ\tSN:y\tLN:6\n")
    b = write(tmp_path / "b.sam", "@SQ\tSN:x\tLN:5\n@SQ\tSN:y\tLN:7\n")
    assert [(r.target_id, r["name"], r.length) for r in read_header(spark, a).orderBy("target_id").collect()] == [(0, "x", 5), (1, "y", 6)]
    assert check_headers(spark, [a, a]).count() == 2
    with pytest.raises(ValueError, match="other targets"):
        check_headers(spark, [a, b])
    with pytest.raises(ValueError, match="more than once"):
        read_header(spark, write(tmp_path / "c.sam", "@SQ\tSN:x\tLN:5\n@SQ\tSN:x\tLN:5\n"))
    priors = read_priors(spark, write(tmp_path / "p", "x\t0.5\ny 0.25\nx 0.75\n"))
    assert {r["name"]: r.alpha for r in priors.collect()} == {"x": 0.75, "y": 0.25}
    t = read_header(spark, a)
    sets = read_target_sets(spark, write(tmp_path / "s", "x,y\n"), t).collect()
    assert {(r.target_id, r.n_members) for r in sets} == {(0, 2), (1, 2)}
    with pytest.raises(ValueError, match="fewer than 2"):
        read_target_sets(spark, write(tmp_path / "s1", "x\n"), t)
    with pytest.raises(ValueError, match="unknown target"):
        read_target_sets(spark, write(tmp_path / "s2", "x,q\n"), t)


def test_names_of_a_set_leave_its_line(spark, tmp_path):
    """No name carries its line on: with n names to a line that would be n lines to split."""
    t = spark.range(300).select(F.col("id").alias("target_id"), F.concat(F.lit("t"), "id").alias("name"))
    line = ",".join(f" t{i}" for i in range(300))
    sets = read_target_sets(spark, write(tmp_path / "s", f"t1,t2\n\n{line}\nt5, t5\n"), t)
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "value#" not in plan
    assert sorted(map(tuple, sets.collect())) == sorted([(0, 1, 2), (0, 2, 2), *((2, i, 300) for i in range(300)), (3, 5, 2), (3, 5, 2)])


def test_a_line_is_parsed_once(spark, tmp_path):
    """The tests on flags and gaps do not split the line or parse the CIGAR again."""
    sam = write(tmp_path / "a.sam", "@SQ\tSN:x\tLN:100\nf\t16\tx\t3\t255\t2M1D3M\t*\t0\t0\tACGTA\t*\n\nshort\t0\n")
    reads = read_alignments(spark, sam, cut(read_header(spark, sam)), Options())
    plan = reads._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("split(") == 1
    assert [(r["name"], r.left, r.right, r.seq) for r in reads.collect()] == [("f", 2, 8, "TACGT")]


def test_alignment_decoding(spark, tmp_path):
    head = "@SQ\tSN:x\tLN:100\n"
    row = lambda name, flag, pos, cigar, mate, seq="ACGTA", t="x", nxt="*": f"{name}\t{flag}\t{t}\t{pos}\t9\t{cigar}\t{nxt}\t{mate}\t0\t{seq}\tII\n"
    body = row("a/1", 0, 5, "5M", 0) + row("b", 16, 7, "2M3I", 0) + row("c", 4, 1, "5M", 0) + row("d", 0, 1, "11I5M", 0) + row("e", 0, 1, "5M", 0, t="*")
    path = write(tmp_path / "a.sam", head + body)
    got = {r["name"]: r for r in read_alignments(spark, path, read_header(spark, path), Options()).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].left, got["a"].right, got["a"].mate_l, got["a"].seq) == (4, 9, None, "ACGTA")
    assert (got["b"].right - got["b"].left, got["b"].seq) == (2, revcomp("ACGTA"))
    bad = write(tmp_path / "b.sam", head + row("a", 0, 5, "5M", 0, t="nope"))
    with pytest.raises(Exception, match="unknown target nope"):
        read_alignments(spark, bad, read_header(spark, bad), Options()).collect()
    long = write(tmp_path / "c.sam", head + row("a", 0, 5, "5M", 0))
    with pytest.raises(Exception, match="read longer"):
        read_alignments(spark, long, read_header(spark, long), Options(max_read_len=4)).collect()
    split = write(tmp_path / "d.sam", head + row("a", 0, 5, "5M", 0) + row("b", 0, 5, "5M", 0) + row("a", 0, 6, "5M", 0))
    with pytest.raises(ValueError, match="a are not consecutive"):
        check_contiguous(read_alignments(spark, split, read_header(spark, split), Options()))


def test_params_round_trip(spark, tmp_path):
    rnd = np.random.default_rng(1)
    prob = lambda *shape: (lambda a: a / a.sum(axis=-1, keepdims=True))(rnd.random(shape) + 0.1)
    aux = AuxModel(list(rnd.random(801)), {1: prob(30, 16, 4), 2: prob(30, 16, 4)}, [0.9] + [0.01] * 10, [0.95] + [0.005] * 10)
    aux.bias = {e: (np.log(prob(21, 64, 4)), np.log(prob(4, 64, 4))) for e in ("5", "3")}
    write_params(spark, aux, f"{tmp_path}/params")
    got = read_params(spark, f"{tmp_path}/params")
    assert np.allclose(got.lengths, np.array(aux.lengths) / sum(aux.lengths), rtol=1e-5)
    assert np.allclose(got.mismatch[2][1:], aux.mismatch[2][1:], rtol=1e-5)
    assert np.allclose(got.inserts, aux.inserts) and np.allclose(got.deletes, aux.deletes)
    for e in ("5", "3"):
        assert np.allclose(got.bias[e][0], aux.bias[e][0], atol=1e-5)
        assert np.allclose(got.bias[e][1], aux.bias[e][1], atol=1e-5)


def bgzf(data, size=700):
    """Compressed blocks of a few hundred bytes, so that records span them."""
    out = b""
    for i in range(0, len(data), size):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        chunk = data[i : i + size]
        body = c.compress(chunk) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out += body + struct.pack("<II", zlib.crc32(chunk), len(chunk))
    return out


def to_bam(sam, path):
    lines = open(sam).read().splitlines()
    refs = [(x.split("SN:")[1].split("\t")[0], int(x.split("LN:")[1])) for x in lines if "SN:" in x and x[0] == "@"]
    ids = {n: i for i, (n, _) in enumerate(refs)}
    data = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(refs))
    for n, k in refs:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
    for line in lines:
        if line[0] == "@":
            continue
        name, flag, t, pos, _, cigar, nxt, mate, tlen, seq = line.split("\t")[:10]
        ops = struct.pack("<I", int(cigar[:-1]) << 4 | CIGAR_OPS.index(cigar[-1]))
        codes = [BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        body = struct.pack("<iiBBHHHiiii", ids[t], int(pos) - 1, len(name.encode()) + 1, 9, 0, 1, int(flag), len(seq), ids[t] if nxt == "=" else -1, int(mate) - 1, int(tlen))
        body += name.encode() + b"\0" + ops + packed + b"\xff" * len(seq)
        data += struct.pack("<i", len(body)) + body
    path.write_bytes(bgzf(data) + bgzf(b""))
    return str(path)


def test_bam_ranges_give_every_record_once(spark, simulated, tmp_path):
    fasta, sam, truth = simulated
    bam = to_bam(sam, tmp_path / "hits.bam")
    want = sorted(tuple(x.split("\t")[i] for i in (0, 1, 2, 3, 5, 6, 7, 9)) for x in open(sam).read().splitlines() if x[0] != "@")
    for width in (1 << 30, 9000, 3000):
        rows = read_bam(spark, bam, width).collect()
        got = sorted((r["name"], str(r.flag), r.target, str(r.pos), r.cigar, r.rnext, str(r.pnext), r.seq) for r in rows)
        assert got == want
    a = estimate(spark, fasta, sam, Options(batch_mode=True, errors=False, bias=False)).results
    b = estimate(spark, fasta, bam, Options(batch_mode=True, errors=False, bias=False)).results
    pick = lambda df: {r.target_id: pytest.approx(r.est_counts) for r in df.collect()}
    assert pick(a) == {r.target_id: r.est_counts for r in b.collect()}


def test_doubtful_records_at_range_borders_stay(spark, simulated, tmp_path):
    """Names that no range would take for one, a few and a long run of them, at any border."""
    _, sam, _ = simulated
    lines = open(sam).read().splitlines()
    head, body = [x for x in lines if x[0] == "@"], [x for x in lines if x[0] != "@"][:300]
    odd = [f"é\x01{i}\t{x.split(chr(9), 1)[1]}" if i % 21 == 20 or 100 <= i < 160 else f"r{i}\t{x.split(chr(9), 1)[1]}" for i, x in enumerate(body)]
    path = write(tmp_path / "odd.sam", "\n".join([*head, *odd]) + "\n")
    bam = to_bam(path, tmp_path / "odd.bam")
    want = [x.split("\t")[0] for x in odd]
    size = len(open(bam, "rb").read())
    for width in (1500, 2300, size // 3, size):
        rows = read_bam(spark, bam, width).orderBy("block_at", "in_block").collect()
        assert [r["name"] for r in rows] == want
        borders = record_borders(spark, bam, width).orderBy("id").collect()
        assert all((a.to_block, a.to_offset) == (b.from_block, b.from_offset) for a, b in zip(borders, borders[1:]))
        assert (borders[-1].to_block, borders[-1].to_offset) == (size, 0)


def test_damaged_bam_is_an_error(spark, simulated, tmp_path):
    _, sam, _ = simulated
    bam = to_bam(sam, tmp_path / "whole.bam")
    data = open(bam, "rb").read()
    heads = [i for i in range(len(data)) if data[i : i + 4] == b"\x1f\x8b\x08\x04"]
    flipped = bytearray(data)
    flipped[heads[len(heads) // 2] + 30] ^= 0xFF
    cases = {"flipped": bytes(flipped), "short": data[: heads[-3] + 100], "record": data[: heads[-3]]}
    for name, content in cases.items():
        path = tmp_path / f"{name}.bam"
        path.write_bytes(content)
        for width in (1 << 30, 3000):
            with pytest.raises(Exception, match="damaged|cut off|ends inside"):
                read_bam(spark, str(path), width).count()
    assert is_bam(spark, f"file:{bam}") and is_bam(spark, bam) and not is_bam(spark, sam)
    with pytest.raises(Exception, match="(?i)exist|not ?found"):
        is_bam(spark, f"{tmp_path}/nowhere.bam")


def test_reads_agree_with_their_targets(spark, tmp_path):
    """Without errors every aligned base equals the target base on both strands."""
    fasta, sam, _ = simulate(tmp_path, n_frags=30, errors=0.0)
    header = read_header(spark, sam)
    targets, _ = validate_targets(header, read_fasta(spark, fasta))
    placed = pair_mates(read_alignments(spark, sam, header, Options())).withColumn("hit_id", F.monotonically_increasing_id())
    reads = aligned_reads(placed, targets)
    assert reads.filter("read <> ref").count() == 0 and reads.count() > 30


def test_export(spark, tmp_path):
    fasta, sam, truth = simulate(tmp_path, n_frags=40)
    out = estimate(spark, fasta, sam, Options(batch_mode=True, errors=False, bias=False))
    targets, _ = validate_targets(read_header(spark, sam), read_fasta(spark, fasta))
    whole = cut(fragment_records(out.placements, targets))
    n = out.placements.count()
    assert whole.count() == n and whole.select("name").distinct().count() == sum(truth.values())
    first = whole.filter("rank = 1 and read_l is not null")
    assert first.filter("read_l.mismatch_indices is null").count() == 0
    ranks = whole.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("top")).filter("n <> top")
    assert ranks.count() == 0
    lines = [r.value for r in fragment_lines(whole).collect()]
    assert len(lines) == n and all(len(x) % 4 == 0 for x in lines)
    assert target_lines(target_records(targets)).count() == 5


def test_site_differences_find_a_changed_base(spark, tmp_path):
    fasta, sam, _ = simulate(tmp_path, n_frags=300, errors=0.002)
    # Change one base of a target that has reads of its own; its reads now all differ there.
    text = open(fasta).read().split(">")
    i = next(k for k, rec in enumerate(text) if rec.startswith("t_d"))
    head, *seq = text[i].split("\n")
    whole = "".join(seq)
    at = 350
    changed = whole[:at] + ("A" if whole[at] != "A" else "C") + whole[at + 1 :]
    text[i] = head + "\n" + changed + "\n"
    changed_fasta = write(tmp_path / "changed.fa", ">".join(text))
    out = estimate(spark, changed_fasta, sam, Options(batch_mode=True, bias=False))
    sites = site_table(spark, out).filter("p_value < 0.001").collect()
    assert [(r["name"], r.position) for r in sites] == [("t_d", at)]
