"""A small simulated library whose truth is known."""

import random
from pathlib import Path


def revcomp(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def simulate(folder: Path, n_frags=400, seed=7, errors=0.01):
    """Five targets, three of them sharing a stretch; paired and single reads in SAM text.

    Returns (fasta, sam, truth) where truth counts fragments drawn per target.
    """
    rnd = random.Random(seed)
    base = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = base(600)
    seqs = {
        "t_a": base(300) + shared,
        "t_b": shared + base(250),
        "t_c": base(200) + shared + base(120),
        "t_d": base(700),
        "t_e": base(500),
    }
    names = list(seqs)
    fasta = folder / "targets.fa"
    fasta.write_text(
        "".join(
            f">{n} description of {n}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n"
            for n, s in seqs.items()
        )
    )
    weights = {"t_a": 5, "t_b": 2, "t_c": 1, "t_d": 3, "t_e": 0}
    lines = ["@HD\tVN:1.0"] + [f"@SQ\tSN:{n}\tLN:{len(s)}" for n, s in seqs.items()]
    truth = dict.fromkeys(names, 0)
    flip = lambda s: "".join(rnd.choice("ACGT") if rnd.random() < errors else c for c in s)
    for k in range(n_frags):
        t = rnd.choices(names, [weights[n] for n in names])[0]
        size = max(60, int(rnd.gauss(180, 25)))
        start = rnd.randrange(0, len(seqs[t]) - size)
        piece = seqs[t][start : start + size]
        truth[t] += 1
        paired = k % 5 != 0
        left, right = flip(piece[:50]), flip(piece[-50:])
        first_left = rnd.random() < 0.5
        for n in names:
            at = seqs[n].find(piece)
            if at < 0:
                continue
            l, r = at + 1, at + size - 50 + 1
            if paired:
                f1 = 1 | 2 | 32 | (64 if first_left else 128)
                f2 = 1 | 2 | 16 | (128 if first_left else 64)
                lines.append(f"f{k}\t{f1}\t{n}\t{l}\t255\t50M\t=\t{r}\t{size}\t{left}\t*")
                lines.append(f"f{k}\t{f2}\t{n}\t{r}\t255\t50M\t=\t{l}\t{-size}\t{right}\t*")
            else:
                flag, p, s = (0, l, left) if first_left else (16, r, right)
                lines.append(f"f{k}\t{flag}\t{n}\t{p}\t255\t50M\t*\t0\t0\t{s}\t*")
    sam = folder / "hits.sam"
    sam.write_text("\n".join(lines) + "\n")
    return str(fasta), str(sam), truth
