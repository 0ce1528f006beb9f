"""Auxiliary parameters: one text file of fixed-size sections, read and written whole."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from apportion.config import BIAS_SURROUND, BIAS_WINDOW
from apportion.functions.sequence import NUCS
from apportion.sources.lines import numbered_lines


@dataclass
class AuxModel:
    """Learned tables; their sizes depend on options, never on the data."""

    lengths: list[float]
    mismatch: dict[int, np.ndarray] = field(default_factory=dict)  # mate -> [pos, 16, 4] probabilities
    inserts: list[float] = field(default_factory=list)
    deletes: list[float] = field(default_factory=list)
    bias: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # end -> log tables
    marginal: dict[str, np.ndarray] = field(default_factory=dict)  # end -> [pos, base] shares observed
    order: int = 3
    min_len: int = 1  # smallest fragment length seen; 1 if none was


def _row(values) -> str:
    return "\t".join(f"{v:.6e}" for v in values)


def _contexts(order: int) -> str:
    names = [""]
    for _ in range(order + 1):
        names = [n + c for n in names for c in NUCS]
    return "\t".join(f"{n[:-1]}->{n[-1]}" for n in names)


def params_lines(aux: AuxModel) -> list[str]:
    total = sum(aux.lengths) or 1.0
    out = [f">Fragment Length Distribution (0-{len(aux.lengths) - 1})", _row(v / total for v in aux.lengths)]
    for mate, title in ((1, "First"), (2, "Second")):
        if mate not in aux.mismatch:
            continue
        names = [f"{a}{b}->*{c}" for a in NUCS for b in NUCS for c in NUCS]
        out += [f">{title} Read Mismatch", "\t" + "\t".join(names)]
        for pos, table in enumerate(aux.mismatch[mate]):
            cells = [p if pos or i < 4 else 0.0 for i, row in enumerate(table) for p in row]
            out.append(f"{pos + 1}:\t{_row(cells)}")
    for title, values in (("Insertion", aux.inserts), ("Deletion", aux.deletes)):
        if values:
            out += [f">{title} Length (0-{len(values) - 1})", _row(values)]
    for end in ("5", "3"):
        if end not in aux.bias:
            continue
        obs, exp = (np.exp(t) for t in aux.bias[end])
        offsets = range(-BIAS_SURROUND, BIAS_WINDOW - BIAS_SURROUND)
        out += [f">{end}' Sequence-Specific Bias", "\tObserved Marginal Distribution", "\t" + "\t".join(map(str, offsets))]
        # Contexts weigh by how often they were seen; tables without counts count them alike.
        marginal = aux.marginal[end] if end in aux.marginal else obs.mean(axis=1)
        out += [f"{c}:\t{_row(marginal[:, j])}" for j, c in enumerate(NUCS)]
        for title, table, names in (
            ("Observed", obs, offsets),
            ("Background", exp, range(1, aux.order + 2)),
        ):
            out += [f"\t{title} Conditional Probabilities", "Position\t" + _contexts(aux.order)]
            out += [f"{n}:\t{_row(table[i].reshape(-1))}" for i, n in enumerate(names)]
    return out


def write_params(spark: SparkSession, aux: AuxModel, path: str) -> None:
    rows = [(line,) for line in params_lines(aux)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("overwrite").text(path)


def read_params(spark: SparkSession, path: str, order: int = 3) -> AuxModel:
    """Parse a parameter file; missing sections stay empty, unknown ones are ignored."""
    rows: DataFrame = numbered_lines(spark, path).orderBy("line_no").select("value")
    sections: dict[str, list[str]] = {}
    name = None
    for r in rows.collect():
        if r["value"].startswith(">"):
            name = r["value"][1:]
            sections[name] = []
        elif name is not None:
            sections[name].append(r["value"])

    def body(prefix: str) -> list[str] | None:
        return next((v for k, v in sections.items() if k.startswith(prefix)), None)

    def numbers(line: str, skip: int = 0) -> list[float]:
        return [float(x) for x in line.rstrip("\t").split("\t")[skip:]]

    fragment = body("Fragment")
    if not fragment:
        raise ValueError(f"{path} has no fragment length section")
    aux = AuxModel(numbers(fragment[0]), order=order)
    for mate, title in ((1, "First Read"), (2, "Second Read")):
        lines = body(title)
        if lines:
            cells = np.array([numbers(line, 1) for line in lines[1:] if line.strip()])
            aux.mismatch[mate] = cells.reshape(len(cells), 16, 4)
    for title, attr in (("Insertion", "inserts"), ("Deletion", "deletes")):
        lines = body(title)
        if lines:
            setattr(aux, attr, numbers(lines[0]))
    for end in ("5", "3"):
        lines = body(end)
        if lines:
            obs_at = lines.index("\tObserved Conditional Probabilities") + 2
            exp_at = lines.index("\tBackground Conditional Probabilities") + 2
            obs = [numbers(x, 1) for x in lines[obs_at : obs_at + BIAS_WINDOW]]
            exp = [numbers(x, 1) for x in lines[exp_at : exp_at + order + 1]]
            at = lines.index("\tObserved Marginal Distribution") + 2
            aux.marginal[end] = np.array([numbers(x, 1) for x in lines[at : at + len(NUCS)]]).T
            shape = (-1, 4**order, 4)
            with np.errstate(divide="ignore"):
                aux.bias[end] = (
                    np.maximum(np.log(np.array(obs).reshape(shape)), math.log(1e-300)),
                    np.maximum(np.log(np.array(exp).reshape(shape)), math.log(1e-300)),
                )
    return aux
