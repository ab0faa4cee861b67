"""Checks over what a build leaves: predicates of single artifacts, coherence across them, the certificate, the time budget.

Small objects are checked on the driver; tables are checked by one aggregate each.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import digest, downstream, parity, topological, verify_manifest
from .ranking import validate_ranking

Predicate = Callable[[object], list[str]]


def weights_sound(weights: Mapping[str, float], names: Sequence[str] | None = None, least: float = 0.0, tolerance: float = 1e-6) -> list[str]:
    """G-X: finite, not below ``least``, of exactly the given names, with sum 1."""
    faults = [f"NOT_FINITE:{k}" for k, v in weights.items() if not math.isfinite(v)]
    faults += [f"BELOW:{k}" for k, v in weights.items() if math.isfinite(v) and v < least]
    if names is not None:
        faults += [f"MISSING:{k}" for k in names if k not in weights] + [f"UNKNOWN:{k}" for k in weights if k not in names]
    if not faults and abs(math.fsum(weights.values()) - 1) > tolerance:
        faults.append("SUM_NOT_ONE")
    return faults


def knots_sound(knots: Sequence[tuple[float, float]], low: float = 0.0, high: float = 1.0) -> list[str]:
    """G-X, CAL-3: inputs rise, outputs never fall and stay within bounds."""
    faults = ["INPUTS_DO_NOT_RISE"] if any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) else []
    faults += ["OUTPUTS_FALL"] if any(a[1] > b[1] for a, b in zip(knots, knots[1:], strict=False)) else []
    return faults + (["OUT_OF_BOUNDS"] if any(not low <= y <= high for _, y in knots) else [])


def thresholds_sound(thresholds: Mapping[str, float], low: float = 0.0, high: float = 1.0) -> list[str]:
    """G-X: every threshold finite and within bounds."""
    return [f"OUT_OF_BOUNDS:{k}" for k, v in thresholds.items() if not (math.isfinite(v) and low <= v <= high)]


def codes_known(codes: Sequence[str], known: Sequence[str]) -> list[str]:
    """G-X, J-16: no code outside the enum, none twice."""
    return [f"UNKNOWN:{c}" for c in sorted(set(codes) - set(known))] + [f"REPEATED:{c}" for c in sorted({c for c in codes if list(codes).count(c) > 1})]


def not_blank(texts: Sequence[str]) -> list[str]:
    """G-X: no empty or blank text."""
    return [f"BLANK:{k}" for k, t in enumerate(texts) if not (t or "").strip()]


def table_sound(df: DataFrame, keys: Sequence[str], finite: Sequence[str] = (), rows: int | None = None) -> list[str]:
    """G-X over a table: not empty (or of exactly ``rows``), keys unique and not null, numbers finite."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    # Groups by key are as many as rows; only their sums reach the driver.
    said = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.count_if(F.col("__n") > 1).alias("twice"), *(F.count_if(F.col(k).isNull()).alias(f"null_{j}") for j, k in enumerate(keys))).first()
    faults = ["WRONG_ROW_COUNT"] if (said.n != rows if rows is not None else said.n == 0) else []
    faults += ["REPEATED_KEY"] if said.twice else []
    faults += [f"NULL_KEY:{k}" for j, k in enumerate(keys) if said[f"null_{j}"]]
    if finite:
        odd = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"c{j}") for j, c in enumerate(finite))).first()
        faults += [f"NOT_FINITE:{c}" for j, c in enumerate(finite) if odd[f"c{j}"]]
    return faults


def run_predicates(artifacts: Mapping[str, object], predicates: Mapping[str, Sequence[Predicate]], required: Sequence[str] = ()) -> dict[str, list[str]]:
    """G-X: of each artifact the faults that its predicates find; a required one that is not there is a fault too."""
    found = {k: [f for p in predicates.get(k, ()) for f in p(x)] for k, x in artifacts.items()}
    found |= {k: ["NOT_THERE"] for k in required if k not in artifacts}
    return {k: v for k, v in found.items() if v}


def coherence(layout_hash: str, stated_hash: str, dims: Mapping[str, int], anchors: Mapping[str, int], features: int, snapshot_columns: int) -> list[str]:
    """L-5: the artifacts agree on the layout, the length of vectors, the number of anchors and of features."""
    faults = [] if layout_hash == stated_hash else ["LAYOUT_HASH"]
    if len(set(dims.values())) > 1:
        faults.append("DIMENSIONS:" + ",".join(f"{k}={v}" for k, v in sorted(dims.items())))
    if len(set(anchors.values())) > 1:
        faults.append("ANCHORS:" + ",".join(f"{k}={v}" for k, v in sorted(anchors.items())))
    return faults + ([] if features == snapshot_columns else ["FEATURES"])


def certificate(folder: Path, snapshot: DataFrame, recomputed: DataFrame, columns: Sequence[str], ranking: DataFrame, rerun: Callable[[], Mapping[str, str]], hashes: Mapping[str, str], id_col: str = "candidate_id", rows: int = 100, skip: Sequence[str] = (), tolerance: float = 1e-4) -> dict[str, object]:
    """L-6, REP-1 to REP-4: the manifest reads back, features agree with the snapshot, the ranking is sound, a second run gives the same hashes.

    ``skip`` names artifacts that may differ from run to run.
    """
    manifest = verify_manifest(folder)
    same = parity(snapshot, recomputed, id_col, columns, tolerance).first()
    faults = [r.code for r in validate_ranking(ranking, rows, id_col).collect()]
    again = rerun()
    differ = sorted(k for k in hashes.keys() | again.keys() if k not in skip and hashes.get(k) != again.get(k))
    checks = {
        "manifest_reload": {"ok": not manifest, "faults": manifest},
        "feature_parity": {"ok": bool(same.ok), "only_a": same.only_a, "only_b": same.only_b, "max_diff": same.max_diff},
        "dry_run_ranking": {"ok": not faults, "faults": faults},
        "rerun_determinism": {"ok": not differ, "differ": differ},
    }
    body: dict[str, object] = {"checks": checks, "reproducible": all(c["ok"] for c in checks.values())}
    return body | {"self_sha256": digest(body)}


@dataclass
class Budget:
    """L-7: seconds that a run may take.  ``exit_code`` is 0 within them and 3 beyond; ``left`` is never below 0."""

    seconds: float
    clock: Callable[[], float] = time.monotonic
    began: float = field(init=False)

    def __post_init__(self) -> None:
        if not (math.isfinite(self.seconds) and self.seconds > 0):
            raise ValueError("a budget is a positive number of seconds")
        self.began = self.clock()

    @property
    def used(self) -> float:
        return self.clock() - self.began

    @property
    def left(self) -> float:
        return max(0.0, self.seconds - self.used)

    def exit_code(self) -> int:
        return 0 if self.used <= self.seconds else 3


class FeatureGraph:
    """L-3: which features are built of which; unknown names and cycles are rejected when the graph is made."""

    def __init__(self, needs: Mapping[str, Sequence[str]]):
        self.needs = {k: tuple(v) for k, v in needs.items()}
        self.layers = topological(self.needs)

    def order(self) -> list[str]:
        return [x for layer in self.layers for x in layer]

    def upstream(self, of: str) -> set[str]:
        """All that a feature is built of, directly or not."""
        out: set[str] = set()
        todo = list(self.needs[of])
        while todo:
            if (x := todo.pop()) not in out:
                out.add(x)
                todo += self.needs[x]
        return out

    def downstream(self, of: str) -> set[str]:
        """All that changes with a feature, without itself."""
        return downstream(self.needs, of) - {of}

    def edges(self, spark) -> DataFrame:
        """(parent, child) as a table, for queries over the graph."""
        return spark.createDataFrame([(p, c) for c, ps in self.needs.items() for p in ps], "parent string, child string")
