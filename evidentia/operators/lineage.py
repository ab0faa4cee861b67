"""Stages of a build: order, closure, staleness, manifests.  Driver objects, not data."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical(x: object) -> bytes:
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()


def digest(*parts: object) -> str:
    return hashlib.sha256(b"\x1f".join(p if isinstance(p, bytes) else canonical(p) for p in parts)).hexdigest()


def topological(needs: Mapping[str, Sequence[str]]) -> list[list[str]]:
    """L-1: layers of stages that may run side by side, each sorted; an error on a cycle or an unknown name."""
    for k, xs in needs.items():
        if unknown := [x for x in xs if x not in needs]:
            raise ValueError(f"{k} needs unknown stages {unknown}")
    layers, done = [], set()
    while len(done) < len(needs):
        ready = sorted(k for k, xs in needs.items() if k not in done and set(xs) <= done)
        if not ready:
            raise ValueError(f"stages form a cycle: {sorted(set(needs) - done)}")
        layers.append(ready)
        done |= set(ready)
    return layers


def downstream(needs: Mapping[str, Sequence[str]], of: str) -> set[str]:
    out = {of}
    while more := {k for k, xs in needs.items() if k not in out and out & set(xs)}:
        out |= more
    return out


def closure_sql(edges: str) -> str:
    """L-1 as a recursive query over a view or VALUES of (parent, child)."""
    return f"WITH RECURSIVE reach(ancestor, node) AS (SELECT parent, child FROM {edges} UNION ALL SELECT r.ancestor, e.child FROM reach r JOIN {edges} e ON e.parent = r.node) SELECT DISTINCT ancestor, node FROM reach"


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, object]], Mapping[str, object]]
    needs: tuple[str, ...] = ()
    version: str = "1"


@dataclass
class Build:
    """L-2: runs stages in order; a stage whose key (name, version, config, inputs) is on record is skipped."""

    folder: Path
    stages: Sequence[Stage]
    config: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.folder = Path(self.folder)
        self.by_name = {s.name: s for s in self.stages}
        self.layers = topological({s.name: s.needs for s in self.stages})

    def key(self, stage: Stage, done: Mapping[str, str]) -> str:
        return digest(stage.name, stage.version, self.config, {n: done[n] for n in stage.needs})

    def receipt(self, name: str) -> Path:
        return self.folder / "receipts" / f"{name}.json"

    def run(self, force: Sequence[str] = (), keep_going: bool = False) -> dict[str, str]:
        """Of each stage: ran, fresh, failed or blocked (something it needs failed)."""
        (self.folder / "receipts").mkdir(parents=True, exist_ok=True)
        forced = set().union(*(downstream({s.name: s.needs for s in self.stages}, f) for f in force)) if force else set()
        state: dict[str, str] = {}
        done: dict[str, str] = {}
        results: dict[str, object] = {}
        for name in [n for layer in self.layers for n in layer]:
            stage = self.by_name[name]
            if any(state[n] in ("failed", "blocked") for n in stage.needs):
                state[name] = "blocked"
                continue
            key, path = self.key(stage, done), self.receipt(name)
            old = json.loads(path.read_text()) if path.exists() else {}
            if old.get("key") == key and name not in forced:
                state[name], done[name], results[name] = "fresh", old["output"], old["result"]
                continue
            try:
                result = json.loads(canonical(dict(stage.run({n: results[n] for n in stage.needs}))))
            except Exception as e:  # a failed stage is quarantined with its reason, not lost
                state[name] = "failed"
                atomic_write(path.with_suffix(".failed.json"), canonical({"key": key, "error": repr(e)}))
                if not keep_going:
                    raise
                continue
            done[name] = digest(result)
            results[name], state[name] = result, "ran"
            atomic_write(path, canonical({"key": key, "output": done[name], "result": result}))
        return state


def atomic_write(path: Path, data: bytes) -> str:
    """SNK-4: written beside, flushed to disk, renamed; the receipt is the SHA-256."""
    import os

    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.part")
    with beside.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)
    return hashlib.sha256(data).hexdigest()


def write_manifest(folder: Path, entries: Mapping[str, str], kinds: Mapping[str, str] | None = None, version: str = "1.0") -> dict:
    """SNK-7: paths with SHA-256, size and kind, and a hash of the manifest itself."""
    folder = Path(folder)
    items = [{"key": k, "path": p, "sha256": hashlib.sha256((folder / p).read_bytes()).hexdigest(), "bytes": (folder / p).stat().st_size, "kind": (kinds or {}).get(k, "bytes"), "schema_version": version} for k, p in sorted(entries.items())]
    body = {"schema_version": version, "artifacts": items}
    body["self_sha256"] = digest(body)
    atomic_write(folder / "manifest.json", canonical(body))
    return body


def verify_manifest(folder: Path, major: str = "1") -> list[str]:
    """L-4: faults of a manifest and its files; none for a sound one.  A path may not leave the folder."""
    folder = Path(folder).resolve()
    body = json.loads((folder / "manifest.json").read_text())
    said = body.pop("self_sha256", None)
    faults = [] if said == digest(body) else ["SELF_HASH"]
    if body["schema_version"].split(".")[0] != major:
        faults.append("SCHEMA_MAJOR")
    for a in body["artifacts"]:
        path = (folder / a["path"]).resolve()
        if not path.is_relative_to(folder):
            faults.append(f"OUTSIDE:{a['key']}")
        elif not path.exists():
            faults.append(f"MISSING:{a['key']}")
        elif hashlib.sha256(path.read_bytes()).hexdigest() != a["sha256"]:
            faults.append(f"SHA256:{a['key']}")
    return faults


def parity(a: DataFrame, b: DataFrame, id_col: str, columns: Sequence[str], tolerance: float = 1e-4) -> DataFrame:
    """J-15, REP-2: one row: rows on either side only, and the greatest difference, by full outer join on the id."""
    left = a.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"a_{k}") for k, c in enumerate(columns)), F.lit(True).alias("in_a"))
    right = b.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"b_{k}") for k, c in enumerate(columns)), F.lit(True).alias("in_b"))
    diffs = [F.abs(F.col(f"a_{k}") - F.col(f"b_{k}")) for k in range(len(columns))]
    worst = F.greatest(*diffs) if len(diffs) > 1 else diffs[0]
    out = left.join(right, "id", "full").agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"), F.coalesce(F.max(worst), F.lit(0.0)).alias("max_diff"))
    return out.withColumn("ok", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("max_diff") <= tolerance))


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    edges.createOrReplaceTempView("evidentia_edges")
    return spark.sql(closure_sql("evidentia_edges"))
