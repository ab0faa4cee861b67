"""Small files: labels and rankings as CSV, artifacts with their hashes, layered configuration."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LABELS = "candidate_id string, tier string, reasoning string, reviewer string, archetype_id string, is_honeypot_suspect string, is_borderline string, cited_features string"
SUBMISSION_HEADER = ("candidate_id", "rank", "score", "reasoning")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: gold labels; a suspect's tier is 0, the last of repeated ids wins."""
    raw = spark.read.csv(path, header=True, schema=_LABELS, multiLine=True, escape='"', enforceSchema=False).withColumn("__at", F.monotonically_increasing_id())
    last = raw.groupBy("candidate_id").agg(F.max_by(F.struct(*[c for c in raw.columns if c not in ("candidate_id", "__at")]), "__at").alias("x")).select("candidate_id", "x.*")
    yes = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("true", "1", "yes")
    suspect = yes("is_honeypot_suspect")
    return last.select(
        "candidate_id",
        F.when(suspect, 0).otherwise(F.expr("try_cast(tier as int)")).alias("tier"),
        "reasoning",
        "reviewer",
        F.expr("try_cast(nullif(trim(archetype_id), '') as int)").alias("archetype_id"),
        suspect.alias("is_honeypot_suspect"),
        yes("is_borderline").alias("is_borderline"),
        F.filter(F.transform(F.split(F.coalesce("cited_features", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "").alias("cited_features"),
    )


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: a ranking; another header than the fixed one is an error."""
    return spark.read.csv(path, header=True, schema="candidate_id string, rank int, score double, reasoning string", multiLine=True, escape='"', enforceSchema=False)


def read_vectors(spark: SparkSession, path: str, id_col: str = "id", prefix: str = "v") -> DataFrame:
    """SRC-7: (id, vector) from a table with one float column per dimension; other columns are not read."""
    df = spark.read.parquet(path)
    dims = sorted((c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    if [f"{prefix}{k}" for k in range(len(dims))] != dims:
        raise ValueError("vector columns have gaps")
    if wrong := [c for c, kind in df.dtypes if c in dims and kind != "float"]:
        raise ValueError(f"columns are not float: {wrong[:3]}")
    return df.select(F.col(id_col).cast("string").alias("id"), F.array(*dims).alias("vector"))


def read_snapshot(spark: SparkSession, path: str, layout: list[str]) -> DataFrame:
    """SRC-8: a feature snapshot by name, so the order of columns doesn't matter."""
    return spark.read.parquet(path).select("id", *layout)


def read_artifact(path: str | Path, sha256: str | None = None) -> bytes:
    """SRC-9: bytes, checked against their hash."""
    data = Path(path).read_bytes()
    if sha256 is not None and hashlib.sha256(data).hexdigest() != sha256:
        raise ValueError(f"{path}: content is not what the manifest says")
    return data


def artifact_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-9 for many files: (path, bytes, sha256), hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def deep_merge(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """SRC-10: later layers win; mappings merge, everything else is replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else (dict(v) if isinstance(v, Mapping) else v)
    return out


def check_config(config: Mapping[str, Any]) -> list[str]:
    """CFG-1 to CFG-8: faults of a configuration; none for a sound one."""
    faults = []
    run = config.get("run", {})
    if run.get("alarm_seconds", 0) > run.get("ceiling_seconds", float("inf")):
        faults.append("ALARM_ABOVE_CEILING")
    as_of = config.get("as_of")
    if as_of is not None and getattr(as_of, "tzinfo", None) is None:
        faults.append("AS_OF_WITHOUT_TIMEZONE")
    if len([m for m in ("online", "offline") if m in config]) != 1:
        faults.append("NOT_ONE_RUN_MODE")
    if any(not isinstance(w, (int, float)) or w != w or abs(w) == float("inf") for w in config.get("weights", {}).values()):
        faults.append("WEIGHT_NOT_FINITE")
    if any(not str(t).strip() for ts in config.get("lexicon", {}).values() for t in ts):
        faults.append("BLANK_TERM")
    anchors = config.get("anchors", [])
    if len({a["id"] for a in anchors}) != len(anchors):
        faults.append("ANCHOR_REPEATED")
    if anchors and {a["polarity"] for a in anchors} != {"positive", "negative"}:
        faults.append("ANCHOR_POLARITY_MISSING")
    rules = config.get("rules", [])
    if len({r["code"] for r in rules}) != len(rules):
        faults.append("RULE_REPEATED")
    if any(("penalty" in r) == bool(r.get("hard")) for r in rules):
        faults.append("RULE_PENALTY")
    flags = config.get("flags", [])
    if len(set(flags)) != len(flags):
        faults.append("FLAG_REPEATED")
    return sorted(faults)
