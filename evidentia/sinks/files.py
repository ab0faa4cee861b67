"""The final ranking as CSV, the run report, and checked Parquet."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators.lineage import atomic_write
from evidentia.operators.vectors import check_vectors
from evidentia.sources.files import SUBMISSION_HEADER


def write_submission(ranking: DataFrame, path: str | Path, rows: int = 100, digits: int = 6) -> str:
    """SNK-1 to SNK-4: the ranked rows with fixed decimals, ties as shown by id, checked, then written in one step.

    Python formats the score, as its rounding (half to even on the binary value)
    is what readers of the file expect.  Returns the SHA-256 of the file.
    """
    got = ranking.select("candidate_id", "score", "reasoning").limit(rows + 1).collect()
    if len(got) != rows:
        raise ValueError(f"{len(got)} rows instead of {rows}")
    shown = sorted(((f"{r.score:.{digits}f}", r.candidate_id, r.reasoning) for r in got), key=lambda x: (-float(x[0]), x[1]))
    if len({c for _, c, _ in shown}) != rows:
        raise ValueError("ids repeat")
    if any(not (t or "").strip() for _, _, t in shown):
        raise ValueError("a row has no text")
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(SUBMISSION_HEADER)
    w.writerows((c, n, s, t) for n, (s, c, t) in enumerate(shown, 1))
    return atomic_write(Path(path), out.getvalue().encode())


def write_report(report: Mapping[str, object], path: str | Path) -> str:
    """SNK-5: sorted keys, floats with 6 decimals."""

    def fixed(x: object) -> object:
        if isinstance(x, float):
            return float(f"{x:.6f}")
        if isinstance(x, Mapping):
            return {str(k): fixed(v) for k, v in x.items()}
        return [fixed(v) for v in x] if isinstance(x, (list, tuple)) else x

    return atomic_write(Path(path), (json.dumps(fixed(report), sort_keys=True, ensure_ascii=False, indent=1, default=str) + "\n").encode())


def write_vectors(df: DataFrame, path: str, dim: int, id_col: str = "id", vector: str = "vector") -> None:
    """SNK-6: one float column a dimension, as ``read_vectors`` takes them, after a check for null, odd, short, long or not unit vectors and repeated ids."""
    faults = check_vectors(df, id_col, vector, dim).first().asDict()
    if bad := {k: n for k, n in faults.items() if n}:
        raise ValueError(f"vectors are not sound: {bad}")
    cells = [F.col(vector)[k].cast("float").alias(f"v{k}") for k in range(dim)]
    df.select(F.col(id_col).cast("string").alias("id"), *cells).write.mode("overwrite").option("compression", "none").parquet(path)


def write_features(df: DataFrame, path: str, features: Sequence[str], groups: Sequence[str], id_col: str = "candidate_id") -> None:
    """SNK-6: the snapshot: id, features and confidences as float32."""
    odd = df.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(c) for c in [*features, *groups])).first().asDict()
    if bad := [c for c, n in odd.items() if n]:
        raise ValueError(f"features are not finite: {bad[:5]}")
    df.select(F.col(id_col).alias("id"), *(F.col(c).cast("float").alias(c) for c in [*features, *groups])).write.mode("overwrite").parquet(path)


def dashboard(ranking: DataFrame, least: float = 0.0, most: float = 1.0, contains: str = "", sort: str = "rank") -> DataFrame:
    """SNK-8: rows of a ranking by score range and text, in one of three orders."""
    order = {"rank": [F.asc("rank")], "score": [F.desc("score"), F.asc("candidate_id")], "id": [F.asc("candidate_id")]}[sort]
    text = F.lower(F.concat_ws(" ", "candidate_id", "reasoning"))
    return ranking.where(F.col("score").between(least, most) & F.contains(text, F.lit(contains.lower()))).orderBy(*order)


def markdown(rows: DataFrame, columns: Sequence[str], limit: int = 100) -> str:
    """SNK-8: a table of the first rows, a report and not the data."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    got = rows.select(*columns).limit(limit).collect()
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in got)]) + "\n"
