"""Model catalogue and target selection: M13 target dimension, J09 catalogue
assembly, U04 missing classes, P22 composite dependency resolution, P23 tier
selection with a resume ledger, P18 feature/label split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.constants import COMPOSITE_DEPENDENCIES, TARGET_METADATA, TARGETS, display_name


def target_dim(spark: SparkSession) -> DataFrame:
    """One row per target (40 rows, fixed size)."""
    rows = []
    for t in TARGETS:
        m = TARGET_METADATA[t]
        vr = m.get("value_range") or (None, None)
        exp = m.get("expected_classes")
        rows.append((t, display_name(t), m["task_type"], m["unit"], m["group"],
                     [str(x) for x in exp] if exp is not None else None, vr[0], vr[1]))
    return spark.createDataFrame(rows, "target string, display_name string, task_type string, unit string, group string, "
                                       "expected_classes array<string>, range_min double, range_max double")


def model_catalog(dim: DataFrame, metrics: DataFrame, diagnostics: DataFrame, observed: DataFrame) -> DataFrame:
    """Targets LEFT JOIN metrics LEFT JOIN diagnostics, plus U04 (expected
    classes never observed -> flagged).  ``observed`` = (target, classes)."""
    j = (dim.join(metrics, on="target", how="left").join(diagnostics, on="target", how="left")
         .join(observed, on="target", how="left"))
    missing = F.when(F.col("expected_classes").isNotNull() & F.col("classes").isNotNull(),
                     F.array_except("expected_classes", "classes"))
    status = F.lower(F.coalesce(F.col("overall_status"), F.lit("unknown")))
    status = F.when(status.isin("healthy", "flagged"), status).otherwise(F.lit("unknown"))
    j = j.withColumn("missing_classes", missing)
    flagged = F.coalesce(F.size("missing_classes") > 0, F.lit(False))
    warnings = F.array_compact(F.array(
        F.lit("Experimental surrogate model trained on rule-engineered labels; not field-validated."),
        F.when((status == "flagged") & (F.col("issues") != ""), F.col("issues")),
        F.when(flagged, F.concat(F.lit("Training data contains no examples for expected classes: "),
                                 F.array_join("missing_classes", ", ")))))
    return j.withColumns({"validation_status": F.when(flagged, F.lit("flagged")).otherwise(status),
                          "warnings": warnings, "n_warnings": F.size(warnings)})


def resolve_targets(requested: list[str], composites: list[str]) -> list[str]:
    """Requested targets, then the dependencies of the requested
    composites, order kept, no duplicates."""
    out, seen = list(requested), set(requested)
    for c in composites:
        for t in COMPOSITE_DEPENDENCIES.get(c, []):
            if t not in seen:
                out.append(t)
                seen.add(t)
    return out


def split_columns(columns: list[str], labels: list[str]) -> tuple[list[str], list[str]]:
    """(features, labels) by list algebra on the column names."""
    lab = [c for c in columns if c in set(labels)]
    return [c for c in columns if c not in set(labels)], lab


def pending_targets(spark: SparkSession, wanted: list[str], ledger: DataFrame | None) -> list[str]:
    """Targets still to train = wanted LEFT ANTI the completed ledger
    (bounded list of target names)."""
    want = spark.createDataFrame([(i, t) for i, t in enumerate(wanted)], "ord int, target string")
    if ledger is not None:
        want = want.join(ledger.select("target"), on="target", how="left_anti")
    return [r["target"] for r in want.orderBy("ord").collect()]
