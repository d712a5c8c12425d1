"""Projections, label handling and feature builders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalar import cyclic_sin, log1p, square


def split_features_label(df: DataFrame, label_col: str, id_col: str = "id",
                         exclude: Sequence[str] = ()) -> tuple[list[str], str]:
    """Feature column names (everything but id, label, excludes) and the label."""
    drop = {id_col, label_col, *exclude}
    return [c for c in df.columns if c not in drop], label_col


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """String-typed columns (the reference's ``object`` dtype)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, StringType) and f.name not in exclude]


def cast_label(df: DataFrame, label_col: str, to: str = "int") -> DataFrame:
    """Label cast (e.g. boolean/float 0/1 -> int)."""
    return df.withColumn(label_col, F.col(label_col).cast(to))


def map_label(df: DataFrame, label_col: str, mapping: Mapping[str, int],
              out_col: str | None = None) -> DataFrame:
    """Dictionary label mapping; unmapped values become null."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return df.withColumn(out_col or label_col, m[F.col(label_col)])


def add_source_flag(df: DataFrame, value: int, col: str = "is_generated") -> DataFrame:
    """P5: constant column telling generated (1) and original (0) rows apart."""
    return df.withColumn(col, F.lit(int(value)))


def drop_encoded_sources(df: DataFrame, cat_cols: Sequence[str]) -> DataFrame:
    """Drop the raw categoricals once their encodings exist."""
    return df.drop(*cat_cols)


def select_stat_columns(df: DataFrame, label_col: str, id_col: str = "id",
                        exclude: Sequence[str] = (), only: Sequence[str] | None = None,
                        strings_only: bool = False) -> list[str]:
    """Columns to build statistics on: all features minus excludes, a named list,
    or string columns only."""
    if only is not None:
        return [c for c in only if c in df.columns]
    cols = categorical_columns(df) if strings_only else df.columns
    return [c for c in cols if c not in {id_col, label_col, *exclude}]


def fill_default(df: DataFrame, cols: Sequence[str], default_col: str) -> DataFrame:
    """Null -> value of another column (e.g. the global mean)."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.col(c), F.col(default_col)))
    return df


def rename_prediction(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P10: rename statistic / prediction columns."""
    for a, b in mapping.items():
        df = df.withColumnRenamed(a, b)
    return df


def union_folds(parts: Sequence[DataFrame]) -> DataFrame:
    """Row concat of per-fold parts (by name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def augment_train(train_part: DataFrame, external: DataFrame, flag_col: str = "is_generated",
                  rename: Mapping[str, str] | None = None) -> DataFrame:
    """Training rows plus external labelled rows, by column name, flagged.

    Call it after the fold filter so validation never holds external rows (Q26).
    """
    if rename:
        external = rename_prediction(external, rename)
    ext = add_source_flag(external, 0, flag_col)
    tr = add_source_flag(train_part, 1, flag_col)
    ext = ext.select(*[c for c in ext.columns if c in tr.columns])
    return tr.unionByName(ext, allowMissingColumns=True)


def math_features(df: DataFrame, sin_cols: Sequence[str] = (), num_cols: Sequence[str] = (),
                  period: float = 12.0) -> DataFrame:
    """``_<c>_sin`` (float32) for ``sin_cols``; ``log_<c>`` and ``<c>_sq`` for
    ``num_cols``; columns absent from ``df`` are skipped."""
    present = set(df.columns)
    cols = [F.col(c) for c in df.columns]
    cols += [cyclic_sin(c, period).alias(f"_{c}_sin") for c in sin_cols if c in present]
    for c in num_cols:
        if c in present:
            cols += [log1p(c).alias(f"log_{c}"), square(c).alias(f"{c}_sq")]
    return df.select(*cols)
