"""Ingestion: wide, long and array panels, recoding, covariate designs, case weights.

Everything is a projection, one aggregation, or a pivot; columns of a panel are named item@time, time by time.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAMILIES = ("binary", "categorical", "ordinal", "continuous", "count", "zip", "negbin")


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table by path: parquet, csv, json or orc, told by the name where no format is given."""
    kind = format or next((k for k in ("parquet", "csv", "json", "orc") if path.rstrip("/").endswith(k)), "parquet")
    if kind == "csv":
        options = {"header": "true", "inferSchema": "true"} | options
    return spark.read.format(kind).options(**options).load(path)


def column_names(items: Sequence[str], times: Sequence) -> list[str]:
    return [f"{i}@{t}" for t in times for i in items]


def long_to_wide(df: DataFrame, *, id: str, time: str, items: Sequence[str], times: Sequence | None = None, order: str | None = None) -> DataFrame:
    """One row per id with columns item@time.  Of several records of an id and time the last by `order` counts; absent waves are null."""
    if times is None:
        times = sorted(r[0] for r in df.select(time).distinct().limit(1001).collect())
        if len(times) > 1000:
            raise ValueError("more than 1000 occasions; name them")
    by = F.struct(F.col(order or time), *(F.col(i) for i in items))
    cells = []
    for t in times:
        here = F.max(F.when(F.col(time) == F.lit(t), by))
        cells += [here.getField(i).alias(f"{i}@{t}") for i in items]
    return df.groupBy(id).agg(*cells)


def wide_to_panel(df: DataFrame, columns: Sequence[str], items: Sequence[str], times: Sequence, layout: str = "time_major") -> DataFrame:
    """Columns given time by time or item by item, renamed item@time in time-major order; other columns stay in front."""
    if len(columns) != len(items) * len(times):
        raise ValueError("columns are not items x times")
    grid = {(i, t): (columns[b * len(items) + a] if layout == "time_major" else columns[a * len(times) + b]) for a, i in enumerate(items) for b, t in enumerate(times)}
    rest = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in rest), *(F.col(f"`{grid[i, t]}`").alias(f"{i}@{t}") for t in times for i in items))


def array_to_panel(df: DataFrame, column: str, items: Sequence[str], times: Sequence) -> DataFrame:
    """An array (occasion) of arrays (item) as columns item@time."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(F.col(column)[b][a].alias(f"{i}@{t}") for b, t in enumerate(times) for a, i in enumerate(items)))


def stack_occasions(df: DataFrame, items: Sequence[str], times: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """One row per case and occasion: the columns of `keep`, occasion (from 1), time, and the items."""
    waves = F.array(*(F.struct(F.lit(b + 1).alias("occasion"), F.lit(t).alias("time"), *(F.col(f"`{i}@{t}`").alias(i) for i in items)) for b, t in enumerate(times)))
    return df.select(*keep, F.explode(waves).alias("_at_occasion")).select(*keep, "_at_occasion.*")


def wave_missing(df: DataFrame, items: Sequence[str], times: Sequence) -> DataFrame:
    """df with a boolean missing@time for each occasion of which nothing was observed."""
    return df.withColumns({f"missing@{t}": F.coalesce(*(F.col(f"`{i}@{t}`").cast("string") for i in items)).isNull() for t in times})


def drop_empty(df: DataFrame, items: Sequence[str], keep_if: str | None = None) -> DataFrame:
    """Rows with an observed indicator (or an observed `keep_if`)."""
    return df.where(F.coalesce(*(F.col(f"`{c}`").cast("string") for c in [*items, *([keep_if] if keep_if else [])])).isNotNull())


def inspect(df: DataFrame, items: Sequence[str]) -> dict[str, dict]:
    """Per item: number of distinct values (approximate over 50), least, greatest, nulls, whether all are whole; one aggregation."""
    cells = []
    for c in items:
        x = F.col(f"`{c}`")
        number = x.cast("double")
        cells += [F.approx_count_distinct(x, 0.01).alias(f"n:{c}"), F.min(number).alias(f"min:{c}"), F.max(number).alias(f"max:{c}"), F.sum(x.isNull().cast("bigint")).alias(f"null:{c}"), F.min((number == F.floor(number)).cast("int")).alias(f"whole:{c}")]
    row = df.agg(*cells).first()
    return {c: {"distinct": row[f"n:{c}"], "min": row[f"min:{c}"], "max": row[f"max:{c}"], "nulls": row[f"null:{c}"] or 0, "whole": row[f"whole:{c}"] == 1} for c in items}


def measurement_hint(df: DataFrame, items: Sequence[str]) -> dict[str, str]:
    """A family for each item: two values are binary; whole, at least 0 and ten values at most categorical; whole and at least 0 counts; else continuous."""
    out = {}
    for c, s in inspect(df, items).items():
        whole = s["whole"] and s["min"] is not None and s["min"] >= 0
        out[c] = "binary" if s["distinct"] <= 2 else "categorical" if whole and s["distinct"] <= 10 else "count" if whole else "continuous"
    return out


def normalize_measurement(items: Sequence[str], measurement: str | Mapping[str, Sequence[str]] | None) -> list[tuple[str, list[str]]]:
    """(family, items) blocks; every item in exactly one."""
    if measurement is None:
        raise ValueError("measurement must be given: a family, or a mapping of families to items")
    blocks = [(measurement, list(items))] if isinstance(measurement, str) else [(f, [c] if isinstance(c, str) else list(c)) for f, c in measurement.items()]
    seen = [c for _, cols in blocks for c in cols]
    for f, _ in blocks:
        if f not in FAMILIES and not f.startswith("continuous"):
            raise ValueError(f"no such family: {f}")
    if len(seen) != len(set(seen)):
        raise ValueError("an item stands in two families: " + ", ".join(sorted({c for c in seen if seen.count(c) > 1})))
    if set(seen) != set(items):
        raise ValueError("items without a family, or no items: " + ", ".join(sorted(set(items) ^ set(seen))))
    return blocks


def recode_binary(df: DataFrame, items: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, dict[str, tuple]]:
    """Two-valued items as 0/1, the greater value 1, with the (low, high) found.

    `groups` names sets of columns (one item's occasions) that share one coding.
    """
    groups = groups or {c: [c] for c in items}
    row = df.agg(*(f(F.col(f"`{c}`")).alias(f"{n}:{c}") for cols in groups.values() for c in cols for n, f in (("lo", F.min), ("hi", F.max)))).first()
    coding, new, wrong = {}, {}, []
    for g, cols in groups.items():
        ends = [v for c in cols for v in (row[f"lo:{c}"], row[f"hi:{c}"]) if v is not None]
        if not ends:
            coding[g] = (None, None)
            continue
        lo, hi = min(ends), max(ends)
        coding[g] = (lo, hi)
        for c in cols:
            x = F.col(f"`{c}`")
            wrong.append(F.sum((x.isNotNull() & ~x.isin(lo, hi)).cast("bigint")).alias(c))
            single = int(hi == 1) if lo == hi else 1
            new[c] = F.when(x == F.lit(hi), F.lit(single)).when(x == F.lit(lo), F.lit(0))
    if wrong:
        bad = [c for c, n in df.agg(*wrong).first().asDict().items() if n]
        if bad:
            raise ValueError("binary items with more than two values: " + ", ".join(bad))
    return df.withColumns(new), coding


def coded(df: DataFrame, coding: Mapping[str, tuple]) -> DataFrame:
    """df with columns as a coding (column to low and high) says: a value that it lacks is refused where the row is read."""
    new = {}
    for c, (lo, hi) in coding.items():
        x = F.col(f"`{c}`")
        if lo is None:
            continue
        strange = F.when(x.isNotNull(), F.raise_error(F.concat(F.lit(f"a value of {c} that the fit has not seen: "), x.cast("string"))).cast("int"))
        new[c] = F.when(x == F.lit(hi), F.lit(1 if lo != hi else int(hi == 1))).when(x == F.lit(lo), F.lit(0)).otherwise(strange)
    return df.withColumns(new) if new else df


def columns_coding(coding: Mapping[str, tuple], groups: Mapping[str, Sequence[str]]) -> dict[str, tuple]:
    """The coding of each column that needs one: 0 and 1 stand for themselves."""
    return {c: ends for g, ends in coding.items() for c in groups[g] if ends[0] is not None and not set(ends) <= {0, 1}}


def align_rows(rows: DataFrame, fitted: DataFrame, key: str) -> DataFrame:
    """Of rows given for the original data, those that a fit kept: one for each key of `fitted`; a key without a row, or with several, is refused."""
    held = rows.join(fitted.select(F.col(f"`{key}`")), key, "left_semi")
    n, keys, asked = held.count(), held.select(f"`{key}`").distinct().count(), fitted.count()
    if not n == keys == asked:
        raise ValueError(f"{asked} fitted rows, {keys} of them with a row here, {n} rows")
    return held


def encode_levels(df: DataFrame, items: Sequence[str], levels: Mapping[str, Sequence] | None = None, max_levels: int = 100) -> tuple[DataFrame, dict[str, list]]:
    """Categorical columns of any type as codes 1..C in the order of their levels, with the levels found (or given) as labels."""
    labels = {}
    for c in items:
        found = list((levels or {}).get(c) or sorted(r[0] for r in df.select(f"`{c}`").where(F.col(f"`{c}`").isNotNull()).distinct().limit(max_levels + 1).collect()))
        if len(found) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        labels[c] = found
    strange = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.raise_error(F.concat(F.lit(f"a level of {c} that is not known: "), F.col(f"`{c}`").cast("string"))).cast("int"))
    codes = {c: F.when(F.col(f"`{c}`").isin(v), F.array_position(F.array(*map(F.lit, v)), F.col(f"`{c}`")).cast("int")).otherwise(strange(c)) for c, v in labels.items()}
    return df.withColumns(codes), labels


def check_categories(df: DataFrame, items: Sequence[str]) -> None:
    bad = [c for c, s in inspect(df, items).items() if s["min"] is not None and not (s["whole"] and s["min"] >= 1)]
    if bad:
        raise ValueError("categories must be whole codes from 1: " + ", ".join(bad))


def check_counts(df: DataFrame, items: Sequence[str]) -> None:
    bad = [c for c, s in inspect(df, items).items() if s["min"] is not None and not (s["whole"] and s["min"] >= 0)]
    if bad:
        raise ValueError("counts must be whole and at least 0: " + ", ".join(bad))


def dummies(df: DataFrame, terms: Sequence[str], levels: Mapping[str, Sequence] | None = None, max_levels: int = 100) -> tuple[DataFrame, dict[str, list[str]]]:
    """Numeric covariates as they are, others as indicators name.level against their first level.

    Products are terms such as a:b.  Gives df with the columns and, per term, their names; levels with fewer than five cases are warned of.
    """
    levels, out, new = dict(levels or {}), {}, {}
    kinds = dict(df.dtypes)

    def main(term: str) -> list[str]:
        if term in out:
            return out[term]
        if term not in kinds:
            raise ValueError(f"no such column: {term}")
        if kinds[term] in ("string", "boolean") or term in levels:
            if term not in levels:
                found = df.where(F.col(term).isNotNull()).groupBy(term).count().limit(max_levels + 1).collect()
                if len(found) > max_levels:
                    raise ValueError(f"{term} has more than {max_levels} levels")
                levels[term] = sorted(r[0] for r in found)
                small = [str(r[0]) for r in found if r["count"] < 5]
                if small:
                    warnings.warn(f"{term}: fewer than five cases at {', '.join(small)}", stacklevel=3)
            for v in levels[term][1:]:
                new[f"{term}.{v}"] = F.when(F.col(term).isNotNull(), (F.col(term) == F.lit(v)).cast("double"))
            out[term] = [f"{term}.{v}" for v in levels[term][1:]]
        else:
            new[f"{term}."] = F.col(term).cast("double")
            out[term] = [f"{term}."]
        return out[term]

    for term in terms:
        if ":" not in term:
            main(term)
            continue
        sides = [main(t) for t in term.split(":")]
        names = [""]
        grid = [(n, c) for n, c in ((s, new[s]) for s in sides[0])]
        for side in sides[1:]:
            grid = [(f"{n}:{s}", c * new[s]) for n, c in grid for s in side]
        names = [n for n, _ in grid]
        new |= dict(grid)
        out[term] = names
    return df.withColumns(new), {t: out[t] for t in terms}


def predictors_observed(columns: Sequence[str]) -> Column:
    """True where all predictors are observed (listwise); others leave the structural model only."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"`{c}`").isNotNull()
    return cond


def impute_conditional_means(df: DataFrame, columns: Sequence[str], ridge: float = 1e-6) -> DataFrame:
    """Missing covariates by their conditional means under a multivariate normal with pairwise moments.

    One aggregation for the moments; then a projection per pattern of missing columns, so no rows leave the JVM.
    """
    d = len(columns)
    x = [F.col(f"`{c}`").cast("double") for c in columns]
    cells = [F.avg(x[i]).alias(f"m{i}") for i in range(d)] + [F.covar_samp(x[i], x[j]).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    row = df.agg(*cells).first()
    mean = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i in range(d)])
    cov = np.eye(d) * ridge
    for i in range(d):
        for j in range(i, d):
            v = row[f"c{i}_{j}"]
            v = 0.0 if v is None or v != v else v
            cov[i, j] += v
            cov[j, i] += v * (i != j)
    mask = sum((F.when(x[i].isNull(), 1 << i).otherwise(0) for i in range(d)), F.lit(0))
    patterns = [r[0] for r in df.select(mask.alias("m")).distinct().limit(4097).collect()]
    if len(patterns) > 4096:
        raise ValueError("more than 4096 patterns of missing covariates")
    new = {}
    for i, c in enumerate(columns):
        value = x[i]
        for p in patterns:
            if not p >> i & 1:
                continue
            seen = [j for j in range(d) if not p >> j & 1]
            b = np.linalg.pinv(cov[np.ix_(seen, seen)]) @ cov[seen, i] if seen else np.zeros(0)
            fill = F.lit(float(mean[i] - b @ mean[seen])) if seen else F.lit(float(mean[i]))
            for k, j in enumerate(seen):
                fill = fill + float(b[k]) * x[j]
            value = F.when(mask == p, fill).otherwise(value)
        new[c] = value
    return df.withColumns(new)


def rescale_weights(df: DataFrame, weight: str, kind: str = "sampling", out: str = "w") -> DataFrame:
    """Sampling weights sum to the number of rows; frequency weights stay.  Null or negative weights are refused."""
    row = df.agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n"), F.min(weight).alias("lo"), F.sum(F.col(weight).isNull().cast("bigint")).alias("nulls")).first()
    if row.n and (row.nulls or row.lo < 0 or not row.s):
        raise ValueError("weights must be at least 0, not all 0, and not null")
    if kind == "frequency":
        return df.withColumn(out, F.col(weight).cast("double"))
    if kind != "sampling":
        raise ValueError("weights are sampling or frequency weights")
    return df.withColumn(out, F.col(weight) * (row.n / row.s) if row.n else F.lit(None).cast(T.DoubleType()))
