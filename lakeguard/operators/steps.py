"""Pipeline steps: every step is DataFrame → DataFrame, a chain is their composition."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types a column can be cast to, by their names in definitions.  Fixed values.
CASTS = {"INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "BIGINT": "bigint", "FLOAT": "float", "TEXT": "string"}


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


# ------------------------------------------------------------ filters and projections
def filter_step(df: DataFrame, column: str, operator: str = "=", value: Any = None) -> DataFrame:
    """Rows that compare; an empty or unknown column leaves df as it is, an unknown operator means =."""
    if not column or column not in df.columns:
        return df
    c, op = F.col(f"`{column}`"), operator.upper().strip()
    kind = df.schema[column].dataType.simpleString()
    lit = lambda v: F.lit(str(v)).try_cast(kind) if v is not None else F.lit(None).cast(kind)
    if op == "IS NULL":
        return df.filter(c.isNull())
    if op == "IS NOT NULL":
        return df.filter(c.isNotNull())
    if op in ("LIKE", "NOT LIKE"):
        like = c.cast("string").like(str(value))
        return df.filter(like if op == "LIKE" else ~like)
    if op in ("IN", "NOT IN"):
        values = value if isinstance(value, (list, tuple, set)) else [value]
        among = c.isin([lit(v) for v in values])
        return df.filter(among if op == "IN" else ~among)
    compare = {"!=": c != lit(value), "<>": c != lit(value), ">": c > lit(value), "<": c < lit(value), ">=": c >= lit(value), "<=": c <= lit(value)}
    return df.filter(compare.get(op, c == lit(value)))


def rename_first(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Renamed columns first, in the order of the map, then the others."""
    known = {k: v for k, v in names.items() if k in df.columns}
    return df.select(*[F.col(f"`{k}`").alias(v) for k, v in known.items()], *[F.col(f"`{c}`") for c in df.columns if c not in known])


def rename_in_place(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def cast_step(df: DataFrame, column: str, kind: str, in_place: bool = False, strict: bool = True) -> DataFrame:
    """Adds ``<column>_cast``, or casts in place; unknown types leave df as it is; not strict: bad values become null."""
    to = CASTS.get(kind.upper())
    if to is None or column not in df.columns:
        return df
    c = F.col(f"`{column}`")
    return df.withColumn(column if in_place else f"{column}_cast", c.cast(to) if strict else c.try_cast(to))


def fill_missing(df: DataFrame, column: str, method: str = "value", value: Any = None, in_place: bool = False) -> DataFrame:
    """Nulls of one column by a value, the mean or the median; adds ``<column>_filled`` unless in place."""
    name = column if in_place else f"{column}_filled"
    if method == "value":
        return df.withColumn(name, F.coalesce(F.col(column), F.lit(value).cast(df.schema[column].dataType)))
    stat = F.avg(column) if method == "mean" else F.percentile(column, 0.5)
    return df.join(F.broadcast(df.agg(stat.alias("_fill")))).withColumn(name, F.coalesce(F.col(column).cast("double"), F.col("_fill"))).drop("_fill")


def fill_all(df: DataFrame, method: str = "mean", value: Any = None) -> DataFrame:
    """Nulls of every column that has any: numbers by mean, median or a value (0 by default), text by a value that is no number."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first().asDict()
    holes = [c for c in df.columns if counts[c]]
    numeric = [c for c in holes if is_numeric(df.schema[c].dataType)]
    number = value if isinstance(value, (int, float)) else 0
    if not holes:
        return df
    out = df
    if numeric and method in ("mean", "median"):
        stats = df.agg(*[(F.avg(c) if method == "mean" else F.percentile(c, 0.5)).alias(f"_f_{c}") for c in numeric])
        out = out.join(F.broadcast(stats))
        fills = {c: F.col(f"_f_{c}") for c in numeric}
    else:
        fills = {c: F.lit(number) for c in numeric}
    columns: list[Column] = []
    for c in df.columns:
        if c in fills:
            columns.append(F.coalesce(F.col(c).cast("double"), fills[c].cast("double")).alias(c))
        elif c in holes and isinstance(df.schema[c].dataType, T.StringType) and isinstance(value, str):
            columns.append(F.coalesce(F.col(c), F.lit(value)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def custom_sql(df: DataFrame, sql: str) -> DataFrame:
    """A statement over {{prev}} or {{input}}, which stand for df."""
    return df.sparkSession.sql(re.sub(r"\{\{\s*(?:prev|input)\s*\}\}", "{prev}", sql), prev=df)


def sanitize_names(df: DataFrame) -> DataFrame:
    """Letters, digits and underscores only; a leading digit gets an underscore; equal names get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = re.sub(r"[^A-Za-z0-9_]", "_", c)
        n = f"_{n}" if n[:1].isdigit() or not n else n
        k = seen.get(n.lower(), 0)
        seen[n.lower()] = k + 1
        names.append(f"{n}_{k}" if k else n)
    return df.toDF(*names)


def trim_strings(df: DataFrame) -> DataFrame:
    return df.select(*[F.trim(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


# ------------------------------------------------------------ joins
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "SEMI": "left_semi", "ANTI": "left_anti"}


def join_step(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "INNER") -> DataFrame:
    """Equi-join with all columns of both; right names that clash get _1.  CROSS takes no keys; unknown types mean INNER."""
    clash = set(left.columns)
    right = right.toDF(*[f"{c}_1" if c in clash else c for c in right.columns])
    if how.upper() == "CROSS":
        return left.crossJoin(right)
    key = f"{right_key}_1" if right_key in clash else right_key
    return left.join(right, F.col(f"`{left_key}`") == F.col(f"`{key}`"), JOINS.get(how.upper(), "inner"))


# ------------------------------------------------------------ aggregations
def _aggregates(c: Column, approx: bool) -> dict[str, Column]:
    return {"COUNT": F.count(c), "SUM": F.sum(c), "AVG": F.avg(c), "MIN": F.min(c), "MAX": F.max(c), "MEDIAN": F.percentile_approx(c, 0.5) if approx else F.median(c), "STDDEV": F.stddev(c)}


def group_agg(df: DataFrame, group_by: Sequence[str], aggregations: Sequence[Mapping[str, str]], approx: bool = False) -> DataFrame:
    """GROUP BY with COUNT, SUM, AVG, MIN, MAX, MEDIAN, STDDEV; unknown functions are left out."""
    columns = []
    for a in aggregations:
        name, column = a["function"].upper(), a.get("column", "*")
        c = F.lit(1) if column == "*" else F.col(column)
        made = _aggregates(c, approx).get(name)
        if made is not None:
            columns.append(made.alias(a.get("alias") or f"{name}_{column}"))
    return df.groupBy(*group_by).agg(*columns) if columns else df.select(*group_by).distinct()


def pivot_step(df: DataFrame, on: str, values: Sequence[Any] | None, function: str, column: str) -> DataFrame:
    """PIVOT: a column for each value of ``on``, grouped by all other columns."""
    rest = [c for c in df.columns if c not in (on, column)]
    grouped = df.groupBy(*rest).pivot(on, list(values) if values else None)
    return grouped.agg(_aggregates(F.col(column), False)[function.upper()])


def unpivot_step(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, list(columns), "variable", "value").filter("value IS NOT NULL")


def dedup_keys(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order, which makes the survivor certain."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


# ------------------------------------------------------------ windows, sorting, sets
def window_step(df: DataFrame, function: str, partition_by: Sequence[str], order_by: Sequence[Column], alias: str, column: str | None = None, offset: int = 1, default: Any = None, n: int = 4, frame: tuple[str, int, int] | None = None) -> DataFrame:
    """ROW_NUMBER, RANK, DENSE_RANK, NTILE, LAG, LEAD, SUM, AVG, COUNT, MIN, MAX over a window."""
    w = Window.partitionBy(*partition_by).orderBy(*order_by)
    name = function.upper()
    ranks = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}
    if name in ranks:
        return df.withColumn(alias, ranks[name]().over(w))
    if name == "NTILE":
        return df.withColumn(alias, F.ntile(n).over(w))
    if name in ("LAG", "LEAD"):
        return df.withColumn(alias, (F.lag if name == "LAG" else F.lead)(column, offset, default).over(w))
    if frame:
        w = w.rowsBetween(frame[1], frame[2]) if frame[0] == "rows" else w.rangeBetween(frame[1], frame[2])
    made = _aggregates(F.col(column) if column else F.lit(1), False).get(name)
    return df.withColumn(alias, made.over(w)) if made is not None else df


def union_step(df: DataFrame, other: DataFrame, distinct: bool = False) -> DataFrame:
    both = df.unionByName(other, allowMissingColumns=True)
    return both.distinct() if distinct else both


def results_agree(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Cells in which two results differ as multisets: (tag, value, left_n, right_n); empty if they agree.

    Column names and the order of rows play no part; numbers are rounded, NaN is null, booleans are numbers.
    """

    def cells(df: DataFrame, side: str) -> DataFrame:
        out = []
        for f in df.schema:
            c = F.col(f"`{f.name}`")
            if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType):
                d = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
                out.append(F.struct(F.when(d.isNull(), "null").otherwise("number").alias("tag"), F.format_string(f"%.{digits}f", F.round(d, digits) + 0.0).alias("value")))
            else:
                out.append(F.struct(F.when(c.isNull(), "null").otherwise("text").alias("tag"), c.cast("string").alias("value")))
        flat = df.select(F.explode(F.array(*out)).alias("cell")).select("cell.tag", F.when(F.col("cell.tag") == "null", "").otherwise(F.col("cell.value")).alias("value"))
        return flat.groupBy("tag", "value").agg(F.count("*").alias(side))

    both = cells(left, "left_n").join(cells(right, "right_n"), ["tag", "value"], "full")
    return both.select("tag", "value", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n")).filter("left_n <> right_n")


# ------------------------------------------------------------ chains
@dataclass(frozen=True)
class Step:
    """A step of a pipeline definition."""

    kind: str
    config: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Run:
    """A chain's result, and the steps that were executed and skipped."""

    frame: DataFrame
    executed: int
    skipped: int


_STEPS: dict[str, Callable[..., DataFrame]] = {
    "filter": filter_step,
    "where": lambda df, condition: df.where(condition),
    "drop": lambda df, columns: df.drop(*columns),
    "rename": lambda df, names: rename_first(df, names),
    "add": lambda df, name, expression: df.withColumn(name, F.expr(expression)),
    "cast": cast_step,
    "fill": fill_missing,
    "fill_all": fill_all,
    "sql": lambda df, sql: custom_sql(df, sql),
    "sort": lambda df, column, descending=False: df.orderBy(F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()),
    "limit": lambda df, n=100: df.limit(n),
    "join": lambda df, right, left_key="", right_key="", how="INNER": join_step(df, right, left_key, right_key, how),
    "group": lambda df, group_by, aggregations: group_agg(df, group_by, aggregations),
    "pivot": pivot_step,
    "unpivot": lambda df, columns: unpivot_step(df, columns),
    "distinct": lambda df: df.distinct(),
    "dedup": dedup_keys,
    "window": window_step,
    "union": union_step,
    "trim": trim_strings,
    "sanitize": sanitize_names,
}


def run_chain(df: DataFrame, steps: Sequence[Step]) -> Run:
    """All steps in order; those of unknown kind or without what they need are skipped and counted."""
    done = skipped = 0
    for s in steps:
        made = _STEPS.get(s.kind)
        needs = {k: s.config.get(k) for k in ("column", "condition", "columns", "names") if k in s.config}
        if made is None or any(v in (None, "", [], {}) for v in needs.values()):
            skipped += 1
            continue
        df = made(df, **s.config)
        done += 1
    return Run(df, done, skipped)


# ------------------------------------------------------------ personal data
PII_KEYS = frozenset(("email", "phone", "ssn", "name", "address", "credit_card", "dob"))


def redact(df: DataFrame, keys: frozenset[str] = PII_KEYS, mark: str = "[REDACTED]") -> DataFrame:
    """Fields with such names, at any depth of structs and arrays, replaced by a mark."""

    def clean(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            fields = [(F.lit(mark) if f.name.lower() in keys else clean(c.getField(f.name), f.dataType)).alias(f.name) for f in kind]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: clean(x, kind.elementType))
        return c

    return df.select(*[(F.lit(mark) if f.name.lower() in keys else clean(F.col(f"`{f.name}`"), f.dataType)).alias(f.name) for f in df.schema])


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column in hex, as an expression."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def tokenize_pii(df: DataFrame, column: str, key: bytes, context: str) -> DataFrame:
    """A column's values as PII- and 12 hex digits that depend on key, context, field and value."""
    mac = hmac_sha256(key, F.concat_ws("|", F.lit(context), F.lit(column), F.col(column).cast("string")))
    return df.withColumn(column, F.when(F.col(column).isNotNull(), F.concat(F.lit("PII-"), F.substring(mac, 1, 12))))


# ------------------------------------------------------------ repairs
def repair_rename(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """As many columns added as removed: mapped back in the order of their names."""
    added, removed = sorted(set(df.columns) - set(expected)), sorted(set(expected) - set(df.columns))
    return df.withColumnsRenamed(dict(zip(added, removed, strict=True))) if len(added) == len(removed) else df


def repair_missing(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in expected.items() if c not in df.columns})


def repair_extra(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in expected if c in df.columns])


def repair_cast(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in expected.items() if c in df.columns})


#: Factors that unit errors have.  Fixed values.
FACTORS = (10, 100, 1000, 1_000_000, 60, 3600, 24, 12, 2)


def repair_rescale(df: DataFrame, column: str, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Divides by the factor k (or its inverse) that the batch's mean is of the baseline's, within a tolerance."""
    means = df.agg(F.avg(column).alias("_b")).join(F.broadcast(baseline.agg(F.avg(column).alias("_0"))))
    ratio = F.try_divide(F.col("_b"), F.col("_0"))
    factor: Column = F.lit(1.0)
    for k in reversed([float(x) for x in FACTORS] + [1.0 / x for x in FACTORS]):
        factor = F.when(F.abs(ratio / k - 1) <= tolerance, F.lit(k)).otherwise(factor)
    return df.join(F.broadcast(means.select(factor.alias("_k")))).withColumn(column, F.col(column) / F.coalesce("_k", F.lit(1.0))).drop("_k")


def repair_clip(df: DataFrame, columns: Sequence[str], baseline: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Each column held within the baseline's mean ± sigmas standard deviations."""
    stats = baseline.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    clipped = {c: F.greatest(F.least(F.col(c), F.col(f"_m_{c}") + sigmas * F.col(f"_s_{c}")), F.col(f"_m_{c}") - sigmas * F.col(f"_s_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(clipped).drop(*stats.columns)


def causal_encode(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], most: int = 12, left_out: list[str] | None = None) -> DataFrame:
    """A modelling table: treatment as 0/1, outcome as a number, categories one-hot without the first, null rows dropped.

    A treatment of two values maps the larger to 1; a continuous one is cut at its median.
    A confounder of more than ``most`` categories would bias the effect if it went unseen: its name is added
    to ``left_out`` if that list is given, else it is an error.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    values = {c: [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).limit(most + 1).collect()] for c in [treatment, *confounders] if c == treatment or not is_numeric(kinds[c])}
    columns: list[Column] = []
    source = df
    if len(values[treatment]) == 2:
        columns.append((F.col(treatment) == F.lit(values[treatment][1])).cast("int").alias(treatment))
    else:
        source = source.join(F.broadcast(df.agg(F.percentile(treatment, 0.5).alias("_median"))))
        columns.append((F.col(treatment) > F.col("_median")).cast("int").alias(treatment))
    columns.append(F.col(outcome).try_cast("double").alias(outcome))
    for c in confounders:
        if c not in values:
            columns.append(F.col(c).try_cast("double").alias(c))
        elif len(values[c]) == 2:
            columns.append((F.col(c) == F.lit(values[c][1])).cast("double").alias(c))
        elif len(values[c]) <= most:
            columns += [(F.col(c) == F.lit(v)).cast("double").alias(f"{c}_{re.sub(r'[^A-Za-z0-9]', '_', str(v))}") for v in values[c][1:]]
        elif left_out is None:
            raise ValueError(f"{c} has more than {most} categories")
        else:
            left_out.append(c)
    return source.select(*columns).na.drop()
