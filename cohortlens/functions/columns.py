"""Column-level building blocks (survey B1-B16).

Everything here is a built-in Spark expression or a walk over ``df.schema``;
nothing runs Python per row, so all of it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Above this many entries a decode map becomes a broadcast join instead of a
# literal map expression (the map is driver-side data, so its size is known).
_MAP_LITERAL_LIMIT = 1000


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# B1
def project(df: DataFrame, cols: Sequence[str | Column]) -> DataFrame:
    return df.select(*cols)


# B2
def cols_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def select_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *cols_with_prefix(df, prefix))


# B3
def numeric_features(df: DataFrame, exclude: Iterable[str] = (), exclude_suffix: str | None = None,
                     include_bool: bool = False) -> list[str]:
    """Numeric columns minus a leakage list and a suffix (schema only, no job)."""
    drop = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.name in drop or (exclude_suffix and f.name.endswith(exclude_suffix)):
            continue
        if isinstance(f.dataType, T.NumericType) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


# B4
def keep_existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def first_existing(df: DataFrame, names: Sequence[str], default=None) -> Column:
    """The first of ``names`` present in ``df``; else a literal default."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(default)


# B5
def decode(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Code -> label; codes missing from ``mapping`` give NULL."""
    out = out or col
    if len(mapping) <= _MAP_LITERAL_LIMIT:
        m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return df.withColumn(out, F.try_element_at(m, F.col(col)))
    spark = df.sparkSession
    codes = spark.createDataFrame([(k, v) for k, v in mapping.items()], ["__code", "__label"])
    # The code table is driver-side data of known size: broadcasting is bounded.
    j = df.join(F.broadcast(codes), F.col(col) == F.col("__code"), "left")
    return j.withColumn(out, F.col("__label")).drop("__code", "__label")


def decode_col(col: str | Column, mapping: Mapping) -> Column:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(m, _c(col))


# B6
def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


# B7
def fill_nulls(df: DataFrame, cols: Sequence[str] | None = None, value=0) -> DataFrame:
    """NULL (and NaN) -> ``value`` for model inputs."""
    cols = list(cols) if cols is not None else numeric_features(df, exclude_suffix=None)
    types = {f.name: f.dataType for f in df.schema.fields}
    repl = {}
    for c in cols:
        e = F.col(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            e = F.nanvl(e, F.lit(None).cast(types[c]))
        repl[c] = F.coalesce(e, F.lit(value).cast(types[c]))
    return df.withColumns(repl)


# B8
def filter_by(df: DataFrame, predicate: Column | Mapping[str, object] | str) -> DataFrame:
    """``Column``/SQL string, or a dict of equality tests joined with AND."""
    if isinstance(predicate, Mapping):
        cond = F.lit(True)
        for k, v in predicate.items():
            cond = cond & (F.col(k) == F.lit(v))
        predicate = cond
    return df.filter(predicate)


# B9
def band(col: str | Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Ordered bands: ``x >= cuts[0]`` -> labels[0], ... else labels[-1];
    NULL stays NULL. ``cuts`` must be descending."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("need len(cuts) + 1 labels")
    x = _c(col)
    e = F.when(x.isNull(), F.lit(None))
    for cut, lab in zip(cuts, labels):
        e = e.when(x >= cut, F.lit(lab))
    return e.otherwise(F.lit(labels[-1]))


# B10
def classify_by_prefix(col: str | Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First matching prefix wins (feature provenance labels)."""
    x = _c(col)
    e = None
    for prefix, label in rules:
        cond = x.startswith(prefix)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return F.lit(default) if e is None else e.otherwise(F.lit(default))



# B11
def match_regex(col: str | Column, pattern: str) -> Column:
    return F.coalesce(_c(col).rlike(pattern), F.lit(False))


# B12
def round_cols(df: DataFrame, digits: int | Mapping[str, int], half_even: bool = False) -> DataFrame:
    """Round floating columns at the output edge (``half_even`` = NumPy rule)."""
    rnd = F.bround if half_even else F.round
    if isinstance(digits, Mapping):
        spec = dict(digits)
    else:
        spec = {f.name: digits for f in df.schema.fields
                if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    return df.withColumns({c: rnd(F.col(c), d) for c, d in spec.items()})


# B13
def to_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("boolean") for c in cols})


# B14
def set_to_string(col: str | Column, sep: str = ", ") -> Column:
    return F.array_join(F.array_sort(_c(col)), sep)


# B15
def strip_prefixes(col: str | Column, prefixes: Sequence[str]) -> Column:
    if not prefixes:
        return _c(col)
    alt = "|".join(p.replace("\\", "\\\\").replace(".", "\\.") for p in prefixes)
    return F.regexp_replace(_c(col), f"^({alt})", "")


def truncate(col: str | Column, n: int) -> Column:
    return F.substring(_c(col), 1, n)


def money_label(col: str | Column, currency: str, digits: int = 0) -> Column:
    return F.format_string(f"{currency} %.{digits}f", _c(col))


def pct_label(col: str | Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", _c(col))


def arrow_label(left: str | Column, right: str | Column, left_len: int | None = None,
                right_len: int | None = None) -> Column:
    a = truncate(left, left_len) if left_len else _c(left)
    b = truncate(right, right_len) if right_len else _c(right)
    return F.concat_ws(" → ", a, b)


# B16
def percent_of(num: str | Column, den: str | Column, digits: int | None = None) -> Column:
    """100 * num / den, NULL when the denominator is 0 or NULL."""
    v = F.lit(100.0) * _c(num) / F.nullif(_c(den), F.lit(0))
    return F.round(v, digits) if digits is not None else v
