"""Reading the admission table and the fixed source projection.

The analysed system runs one SELECT against a database view: 23 columns, four
categories turned into codes, weight and height out of range turned into NULL,
and (service variant) only inpatient admissions. ``extract`` is that SELECT as
a DataFrame projection; Catalyst pushes the filter and the column list into the
Parquet scan or into the JDBC query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens import config as C
from carelens.functions import clinical as X

SOURCE_SCHEMA = T.StructType([
    T.StructField("DOCUMENTO", T.StringType()),
    T.StructField("SEXO", T.StringType()),
    T.StructField("EDAD", T.IntegerType()),
    T.StructField("ASEGURADOR", T.StringType()),
    T.StructField("INGRESO_ACTUAL", T.LongType()),
    T.StructField("FECHA_INGRESO_ACTUAL", T.TimestampNTZType()),
    T.StructField("FECHA_EGRESO_DEL_INGRESO_ACTUAL", T.TimestampNTZType()),
    T.StructField("COD_DX_INGRESO", T.StringType()),
    T.StructField("NOM_DX_INGRESO", T.StringType()),
    T.StructField("COD_DX_EGRESO", T.StringType()),
    T.StructField("NOM_DX_EGRESO", T.StringType()),
    T.StructField("ESTADO_EGRESO", T.StringType()),
    T.StructField("ANTECEDENTES_PERSONALES", T.StringType()),
    T.StructField("ANTECEDENTES_FAMILIARES", T.StringType()),
    T.StructField("PESO", T.DoubleType()),
    T.StructField("TALLA", T.DoubleType()),
    T.StructField("PRESION_ARTERIAL", T.StringType()),
    T.StructField(C.HOSP, T.IntegerType()),
    T.StructField("TIEMPO_ULTIMA_HOSPITALIZACION", T.StringType()),
    T.StructField("DURACION_ESTANCIA_ACTUAL", T.IntegerType()),
    T.StructField("NUMERO_MEDICAMENTOS", T.IntegerType()),
    T.StructField("ADHERENCIA_PREVIA", T.StringType()),
    T.StructField("CAUSA_INGRESO", T.StringType()),
    T.StructField("TIPO_INGRESO", T.StringType()),
])

EXTRACT_COLUMNS = [f.name for f in SOURCE_SCHEMA.fields if f.name != "TIPO_INGRESO"]


def check_schema(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    missing = [c for c in (required or EXTRACT_COLUMNS) if c not in df.columns]
    if missing:
        raise ValueError(f"episode source lacks columns: {missing}")
    return df


def conform(df: DataFrame) -> DataFrame:
    """The source columns in the types of ``SOURCE_SCHEMA``: NaN becomes NULL, text
    dates and numbers are parsed (bad text -> NULL), other types must cast without loss of meaning."""
    have = dict(df.dtypes)
    out = {}
    for f in SOURCE_SCHEMA.fields:
        if f.name not in have:
            continue
        want, kind, c = f.dataType, have[f.name], F.col(f.name)
        number = isinstance(want, (T.IntegerType, T.LongType, T.DoubleType))
        if kind.startswith(("array", "map", "struct", "binary", "variant")):
            raise ValueError(f"episode source column {f.name} has type {kind}")
        if number:
            if kind == "string":
                c = X.parse_number(c)
            elif kind in ("double", "float"):
                c = X.nan_to_null(c)
            elif kind in ("date", "boolean") or kind.startswith("timestamp"):
                raise ValueError(f"episode source column {f.name} has type {kind}")
            out[f.name] = c.try_cast(want)
        elif isinstance(want, T.TimestampNTZType):
            if kind != "string" and kind != "date" and not kind.startswith("timestamp"):
                raise ValueError(f"episode source column {f.name} has type {kind}")
            # Real timestamps keep their type.
            out[f.name] = X.parse_timestamp(c, dtype=kind).cast(want) if kind in ("string", "date") else c
        else:
            out[f.name] = X.nan_to_null(c).cast("string") if kind in ("double", "float") else c.cast("string")
    return df.withColumns(out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return conform(check_schema(spark.read.parquet(path)))


def jdbc_options(url: str, table: str, partition_column: str, lower_bound: int | None, upper_bound: int | None,
                 num_partitions: int, properties: dict | None = None) -> dict[str, str]:
    """Options of a partitioned JDBC scan. Without both bounds Spark would read the
    whole table over one connection, so that has to be asked for by ``num_partitions=1``."""
    options = {"url": url, "dbtable": table, **{k: str(v) for k, v in (properties or {}).items()}}
    if num_partitions == 1:
        return options
    if lower_bound is None or upper_bound is None:
        raise ValueError("a JDBC scan needs lower_bound and upper_bound (or num_partitions=1 for a small table)")
    return options | {"partitionColumn": partition_column, "lowerBound": str(lower_bound), "upperBound": str(upper_bound),
                      "numPartitions": str(num_partitions)}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def source_query(table: str, columns: list[str] | None = None, only_inpatient: bool = False) -> str:
    """The part of the source that is read, as a query the database runs: named
    columns, and only inpatient admissions if asked for."""
    listed = ", ".join(_quoted(c) for c in columns or [f.name for f in SOURCE_SCHEMA.fields])
    where = f" WHERE {_quoted('TIPO_INGRESO')} = '{C.INPATIENT}'" if only_inpatient else ""
    return f"SELECT {listed} FROM {table}{where}"


def bounds_query(query: str, column: str, parts: int, by: str = "range") -> str:
    """The least value of each part: of ``parts`` equal ranges between the least and the
    greatest value (``range``: those two), or of parts of equal numbers of rows (``quantiles``)."""
    c = _quoted(column)
    if by == "range":
        return f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM ({query}) src"
    if by == "quantiles":
        return (f"SELECT MIN({c}) AS lo, MAX({c}) AS hi FROM (SELECT {c}, NTILE({parts}) OVER (ORDER BY {c}) AS part "
                f"FROM ({query}) src WHERE {c} IS NOT NULL) tiles GROUP BY part")
    raise ValueError(f"bounds are by range or by quantiles, not {by!r}")


def part_bounds(rows: list[tuple], parts: int, by: str = "range") -> list[int]:
    """Where parts begin, but for the first, from the rows of ``bounds_query``."""
    rows = [r for r in rows if r[0] is not None]
    if not rows:
        return []
    if by == "quantiles":
        return sorted({int(lo) for lo, _ in rows})[1:]
    lo, hi = int(rows[0][0]), int(rows[0][1])
    step = -(-(hi - lo + 1) // parts)
    return [b for b in range(lo + step, hi + 1, step)]


def part_predicates(column: str, bounds: list[int]) -> list[str]:
    """A predicate per part, that every row meets exactly one of: rows without a value
    have one, values below the first bound and from the last one on are in the end parts."""
    c = _quoted(column)
    if not bounds:
        return [f"{c} IS NULL", f"{c} IS NOT NULL"]
    middle = [f"{c} >= {a} AND {c} < {b}" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [f"{c} IS NULL", f"{c} < {bounds[0]}", *middle, f"{c} >= {bounds[-1]}"]


def read_jdbc(spark: SparkSession, url: str, table: str, *, partition_column: str = "INGRESO_ACTUAL",
              lower_bound: int | None = None, upper_bound: int | None = None,
              num_partitions: int = 64, properties: dict | None = None, columns: list[str] | None = None,
              only_inpatient: bool = False, bounds_by: str = "range") -> DataFrame:
    """Parallel JDBC scan of the episode view.

    Credentials come only from ``properties`` (user, password, driver); none are
    kept in code. The database runs the column list and the inpatient filter. Without
    given bounds they are read from the source (one row, or with ``bounds_by="quantiles"``
    one a part, which evens out gaps in the numbers), and the parts are
    predicates that are disjoint and complete, rows without a number included.
    Bounds only shape the parts, no row is dropped.
    """
    properties = properties or {}
    query = source_query(table, columns, only_inpatient)
    if num_partitions == 1 or lower_bound is not None or upper_bound is not None:
        options = jdbc_options(url, f"({query}) src", partition_column, lower_bound, upper_bound, num_partitions, properties)
        found = spark.read.format("jdbc").options(**options).load()
    else:
        asked = jdbc_options(url, f"({bounds_query(query, partition_column, num_partitions, bounds_by)}) bounds", partition_column, None, None, 1, properties)
        rows = [tuple(r) for r in spark.read.format("jdbc").options(**asked).load().collect()]      # at most a row a part
        predicates = part_predicates(partition_column, part_bounds(rows, num_partitions, bounds_by))
        found = spark.read.jdbc(url, f"({query}) src", predicates=predicates, properties={k: str(v) for k, v in properties.items()})
    return conform(check_schema(found, columns))


def inpatient_filter(df: DataFrame) -> DataFrame:
    return df.filter(F.col("TIPO_INGRESO") == C.INPATIENT)


def extract(df: DataFrame, only_inpatient: bool = False, collation: str | None = None) -> DataFrame:
    """The fixed 23-column source projection with coded categories and range guards.
    ``collation``: how category texts compare (default: exactly)."""
    df = conform(check_schema(df))
    if only_inpatient:
        df = inpatient_filter(df)
    return df.select(
        "DOCUMENTO",
        X.encode("SEXO", C.SEX_CODES, collation).alias("SEXO"),
        "EDAD", "ASEGURADOR", "INGRESO_ACTUAL",
        "FECHA_INGRESO_ACTUAL", "FECHA_EGRESO_DEL_INGRESO_ACTUAL",
        "COD_DX_INGRESO", "NOM_DX_INGRESO", "COD_DX_EGRESO", "NOM_DX_EGRESO",
        X.encode("ESTADO_EGRESO", C.DISCHARGE_STATE_CODES, collation).alias("ESTADO_EGRESO"),
        "ANTECEDENTES_PERSONALES", "ANTECEDENTES_FAMILIARES",
        X.range_guard("PESO", *C.WEIGHT_RANGE).alias("PESO"),
        X.range_guard("TALLA", *C.HEIGHT_RANGE).alias("TALLA"),
        "PRESION_ARTERIAL", C.HOSP, "TIEMPO_ULTIMA_HOSPITALIZACION",
        "DURACION_ESTANCIA_ACTUAL", "NUMERO_MEDICAMENTOS",
        X.encode("ADHERENCIA_PREVIA", C.ADHERENCE_CODES, collation).alias("ADHERENCIA_PREVIA"),
        X.encode("CAUSA_INGRESO", C.CAUSE_CODES, collation).alias("CAUSA_INGRESO"),
    )


def resolve_column(df: DataFrame, candidates: list[str]) -> str | None:
    """First candidate name that exists in ``df`` (None if none does)."""
    return next((c for c in candidates if c in df.columns), None)


def resolve_report_columns(df: DataFrame) -> dict[str, str | None]:
    """The patient report's columns by their known names; an error without its critical ones."""
    return resolve_columns(df, C.COLUMN_CANDIDATES, C.REQUIRED_REPORT_COLUMNS)


def resolve_columns(df: DataFrame, roles: dict[str, list[str]], required: list[str] = ()) -> dict[str, str | None]:
    found = {role: resolve_column(df, cands) for role, cands in roles.items()}
    missing = [r for r in required if found.get(r) is None]
    if missing:
        raise ValueError(f"missing critical columns: {missing}; detected {found}")
    return found
