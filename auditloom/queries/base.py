"""How a query and its SQL are registered, and the common table expressions that the SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KINDS = {"l": ("long", "CAST({0} AS BIGINT)"), "d": ("double", "round(CAST({0} AS DOUBLE), 6) + 0.0"), "s": ("string", "CAST({0} AS VARCHAR)"), "b": ("boolean", "CAST({0} AS BOOLEAN)")}


def query(name: str, columns: str, sql: str | None = None):
    """Registers a query whose result has ``columns`` (``name:kind``, kinds l, d, s, b), on both sides
    cast alike and with numbers rounded to six places."""
    spec = [c.split(":") for c in columns.split()]

    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0) if k == "d" else F.col(c).cast(KINDS[k][0])).alias(c) for c, k in spec])

        QUERIES[name] = run
        if sql is not None:
            head, _, body = sql.partition("::")
            ORACLE_SQL[name] = f"{('WITH ' + head) if body else ''} SELECT {', '.join(KINDS[k][1].format(c) + ' AS ' + c for c, k in spec)} FROM ({body or head}) AS result"
        return f

    return add


def key(seed: int, tag: str, *columns: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{tag}', {', '.join(f'CAST({c} AS VARCHAR)' for c in columns)}))"


def uniform(seed: int, tag: str, *columns: str, at: int = 1) -> str:
    return f"(CAST('0x' || substr({key(seed, tag, *columns)}, {at}, 8) AS BIGINT) / 4294967296e0)"


def with_(*parts: str) -> str:
    """Common table expressions before the body that follows ``::``."""
    return ", ".join(parts) + " :: "


OBS = """obs AS (SELECT CAST(l_suppkey AS BIGINT) AS dataset_id,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row_id,
  l_quantity AS x0, l_extendedprice AS x1, l_discount AS x2, l_tax AS x3,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_extendedprice AS t FROM lineitem)"""


def leaning(name: str, source: str, lean: str, tag: str, *more: str) -> str:
    cols = ", ".join(["dataset_id", "row_id", "y", *more])
    raw = ", ".join(f"{uniform(c, tag, 'dataset_id', 'row_id', *more)} + CASE WHEN y = {c} THEN {lean} ELSE 0e0 END AS r{c}" for c in range(3))
    return f"""{name}_raw AS (SELECT {cols}, {raw} FROM {source}),
  {name} AS (SELECT {cols}, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2,
  CASE WHEN r0 >= r1 AND r0 >= r2 THEN 0 WHEN r1 >= r2 THEN 1 ELSE 2 END AS pred FROM {name}_raw)"""


PRED = leaning("pred", "obs", "0.6e0", "p")
MANY = "many AS (SELECT dataset_id, row_id, y, v.variant FROM obs, (SELECT unnest([0, 1, 2, 3, 4]) AS variant) AS v)"
VARIANTS = leaning("var", "many", "(0.6e0 - variant * 0.1e0)", "v", "variant")
REG = f"reg AS (SELECT dataset_id, row_id, t AS y, t * (0.8e0 + 0.4e0 * {uniform(7, 'reg', 'dataset_id', 'row_id')}) AS pred FROM obs)"
ROLES = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {key(42, 'role', 'dataset_id', 'row_id')}, row_id) AS rr, count(*) OVER (PARTITION BY dataset_id) AS rn FROM obs),
  roles AS (SELECT dataset_id, row_id, x0, x1, x2, x3, y, t, CASE WHEN rr <= ceil(rn * 0.3e0) THEN 'query' ELSE 'context' END AS role FROM ranked)"""
EPS = "1e-10"


def own(prefix: str = "p") -> str:
    return f"CASE y WHEN 0 THEN {prefix}0 WHEN 1 THEN {prefix}1 ELSE {prefix}2 END"


def entropy(prefix: str = "p") -> str:
    return "-(" + " + ".join(f"{prefix}{c} * ln({prefix}{c} + {EPS})" for c in range(3)) + ")"


MARGIN = "greatest(p0, p1, p2) - (p0 + p1 + p2 - greatest(p0, p1, p2) - least(p0, p1, p2))"
