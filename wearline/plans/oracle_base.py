"""SQL text of the fixture views, for the independent DuckDB oracle.

The rule is the one of ``wearline.sources.fixtures``, written a second time in SQL.
"""

from __future__ import annotations

# Fixed values of the fixture rule, stated a second time.
DATASET_BY_RETURNFLAG = {"A": "FD001", "R": "FD002"}
RUL_DATASET_BY_STATUS = {"O": "FD001", "F": "FD002", "P": "FD003"}
CUT_MODULUS = 97
BAD_MODULUS = 89


def _sensor_sql(i: int) -> str:
    sign = "-" if i % 2 == 1 else "+"
    return (f"CAST({100 * i} AS DOUBLE) + q * {i % 5 + 1} / 8 + p / {1024 * (1 + i % 3)} "
            f"{sign} CAST(time_cycles AS DOUBLE) / {16 * (1 + i % 4)} AS sensor_{i}")


_FLAG_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DATASET_BY_RETURNFLAG.items())
_STATUS_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUL_DATASET_BY_STATUS.items())
_SENSORS = ",\n       ".join(["CAST(518.5 AS DOUBLE) AS sensor_1"]
                             + [_sensor_sql(i) for i in range(2, 22)])

READINGS_SQL = f"""
WITH b AS (
  SELECT CAST(l_suppkey AS INT) AS unit_number,
         CAST(row_number() OVER (
           PARTITION BY l_returnflag, l_linestatus, l_suppkey
           ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS INT) AS time_cycles,
         l_discount * 100 + 0.0 AS op_setting_1,
         l_tax * 10 + 0.0 AS op_setting_2,
         CAST(l_linenumber AS DOUBLE) AS op_setting_3,
         l_quantity AS q, l_extendedprice AS p,
         CASE l_returnflag {_FLAG_CASE} ELSE 'FD003' END AS dataset_id,
         CASE l_linestatus WHEN 'F' THEN 'train' ELSE 'test' END AS dataset_type
  FROM lineitem)
SELECT unit_number, time_cycles, op_setting_1, op_setting_2, op_setting_3,
       {_SENSORS},
       dataset_id, dataset_type
FROM b
"""

RUL_SQL = f"""
SELECT CAST(floor(o_totalprice / 2500) AS DOUBLE) AS rul,
       CASE o_orderstatus {_STATUS_CASE} END AS dataset_id,
       'rul' AS dataset_type
FROM orders
"""

# Fault flags of the rendered text lines (see fixtures.raw_lines).
CUT_SQL = f"((unit_number * 7 + time_cycles) % {CUT_MODULUS} = 0)"
BAD_SQL = f"(NOT {CUT_SQL} AND (unit_number * 7 + time_cycles) % {BAD_MODULUS} = 0)"

CTES = f"""readings AS ({READINGS_SQL}),
cmapss_train AS (SELECT * FROM readings WHERE dataset_type = 'train'),
cmapss_test AS (SELECT * FROM readings WHERE dataset_type = 'test'),
rul AS ({RUL_SQL})"""


def with_fixtures(sql: str, extra_ctes: str | None = None) -> str:
    """Prefix a query over readings / cmapss_train / cmapss_test / rul with their CTEs."""
    ctes = CTES + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{sql}"
