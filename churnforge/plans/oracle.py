"""Independent SQL (DuckDB dialect) for the frames, used by the oracle queries.

Each oracle query is ``WITH <frame CTEs>, ... SELECT ...``; the frame CTEs restate the frame
definitions of plans/frames.py in plain SQL over the driver's tables.
"""

from __future__ import annotations

NUM_RE = "[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
SPECIAL_RE = "[+-]?([Ii][Nn][Ff]([Ii][Nn][Ii][Tt][Yy])?|[Nn][Aa][Nn])"


def num(x: str) -> str:
    """P4 in SQL: number text -> double, anything else null, NaN -> null."""
    t = f"trim({x})"
    v = f"TRY_CAST({t} AS DOUBLE)"
    return (f"(CASE WHEN (regexp_full_match({t}, '{NUM_RE}') OR regexp_full_match({t}, '{SPECIAL_RE}')) "
            f"AND NOT isnan({v}) THEN {v} END)")


ORDER_CTES = f"""
lines AS (
  SELECT l_orderkey, count(*) AS n_lines, avg(l_extendedprice) AS avg_line_price
  FROM lineitem GROUP BY l_orderkey
),
flag_counts AS (
  SELECT l_orderkey, l_returnflag, count(*) AS c FROM lineitem GROUP BY l_orderkey, l_returnflag
),
flag_mode AS (
  SELECT l_orderkey, l_returnflag AS flag_mode FROM (
    SELECT l_orderkey, l_returnflag,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_returnflag) AS rn
    FROM flag_counts) t WHERE rn = 1
),
raw_orders AS (
  SELECT o.o_orderkey AS id,
    CASE WHEN o.o_orderstatus = 'F' THEN 'Yes' WHEN o.o_orderstatus = 'O' THEN 'No' ELSE o.o_orderstatus END AS churn_text,
    CASE WHEN o.o_orderkey % 10 < 7 THEN 'train' ELSE 'score' END AS split,
    CAST(l.n_lines AS VARCHAR) AS tenure_txt,
    CASE WHEN o.o_orderkey % 41 = 0 THEN ' ' WHEN o.o_orderkey % 43 = 0 THEN 'abc'
         WHEN o.o_orderkey % 47 = 0 THEN 'nan' ELSE CAST(l.avg_line_price AS VARCHAR) END AS monthly_txt,
    CASE WHEN o.o_orderkey % 53 = 0 THEN '' WHEN o.o_orderkey % 59 = 0 THEN ' ' || CAST(o.o_totalprice AS VARCHAR) || ' '
         WHEN o.o_orderkey % 61 = 0 THEN CAST(o.o_totalprice AS VARCHAR) || 'd' ELSE CAST(o.o_totalprice AS VARCHAR) END AS total_txt,
    c.c_acctbal AS acctbal,
    CASE WHEN o.o_orderkey % 67 = 0 THEN NULL ELSE o.o_orderpriority END AS priority,
    c.c_mktsegment AS segment, n.n_name AS nation, fm.flag_mode AS flag
  FROM orders o
  LEFT JOIN lines l ON o.o_orderkey = l.l_orderkey
  LEFT JOIN flag_mode fm ON o.o_orderkey = fm.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
order_frame AS (
  SELECT id, CASE WHEN churn_text IN ('Yes', 'True', '1') THEN 1 ELSE 0 END AS label, split,
         coalesce({num('tenure_txt')}, 0.0) AS tenure,
         coalesce({num('monthly_txt')}, 0.0) AS monthly,
         coalesce({num('total_txt')}, 0.0) AS total,
         acctbal, priority, segment, nation, flag
  FROM raw_orders
),
score_tables AS (
  SELECT 'a' AS model, id, split, label, round(total / (total + 150000.0), 3) AS score FROM order_frame
  UNION ALL
  SELECT 'b', id, split, label, round(monthly / (monthly + 40000.0), 3) FROM order_frame
  UNION ALL
  SELECT 'c', id, split, label, round((acctbal + 1000.0) / 12000.0, 3) FROM order_frame
)"""


def with_orders(*ctes: str) -> str:
    """'WITH <order frame CTEs>, <extra CTEs>' prefix."""
    extra = "".join(f",\n{c}" for c in ctes)
    return f"WITH {ORDER_CTES}{extra}\n"


def folds_cte(k: int = 5, seed: int = 42, name: str = "folded", source: str = "order_frame",
              where: str = "split = 'train'") -> str:
    """W3 in SQL: rank inside each class in md5 order, deal out round-robin."""
    return f"""{name} AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || '|{seed}')) - 1) % {k} AS INTEGER) AS fold
  FROM {source} WHERE {where}
)"""
