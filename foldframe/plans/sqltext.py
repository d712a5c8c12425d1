"""DuckDB text for the fixtures and hash helpers used by the oracle queries.

These strings mirror ``foldframe.sources.fixtures`` and
``foldframe.functions.hashing`` expression for expression.  Doubles are
written as ``x::double`` because a bare ``1.0`` is DECIMAL in DuckDB.
"""

from __future__ import annotations


def d(x: float) -> str:
    return f"{float(x)!r}::double"


def md5_of(*parts: str) -> str:
    """md5 of parts joined by '|'; each part is a SQL expression."""
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def word(h: str, i: int) -> str:
    return f"(('0x' || substr({h}, {8 * i + 1}, 8))::BIGINT)::DOUBLE"


def unif(h: str, i: int) -> str:
    return f"(({word(h, i)} + 1.0::double) / 4294967297.0::double)"


def z(*parts: str) -> str:
    h = md5_of(*parts)
    return f"(sqrt(-2.0::double * ln({unif(h, 0)})) * cos(2.0::double * pi() * {unif(h, 1)}))"


def noise(sigma: float, *parts: str) -> str:
    if not sigma:
        return "0.0::double"
    return f"({d(sigma)} * {z(*parts)})"


def smoothed(s: str, n: str, g: str, lam: float) -> str:
    return (f"(CASE WHEN {n} > 0 THEN (CAST({s} AS DOUBLE) + {d(lam)} * {g}) "
            f"/ (CAST({n} AS DOUBLE) + {d(lam)}) ELSE {g} END)")


SPLIT = ("CASE WHEN ('0x' || substr(md5('split|' || CAST(o_orderkey AS VARCHAR)), 1, 2))::INTEGER < 128 "
         "THEN 'train' WHEN ('0x' || substr(md5('split|' || CAST(o_orderkey AS VARCHAR)), 1, 2))::INTEGER < 192 "
         "THEN 'test' ELSE 'original' END")

FCLS = f"""fcls AS (
  SELECT o_orderkey AS id, o_orderpriority, c_mktsegment, c_nationkey, o_totalprice, c_acctbal,
         o_orderstatus AS status, CAST(o_orderstatus = 'F' AS INTEGER) AS y, {SPLIT} AS part
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

FSIG = FCLS + f""",
fsig0 AS (
  SELECT *, round(0.8::double * o_totalprice / 100000.0::double
                  + CAST(CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS DOUBLE)
                  - 0.0001::double * c_acctbal + {z("'sig'", "id")}, 9) AS s
  FROM fcls),
fsig AS (SELECT *, CAST(s > 2.0::double AS INTEGER) AS y_sig FROM fsig0)"""


def strat_fold(id_col: str, label: str | None, k: int, seed: int, partition: str = "") -> str:
    order = ", ".join(x for x in (label, md5_of(id_col, f"'{seed}'"), id_col) if x)
    part = f"PARTITION BY {partition} " if partition else ""
    return f"CAST((row_number() OVER ({part}ORDER BY {order}) - 1) % {k} AS INTEGER)"


def pred_cols(tag1: str, tag2: str) -> str:
    p1 = f"(0.4::double + 0.2::double * y + 0.15::double * {z(tag1, 'id')})"
    p2 = f"(0.4::double + 0.1::double * y + 0.2::double * {z(tag2, 'id')})"
    return f"{p1} AS p1, {p2} AS p2, round({p1}, 1) AS p3"


FPRED = FSIG + f""",
fpred_base AS (
  SELECT id, y_sig AS y, {strat_fold('id', 'y_sig', 5, 42)} AS fold FROM fsig WHERE part = 'train'),
fpred AS (SELECT id, fold, y, {pred_cols("'p1'", "'p2'")} FROM fpred_base),
fpred_test_base AS (
  SELECT id, y_sig AS y, f.fold FROM fsig, range(5) f(fold) WHERE part = 'test'),
fpred_test AS (
  SELECT id, CAST(fold AS INTEGER) AS fold,
         {pred_cols("'p1|' || CAST(fold AS VARCHAR)", "'p2|' || CAST(fold AS VARCHAR)")}
  FROM fpred_test_base)"""

FREG = """freg AS (SELECT p_partkey AS id, p_brand, p_type, p_size, p_retailprice FROM part)"""
FEVT = """fevt AS (SELECT event_id AS id, value, event_type, user_id FROM events)"""
FDOC = """fdoc AS (SELECT l.doc_id AS id, quality, toxic, lang, source, n_chars
         FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def auc_sql(src: str, score: str, label: str = "y", by: str = "", out: str = "auc") -> str:
    """Exact AUC (ties half) over a relation; same arithmetic as ``roc_auc``."""
    sel_by = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""(WITH g AS (
      SELECT {sel_by}{score} AS sc, sum(CAST({label} AS BIGINT)) AS p, sum(1 - CAST({label} AS BIGINT)) AS q
      FROM {src} WHERE {label} IS NOT NULL AND {score} IS NOT NULL GROUP BY {sel_by}{score}),
    c AS (SELECT *, coalesce(sum(q) OVER ({part}ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS qb
          FROM g)
    SELECT {sel_by}CAST(sum(p * (2 * qb + q)) AS DOUBLE)
           / (2.0::double * CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) AS {out}
    FROM c {grp})"""
