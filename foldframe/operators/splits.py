"""Split search (T6, T7) over a histogram table, as DataFrame operations: only the splits reach the driver.

A histogram has a row per ``(model, node, feat, bin)`` with sums ``G``, ``H`` and row count ``C``.  Inside each
``(model, node, feat)`` running sums in bin order (categories in order of ``G / (H + lambda)``) give both sides of every
cut; the best cut is the row of greatest gain (to 8 decimals, beyond which sums depend on the layout), ties by smaller
feature, then smaller place.  A histogram
partitioned by ``(model, node, feat)`` needs one further exchange, of one row per feature and node, and per 32,768 categories
with a bit for each of them: no list of a column's categories is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .forest import Binning

SPLIT_COLS = ["model", "node", "G", "H", "C", "feat", "bin", "gain", "GL", "HL", "CL", "GR", "HR", "CR", "miss_left", "left"]


def dlit(x: float) -> str:
    """A DOUBLE literal in Spark SQL text (bare decimals would be DECIMAL)."""
    x = float(x)
    if x != x:
        return "CAST('NaN' AS DOUBLE)"
    if x in (float("inf"), float("-inf")):
        return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)"
    return f"({x!r}D)"


def _score(g: str, h: str, p) -> str:
    t = f"greatest(abs({g}) - {dlit(p.reg_alpha)}, 0.0D)"
    return f"coalesce({t} * {t} / nullif({h} + {dlit(p.reg_lambda)}, 0.0D), 0.0D)"


def _sides(binning: Binning, p, common_order: bool) -> str:
    """SQL of running sums on the left of every cut, totals, sums of the missing bin, place in the order."""
    cats = ", ".join(str(c).lower() for c in binning.categorical)
    miss = ", ".join(str(binning.missing_bin(i)) for i in range(len(binning.features)))
    # one order of categories for all nodes of a level, or one for each node
    rg, rh = (f"sum({c}) OVER (PARTITION BY model, feat, bin)" if common_order else c for c in "GH")
    sums = ", ".join(f"sum({c}) OVER upto AS {c}L, sum({c}) OVER grp AS {c}T, sum(CASE WHEN lost THEN {c} END) OVER grp AS {c}M" for c in "GHC")
    return f"""
SELECT model, node, feat, bin, cat, lost, key, row_number() OVER (PARTITION BY model, node, feat ORDER BY key, bin) AS pos, {sums}
FROM (SELECT *, CASE WHEN cat THEN CASE WHEN lost THEN {dlit(float('inf'))} ELSE coalesce(RG / nullif(RH + {dlit(p.reg_lambda)}, 0.0D), 0.0D) END
                ELSE CAST(bin AS DOUBLE) END AS key
      FROM (SELECT *, {rg} AS RG, {rh} AS RH, CASE WHEN feat < 0 THEN false ELSE element_at(array({cats}), feat + 1) END AS cat,
                   CASE WHEN feat < 0 THEN -1 ELSE element_at(array({miss}), feat + 1) END = bin AS lost FROM {{hist}}))
WINDOW grp AS (PARTITION BY model, node, feat),
       upto AS (PARTITION BY model, node, feat ORDER BY key, bin ROWS UNBOUNDED PRECEDING)"""


def best_splits(hist: DataFrame, binning: Binning, p) -> DataFrame:
    """The best split of every ``(model, node)``: one row each with the node's sums; ``feat`` is null where no cut has
    positive gain and children of at least ``min_child_weight`` and ``min_child_samples``.

    ``left`` holds the category codes of the left side as pieces of bits and the byte each begins at (``Codes.of_parts``);
    ``miss_left`` sends missing values of a numeric feature left, where that gains more (right if equal).
    """
    gain = lambda g, h: (f"0.5D * ({_score(g, h, p)} + {_score(f'(GT - ({g}))', f'(HT - ({h}))', p)} - {_score('GT', 'HT', p)})"  # noqa: E731
                         f" - {dlit(p.gamma)}")
    least_h, least_c = dlit(p.min_child_weight), max(1, int(p.min_child_samples))
    fits = lambda h, c: (f"({h} >= {least_h} AND HT - ({h}) >= {least_h} AND {c} >= {least_c} AND CT - ({c}) >= {least_c})")
    return hist.sparkSession.sql(f"""
SELECT model, node, t.GT AS G, t.HT AS H, t.CT AS C, -w.nfeat AS feat, -w.nbin AS bin, coalesce(w.gain, 0.0D) AS gain,
       w.GL, w.HL, w.CL, t.GT - w.GL AS GR, t.HT - w.HL AS HR, t.CT - w.CL AS CR,
       coalesce(w.miss_left, false) AS miss_left,
       transform(filter(codes, x -> x.feat = -w.nfeat), x -> named_struct('at', x.at, 'bits', x.bits)) AS left
FROM (SELECT model, node, max(b) AS w, min(named_struct('feat', feat, 'GT', GT, 'HT', HT, 'CT', CT)) AS t,
             collect_list(CASE WHEN last IS NOT NULL THEN named_struct(
                 'feat', feat, 'at', 4096L * part, 'bits', substring(bits, 1, CAST(last % 32768 div 8 + 1 AS INT))) END) AS codes
      FROM (SELECT model, node, feat, part, any_value(GT) AS GT, any_value(HT) AS HT, any_value(CT) AS CT, max(b) AS b,
                   max(bin) FILTER (WHERE goes) AS last, bitmap_construct_agg(bitmap_bit_position(bin + 1L)) FILTER (WHERE goes) AS bits
            FROM (SELECT *, cat AND pos <= b.pos AS goes, CASE WHEN cat THEN bin div 32768 ELSE 0L END AS part
                  FROM (SELECT *, max(CASE WHEN (ml OR fits0) AND NOT lost AND gain > 0.0D THEN named_struct(
                                   'rank', round(gain, 8), 'nfeat', -feat, 'nkey', -key, 'nbin', -bin, 'pos', pos, 'miss_left', ml, 'gain', gain,
                                   'GL', GL + IF(ml, GM, 0.0D), 'HL', HL + IF(ml, HM, 0.0D), 'CL', CL + IF(ml, CM, 0L)) END)
                                 OVER (PARTITION BY model, node, feat) AS b
                        FROM (SELECT *, CASE WHEN ml THEN gain1 ELSE gain0 END AS gain
                              FROM (SELECT *, coalesce(fits1 AND (NOT fits0 OR gain1 > gain0 + 1e-12D), false) AS ml
                                    FROM (SELECT *, {gain('GL', 'HL')} AS gain0, {gain('GL + GM', 'HL + HM')} AS gain1, {fits('HL', 'CL')} AS fits0,
                                                 NOT cat AND NOT lost AND CM > 0 AND {fits('(HL + HM)', '(CL + CM)')} AS fits1
                                          FROM ({_sides(binning, p, False)}))))))
            GROUP BY model, node, feat, part)
      GROUP BY model, node)""", hist=hist)


def best_level_splits(hist: DataFrame, binning: Binning, p) -> DataFrame:
    """One split for all nodes of a model's level (symmetric trees): the cut of greatest summed gain, categories ordered
    by their ratio over all nodes.  A row per node with the shared split and the node's own sides; ``hist`` must hold every
    bin of every node, empty ones with zeros.  ``gain`` is the level's; a level without positive gain (1e-12, what rounding may
    leave of none) has null ``feat``.
    """
    part = lambda g, h: f"{_score(g, h, p)} + {_score(f'(GT - ({g}))', f'(HT - ({h}))', p)} - {_score('GT', 'HT', p)}"
    sides = hist.sparkSession.sql(_sides(binning, p, True), hist=hist)
    return hist.sparkSession.sql(f"""
WITH level AS (
  SELECT model, max(named_struct('rank', round(gain, 8), 'nfeat', -feat, 'nkey', -key, 'nbin', -bin, 'pos', pos, 'ml', ml, 'gain', gain)) AS w
  FROM (SELECT *, 0.5D * CASE WHEN ml THEN part1 ELSE part0 END - {dlit(p.gamma)} AS gain
        FROM (SELECT *, coalesce(NOT cat AND CM > 0 AND part1 > part0 + 1e-12D, false) AS ml
              FROM (SELECT model, feat, bin, key, cat, sum({part('GL', 'HL')}) AS part0, sum(CM) AS CM, max(pos) AS pos,
                           sum(CASE WHEN NOT cat THEN {part('(GL + GM)', '(HL + HM)')} END) AS part1
                    FROM {{sides}} WHERE feat >= 0 AND NOT lost GROUP BY model, feat, bin, key, cat)))
  WHERE gain > 1e-12D GROUP BY model)
SELECT model, node, t.GT AS G, t.HT AS H, t.CT AS C, -w.nfeat AS feat, -w.nbin AS bin, coalesce(w.gain, 0.0D) AS gain, s.GL, s.HL, s.CL,
       t.GT - s.GL AS GR, t.HT - s.HL AS HR, t.CT - s.CL AS CR, coalesce(w.ml, false) AS miss_left, left
FROM (SELECT /*+ BROADCAST(level) */ d.model, node, max(w) AS w, min(named_struct('feat', feat, 'GT', GT, 'HT', HT, 'CT', CT)) AS t,
             max(CASE WHEN feat = -w.nfeat AND bin = -w.nbin THEN named_struct(
                 'GL', GL + IF(w.ml, GM, 0.0D), 'HL', HL + IF(w.ml, HM, 0.0D), 'CL', CL + IF(w.ml, CM, 0L)) END) AS s,
             array_sort(collect_list(CASE WHEN cat AND feat = -w.nfeat AND pos <= w.pos THEN bin END)) AS left
      FROM {{sides}} d LEFT JOIN level ON d.model = level.model GROUP BY d.model, node)""", sides=sides)
