"""DuckDB text of a whole boosted fit: bins, trees, margins, validation losses, best iteration.

The trainer's rules written out level by level, one common table expression each, so that the boosting
queries can be compared value by value.  ``bins`` columns b0.. hold no missing values here.
"""

from __future__ import annotations

import re

from ..operators.boost import BoostParams, tree_features
from .sqltext import d


def cuts_sql(name: str, src: str, col: str, b: int) -> str:
    """Exact rank-defined cut points: b * (rows up to v) / n passes a whole number below b."""
    return f"""{name} AS MATERIALIZED (
  SELECT v FROM (SELECT v, sum(n) OVER (ORDER BY v) AS r, n, sum(n) OVER () AS total
                 FROM (SELECT {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col}) GROUP BY 1))
  WHERE least((r * {b}) // total, {b} - 1) > ((r - n) * {b}) // total)"""


def _soft(g: str, p: BoostParams) -> str:
    return f"(sign({g}) * greatest(abs({g}) - {d(p.reg_alpha)}, {d(0)}))"


def _bag_sql(seed: int, tree, model: str, key: str) -> str:
    return (f"CAST(('0x' || substr(md5('bag|{seed}|{tree}|' || CAST({model} AS VARCHAR) || '|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT "
            f"AS DOUBLE) / 4294967296.0::double")


def _chosen(t: int, p: BoostParams) -> list[str]:
    """``h{t}``: the splits that best-first growth takes under the leaf limit."""
    ctes = [f"p{t} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT model, node, gain FROM s{t}_{lv}' for lv in range(p.max_depth))})",
            f"h{t}_1 AS MATERIALIZED (SELECT model, node FROM p{t} WHERE node = 1)"]
    for n in range(2, p.max_leaves):
        ctes.append(f"""h{t}_{n} AS MATERIALIZED (SELECT * FROM h{t}_{n - 1} UNION ALL SELECT model, node FROM (
  SELECT q.*, row_number() OVER (PARTITION BY q.model ORDER BY round(gain, 8) DESC, q.node) AS rn FROM p{t} q
  JOIN h{t}_{n - 1} u ON u.model = q.model AND u.node = q.node // 2
  WHERE NOT EXISTS (SELECT 1 FROM h{t}_{n - 1} x WHERE x.model = q.model AND x.node = q.node)) WHERE rn = 1)""")
    return ctes


def prefixed(ctes: list[str], prefix: str) -> list[str]:
    """The same fit under names of its own, for several fits in one statement."""
    name = re.compile(r"\b((?:cut|z|h|m|l|p)\d+|[nceskh]\d+_\d+|binned|losses|runmin|stops|best)\b")
    return [name.sub(prefix + r"\1", c) for c in ctes]


def boost_ctes(rows: str, numeric: list[str], categorical: list[str], p: BoostParams, k: int, train: str = "TRUE",
               refit: bool = False, owned: bool = False) -> list[str]:
    """CTEs from ``rows`` (id, fold, y, features) to ``z0 .. zn`` (model, id, tr, st, va, y, z, bins) and ``best``
    (model, best_iter, trees_grown, best_valid_loss); model m learns from ``fold <> m`` of the rows that ``train`` names.
    ``refit``: model k learns from all of these.  ``owned``: each row belongs to one model: ``rows`` has model, tr, va instead of fold."""
    feats = [*numeric, *categorical]
    fit = f"(SELECT * FROM {rows} WHERE {'tr' if owned else train})"
    ctes = [cuts_sql(f"cut{i}", fit, f"CAST({c} AS DOUBLE)", p.max_bins) for i, c in enumerate(numeric)]
    bins = [f"(SELECT count(*) FROM cut{i} WHERE v <= r.{c}) AS b{i}" for i, c in enumerate(numeric)]
    bins += [f"r.{c} AS b{len(numeric) + i}" for i, c in enumerate(categorical)]
    ctes.append(f"binned AS MATERIALIZED (SELECT id, {'model, tr, va' if owned else 'fold'}, CAST(y AS DOUBLE) AS y, {', '.join(bins)} FROM {rows} r)")
    hold = "FALSE"
    if p.validation_fraction:
        hold = f"{_bag_sql(p.seed, 'hold', 'm', 'id')} < {d(p.validation_fraction)}"
    mean = "avg(CASE WHEN tr THEN y END) OVER (PARTITION BY model)"
    base = mean if p.objective == "squared" else f"ln({mean} / (1 - {mean}))"
    # tr: learns, st: judged for early stopping, va: the fold left out
    flags = (f"CAST(m AS INTEGER) AS model, *, fold <> m AND {train} AND NOT ({hold}) AS tr, "
             f"{f'fold <> m AND {train} AND ({hold})' if p.validation_fraction else 'fold = m'} AS st, fold = m AS va "
             f"FROM binned, range({k + refit}) t(m)") if not owned else "*, va AS st FROM binned"
    ctes.append(f"""z0 AS MATERIALIZED (SELECT model, id, tr, st, va, y, {base} AS z, {', '.join(f'b{i}' for i in range(len(feats)))}
  FROM (SELECT {flags}))""")
    if p.objective == "squared":
        g, h, loss = "z - y", d(1), "(z - y) * (z - y)"
    else:
        pr = "(1.0::double / (1.0::double + exp(-z)))"
        g, h, loss = f"{pr} - y", f"{pr} * (1.0::double - {pr})", "greatest(z, 0) + ln(1.0::double + exp(-abs(z))) - y * z"
    lam = d(p.reg_lambda)
    score = lambda G, H: f"{_soft(G, p)} * {_soft(G, p)} / ({H} + {lam})"
    for t in range(p.n_trees):
        bag = f"{_bag_sql(p.seed, t, 'model', 'id')} < {d(p.subsample)}" if p.subsample < 1.0 else "TRUE"
        ctes.append(f"n{t}_0 AS MATERIALIZED (SELECT *, {g} AS g, {h} AS h, tr AND {bag} AS inb, 1 AS node, TRUE AS open FROM z{t})")
        allowed = " OR ".join(f"(model = {m} AND feat IN ({', '.join(map(str, tree_features(p, len(feats), t, m)))}))" for m in range(k + refit))
        for lv in range(p.max_depth):
            src = f"n{t}_{lv}"
            cells = " UNION ALL ".join(f"SELECT model, node, {i} AS feat, b{i} AS bin, g, h FROM {src} WHERE inb AND open" for i in range(len(feats)))
            cats = ", ".join(str(len(numeric) + i) for i in range(len(categorical))) or "-1"
            key = f"CASE WHEN feat IN ({cats}) THEN G / (H + {lam}) ELSE CAST(bin AS DOUBLE) END"
            sums = f"""SELECT model, node, feat, bin, sum(g) AS G, sum(h) AS H, count(*) AS C FROM ({cells}) WHERE {allowed} GROUP BY ALL"""
            if p.symmetric:     # every bin of the level in every node, one order for all
                ctes.append(f"""e{t}_{lv} AS MATERIALIZED ({sums})""")
                ctes.append(f"""k{t}_{lv} AS MATERIALIZED (SELECT model, feat, bin, {key} AS key
  FROM (SELECT model, feat, bin, sum(G) AS G, sum(H) AS H FROM e{t}_{lv} GROUP BY ALL))""")
                keyed = f"""SELECT n.model, n.node, k.feat, k.bin, k.key, coalesce(G, 0) AS G, coalesce(H, 0) AS H, coalesce(C, 0) AS C
        FROM (SELECT DISTINCT model, node FROM e{t}_{lv}) n JOIN k{t}_{lv} k ON n.model = k.model
        LEFT JOIN e{t}_{lv} e ON e.model = n.model AND e.node = n.node AND e.feat = k.feat AND e.bin = k.bin"""
            else:
                keyed = f"SELECT *, {key} AS key FROM ({sums})"
            ctes.append(f"""c{t}_{lv} AS MATERIALIZED (
  SELECT *, sum(G) OVER w AS GL, sum(H) OVER w AS HL, sum(C) OVER w AS CL, row_number() OVER w AS pos,
         sum(G) OVER f AS GT, sum(H) OVER f AS HT, sum(C) OVER f AS CT
  FROM ({keyed})
  WINDOW w AS (PARTITION BY model, node, feat ORDER BY key, bin), f AS (PARTITION BY model, node, feat))""")
            gain = f"{score('GL', 'HL')} + {score('(GT - GL)', '(HT - HL)')} - {score('GT', 'HT')}"
            if p.symmetric:
                ctes.append(f"""s{t}_{lv} AS MATERIALIZED (
  SELECT n.model, n.node, feat, bin, pos, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(gain, 8) DESC, feat, key, bin) AS rn FROM (
      SELECT model, feat, bin, key, max(pos) AS pos, 0.5::double * sum({gain}) - {d(p.gamma)} AS gain FROM c{t}_{lv} GROUP BY ALL)
    WHERE gain > 1e-12) b JOIN (SELECT DISTINCT model, node FROM c{t}_{lv}) n ON n.model = b.model WHERE rn = 1)""")
            else:
                ctes.append(f"""s{t}_{lv} AS MATERIALIZED (
  SELECT model, node, feat, bin, pos, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY model, node ORDER BY round(gain, 8) DESC, feat, key, bin) AS rn FROM (
      SELECT *, 0.5::double * ({gain}) - {d(p.gamma)} AS gain
      FROM c{t}_{lv})
    WHERE gain > 0 AND HL >= {d(p.min_child_weight)} AND HT - HL >= {d(p.min_child_weight)}
      AND CL >= {p.min_child_samples} AND CT - CL >= {p.min_child_samples}) WHERE rn = 1)""")
            at = "CASE s.feat " + " ".join(f"WHEN {i} THEN r.b{i}" for i in range(len(feats))) + " END"
            left = f"CASE WHEN s.feat IN ({cats}) THEN coalesce(c.pos <= s.pos, FALSE) ELSE {at} <= s.bin END"
            ctes.append(f"""n{t}_{lv + 1} AS MATERIALIZED (
  SELECT r.* EXCLUDE (node, open), CASE WHEN r.open AND s.feat IS NOT NULL THEN 2 * r.node + CASE WHEN {left} THEN 0 ELSE 1 END
         ELSE r.node END AS node, r.open AND s.feat IS NOT NULL AS open
  FROM {src} r LEFT JOIN s{t}_{lv} s ON r.model = s.model AND r.node = s.node
  LEFT JOIN c{t}_{lv} c ON c.model = s.model AND c.node = s.node AND c.feat = s.feat AND c.bin = {at})""")
        last = f"n{t}_{p.max_depth}"
        if p.max_leaves:        # up to the first node on a row's path that was not split
            ctes += _chosen(t, p)
            ctes.append(f"""m{t} AS MATERIALIZED (SELECT r.* EXCLUDE (node), f.final AS node FROM {last} r JOIN (
  SELECT q.model, q.node, min(q.node >> k) AS final FROM (SELECT DISTINCT model, node FROM {last}) q, range({p.max_depth + 1}) x(k)
  WHERE q.node >> k > 0 AND NOT EXISTS (SELECT 1 FROM h{t}_{p.max_leaves - 1} c WHERE c.model = q.model AND c.node = q.node >> k)
  GROUP BY ALL) f ON f.model = r.model AND f.node = r.node)""")
            last = f"m{t}"
        ctes.append(f"""l{t} AS MATERIALIZED (SELECT model, node, -{_soft('sum(g)', p)} / (sum(h) + {lam}) AS leaf FROM {last} WHERE inb GROUP BY ALL)""")
        ctes.append(f"""z{t + 1} AS MATERIALIZED (SELECT r.model, r.id, r.tr, r.st, r.va, r.y, r.z + coalesce(l.leaf, 0) * {d(p.learning_rate)} AS z,
  {', '.join(f'r.b{i}' for i in range(len(feats)))} FROM {last} r LEFT JOIN l{t} l ON r.model = l.model AND r.node = l.node)""")
    losses = " UNION ALL ".join(f"SELECT model, {t} AS t, avg({loss}) AS loss FROM z{t} WHERE st GROUP BY model" for t in range(p.n_trees + 1))
    ctes.append(f"losses AS MATERIALIZED ({losses})")
    ctes.append("""runmin AS (SELECT a.model, a.t, a.loss, (SELECT b.t FROM losses b WHERE b.model = a.model AND b.t <= a.t
               ORDER BY b.loss, b.t LIMIT 1) AS bt FROM losses a)""")
    stop = f"min(t) FILTER (WHERE t - bt >= {p.early_stopping})" if p.early_stopping else "NULL"
    ctes.append(f"stops AS (SELECT model, coalesce({stop}, {p.n_trees}) AS trees_grown FROM runmin GROUP BY model)")
    ctes.append("""best AS (SELECT s.model, r.bt AS best_iter, s.trees_grown,
               (SELECT min(loss) FROM losses l WHERE l.model = s.model AND l.t <= s.trees_grown) AS best_valid_loss
               FROM stops s JOIN runmin r ON r.model = s.model AND r.t = s.trees_grown)""")
    return ctes


def oof_sql(p: BoostParams, prefix: str = "") -> str:
    """SELECT of (id, fold, y, pred): the margin after the best iteration of the model that did not see the row."""
    parts = " UNION ALL ".join(f"SELECT model, id, y, z, {t} AS t FROM {prefix}z{t} WHERE va" for t in range(p.n_trees + 1))
    pred = "z" if p.objective == "squared" else "1.0::double / (1.0::double + exp(-z))"
    return f"SELECT id, a.model AS fold, y, {pred} AS pred FROM ({parts}) a JOIN {prefix}best b ON a.model = b.model AND a.t = b.best_iter"


def rest_sql(p: BoostParams, prefix: str = "") -> str:
    """SELECT of (id, model, pred): what the best iterations give for the rows that neither train nor validate."""
    parts = " UNION ALL ".join(f"SELECT model, id, z, {t} AS t FROM {prefix}z{t} WHERE NOT tr AND NOT va" for t in range(p.n_trees + 1))
    pred = "z" if p.objective == "squared" else "1.0::double / (1.0::double + exp(-z))"
    return f"SELECT id, a.model, {pred} AS pred FROM ({parts}) a JOIN {prefix}best b ON a.model = b.model AND a.t = b.best_iter"


def solve_ctes(src: str, n: int) -> list[str]:
    """CTEs from a one-row ``src`` with a symmetric system a<i>_<j>, right side a<i>_<n+1>, to ``solved`` (w1 .. wn)."""
    ctes, last = [], src
    for k in range(1, n):
        cols = [f"a{i}_{j}" if i <= k else f"a{i}_{j} - a{i}_{k} * a{k}_{j} / a{k}_{k} AS a{i}_{j}" for i in range(1, n + 1) for j in range(1, n + 2)]
        ctes.append(f"g{k} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {last})")
        last = f"g{k}"
    for i in range(n, 0, -1):
        known = "".join(f" - a{i}_{j} * w{j}" for j in range(i + 1, n + 1))
        ctes.append(f"v{i} AS MATERIALIZED (SELECT *, (a{i}_{n + 1}{known}) / a{i}_{i} AS w{i} FROM {last})")
        last = f"v{i}"
    return [*ctes, f"solved AS (SELECT * FROM {last})"]
