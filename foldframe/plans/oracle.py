"""DuckDB oracle text for every closed-form query in ``catalog.QUERIES``."""

from __future__ import annotations

from .sqltext import FCLS, FDOC, FPRED, FREG, FSIG, auc_sql, md5_of, strat_fold

D = 9
ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


# --------------------------------------------------------------- folds
oracle("kfold_assign", f"""WITH {FREG}
SELECT id, {strat_fold('id', None, 5, 42)} AS fold FROM freg""")

_SK = f"""{FCLS},
skf AS (SELECT id, y, {strat_fold('id', 'y', 5, 42)} AS fold FROM fcls WHERE part = 'train')"""

oracle("stratified_kfold_assign", f"WITH {_SK} SELECT id, y, fold FROM skf")

oracle("inner_fold_assign", f"""WITH {_SK},
ex AS (SELECT CAST(o.k AS INTEGER) AS "outer", id, y, fold FROM skf, range(5) o(k) WHERE fold <> o.k)
SELECT "outer", id, fold,
       CAST((row_number() OVER (PARTITION BY "outer" ORDER BY y, {md5_of('id', "'1'")}, id) - 1) % 5 AS INTEGER)
         AS "inner"
FROM ex""")

# --------------------------------------------------------------- metrics
_LONG = f"""{FPRED},
plong AS (
  SELECT id, fold, y, 'p1' AS model, p1 AS score FROM fpred UNION ALL
  SELECT id, fold, y, 'p2', p2 FROM fpred UNION ALL
  SELECT id, fold, y, 'p3', p3 FROM fpred)"""

oracle("roc_auc_pooled", f"""WITH {_LONG}
SELECT model, round(value, {D}) AS value FROM {auc_sql('plong', 'score', 'y', 'model', 'value')} a""")

oracle("roc_auc_by_fold", f"""WITH {_LONG}
SELECT model, fold, round(value, {D}) AS value
FROM {auc_sql('plong', 'score', 'y', 'model, fold', 'value')} a""")

oracle("rmse_by_fold", f"""WITH {_LONG}
SELECT model, fold, round(sqrt(avg((CAST(y AS DOUBLE) - score) * (CAST(y AS DOUBLE) - score))), {D}) AS value
FROM plong GROUP BY model, fold""")

oracle("mean_fold_score", f"""WITH {_LONG}
SELECT model, round(avg(value), {D}) AS mean_value
FROM {auc_sql('plong', 'score', 'y', 'model, fold', 'value')} a GROUP BY model""")

# --------------------------------------------------------------- encoders
from .sqltext import d, noise, smoothed  # noqa: E402

CATS = ["o_orderpriority", "c_mktsegment"]
LAM, SIG, SEED = 2.0, 0.01, 0


def _dict(c, where):
    return (f"dict_{c} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
            f"FROM (SELECT DISTINCT {c} FROM fcls WHERE {where} AND {c} IS NOT NULL))")


def _codes(cols, where, null_code="NULL"):
    ctes = ",\n".join(_dict(c, where) for c in cols)
    sel = ", ".join(
        f"CASE WHEN t.{c} IS NULL THEN {null_code} ELSE coalesce(dict_{c}.code, -1) END AS {c}" for c in cols)
    joins = " ".join(f"LEFT JOIN dict_{c} ON t.{c} = dict_{c}.v" for c in cols)
    return ctes, sel, joins


_c, _s, _j = _codes(CATS, "part = 'train'")
oracle("ordinal_encode", f"""WITH {FCLS}, {_c}
SELECT t.id, t.part, {_s} FROM fcls t {_j} WHERE t.part IN ('train', 'test')""")

_c, _s, _j = _codes(CATS, "part = 'train' AND o_orderpriority <> '5-LOW'")
oracle("ordinal_encode_unknown", f"""WITH {FCLS}, {_c}
SELECT t.id, t.part, {_s} FROM fcls t {_j}""")

_c, _s, _j = _codes(CATS, "TRUE")
oracle("ordinal_encode_strict", f"""WITH {FCLS}, {_c}
SELECT t.id, {_s} FROM fcls t {_j} WHERE t.part = 'test'""")

_c, _s, _j = _codes([*CATS, "c_nationkey"], "part = 'train' AND o_orderpriority <> '5-LOW'", "-1")
oracle("category_encode", f"""WITH {FCLS}, {_c}
SELECT t.id, t.part, {_s} FROM fcls t {_j}""")

_SKF = f"""{FCLS},
skf AS (SELECT *, {strat_fold('id', 'y', 5, 42)} AS fold FROM fcls WHERE part = 'train'),
ex AS (SELECT CAST(o.k AS INTEGER) AS "outer", skf.* FROM skf, range(5) o(k) WHERE fold <> o.k)"""

oracle("global_mean", f"""WITH {_SKF}
SELECT "outer", round(avg(CAST(y AS DOUBLE)), {D}) AS global_mean FROM ex GROUP BY "outer" """)


def _te_plain():
    fit = "(SELECT * FROM ex WHERE o_orderpriority <> '5-LOW')"
    ctes = [f"fit AS {fit}", 'gm AS (SELECT "outer", avg(CAST(y AS DOUBLE)) AS gm FROM fit GROUP BY "outer")']
    for c in CATS:
        e = smoothed("st.s", "st.n", "gm.gm", LAM)
        nz = noise(SIG, f"'te|{SEED}|{c}'", 'st."outer"', f"st.{c}")
        ctes.append(f"""enc_{c} AS (SELECT st."outer", st.{c}, {e} + {nz} AS enc FROM
          (SELECT "outer", {c}, sum(CAST(y AS DOUBLE)) AS s, count(y) AS n FROM fit WHERE {c} IS NOT NULL
           GROUP BY "outer", {c}) st JOIN gm ON st."outer" = gm."outer")""")
    ctes.append("""valid AS (SELECT fold AS "outer", * FROM skf)""")
    ctes.append("""tst AS (SELECT CAST(o.k AS INTEGER) AS "outer", fcls.* FROM fcls, range(5) o(k)
                   WHERE part = 'test')""")
    body = []
    for src, role in (("ex", "train"), ("valid", "valid"), ("tst", "test")):
        sel = ", ".join(f"round(coalesce(enc_{c}.enc, gm.gm), {D}) AS {c}_encoded" for c in CATS)
        joins = " ".join(f'LEFT JOIN enc_{c} ON t."outer" = enc_{c}."outer" AND t.{c} = enc_{c}.{c}'
                         for c in CATS)
        body.append(f"""SELECT t."outer", t.id, {sel}, '{role}' AS role FROM {src} t
          JOIN gm ON t."outer" = gm."outer" {joins}""")
    return f"WITH {_SKF}, " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(body)


oracle("target_encode", _te_plain())


def _te_cv_ctes(cats=None):
    cats = cats or CATS
    ctes = [f"""exi AS (SELECT *, CAST((row_number() OVER (PARTITION BY "outer" ORDER BY y, {md5_of('id', "'1'")}, id)
                 - 1) % 5 AS INTEGER) AS "inner" FROM ex)""",
            'gm AS (SELECT "outer", avg(CAST(y AS DOUBLE)) AS gm FROM exi GROUP BY "outer")']
    for c in cats:
        ctes.append(f"""cell_{c} AS (SELECT "outer", "inner", {c} AS key, sum(CAST(y AS DOUBLE)) AS s, count(y) AS n
          FROM exi WHERE {c} IS NOT NULL GROUP BY "outer", "inner", {c})""")
        ctes.append(f"""tot_{c} AS (SELECT "outer", key, sum(s) AS S, sum(n) AS N FROM cell_{c}
          GROUP BY "outer", key)""")
    return ",\n".join(ctes)


def _te_oof(cats=None, base=None, lam=LAM, sig=SIG, seed=SEED, raw=False):
    cats, base = cats or CATS, base or _SKF
    sels, joins = [], []
    for c in cats:
        e = smoothed(f"(t_{c}.S - c_{c}.s)", f"(t_{c}.N - c_{c}.n)", "gm.gm", lam)
        nz = noise(sig, f"'te_oof|{seed}|{c}'", 'e."outer"', "e.id")
        value = f"coalesce({e}, gm.gm) + {nz}"
        sels.append(f"{value if raw else f'round({value}, {D})'} AS {c}_encoded")
        joins.append(f"""LEFT JOIN cell_{c} c_{c} ON e."outer" = c_{c}."outer" AND e."inner" = c_{c}."inner"
                         AND e.{c} = c_{c}.key
          LEFT JOIN tot_{c} t_{c} ON e."outer" = t_{c}."outer" AND e.{c} = t_{c}.key""")
    ctes = f"WITH {base}, {_te_cv_ctes(cats)}"
    body = (f"SELECT e.\"outer\", e.id, {'e.y, ' if raw else ''}{', '.join(sels)} FROM exi e "
            f"JOIN gm ON e.\"outer\" = gm.\"outer\" " + " ".join(joins))
    return (ctes, body) if raw else f"{ctes}\n{body}"


oracle("target_encode_oof", _te_oof())


def _te_apply_body(src, role, extra_sel=""):
    sels, joins = [], []
    for c in CATS:
        e = smoothed(f"t_{c}.S", f"t_{c}.N", "gm.gm", LAM)
        sels.append(f"coalesce({e}, gm.gm) AS {c}_encoded")
        joins.append(f"""LEFT JOIN tot_{c} t_{c} ON v."outer" = t_{c}."outer" AND v.{c} = t_{c}.key""")
    return (f"SELECT v.\"outer\", v.id, v.y, {', '.join(sels)}, '{role}' AS role FROM {src} v "
            f"JOIN gm ON v.\"outer\" = gm.\"outer\" " + " ".join(joins))


_APPLY = f"""WITH {_SKF}, {_te_cv_ctes()},
valid AS (SELECT fold AS "outer", * FROM skf),
tst AS (SELECT CAST(o.k AS INTEGER) AS "outer", fcls.* FROM fcls, range(5) o(k) WHERE part = 'test'),
applied AS ({_te_apply_body('valid', 'valid')} UNION ALL {_te_apply_body('tst', 'test')})"""

oracle("target_encode_apply", _APPLY + f"""
SELECT "outer", id, role, {', '.join(f'round({c}_encoded, {D}) AS {c}_encoded' for c in CATS)} FROM applied""")

_c, _b = _te_oof(raw=True)
oracle("te_oof_auc_by_fold", f"""{_c},
enc AS ({_b}),
scored AS (SELECT "outer", y, o_orderpriority_encoded + c_mktsegment_encoded AS score FROM enc)
SELECT "outer", round(auc, {D}) AS auc FROM {auc_sql('scored', 'score', 'y', '"outer"', 'auc')} a""")

# --------------------------------------------------------------- external statistics
STAT_COLS = ["o_orderpriority", "c_mktsegment", "c_nationkey", "o_totalprice", "c_acctbal"]


def _ext(cols, mean, count):
    ctes, sels, joins = [], [], []
    for c in cols:
        nan = f" AND NOT isnan({c})" if c in ("o_totalprice", "c_acctbal") else ""
        ctes.append(f"""st_{c} AS (SELECT {c} AS key, avg(CAST(y AS DOUBLE)) AS m, count(*) AS n
          FROM fcls WHERE part = 'original' AND {c} IS NOT NULL{nan} GROUP BY {c})""")
        if mean:
            sels.append(f"round(st_{c}.m, {D}) AS {c}_mean")
        if count:
            sels.append(f"st_{c}.n AS {c}_count")
        joins.append(f"LEFT JOIN st_{c} ON t.{c} = st_{c}.key")
    return (f"WITH {FCLS}, " + ",\n".join(ctes) + f"\nSELECT t.id, t.part, {', '.join(sels)} FROM fcls t "
            + " ".join(joins) + " WHERE t.part IN ('train', 'test')")


oracle("external_target_mean", _ext(STAT_COLS[:4], True, False))
oracle("external_count", _ext(STAT_COLS[:4], False, True))
oracle("external_stats_all", _ext(STAT_COLS, True, True))

oracle("category_stats", f"""WITH {FDOC}
SELECT 'lang' AS "column", CAST(lang AS VARCHAR) AS key, round(avg(CAST(quality AS DOUBLE)), {D}) AS label_mean,
       count(quality) AS label_count FROM fdoc WHERE lang IS NOT NULL GROUP BY lang
UNION ALL
SELECT 'source', CAST(source AS VARCHAR), round(avg(CAST(quality AS DOUBLE)), {D}), count(quality)
FROM fdoc WHERE source IS NOT NULL GROUP BY source""")

# --------------------------------------------------------------- features, labels, unions
from .sqltext import FEVT, z  # noqa: E402

_SIN = "CAST(sin(2.0::double * pi() * CAST({c} AS DOUBLE) / 12.0::double) AS FLOAT)"
oracle("math_features", f"""WITH {FEVT}
SELECT id, {_SIN.format(c='value')} AS _value_sin, {_SIN.format(c='user_id')} AS _user_id_sin,
       round(ln(1.0::double + value), {D}) AS log_value, round(value * value, {D}) AS value_sq,
       round(ln(1.0::double + CAST(user_id AS DOUBLE)), {D}) AS log_user_id,
       round(CAST(user_id AS DOUBLE) * CAST(user_id AS DOUBLE), {D}) AS user_id_sq
FROM fevt""")

oracle("hash_noise", f"""WITH {FEVT}
SELECT id, round({z("'evt'", 'id')}, {D}) AS z, round({noise(0.5, "'evt2'", 'event_type', 'id')}, {D}) AS noise
FROM fevt""")

oracle("map_label", f"""WITH {FCLS}
SELECT id, status, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS label FROM fcls""")

oracle("augment_train", f"""WITH {_SKF}
SELECT id, y, o_orderpriority, round(c_acctbal, {D}) AS c_acctbal, 1 AS is_generated FROM skf WHERE fold <> 0
UNION ALL
SELECT id, y, o_orderpriority, round(c_acctbal, {D}), 0 FROM fcls WHERE part = 'original'""")

# --------------------------------------------------------------- blends
oracle("join_oof", f"""WITH {FPRED}
SELECT id, y, round(p1, {D}) AS p1, round(p2, {D}) AS p2, round(p3, {D}) AS p3 FROM fpred""")

oracle("align_fold_predictions", f"""WITH {FPRED}
SELECT id, fold, round(p1, {D}) AS p1, round(p2, {D}) AS p2 FROM fpred_test""")

oracle("mean_over_folds", f"""WITH {FPRED}
SELECT id, round(avg(p1), {D}) AS p1, round(avg(p2), {D}) AS p2 FROM fpred_test GROUP BY id""")

oracle("mean_over_models", f"""WITH {FPRED}
SELECT id, round((p1 + p2 + p3) / 3.0::double, {D}) AS pred FROM fpred""")


# --------------------------------------------------------------- linear meta-models, 2 features written out
def _moments_ctes(by_class: bool):
    """Centred moments of (p1, p2[, y]) per fold (and class); combined per outer fold and for all."""
    cls = ", y" if by_class else ""
    ycols = "" if by_class else """, sum(x3) AS s3, sum(x1 * x3) AS q13, sum(x2 * x3) AS q23"""
    ymean = "" if by_class else ", avg(CAST(y AS DOUBLE)) AS m3"
    yx = "" if by_class else ", CAST(y AS DOUBLE) - m.m3 AS x3"
    ysum = "" if by_class else ", sum(s3) AS s3, sum(q13) AS q13, sum(q23) AS q23"
    return f"""gmean AS (SELECT avg(p1) AS m1, avg(p2) AS m2{ymean} FROM fpred),
cen AS (SELECT fold{cls}, p1 - m.m1 AS x1, p2 - m.m2 AS x2{yx} FROM fpred, gmean m),
mom AS (SELECT fold{cls}, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS q11,
               sum(x1 * x2) AS q12, sum(x2 * x2) AS q22{ycols} FROM cen GROUP BY fold{cls}),
keys AS (SELECT CAST(k AS INTEGER) AS o FROM range(-1, 5) t(k)),
om AS (SELECT keys.o{cls}, sum(n) AS n, sum(s1) AS s1, sum(s2) AS s2, sum(q11) AS q11, sum(q12) AS q12,
              sum(q22) AS q22{ysum}
       FROM mom, keys WHERE keys.o = -1 OR mom.fold <> keys.o GROUP BY keys.o{cls})"""


_RIDGE = f"""{FPRED},
{_moments_ctes(False)},
sc AS (SELECT o, n, m1 + s1 / n AS mx1, m2 + s2 / n AS mx2, m3 + s3 / n AS my,
              q11 - s1 * s1 / n + 1.0::double AS a11, q12 - s1 * s2 / n AS a12, q22 - s2 * s2 / n + 1.0::double AS a22,
              q13 - s1 * s3 / n AS c1, q23 - s2 * s3 / n AS c2 FROM om, gmean),
coef AS (SELECT o, (a22 * c1 - a12 * c2) / (a11 * a22 - a12 * a12) AS w1,
                   (a11 * c2 - a12 * c1) / (a11 * a22 - a12 * a12) AS w2, mx1, mx2, my FROM sc),
model AS (SELECT o, my - mx1 * w1 - mx2 * w2 AS b, w1, w2 FROM coef)"""

oracle("ridge_oof", f"""WITH {_RIDGE}
SELECT id, fold, round(b + w1 * p1 + w2 * p2, {D}) AS pred FROM fpred JOIN model ON model.o = fpred.fold""")

oracle("ridge_blend_submission", f"""WITH {_RIDGE}
SELECT id, round(avg(b + w1 * p1 + w2 * p2), {D}) AS pred FROM fpred_test, model WHERE model.o = -1 GROUP BY id""")

_LDA = f"""{FPRED},
{_moments_ctes(True)},
cls AS (SELECT o, y, n, m1 + s1 / n AS mu1, m2 + s2 / n AS mu2,
               q11 - s1 * s1 / n AS w11, q12 - s1 * s2 / n AS w12, q22 - s2 * s2 / n AS w22 FROM om, gmean),
pooled AS (SELECT c0.o, c0.n AS n0, c1.n AS n1, c0.mu1 AS a1, c0.mu2 AS a2, c1.mu1 AS b1, c1.mu2 AS b2,
                  (c0.w11 + c1.w11) / CAST(c0.n + c1.n - 2 AS DOUBLE) AS s11,
                  (c0.w12 + c1.w12) / CAST(c0.n + c1.n - 2 AS DOUBLE) AS s12,
                  (c0.w22 + c1.w22) / CAST(c0.n + c1.n - 2 AS DOUBLE) AS s22
           FROM cls c0 JOIN cls c1 ON c0.o = c1.o AND c0.y = 0 AND c1.y = 1),
beta AS (SELECT *, (s22 * (b1 - a1) - s12 * (b2 - a2)) / (s11 * s22 - s12 * s12) AS w1,
                   (s11 * (b2 - a2) - s12 * (b1 - a1)) / (s11 * s22 - s12 * s12) AS w2 FROM pooled),
model AS (SELECT o, -0.5::double * ((a1 + b1) * w1 + (a2 + b2) * w2) + ln(CAST(n1 AS DOUBLE) / CAST(n0 AS DOUBLE)) AS b,
                 w1, w2 FROM beta)"""

oracle("lda_oof", f"""WITH {_LDA}
SELECT id, fold, round(1.0::double / (1.0::double + exp(-(b + w1 * p1 + w2 * p2))), {D}) AS pred
FROM fpred JOIN model ON model.o = fpred.fold""")

oracle("lda_blend_submission", f"""WITH {_LDA}
SELECT id, round(avg(1.0::double / (1.0::double + exp(-(b + w1 * p1 + w2 * p2)))), {D}) AS pred
FROM fpred_test, model WHERE model.o = -1 GROUP BY id""")

# --------------------------------------------------------------- boosting: root split of five fold models
_CUTS = [50000.0, 100000.0, 150000.0, 200000.0, 250000.0, 300000.0, 350000.0, 400000.0]
_BIN0 = ("CASE WHEN o_totalprice IS NULL OR isnan(o_totalprice) THEN 9 " +
         " ".join(f"WHEN o_totalprice < {d(c)} THEN {i}" for i, c in enumerate(_CUTS)) + " ELSE 8 END")
_BIN1 = "CASE WHEN c_nationkey IS NULL OR c_nationkey < 0 OR c_nationkey >= 25 THEN 25 ELSE c_nationkey END"


def _T(x):
    return f"(sign({x}) * greatest(abs({x}) - 0.5::double, 0.0::double))"


oracle("best_split", f"""WITH {FSIG},
kf AS (SELECT *, {strat_fold('id', None, 5, 42)} AS fold FROM fsig WHERE part = 'train'),
ex AS (SELECT CAST(o.k AS INTEGER) AS model, kf.* FROM kf, range(5) o(k) WHERE fold <> o.k),
base AS (SELECT model, avg(s) AS b FROM ex GROUP BY model),
r AS (SELECT ex.model, base.b - ex.s AS g, {_BIN0} AS bin0, {_BIN1} AS bin1 FROM ex JOIN base ON ex.model = base.model),
hist AS (SELECT model, 0 AS feat, bin0 AS bin, sum(g) AS G, count(*) * 1.0::double AS H, count(*) AS C
         FROM r GROUP BY model, bin0
         UNION ALL
         SELECT model, 1, bin1, sum(g), count(*) * 1.0::double, count(*) FROM r GROUP BY model, bin1),
ord AS (SELECT *, CASE WHEN feat = 1 THEN (CASE WHEN bin = 25 THEN 'Infinity'::double ELSE G / (H + 1.0::double) END)
                  ELSE CAST(bin AS DOUBLE) END AS key FROM hist),
cum AS (SELECT *,
          sum(G) OVER w AS GL, sum(H) OVER w AS HL, sum(C) OVER w AS CL,
          sum(G) OVER (PARTITION BY model, feat) AS Gt, sum(H) OVER (PARTITION BY model, feat) AS Ht,
          sum(C) OVER (PARTITION BY model, feat) AS Ct
        FROM ord WINDOW w AS (PARTITION BY model, feat ORDER BY key, bin ROWS UNBOUNDED PRECEDING)),
gains AS (SELECT *, 0.5::double * ({_T('GL')} * {_T('GL')} / (HL + 1.0::double)
                   + {_T('(Gt - GL)')} * {_T('(Gt - GL)')} / (Ht - HL + 1.0::double)
                   - {_T('Gt')} * {_T('Gt')} / (Ht + 1.0::double)) AS gain
          FROM cum
          WHERE HL >= 1.0::double AND Ht - HL >= 1.0::double AND CL >= 1 AND Ct - CL >= 1
            AND ((feat = 0 AND bin <> 9) OR (feat = 1 AND key <> 'Infinity'::double))),
best AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(gain, 8) DESC, feat, key) AS rn FROM gains WHERE gain > 0)
SELECT model, feat, bin, round(gain, 6) AS gain, round(GL, 6) AS GL, round(HL, 6) AS HL FROM best WHERE rn = 1""")


# --------------------------------------------------------------- logistic (penalised intercept), unrolled Newton steps
def _logistic_ctes(steps: int = 10, free: bool = False) -> str:
    """``free``: the intercept is not penalised."""
    ctes = ["lr0 AS (SELECT CAST(k AS INTEGER) AS o, 0.0::double AS b, 0.0::double AS w1, 0.0::double AS w2 "
            "FROM range(-1, 5) t(k))"]
    for i in range(1, steps + 1):
        prev = f"lr{i - 1}"
        ctes.append(f"""ag{i} AS (
  SELECT m.o, m.b, m.w1, m.w2,
         sum(pp - y){'' if free else ' + m.b'} AS g0, sum((pp - y) * p1) + m.w1 AS g1, sum((pp - y) * p2) + m.w2 AS g2,
         sum(pp * (1.0::double - pp)){'' if free else ' + 1.0::double'} AS h00, sum(pp * (1.0::double - pp) * p1) AS h01,
         sum(pp * (1.0::double - pp) * p2) AS h02, sum(pp * (1.0::double - pp) * p1 * p1) + 1.0::double AS h11,
         sum(pp * (1.0::double - pp) * p1 * p2) AS h12, sum(pp * (1.0::double - pp) * p2 * p2) + 1.0::double AS h22
  FROM (SELECT m.o, m.b, m.w1, m.w2, f.p1, f.p2, CAST(f.y AS DOUBLE) AS y,
               1.0::double / (1.0::double + exp(-(m.b + m.w1 * f.p1 + m.w2 * f.p2))) AS pp
        FROM {prev} m JOIN fpred f ON m.o = -1 OR f.fold <> m.o) z
  JOIN {prev} m ON z.o = m.o GROUP BY m.o, m.b, m.w1, m.w2),
cf{i} AS (SELECT *, h11 * h22 - h12 * h12 AS c00, -(h01 * h22 - h02 * h12) AS c01, h01 * h12 - h02 * h11 AS c02,
                 h00 * h22 - h02 * h02 AS c11, -(h00 * h12 - h01 * h02) AS c12, h00 * h11 - h01 * h01 AS c22
          FROM ag{i}),
lr{i} AS (SELECT o,
                 b - (c00 * g0 + c01 * g1 + c02 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS b,
                 w1 - (c01 * g0 + c11 * g1 + c12 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS w1,
                 w2 - (c02 * g0 + c12 * g1 + c22 * g2) / (h00 * c00 + h01 * c01 + h02 * c02) AS w2
          FROM cf{i})""")
    return ",\n".join(ctes) + f",\nlrmodel AS (SELECT * FROM lr{steps})"


_LOGIT = f"{FPRED},\n{_logistic_ctes()}"

oracle("logistic_oof", f"""WITH {_LOGIT}
SELECT id, fold, round(1.0::double / (1.0::double + exp(-(b + w1 * p1 + w2 * p2))), {D}) AS pred
FROM fpred JOIN lrmodel ON lrmodel.o = fpred.fold""")

oracle("vote_blend", f"""WITH {_LDA},
{_logistic_ctes()}
SELECT f.id, f.fold, round((1.0::double / (1.0::double + exp(-(l.b + l.w1 * f.p1 + l.w2 * f.p2)))
                     + 1.0::double / (1.0::double + exp(-(d.b + d.w1 * f.p1 + d.w2 * f.p2)))) / 2.0::double, {D}) AS pred
FROM fpred f JOIN lrmodel l ON l.o = f.fold JOIN model d ON d.o = f.fold""")

oracle("submission", f"""WITH {_RIDGE},
preds AS (SELECT id, avg(b + w1 * p1 + w2 * p2) AS pred FROM fpred_test, model WHERE model.o = -1 GROUP BY id)
SELECT t.id, round(preds.pred, {D}) AS target FROM fsig t LEFT JOIN preds ON t.id = preds.id
WHERE t.part = 'test'""")

oracle("vote_submission", f"""WITH {_LDA},
{_logistic_ctes()},
per AS (SELECT t.id,
               1.0::double / (1.0::double + exp(-(l.b + l.w1 * t.p1 + l.w2 * t.p2))) AS lr,
               1.0::double / (1.0::double + exp(-(d.b + d.w1 * t.p1 + d.w2 * t.p2))) AS lda
        FROM fpred_test t, lrmodel l, model d WHERE l.o = -1 AND d.o = -1),
avgd AS (SELECT id, avg(lr) AS lr, avg(lda) AS lda, avg((lr + lda) / 2.0::double) AS vote FROM per GROUP BY id)
SELECT id, round((lr + lda + vote) / 3.0::double, {D}) AS pred FROM avgd""")

# --------------------------------------------------------------- boosting: first depth-2 tree of five fold models
_ACCT = [-500.0, 0.0, 1000.0, 2000.0, 3000.0, 4000.0, 5000.0, 6000.0, 7000.0, 8000.0, 9000.0]
_BINA = ("CASE WHEN c_acctbal IS NULL OR isnan(c_acctbal) THEN 12 " +
         " ".join(f"WHEN c_acctbal < {d(c)} THEN {i}" for i, c in enumerate(_ACCT)) + " ELSE 11 END")


def _best(hist: str, keys: str) -> str:
    """Best numeric split per (keys) over a histogram relation (feat 0: missing bin 9, feat 1: 12)."""
    return f"""(SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(gain, 8) DESC, feat, bin) AS rn FROM (
    SELECT *, 0.5::double * ({_T('GL')} * {_T('GL')} / (HL + 1.0::double)
                 + {_T('(Gt - GL)')} * {_T('(Gt - GL)')} / (Ht - HL + 1.0::double)
                 - {_T('Gt')} * {_T('Gt')} / (Ht + 1.0::double)) AS gain
    FROM (SELECT *, sum(G) OVER w AS GL, sum(H) OVER w AS HL, sum(C) OVER w AS CL,
                 sum(G) OVER (PARTITION BY {keys}, feat) AS Gt, sum(H) OVER (PARTITION BY {keys}, feat) AS Ht,
                 sum(C) OVER (PARTITION BY {keys}, feat) AS Ct
          FROM {hist} WINDOW w AS (PARTITION BY {keys}, feat ORDER BY bin ROWS UNBOUNDED PRECEDING)) c
    WHERE HL >= 1.0::double AND Ht - HL >= 1.0::double AND CL >= 1 AND Ct - CL >= 1
      AND ((feat = 0 AND bin <> 9) OR (feat = 1 AND bin <> 12))) g
  WHERE gain > 0) b WHERE rn = 1)"""


def _hist_sql(src: str, keys: str) -> str:
    return f"""(SELECT {keys}, 0 AS feat, bin0 AS bin, sum(g) AS G, count(*) * 1.0::double AS H, count(*) AS C
       FROM {src} GROUP BY {keys}, bin0
       UNION ALL
       SELECT {keys}, 1, bin1, sum(g), count(*) * 1.0::double, count(*) FROM {src} GROUP BY {keys}, bin1)"""


def _goes_left(split: str) -> str:
    return f"(({split}.feat = 0 AND bin0 <= {split}.bin) OR ({split}.feat = 1 AND bin1 <= {split}.bin))"


oracle("gbt_first_tree", f"""WITH {FSIG},
kf AS (SELECT *, {strat_fold('id', None, 5, 42)} AS fold FROM fsig WHERE part = 'train'),
ex AS (SELECT CAST(o.k AS INTEGER) AS model, kf.* FROM kf, range(5) o(k) WHERE fold <> o.k),
base AS (SELECT model, avg(s) AS b FROM ex GROUP BY model),
r0 AS (SELECT ex.model, base.b - ex.s AS g, {_BIN0} AS bin0, {_BINA} AS bin1 FROM ex JOIN base ON ex.model = base.model),
s0 AS {_best(_hist_sql('r0', 'model'), 'model')},
r1 AS (SELECT r0.*, CASE WHEN {_goes_left('s0')} THEN 2 ELSE 3 END AS node FROM r0 JOIN s0 ON r0.model = s0.model),
s1 AS {_best(_hist_sql('r1', 'model, node'), 'model, node')},
r2 AS (SELECT r1.g, r1.model, 2 * r1.node + CASE WHEN {_goes_left('s1')} THEN 0 ELSE 1 END AS leaf
       FROM r1 JOIN s1 ON r1.model = s1.model AND r1.node = s1.node),
lv AS (SELECT model, leaf, sum(g) AS G, count(*) * 1.0::double AS H FROM r2 GROUP BY model, leaf)
SELECT model, 1 AS node, feat, bin, NULL::double AS value FROM s0
UNION ALL SELECT model, node, feat, bin, NULL::double FROM s1
UNION ALL SELECT model, leaf, NULL, NULL, round(-{_T('G')} / (H + 1.0::double), 6) FROM lv""")

oracle("source_flag", f"""WITH {FCLS}
SELECT id, y, CASE WHEN part = 'train' THEN 1 ELSE 0 END AS is_generated FROM fcls WHERE part IN ('train', 'original')""")


# --------------------------------------------------------------- sparse cells: unbalanced document labels (F-DOC)
_DOC_SKF = f"""{FDOC},
skf AS (SELECT id, toxic AS y, lang, source, {strat_fold('id', 'toxic', 5, 42)} AS fold FROM fdoc),
ex AS (SELECT CAST(o.k AS INTEGER) AS "outer", skf.* FROM skf, range(5) o(k) WHERE fold <> o.k)"""

oracle("target_encode_oof_sparse", _te_oof(["lang", "source"], _DOC_SKF, lam=1.0, sig=0.0, seed=0))


# --------------------------------------------------------------- operators on their own
oracle("read_table", f"""WITH {FCLS} SELECT id, round(o_totalprice, {D}) AS o_totalprice, o_orderpriority FROM fcls""")
oracle("read_reference_table", f"""WITH {FCLS} SELECT id, y, c_nationkey FROM fcls WHERE part = 'original'""")
oracle("oof_round_trip", f"""WITH {FPRED} SELECT id, round(p1, {D}) AS m1, y FROM fpred""")
oracle("fold_predictions_round_trip", f"""WITH {FPRED} SELECT id, fold, round(p1, {D}) AS m1 FROM fpred_test""")
oracle("split_features_label", f"""WITH {FCLS}
SELECT id, o_orderpriority, c_mktsegment, c_nationkey, round(o_totalprice, {D}) AS o_totalprice,
       round(c_acctbal, {D}) AS c_acctbal, y FROM fcls""")
oracle("categorical_columns", f"""WITH {FCLS} SELECT id, o_orderpriority, c_mktsegment, status FROM fcls""")
oracle("cast_label", f"""WITH {FCLS}
SELECT id, CAST(status = 'F' AS INTEGER) AS label, CAST(c_nationkey AS INTEGER) AS code FROM fcls""")
oracle("fill_default", f"""WITH {FCLS},
fit AS (SELECT * FROM fcls WHERE part = 'train' AND o_orderpriority <> '5-LOW'),
gm AS (SELECT avg(CAST(y AS DOUBLE)) AS g FROM fit),
st AS (SELECT o_orderpriority AS k, avg(CAST(y AS DOUBLE)) AS m FROM fit GROUP BY 1)
SELECT id, round(coalesce(st.m, gm.g), {D}) AS enc, round(gm.g, {D}) AS global_mean
FROM fcls t LEFT JOIN st ON t.o_orderpriority = st.k, gm WHERE part = 'test'""")
oracle("train_valid_split", f"""WITH {_SK}
SELECT id, fold, y, CASE WHEN fold = 2 THEN 'valid' ELSE 'train' END AS role FROM skf
UNION ALL SELECT id, fold, y, 'fold0' FROM skf WHERE fold = 0""")
oracle("stack_predictions", f"""WITH {FPRED}
SELECT id, round(p1, {D}) AS p1, round(p2, {D}) AS p2, round(p3, {D}) AS p3 FROM fpred""")
oracle("score_report", f"""WITH {_LONG}
SELECT model, 'auc' AS metric, round(value, {D}) AS value FROM {auc_sql('plong', 'score', 'y', 'model', 'value')} a""")
oracle("fold_scores", f"""WITH {_LONG}
SELECT model, fold, 'auc' AS metric, round(value, {D}) AS value
FROM {auc_sql('plong', 'score', 'y', 'model, fold', 'value')} a WHERE model = 'p1'
UNION ALL
SELECT model, fold, 'rmse', round(sqrt(avg((CAST(y AS DOUBLE) - score) * (CAST(y AS DOUBLE) - score))), {D})
FROM plong WHERE model = 'p1' GROUP BY model, fold""")
oracle("blend_pipeline_lda", ORACLE["lda_blend_submission"])
oracle("vote_scores", f"""WITH {FPRED},
vs AS (SELECT 'lr' AS model, id, pred FROM ({ORACLE['logistic_oof']}) a UNION ALL
       SELECT 'lda', id, pred FROM ({ORACLE['lda_oof']}) b UNION ALL
       SELECT 'vote', id, pred FROM ({ORACLE['vote_blend']}) c),
vy AS (SELECT vs.*, fpred.y FROM vs JOIN fpred USING (id))
SELECT model, 'auc' AS metric, round(value, 7) AS value FROM {auc_sql('vy', 'pred', 'y', 'model', 'value')} a""")
oracle("vote_only_submission", ORACLE["vote_submission"])


# --------------------------------------------------------------- boosted fits, tree by tree
from .boostsql import boost_ctes, cuts_sql, oof_sql, prefixed, rest_sql, solve_ctes  # noqa: E402
from .catalog import (  # noqa: E402
    CV_P, CV_SUBMISSION_P, EARLY_P, FOREST_DEPTH, FOREST_TREES, HOLD_P, LEAF_P, MANY_P, SAMPLED_P, SCORES_P, SIG_NUM,
    STACK_A, STACK_B, SYMMETRIC_P, _quick)


def _boost(p, label="s", strata=None, cats=(), num=SIG_NUM):
    codes = ", ".join(f"(SELECT count(DISTINCT {c}) FROM fsig q WHERE q.part = 'train' AND q.{c} < f.{c}) AS {c}" for c in cats)
    rows = f"""tr AS MATERIALIZED (SELECT id, {strat_fold('id', strata, 5, 42)} AS fold, {label} AS y,
      {', '.join(num)}{', ' + codes if cats else ''} FROM fsig f WHERE part = 'train')"""
    return f"WITH {FSIG},\n" + ",\n".join([rows, *boost_ctes("tr", list(num), list(cats), p, 5)]) + "\n"


def _oof(p):
    return f"SELECT id, fold, CAST(y AS DOUBLE) AS y, round(pred, 6) AS pred FROM ({oof_sql(p)}) o"


oracle("boost_regress_oof", _boost(_quick("squared")) + _oof(_quick("squared")).replace("CAST(y AS DOUBLE)", "round(y, 6)"))
oracle("boost_classify_oof", _boost(_quick("logistic"), "y_sig", "y_sig") + _oof(_quick("logistic")))
oracle("boost_categorical", _boost(_quick("squared"), cats=("c_mktsegment", "o_orderpriority"))
       + _oof(_quick("squared")).replace("CAST(y AS DOUBLE)", "round(y, 6)"))
oracle("boost_sampled", _boost(SAMPLED_P) + _oof(SAMPLED_P).replace("CAST(y AS DOUBLE)", "round(y, 6)"))
oracle("boost_early_stop", _boost(EARLY_P) + """SELECT model AS fold, CAST(best_iter AS INTEGER) AS best_iter,
  CAST(trees_grown AS INTEGER) AS trees_grown, round(best_valid_loss, 6) AS best_valid_loss FROM best""")
oracle("boost_leafwise", _boost(LEAF_P) + _oof(LEAF_P).replace("CAST(y AS DOUBLE)", "round(y, 6)"))
oracle("boost_symmetric", _boost(SYMMETRIC_P, "y_sig", "y_sig", ("c_mktsegment",)) + _oof(SYMMETRIC_P))
oracle("boost_holdout", _boost(HOLD_P) + """SELECT b.model AS fold, CAST(best_iter AS INTEGER) AS best_iter,
  CAST(trees_grown AS INTEGER) AS trees_grown, round(best_valid_loss, 6) AS best_valid_loss, n AS held_rows
  FROM best b JOIN (SELECT model, count(*) AS n FROM z0 WHERE st GROUP BY 1) h ON h.model = b.model""")
_MANY = _boost(MANY_P, cats=("account",), num=("o_totalprice",)).replace(
    "(SELECT count(DISTINCT account) FROM fsig q WHERE q.part = 'train' AND q.account < f.account)",
    "(SELECT code FROM accounts a WHERE a.account = CAST(f.c_acctbal AS VARCHAR))").replace(
    "tr AS MATERIALIZED", "accounts AS MATERIALIZED (SELECT account, row_number() OVER (ORDER BY account) - 1 AS code FROM "
    "(SELECT DISTINCT CAST(c_acctbal AS VARCHAR) AS account FROM fsig WHERE part = 'train')),\ntr AS MATERIALIZED", 1)
oracle("boost_many_categories", _MANY + _oof(MANY_P).replace("CAST(y AS DOUBLE)", "round(y, 6)"))
_HALF = 1 << FOREST_DEPTH
oracle("forest_score", f"""WITH {FSIG},
{cuts_sql('c1', "(SELECT * FROM fsig WHERE part = 'train')", 'o_totalprice', 16)}, {cuts_sql('c2', "(SELECT * FROM fsig WHERE part = 'train')", 'c_acctbal', 16)},
b AS MATERIALIZED (SELECT id, (SELECT count(*) FROM c1 WHERE v <= f.o_totalprice) AS b0, (SELECT count(*) FROM c2 WHERE v <= f.c_acctbal) AS b1 FROM fsig f),
h AS (SELECT tree, node, md5('forest|' || tree || '|' || node) AS h FROM range({FOREST_TREES}) t(tree), range(1, {2 * _HALF}) n(node)),
n AS MATERIALIZED (SELECT tree, node, ('0x' || substr(h, 1, 8))::BIGINT % 2 AS f, ('0x' || substr(h, 9, 8))::BIGINT AS u,
      ('0x' || substr(h, 17, 8))::BIGINT / 68719476736.0::DOUBLE - 0.03 AS value FROM h),
g AS MATERIALIZED (SELECT tree, node, f, u % (CASE f WHEN 0 THEN (SELECT count(*) FROM c1) ELSE (SELECT count(*) FROM c2) END) AS bin, value FROM n),
w0 AS (SELECT DISTINCT b0, b1, t.tree, 1 AS node FROM b, range({FOREST_TREES}) t(tree)),
""" + ",\n".join(f"""w{i + 1} AS (SELECT b0, b1, w.tree, 2 * w.node + CASE WHEN (CASE f WHEN 0 THEN b0 ELSE b1 END) <= bin THEN 0 ELSE 1 END AS node
  FROM w{i} w JOIN g ON g.tree = w.tree AND g.node = w.node)""" for i in range(FOREST_DEPTH)) + f""",
s AS (SELECT b0, b1, 0.25 + sum(value) AS z FROM w{FOREST_DEPTH} w JOIN g ON g.tree = w.tree AND g.node = w.node GROUP BY ALL)
SELECT id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-z)), 6) AS pred FROM b JOIN s USING (b0, b1)""")
oracle("quantile_bin", f"""WITH {FSIG},
tr AS (SELECT id, o_totalprice, c_acctbal FROM fsig WHERE part = 'train'),
{cuts_sql('c1', 'tr', 'o_totalprice', 16)}, {cuts_sql('c2', 'tr', 'c_acctbal', 16)}
SELECT id, (SELECT CAST(count(*) AS INTEGER) FROM c1 WHERE v <= t.o_totalprice) AS o_totalprice_bin,
       (SELECT CAST(count(*) AS INTEGER) FROM c2 WHERE v <= t.c_acctbal) AS c_acctbal_bin FROM tr t""")

oracle("stacking_linear_bases", f"""WITH {FPRED},
vs AS (SELECT 'ridge' AS model, id, pred FROM ({ORACLE['ridge_oof']}) a UNION ALL
       SELECT 'lda', id, pred FROM ({ORACLE['lda_oof']}) b),
vy AS (SELECT vs.*, fpred.y FROM vs JOIN fpred USING (id))
SELECT model, 'auc' AS metric, round(value, 7) AS value FROM {auc_sql('vy', 'pred', 'y', 'model', 'value')} a""")

_ROWS = f"""WITH {FSIG},
em AS (SELECT c_nationkey AS k, avg(s) AS m FROM fsig WHERE part = 'original' GROUP BY 1),
tr AS MATERIALIZED (SELECT id, fold, s AS y, o_totalprice, c_acctbal, c_nationkey, em.m AS c_nationkey_mean
  FROM (SELECT *, {strat_fold('id', None, 5, 42)} AS fold FROM fsig WHERE part = 'train'
        UNION ALL SELECT *, -2 FROM fsig WHERE part = 'original') f LEFT JOIN em ON f.c_nationkey = em.k)"""
oracle("cv_external_mean", ",\n".join([_ROWS, *boost_ctes("tr", [*SIG_NUM, "c_nationkey_mean"], [], CV_P, 5)]) + "\n"
       + _oof(CV_P).replace("CAST(y AS DOUBLE)", "round(y, 6)"))

_ROWS = f"""WITH {FSIG},
em AS (SELECT c_mktsegment AS k, avg(s) AS m, count(*) AS n FROM fsig WHERE part = 'original' GROUP BY 1),
tr AS MATERIALIZED (SELECT id, {strat_fold('id', None, 5, 42)} AS fold, s AS y, o_totalprice, c_acctbal, em.m AS seg_mean,
  em.n AS seg_count, (SELECT count(DISTINCT q.c_mktsegment) FROM fsig q WHERE q.part = 'train' AND q.c_mktsegment < f.c_mktsegment) AS seg
  FROM fsig f LEFT JOIN em ON f.c_mktsegment = em.k WHERE part = 'train')"""
oracle("cv_scores", ",\n".join([_ROWS, *boost_ctes("tr", ["o_totalprice", "c_acctbal", "seg_mean", "seg_count"], ["seg"], SCORES_P, 5)])
       + f"""
SELECT 'model' AS model, fold, 'rmse' AS metric, round(sqrt(avg((y - pred) * (y - pred))), 6) AS value
FROM ({oof_sql(SCORES_P)}) o GROUP BY fold""")


# --------------------------------------------------------------- pipelines with boosters
def _enc_rows(label: str, cats: list[str], plain: bool, lam: float) -> str:
    """CTE ``rows``: training rows of each outer part, its validation rows and all test rows with encoded columns."""
    base = f"""{FSIG},
skf AS (SELECT id, {label} AS y, o_totalprice, c_acctbal, {', '.join(cats)}, {strat_fold('id', None if plain else label, 5, 42)} AS fold FROM fsig WHERE part = 'train'),
ex AS (SELECT CAST(o.k AS INTEGER) AS "outer", skf.* FROM skf, range(5) o(k) WHERE fold <> o.k),
valid AS (SELECT fold AS "outer", * FROM skf),
tst AS (SELECT CAST(o.k AS INTEGER) AS "outer", id, NULL AS y, o_totalprice, c_acctbal, {', '.join(cats)} FROM fsig, range(5) o(k) WHERE part = 'test'),
{_te_cv_ctes(cats)}"""
    part = []
    for src, role in (("ex", "train"), ("valid", "valid"), ("tst", "test")):
        joins = [f'LEFT JOIN tot_{c} t_{c} ON v."outer" = t_{c}."outer" AND v.{c} = t_{c}.key' for c in cats]
        sels = [f"coalesce({smoothed(f't_{c}.S', f't_{c}.N', 'gm.gm', lam)}, gm.gm) AS {c}_encoded" for c in cats]
        if role == "train" and not plain:
            src = "exi"
            joins += [f'LEFT JOIN cell_{c} c_{c} ON v."outer" = c_{c}."outer" AND v."inner" = c_{c}."inner" AND v.{c} = c_{c}.key' for c in cats]
            sels = [f"coalesce({smoothed(f'(t_{c}.S - c_{c}.s)', f'(t_{c}.N - c_{c}.n)', 'gm.gm', lam)}, gm.gm) AS {c}_encoded" for c in cats]
        part.append(f"""SELECT v."outer" AS model, v.id, '{role}' = 'train' AS tr, '{role}' = 'valid' AS va, v.y, v.o_totalprice, v.c_acctbal, {', '.join(sels)}
  FROM {src} v JOIN gm ON v."outer" = gm."outer" {' '.join(joins)}""")
    return f"WITH {base},\nrows AS MATERIALIZED ({' UNION ALL '.join(part)})"


_SUB = "SELECT id, round(avg(pred), 6) AS pred FROM ({}) o GROUP BY id"
oracle("cv_plain_encoding", ",\n".join([_enc_rows("s", ["c_mktsegment"], True, 2.0), *boost_ctes(
    "rows", ["o_totalprice", "c_mktsegment_encoded"], [], CV_P, 5, owned=True)]) + "\n" + _SUB.format(rest_sql(CV_P)))
oracle("cv_submission", ",\n".join([_enc_rows("y_sig", ["c_mktsegment", "o_orderpriority"], False, 0.5), *boost_ctes(
    "rows", ["o_totalprice", "c_acctbal", "c_mktsegment_encoded", "o_orderpriority_encoded"], [], CV_SUBMISSION_P, 5, owned=True)])
    + "\n" + _SUB.format(rest_sql(CV_SUBMISSION_P)))

_RAW = ["o_totalprice", "c_acctbal", "c_nationkey"]
_BASES = [("a0_", STACK_A, _RAW), ("b0_", STACK_B, _RAW), ("a1_", STACK_A, [*_RAW, "nation_mean"]), ("b1_", STACK_B, [*_RAW, "nation_mean"])]
_STACK = [f"""WITH {FSIG},
em AS (SELECT c_nationkey AS k, avg(y_sig) AS m FROM fsig WHERE part = 'original' GROUP BY 1),
tr AS MATERIALIZED (SELECT id, fold, label AS y, o_totalprice, c_acctbal, c_nationkey, em.m AS nation_mean FROM (
  SELECT *, y_sig AS label, {strat_fold('id', 'y_sig', 5, 42)} AS fold FROM fsig WHERE part = 'train'
  UNION ALL SELECT *, NULL, -1 FROM fsig WHERE part = 'test') f LEFT JOIN em ON f.c_nationkey = em.k)"""]
for _pre, _p, _feats in _BASES:
    _STACK += prefixed(boost_ctes("tr", _feats, [], _p, 5, train="fold >= 0", refit=True), _pre)
_N = range(1, 5)
_STACK.append("stack AS MATERIALIZED (SELECT o1.id, o1.y, " + ", ".join(f"o{i}.pred AS p{i}" for i in _N) + " FROM "
              + " JOIN ".join(f"({oof_sql(_BASES[i - 1][1], _BASES[i - 1][0])}) o{i}" + ("" if i == 1 else f" ON o{i}.id = o1.id") for i in _N) + ")")
_STACK.append("mom AS MATERIALIZED (SELECT avg(y) AS my, " + ", ".join(f"avg(p{i}) AS m{i}_" for i in _N) + " FROM stack)")
_STACK.append("sys AS MATERIALIZED (SELECT " + ", ".join(
    f"sum((p{i} - m{i}_) * ({'y - my' if j == 5 else f'p{j} - m{j}_'})) {'+ 1.0::double' if i == j else ''} AS a{i}_{j}" for i in _N for j in range(1, 6))
    + " FROM stack, mom)")
_STACK += solve_ctes("sys", 4)
_TST = " JOIN ".join(f"(SELECT id, 1.0::double / (1.0::double + exp(-z)) AS p{i} FROM {_BASES[i - 1][0]}z{_BASES[i - 1][1].n_trees} WHERE model = 5 AND y IS NULL) t{i}"
                     + ("" if i == 1 else f" ON t{i}.id = t1.id") for i in _N)
oracle("stack_submission", ",\n".join(_STACK) + "\nSELECT t1.id, round(my + " + " + ".join(f"w{i} * (p{i} - m{i}_)" for i in _N) + f", 6) AS pred FROM {_TST}, mom, solved")

_REPORT = [f"""WITH {FSIG},
tr AS MATERIALIZED (SELECT id, {strat_fold('id', 'y_sig', 5, 42)} AS fold, y_sig AS y, o_totalprice, c_acctbal, c_nationkey FROM fsig WHERE part = 'train')"""]
_TWO = [("a0_", STACK_A, ["o_totalprice", "c_acctbal"]), ("b0_", STACK_B, ["o_totalprice", "c_nationkey"])]
for _pre, _p, _feats in _TWO:
    _REPORT += prefixed(boost_ctes("tr", _feats, [], _p, 5), _pre)
_REPORT.append(f"""fpred AS MATERIALIZED (SELECT a.id, a.fold, CAST(a.y AS INTEGER) AS y, a.pred AS p1, b.pred AS p2
  FROM ({oof_sql(STACK_A, 'a0_')}) a JOIN ({oof_sql(STACK_B, 'b0_')}) b ON a.id = b.id)""")
_REPORT.append(_logistic_ctes(free=True))
_REPORT.append("""sc AS MATERIALIZED (SELECT 'a' AS model, y, p1 AS pred FROM fpred UNION ALL SELECT 'b', y, p2 FROM fpred
  UNION ALL SELECT 'stacker_in_sample', y, 1.0::double / (1.0::double + exp(-(b + w1 * p1 + w2 * p2))) FROM fpred, lrmodel WHERE o = -1
  UNION ALL SELECT 'stacker_cv', y, 1.0::double / (1.0::double + exp(-(b + w1 * p1 + w2 * p2))) FROM fpred JOIN lrmodel ON o = fold)""")
oracle("stacking_report", ",\n".join(_REPORT) + f"""
SELECT model, 'auc' AS metric, round(value, {D}) AS value FROM {auc_sql('sc', 'pred', 'y', 'model', 'value')} q""")

oracle("bucketed_join_oof", ORACLE["join_oof"])
oracle("bucketed_align_folds", ORACLE["align_fold_predictions"])
