"""Named parameter sets (C6) and their mapping to ``BoostParams``.

Encoder knobs (``smoothing``, ``noise_level``) are popped out of a model's
parameters before the booster sees them.  Leaf limits mean leaf-wise growth;
the symmetric family splits whole levels; device and thread settings are the
cluster's business.
"""

from __future__ import annotations

from dataclasses import replace

from ..operators.boost import BoostParams

# Hyper-parameter sets, with rounds / early-stopping patience where the scripts set them.
REGISTRY: dict[str, dict] = {
    "bin_hist_1": dict(l2_regularization=0.01733562332605339, learning_rate=0.07514670676521666, max_iter=1000, max_depth=4,
                       min_samples_leaf=29, max_leaf_nodes=19, random_state=42, smoothing=0.6850682577365309,
                       noise_level=0.0076208026336182545, objective="logistic"),
    "bin_leafwise_1": dict(learning_rate=0.0966720009827347, max_depth=5, reg_alpha=7.646234504355554, reg_lambda=0.15022879711661294,
                       num_leaves=15, colsample_bytree=0.9354973347421695, rounds=1000, patience=100),
    "bin_leafwise_2": dict(learning_rate=0.08730554809151961, max_depth=5, reg_alpha=7.629939855032208, reg_lambda=0.05407575333210989,
                       num_leaves=23, colsample_bytree=0.6235800053301607, rounds=1000, patience=100),
    "bin_leafwise_3": dict(learning_rate=0.09998487056450626, max_depth=5, reg_alpha=5.876801609796171, reg_lambda=0.03194501388706304,
                       num_leaves=24, colsample_bytree=0.6397508847379295, rounds=1000, patience=100),
    "bin_leafwise_4": dict(learning_rate=0.09765029857418714, max_depth=6, reg_alpha=9.543498850760129, reg_lambda=8.495250045623626,
                       num_leaves=23, colsample_bytree=0.603870803458922, rounds=1000, patience=100),
    "bin_leafwise_5": dict(learning_rate=0.12152492033540772, max_depth=4, reg_alpha=6.926015524352944, reg_lambda=9.990268389998137,
                       num_leaves=25, colsample_bytree=0.6865041358682433, subsample=0.7054327393072288, min_child_samples=45,
                       smoothing=0.27555233813494145, noise_level=0.006584592103465401, rounds=1000, patience=100),
    "bin_leafwise_6": dict(learning_rate=0.14574066721987344, max_depth=4, reg_alpha=0.6387499829029953, reg_lambda=0.010270309848469737,
                       num_leaves=26, colsample_bytree=0.8272526514202877, subsample=0.7027683761760808, min_child_samples=50,
                       smoothing=4.473232442358369, noise_level=0.03329881499218803, rounds=1000, patience=100),
    "bin_leafwise_7": dict(learning_rate=0.1124121813710808, max_depth=4, reg_alpha=9.710588297053341, reg_lambda=0.30919961518106104,
                       num_leaves=26, colsample_bytree=0.6009768997648857, subsample=0.890955039393104, min_child_samples=31,
                       smoothing=0.3726080918817735, noise_level=0.01646934814667607, rounds=1000, patience=100),
    "bin_depthwise_1": dict(max_depth=8, learning_rate=0.01293135558370836, gamma=0.271071018794089, min_child_weight=37,
                       colsample_bytree=0.8, reg_lambda=8.074580873225932, reg_alpha=0.615398224096162, rounds=1000, patience=100),
    "bin_depthwise_2": dict(max_depth=11, learning_rate=0.014888815587019282, gamma=0.062487392993290314, min_child_weight=34,
                       colsample_bytree=0.6, reg_lambda=2.976059681891355, reg_alpha=7.40850302183151, rounds=2000, patience=150),
    "bin_depthwise_3": dict(max_depth=8, learning_rate=0.01743061164700545, gamma=0.05367436158322553, min_child_weight=39,
                       colsample_bytree=0.7, reg_lambda=9.852809220595176, reg_alpha=4.347223030038844, rounds=2000, patience=100),
    "bin_depthwise_4": dict(max_depth=9, learning_rate=0.018222771612109747, gamma=0.022992523309746105, min_child_weight=46,
                       colsample_bytree=0.7, reg_lambda=6.089668883675993, reg_alpha=6.35141073411683, rounds=2000, patience=100),
    "bin_depthwise_5": dict(max_depth=5, learning_rate=0.04401817650540594, gamma=0.10305882552604473, min_child_weight=39,
                       colsample_bytree=0.8, reg_lambda=1.4448644594554028, reg_alpha=9.479310936823271, smoothing=0.3024290135590247,
                       noise_level=0.03556370617715808, rounds=1000, patience=100),
    "reg_leafwise_1": dict(learning_rate=0.09422182900073163, max_depth=6, reg_alpha=2.111326313090215, reg_lambda=5.32629340512962,
                      num_leaves=15, colsample_bytree=0.9267150127563124, rounds=1000, patience=100),
    "reg_leafwise_2": dict(learning_rate=0.09066181426290201, max_depth=5, reg_alpha=0.02973421418700197, reg_lambda=2.260451658634028,
                      num_leaves=20, colsample_bytree=0.7901487502240994, rounds=1000, patience=100),
    "reg_leafwise_3": dict(learning_rate=0.09257679474290241, max_depth=5, reg_alpha=0.02416818671268253, reg_lambda=0.6930968146965372,
                      num_leaves=22, colsample_bytree=0.8424807137427762, rounds=1000, patience=100),
    "reg_depthwise_1": dict(max_depth=7, learning_rate=0.052105375310238025, gamma=2.0980714582486693, min_child_weight=74,
                      colsample_bytree=0.7, reg_lambda=6.1942349015891764, reg_alpha=2.0877130801722488, rounds=1000, patience=100),
    "reg_depthwise_2": dict(max_depth=8, learning_rate=0.03792905076492685, gamma=2.723625807829389, min_child_weight=83,
                      colsample_bytree=0.6, reg_lambda=3.5803877884369237, reg_alpha=4.217209981350277, rounds=1000, patience=100),
    "reg_depthwise_3": dict(max_depth=7, learning_rate=0.04541499486581436, gamma=2.6546486024073404, min_child_weight=90,
                      colsample_bytree=0.8, reg_lambda=7.2914042086797615, reg_alpha=9.280202100596322, rounds=1000, patience=100),
    "reg_depthwise_4": dict(max_depth=6, learning_rate=0.072739718403206, gamma=1.7888938355292365, min_child_weight=89,
                      colsample_bytree=0.6, reg_lambda=2.2420868353220964, reg_alpha=2.4916117766200605, rounds=1000, patience=100),
    "cls_leafwise_a": dict(n_estimators=998, learning_rate=0.11239530686383664, num_leaves=35, max_depth=3,
                       min_child_samples=50, subsample=0.7094235914815041, colsample_bytree=0.9939521128432284,
                       reg_alpha=0.9844372637384456, reg_lambda=0.0022962114949080514, random_state=42, objective="logistic"),
    "cls_depthwise_a": dict(n_estimators=943, learning_rate=0.09717789596330055, max_depth=3, subsample=0.8312966962670887,
                      colsample_bytree=0.6067405874013712, gamma=0.4597939772867661, min_child_weight=6, random_state=42,
                      objective="logistic"),
    "cls_symmetric_a": dict(max_depth=4, objective="logistic"),
    "cls_leafwise_b": dict(n_estimators=783, learning_rate=0.11232301086863652, num_leaves=40, max_depth=3,
                       min_child_samples=64, subsample=0.9346504089353533, colsample_bytree=0.6144043725950896,
                       reg_alpha=0.2693234207150637, reg_lambda=0.3303738446455776, random_state=42, objective="logistic"),
    "cls_depthwise_b": dict(n_estimators=832, max_depth=7, learning_rate=0.013432781360505153, subsample=0.7711052834966381,
                      random_state=42, objective="logistic"),
    "cls_symmetric_b": dict(max_depth=2, objective="logistic"),
    "reg_trees_1": dict(num_trees=1000),
}

_ALIASES = {
    "learning_rate": "learning_rate", "max_depth": "max_depth", "reg_alpha": "reg_alpha",
    "reg_lambda": "reg_lambda", "l2_regularization": "reg_lambda", "gamma": "gamma",
    "min_child_weight": "min_child_weight", "min_child_samples": "min_child_samples",
    "min_samples_leaf": "min_child_samples", "subsample": "subsample",
    "colsample_bytree": "colsample_bytree", "objective": "objective", "random_state": "seed",
    "rounds": "n_trees", "n_estimators": "n_trees", "max_iter": "n_trees", "num_trees": "n_trees",
    "patience": "early_stopping", "num_leaves": "max_leaves", "max_leaf_nodes": "max_leaves",
}


# What a parameter set leaves out follows its trainer's own defaults (fixed values).
_FAMILY = {
    "leafwise": {"reg_lambda": 0.0, "min_child_samples": 20, "min_child_weight": 1e-3, "n_trees": 100, "learning_rate": 0.1,
                 "max_leaves": 31, "max_depth": -1},
    "depthwise": {"reg_lambda": 1.0, "min_child_samples": 1, "min_child_weight": 1.0, "n_trees": 100, "learning_rate": 0.3,
                  "max_depth": 6},
    "symmetric": {"reg_lambda": 3.0, "min_child_samples": 1, "n_trees": 1000, "max_depth": 6, "symmetric": True},
    "hist": {"reg_lambda": 0.0, "min_child_samples": 20, "n_trees": 100, "learning_rate": 0.1, "max_leaves": 31, "max_depth": -1,
             "validation_fraction": 0.1, "early_stopping": 10},
    "trees": {"reg_lambda": 0.0, "min_child_samples": 5, "n_trees": 300, "learning_rate": 0.1, "max_depth": 6,
              "validation_fraction": 0.1, "early_stopping": 30},
}


def _family(name: str) -> dict:
    return next((dict(v) for k, v in _FAMILY.items() if f"_{k}_" in f"_{name}_"), {})


def model_spec(name_or_params, **overrides) -> tuple[BoostParams, dict]:
    """``(BoostParams, encoder_knobs)`` for a registry name or a raw parameter dict.

    ``overrides`` replace BoostParams fields (e.g. ``n_trees=10`` in tests).  Unknown keys are errors.
    """
    raw = dict(REGISTRY[name_or_params] if isinstance(name_or_params, str) else name_or_params)
    enc = {k: raw.pop(k) for k in ("smoothing", "noise_level") if k in raw}
    kw = _family(name_or_params) if isinstance(name_or_params, str) else {}
    for k, v in raw.items():
        if k in _ALIASES:
            kw[_ALIASES[k]] = v
        else:
            raise ValueError(f"unknown parameter {k!r}")
    p = BoostParams(**kw)
    return replace(p, **overrides), enc
