"""DuckDB statements for the modelling jobs SQL can express."""

from __future__ import annotations

from checks.oracle_catalogue import even, over
from checks.oracle_jobs import feature_ctes
from wardlens.models.columns import CATEGORICAL as CATS
from wardlens.models.columns import CLF_NUMERIC as CLF
from wardlens.models.columns import REG_NUMERIC as REG

RARE_BELOW = 60

_CLF_ROWS = f"clf AS (SELECT facility_id, {', '.join(CATS + CLF)}, CAST(is_underperformer AS DOUBLE) AS label FROM feat)"
_REG_ROWS = (
    f"reg AS (SELECT facility_id, {', '.join(CATS + REG)}, patient_star_avg AS label FROM feat"
    " WHERE patient_star_avg IS NOT NULL)"
)
_DRAW = "md5(facility_id || ':42')"
_REG_SPLIT = f"""rs AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {_DRAW}, facility_id) <= ceil(0.2 * count(*) OVER ())
  THEN 'test' ELSE 'train' END AS part FROM reg)"""
# Two classes: the test rows are shared out by largest remainder.
_CLF_SPLIT = f"""cn AS (SELECT label, count(*) AS n, ceil(0.2 * sum(count(*)) OVER ()) AS want, sum(count(*)) OVER () AS total
  FROM clf GROUP BY label),
 cq AS (SELECT label, want, floor(n * want / total) AS base, n * want / total - floor(n * want / total) AS rest FROM cn),
 cr AS (SELECT label, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= want - sum(base) OVER () THEN 1 ELSE 0 END
  AS quota FROM cq),
 cs AS (SELECT clf.*, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_DRAW}, facility_id) <= quota
  THEN 'test' ELSE 'train' END AS part FROM clf JOIN cr USING (label))"""
_REG_FOLDS = "rf AS (SELECT *, ntile(5) OVER (ORDER BY facility_id) - 1 AS fold FROM reg)"
_CLF_FOLDS = """lab AS (SELECT label, min(facility_id) AS first_id FROM clf GROUP BY label),
 laid AS (SELECT clf.*, row_number() OVER (PARTITION BY label ORDER BY facility_id) AS j,
  row_number() OVER (ORDER BY first_id, facility_id) - 1 AS place FROM clf JOIN lab USING (label)),
 sized AS (SELECT label, place % 5 AS fold, count(*) AS n FROM laid GROUP BY ALL),
 ends AS (SELECT label, fold, sum(n) OVER (PARTITION BY label ORDER BY fold) AS last_j,
  sum(n) OVER (PARTITION BY label ORDER BY fold) - n AS before_j FROM sized),
 cf AS (SELECT laid.* EXCLUDE (j, place), ends.fold FROM laid JOIN ends ON laid.label = ends.label AND j > before_j AND j <= last_j)"""


def _feat(body: str) -> str:
    return over("hts", f"@{feature_ctes()}, {_CLF_ROWS}, {_REG_ROWS}{body}")


def _slot(c: str) -> str:
    return f"'{c}_' || CASE WHEN n_{c} >= {RARE_BELOW} THEN {c} ELSE 'other' END"


_COUNTED = "cnt AS (SELECT *, " + ", ".join(f"count(*) OVER (PARTITION BY {c}) AS n_{c}" for c in CATS) + " FROM clf)"
_FULL = "full_rows AS (SELECT facility_id, " + ", ".join(
    f"coalesce({c}, (SELECT median({c}) FROM clf)) AS {c}" for c in CLF
) + " FROM clf)"


def _names() -> str:
    """Frequent levels by falling count then text, the pooled level, then the numbers."""
    parts = []
    for i, c in enumerate(CATS):
        parts.append(
            f"SELECT {i} AS g, 0 AS rare, count(*) AS n, '{c}_' || {c} AS feature FROM clf GROUP BY {c} HAVING count(*) >= {RARE_BELOW}"
        )
        parts.append(
            f"SELECT DISTINCT {i}, 1, 0, '{c}_other' FROM cnt WHERE n_{c} < {RARE_BELOW}"
        )
    for i, c in enumerate(CLF):
        parts.append(f"SELECT {len(CATS) + i}, 0, 0, '{c}'")
    return (
        f", {_COUNTED}, nm AS ({' UNION ALL '.join(parts)}) "
        "SELECT row_number() OVER (ORDER BY g, rare, n DESC, feature) - 1 AS position, feature FROM nm"
    )


def models() -> dict[str, str]:
    shown = ", ".join(CATS)
    fold_mean = """fm AS (SELECT a.fold, avg(b.label) AS m FROM (SELECT DISTINCT fold FROM rf) a JOIN rf b ON a.fold <> b.fold GROUP BY a.fold),
 fr AS (SELECT rf.fold, 1 - sum((label - m) * (label - m)) / (var_pop(label) * count(*)) AS r2 FROM rf JOIN fm USING (fold) GROUP BY rf.fold)"""
    return {
        "m_select": _feat(f" SELECT {shown}, {', '.join(CLF)} FROM feat"),
        "m_select_reg": _feat(f" SELECT {shown}, {', '.join(REG)} FROM feat"),
        "m_features": _feat(" SELECT * FROM clf"),
        "m_features_reg": _feat(" SELECT * FROM reg"),
        "m_encode": _feat(
            f", {_COUNTED} SELECT facility_id, array_to_string(list_sort([{', '.join(_slot(c) for c in CATS)}]), '|') AS slots FROM cnt"
        ),
        "m_impute": _feat(f", {_FULL} SELECT facility_id, {', '.join(f'{even(c, 6)} AS {c}' for c in CLF)} FROM full_rows"),
        "m_scale": _feat(
            f", {_FULL} SELECT facility_id, "
            + ", ".join(f"{even(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', 6)} AS {c}" for c in CLF)
            + " FROM full_rows"
        ),
        "m_names": _feat(_names()),
        "m_split": _feat(f", {_REG_SPLIT} SELECT facility_id, label, part FROM rs"),
        "m_split_stratified": _feat(f", {_CLF_SPLIT} SELECT facility_id, label, part FROM cs"),
        "m_folds": _feat(f", {_REG_FOLDS} SELECT facility_id, label, fold FROM rf"),
        "m_folds_stratified": _feat(f", {_CLF_FOLDS} SELECT facility_id, label, fold FROM cf"),
        "m_baseline": _feat(
            f""", {_REG_SPLIT} SELECT facility_id, label, {even("(SELECT avg(label) FROM rs WHERE part = 'train')", 9)} AS prediction
 FROM rs WHERE part = 'test'"""
        ),
        "m_baseline_majority": _feat(
            f""", {_CLF_SPLIT} SELECT facility_id, label,
 (SELECT label FROM cs WHERE part = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS prediction
 FROM cs WHERE part = 'test'"""
        ),
        "m_cv_baseline": _feat(
            f""", {_REG_FOLDS}, {fold_mean}
SELECT 'regression' AS task, 'r2' AS scoring, 'Baseline (mean)' AS model, round(avg(r2), 4) AS cv_mean,
 round(stddev_pop(r2), 4) AS cv_std FROM fr
UNION ALL SELECT 'classification', 'roc_auc', 'Baseline (majority)', 0.5::DOUBLE, 0::DOUBLE"""
        ),
    }
