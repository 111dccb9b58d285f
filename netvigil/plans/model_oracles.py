"""DuckDB SQL for what SQL can state of the model queries."""

from __future__ import annotations

from netvigil.plans.sample_oracles import FL, _unit
from netvigil.plans.score_oracles import CONNLOG_LABEL, label_sql
from netvigil.sources import fixtures

TEST = f"{FL},\ntest AS (SELECT * FROM fl WHERE label IN (0, 1) AND {_unit('flow_id')} < 0.3)"

CLOSED = f"closed AS (SELECT {label_sql('closed')} AS label FROM ({fixtures.FLOWS_SQL}) f)"


def _held_out(share: str, counts: str) -> str:
    """Rows held out per class: the share of each, rounded up."""
    return f"""SELECT max(CASE WHEN label = 0 THEN CAST(ceil({share} * n) AS BIGINT) END) AS support_0,
       max(CASE WHEN label = 1 THEN CAST(ceil({share} * n) AS BIGINT) END) AS support_1, true AS in_unit FROM {counts}"""


ORACLES = {
    "model_checks": f"""WITH {TEST}
SELECT model, count(*) AS total_records, count(*) FILTER (WHERE label = 0) AS support_0, count(*) FILTER (WHERE label = 1) AS support_1,
  true AS in_unit, true AS ranks, true AS adds_up, true AS on_grid FROM test, (VALUES ('rf'), ('lr'), ('mlp')) AS m(model) GROUP BY model""",
    "connlog_supports": f"""WITH cl AS ({fixtures.CONNLOG_SQL}),
lab AS ({CONNLOG_LABEL}),
k AS (SELECT CAST(ceil(CAST(0.3 AS DOUBLE) * count(*)) AS BIGINT) AS n FROM lab WHERE attack = 1)
SELECT c AS class, CASE WHEN c IN ('0', '1') THEN n ELSE 2 * n END AS support, true AS in_unit
FROM k, (VALUES ('0'), ('1'), ('accuracy'), ('macro avg'), ('weighted avg')) AS v(c)""",
    "weighted_trainer": f"""WITH {FL},
c AS (SELECT label, count(*) AS n FROM fl WHERE label IN (0, 1) GROUP BY label)
{_held_out('CAST(0.25 AS DOUBLE)', 'c')}""",
    "scaled_forest_trainer": f"""WITH {CLOSED},
c AS (SELECT label, least(1000, min(count(*)) OVER ()) AS n FROM closed GROUP BY label)
{_held_out('CAST(0.3 AS DOUBLE)', 'c')}""",
    "model_roundtrip": f"""WITH {TEST}
SELECT count(*) AS rows_scored, CAST(0 AS BIGINT) AS rows_different, 'label' AS label_col FROM test""",
    "score_ranges": f"""WITH {TEST}
SELECT model, count(*) AS rows_scored, count(*) FILTER (WHERE label = 1) AS attacks, count(*) AS in_unit
FROM test, (VALUES ('rf'), ('lr'), ('mlp')) AS m(model) GROUP BY model""",
}
