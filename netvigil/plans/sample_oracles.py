"""DuckDB SQL for the sampling queries: full row_number rankings over md5."""

from __future__ import annotations

from netvigil.plans.score_oracles import label_sql
from netvigil.sources import fixtures

EV = "ev AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events)"
FL = (f"flows AS ({fixtures.FLOWS_SQL}),\n"
      f"fl AS (SELECT flow_id, label FROM (SELECT flow_id, {label_sql('open')} AS label FROM flows) "
      "WHERE label IS NOT NULL)")


def _md5(key: str) -> str:
    return f"md5(concat('42:', CAST({key} AS VARCHAR)))"


def _unit(key: str) -> str:
    return f"(CAST(('0x' || substr({_md5(key)}, 1, 13)) AS BIGINT) / 4503599627370496.0)"


def _ranked(src: str, key: str, cols: str) -> str:
    return (f"SELECT {cols}, label, row_number() OVER (PARTITION BY label ORDER BY {_md5(key)}, {key}) "
            f"AS rn FROM {src}")


ORACLES = {
    "balance_cap": f"""WITH {EV},
cnt AS (SELECT least(min(n), 500) AS t FROM (SELECT label, count(*) AS n FROM ev GROUP BY label))
SELECT event_id, label FROM ({_ranked('ev', 'event_id', 'event_id')}) WHERE rn <= (SELECT t FROM cnt)""",
    "balance_min": f"""WITH {FL},
cnt AS (SELECT min(n) AS t FROM (SELECT label, count(*) AS n FROM fl WHERE label IN (0, 1) GROUP BY label))
SELECT flow_id, label FROM ({_ranked('fl', 'flow_id', 'flow_id')}) WHERE label IN (0, 1)
  AND rn <= (SELECT t FROM cnt)""",
    "balance_target": f"""WITH {EV},
cnt AS (SELECT count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1 FROM ev),
p AS (SELECT CASE WHEN n0 <= n1 THEN 0 ELSE 1 END AS minority,
             CASE WHEN n0 <= n1 THEN n0 ELSE n1 END AS n_min FROM cnt),
params AS (SELECT minority, n_min, CAST(ceil(3000 / n_min) AS BIGINT) AS reps FROM p),
copies AS (SELECT e.event_id, e.label,
                  unnest(CASE WHEN e.label = params.minority THEN generate_series(1, params.reps)
                              ELSE [1] END) AS rep
           FROM ev e, params),
r AS (SELECT event_id, label, rep, row_number() OVER (
        PARTITION BY label ORDER BY md5(concat('42:', concat_ws('|', event_id, rep))), event_id, rep) AS rn
      FROM copies)
SELECT event_id, label, rep FROM r WHERE rn <= 3000""",
    "ratio_sample": f"""WITH {FL}
SELECT flow_id, label FROM ({_ranked('fl', 'flow_id', 'flow_id')})
WHERE (label = 1 AND rn <= 3000) OR (label = 0 AND rn <= 7000)""",
    "holdout": f"""WITH flows AS ({fixtures.FLOWS_SQL}),
sm AS (SELECT flow_id, label FROM (SELECT flow_id, {label_sql('small')} AS label FROM flows)
       WHERE label IS NOT NULL)
SELECT flow_id, label FROM ({_ranked('sm', 'flow_id', 'flow_id')})
WHERE (label = 1 AND rn <= 4999) OR (label = 0 AND rn <= 5000)""",
    "balance_to_class": f"""WITH {EV},
cnt AS (SELECT count(*) FILTER (WHERE label = 1) AS n_keep FROM ev),
r AS ({_ranked('ev', 'event_id', 'event_id')})
SELECT event_id, label FROM r WHERE rn <= (SELECT n_keep FROM cnt)""",
    "first_n_per_class": f"""WITH {EV}
SELECT event_id, label FROM (
  SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY event_id) AS rn FROM ev)
WHERE rn <= (SELECT least(500, min(n)) FROM (SELECT count(*) AS n FROM ev GROUP BY label))""",
    "split_exact": f"""WITH {EV},
cnt AS (SELECT label, count(*) AS n FROM ev GROUP BY label),
r AS ({_ranked('ev', 'event_id', 'event_id')})
SELECT r.event_id, r.label, CASE WHEN r.rn <= ceil(0.3 * c.n) THEN 'test' ELSE 'train' END AS split
FROM r JOIN cnt c ON c.label = r.label""",
    "split_hash": f"""WITH {EV}
SELECT event_id, label, CASE WHEN {_unit('event_id')} < 0.3 THEN 'test' ELSE 'train' END AS split FROM ev""",
    "sample_frac": f"""WITH {FL}
SELECT flow_id, label FROM fl WHERE {_unit('flow_id')} < 0.05""",
    "dedup_sample": f"""WITH flows AS ({fixtures.FLOWS_SQL}),
d AS (SELECT DISTINCT saddr, daddr, proto, state FROM flows)
SELECT * FROM d
WHERE (CAST(('0x' || substr(md5(concat('42:', concat_ws('|', saddr, daddr, proto, state))), 1, 13)) AS BIGINT)
       / 4503599627370496.0) < 0.3""",
}
