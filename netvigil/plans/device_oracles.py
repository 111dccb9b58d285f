"""DuckDB SQL for the device queries (same semantics, written plainly)."""

from __future__ import annotations

import json

from netvigil.sources import fixtures, lookups


def _vendor_values() -> str:
    with open(lookups.DEFAULT_VENDOR_FILE, encoding="utf-8") as fh:
        data = json.load(fh)
    rows = ", ".join(f"('{k.strip().upper()}', '{v}')" for k, v in data.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(prefix, vendor)"


def _scored(threshold: float = 0.5) -> str:
    return (f"flows AS ({fixtures.FLOWS_SQL}),\n"
            f"scored AS (SELECT *, CASE WHEN score >= {threshold} THEN 1 ELSE 0 END AS pred FROM flows)")


def _long(mode: str) -> str:
    cols = "pred, pkts, bytes, ltime, smac, dmac, category AS attack, pkSeqID"
    parts = []
    if mode in ("src", "both"):
        parts.append(f"SELECT trim(saddr) AS dev, 0 AS role_rank, {cols} FROM scored")
    if mode in ("dst", "both"):
        rank = 1 if mode == "both" else 0
        parts.append(f"SELECT trim(daddr) AS dev, {rank} AS role_rank, {cols} FROM scored")
    body = "\n UNION ALL\n ".join(parts)
    return (f"long AS ({body}),\n"
            "clean AS (SELECT * FROM long WHERE dev IS NOT NULL AND dev <> '' AND dev <> 'nan')")


_ROLLUP = """
att AS (SELECT dev, NULLIF(trim(attack), '') AS attack, count(*) AS n_all, sum(pred) AS n_anom
        FROM clean GROUP BY 1, 2),
top_anom AS (SELECT dev, attack FROM (
    SELECT dev, attack, row_number() OVER (PARTITION BY dev ORDER BY n_anom DESC, attack) AS rn
    FROM att WHERE attack IS NOT NULL AND n_anom > 0) WHERE rn = 1),
top_all AS (SELECT dev, attack FROM (
    SELECT dev, attack, row_number() OVER (PARTITION BY dev ORDER BY n_all DESC, attack) AS rn
    FROM att WHERE attack IS NOT NULL) WHERE rn = 1),
roll0 AS (SELECT dev, count(*) AS total, CAST(sum(pred) AS BIGINT) AS anomalies,
                 CAST(sum(pkts) AS BIGINT) AS pkts, CAST(sum(bytes) AS BIGINT) AS bytes,
                 max(ltime) AS last_seen
          FROM clean GROUP BY dev),
roll AS (SELECT r.dev AS device, r.total, r.anomalies,
                CAST(r.anomalies AS DOUBLE) / r.total AS anomaly_rate,
                CASE WHEN r.anomalies > 0 THEN 'RED' ELSE 'GREEN' END AS status,
                r.pkts, r.bytes, r.last_seen, coalesce(a.attack, b.attack) AS top_attack
         FROM roll0 r LEFT JOIN top_anom a ON a.dev = r.dev LEFT JOIN top_all b ON b.dev = r.dev)"""


def _macs() -> str:
    parts = "string_split(replace(upper(trim(mac)), '-', ':'), ':')"
    return f"""
macs AS (SELECT dev, role_rank, ltime, pkSeqID, 0 AS side, smac AS mac FROM clean WHERE smac IS NOT NULL
         UNION ALL
         SELECT dev, role_rank, ltime, pkSeqID, 1 AS side, dmac AS mac FROM clean WHERE dmac IS NOT NULL),
first3 AS (SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dev, side
                                 ORDER BY role_rank, ltime NULLS LAST, pkSeqID NULLS LAST, mac) AS pos
    FROM macs) WHERE pos <= 3),
pref AS (SELECT *, CASE WHEN mac <> '' AND len({parts}) >= 3
                        THEN array_to_string({parts}[1:3], ':') END AS prefix FROM first3),
vend AS ({_vendor_values()}),
macinfo AS (SELECT p.dev AS device,
                   max(CASE WHEN side = 0 AND pos = 1 THEN mac END) AS smac,
                   max(CASE WHEN side = 1 AND pos = 1 THEN mac END) AS dmac,
                   arg_min(v.vendor, side * 10 + pos) FILTER (WHERE v.vendor IS NOT NULL) AS vendor
            FROM pref p LEFT JOIN vend v ON p.prefix = v.prefix GROUP BY p.dev)"""


_NAMES = f"""
dm AS ({fixtures.DEVICE_MAP_SQL}),
dm_clean AS (SELECT trim(ip) AS ip, NULLIF(trim(name), '') AS name, NULLIF(trim(type), '') AS dtype,
                    row_no FROM dm),
names AS (SELECT ip AS device, name, dtype FROM (
    SELECT *, row_number() OVER (PARTITION BY ip ORDER BY row_no DESC) AS rn
    FROM dm_clean WHERE ip IS NOT NULL AND ip <> '') WHERE rn = 1)"""


def rollup_sql(mode: str) -> str:
    return (f"WITH {_scored()},\n{_long(mode)},{_ROLLUP}\n"
            "SELECT device, total, anomalies, anomaly_rate, status, pkts, bytes, last_seen, top_attack "
            "FROM roll")


ORACLES = {
    "device_rollup_both": rollup_sql("both"),
    "device_rollup_src": rollup_sql("src"),
    "device_rollup_dst": rollup_sql("dst"),
    "device_top_attack": f"WITH {_scored()},\n{_long('both')},{_ROLLUP}\n"
                         "SELECT device, top_attack FROM roll",
    "device_vendor": f"WITH {_scored()},\n{_long('both')},{_macs()}\n"
                     "SELECT device, smac, dmac, vendor FROM macinfo",
    "device_named": f"WITH {_NAMES.strip()}\nSELECT device, name, dtype FROM names",
    "device_stats": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT count(DISTINCT saddr) AS unique_saddr, count(DISTINCT daddr) AS unique_daddr,
       (SELECT count(DISTINCT a) FROM (SELECT saddr AS a FROM flows UNION ALL SELECT daddr FROM flows))
         AS unique_union
FROM flows""",
    "device_report": f"WITH {_scored()},\n{_long('both')},{_ROLLUP},{_macs()},{_NAMES}\n"
                     """SELECT r.device, n.name, n.dtype, m.vendor, r.status, r.total, r.anomalies,
       r.anomaly_rate, r.top_attack, r.pkts, r.bytes, r.last_seen, m.smac, m.dmac
FROM roll r LEFT JOIN macinfo m ON m.device = r.device LEFT JOIN names n ON n.device = r.device""",
    "device_page": f"WITH {_scored()},\n{_long('both')},{_ROLLUP}\n"
                   """SELECT row_no, device, anomalies, bytes, status FROM (
    SELECT row_number() OVER (ORDER BY coalesce(bytes, 0) DESC, device) AS row_no, * FROM roll)
WHERE row_no BETWEEN 26 AND 50""",
    "device_page_last": f"WITH {_scored()},\n{_long('both')},{_ROLLUP}\n"
                        """SELECT row_no, device, anomalies, anomaly_rate FROM (
    SELECT row_number() OVER (ORDER BY coalesce(anomaly_rate, 0) DESC, device) AS row_no, count(*) OVER () AS n, * FROM roll)
WHERE row_no > (n - 1) // 10 * 10""",
    "device_stats_approx": "SELECT true AS unique_saddr_near, true AS unique_daddr_near, true AS unique_union_near",
    "device_search": f"WITH {_scored()},\n{_long('both')},{_ROLLUP}\n"
                     """SELECT device, top_attack, anomalies FROM roll
WHERE status = 'RED' AND (contains(lower(device), 'dos')
      OR contains(lower(coalesce(top_attack, '—')), 'dos') OR contains('', 'dos'))""",
    "mac_prefix": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT flow_id,
  CASE WHEN smac <> '' AND len(string_split(replace(upper(trim(smac)), '-', ':'), ':')) >= 3
       THEN array_to_string(string_split(replace(upper(trim(smac)), '-', ':'), ':')[1:3], ':') END
    AS smac_prefix,
  CASE WHEN dmac <> '' AND len(string_split(replace(upper(trim(dmac)), '-', ':'), ':')) >= 3
       THEN array_to_string(string_split(replace(upper(trim(dmac)), '-', ':'), ':')[1:3], ':') END
    AS dmac_prefix
FROM flows""",
}
