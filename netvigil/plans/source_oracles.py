"""DuckDB SQL for source round trips."""

from netvigil.sources import fixtures

ORACLES = {
    "csv_roundtrip": f"""WITH flows AS ({fixtures.FLOWS_SQL})
SELECT flow_id, saddr, smac, attack, pkts, score FROM flows""",
}

from netvigil.plans.device_oracles import rollup_sql  # noqa: E402

ORACLES["stream_device_rollup"] = rollup_sql("both").replace(
    "SELECT device, total, anomalies, anomaly_rate, status, pkts, bytes, last_seen, top_attack FROM roll",
    "SELECT device, total, anomalies, anomaly_rate, status, pkts, bytes, last_seen FROM roll")
