"""Fixed values that must equal the behaviour being reproduced.

FIXED VALUES — label maps, keyword lists, column lists and default
lookups.  They are listed plainly, in the order in which the original
tools declare them.  Nothing here is logic; the functions that use
them live in the sibling modules.
"""

# ---------------------------------------------------------------- labels
# Label texts (after lower-casing) per label profile.  1 = attack, 0 = normal.

# profile "closed": lower-case only, no trim; unknown text counts as attack
LABELS_CLOSED = {
    "normal": 0, "benign": 0,
    "attack": 1, "anomaly": 1,
    "ddos": 1, "dos": 1, "theft": 1,
    "scan": 1, "keylogging": 1, "data_exfiltration": 1,
}

# profile "open" (also "strict"): trim + lower, numeric fallback, else dropped
LABELS_OPEN = {
    "0": 0, "1": 1,
    "attack": 1, "attacks": 1, "anomaly": 1, "malicious": 1, "true": 1, "yes": 1,
    "normal": 0, "benign": 0, "false": 0, "no": 0,
}

# profile "named": open + attack family names, clipped to 0..1
LABELS_NAMED = {
    "0": 0, "1": 1,
    "normal": 0, "benign": 0,
    "attack": 1, "attacks": 1, "anomaly": 1, "malicious": 1,
    "ddos": 1, "dos": 1, "theft": 1,
    "scan": 1, "keylogging": 1, "data_exfiltration": 1,
    "true": 1, "yes": 1, "false": 0, "no": 0,
}

# profile "botnet": open + botnet
LABELS_BOTNET = {
    "1": 1, "0": 0,
    "attack": 1, "attacks": 1, "anomaly": 1, "malicious": 1, "botnet": 1,
    "true": 1, "yes": 1,
    "normal": 0, "benign": 0, "false": 0, "no": 0,
}

# profile "small": nine keys, no numeric fallback
LABELS_SMALL = {
    "1": 1, "0": 0, "attack": 1, "normal": 0, "benign": 0,
    "true": 1, "false": 0, "yes": 1, "no": 0,
}

# keyword labelling of conn-log tunnel_parents: benign wins, then any of these
KEYWORD_BENIGN = ["benign"]
KEYWORD_MALICIOUS = ["malicious", "okiru", "gafgyt", "mirai", "c&c", "ddos", "scan"]

# label column candidates, first present wins
LABEL_CANDIDATES_SAMPLE = ["label", "Label", "attack", "category", "class"]
LABEL_CANDIDATES_BALANCED = ["label", "Label", "attack", "class", "category"]
LABEL_CANDIDATES_TRAIN = ["attack", "label"]
LABEL_CANDIDATES_TESTSET = ["attack", "label", "Category", "category", "subcategory"]
LABEL_CANDIDATES_SERVICE = ["attack", "label"]

# label columns dropped once the canonical "label" exists
STALE_LABEL_COLUMNS = ["__y__", "attack", "Attack", "Label", "label.1", "category", "class"]

# -------------------------------------------------------------- features
# identifier columns dropped before training, per trainer
DROP_PREPROCESS = ["src_ip", "dst_ip", "sport", "dport", "state", "timestamp", "flow_id"]
DROP_COMBINED = ["pkSeqID", "stime", "ltime", "seq", "saddr", "daddr", "sport", "dport",
                 "smac", "dmac", "soui", "doui"]
DROP_BALANCED = ["pkSeqID", "stime", "ltime", "seq", "saddr", "daddr", "sport", "dport",
                 "smac", "dmac", "soui", "doui", "src_ip", "dst_ip", "timestamp", "flow_id"]
DROP_TRAIN = ["pkSeqID", "stime", "ltime", "seq", "saddr", "daddr", "sport", "dport",
              "smac", "dmac", "soui", "doui", "flow_id", "timestamp"]
DROP_CONNLOG = ["uid", "id.orig_h", "id.resp_h", "proto", "service", "label",
                "detailed-label", "tunnel_parents"]

# categorical guesses
CATEGORICAL_TRAIN = ["proto", "flgs", "state"]
CATEGORICAL_BALANCED = ["proto", "state", "service", "flgs"]

# conn-log model features, in model order
CONNLOG_FEATURES = ["ts", "id.orig_p", "id.resp_p", "duration", "orig_bytes", "resp_bytes",
                    "conn_state", "local_orig", "local_resp", "missed_bytes", "history",
                    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]

# --------------------------------------------------------------- devices
# MAC prefix -> vendor used when no vendor file can be read
VENDOR_DEFAULTS = {
    "00:1A:2B": "Cisco",
    "F4:92:BF": "Huawei",
    "44:65:0D": "Samsung",
    "D8:9E:F3": "Xiaomi",
    "BC:92:6B": "TP-Link",
}

# device grouping modes; anything else means "auto"
DEVICE_MODES = ["auto", "src", "dst", "both"]

# attack-name columns, first present wins
ATTACK_NAME_CANDIDATES = ["category", "subcategory"]

# device table sort options (all descending except device)
DEVICE_SORTS = ["anomalies_desc", "anomaly_rate_desc", "bytes_desc", "pkts_desc", "device_asc"]
DEVICE_PAGE_SIZES = [10, 25, 50, 100]
DEVICE_PAGE_SIZE_DEFAULT = 25

# ---------------------------------------------------------------- scores
THRESHOLD_DEFAULT = 0.5
THRESHOLD_AUTO_METRIC_DEFAULT = "youden"
# candidate thresholds: 99 evenly spaced values from 0.01 to 0.99 (numpy linspace)
THRESHOLD_GRID = (0.01, 0.99, 99)
MINMAX_EPS = 1e-8
ROC_MAX_POINTS = 500
PREVIEW_ROWS = 20
SEED = 42
