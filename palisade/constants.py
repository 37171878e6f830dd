"""Thresholds, weights, time-to-live settings, label sets and word lists.

Results depend on these exact values, so they are stated plainly and used by name.
"""

# Graduated response: lowest score of each action.
ACTION_FLOORS = [("BLOCK", 0.70), ("CAPTCHA", 0.50), ("THROTTLE", 0.35), ("DELAY", 0.25)]
ACTION_DEFAULT = "ALLOW"

# Layer fusion.
WEIGHT_REGEX = 0.20
WEIGHT_CLASSIFIER = 0.35
WEIGHT_ANOMALY = 0.25
WEIGHT_NETWORK = 0.20
WEIGHT_NETWORK_CLASSIFIER = 0.55
WEIGHT_NETWORK_ANOMALY = 0.45
NETWORK_THREAT_FLOOR = 0.35
ANALYSIS_FLOOR = 0.65

# Seconds.
TTL_NETWORK_THREAT = 60
TTL_BLACKLIST = 3600
TTL_CAPTCHA = 300
TTL_RATE = 60
TTL_REQUEST_LOG = 120
CORRELATION_WINDOW = 10
CORRELATION_RETENTION = 60
CORRELATION_HISTORY_CAP = 50

RATE_LIMIT_SESSION = 100
RATE_LIMIT_SLIDING = 120

# Packets to flows.
FLOW_IDLE_SECONDS = 30
FLOW_MAX_SECONDS = 120
FLOW_MIN_PACKETS = 4
IDLE_GAP_SECONDS = 1
FLAG_FIN, FLAG_SYN, FLAG_RST, FLAG_PSH, FLAG_ACK = 1, 2, 4, 8, 16

# Sink batching.
FLUSH_ROWS = 50
FLUSH_SECONDS = 5
NEWEST_EVENTS_CAP = 10_000
RULE_RELOAD_SECONDS = 30
MAX_ADAPTIVE_RULES = 500

LAYER_STATIC = "layer0_firewall"
LAYER_REGEX = "layer1_regex"
LAYER_CLASSIFIER = "layer2_lgbm"
LAYER_ANOMALY = "layer2_cnn"
LAYER_NETWORK = "network_ips"

# Labels that do not name an attack, per consumer.
BENIGN_EVENT_LABELS = ["clean", "norm", "normal", ""]
BENIGN_CHART_LABELS = ["clean", "norm", "normal", "unknown", ""]
BENIGN_CORRELATION_TYPES = ["clean", "norm", "normal", "benign", "unknown", ""]
NORMAL_LABELS = ["norm", "clean", "normal", "benign"]

CORRELATION_MULTIPLIERS = {1: 1.0, 2: 1.3, 3: 1.5}
CORRELATION_MULTIPLIER_MAX = 1.7

# The 16 flow features, in model order.
FLOW_FEATURES = [
    "flow duration", "total fwd packets", "total backward packets",
    "total length of fwd packets", "total length of bwd packets",
    "fwd packet length mean", "bwd packet length mean",
    "flow bytes/s", "flow packets/s",
    "syn flag count", "ack flag count", "psh flag count",
    "packet length mean", "packet length std", "idle mean", "idle std",
]

# The 32 unified flow columns and the capture tool's spelling of each (None: not captured, imputed).
UNIFIED_FEATURES = {
    "flow_duration": "Flow Duration",
    "total_fwd_packets": "Total Fwd Packets",
    "total_bwd_packets": "Total Backward Packets",
    "total_fwd_bytes": "Total Length of Fwd Packets",
    "total_bwd_bytes": "Total Length of Bwd Packets",
    "flow_bytes_per_sec": "Flow Bytes/s",
    "flow_pkts_per_sec": "Flow Packets/s",
    "fwd_pkts_per_sec": "Fwd Packets/s",
    "bwd_pkts_per_sec": "Bwd Packets/s",
    "pkt_len_mean": "Packet Length Mean",
    "pkt_len_std": "Packet Length Std",
    "pkt_len_max": "Max Packet Length",
    "pkt_len_min": "Min Packet Length",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "fwd_iat_mean": "Fwd IAT Mean",
    "bwd_iat_mean": "Bwd IAT Mean",
    "fin_flag_count": "FIN Flag Count",
    "syn_flag_count": "SYN Flag Count",
    "rst_flag_count": "RST Flag Count",
    "psh_flag_count": "PSH Flag Count",
    "ack_flag_count": "ACK Flag Count",
    "init_win_fwd": "Init_Win_bytes_forward",
    "init_win_bwd": "Init_Win_bytes_backward",
    "fwd_ttl_mean": None,
    "bwd_ttl_mean": None,
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "down_up_ratio": "Down/Up Ratio",
}
IMPUTED_TTL = 64.0
RATE_FEATURES = ["flow_bytes_per_sec", "flow_pkts_per_sec", "fwd_pkts_per_sec", "bwd_pkts_per_sec"]

# Second spellings used by the later corpus; the first spelling is in UNIFIED_FEATURES.
SECOND_SPELLINGS = {
    "total_fwd_packets": "Tot Fwd Pkts",
    "total_bwd_packets": "Tot Bwd Pkts",
    "total_fwd_bytes": "TotLen Fwd Pkts",
    "total_bwd_bytes": "TotLen Bwd Pkts",
    "flow_bytes_per_sec": "Flow Byts/s",
    "flow_pkts_per_sec": "Flow Pkts/s",
    "fwd_pkts_per_sec": "Fwd Pkts/s",
    "bwd_pkts_per_sec": "Bwd Pkts/s",
    "pkt_len_mean": "Pkt Len Mean",
    "pkt_len_std": "Pkt Len Std",
    "pkt_len_max": "Pkt Len Max",
    "pkt_len_min": "Pkt Len Min",
    "fwd_pkt_len_mean": "Fwd Pkt Len Mean",
    "bwd_pkt_len_mean": "Bwd Pkt Len Mean",
    "fwd_pkt_len_std": "Fwd Pkt Len Std",
    "bwd_pkt_len_std": "Bwd Pkt Len Std",
    "fin_flag_count": "FIN Flag Cnt",
    "syn_flag_count": "SYN Flag Cnt",
    "rst_flag_count": "RST Flag Cnt",
    "psh_flag_count": "PSH Flag Cnt",
    "ack_flag_count": "ACK Flag Cnt",
    "init_win_fwd": "Init Fwd Win Byts",
    "init_win_bwd": "Init Bwd Win Byts",
    "idle mean": "Idle Mean",
    "idle std": "Idle Std",
}

# Raw label -> class, first corpus (known attacks) and its out-of-class labels.
KNOWN_LABELS = {
    "BENIGN": "benign",
    "DDoS": "ddos",
    "DoS Hulk": "dos",
    "DoS GoldenEye": "dos",
    "DoS slowloris": "dos",
    "DoS Slowhttptest": "dos",
    "PortScan": "portscan",
    "Bot": "botnet",
}
NOVEL_LABELS = [
    "Heartbleed",
    "Infiltration",
    "Web Attack \x96 Brute Force",
    "Web Attack \x96 XSS",
    "Web Attack \x96 Sql Injection",
    "Web Attack \xe2\x80\x93 Brute Force",
    "Web Attack \xe2\x80\x93 XSS",
    "Web Attack \xe2\x80\x93 Sql Injection",
    "Web Attack – Brute Force",
    "Web Attack – XSS",
    "Web Attack – Sql Injection",
    "FTP-Patator",
    "SSH-Patator",
]

# Raw label -> class, second corpus; anything else is "other".
SECOND_CORPUS_LABELS = {
    "benign": "benign", "Benign": "benign", "BENIGN": "benign",
    "DDOS attack-HOIC": "ddos", "DDOS attack-LOIC-UDP": "ddos",
    "DDoS attacks-LOIC-HTTP": "ddos", "DDoS-LOIC-UDP": "ddos", "DDoS-HOIC": "ddos",
    "DoS attacks-Hulk": "dos", "DoS attacks-SlowHTTPTest": "dos",
    "DoS attacks-Slowloris": "dos", "DoS attacks-GoldenEye": "dos",
    "DoS-GoldenEye": "dos", "DoS-Hulk": "dos", "DoS-Slowloris": "dos", "DoS-SlowHTTPTest": "dos",
    "FTP-BruteForce": "bruteforce", "SSH-Bruteforce": "bruteforce",
    "Brute Force -Web": "bruteforce", "Brute Force -XSS": "bruteforce", "XSS": "bruteforce",
    "SQL Injection": "sqli",
    "Infilteration": "infiltration", "Infiltration": "infiltration",
    "Bot": "botnet",
}

BENIGN_TOKENS = ["benign", "normal", "0", "no", "none", "normal flow"]
BLANK_TOKENS = ["", "nan", "none", "na"]
LABEL_COLUMN_NAMES = ["label", "Label", "attack", "Attack", "class", "Class", "flow_label", "Flow ID"]
IDENTIFIER_COLUMNS = ["flow_id", "id", "timestamp", "start_time", "end_time", "time", "flow_id.1"]
NON_NUMERIC_COLUMNS = [
    "srcip", "proto", "service", "state", "dstip", "Timestamp", "Flow ID", "Label",
    "attack_cat", "attack_category", "id", "start_time", "end_time",
]

# Headerless connection records.
CONNECTION_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root", "num_file_creations",
    "num_shells", "num_access_files", "num_outbound_cmds", "is_host_login",
    "is_guest_login", "count", "srv_count", "serror_rate", "srv_serror_rate",
    "rerror_rate", "srv_rerror_rate", "same_srv_rate", "diff_srv_rate",
    "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
    "dst_host_srv_diff_host_rate", "dst_host_serror_rate", "dst_host_srv_serror_rate",
    "dst_host_rerror_rate", "dst_host_srv_rerror_rate", "label", "difficulty",
]
CONNECTION_CATEGORICALS = ["protocol_type", "service", "flag"]

# Attack label -> technique id, name, tactic.
TECHNIQUES = {
    "sqli": ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    "sql_injection": ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    "xss": ("T1059.007", "Command and Scripting: JavaScript", "Execution"),
    "cmdi": ("T1059", "Command and Scripting Interpreter", "Execution"),
    "command_injection": ("T1059", "Command and Scripting Interpreter", "Execution"),
    "path_traversal": ("T1083", "File and Directory Discovery", "Discovery"),
    "path-traversal": ("T1083", "File and Directory Discovery", "Discovery"),
    "rce": ("T1059", "Command and Scripting Interpreter", "Execution"),
    "portscan": ("T1046", "Network Service Scanning", "Discovery"),
    "port_scan": ("T1046", "Network Service Scanning", "Discovery"),
    "ddos": ("T1498", "Network Denial of Service", "Impact"),
    "botnet": ("T1583.005", "Acquire Infrastructure: Botnet", "Resource Development"),
    "anomaly": ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    "zeroday": ("T1190", "Exploit Public-Facing Application (Zero-Day)", "Initial Access"),
    "zero-day": ("T1190", "Exploit Public-Facing Application (Zero-Day)", "Initial Access"),
    "unknown": ("T1190", "Exploit Public-Facing Application (Unknown)", "Initial Access"),
}
KILL_CHAIN = {
    "Initial Access": "Exploitation",
    "Execution": "Exploitation",
    "Persistence": "Installation",
    "Privilege Escalation": "Exploitation",
    "Defense Evasion": "Command & Control",
    "Credential Access": "Exploitation",
    "Discovery": "Reconnaissance",
    "Lateral Movement": "Lateral Movement",
    "Collection": "Actions on Objectives",
    "Command and Control": "Command & Control",
    "Exfiltration": "Actions on Objectives",
    "Impact": "Actions on Objectives",
    "Resource Development": "Weaponization",
}

# Network-owner words searched in organisation and provider names.
VPN_WORDS = ["vpn", "nordvpn", "expressvpn", "mullvad"]
HOSTING_WORDS = ["hosting", "digitalocean", "linode", "vultr", "hetzner", "amazon", "google", "microsoft", "ovh"]

# Paths that are served but never scored.
SKIP_PREFIXES = [
    "/health", "/docs", "/openapi.json", "/redoc", "/status", "/demo",
    "/api/inspect", "/api/stats", "/api/events", "/api/admin",
    "/api/myip", "/api/geoip", "/api/ai-analysis", "/api/adaptive-rules",
]
