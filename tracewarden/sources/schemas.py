"""Explicit schemas of the file sources."""

# Access log: status and sizes arrive as text and are cast leniently.
ACCESS_LOG = (
    "timestamp string, remote_addr string, remote_user string, request_method string, request_uri string,"
    " server_protocol string, status string, body_bytes_sent string, request_length string, http_referer string,"
    " http_user_agent string, http_x_forwarded_for string, request_time double, upstream_response_time string,"
    " upstream_addr string, gzip_ratio string, _corrupt_record string"
)
LABELLED_SCORES = "ml_score double, z_score double, rule_score double, label int"
# Flow events: default of every column that may be absent.
FLOW_DEFAULTS = {
    "bytes_in": 0,
    "bytes_out": 0,
    "dst_port": 0,
    "domain": "",
    "is_nxdomain": 0,
    "failed_login": 0,
    "fortiguard_hit": 0,
    "cvss_score": 0.0,
    "is_vuln": 0,
    "src_ip": "unknown",
}
# Access-log fields and the other names they may arrive under, best first, with the final default.
FIELD_ALIASES = {
    "remote_addr": (("remote_addr", "clientip"), "0.0.0.0"),
    "request_method": (("request_method", "verb"), "GET"),
    "request_uri": (("request_uri", "request"), ""),
    "status": (("status",), 200),
    "http_user_agent": (("http_user_agent", "agent"), ""),
    "body_bytes_sent": (("body_bytes_sent", "bytes"), 0),
    "timestamp": (("@timestamp", "timestamp", "time_local"), None),
}
# Detection thresholds used while no profile has been learned.
DEFAULT_THRESHOLDS = {
    "rate_limit_req_per_min": 30.0,
    "error_rate_threshold": 0.30,
    "rate_4xx_threshold": 0.25,
    "rate_5xx_threshold": 0.10,
    "entropy_scan_threshold": 1.0,
}
