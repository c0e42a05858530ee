"""Schemas of the relations that the operators exchange."""

from __future__ import annotations

_APP_TYPE = (
    "struct<dns:struct<qr:int,opcode:int,rcode:int,qname:string,qtype:int>,"
    "arp:struct<op:int,hwsrc:string,psrc:string,hwdst:string,pdst:string,is_gratuitous:boolean>,"
    "http_auth:struct<username:string,password:string>,"
    "ftp_cmd:struct<cmd:string,arg:string>>"
)
#: A packet: capture and place in it, time in seconds and in microseconds, addresses, and what its payload says.
PACKETS = (
    "capture string, seq long, ts double, us long, src_ip string, dst_ip string, src_mac string, dst_mac string, proto string,"
    f" src_port int, dst_port int, tcp_flags string, length int, app {_APP_TYPE}, malformed boolean"
)
#: The evidence of every detector in one struct; what a detector doesn't use is null.
EVIDENCE = {
    "scan_type": "string", "distinct_ports_count": "int", "total_probes": "long", "sample_ports": "array<int>", "probe_rate_per_sec": "double",
    "window_type": "string", "target_hosts_count": "int", "sample_target_hosts": "array<string>",
    "protocol": "string", "auth_type": "string", "username": "string", "password": "string", "target_port": "int",
    "parent_domain": "string", "unique_subdomains_count": "int", "max_entropy": "double", "max_label_length": "int", "txt_null_queries_count": "int",
    "total_queries_in_window": "int", "sample_queries": "array<string>", "single_query_trip": "boolean", "volume_trip": "boolean",
    "victim_ip": "string", "original_mac": "string", "spoofed_mac": "string", "all_known_macs": "array<string>", "is_gratuitous": "boolean",
    "change_type": "string", "arp_opcode": "int",
    "anomaly_score": "double", "raw_if_score": "double", "window_seconds": "double",
    "top_feature_contributors": "array<struct<feature:string,value:double,baseline_median:double,deviation:double>>",
    "connections_per_minute": "double", "distinct_dst_ips": "double", "distinct_dst_ports": "double", "syn_count": "double", "syn_to_synack_ratio": "double",
    "bytes_sent_received_ratio": "double", "mean_packet_length": "double", "dns_queries_per_minute": "double",
    "merged_alerts_count": "int",
}
EVIDENCE_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t in EVIDENCE.items()) + ">"
ALERTS = (
    "capture string, id string, detector string, severity string, severity_rank int, src string, dst string, start_us long, end_us long,"
    f" score double, summary string, evidence {EVIDENCE_TYPE}, emit_seq long, emit_ord int"
)
FEATURES = ("connections_per_minute", "distinct_dst_ips", "distinct_dst_ports", "syn_count", "syn_to_synack_ratio", "bytes_sent_received_ratio", "mean_packet_length", "dns_queries_per_minute")
DETECTORS = ("port_scan", "cleartext_creds", "arp_spoof", "dns_tunnel", "ml_anomaly")
SEVERITIES = ("HIGH", "MEDIUM", "LOW")
REDACTED = "***REDACTED***"
