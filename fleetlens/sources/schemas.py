"""Declared schemas of the posted records; nothing is inferred in production paths."""

from __future__ import annotations

# byte counters are unsigned 64-bit numbers
U64 = "decimal(20,0)"

DISKS = f"array<struct<device:string,mountpoint:string,fs_type:string,total_bytes:{U64},used_bytes:{U64},used_percent:double>>"
NETWORK_INTERFACES = "array<struct<name:string,mac:string,is_up:boolean,ipv4:array<string>,ipv6:array<string>>>"
NETWORK_COUNTERS = f"array<struct<name:string,rx_bytes:{U64},tx_bytes:{U64}>>"
DISK_LATENCY = "array<struct<device:string,read_latency_ms:double,write_latency_ms:double,read_iops:double,write_iops:double>>"
TOP_PROCESSES = f"array<struct<pid:int,name:string,state:string,cpu_percent:double,rss_bytes:{U64}>>"

HEARTBEAT = (
    "server_id string, agent_version string, hostname string, pid int, timestamp timestamp, privilege_mode string, "
    f"cpu_percent double, memory_percent double, memory struct<total_bytes:{U64},used_bytes:{U64},available_bytes:{U64},cached_bytes:{U64},used_percent:double>, "
    f"has_multiple_disks boolean, disk_used_percent_root double, disks {DISKS}, network_interfaces {NETWORK_INTERFACES}, "
    f"network_counters {NETWORK_COUNTERS}, disk_latency {DISK_LATENCY}, disk_latency_avg map<string,double>, "
    f"top_processes_cpu {TOP_PROCESSES}, top_processes_mem {TOP_PROCESSES}, "
    "os_info struct<distro:string,version:string,arch:string>, detected_capabilities map<string,boolean>, capabilities map<string,string>"
)

CHECK_RESULT = (
    "monitor_id:string,checked_at:timestamp,status:string,latency_ms:bigint,details:variant,active_state:string,"
    "service_name:string,service_type:string"
)
CHECK_BATCH = f"server_id string, results array<struct<{CHECK_RESULT}>>"

DISCOVERY = (
    "server_id string, discovered_at timestamp, "
    "services array<struct<name:string,type:string,unit:string,pid:int,state:string,ports:array<int>,meta:variant>>"
)
REMEDIATION_LOG = (
    "server_id string, monitor_id string, incident_id string, playbook_id string, trigger string, success boolean, "
    "steps array<struct<order:int,command:string,exit_code:int,output:string,duration_ms:bigint>>, verification variant, "
    "started_at timestamp, finished_at timestamp"
)
OPS_RESULT = (
    "run_id string, server_id string, status string, "
    "step_results array<struct<step_id:string,action:string,status:string,output:string,error:string,started_at:timestamp,finished_at:timestamp,changed:boolean>>, "
    "output string, error string, started_at timestamp, finished_at timestamp"
)
AUDIT_RESULT = (
    "run_id string, server_id string, agent_id string, started_at timestamp, finished_at timestamp, "
    "results array<struct<check_key:string,check_definition_id:string,status:string,severity:string,confidence:double,raw_output:variant,"
    "normalized:variant,evidence_items:array<struct<title:string,evidence_type:string,raw_output:variant,normalized_summary:variant,redaction_status:string,metadata_json:variant>>,"
    "started_at:timestamp,finished_at:timestamp,errors:array<string>>>"
)
COMMAND_RESULT = (
    "server_id string, command_id string, command_type string, status string, output string, error string, exit_code int, "
    "started_at timestamp, finished_at timestamp, duration_ms bigint"
)
