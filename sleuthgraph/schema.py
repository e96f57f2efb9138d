"""Schemas of the event table (nested, stored) and of the record input."""

from __future__ import annotations

ENDPOINT = "struct<hostname:string,ip:string,port:int,mac:string,os:string>"

EVENT_DDL = f"""
  uid string, time timestamp, time_is_fallback boolean, event_date date,
  source string, origin string, class_name string, class_uid int, activity string,
  severity int, status string, message string,
  actor struct<user:string,domain:string,sid:string,session_id:string>,
  src {ENDPOINT}, dst {ENDPOINT}, device {ENDPOINT},
  process struct<name:string,path:string,cmdline:string,pid:int,parent_name:string,
                 parent_path:string,parent_pid:int,integrity:string>,
  file struct<name:string,path:string,sha256:string,md5:string,size:bigint>,
  email struct<sender:string,recipient:string,subject:string,url:string>,
  domain string, url string, app string,
  mitre array<struct<id:string,name:string,tactic:string>>,
  logon_type_label string,
  extra_entities array<struct<type:string,value:string>>,
  payload_decoded string,
  raw string
"""

# A record is one exported log line before normalisation: its fields as text
# (nested values as JSON text), the original text and where it came from.
RECORD_DDL = "record map<string,string>, raw string, origin_file string"
