"""Explicit schemas of the data model. Fixed-width digests are 48 hex digits (24 bytes), addresses blocks."""

from __future__ import annotations

ENTRY = "package string, path string, type int, size long, executable boolean, inline_data binary, digests array<string>, chunk_shift int"
MANIFEST = "package string, entries array<struct<path:string,type:int,size:long,executable:boolean,inline_data:binary,digests:array<string>>>, small_file_cutoff int, meta struct<narinfo:map<string,string>,generator:string,generated_time:long>"
IMAGE = "sph string, store_path string, upstream string, mount_state int, mount_point string, last_mount_error string, image_size long, is_bare boolean, nar_size long"
CHUNK_REF = "digest string, slab_id int, addr long, refs array<string>"
SLAB = "slab_id int, addr long, digest string, present boolean"
CATALOG = "sph string, name string, is_manifest boolean"
BUILD_ROOT = "key string, build_time timestamp, store_path_hash array<string>, manifest array<string>"
OBJECT = "key string, size long"
SIGNED_MESSAGE = "params struct<digest_algo:string,digest_bits:int>, msg struct<path:string,inline_data:binary,digests:array<string>>, key_id array<string>, signature array<binary>"

#: lifecycle of an image, in order of their numbers
MOUNT_STATES = ("Unknown", "Requested", "Mounted", "MountError", "UnmountRequested", "Unmounted", "Deleted", "Materialized")
#: entry types by number
REGULAR, DIRECTORY, SYMLINK = 1, 2, 3
