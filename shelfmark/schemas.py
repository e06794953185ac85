"""Schemas of the catalogue tables."""

from __future__ import annotations

TRACKS_RAW = """
    file_path string, tags map<string,array<string>>,
    technical struct<bitrate:int,sample_rate:int,channels:int,duration:double,file_size:bigint>
"""

TRACKS = """
    album_key string, track_number int, title string, artist string, album string, album_artist string,
    genre string, year int, is_compilation boolean, duration double, file_path string, file_format string,
    file_size bigint, raw_metadata string
"""

ALBUMS = """
    album_key string, artist string, album string, year int, genres array<string>, track_count bigint,
    total_duration double, file_path string, is_compilation boolean
"""

REGISTRY = """
    album_key string, artist string, album string, track_count bigint, file_hash string, first_discovered timestamp,
    last_scanned timestamp, scan_status string, match_status string, api_match_date timestamp, confidence double,
    matched_genres array<string>, api_sources array<string>, error_message string, manual_review_reason string,
    updated_at timestamp
"""

SESSIONS = "session_id string, started_at timestamp, completed_at timestamp, discovered bigint, updated bigint, " \
           "total bigint, status string"

SOURCE_CANDIDATES = "entity_key string, source string, cand_artist string, cand_title string, position int"

SOURCE_VOTES = "entity_key string, source string, genres array<string>, confidence double, weight double, " \
               "match_quality double"

SOURCE_CACHE = "cache_key string, artist string, album string, source string, genres array<string>, " \
               "confidence double, weight double, created_at timestamp, expires_at timestamp"

JOBS = "job_id string, name string, created_at timestamp, total_albums bigint, confidence_threshold double, " \
       "dry_run boolean, status string, options string"

JOB_RESULTS = """
    job_id string, album_key string, artist string, album string, original_genres array<string>,
    suggested_genres array<string>, final_genres array<string>, confidence double, sources_used array<string>,
    files_updated int, status string, error_message string, processing_time double, manual_review_reason string,
    created_at timestamp
"""

REVIEW_QUEUE = "job_id string, album_key string, artist string, album string, confidence double, priority int, " \
               "reason string, created_at timestamp, reviewed_at timestamp, reviewer_decision string"

QUALITY_ISSUES = "issue_type string, severity string, album_key string, artist string, album string, " \
                 "description string, suggested_fix string, confidence double"

QUALITY_REPORTS = "report_id string, created_at timestamp, total_albums bigint, total_issues bigint, " \
                  "critical_issues bigint, warning_issues bigint, info_issues bigint, quality_score double, " \
                  "consistency_score double"

SNAPSHOT = "struct<artist:string,album:string,year:int,genre:string,track_count:bigint,total_duration:double," \
           "file_path:string>"

VERSIONS = f"album_key string, version_number bigint, snapshot {SNAPSHOT}, " \
           "changed_fields map<string,struct<old:string,new:string>>, changed_by string, change_reason string, " \
           "created_at timestamp, is_current boolean, reverted_from bigint"

# one status vocabulary for results and jobs
STATUSES = ["pending", "in_progress", "completed", "failed", "needs_review", "skipped", "approved", "rejected"]
MATCHED_STATUSES = ["completed", "approved"]
