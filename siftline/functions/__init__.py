"""Column expressions: normalisation, keys, sizes, rendering. All run inside the JVM."""

from .normalize import ascii_lower, detect_protocol, find_char, find_last_char, is_email, normalize_host, normalize_url, normalize_username, starts_with, trim_unicode
from .record import dedup_key, estimated_size, field_count, record_from_json, record_json, to_csv_line, to_quoted_line

__all__ = ["ascii_lower", "dedup_key", "detect_protocol", "estimated_size", "field_count", "find_char", "find_last_char", "is_email", "normalize_host", "normalize_url", "normalize_username", "record_from_json", "record_json", "starts_with", "to_csv_line", "to_quoted_line", "trim_unicode"]
