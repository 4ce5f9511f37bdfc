"""A PySpark-native analytics engine for timestamped activity data."""

from .api import ActivityLog
from .functions.entities import with_page as parse_url
from .operators.views import SURFACE_KINDS as COMM_KINDS
from .operators.views import app_ledger, comm_surfaces, coverage
from .operators.views import patterns as detect_patterns
from .operators.temporal import segments
from .plans import SCHEMA_VERSION, context_block, to_json, to_markdown, to_yaml
from .plans import build_document as build_frames
from .sources import CaptureNotFound, find_capture

__version__ = "0.2.0"
__all__ = [
    "ActivityLog", "COMM_KINDS", "CaptureNotFound", "SCHEMA_VERSION", "app_ledger", "build_frames", "comm_surfaces", "context_block", "coverage",
    "detect_patterns", "find_capture", "parse_url", "segments", "to_json", "to_markdown", "to_yaml",
]
