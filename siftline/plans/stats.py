"""What a job counted, and how far it is."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Phase(str, Enum):
    INITIALIZATION = "Initialization"
    FILE_PROCESSING = "FileProcessing"
    CHUNK_SORTING = "ChunkSorting"
    MERGING = "Merging"
    COMPLETED = "Completed"
    FAILED = "Failed"


@dataclass(frozen=True)
class JobStats:
    """total_records: parsed rows; duplicates_removed: total less unique."""

    total_records: int
    unique_records: int
    files_processed: int
    chunks_created: int
    processing_time_ms: int

    @property
    def duplicates_removed(self) -> int:
        return self.total_records - self.unique_records


#: The shares of the progress that reading and merging take.
READ_SHARE, MERGE_SHARE = 80.0, 15.0


def progress_percentage(phase: Phase, files_done: int, files: int, chunks_done: int = 0, chunks: int = 0) -> float:
    """From 0 to 100: 80 by files, then 15 by chunks (5 if there are none), 100 when completed."""
    if phase is Phase.COMPLETED:
        return 100.0
    if phase is Phase.FILE_PROCESSING:
        return READ_SHARE * files_done / files if files else 0.0
    if phase is Phase.CHUNK_SORTING:
        return READ_SHARE
    if phase is Phase.MERGING:
        return READ_SHARE + (MERGE_SHARE * chunks_done / chunks if chunks else 5.0)
    return 0.0
