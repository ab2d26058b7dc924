"""Job configuration: defaults, limits, JSON."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

#: Allowed ranges, ends included.
RANGES = {
    "memory_usage_percent": (10.0, 90.0),
    "chunk_size_mb": (64, 4096),
    "processing_threads": (1, 32),
    "cuda_batch_size": (1000, 1_000_000),
}
KEYS = ("username", "username_url")


@dataclass(frozen=True)
class JobConfig:
    """Options of a deduplication job.

    The three cuda options are accepted and checked, and have no effect on Spark. An empty temp_directory means a
    folder in spark.checkpoint.dir. spark_options says what the sizes mean; verbose reports the progress every
    merge_progress_interval_seconds.
    """

    memory_usage_percent: float = 60.0
    chunk_size_mb: int = 512
    io_buffer_size_kb: int = 64
    processing_threads: int = 4
    enable_cuda: bool = True
    cuda_batch_size: int = 100_000
    cuda_memory_percent: float = 80.0
    temp_directory: str = ""
    enable_compression: bool = False
    merge_buffer_size_kb: int = 256
    case_sensitive: bool = False
    normalize_urls: bool = True
    email_only_usernames: bool = False
    verbose: bool = False
    merge_progress_interval_seconds: int = 10

    def validate(self) -> JobConfig:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must be from {low} to {high}, not {getattr(self, name)}")
        return self

    @classmethod
    def from_file(cls, path: str | Path) -> JobConfig:
        """Read JSON; every option must be there."""
        given = json.loads(Path(path).read_text())
        names = {f.name for f in fields(cls)}
        if missing := sorted(names - set(given)):
            raise ValueError(f"missing options: {', '.join(missing)}")
        return cls(**{k: v for k, v in given.items() if k in names}).validate()

    def to_file(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2) + "\n")

    @property
    def chunk_size_bytes(self) -> int:
        return self.chunk_size_mb << 20

    def memory_limit_bytes(self, total: int) -> int:
        return int(total * self.memory_usage_percent / 100)

    def spark_options(self, cluster: bool = False) -> dict[str, str]:
        """The options that have a counterpart in Spark. Threads and memory are a cluster's own business."""
        out = {
            "spark.sql.files.maxPartitionBytes": str(min(self.chunk_size_bytes, 512 << 20)),
            "spark.shuffle.file.buffer": f"{self.io_buffer_size_kb}k",
            "spark.shuffle.unsafe.file.output.buffer": f"{self.merge_buffer_size_kb}k",
        }
        if not cluster:
            total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
            out |= {"spark.master": f"local[{self.processing_threads}]", "spark.driver.memory": f"{self.memory_limit_bytes(total) >> 20}m"}
        return out
