"""A job's saved state: which inputs are staged, under which options."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from ..config import JobConfig
from .stats import Phase
from .workspace import Workspace

#: Fixed value: the name of the state file.
MANIFEST = "external_sort_checkpoint.json"
VERSION = 1


def options_hash(config: JobConfig, key: str) -> str:
    used = [config.case_sensitive, config.normalize_urls, config.email_only_usernames, key]
    return hashlib.sha256(json.dumps(used).encode()).hexdigest()


@dataclass
class Batch:
    """Staged inputs: their signatures (path, bytes, time), the folder, the rows that were parsed."""

    files: list[list]
    folder: str
    records: int
    staged: int


@dataclass
class Manifest:
    options: str
    output: str
    job: str = field(default_factory=lambda: uuid.uuid4().hex)
    version: int = VERSION
    phase: str = Phase.INITIALIZATION.value
    timestamp: float = field(default_factory=time.time)
    batches: list[Batch] = field(default_factory=list)

    def save(self, workspace: Workspace, folder: str) -> None:
        self.timestamp = time.time()
        workspace.write_text(f"{folder}/{MANIFEST}", json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, workspace: Workspace, folder: str) -> Manifest:
        raw = json.loads(workspace.read_text(f"{folder}/{MANIFEST}"))
        raw["batches"] = [Batch(**b) for b in raw["batches"]]
        return cls(**raw)

    @staticmethod
    def exists(workspace: Workspace, folder: str) -> bool:
        return workspace.exists(f"{folder}/{MANIFEST}")


def validate_batches(batches: list[Batch], workspace: Workspace) -> None:
    """An error for the first staged folder that is missing, was not finished, or holds another number of rows than were staged.

    Staged rows need no order: the merge's range exchange makes it.
    """
    for batch in batches:
        if not workspace.exists(batch.folder):
            raise FileNotFoundError(f"staged folder {batch.folder} does not exist")
        if not workspace.exists(f"{batch.folder}/_SUCCESS"):
            raise ValueError(f"staged folder {batch.folder} is not complete")
        if (rows := workspace.spark.read.parquet(batch.folder).count()) != batch.staged:
            raise ValueError(f"staged folder {batch.folder} has {rows} rows, not {batch.staged}")
