"""The job: line files in, deduplicated and ordered lines out, with resume.

Stage A parses inputs in batches of files and stages the first row of each key as Parquet, one folder
for each batch; the manifest names a batch once its folder is complete. Stage B takes all staged rows,
keeps the first of each key over all files, orders by key and writes lines. A resumed job skips the
batches whose inputs are unchanged and whose options are the same, and does stage B again.
"""

from __future__ import annotations

import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import JobConfig
from ..functions.normalize import is_email
from ..functions.record import record_key, to_csv_line, to_quoted_line
from ..operators.dedup import dedup_first, sort_dedup
from ..operators.grammar import RECORD, parse_lines
from ..sources.lines import ORDER, read_lines
from ..sources.sinks import write_parts, write_single
from .manifest import MANIFEST, Batch, Manifest, options_hash, validate_batches
from .stats import JobStats, Phase, progress_percentage
from .workspace import Workspace, shared_root

#: The folder for staged rows where no other is set.
STAGING = "external_sort_temp"


class DedupJob:
    """One run over a list of input files; see the module's text."""

    def __init__(self, spark: SparkSession, config: JobConfig | None = None, key: str = "username", line_form: str = "raw", single_file: bool = True, files_per_batch: int = 64, ignore_failed_files: bool = False):
        self.spark, self.config, self.key = spark, (config or JobConfig()).validate(), key
        self.line_form, self.single_file, self.files_per_batch, self.ignore_failed_files = line_form, single_file, files_per_batch, ignore_failed_files
        self.manifest: Manifest | None = None
        self.group = f"siftline-{uuid.uuid4().hex}"

    def records(self, lines: DataFrame) -> DataFrame:
        """Parsed records of lines with their key, after the options' filters."""
        out = parse_lines(lines)
        if self.config.email_only_usernames:
            out = out.where(is_email(F.col("username")))
        return out.withColumn("key", record_key(self.key, self.config.case_sensitive, self.config.normalize_urls))

    def rendered(self, records: DataFrame) -> DataFrame:
        form = to_quoted_line if self.line_form == "quoted" else to_csv_line
        return records.withColumn("line", form(*map(F.col, RECORD)))

    def stop(self) -> None:
        """Cancel the running job; its manifest allows it to be resumed."""
        self.spark.sparkContext.cancelJobGroup(self.group)

    def progress(self, files: int) -> float:
        """From 0 to 100; while merging, by the tasks of the merge's stages that Spark knows of."""
        if self.manifest is None:
            return 0.0
        done = sum(len(b.files) for b in self.manifest.batches)
        return progress_percentage(Phase(self.manifest.phase), done, files, *self._tasks())

    def _tasks(self) -> tuple[int, int]:
        """Done and all tasks of this job's running Spark jobs."""
        tracker = self.spark.sparkContext.statusTracker()
        done = every = 0
        for number in tracker.getJobIdsForGroup(self.group):
            job = tracker.getJobInfo(number)
            for stage in map(tracker.getStageInfo, job.stageIds if job is not None and job.status == "RUNNING" else ()):
                if stage is not None:
                    done, every = done + stage.numCompletedTasks, every + stage.numTasks
        return done, every

    def report(self, files: int, tell: Callable[[str], None]) -> Callable[[], None]:
        """Tell the progress every merge_progress_interval_seconds until the returned function is called."""
        over = threading.Event()

        def watch() -> None:
            while not over.wait(self.config.merge_progress_interval_seconds):
                phase = self.manifest.phase if self.manifest else Phase.INITIALIZATION.value
                tell(f"{phase}: {self.progress(files):.0f} %")

        threading.Thread(target=watch, daemon=True).start()
        return over.set

    def _folder(self, workspace: Workspace) -> str:
        """temp_directory, on the default file system unless it names another; if not set, a folder in the shared place."""
        given = self.config.temp_directory
        if given:
            return workspace.qualified(given)
        if self.spark.conf.get("spark.checkpoint.dir", None) or self.spark.sparkContext.master.split("[")[0] != "local":
            return f"{shared_root(self.spark)}/{STAGING}"
        return f"file://{tempfile.gettempdir()}/{STAGING}"  # of one machine, the same for a job that goes on later

    def run(self, paths: list[str], output: str, resume: bool = False) -> JobStats:
        began = time.time()
        if not paths:
            raise ValueError("no input files")
        workspace = Workspace(self.spark, base="unused:/")
        folder = self._folder(workspace)
        options = options_hash(self.config, self.key)
        manifest = Manifest(options, output)
        if resume and Manifest.exists(workspace, folder):
            saved = Manifest.load(workspace, folder)
            if saved.options != options:
                raise ValueError("the saved job had other options; run without resume")
            manifest.batches, manifest.job = saved.batches, saved.job
        elif Manifest.exists(workspace, folder):
            workspace.delete(f"{folder}/staged-{Manifest.load(workspace, folder).job}")
        self.manifest = manifest
        self.spark.sparkContext.setJobGroup(self.group, f"deduplicate {len(paths)} files", True)
        signed = [self._signature(workspace, p) for p in paths]
        manifest.batches = [b for b in manifest.batches if all(list(f) in signed for f in b.files) and workspace.exists(f"{b.folder}/_SUCCESS")]
        manifest.phase = Phase.FILE_PROCESSING.value
        manifest.save(workspace, folder)
        staged = {f[0] for b in manifest.batches for f in b.files}
        todo = [i for i, p in enumerate(paths) if p not in staged]
        for at in range(0, len(todo), self.files_per_batch):
            some = todo[at : at + self.files_per_batch]
            manifest.batches.append(self._stage(f"{folder}/staged-{manifest.job}", paths, some, signed))
            manifest.save(workspace, folder)
        validate_batches(manifest.batches, workspace)
        manifest.phase = Phase.MERGING.value
        manifest.save(workspace, folder)
        unique = self._merge(manifest.batches, output) if any(b.staged for b in manifest.batches) else 0
        manifest.phase = Phase.COMPLETED.value
        manifest.save(workspace, folder)
        return JobStats(sum(b.records for b in manifest.batches), unique, len(paths), len(manifest.batches), int(1000 * (time.time() - began)))

    def cleanup(self) -> None:
        """Delete the saved job's staged rows and its manifest, and the folder if nothing else is in it."""
        workspace = Workspace(self.spark, base="unused:/")
        folder = self._folder(workspace)
        if Manifest.exists(workspace, folder):
            workspace.delete(f"{folder}/staged-{Manifest.load(workspace, folder).job}")
            workspace.delete(f"{folder}/{MANIFEST}")
        left = workspace.children(folder)
        if set(left) <= {f".{MANIFEST}.crc"}:
            workspace.delete(folder)

    def _signature(self, workspace: Workspace, path: str) -> list:
        store, target = workspace.file_system(path)
        if not store.exists(target):
            if self.ignore_failed_files:
                return [path, -1, -1]
            raise FileNotFoundError(f"no such file: {path}")
        status = store.getFileStatus(target)
        return [path, status.getLen(), status.getModificationTime()]

    def _stage(self, folder: str, paths: list[str], some: list[int], signed: list[list]) -> Batch:
        name = f"{folder}/{uuid.uuid4().hex}"
        lines = read_lines(self.spark, [paths[i] for i in some], ignore_failed_files=self.ignore_failed_files)
        # places in the batch become places in the whole list
        places = F.array(*[F.lit(i) for i in some])
        lines = lines.withColumn("file_index", F.element_at(places, F.col("file_index") + 1))
        seen = Observation()
        records = self.records(lines).observe(seen, F.count(F.lit(1)).alias("n"))
        dedup_first(records, ["key"], ORDER).select("key", *RECORD, *ORDER).write.mode("overwrite").parquet(name)
        return Batch([signed[i] for i in some], name, int(seen.get["n"]), self.spark.read.parquet(name).count())

    def _merge(self, batches: list[Batch], output: str) -> int:
        rows = self.spark.read.parquet(*[b.folder for b in batches])
        seen = Observation()
        ordered = sort_dedup(rows, "key", ORDER).observe(seen, F.count(F.lit(1)).alias("n"))
        lines = self.rendered(ordered)
        (write_single if self.single_file else write_parts)(lines, output, "line", self.config.enable_compression)
        return int(seen.get["n"])


def run_dedup(spark: SparkSession, paths: list[str], output: str, config: JobConfig | None = None, **options) -> JobStats:
    return DedupJob(spark, config, **options).run(paths, output)


def normalized_records(records: DataFrame, ascii_only: bool = True, case_sensitive: bool = False) -> DataFrame:
    """The batch normalisation of users and addresses: normalized_user, normalized_url (the host), field_count, all_fields."""
    from ..functions.normalize import ascii_lower, normalize_host, normalize_username
    from ..functions.record import field_count

    user = F.col("username") if case_sensitive else (ascii_lower if ascii_only else normalize_username)(F.col("username"))
    every = F.concat(F.array("username", "password"), F.when(F.col("url") != "", F.array("url")).otherwise(F.array().cast("array<string>")), F.col("extra_fields"))
    return records.select(
        F.col("username").alias("user"), "password", "url", user.alias("normalized_user"), normalize_host(F.col("url")).alias("normalized_url"), field_count(F.col("url"), F.col("extra_fields")).cast("long").alias("field_count"), every.alias("all_fields")
    )
