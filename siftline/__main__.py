"""python -m siftline -i DIR -o FILE [-c CONFIG] [-r] [-v]"""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from pathlib import Path

from .config import JobConfig


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="siftline", description="Deduplicate and sort records from CSV-like files.")
    out.add_argument("-i", "--input", required=True, help="folder with .csv files")
    out.add_argument("-o", "--output", required=True, help="the file to write")
    out.add_argument("-c", "--config", default="config.json", help="JSON options; made with the defaults if missing")
    out.add_argument("-r", "--resume", action="store_true", help="go on with a job that was stopped")
    out.add_argument("-v", "--verbose", action="store_true", help="report the progress")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    path = Path(args.config)
    if not path.exists():
        JobConfig().to_file(path)
    config = JobConfig.from_file(path)
    if args.verbose:
        config = replace(config, verbose=True)
    from pyspark import SparkConf
    from pyspark.sql import SparkSession

    from .plans.job import DedupJob
    from .sources.lines import discover_csv

    builder = SparkSession.builder.appName("siftline")
    for name, value in config.spark_options(cluster=SparkConf().contains("spark.master")).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    try:
        files = discover_csv(spark, args.input)
        job = DedupJob(spark, config)
        over = job.report(len(files), lambda line: print(line, file=sys.stderr, flush=True)) if config.verbose else lambda: None
        try:
            stats = job.run(files, args.output, resume=args.resume)
        except KeyboardInterrupt:
            job.stop()
            print("stopped; run again with --resume", file=sys.stderr)
            return 130
        finally:
            over()
        job.cleanup()
    except (FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{stats.files_processed} files, {stats.total_records} records, {stats.unique_records} unique, {stats.duplicates_removed} duplicates, {stats.processing_time_ms} ms")
    return 0


if __name__ == "__main__":
    sys.exit(main())
