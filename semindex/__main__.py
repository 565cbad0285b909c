"""Command line: python -m semindex index DIR | search TEXT | status | projects | clear | smoke"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from semindex.operators import index_stats
from semindex.plans.service import Service


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="semindex")
    top.add_argument("--storage-dir", default=str(Path.home() / ".semindex"))
    top.add_argument("-v", "--verbose", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("directory")
    index.add_argument("--patterns", nargs="*")
    index.add_argument("--clear", action="store_true", help="index anew")
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("-k", type=int, default=5)
    search.add_argument("--file-pattern")
    search.add_argument("--chunk-type")
    for name in ("status", "projects", "clear", "smoke"):
        commands.add_parser(name)
    return top


def smoke(service: Service) -> dict:
    """Index a project of two small files."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "main.py").write_text('def hello():\n    """Say hello."""\n    return "hello"\n')
        Path(folder, "utils.py").write_text("def add(a, b):\n    return a + b\n")
        return asdict(service.index_directory(folder))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("semindex").getOrCreate()
    service = Service(spark, asked.storage_dir)
    if asked.command == "index":
        print(json.dumps(asdict(service.index_directory(str(Path(asked.directory).resolve()), asked.patterns, not asked.clear))))
        if asked.verbose:
            for row in index_stats.top(index_stats.counts(service.current.index.read()), "chunk_types").collect():
                print(f"{row['value']}: {row['count']}")
    elif asked.command == "search":
        for line in service.search_code(asked.text, asked.k, file_pattern=asked.file_pattern, chunk_type=asked.chunk_type).toJSON().collect():
            print(line)
    elif asked.command == "status":
        print(service.index_status().toJSON().first())
    elif asked.command == "projects":
        for line in service.list_projects().toJSON().collect():
            print(line)
    elif asked.command == "clear":
        service.clear_index()
    else:
        print(json.dumps(smoke(service)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
