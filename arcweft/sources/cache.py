"""Parsed graphs kept as Parquet, keyed by path and configuration, checked by time and size.

Whoever parses a graph holds a lock file meanwhile; others wait for the result, or parse it themselves if the lock
is older than ``STALE`` seconds (its holder is gone).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import time
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from ..graph import GraphConfig, PropertyGraph
from . import formats

KEEP = 10
STALE, PAUSE = 600.0, 0.2


class GraphCache:
    """At most ``keep`` graphs under ``folder``; the least recently used goes first."""

    def __init__(self, folder: str, keep: int = KEEP):
        self.folder, self.keep = Path(folder), keep

    def key(self, path: str, config: GraphConfig) -> str:
        said = json.dumps([os.path.abspath(path), path.rsplit(".", 1)[-1], asdict(config)], sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()

    def load(self, spark: SparkSession, path: str, config: GraphConfig | None = None) -> PropertyGraph:
        config = config or GraphConfig()
        at = self.folder / self.key(path, config)
        stat = os.stat(path)
        mark = {"mtime": stat.st_mtime_ns, "size": stat.st_size}
        found = self._kept(spark, at, mark, config)
        if found is not None:
            return found
        self.folder.mkdir(parents=True, exist_ok=True)
        lock = self.folder / f"{at.name}.lock"
        while not self._take(lock):
            time.sleep(PAUSE)
        try:
            return self._kept(spark, at, mark, config) or self._parse(spark, path, config, at, mark)
        finally:
            lock.unlink(missing_ok=True)

    def _take(self, lock: Path) -> bool:
        """Whether the lock is ours now; a stale one is removed for the next try."""
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return True
        except FileExistsError:
            try:
                if time.time() - lock.stat().st_mtime > STALE:
                    lock.unlink(missing_ok=True)
            except FileNotFoundError:
                pass
            return False

    def _kept(self, spark: SparkSession, at: Path, mark: dict, config: GraphConfig) -> PropertyGraph | None:
        note = at / "note.json"
        said = json.loads(note.read_text()) if note.exists() else {}
        if {k: v for k, v in said.items() if k in mark} != mark:
            return None
        os.utime(note)
        g = PropertyGraph(spark, (), (), GraphConfig(**{**asdict(config), "graph_type": said["graph_type"]}))
        return g.with_frames(spark.read.parquet(str(at / "nodes")), spark.read.parquet(str(at / "edges")))

    def _parse(self, spark: SparkSession, path: str, config: GraphConfig, at: Path, mark: dict) -> PropertyGraph:
        graph = formats.load(spark, path, config)
        work = self.folder / f".{at.name}.{os.getpid()}.{time.time_ns()}"
        graph.node_frame().write.parquet(str(work / "nodes"))
        graph.edge_frame().write.parquet(str(work / "edges"))
        (work / "note.json").write_text(json.dumps(mark | {"graph_type": graph.config.graph_type}))
        shutil.rmtree(at, ignore_errors=True)
        try:
            os.replace(work, at)  # whole or not at all, whoever else writes
        except OSError:
            shutil.rmtree(work, ignore_errors=True)
        self._trim()
        return graph

    def _trim(self) -> None:
        notes = sorted(self.folder.glob("*/note.json"), key=lambda p: p.stat().st_mtime, reverse=True)
        for p in notes[self.keep :]:
            shutil.rmtree(p.parent, ignore_errors=True)
