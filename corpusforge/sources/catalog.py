"""Versioned index artefacts: built aside, published by one commit, read from a pinned snapshot.

A catalogue is a folder. Data lies in folders that are never written again; a commit is a small JSON file that names, for
each artefact, its folders and a manifest (counts, fingerprint, settings). The file is created only if it isn't there, so of two
writers with the same base one fails and starts over from the newer snapshot. A reader holds a snapshot: later commits
don't change what it sees until `vacuum` removes folders that no kept commit names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published a newer version."""


@dataclass(frozen=True)
class Snapshot:
    """One version: artefact name to {"folders": [...], "manifest": {...}}."""

    version: int
    artefacts: dict = field(default_factory=dict)

    def folders(self, name: str) -> list[str]:
        if name not in self.artefacts:
            raise KeyError(f"no artefact {name} in version {self.version}; there are {sorted(self.artefacts)}")
        return self.artefacts[name]["folders"]

    def manifest(self, name: str) -> dict:
        self.folders(name)
        return self.artefacts[name]["manifest"]


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._path(f"{self.folder}/_commits/{version:012d}.json")

    def versions(self) -> list[int]:
        """All published versions, oldest first."""
        at = self._path(f"{self.folder}/_commits")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(at) if s.getPath().getName().endswith(".json"))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A version, the newest unless one is named; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Snapshot(0)
        if version not in known:
            raise KeyError(f"version {version} isn't there; there are {known}")
        stream = self._fs.open(self._file(version))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(version, json.loads(text))

    def aside(self, name: str) -> str:
        """A new data folder for an artefact; nobody sees it until it is published."""
        return f"{self.folder}/data/{name}-{uuid.uuid4().hex}"

    def publish(self, base: Snapshot, changes: dict[str, tuple[list[str], dict]], drop: tuple[str, ...] = ()) -> Snapshot:
        """The version after base, with changed artefacts (folders, manifest) and without dropped ones; Conflict if there is one already."""
        artefacts = {k: v for k, v in base.artefacts.items() if k not in drop}
        artefacts |= {k: {"folders": list(folders), "manifest": manifest} for k, (folders, manifest) in changes.items()}
        version = base.version + 1
        if version <= max(self.versions(), default=0):
            raise Conflict(f"version {version} has been published meanwhile")
        try:
            out = self._fs.create(self._file(version), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"version {version} has been published meanwhile") from e
            raise
        try:
            out.write(bytearray(json.dumps(artefacts).encode()))
        finally:
            out.close()
        return Snapshot(version, artefacts)

    def write(self, name: str, df: DataFrame, manifest: dict | None = None, base: Snapshot | None = None) -> Snapshot:
        """Write df aside and publish it as the whole artefact."""
        base = self.snapshot() if base is None else base
        at = self.aside(name)
        df.write.parquet(at)
        return self.publish(base, {name: ([at], manifest or {})})

    def read(self, name: str, snapshot: Snapshot | None = None) -> DataFrame:
        return self.spark.read.parquet(*(self.snapshot() if snapshot is None else snapshot).folders(name))

    def require(self, name: str, fingerprint: str, snapshot: Snapshot | None = None) -> Snapshot:
        """The snapshot, if the artefact was built from what the fingerprint says; an error stops the run otherwise."""
        snapshot = self.snapshot() if snapshot is None else snapshot
        stored = snapshot.manifest(name).get("fingerprint")
        if stored != fingerprint:
            raise ValueError(f"{name} of version {snapshot.version} was built from {stored}, the chunks are {fingerprint}: build it again")
        return snapshot

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the newest commits, and delete data folders that none of these names. Not to be run beside a writer."""
        known = self.versions()
        kept = [self.snapshot(v) for v in known[-keep:]] if keep > 0 else []
        named = {f.rsplit("/", 1)[-1] for s in kept for a in s.artefacts for f in s.folders(a)}
        for v in known[: len(known) - len(kept)]:
            self._fs.delete(self._file(v), False)
        at, gone = self._path(f"{self.folder}/data"), []
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return sorted(gone)
