"""Numbered versions under a folder, each published by one atomic rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from quiver.workdir import hadoop


class StateConflict(RuntimeError):
    """Another writer has published the version that this one was about to publish."""


class Versions:
    """Version 1, 2, … of something under ``path``; what a version says is a JSON object.

    A version is there or isn't: it is written beside the others and renamed,
    and the rename fails if the number is taken.  Nothing that a published
    version names is written again, so readers never see half of a change.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def latest(self) -> int:
        """Number of the newest version; 0 before the first."""
        fc, p = hadoop(self.spark, f"{self.path}/_versions")
        if not fc.util().exists(p):
            return 0
        names = [s.getPath().getName() for s in fc.util().listStatus(p)]
        return max([0, *(int(n) for n in names if n.isdigit())])

    def read(self, version: int) -> dict:
        fc, p = hadoop(self.spark, f"{self.path}/_versions/{version:012d}")
        stream = fc.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def folder(self, name: str) -> str:
        """A new folder for a version's data, relative to the path."""
        return f"{name}-{uuid.uuid4().hex}"

    def publish(self, content: dict, base: int) -> int:
        """Make ``content`` version ``base`` + 1."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        fs = jvm.org.apache.hadoop.fs
        fc, final = hadoop(self.spark, f"{self.path}/_versions/{base + 1:012d}")
        _, tmp = hadoop(self.spark, f"{self.path}/_versions/.{uuid.uuid4().hex}")
        parents = gateway.new_array(fs.Options.CreateOpts, 1)
        parents[0] = fs.Options.CreateOpts.createParent()
        out = fc.create(tmp, jvm.java.util.EnumSet.of(fs.CreateFlag.CREATE), parents)
        out.write(json.dumps(content).encode())
        out.close()
        options = gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.NONE
        try:
            fc.rename(tmp, final, options)
        except Exception as e:
            fc.delete(tmp, False)
            if fc.util().exists(final):
                raise StateConflict(f"version {base + 1} of {self.path} is already there") from e
            raise
        return base + 1
