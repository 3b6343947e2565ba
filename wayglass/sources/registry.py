"""Tables that outlive a run, kept under a fingerprint of what they were made from.

A table's key hashes the contents of its inputs (whatever their order, files and partitions), its parameters and the version of its rule, so the same question finds the same table and a changed row another one. A build
that breaks off leaves no table: data is written first, a JSON note with its inputs last, and only tables with a note count. Runs hold tables by name while they need them; a table that no run
holds can be dropped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayglass.sources.tables import _path, exists, fingerprint, read_json, write_json

NOTE, HOLDERS = "note.json", "held-by"


class Registry:
    """Tables under a root folder that all runs share. built and reused name what this object has made and found."""

    def __init__(self, spark: SparkSession, root: str, holder: str | None = None):
        self.spark, self.root, self.holder = spark, root.rstrip("/"), holder or uuid.uuid4().hex
        self.built: list[str] = []
        self.reused: list[str] = []

    def key(self, inputs: dict[str, DataFrame | str], params: dict) -> str:
        """Of frames and of keys of other tables."""
        prints = {name: x if isinstance(x, str) else fingerprint(x, x.columns) for name, x in inputs.items()}
        return hashlib.sha256(json.dumps([prints, params], sort_keys=True).encode()).hexdigest()[:32]

    def table(self, name: str, inputs: dict[str, DataFrame | str], build: Callable[[], DataFrame], params: dict | None = None, version: int = 1) -> tuple[DataFrame, str]:
        """The table and its key; `build` runs only if no whole table has it. Two builders of one key write apart, and the first note counts."""
        key = self.key(inputs, {"version": version, **(params or {})})
        at = f"{self.root}/{name}/{key}"
        if self._note(at) is None:
            data = f"{at}/data-{uuid.uuid4().hex}"
            build().write.parquet(data)
            if self._note(at) is None:
                write_json(self.spark, f"{at}/{NOTE}", {"name": name, "key": key, "data": data.rsplit("/", 1)[1], "params": params or {}, "version": version})
            self.built.append(name)
        else:
            self.reused.append(name)
        write_json(self.spark, f"{at}/{HOLDERS}/{self.holder}.json", {"holder": self.holder})
        return self.spark.read.parquet(f"{at}/{self._note(at)['data']}"), key

    def _note(self, at: str) -> dict | None:
        return read_json(self.spark, f"{at}/{NOTE}") if exists(self.spark, f"{at}/{NOTE}") else None

    def _folders(self, path: str) -> list[str]:
        p, fs = _path(self.spark, path)
        return sorted(str(s.getPath()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, path: str) -> None:
        p, fs = _path(self.spark, path)
        fs.delete(p, True)

    def release(self) -> None:
        """Give up all that this holder holds."""
        for table in self._folders(self.root):
            for at in self._folders(table):
                self._delete(f"{at}/{HOLDERS}/{self.holder}.json")

    def drop_unheld(self) -> list[str]:
        """Delete the tables that nobody holds (and what broken builds left); their names and keys."""
        gone = []
        for table in self._folders(self.root):
            for at in self._folders(table):
                if not any(f.endswith(".json") for f in self._folders(f"{at}/{HOLDERS}")):
                    self._delete(at)
                    gone.append("/".join(at.rsplit("/", 2)[1:]))
        return gone
