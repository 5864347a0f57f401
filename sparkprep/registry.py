"""A versioned catalogue of datasets: Parquet folders, and a record in JSON for each version.

Publishing writes a record of its own and changes no other, so writers do not undo each other's work; the index is the
records, listed on load."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.errors import InvalidConfig, NotFound, ParseError
from sparkprep.sources.storage import HadoopStorage, Storage

INDEX, RECORDS = "registry-index.json", "registry/"


@dataclass
class Entry:
    name: str
    versions: list[str]
    latest: str
    size_bytes: int = 0
    num_rows: int = 0
    schema: str = ""
    description: str = ""
    license: str = ""
    tags: list[str] = field(default_factory=list)
    source: str | None = None
    citation: str | None = None
    sha256: str | None = None


class Registry:
    """``root`` is a folder that Spark can write; the index is kept in it."""

    def __init__(self, spark: SparkSession, root: str, storage: Storage | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage = storage or HadoopStorage(spark, self.root)

    def load(self) -> dict[str, Entry]:
        try:
            if self.storage.exists(INDEX):
                json.loads(self.storage.get(INDEX))["format"]
            found = [json.loads(self.storage.get(k)) for k in self.storage.list(RECORDS)]
            out: dict[str, Entry] = {}
            for x in sorted(found, key=lambda x: (x["at"], x["entry"]["latest"])):
                e = Entry(**x["entry"])
                e.versions = [*(out[e.name].versions if e.name in out else []), e.latest]
                out[e.name] = e
            return out
        except (ValueError, KeyError, TypeError) as e:
            raise ParseError(f"the index of {self.root} can't be read") from e

    def init(self) -> None:
        if not self.storage.exists(INDEX):
            self.storage.put(INDEX, b'{"format": 2}')

    def path(self, name: str, version: str) -> str:
        return f"{self.root}/datasets/{name}/{version}/data.parquet"

    def publish(self, name: str, version: str, df: DataFrame, **about) -> Entry:
        """Write a version and make it the latest."""
        for x in (name, version):
            if not re.fullmatch(r"[\w.+-]+", x):
                raise InvalidConfig(f"bad name or version {x!r}")
        old = self.load().get(name)  # before anything is written
        path = self.path(name, version)
        df.write.mode("overwrite").parquet(path)
        base = f"datasets/{name}/{version}/data.parquet"
        size = sum(self.storage.size(k) for k in self.storage.list(base))
        kept = {k: v for k, v in asdict(old).items() if k in ("description", "license", "tags", "source", "citation")} if old else {}
        entry = Entry(name, [version], version, size, self.spark.read.parquet(path).count(), df.schema.simpleString(), **(kept | about))
        self.init()
        self.storage.put(f"{RECORDS}{name}/{version}.json", json.dumps({"at": time.time_ns(), "entry": asdict(entry)}).encode())
        return self.load()[name]

    def list(self) -> list[str]:
        return sorted(self.load())

    def info(self, name: str) -> Entry:
        entries = self.load()
        if name not in entries:
            raise NotFound(name)
        return entries[name]

    def pull(self, name: str, version: str | None = None) -> DataFrame:
        entry = self.info(name)
        v = version or entry.latest
        if v not in entry.versions:
            raise NotFound(f"{name} {v}")
        return self.spark.read.parquet(self.path(name, v))

    def delete(self, name: str, version: str) -> None:
        """Forget a version; after the last one the dataset is forgotten."""
        entries = self.load()
        if name not in entries or version not in entries[name].versions:
            raise NotFound(f"{name} {version}")
        self.storage.delete(f"{RECORDS}{name}/{version}.json")
        for key in self.storage.list(f"datasets/{name}/{version}/"):
            self.storage.delete(key)

    def frame(self) -> DataFrame:
        """The index as a table."""
        rows = [(e.name, e.latest, e.versions, e.num_rows, e.size_bytes, e.description, e.tags) for e in self.load().values()]
        return self.spark.createDataFrame(rows, "name string, latest string, versions array<string>, num_rows long, size_bytes long, description string, tags array<string>")

    def search(self, text: str) -> DataFrame:
        t = text.lower()
        return self.frame().filter(F.lower("name").contains(t) | F.lower("description").contains(t))

    def search_tags(self, tags: Sequence[str]) -> DataFrame:
        return self.frame().filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
