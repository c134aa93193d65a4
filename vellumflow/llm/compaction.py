"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder that Spark can reach.  ``append`` registers an arrival's
files as a run; ``compact`` merges runs of one size tier, as soon as there are
``FAN_IN`` of them, into files of about ``target_bytes``, without a shuffle
(scan tasks are coalesced), until no tier is full.  Each change is a new
manifest version: written beside the manifests and then renamed without
overwriting, so exactly one writer wins a version and readers always see a
whole one; a writer that lost reads the new version and tries again.  Files that
no kept version names are removed by ``vacuum``.

Only the manifest passes through the driver: one line for each run, and
compaction keeps their number logarithmic in the data.

Defined results: nulls, repeated rows, empty and long texts are stored as they
are; an empty arrival adds no run; reading an empty store gives an empty table
of its schema; any columns are kept.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

FAN_IN = 4
TARGET_BYTES = 128 << 20
#: Runs up to this size are the lowest tier; each further tier is FAN_IN times as large.
SMALLEST = 1 << 20


@dataclass(frozen=True)
class Run:
    path: str
    bytes: int
    files: int

    @property
    def tier(self) -> int:
        return max(0, math.ceil(math.log(max(self.bytes, 1) / SMALLEST, FAN_IN)))


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    runs: tuple[Run, ...]


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self._conf)

    # -- manifests -------------------------------------------------------
    def versions(self) -> list[int]:
        fs, at = self._fs, self._path("manifest")
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(at) if s.getPath().getName().endswith(".json")) if fs.exists(at) else []

    def manifest(self, version: int | None = None) -> Manifest | None:
        found = self.versions()
        if not found:
            return None
        stream = self._fs.open(self._path("manifest", f"v{found[-1] if version is None else version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        return Manifest(got["version"], got["schema"], tuple(Run(**r) for r in got["runs"]))

    def _publish(self, manifest: Manifest) -> bool:
        """Make the version visible at once; False if another writer took it."""
        fs, draft = self._fs, self._path("manifest", f".draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, self._path("manifest", f"v{manifest.version:012d}.json"), options)
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(draft, False)
            return False

    def _change(self, edit) -> Manifest:
        """Apply ``edit`` to the newest manifest until its successor is ours."""
        while True:
            now = self.manifest()
            new = edit(now)
            if new is None or self._publish(new):
                return new or now

    # -- data ------------------------------------------------------------
    def _run(self, name: str) -> Run | None:
        fs, at = self._fs, self._path("data", name)
        files = [s for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")] if fs.exists(at) else []
        if not files or self.spark.read.parquet(str(at)).isEmpty():
            return None
        return Run(f"data/{name}", sum(s.getLen() for s in files), len(files))

    def append(self, arrivals: DataFrame, by: str | None = None) -> Manifest:
        """Write rows as new runs, one for each value of the column ``by`` (then not stored), and commit each as an arrival."""
        stem = uuid.uuid4().hex
        columns = [c for c in arrivals.columns if c != by]
        writer = arrivals.write.mode("error")
        (writer.partitionBy(by) if by else writer).parquet(str(self._path("data", stem)))
        fs = self._fs
        names = sorted(f"{stem}/{s.getPath().getName()}" for s in fs.listStatus(self._path("data", stem)) if s.isDirectory()) if by else [stem]
        schema = arrivals.select(*columns).schema.json()
        last = None
        for name in names:
            run = self._run(name)
            last = self._change(lambda m, run=run: Manifest(m.version + 1 if m else 1, m.schema if m else schema, (m.runs if m else ()) + ((run,) if run else ())))
        return last or self._change(lambda m: m or Manifest(1, schema, ()))

    def _read(self, runs: tuple[Run, ...], schema: str) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[str(self._path(r.path)) for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the newest by default)."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(f"no manifest under {self.root}")
        return self._read(m.runs, m.schema)

    def compact(self) -> Manifest | None:
        """Merge full tiers until none is left."""
        while True:
            now = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for r in now.runs if now else ():
                tiers.setdefault(r.tier, []).append(r)
            full = next((sorted(rs, key=lambda r: (r.bytes, r.path))[: self.fan_in] for _, rs in sorted(tiers.items()) if len(rs) >= self.fan_in), None)
            if full is None:
                return now
            name = uuid.uuid4().hex
            files = max(1, -(-sum(r.bytes for r in full) // self.target_bytes))
            self._read(tuple(full), now.schema).coalesce(files).write.parquet(str(self._path("data", name)))
            merged, gone = self._run(name), {r.path for r in full}

            def swap(m: Manifest, merged=merged, gone=gone) -> Manifest | None:
                if not gone <= {r.path for r in m.runs}:
                    return None  # another writer merged some of them first
                return replace(m, version=m.version + 1, runs=(*(r for r in m.runs if r.path not in gone), merged))

            self._change(swap)

    def vacuum(self, keep_versions: int = 1, min_age_s: float = 86_400.0) -> int:
        """Remove run folders that the newest ``keep_versions`` manifests don't name; how many went.

        Folders younger than ``min_age_s`` stay: another writer may be about to commit them.
        """
        oldest = (time.time() - min_age_s) * 1000
        kept = {r.path for v in self.versions()[-keep_versions:] for r in self.manifest(v).runs}
        fs, gone = self._fs, 0
        for top in fs.listStatus(self._path("data")):
            if min_age_s and top.getModificationTime() > oldest:
                continue
            stem = f"data/{top.getPath().getName()}"
            inner = [f"{stem}/{s.getPath().getName()}" for s in fs.listStatus(top.getPath()) if s.isDirectory() and "=" in s.getPath().getName()]
            for p in inner or [stem]:
                if p not in kept:
                    fs.delete(self._path(*p.split("/")), True)
                    gone += 1
        return gone


def arrive_and_compact(rows: DataFrame, root: str, arrivals: int, key: str) -> DataFrame:
    """Store ``rows`` as ``arrivals`` small runs, compact, drop what was replaced, and read the result."""
    store = ShardStore(rows.sparkSession, root)
    arrival = free_name(rows, "arrival")
    store.append(rows.withColumn(arrival, F.pmod(F.xxhash64(key), F.lit(arrivals))), by=arrival)
    store.compact()
    store.vacuum(min_age_s=0)  # the store has no other writer
    return store.read()
