"""Size-tiered compaction of a table of immutable Parquet shards under a versioned manifest.

Arrivals are appended as small shards. A shard's tier is the power of `fan_in` that its size has reached; once a tier holds
`fan_in` shards or more, they are packed in order of arrival into groups of at most the target size and each group is written
as one new shard. A round takes at most ROUND shards, so what a job has to know of them is bounded; the rounds go on until no
tier is full. Old shards aren't touched, so readers of an older version are not disturbed; `vacuum` removes what no kept
version names. A version exists once its manifest has been renamed to its number, which only one writer can do.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidenta.llm.common import fresh

TARGET_BYTES = 32 << 20
FAN_IN = 4
#: Arrivals are cut into shards of at most this part of the target.
PARTS = 8
#: Shards that one job merges, at most; their names and groups (under 100 bytes each) are broadcast to it.
ROUND = 1 << 16
#: Shards below this size are one tier.
LEAST_BYTES = 64 << 10
GROUP = "__group"


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Shard:
    path: str
    size: int
    arrival: int


def tier(size: int, fan_in: int = FAN_IN, least: int = LEAST_BYTES) -> int:
    """Number of times a shard has outgrown the smallest tier by the factor `fan_in`."""
    return 0 if size <= least else 1 + int(math.log(size / least, fan_in))


def merge_groups(shards: list[Shard], target: int = TARGET_BYTES, fan_in: int = FAN_IN, least: int = LEAST_BYTES) -> list[list[Shard]]:
    """Groups of two or more similarly sized shards, each of at most `target` bytes, by tier and arrival."""
    tiers: dict[int, list[Shard]] = {}
    for s in sorted(shards, key=lambda s: (s.arrival, s.path)):
        if 2 * s.size <= target:
            tiers.setdefault(tier(s.size, fan_in, least), []).append(s)
    out: list[list[Shard]] = []
    for _, own in sorted(tiers.items()):
        if len(own) < fan_in:
            continue
        now: list[Shard] = []
        for s in own:
            if now and sum(x.size for x in now) + s.size > target:
                out.append(now)
                now = []
            now.append(s)
        out.append(now)
    found, n = [], 0
    for g in (g for g in out if len(g) > 1):
        n += len(g)
        if n > ROUND:
            break
        found.append(g)
    return found


class ShardStore:
    """A sharded table at `root`, in any file system that Hadoop reaches and that renames atomically."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN, least: int = LEAST_BYTES):
        self.spark, self.root, self.target, self.fan_in, self.least = spark, root.rstrip("/"), target, fan_in, least
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.root}/{name}")

    def versions(self) -> list[int]:
        """Committed versions in order."""
        at = self._path("manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards) of a version, the latest if none is named; (0, []) of an empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, []
        rows = self.spark.read.text(f"{self.root}/manifest/v{version:010d}.json", wholetext=True).first()[0]
        return version, [Shard(**x) for x in json.loads(rows)]

    def commit(self, version: int, shards: list[Shard]) -> int:
        """Make `shards` the content of `version`; Conflict if that version exists."""
        draft, final = self._path(f"manifest/.draft-{uuid.uuid4().hex}"), self._path(f"manifest/v{version:010d}.json")
        self.fs.mkdirs(self._path("manifest"))
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps([asdict(s) for s in shards]).encode()))
        out.close()
        # rename without overwriting is the commit
        option = self.spark._jvm.java.lang.reflect.Array.newInstance(self.spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        context = self.hadoop.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), option)
        except Exception as e:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                raise Conflict(f"version {version} exists") from e
            raise
        return version

    def _written(self, name: str, arrival: int) -> list[Shard]:
        """Shards below a folder that a Spark job has committed."""
        found, files = [], self.fs.listFiles(self._path(name), True)
        base = self.fs.makeQualified(self.hadoop.Path(self.root)).toString().rstrip("/") + "/"
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append(Shard(f.getPath().toString().removeprefix(base), int(f.getLen()), arrival))
        return sorted(found, key=lambda s: s.path)

    def append(self, df: DataFrame, rows: int = 0) -> int:
        """Write the rows of `df` as new shards of at most `rows` rows (0: one for each partition that has rows), and commit them."""
        version, shards = self.manifest()
        name = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/{name}")
        return self.commit(version + 1, shards + self._written(name, version + 1))

    def compact(self) -> int:
        """Merge until no tier has a group left; each round is one Spark job and one version. Returns the last version."""
        version, shards = self.manifest()
        while groups := merge_groups(shards, self.target, self.fan_in, self.least):
            name = f"data/{uuid.uuid4().hex}"
            base = self.fs.makeQualified(self.hadoop.Path(self.root)).toString().rstrip("/") + "/"
            pairs = [("/".join(s.path.split("/")[-2:]), k) for k, g in enumerate(groups) for s in g]
            source = self.spark.read.parquet(*(base + s.path for g in groups for s in g))
            file, group = fresh(source, "__file"), fresh(source, GROUP)
            # ROUND short rows at most
            number = F.broadcast(self.spark.createDataFrame(pairs, f"`{file}` string, `{group}` int"))
            rows = source.withColumn(file, F.regexp_extract("_metadata.file_path", "([^/]+/[^/]+)$", 1))
            merged = rows.join(number, file).drop(file).repartitionById(len(groups), F.col(group))
            merged.drop(group).write.option("maxRecordsPerFile", 0).option("compression", "zstd").parquet(f"{self.root}/{name}")
            gone = {s.path for g in groups for s in g}
            shards = [s for s in shards if s.path not in gone] + self._written(name, min(s.arrival for g in groups for s in g))
            version = self.commit(version + 1, shards)
        return version

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of a version; `schema` is that of the table, for a store without shards."""
        _, shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{s.path}" for s in shards))

    def vacuum(self, keep: int = 1) -> int:
        """Delete shards that none of the last `keep` versions names, and older manifests; returns the number of shards."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        live = {s.path for v in kept for s in self.manifest(v)[1]}
        dead = {s.path for v in old for s in self.manifest(v)[1]} - live
        for path in dead:
            self.fs.delete(self._path(path), False)
        for v in old:
            self.fs.delete(self._path(f"manifest/v{v:010d}.json"), False)
        return len(dead)


def rows_of(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """Rows of a shard that is a PARTS-th of the target, by the bytes that the files of a scan have for each of its rows."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return max(1, int(target / PARTS * df.count() / total)) if total else 0


def shard(arrivals: list[DataFrame], root: str, target: int = TARGET_BYTES, fan_in: int = FAN_IN, rows: int = 0) -> ShardStore:
    """Append each of `arrivals` in order, then compact; returns the store.

    Every row is kept as it is: nulls in any column, empty and very long texts, repeated rows and any column names. Shards of
    an arrival have at most `rows` rows (0: no limit), see rows_of. An empty table adds a version, and no shard with rows; at
    least one arrival is needed. A job that is lost before its commit leaves files that no version names.
    """
    if not arrivals:
        raise ValueError("nothing has arrived")
    store = ShardStore(arrivals[0].sparkSession, root, target, fan_in)
    for df in arrivals:
        store.append(df, rows)
    store.compact()
    return store
