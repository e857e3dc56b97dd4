"""A versioned key-value store on files: batches, snapshots, flushes and leveled compaction under a manifest.

Every change of the store is one new manifest, a JSON file that is written under a name of its own and then takes the next
number in one step that fails if the number is taken: two writers can't take the same, readers always see a whole state,
and what a failed writer left is never referred to. That step is a link on local file systems and a rename that doesn't
replace elsewhere, so a shared store needs such a rename, as HDFS has. Data files are Parquet and are never changed;
vacuum() removes those that no manifest in use names.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import compact
from palimpsest.operators.resolve import live, newest
from palimpsest.operators.runs import block_candidate, block_index, run_stats, write_run
from palimpsest.schema import COLUMNS, MUTATION, mutations, tagged, value_text
from palimpsest.sources.files import read_file, write_file

#: Names of batches that a manifest holds itself; more of them go to a file.
BATCHES = 1000


class KVStore:
    """path: a folder that all executors reach. flush_threshold: live keys of the buffer from which it is flushed, so
    deletes alone don't flush it; most_operations flushes it from so many operations on, too."""

    def __init__(self, spark: SparkSession, path: str, flush_threshold: int = 1000, target_entries: int | None = None, backend: str = "leveled", most_operations: int | None = None):
        self.spark, self.path, self.flush_threshold = spark, path.rstrip("/"), flush_threshold
        self.target_entries, self.backend = target_entries or flush_threshold, backend
        self.most_operations = most_operations
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))
        new = {"version": 0, "seq": 0, "next_table": 0, "log": [], "log_ops": 0, "runs": [], "pins": {}, "batches": [], "batch_files": [], "streams": {}}
        sums = {"user_chars": 0, "disk_chars": 0, "merged_bytes": 0, "merge_ms": 0, "compactions": 0, "waits": 0}
        self.manifest = new | sums | (self._latest() or {})

    # manifest

    def _versions(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _latest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{versions[-1]:012d}.json", wholetext=True).first()[0])

    def _commit(self, **change) -> None:
        """Write the next manifest under a name of its own, then take its number, which must be free."""
        new = {**self.manifest, **change, "version": self.manifest["version"] + 1}
        held = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(held, False)
        out.write(json.dumps(new).encode())
        out.close()
        taken = self._take(held, self._path(f"{self.path}/manifest/{new['version']:012d}.json"))
        self._fs.delete(held, False)
        if not taken:
            raise RuntimeError(f"version {new['version']} was committed by another writer")
        self.manifest = new

    def _take(self, held, target) -> bool:
        jvm = self.spark.sparkContext._jvm
        try:
            if self._fs.getUri().getScheme() == "file":
                place = lambda p: jvm.java.nio.file.Paths.get(jvm.java.net.URI.create("file://" + p.toUri().getPath()))
                jvm.java.nio.file.Files.createLink(place(target), place(held))
                return True
            return self._fs.rename(held, target)
        except Py4JJavaError as problem:
            if "AlreadyExists" in problem.java_exception.getClass().getName():
                return False
            raise

    # reading

    def _read(self, paths: list[str]) -> DataFrame:
        kinds = MUTATION
        if not paths:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/{p}" for p in paths])

    def log(self) -> DataFrame:
        """Operations that aren't flushed."""
        return self._read(self.manifest["log"])

    def runs(self, level: int | None = None, key: str | None = None) -> DataFrame:
        """Entries of the runs with level and table_id; with a key, of the runs whose range may hold it only. The runs are
        read as one scan."""
        chosen = [r for r in self.manifest["runs"] if (level is None or r["level"] == level) and (key is None or r["min_key"] <= key <= r["max_key"])]
        if not chosen:
            return self._read([]).withColumn("level", F.lit(0)).withColumn("table_id", F.lit(0).cast("bigint"))
        path = F.regexp_extract(F.col("_metadata.file_path"), r"/(runs/[^/]+(?:/folder=\d+)?)/[^/]+$", 1)
        of_run = self.spark.createDataFrame([(r["path"], r["level"], r["table_id"]) for r in chosen], "_path string, level int, table_id bigint")
        return self._read([r["path"] for r in chosen]).select("*", path.alias("_path")).join(F.broadcast(of_run), "_path").drop("_path")

    def run_manifest(self) -> DataFrame:
        kinds = "table_id bigint, level int, path string, min_key string, max_key string, n_entries bigint, bytes bigint, max_seq bigint"
        return self.spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in kinds.split(", ")) for r in self.manifest["runs"]], kinds)

    def _all(self, key: str | None = None) -> DataFrame:
        """All versions; runs whose range can't hold the key aren't opened."""
        runs = [r["path"] for r in self.manifest["runs"] if key is None or r["min_key"] <= key <= r["max_key"]]
        both = self.log().unionByName(self._read(runs))
        return both if key is None else both.filter(F.col("key") == key)

    def get(self, key: str, snapshot: int | None = None):
        """The value at the latest or at a snapshot; None on a miss, '' with the append-only backend."""
        row = live(self._all(key), snapshot).first()
        if row is None:
            return "" if self.backend == "bitcask" else None
        return self._value(row)

    @staticmethod
    def _value(row):
        return next((v for v in (row["v_long"], row["v_double"], row["v_string"]) if v is not None), None)

    def get_from_run(self, table_id: int, key: str, snapshot: int | None = None):
        """(found, value) of one run: the newest version that it has for the snapshot; a tombstone is found without value.
        The run isn't opened if its range can't hold the key, and its bloom filter is asked before its blocks."""
        run = next(r for r in self.manifest["runs"] if r["table_id"] == table_id)
        if not run["min_key"] <= key <= run["max_key"]:
            return False, None
        row = newest(self._read([run["path"]]).filter(F.col("key") == key), snapshot).first()
        return row is not None, None if row is None else self._value(row)

    def get_from_level(self, level: int, key: str, snapshot: int | None = None):
        """(found, value) of one level: of its runs that could hold the key, the newest version for the snapshot."""
        row = newest(self.runs(level, key).filter(F.col("key") == key), snapshot).first()
        return row is not None, None if row is None else self._value(row)

    def blocks(self, table_id: int, keys: DataFrame) -> DataFrame:
        """Each key with the block of a run that could hold it, by the run's stored index."""
        run = next(r for r in self.manifest["runs"] if r["table_id"] == table_id)
        index = self.spark.read.schema("table_id bigint, first_key string, file_offset bigint").parquet(f"{self.path}/{run['index']}")
        return block_candidate(keys, index.filter(F.col("table_id") == table_id))

    def locate(self, key: str) -> str:
        """Where the newest version lies, tombstones included: 'buffer', 'level n (sst_…)' or 'none'."""
        tiers = self.log().withColumns({"level": F.lit(-1), "table_id": F.lit(-1).cast("bigint")}).unionByName(self.runs(key=key)).filter(F.col("key") == key)
        row = newest(tiers, carry=("level", "table_id")).first()
        return "none" if row is None else "buffer" if row["level"] < 0 else f"level {row['level']} (sst_{row['table_id']:05d})"

    def keys(self, snapshot: int | None = None) -> DataFrame:
        return live(self._all(), snapshot).select("key").orderBy("key")

    def scan(self, snapshot: int | None = None) -> DataFrame:
        return live(self._all(), snapshot)

    def size(self) -> int:
        """Live keys of the whole store."""
        return live(self._all()).count()

    def buffer_size(self) -> int:
        """Live keys of what isn't flushed."""
        return live(self.log()).count()

    # writing

    def put(self, key: str, value) -> int:
        return self.write([(key, value)])

    def delete(self, key: str) -> int:
        return self.write([(key, None)])

    def _known(self, batch_id: str) -> bool:
        """Whether a batch of that name was committed. Names beyond BATCHES are in files that never change."""
        files = self.__dict__.setdefault("_batch_names", {})
        for path in self.manifest["batch_files"]:
            if path not in files:
                files[path] = set(json.loads(read_file(self.spark, f"{self.path}/{path}")))
        return batch_id in self.manifest["batches"] or any(batch_id in names for names in files.values())

    def write(self, batch, batch_id: str | None = None, stream: str | None = None, number: int | None = None) -> int:
        """Commit a batch, a list of (key, value or None) or a DataFrame of mutations in the order of op_index or seq.

        All of it gets one sequence, which is returned, and is visible at once. An empty batch changes nothing, nor does a
        batch_id that was ever committed, nor a ``number`` that isn't above the highest one committed for its ``stream``.
        A value of a type that can't be stored is refused before anything is written, as is a DataFrame that has neither
        op_index nor seq, whose rows have no order.
        """
        if batch_id is not None and self._known(batch_id):
            return self.manifest["seq"]
        if stream is not None and number <= self.manifest["streams"].get(stream, -1):
            return self.manifest["seq"]
        if not isinstance(batch, DataFrame):
            for key, value in batch:
                if not isinstance(key, str) or isinstance(value, bool) or not isinstance(value, (int, float, str, type(None))):
                    raise TypeError(f"can't store {type(value).__name__} under {key!r}")
            rows = [(k, i, v if isinstance(v, int) else None, v if isinstance(v, float) else None, v if isinstance(v, str) else None) for i, (k, v) in enumerate(batch)]
            batch = self.spark.createDataFrame(rows, "key string, op_index int, l bigint, d double, s string").select("key", "op_index", *tagged(v_long=F.col("l"), v_double=F.col("d"), v_string=F.col("s")))
        elif "op_index" not in batch.columns or "seq" in batch.columns:
            order = [c for c in ("seq", "op_index") if c in batch.columns]
            if not order:
                raise ValueError("a batch needs op_index or seq: its rows have no order of their own")
            batch = batch.withColumn("op_index", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
        seq = self.manifest["seq"] + 1
        path = f"log/{seq:012d}-{uuid.uuid4().hex[:8]}"
        mutations(batch.withColumn("seq", F.lit(seq))).write.parquet(f"{self.path}/{path}")
        written = self._read([path])
        n, chars = written.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key") + F.coalesce(F.length(value_text()), F.lit(0))), F.lit(0))).first()
        if not n:
            return self.manifest["seq"]
        m = self.manifest
        names, files = [*m["batches"], *([] if batch_id is None else [batch_id])], m["batch_files"]
        if len(names) > BATCHES:
            files = [*files, f"batches/{uuid.uuid4().hex}.json"]
            write_file(self.spark, f"{self.path}/{files[-1]}", json.dumps(names).encode())
            names = []
        streams = m["streams"] if stream is None else {**m["streams"], stream: number}
        waits = m["waits"] + (sum(r["level"] == 0 for r in m["runs"]) >= compact.BACKPRESSURE)
        self._commit(seq=seq, log=[*m["log"], path], log_ops=m["log_ops"] + n, batches=names, batch_files=files, streams=streams, waits=waits, user_chars=m["user_chars"] + chars, disk_chars=m["disk_chars"] + chars)
        if self.buffer_size() >= self.flush_threshold or (self.most_operations is not None and self.manifest["log_ops"] >= self.most_operations):
            self.flush()
        return seq

    def snapshot(self, pin: str | None = None) -> int:
        """The current sequence; with a name, compaction keeps what a read at it sees until unpin()."""
        if pin is not None:
            self._commit(pins={**self.manifest["pins"], pin: self.manifest["seq"]})
        return self.manifest["seq"]

    def unpin(self, pin: str) -> None:
        self._commit(pins={k: v for k, v in self.manifest["pins"].items() if k != pin})

    # maintenance

    def _index(self, written: DataFrame, stem: str) -> str:
        """Write the block index of the runs (table_id, key, ...) in a folder beside them."""
        path = stem.replace("runs/", "index/", 1)
        block_index(written).write.parquet(f"{self.path}/{path}")
        return path

    def _add(self, run: DataFrame, level: int) -> list[dict]:
        """Write a run and return its manifest rows: none if it is empty."""
        table_id = self.manifest["next_table"]
        path = f"runs/sst_{table_id:05d}-{uuid.uuid4().hex[:8]}"
        written = write_run(run.select(*COLUMNS), f"{self.path}/{path}", 1).withColumn("table_id", F.lit(table_id).cast("bigint"))
        stats = run_stats(written).first()
        return [] if stats is None else [{**stats.asDict(), "level": level, "path": path, "index": self._index(written, path)}]

    def flush(self) -> None:
        """Write the buffer as a run of level 0, tombstones and versions that a pin sees included, and drop its log."""
        if not self.manifest["log"]:
            return
        pins = tuple(self.manifest["pins"].values())
        added = self._add(compact.merged(self.log(), bottom=False, pins=pins), 0)
        self._commit(log=[], log_ops=0, runs=[*self.manifest["runs"], *added], next_table=self.manifest["next_table"] + 1, disk_chars=self.manifest["disk_chars"] + sum(r["bytes"] for r in added))
        self.compact()

    def compact(self) -> None:
        """Compact every level that has TRIGGER runs or more into the next, from the top."""
        for level in range(compact.LEVELS - 1):
            due = [r for r in self.manifest["runs"] if r["level"] == level]
            if len(due) >= compact.TRIGGER:
                self._compact(level, due)

    def _compact(self, level: int, due: list[dict]) -> None:
        chosen = due if level == 0 else [min(due, key=lambda r: (r["min_key"], r["table_id"]))]
        low, high = min(r["min_key"] for r in chosen), max(r["max_key"] for r in chosen)
        below = [r for r in self.manifest["runs"] if r["level"] == level + 1 and r["min_key"] <= high and r["max_key"] >= low]
        inputs = chosen + below
        bottom = not any(r["level"] > level + 1 for r in self.manifest["runs"])
        out = compact.compacted(self._read([r["path"] for r in inputs]), target=self.target_entries, bottom=bottom, pins=tuple(self.manifest["pins"].values()))
        began = time.monotonic()
        # one job writes all runs of the output, one folder each
        first = self.manifest["next_table"]
        stem = f"runs/level{level + 1}-{uuid.uuid4().hex[:8]}"
        out = out.withColumn("table_id", F.col("table_id") + first).withColumn("folder", F.col("table_id"))
        out.repartition("folder").sortWithinPartitions("folder", "key", F.desc("seq")).write.partitionBy("folder").option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{stem}")
        written = self.spark.read.schema(f"{MUTATION}, table_id bigint").parquet(f"{self.path}/{stem}")
        stats = run_stats(written).orderBy("table_id").collect()  # a row per run
        index = self._index(written, stem) if stats else None
        added = [{**r.asDict(), "level": level + 1, "path": f"{stem}/folder={r['table_id']}", "index": index} for r in stats]
        gone = {r["table_id"] for r in inputs}
        runs = [r for r in self.manifest["runs"] if r["table_id"] not in gone] + added
        m, millis = self.manifest, max(1, int(1000 * (time.monotonic() - began)))
        counted = {"merged_bytes": m["merged_bytes"] + sum(r["bytes"] for r in inputs), "merge_ms": m["merge_ms"] + millis, "compactions": m["compactions"] + 1}
        self._commit(runs=runs, next_table=first + len(added), disk_chars=m["disk_chars"] + sum(r["bytes"] for r in added), **counted)

    def vacuum(self) -> list[str]:
        """Remove data that the current manifest doesn't name, and older manifests; returns what was removed."""
        named, removed = {*self.manifest["log"], *(r[c] for r in self.manifest["runs"] for c in ("path", "index"))}, []
        for top in ("log", "runs", "index"):
            folder = self._path(f"{self.path}/{top}")
            for f in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                name = f"{top}/{f.getPath().getName()}"
                if not any(n == name or n.startswith(f"{name}/") for n in named):
                    self._fs.delete(f.getPath(), True)
                    removed.append(name)
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifest/{v:012d}.json"), False)
        return removed

    def amplification(self) -> dict:
        """Write and space amplification in characters; 1.0 where nothing was written or lives."""
        user, disk = self.manifest["user_chars"], self.manifest["disk_chars"]
        alive = live(self._all()).agg(F.sum(F.length("key") + F.length(value_text()))).first()[0] or 0
        held = sum(r["bytes"] for r in self.manifest["runs"])
        return {"waf": disk / user if user > 0 else 1.0, "saf": held / alive if alive > 0 else 1.0}

    def counters(self) -> dict:
        """What was written, merged and waited for so far, the merges' MB/s, and whether writers should wait now."""
        m = self.manifest
        rate = m["merged_bytes"] / (1 << 20) / (m["merge_ms"] / 1000) if m["merge_ms"] else 0.0
        wait = sum(r["level"] == 0 for r in m["runs"]) >= compact.BACKPRESSURE
        return {c: m[c] for c in ("user_chars", "disk_chars", "merged_bytes", "merge_ms", "compactions", "waits")} | {"merge_mb_per_s": rate, "writers_wait": wait}
