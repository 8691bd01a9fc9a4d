"""A catalog: tables by name, and snapshots of them: buckets of rows under a hash tree, and a manifest.

Write verbs are functions from a catalog to a catalog. Nothing is stored until snapshot(). It deals each table's rows to
buckets by their key and hashes every bucket; only buckets that the current snapshot has otherwise are written, the others
are named where they lie. What was written is read back and hashed again, and compared with what was to be written; if it
differs, it is deleted and nothing else has happened. Then the manifest is put in place in one step.

The bucket hashes are the leaves of a tree for each table, sixteen to a node, and the tables' roots give the snapshot's.
Two snapshots are compared from the roots down, so that only buckets that differ are named, and only these are read for
the rows that differ. A table's buckets are counted when it is first stored: one for each BUCKET_ROWS rows.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.plan import numbered
from ..specs import TABLES, FIELDS, schema_of

SCHEMA_VERSION = 17
_NAME = re.compile(r"^anamnex-(\d{8})-(\d{4})(\d{2})?$")


class SnapshotError(ValueError):
    """A snapshot is missing, damaged or would be overwritten."""


@dataclass(frozen=True)
class Catalog:
    """Tables by name. A table may be given as a function, which is called when the table is first asked for."""

    spark: SparkSession
    made: dict[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    #: What was found out about tables, with the table that it was found for.
    facts: dict = field(default_factory=dict, compare=False, repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        """A table; an empty one of its schema where the catalog has none (as older snapshots don't)."""
        if name not in self.made:
            return self.spark.createDataFrame([], schema_of(name))
        if callable(found := self.made[name]):
            found = self.made[name] = found()
        return found

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: self[name] for name in self.made}

    def with_tables(self, **changed: DataFrame) -> Catalog:
        return Catalog(self.spark, {**self.made, **changed})

    def has(self, name: str) -> bool:
        return name in self.made


class Files:
    """The few file operations that snapshots need, through Hadoop, so that any store will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.jvm, self.gateway, self.root, self.conf = spark._jvm, spark.sparkContext._gateway, root.rstrip("/"), spark._jsc.hadoopConfiguration()
        self.path_class = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path_class(self.root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.path_class(f"{self.root}/{name}")

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name) if name else self.path_class(self.root))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: a new file is renamed over what was there, in one step."""
        self._rename(name, text, "OVERWRITE")

    def put(self, name: str, text: str) -> None:
        """As write(), but fails if there is such a file: of several writers, one succeeds."""
        self._rename(name, text, "NONE")

    def _rename(self, name: str, text: str, how: str) -> None:
        made = self.path(f".{name.replace('/', '_')}.{uuid.uuid4().hex}.new")
        self.fs.mkdirs(self.path(name).getParent())
        stream = self.fs.create(made, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        whole = [self.fs.makeQualified(p) for p in (made, self.path(name))]
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole[0].toUri(), self.conf).rename(*whole, options)
        except Py4JJavaError as error:
            self.fs.delete(made, False)
            raise SnapshotError(f"{name} could not be put in place: {error.java_exception.getClass().getSimpleName()}") from None

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path_class(self.root))) if self.exists() else []

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def snapshot_name(now: dt.datetime) -> str:
    return now.strftime("anamnex-%Y%m%d-%H%M%S")


def parsed_name(name: str) -> dt.datetime | None:
    m = _NAME.match(name)
    try:
        return dt.datetime.strptime(m[1] + m[2] + (m[3] or "00"), "%Y%m%d%H%M%S") if m else None
    except ValueError:
        return None


#: Rows for which a table gets a bucket when it is first stored, buckets at most, and children of a node.
BUCKET_ROWS, MOST_BUCKETS, WIDTH = 1_000_000, 4096, 16
#: Rows that a task writes, about: whatever the session's number of shuffle partitions, tasks stay of one size.
TASK_ROWS = 250_000
#: Tables that are stored or checked at once.
AT_ONCE = 8


def bucketed(df: DataFrame, table: str, n: int) -> DataFrame:
    """df with a bucket by the table's key, or by the whole row where it has none; and hashes of its rows."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    key = [F.col(f"{table}_id")] if f"{table}_id" in df.columns else columns
    return df.select("*", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int").alias("__bucket"), F.xxhash64(*columns).alias("__h1"), F.xxhash64(F.lit("second"), *columns).alias("__h2"))


def written_parts(rows: int, buckets: int, each: int = TASK_ROWS) -> tuple[int, int]:
    """Tasks that write so many rows of so many buckets, and slices of a bucket: twice as many as `each` rows a task need, as slices fall to tasks by hash."""
    return max(1, 2 * -(-rows // each)), max(1, -(-rows // (max(1, buckets) * each)))


def bucket_hashes(rows: DataFrame) -> dict[int, dict]:
    """Rows and hash of each bucket that has rows, whatever their order; at most MOST_BUCKETS of them."""
    sums = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("__h1", "__h2"))
    found = rows.groupBy("__bucket").agg(F.count("*").alias("n"), *sums).collect()
    return {r["__bucket"]: {"rows": r["n"], "sums": (r["__h1"], r["__h2"]), "hash": hashlib.sha256(f"{r['n']}:{r['__h1']}:{r['__h2']}".encode()).hexdigest()} for r in found}


def tree(hashes: dict[int, str], n: int) -> list[list[str]]:
    """Levels of the tree over n buckets, leaves first; an empty bucket's hash is empty."""
    levels = [[hashes.get(k, "") for k in range(n)]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256("|".join(below[k : k + WIDTH]).encode()).hexdigest() for k in range(0, len(below), WIDTH)])
    return levels


def differing(one: list[list[str]], other: list[list[str]]) -> list[int]:
    """Buckets in which two trees of one size differ; nodes that agree are not opened."""
    at = [0] if one[-1] != other[-1] else []
    for level in range(len(one) - 2, -1, -1):
        at = [k for node in at for k in range(node * WIDTH, min(node * WIDTH + WIDTH, len(one[level]))) if one[level][k] != other[level][k]]
    return at


def manifest_of(files: Files, name: str) -> dict:
    if not files.exists(f"{name}/manifest.json"):
        raise SnapshotError(f"{name} has no manifest")
    return json.loads(files.read(f"{name}/manifest.json"))


def current_name(files: Files) -> str | None:
    return json.loads(files.read("current.json"))["current"] if files.exists("current.json") else None


def snapshot(catalog: Catalog, root: str, name: str, bucket_rows: int = BUCKET_ROWS) -> dict:
    """Store all tables as root/name and make it the current snapshot; never overwrites. Returns the manifest, where `written` names the buckets that were written."""
    files = Files(catalog.spark, root)
    if files.exists(name):
        raise SnapshotError(f"snapshot {name} exists")
    now = current_name(files)
    before = manifest_of(files, now)["tables"] if now and files.exists(f"{now}/manifest.json") else {}
    entry: dict = {"name": name, "schema_version": SCHEMA_VERSION, "tables": {}, "written": {}}
    try:
        tables = catalog.tables
        with ThreadPoolExecutor(AT_ONCE) as pool:  # their jobs share the cluster
            stored_ = pool.map(inheritable_thread_target(catalog.spark)(lambda t: _store(files, name, t, tables[t], before.get(t), bucket_rows)), tables)
            for table, (made, changed) in zip(tables, stored_):
                entry["tables"][table], entry["written"][table] = made, changed
        roots = sorted((t, e["tree"][-1][0]) for t, e in entry["tables"].items())
        entry["root"] = hashlib.sha256(json.dumps(roots).encode()).hexdigest()
        files.write(f"{name}/manifest.json", json.dumps(entry, sort_keys=True))
    except Exception:
        files.drop(name)  # nothing refers to it yet
        raise
    files.write("current.json", json.dumps({"current": name}))
    return entry


def _form(schema: str) -> str:
    """What of a schema decides whether stored buckets can be kept."""
    return StructType.fromJson(json.loads(schema)).simpleString()


def _store(files: Files, name: str, table: str, df: DataFrame, was: dict | None, bucket_rows: int) -> tuple[dict, list[int]]:
    """The entry of one table, and the buckets that were written for it."""
    schema = df.schema.json()
    if was and _form(was["schema"]) == _form(schema):
        n = was["buckets"]
    else:
        total, was = df.count(), None
        n = min(MOST_BUCKETS, max(1, -(-total // bucket_rows)))
    place = f"{name}/{table}"
    rows, counted = bucketed(df, table, n), Observation()
    meant, changed = {}, []
    if was:  # what is the same is not written again
        meant = bucket_hashes(rows)
        changed = [k for k, b in meant.items() if was["tree"][0][k] != b["hash"]]
        if len(changed) < n:
            rows = rows.where(F.col("__bucket").isin(changed))
    if changed or (not was and total):
        sums = (F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("__h1", "__h2"))
        rows = rows.observe(counted, F.count(F.lit(1)).alias("n"), *sums)  # hashed on its way to the files
        if was:
            total = sum(meant[k]["rows"] for k in changed)
        parts, slices = written_parts(total, len(changed) if was else n)
        rows = rows.withColumn("__slice", F.pmod("__h2", F.lit(slices))).repartition(parts, "__bucket", "__slice").drop("__h1", "__h2", "__slice")
        # most of a row is hashes in hex, which zstd halves
        rows.write.mode("errorifexists").option("compression", "zstd").partitionBy("__bucket").parquet(f"{files.root}/{place}")
        there = [int(x.rpartition("=")[2]) for x in Files(files.spark, f"{files.root}/{place}").names() if x.startswith("__bucket=")]
        found = _hashes_of(files, table, df.schema, {k: f"{place}/__bucket={k}" for k in there}, n)
        sent, kept = counted.get, list(found.values())
        if (sent["n"], sent["__h1"] or 0, sent["__h2"] or 0) != (sum(b["rows"] for b in kept), sum(b["sums"][0] for b in kept), sum(b["sums"][1] for b in kept)):
            raise SnapshotError(f"what was written of {table} differs from what was to be written")
        if not was:
            meant, changed = found, list(found)
        elif wrong := [k for k in changed if found.get(k) != meant[k]]:
            raise SnapshotError(f"what was written of {table} differs from what was to be written, in buckets {sorted(wrong)}")
    places = {k: f"{place}/__bucket={k}" if k in set(changed) else was["places"][str(k)] for k in meant}
    return {"schema": schema, "buckets": n, "rows": sum(b["rows"] for b in meant.values()), "tree": tree({k: b["hash"] for k, b in meant.items()}, n), "places": {str(k): p for k, p in sorted(places.items())}}, sorted(changed)


def _read(files: Files, schema: StructType, places) -> DataFrame:
    """The rows of some buckets, without looking at any other."""
    paths = [f"{files.root}/{p}" for p in places]
    return files.spark.read.schema(schema).parquet(*paths) if paths else files.spark.createDataFrame([], schema)


def _hashes_of(files: Files, table: str, schema: StructType, places: dict, n: int) -> dict[int, dict]:
    """Bucket hashes of what is stored; files that can't be read have no rows."""
    there = [p for p in places.values() if files.exists(p)]
    if not there:
        return {}
    reader = files.spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return bucket_hashes(bucketed(reader.parquet(*(f"{files.root}/{p}" for p in there)), table, n))


def damaged(spark: SparkSession, root: str, name: str) -> list[tuple[str, int]]:
    """(table, bucket) of what is not as the manifest has it."""
    files = Files(spark, root)

    def of(item: tuple[str, dict]) -> list[tuple[str, int]]:
        table, e = item
        places = {int(k): p for k, p in e["places"].items()}
        found = _hashes_of(files, table, StructType.fromJson(json.loads(e["schema"])), places, e["buckets"])
        held = {k: b["hash"] for k, b in found.items()}
        return [(table, k) for k in differing(e["tree"], tree(held, e["buckets"]))]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [x for found in pool.map(inheritable_thread_target(spark)(of), manifest_of(files, name)["tables"].items()) for x in found]


def integrity(spark: SparkSession, root: str, name: str) -> str:
    """'ok', or what is wrong with a snapshot."""
    files = Files(spark, root)
    if not files.exists(f"{name}/manifest.json"):
        return f"{name} has no manifest"
    manifest = manifest_of(files, name)
    for table, e in manifest["tables"].items():
        if tree(dict(enumerate(e["tree"][0])), e["buckets"]) != e["tree"]:
            return f"the tree of {table} in the manifest of {name} is damaged"
        for k, place in e["places"].items():
            if not files.exists(place):
                return f"{name} has lost bucket {k} of table {table}"
    wrong = damaged(spark, root, name)
    return "ok" if not wrong else f"{name} differs from its manifest in " + ", ".join(f"bucket {k} of table {t}" for t, k in wrong)


def changed_buckets(spark: SparkSession, root: str, one: str, other: str) -> dict[str, list[int] | None]:
    """Buckets in which two snapshots differ, by table, from their manifests alone; None where a table's form differs."""
    files = Files(spark, root)
    a, b = (manifest_of(files, n) for n in (one, other))
    if a["root"] == b["root"] and a["tables"].keys() == b["tables"].keys() and all(_form(a["tables"][t]["schema"]) == _form(b["tables"][t]["schema"]) for t in a["tables"]):
        return {}
    out: dict[str, list[int] | None] = {}
    for t in sorted(a["tables"].keys() | b["tables"].keys()):
        x, y = a["tables"].get(t), b["tables"].get(t)
        if not x or not y or (_form(x["schema"]), x["buckets"]) != (_form(y["schema"]), y["buckets"]):
            out[t] = None
        elif found := differing(x["tree"], y["tree"]):
            out[t] = found
    return out


def difference(spark: SparkSession, root: str, one: str, other: str, table: str) -> DataFrame:
    """Rows of a table that only one of two snapshots has: its columns, and `side` (one or other); repeated rows count. Only buckets that differ are read."""
    files = Files(spark, root)
    found = changed_buckets(spark, root, one, other).get(table, [])
    sides = []
    for side, name in (("one", one), ("other", other)):
        e = manifest_of(files, name)["tables"].get(table)
        if e:
            places = [p for k, p in e["places"].items() if found is None or int(k) in found]
            sides.append(_read(files, StructType.fromJson(json.loads(e["schema"])), places).withColumn("side", F.lit(side)))
    if not sides:
        raise SnapshotError(f"no table {table} in {one} or {other}")
    rows = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1], allowMissingColumns=True)
    columns = [c for c in rows.columns if c != "side"]
    counts = rows.groupBy(*(F.col(f"`{c}`") for c in columns)).agg(F.sum(F.when(F.col("side") == "one", 1).otherwise(-1)).alias("__n")).where("__n <> 0")
    return counts.select(*(F.col(f"`{c}`") for c in columns), F.when(F.col("__n") > 0, "one").otherwise("other").alias("side"), F.explode(F.sequence(F.lit(1), F.abs("__n").cast("int"))).alias("__k")).drop("__k")


def load(spark: SparkSession, root: str, name: str | None = None) -> Catalog:
    """The tables of a snapshot (the current one by default)."""
    files = Files(spark, root)
    if name is None and (name := current_name(files)) is None:
        raise SnapshotError(f"{root} holds no snapshot")
    manifest = manifest_of(files, name)
    found = Catalog(spark, {t: partial(_read, files, StructType.fromJson(json.loads(e["schema"])), e["places"].values()) for t, e in manifest["tables"].items()})
    return migrate(found if manifest["schema_version"] >= PROMOTED_AT else promoted(found))


def exists(spark: SparkSession, root: str) -> bool:
    return Files(spark, root).exists("current.json")


def migrate(catalog: Catalog) -> Catalog:
    """Tables in today's schema: missing columns become null, a missing scope is the family's, a missing base the key."""

    def whole(name: str) -> DataFrame:
        df, schema = catalog[name], schema_of(name)
        fill = {"record_id": F.lit(0), "dedup_occurrence": F.lit(0)}
        if "dedup_key" in df.columns:
            fill["dedup_base"] = F.col("dedup_key")
        return df.select(*((F.col(f.name) if f.name in df.columns else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema))

    return Catalog(catalog.spark, {name: partial(whole if name in FIELDS or name in TABLES else catalog.__getitem__, name) for name in catalog.made})


#: The schema from which on allergies and conditions have tables of their own.
PROMOTED_AT = 6


def promoted(catalog: Catalog) -> Catalog:
    """Observations that are allergies or conditions moved to their tables, with new ids in the order of the old; those without a key stay.

    Their identity goes with them; a missing base is the key. A condition counts as active. Ids are counted when this is called.
    """
    moves = F.col("obs_type").isin("allergy", "condition") & F.col("key").isNotNull()
    observations, tables = migrate(Catalog(catalog.spark, {"observation": catalog["observation"]}))["observation"], {}
    same = [F.col(c) for c in ("person_id", "document_id", "dedup_key", "dedup_occurrence")] + [F.coalesce("dedup_base", "dedup_key").alias("dedup_base")]
    for table, own in (
        ("allergy", {"substance": F.col("key"), "reaction": F.col("value_text"), "noted_on": F.col("observed_at")}),
        ("condition", {"name": F.col("key"), "status": F.lit("active"), "onset_on": F.col("observed_at"), "note": F.col("value_text")}),
    ):
        there = migrate(Catalog(catalog.spark, {table: catalog[table]}))[table]
        last = there.agg(F.coalesce(F.max(f"{table}_id"), F.lit(0))).first()[0]
        new = observations.where(moves & (F.col("obs_type") == table)).select("observation_id", *same, *(c.alias(n) for n, c in own.items()))
        new = numbered(new, f"{table}_id", last + 1, "observation_id")
        tables[table] = there.unionByName(new.select(*((F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(table))))
    return catalog.with_tables(observation=observations.where(~F.coalesce(moves, F.lit(False))), **tables)


def pending(catalog: Catalog) -> list[str]:
    """Tables that migrate() would change, in order."""
    return sorted(n for n, df in catalog.tables.items() if (n in FIELDS or n in TABLES) and df.columns != schema_of(n).names)


def stored(files: Files) -> list[str]:
    """Names of snapshots; what a crash left without a manifest is none."""
    return [n for n in files.names() if parsed_name(n) and files.exists(f"{n}/manifest.json")]


def resolve(spark: SparkSession, root: str, spec: str) -> str:
    """A snapshot's name from 'latest' or a name."""
    names = stored(Files(spark, root))
    if spec == "latest":
        if not names:
            raise SnapshotError(f"{root} holds no snapshot")
        return max(names, key=lambda n: (parsed_name(n), n))
    if spec not in names:
        raise SnapshotError(f"no snapshot {spec}")
    return spec


def restore(spark: SparkSession, root: str, spec: str) -> str:
    """Make an earlier snapshot the current one, if it is whole; later ones stay where they are."""
    name = resolve(spark, root, spec)
    if (state := integrity(spark, root, name)) != "ok":
        raise SnapshotError(state)
    Files(spark, root).write("current.json", json.dumps({"current": name}))
    return name


def lost_tombstones(live: Catalog, snapshot_: Catalog) -> DataFrame:
    """Tombstones that a restore would forget, newest first."""
    return live["document_tombstone"].join(snapshot_["document_tombstone"].select("sha256"), "sha256", "left_anti").orderBy(F.desc("removed_at"), "sha256")


def retained(names: DataFrame, keep_daily: int = 7, keep_weekly: int = 4, protect: str | None = None) -> DataFrame:
    """(name, ts, keep) of snapshots (name, ts): the newest of each of the last days, then of each of the last weeks among the rest.

    Days are counted over all snapshots. Weeks (ISO) are counted over those that the days did not keep.
    """
    from pyspark.sql import Window

    day = F.to_date("ts")
    per_day = F.row_number().over(Window.partitionBy(day).orderBy(F.desc("ts"), F.desc("name")))
    rows = names.withColumn("first", per_day == 1)
    days = rows.where("first").select("name", F.row_number().over(Window.orderBy(F.desc("ts"))).alias("d")).where(F.col("d") <= keep_daily)
    rows = rows.join(days.select("name", F.lit(True).alias("daily")), "name", "left").withColumn("daily", F.coalesce("daily", F.lit(False)))
    if protect:
        rows = rows.withColumn("daily", F.col("daily") | (F.col("name") == protect))
    iso = F.struct(F.expr("extract(YEAROFWEEK FROM ts)").alias("y"), F.weekofyear("ts").alias("w"))
    left = rows.where(~F.col("daily")).withColumn("week", iso)
    newest = left.withColumn("k", F.row_number().over(Window.partitionBy("week").orderBy(F.desc("ts"), F.desc("name")))).where("k = 1")
    weeks = newest.withColumn("n", F.row_number().over(Window.orderBy(F.desc("ts")))).where(F.col("n") <= keep_weekly)
    return rows.join(weeks.select("name", F.lit(True).alias("weekly")), "name", "left").select("name", "ts", (F.col("daily") | F.coalesce("weekly", F.lit(False))).alias("keep"))


def rotate(spark: SparkSession, root: str, keep_daily: int = 7, keep_weekly: int = 4, protect: str | None = None) -> list[str]:
    """Delete what retained() lets go; returns the deleted names."""
    files = Files(spark, root)
    names = [(n, parsed_name(n)) for n in stored(files)]
    if not names:
        return []
    now = current_name(files)
    rows = retained(spark.createDataFrame(names, "name string, ts timestamp"), keep_daily, keep_weekly, protect).where("NOT keep").collect()
    gone = sorted(r["name"] for r in rows if r["name"] != now)
    kept = [n for n, _ in names if n not in gone]
    needed = {p for n in kept for e in manifest_of(files, n)["tables"].values() for p in e["places"].values()}
    for n in gone:
        _drop(files, n, needed)
    return gone


def _drop(files: Files, name: str, needed: set[str]) -> None:
    """Delete a snapshot's manifest, and those of its buckets that no other snapshot names."""
    tables = manifest_of(files, name)["written"]
    files.drop(f"{name}/manifest.json")
    for table, buckets in tables.items():
        places = [f"{name}/{table}/__bucket={k}" for k in buckets]
        for p in places:
            if p not in needed:
                files.drop(p)
        if not needed.intersection(places):
            files.drop(f"{name}/{table}")
    if not any(p.startswith(f"{name}/") for p in needed):
        files.drop(name)
