"""The full-text index in segments, kept up to date as records come, change and go.

A batch of changes becomes one new segment: postings of the records that it brings, sharded by token, and a delete bitmap
for each older segment that held one of its keys before. Segments are never changed. Which of them are alive, and their
counts, is said by a manifest of its own for each generation, put in place by a rename that fails if another writer was
first. Segments of about one size are merged, which drops what was deleted, so that their number grows with the logarithm
of what was ever written.

A search reads the shards of its tokens and nothing else: statistics are sums over the manifest, and postings carry their
record. Bitmaps are read for the segments that have one and joined by bucket of 32,768 records.

Odd rows. A record may come with a null or empty text: it is counted, and never found. A key may stand for several records;
a change to it replaces them all. A null key is never replaced. Changes of no rows make no segment. Null or unknown keys
to delete are passed over; a key that one batch both brings and deletes is brought.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import settled
from ..plans.catalog import Files
from ..plans.scratch import written
from .search import bm25, moved_back, phrases, tokens

KEY = ("source_table", "source_id")
CARRIED = (*KEY, "person_id", "document_id")
#: Tokens for which a segment has one shard (and records for which its keys have one bucket), and shards at most.
TOKENS_PER_SHARD, MOST_SHARDS = 4_000_000, 4096
#: Postings that a task takes of one shard, about: shards of common tokens go to several.
SLICE_POSTINGS = 500_000
#: Tokens up to which a record's postings are gathered within its row; those of longer ones are gathered after the shuffle.
SHORT = 32
#: Segments of one tier that are merged; a segment's tier is the logarithm of its live records to this base.
FAN = 4


def shard_of(column: Column, shards: int | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(shards) if isinstance(shards, int) else shards).cast("int")


def key_bucket(shards: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(shards)).cast("int")


def is_set(bitmap: Column, position: Column) -> Column:
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.get(F.array(*(byte.bitwiseAND(1 << k) for k in range(8))), (position % 8).cast("int")) > 0, F.lit(False))


def gathered(own: Column) -> Column:
    """Structs of each token of a short array and its places."""
    places = lambda t: F.filter(F.transform(own, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull())
    return F.transform(F.array_distinct(own), lambda t: F.struct(t.alias("token"), places(t).alias("positions")))


class SegmentedIndex:
    """An index in a folder. Batches are applied one after another; of two writers at once, one fails and may try again."""

    def __init__(self, spark: SparkSession, path: str, tokens_per_shard: int = TOKENS_PER_SHARD, fan: int = FAN):
        self.spark, self.path, self.tokens_per_shard, self.fan = spark, path.rstrip("/"), tokens_per_shard, fan
        self.files = Files(spark, f"{self.path}/manifests")

    def state(self) -> dict:
        """The newest manifest: generation, and segments with their counts."""
        found = [n for n in self.files.names() if n.endswith(".json") and not n.startswith(".")]
        return json.loads(self.files.read(max(found))) if found else {"generation": 0, "segments": []}

    def _commit(self, generation: int, segments: list[dict]) -> dict:
        state = {"generation": generation, "segments": [s for s in segments if s["n"] > s["dead"]]}
        self.files.put(f"{generation:010d}.json", json.dumps(state, indent=1))
        return state

    # -- reading

    def _tables(self, kind: str, parts: dict[str, list[int]]) -> DataFrame | None:
        """Rows of the named parts of segments, with their segment."""
        paths = [f"{self.path}/{kind}/segment={s}/part={k}" for s, numbers in parts.items() for k in numbers]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths).drop("part") if paths else None

    def _alive(self, rows: DataFrame, segments: list[dict]) -> DataFrame:
        """rows (segment, ordinal, ...) without those deleted."""
        marked = [f"{self.path}/deletes/{s['deletes']}/segment={s['id']}" for s in segments if s["deletes"]]
        if not marked:
            return rows
        maps = reduce(DataFrame.unionByName, (self.spark.read.parquet(p).withColumn("segment", F.lit(p.rpartition("=")[2])) for p in marked))
        joined = rows.withColumn("bucket", F.bitmap_bucket_number("ordinal")).join(maps, ["segment", "bucket"], "left")
        return joined.where(~is_set(F.col("bitmap"), F.bitmap_bit_position("ordinal"))).drop("bucket", "bitmap")

    # -- writing

    def _dealt(self, postings: DataFrame, tokens: int, shards: int, exploded: bool, held: dict[int, int] | None = None) -> DataFrame:
        """Postings in the shards of their tokens; those of one token each (pos) are gathered where they have come to, without another shuffle.

        held: postings by shard, where there are many. A shard of more than SLICE_POSTINGS goes to several tasks, by record.
        """
        slices = [max(1, -(-(held or {}).get(k, 0) // SLICE_POSTINGS)) for k in range(shards)]
        dealt = postings.withColumn("part", shard_of(F.col("token"), shards))
        dealt = dealt.withColumn("slice", F.pmod("ordinal", F.get(F.lit(slices), F.col("part")) if max(slices) > 1 else F.lit(1)))
        dealt = dealt.repartition(2 * max(1, -(-tokens // SLICE_POSTINGS)), "part", "slice")  # twice as many tasks as are needed, as slices fall to them by hash
        if exploded:
            dealt = dealt.groupBy("part", "slice", "token", "ordinal", "len", *CARRIED).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        return dealt.drop("slice")

    def _write(self, segment: str, records: DataFrame, *postings: tuple[DataFrame, DataFrame]) -> dict:
        """A segment of records (key, ordinal, len) and postings (token, ordinal, positions or each pos, len, and the record's columns), each with a table of their tokens alone."""
        counts = records.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"), F.coalesce(F.max("ordinal"), F.lit(0)).alias("top")).first().asDict()
        shards = min(MOST_SHARDS, max(1, -(-max(counts["tokens"], counts["n"]) // self.tokens_per_shard)))
        records.select(*KEY, "ordinal", "len", key_bucket(shards).alias("part")).repartition("part").sortWithinPartitions("part", *KEY).write.partitionBy("part").parquet(f"{self.path}/records/segment={segment}")
        for rows, own in postings:
            held = self._held(own, shards) if counts["tokens"] > SLICE_POSTINGS else {}
            dealt = self._dealt(rows, sum(held.values()), shards, "pos" in rows.columns, held)
            dealt.sortWithinPartitions("part", "token").write.mode("append").partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")
        return {"id": segment, **counts, "dead": 0, "dead_tokens": 0, "deletes": None, "shards": shards, "parts": self._parts("postings", segment), "buckets": self._parts("records", segment)}

    def _held(self, own: DataFrame, shards: int) -> dict[int, int]:
        """Tokens in each shard, of which there are at most MOST_SHARDS."""
        return {r["part"]: r["count"] for r in own.groupBy(shard_of(F.col("token"), shards).alias("part")).count().collect()}

    def _parts(self, kind: str, segment: str) -> list[int]:
        return sorted(int(n[5:]) for n in Files(self.spark, f"{self.path}/{kind}/segment={segment}").names() if n.startswith("part="))

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> dict:
        """Bring records (CARRIED and text), replacing those of the same keys, and remove those of other keys. Returns the new manifest."""
        state = self.state()
        generation = state["generation"] + 1
        segments = [dict(s) for s in state["segments"]]
        keys = [df.select(*KEY) for df in (upserts, deletes) if df is not None]
        if not keys:
            return state
        if segments:  # the first batch replaces nothing
            self._mark(segments, written(reduce(DataFrame.unionByName, keys).dropna().distinct()), generation)
        if upserts is not None:
            made = settled(upserts.select(*CARRIED, "text"), tokens=tokens(F.col("text")))
            made = written(made.select(*CARRIED, "tokens", F.size("tokens").cast("bigint").alias("len"), (F.monotonically_increasing_id() + 1).alias("ordinal")))
            if not made.isEmpty():
                short, long = made.where(F.col("len") <= SHORT), made.where(F.col("len") > SHORT)
                within = short.select(*CARRIED, "len", "ordinal", F.inline(gathered(F.col("tokens"))))
                each = long.select(*CARRIED, "len", "ordinal", F.posexplode("tokens").alias("pos", "token"))
                segments.append(self._write(f"s{generation:010d}", made, (within, short.select(F.explode(F.array_distinct("tokens")).alias("token"))), (each, each.select("token"))))
        return self._commit(generation, segments)

    def _mark(self, segments: list[dict], changed: DataFrame, generation: int) -> None:
        """Write bitmaps of the records that changed keys had, and count them; only buckets of those keys are read."""
        counts = sorted({s["shards"] for s in segments})
        asked: dict[int, set[int]] = {n: set() for n in counts}
        pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), key_bucket(n).alias("b")) for n in counts))).alias("p")
        for r in changed.select(pairs).select("p.*").distinct().collect():  # at most MOST_SHARDS numbers for each size of segments
            asked[r["n"]].add(r["b"])
        held = self._tables("records", {s["id"]: sorted(asked[s["shards"]] & set(s["buckets"])) for s in segments})
        if held is None:
            return
        gone = written(self._alive(held.join(changed, list(KEY), "left_semi"), segments).select("segment", "ordinal", "len"))
        lost = {r["segment"]: r for r in gone.groupBy("segment").agg(F.count("*").alias("n"), F.sum("len").alias("tokens")).collect()}
        for s in segments:
            if s["id"] not in lost:
                continue
            own = gone.where(F.col("segment") == s["id"])
            maps = own.groupBy(F.bitmap_bucket_number("ordinal").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("ordinal")).alias("bitmap"))
            if s["deletes"]:
                before = self.spark.read.parquet(f"{self.path}/deletes/{s['deletes']}/segment={s['id']}")
                maps = maps.unionByName(before).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
            maps.write.parquet(f"{self.path}/deletes/{generation}/segment={s['id']}")
            s.update(deletes=str(generation), dead=s["dead"] + lost[s["id"]]["n"], dead_tokens=s["dead_tokens"] + lost[s["id"]]["tokens"])

    def merge(self, whole: bool = False) -> dict:
        """Merge segments of a tier while it has `fan` of them, and rewrite those that are more dead than alive; with whole, make all of them one."""
        while True:
            state = self.state()
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(int(math.log(s["n"] - s["dead"], self.fan) + 1e-9), []).append(s)
            group = next((t for _, t in sorted(tiers.items()) if len(t) >= self.fan), None) or [s for s in state["segments"] if 2 * s["dead"] > s["n"]]
            if whole:
                group = state["segments"] if len(state["segments"]) > 1 or any(s["dead"] for s in state["segments"]) else []
            if not group:
                return state
            generation = state["generation"] + 1
            records = self._alive(self._tables("records", {s["id"]: s["buckets"] for s in group}), group)
            postings = [t for s in group if s["parts"] for t in [self._tables("postings", {s["id"]: s["parts"]})]]
            starts, at = {}, 0
            for s in group:
                starts[s["id"]], at = at, at + s["top"]
            moved = (F.col("ordinal") + reduce(lambda w, s: w.when(F.col("segment") == s, F.lit(starts[s])), list(starts)[1:], F.when(F.col("segment") == next(iter(starts)), F.lit(0)))).alias("ordinal")
            stored = reduce(DataFrame.unionByName, postings) if postings else None
            rows = (self._alive(stored, group).select("token", moved, "len", *CARRIED, "positions"), stored.select("token")) if postings else None
            empty = "token string, ordinal bigint, len bigint, source_table string, source_id bigint, person_id bigint, document_id bigint, positions array<int>"
            none = self.spark.createDataFrame([], empty)
            made = self._write(f"s{generation:010d}", records.select(*KEY, moved, "len"), rows or (none, none))
            ids = {s["id"] for s in group}
            self._commit(generation, [s for s in state["segments"] if s["id"] not in ids] + [made])

    def vacuum(self) -> list[str]:
        """Delete what no live segment needs, and earlier manifests; only when no search of an earlier generation runs. Returns the deleted segments."""
        state = self.state()
        live, kept = {s["id"] for s in state["segments"]}, {(s["deletes"], s["id"]) for s in state["segments"]}
        gone = set()
        for kind in ("records", "postings"):
            folder = Files(self.spark, f"{self.path}/{kind}")
            for name in folder.names():
                if name.startswith("segment=") and name[8:] not in live:
                    folder.drop(name)
                    gone.add(name[8:])
        for generation in Files(self.spark, f"{self.path}/deletes").names():
            folder = Files(self.spark, f"{self.path}/deletes/{generation}")
            for name in folder.names():
                if (generation, name[8:]) not in kept:
                    folder.drop(name)
        for name in self.files.names():
            if name != f"{state['generation']:010d}.json":
                self.files.drop(name)
        return sorted(gone)

    # -- searching

    def find(self, query: str, person: int | None = None) -> DataFrame:
        """CARRIED and rank of the records that hold every word, as search.find() gives over the records as they now are."""
        wanted = phrases(query)
        words = sorted({t for p in wanted for t in p})
        segments = self.state()["segments"]
        none = self.spark.createDataFrame([], "source_table string, source_id bigint, person_id bigint, document_id bigint, rank double")
        if not words or not segments:
            return none
        sizes = sorted({s["shards"] for s in segments})
        numbers = self.spark.createDataFrame([(w,) for w in words], "token string").select(*(shard_of(F.col("token"), n).alias(str(n)) for n in sizes)).collect()
        asked = {n: {r[str(n)] for r in numbers} for n in sizes}
        rows = self._tables("postings", {s["id"]: sorted(asked[s["shards"]] & set(s["parts"])) for s in segments})
        if rows is None:
            return none
        rows = self._alive(rows.where(F.col("token").isin(*words)), segments)
        by_record = rows.groupBy("segment", "ordinal", "len", *CARRIED).agg(*(F.first(F.when(F.col("token") == w, F.col("positions")), ignorenulls=True).alias(f"w{k}") for k, w in enumerate(words)))

        def begins(phrase: list[str]) -> Column:
            """How often a phrase begins: the places of each word, moved back by its distance from the first."""
            out = F.col(f"w{words.index(phrase[0])}")
            for d, w in enumerate(phrase[1:], 1):
                out = F.array_intersect(out, F.transform(F.col(f"w{words.index(w)}"), moved_back(d)))
            return F.greatest(F.coalesce(F.size(out), F.lit(0)), F.lit(0))

        hit = written(settled(by_record, **{f"tf{k}": begins(p) for k, p in enumerate(wanted)}).select(*CARRIED, "len", *(f"tf{k}" for k in range(len(wanted)))))
        dfs = hit.agg(*(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted)))).first()
        n, length = (sum(s[a] - s[b] for s in segments) for a, b in (("n", "dead"), ("tokens", "dead_tokens")))
        rank = reduce(lambda r, k: r - bm25(F.col(f"tf{k}"), F.col("len"), n, dfs[f"df{k}"], length / n), range(len(wanted)), F.lit(0.0))
        found = hit.where(" AND ".join(f"tf{k} > 0" for k in range(len(wanted))))
        if person is not None:
            found = found.where(F.col("person_id") == person)
        return found.select(*CARRIED, rank.alias("rank")).orderBy("rank", *KEY)
