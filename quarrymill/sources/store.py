"""Collections of points: definition, upserts, deletions, snapshots, copies, key-value entries.

A collection is ``root/name``: a log of numbered states (``commits.py``) and folders of Parquet. A state lists layers from
the oldest to the newest: the base, deltas of upserted points, and values of a field whose points are gone. An upsert or a
deletion writes its own rows alone and adds a state with one more layer; it never reads the collection. Readers merge:
a point counts unless a newer layer has its key again or says that it is gone, by two joins with tables of the size of the
changes. When layers become many, those above the base are folded into one; when they become large beside the base, all are
compacted into a new base. Both keep the layers that other writers have added meanwhile.

Folders belong to no one until a state names them, so a driver or executor lost at any moment leaves the collection as it
was. ``vacuum`` removes folders that no remaining state names, once they are older than any writer or reader may be. Nothing
but names and small JSON reaches the driver.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarrymill.operators import retrieval
from quarrymill.sources.commits import STATE, Folder, Log

#: Layers that a reader merges, and how large the newer ones may be beside the base.
MOST_LAYERS, MOST_SHARE = 12, 0.5
DAY = 86_400.0


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder below ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarrymill-store-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class PointStore:
    """Collections below one root. Points have a unique ``chunk_id``, and may have path, name and dense."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.at = spark, Folder(spark, root)

    def log(self, name: str) -> Log:
        return Log(self.at, name)

    def _state(self, name: str) -> STATE:
        state = self.log(name).latest()[1]
        if state is None:
            raise KeyError(name)
        return state

    # Definition.

    def collections(self) -> list[str]:
        return [n for n in self.at.folders() if self.log(n).versions()]

    def has(self, name: str) -> bool:
        return bool(self.log(name).versions())

    @staticmethod
    def _new(schema: StructType, key: str = "chunk_id") -> STATE:
        return {"key": key, "schema": schema.json(), "indexes": [], "layers": []}

    def create(self, name: str, schema: StructType | str, key: str = "chunk_id") -> None:
        schema = schema if isinstance(schema, StructType) else self.spark.createDataFrame([], schema).schema
        if self.has(name) or not self.log(name).add(1, self._new(schema, key)):
            raise ValueError(f"collection {name} is there already")

    def ensure(self, name: str, schema: StructType | str, key: str = "chunk_id") -> None:
        if not self.has(name):
            try:
                self.create(name, schema, key)
            except ValueError:  # another writer was first
                pass

    def drop(self, name: str) -> bool:
        return self.at.delete(name)

    # Layers.

    def _write(self, name: str, rows: DataFrame, indexes: list[str]) -> str:
        """Files whose rows are in the order of the indexed fields have narrow statistics, which filters are pushed to."""
        place = f"d-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        indexed = [c for c in indexes if c in rows.columns]
        (rows.sortWithinPartitions(*indexed) if indexed else rows).write.parquet(self.at.path(name, "data", place))
        return place

    def _read(self, name: str, layer: dict) -> DataFrame:
        return self.spark.read.parquet(self.at.path(name, "data", layer["place"]))

    def _live(self, name: str, state: STATE, layers: list[dict]) -> DataFrame:
        """The points of ``layers`` that no newer one among them replaces or removes."""
        key, rows, newest = state["key"], None, {}
        for i, layer in enumerate(layers):
            if "gone" in layer:
                newest.setdefault(layer["gone"], []).append(self._read(name, layer).select(F.col("value").alias("_value"), F.lit(i).alias("_by")))
                continue
            read = self._read(name, layer)
            if rows is not None:
                newest.setdefault(key, []).append(read.select(F.col(key).alias("_value"), F.lit(i).alias("_by")))
            tagged = read.withColumn("_layer", F.lit(i))
            rows = tagged if rows is None else rows.unionByName(tagged, allowMissingColumns=True)
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(state["schema"])))
        for column, tables in newest.items():
            if column not in rows.columns:
                continue
            changed = tables[0]
            for more in tables[1:]:
                changed = changed.unionByName(more)
            changed = changed.groupBy("_value").agg(F.max("_by").alias("_by"))
            rows = rows.join(changed, F.col(column) == F.col("_value"), "left").filter(F.col("_by").isNull() | (F.col("_by") <= F.col("_layer"))).drop("_value", "_by")
        return rows.drop("_layer")

    def get(self, name: str) -> DataFrame:
        """All points of the current version."""
        state = self._state(name)
        return self._live(name, state, state["layers"])

    def replace(self, name: str, points: DataFrame, key: str = "chunk_id") -> None:
        """Points in place of all that are there."""
        state = self.log(name).latest()[1] or self._new(points.schema, key)
        place = self._write(name, points, state["indexes"])
        self.log(name).change(lambda now: (now or state) | {"schema": points.schema.json(), "layers": [{"place": place}]})
        self.vacuum(name)

    def _append(self, name: str, layer: dict, maintain: bool = True) -> None:
        def step(state):
            if state is None:
                raise KeyError(name)
            return state | {"layers": [*state["layers"], layer]}

        self.log(name).change(step)
        if maintain:
            self.maintain(name)

    def maintain(self, name: str) -> None:
        """Folds or compacts if the layers above the base have become many, or large beside it."""
        layers = self._state(name)["layers"]
        if len(layers) < 2:
            return
        size = [self.at.size(name, "data", x["place"]) for x in layers]
        if len(layers) > MOST_LAYERS and sum(size[1:]) > MOST_SHARE * size[0]:
            self.compact(name)
        elif len(layers) > MOST_LAYERS:
            self.fold(name)

    def _swap(self, name: str, old: list[dict], new: list[dict]) -> bool:
        """``new`` in place of the oldest layers ``old``; not if another writer has changed those."""
        made = self.log(name).change(lambda now: now | {"layers": [*new, *now["layers"][len(old) :]]} if now and now["layers"][: len(old)] == old else None)
        return made is not None

    def compact(self, name: str, grace_seconds: float = DAY) -> bool:
        """All layers as one new base."""
        state = self._state(name)
        place = self._write(name, self._live(name, state, state["layers"]), state["indexes"])
        done = self._swap(name, state["layers"], [{"place": place}])
        self.vacuum(name, grace_seconds)
        return done

    def fold(self, name: str) -> bool:
        """All layers above the base as one delta, over the values of points that are gone from the base."""
        state = self._state(name)
        base, upper, key = state["layers"][0], state["layers"][1:], state["key"]
        values: dict[str, list[DataFrame]] = {}
        for layer in upper:
            # A point that a delta has put there and a newer layer has removed must stay hidden in the base.
            values.setdefault(layer.get("gone", key), []).append(self._read(name, layer).select(F.col("value" if "gone" in layer else key).alias("value")))
        new = [base]
        for column, tables in values.items():
            table = tables[0]
            for more in tables[1:]:
                table = table.unionByName(more)
            new.append({"gone": column, "place": self._write(name, table.distinct(), [])})
        if any("gone" not in x for x in upper):
            new.append({"place": self._write(name, self._live(name, state, upper), state["indexes"])})
        return self._swap(name, state["layers"], new)

    def vacuum(self, name: str, grace_seconds: float = DAY, keep: int = 10) -> list[str]:
        """Removes old states but the last ``keep``, and folders that no state names, if they are older than ``grace_seconds``."""
        before, log = time.time() - grace_seconds, self.log(name)
        old = [f for f in self.at.folders(name, "data") if int(f.split("-")[1]) / 1e9 < before]
        log.clear(before, keep)
        named = {x["place"] for v in log.versions() for x in (log.read(v) or {"layers": []})["layers"]}
        gone = [f for f in old if f not in named]
        for f in gone:
            self.at.delete(name, "data", f)
        return gone

    # Payload indexes.

    def indexes(self, name: str) -> list[str]:
        return (self.log(name).latest()[1] or {"indexes": []})["indexes"]

    def make_indexes(self, name: str, fields: list[str]) -> list[str]:
        """Fields that all later layers are ordered by; the current ones are compacted in that order."""
        unknown = set(fields) - set(self.get(name).columns)
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        made = self.log(name).change(lambda now: now | {"indexes": list(dict.fromkeys([*now["indexes"], *fields]))})
        if made["layers"]:
            self.compact(name)
        return made["indexes"]

    # Points.

    def upsert(self, name: str, points: DataFrame) -> None:
        """Points, each over the one with the same key, if any; reads and rewrites nothing else."""
        self._append(name, {"place": self._write(name, points, self.indexes(name))})

    def _delete(self, name: str, column: str, values: DataFrame) -> None:
        self._append(name, {"gone": column, "place": self._write(name, values.select(F.col(column).alias("value")).distinct(), [])})

    def delete_ids(self, name: str, ids: DataFrame) -> None:
        self._delete(name, self._state(name)["key"], ids)

    def delete_files(self, name: str, paths: DataFrame) -> None:
        self._delete(name, "path", paths)

    def delete_names(self, name: str, names: DataFrame) -> None:
        self._delete(name, "name", names)

    def retrieve(self, name: str, ids: DataFrame) -> DataFrame:
        return self.get(name).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")

    def search(self, name: str, queries: DataFrame, k: int, metric: str = "cosine", condition=None) -> DataFrame:
        return retrieval.dense_search(self.get(name), queries, k, metric, condition, same=True)

    # Copies and snapshots.

    def copy(self, name: str, to: PointStore, as_name: str | None = None) -> None:
        to.replace(as_name or name, self.get(name))

    def persist(self, name: str, points: DataFrame, every_seconds: float = 0.0, now: float | None = None) -> bool:
        """Writes the points if the last version is at least so old; a periodic task calls this as often as it likes."""
        state = self.log(name).latest()[1]
        if state and (time.time() if now is None else now) - state["saved_at"] < every_seconds:
            return False
        self.replace(name, points)
        return True

    def snapshots(self, name: str) -> list[str]:
        """Oldest first."""
        return self.at.folders(name, "snapshots")

    def snapshot(self, name: str) -> str:
        label = f"s-{time.time_ns():020d}"
        self.get(name).write.parquet(self.at.path(name, "snapshots", label))
        return label

    def latest_snapshot(self, name: str) -> str | None:
        return (self.snapshots(name) or [None])[-1]

    def restore(self, name: str, label: str | None = None) -> None:
        label = label or self.latest_snapshot(name)
        if label is None or label not in self.snapshots(name):
            raise KeyError(f"{name}: snapshot {label}")
        self.replace(name, self.spark.read.parquet(self.at.path(name, "snapshots", label)))

    def delete_snapshot(self, name: str, label: str) -> bool:
        return self.at.delete(name, "snapshots", label)

    def retain_snapshots(self, name: str, keep: int) -> list[str]:
        """Deletes all but the newest ``keep``; returns what went."""
        gone = self.snapshots(name)[: -keep or None]
        for label in gone:
            self.delete_snapshot(name, label)
        return gone

    # Entries by key, manifests and checkpoints.

    def save_entries(self, name: str, entries: DataFrame) -> None:
        """(key, value) rows over those of the same key."""
        self.ensure(f"kv-{name}", entries.schema, "key")
        self.upsert(f"kv-{name}", entries)

    def load_entries(self, name: str) -> DataFrame:
        return self.get(f"kv-{name}")

    def save_manifest(self, name: str, manifest: DataFrame) -> None:
        self.replace(f"manifest-{name}", manifest)

    def load_manifest(self, name: str) -> DataFrame | None:
        return self.get(f"manifest-{name}") if self.has(f"manifest-{name}") else None

    def delete_manifest(self, name: str) -> bool:
        return self.at.delete(f"manifest-{name}")

    def save_checkpoint(self, name: str, state: dict, now: float | None = None) -> None:
        self.at.write_text(json.dumps({"saved_at": time.time() if now is None else now, "state": state}), "checkpoints", name)

    def load_checkpoint(self, name: str, settings: str | None = None, stale_hours: float = 24.0, now: float | None = None) -> dict | None:
        """The state, unless it is stale or was made with other settings."""
        held = json.loads(self.at.read_text("checkpoints", name) or "null")
        if held is None or (time.time() if now is None else now) - held["saved_at"] > 3600 * stale_hours:
            return None
        return held["state"] if settings is None or held["state"].get("settings") == settings else None

    def delete_checkpoint(self, name: str) -> bool:
        return self.at.delete("checkpoints", name)


def capture(spark: SparkSession, path: str, events: DataFrame, run: str) -> None:
    """Appends (event, props) rows to a Parquet table of events, with the run and the time."""
    events.select("event", F.to_json("props").alias("props"), F.lit(run).alias("run"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def as_json(rows: DataFrame) -> DataFrame:
    """One line of JSON a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def as_markdown(rows: DataFrame) -> DataFrame:
    """One line of a Markdown table a row (``value``); ``markdown_head`` has its head."""
    cell = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\|", "\\\\\\\\|"), r"\s+", " ")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, rows.columns)), F.lit(" |")).alias("value"))


def markdown_head(rows: DataFrame) -> str:
    return "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
