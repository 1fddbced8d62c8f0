"""Stored tables: layers of Parquet files, and commits that say which layers make the tables.

A commit is one small JSON file, `_commits/<number>.json`: the layers of all tables with their rows by
date, dirty dates, small states, and the last micro-batch of each stream. A writer writes its layers
first, then makes the file of the next number, which fails if another writer was first. It then looks at
what came between: rows that replace others by key are added to the newer state as they are; work that
has read what changed is done anew. So records, markers, offsets and states of one commit are all there
or none, and a crash leaves layers that no commit names, which `vacuum` removes.

A layer has each primary key once, and its rows count before those of earlier layers. To change one row
costs that row, whatever its date holds. Readers take a date that lies in one layer as it is; in others
the keys of later layers, which are few, take rows out of the first. `compact` makes one layer of a date
again once later layers have too many parts or rows. A key's date does not change.

The number must be taken by one writer only: by a hard link on local file systems, by a rename that does
not overwrite on others, as HDFS has it. Object stores without such a rename need one writer.
"""

from __future__ import annotations

import copy
import datetime as dt
import json
import tempfile
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.facts import add_counts, latest_by_key

SCHEMAS = {
    "message": schemas.MESSAGE,
    "command": schemas.COMMAND,
    "user_profile": schemas.USER_PROFILE,
    "ai_request": schemas.AI_REQUEST,
    "ai_model_daily": schemas.AI_MODEL_DAILY,
    "image_generation": schemas.IMAGE_GENERATION,
    "log_offset": schemas.LOG_OFFSET,
    "log_offset_v2": schemas.LOG_OFFSET_V2,
    "ai_daily_dirty": schemas.DIRTY_DATE,
    "log_import_state": schemas.IMPORT_STATE,
}
#: Tables that are kept in the commits themselves: a row for each date, or few rows.
INSIDE = ("ai_daily_dirty", "log_import_state")
#: Folders of lines that batches left open; states name those that count.
OPENED = ("log_import_open", "log_live_open")

#: Rows of one file of a stored table, as far as hashing deals them evenly.
FILE_ROWS = 5_000_000
#: A date is compacted when it has more later layers than this, or a share of its rows in them.
LAYERS, SHARE = 8, 0.5
#: Commits that are kept for readers of earlier states.
KEPT_COMMITS = 20
#: The date of tables without one.
NO_DATE = ""


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the cluster's shared one; a temporary one only where none is named and the session is local."""
    root = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = root or tempfile.mkdtemp(prefix="botlantern-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


class Conflict(Exception):
    """Another writer changed what this one has read."""


@dataclass
class State:
    """What a commit says."""

    version: int = 0
    #: Of each table its layers, older ones first: part, the commit that brought it, rows by date, and how many dates were written.
    layers: dict[str, list[dict]] = field(default_factory=dict)
    #: Dirty dates, each with the commit that marked it and the time in ms.
    dirty: dict[str, list[int]] = field(default_factory=dict)
    #: Small rows by key, each with the commit that wrote it.
    states: dict[str, dict] = field(default_factory=dict)
    #: The last micro-batch of each stream.
    batches: dict[str, int] = field(default_factory=dict)

    def dates(self, name: str) -> dict[str, list[dict]]:
        """The layers of each date of a table."""
        found: dict[str, list[dict]] = {}
        for layer in self.layers.get(name, []):
            for date in layer["rows"]:
                found.setdefault(date, []).append(layer)
        return found


class Change:
    """What one commit adds to the state that it was made from."""

    def __init__(self, tables: Tables, base: State):
        self.tables, self.base = tables, base
        self._added: list[tuple[str, str, dict[str, int]]] = []
        self._replaced: list[tuple[str, set[str], str | None, dict[str, int]]] = []
        self._merged: list[tuple[str, str, dict[str, list[str]], dict[str, int]]] = []
        self._marks: set[int] = set()
        self._cleared: tuple[set[int], int] = (set(), 0)
        self._states: dict[str, dict] = {}
        self._batch: tuple[str, int] | None = None

    def read(self, name: str) -> DataFrame:
        """A table as it was when this change began."""
        return self.tables.read(name, self.base)

    def upsert(self, name: str, rows: DataFrame) -> list[int]:
        """Rows replace those of equal keys, whatever other writers add meanwhile; returns their dates."""
        part, sizes = self.tables.write_layer(name, rows)
        if sizes:
            self._added.append((name, part, sizes))
        return sorted(int(d) for d in sizes if d != NO_DATE)

    def replace(self, name: str, rows: DataFrame, dates: list[int] | None = None) -> int:
        """Make rows all that the table has of some dates, or has; a conflict if others touch those."""
        part, sizes = self.tables.write_layer(name, rows)
        wanted = {str(d) for d in dates} | set(sizes) if dates is not None else {NO_DATE}
        self._replaced.append((name, wanted, part if sizes else None, sizes))
        return sum(sizes.values())

    def merge(self, name: str, rows: DataFrame, layers: dict[str, list[str]]) -> None:
        """Rows stand for all of some layers of dates, below later ones."""
        part, sizes = self.tables.write_layer(name, rows)
        self._merged.append((name, part, layers, {d: sizes.get(d, 0) for d in layers}))

    def mark(self, dates: list[int]) -> None:
        self._marks |= set(dates)

    def clear(self, dates: list[int], at: int | None = None) -> None:
        """Unmark dates, but those marked after a version."""
        self._cleared = set(dates), self.base.version if at is None else at

    def set_state(self, key: str, values: dict) -> None:
        """Write a small row; a conflict if others do."""
        self._states[key] = values

    def batch(self, stream: str, number: int) -> None:
        """This change is a micro-batch of a stream, which counts once."""
        self._batch = stream, number

    def __bool__(self) -> bool:
        return bool(self._added or self._replaced or self._merged or self._marks or self._cleared[0] or self._states or self._batch)

    def done(self, stream: str, number: int) -> bool:
        return self.base.batches.get(stream, -1) >= number

    def onto(self, now: State) -> State | None:
        """The state after this change, or None if its micro-batch is there already."""
        if self._batch and now.batches.get(self._batch[0], -1) >= self._batch[1]:
            return None
        new = copy.deepcopy(now)
        new.version, at = now.version + 1, self.base.version
        layer = lambda part, sizes: {"part": part, "commit": new.version, "rows": dict(sizes), "dates": len(sizes)}
        for name, dates, part, sizes in self._replaced:
            found = new.layers.get(name, [])
            for old in found:
                if old["commit"] > at and dates & set(old["rows"]):
                    raise Conflict(f"{name} has changed since commit {at}")
                old["rows"] = {d: n for d, n in old["rows"].items() if d not in dates}
            new.layers[name] = [old for old in found if old["rows"]] + ([layer(part, sizes)] if part else [])
        for name, part, merged, sizes in self._merged:
            found, last = new.layers.get(name, []), 0
            for date, parts in merged.items():
                have = [i for i, old in enumerate(found) if date in old["rows"]]
                if [found[i]["part"] for i in have[: len(parts)]] != parts:
                    raise Conflict(f"{name} of {date} has changed since commit {at}")
                last = max(last, have[len(parts) - 1])
                for i in have[: len(parts)]:
                    del found[i]["rows"][date]
            # Below later layers of its dates, which are all behind the last that it stands for.
            found.insert(last + 1, layer(part, sizes) | {"commit": max(found[i]["commit"] for i in range(last + 1))})
            new.layers[name] = [old for old in found if old["rows"]]
        for name, part, sizes in self._added:
            new.layers.setdefault(name, []).append(layer(part, sizes))
        gone, upto = self._cleared
        new.dirty = {d: m for d, m in new.dirty.items() if int(d) not in gone or m[0] > upto}
        new.dirty |= {str(d): [new.version, int(time.time() * 1000)] for d in self._marks}
        for key, values in self._states.items():
            if now.states.get(key, {}).get("commit", 0) > at:
                raise Conflict(f"state {key} has changed since commit {at}")
            new.states[key] = {"commit": new.version, "values": values}
        if self._batch:
            new.batches[self._batch[0]] = self._batch[1]
        return new


class Tables:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._jpath = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jpath(self.root).getFileSystem(self._conf)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._jpath(path))

    def exists(self, path: str) -> bool:
        """Whether a folder was written to its end."""
        return self._exists(f"{path}/_SUCCESS")

    def remove(self, path: str) -> None:
        self._fs.delete(self._jpath(path), True)

    def dated(self, name: str) -> bool:
        return name not in INSIDE and (SCHEMAS[name].startswith("date int") or ", date int" in SCHEMAS[name])

    def _names(self, name: str) -> list[str]:
        return [part.split(" ")[0] for part in SCHEMAS[name].split(", ")]

    # --- commits

    def _list(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._jpath(path))] if self._exists(path) else []

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._list(f"{self.root}/_commits") if n.endswith(".json") and n[0].isdigit())

    def state(self) -> State:
        """The newest state."""
        while True:
            numbers = self._numbers()
            if not numbers:
                return State()
            try:
                return State(**json.loads(self._text(f"{self.root}/_commits/{numbers[-1]}.json")))
            except Py4JJavaError:
                if numbers[-1] in self._numbers():  # else it went while newer ones came
                    raise

    def _text(self, path: str) -> str:
        stream = self._fs.open(self._jpath(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, state: State) -> bool:
        """Write a commit unless its number is taken."""
        target, draft = f"{self.root}/_commits/{state.version}.json", f"{self.root}/_commits/_draft-{uuid.uuid4().hex}"
        stream = self._fs.create(self._jpath(draft), True)
        try:
            stream.write(json.dumps(vars(state)).encode())
        finally:
            stream.close()
        try:
            self._claim(draft, target)
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            if self._exists(draft):
                self._fs.delete(self._jpath(draft), False)
        return True

    def _claim(self, draft: str, target: str, link: bool | None = None) -> None:
        """Give a file a second name, or another one, if nothing has it."""
        if self._fs.getScheme() == "file" if link is None else link:
            of = lambda p: self._jvm.java.io.File(self._jpath(p).toUri().getPath()).toPath()
            self._jvm.java.nio.file.Files.createLink(of(target), of(draft))
        else:
            none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(target).toUri(), self._conf).rename(self._jpath(draft), self._jpath(target), none)

    def commit(self, work: Callable[[Change], object], tries: int = 20) -> object:
        """Do what `work` asks for as one commit; it is called again if what it read has changed. Returns its result."""
        for _ in range(tries):
            change = Change(self, self.state())
            result = work(change)
            if not change:
                return result
            try:
                now = change.base
                while (new := change.onto(now)) and not self._create(new):
                    now = self.state()
                return result
            except Conflict as conflict:
                last = conflict
        raise last

    def vacuum(self, older_than_s: float = 3600) -> int:
        """Remove earlier commits, and layers that no commit names and that were not written lately; returns how many layers."""
        for n in self._numbers()[:-KEPT_COMMITS]:
            self._fs.delete(self._jpath(f"{self.root}/_commits/{n}.json"), False)
        named, opened = set(), set()
        for n in self._numbers():
            state = State(**json.loads(self._text(f"{self.root}/_commits/{n}.json")))
            named |= {layer["part"] for layers in state.layers.values() for layer in layers}
            opened |= {s["values"]["path"].rsplit("/", 1)[1] for s in state.states.values() if s["values"].get("path")}
        gone = 0
        for name in OPENED:
            for folder in self._list(self.path(name)):
                part = self._jpath(f"{self.path(name)}/{folder}")
                if folder not in opened and self._fs.getFileStatus(part).getModificationTime() <= (time.time() - older_than_s) * 1000:
                    self._fs.delete(part, True)
        for name in SCHEMAS:
            for folder in self._list(self.path(name)):
                part = self._jpath(f"{self.path(name)}/{folder}")
                if folder.startswith("part=") and folder[5:] not in named and self._fs.getFileStatus(part).getModificationTime() <= (time.time() - older_than_s) * 1000:
                    gone += self._fs.delete(part, True)
        return gone

    # --- layers

    def write_layer(self, name: str, rows: DataFrame) -> tuple[str, dict[str, int]]:
        """Write rows, one for each key, as a layer; its name and rows by date, which are none if there are no rows.

        Rows are read twice, once to count them by date.
        """
        part, key = f"p{uuid.uuid4().hex}", schemas.PRIMARY_KEYS[name]
        dated = self.dated(name)
        rows = rows.select(*self._names(name))
        if dated:
            rows = rows.where("date is not null")
        counted = rows.groupBy("date").agg(F.count("*").alias("n")) if dated else rows.agg(F.lit(NO_DATE).alias("date"), F.count("*").alias("n"))
        sizes = {str(r.date): r.n for r in counted.collect() if r.n}  # as many as days
        if not sizes:
            return part, {}
        rows = latest_by_key(rows, [*(["date"] if dated and "date" not in key else []), *key], [F.col(c) for c in self._names(name) if c not in key])
        path = f"{self.path(name)}/part={part}"
        lookup = {}
        for c in key:
            if c not in schemas.PLACE and f"{c} string" in SCHEMAS[name].split(", "):
                # Without a number of values a filter takes a megabyte of each file.
                lookup |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.expected.ndv#{c}": str(min(max(sizes.values()), FILE_ROWS))}
        if not dated:
            rows.repartition(max(1, -(-sum(sizes.values()) // FILE_ROWS))).write.options(**lookup).parquet(path)
            return part, sizes
        # A date's rows go to as many tasks as they need, each of which writes few dates.
        salts = {d: -(-n // FILE_ROWS) for d, n in sizes.items() if n > FILE_ROWS}
        of = _of_date(salts, 1)
        rows = rows.repartition("date", F.pmod(F.xxhash64(*key), of))
        rows.write.options(**lookup).partitionBy("date").parquet(path)
        return part, sizes

    def read(self, name: str, state: State | None = None) -> DataFrame:
        """The table, empty if it was never written. Filters on date prune layers' folders."""
        state = state or self.state()
        if name == "ai_daily_dirty":
            return self.spark.createDataFrame([(int(d), dt.datetime.fromtimestamp(m[1] / 1000, dt.timezone.utc).replace(tzinfo=None)) for d, m in sorted(state.dirty.items())], SCHEMAS[name])
        if name == "log_import_state":
            rows = [s["values"] for s in state.states.values() if "status" in s["values"]]
            return self.spark.createDataFrame([tuple(restored(r[n]) for n in self._names(name)) for r in rows], SCHEMAS[name])
        dates = state.dates(name)
        if not dates:
            return self.spark.createDataFrame([], SCHEMAS[name])
        first = self._scan(name, [(layers[0], d) for d, layers in dates.items()])
        later = [(layer, d) for d, layers in dates.items() for layer in layers[1:]]
        if not later:
            return first.select(*self._names(name))
        key = [*(["date"] if self.dated(name) and "date" not in schemas.PRIMARY_KEYS[name] else []), *schemas.PRIMARY_KEYS[name]]
        wanted = {layer["part"] for layer, _ in later}
        place = {layer["part"]: i for i, layer in enumerate(state.layers[name]) if layer["part"] in wanted}
        newest = latest_by_key(self._scan(name, later).withColumn("_place", _of_part(place)), key, [F.col("_place")])
        newest = newest.select(*self._names(name))
        changed = newest.select(*[F.col(c).alias(f"_{c}") for c in key])
        same = [first[c].eqNullSafe(changed[f"_{c}"]) for c in key]
        return first.select(*self._names(name)).join(changed, same, "left_anti").unionByName(newest)

    def _scan(self, name: str, wanted: list[tuple[dict, str]]) -> DataFrame:
        """The rows of some dates of layers, and the layer's name."""
        base, dates = self.path(name), {}
        for layer, date in wanted:
            dates.setdefault(layer["part"], (layer, []))[1].append(date)
        paths = []
        for part, (layer, some) in dates.items():
            whole = some == [NO_DATE] or len(some) == layer["dates"]
            paths += [f"{base}/part={part}"] if whole else [f"{base}/part={part}/date={d}" for d in some]
        return self.spark.read.schema(SCHEMAS[name] + ", part string").option("basePath", base).parquet(*paths)

    def compact(self, name: str | None = None) -> list[str]:
        """Make one layer of each date whose later layers are many or large; returns the tables that were changed."""
        done, now = [], self.state()
        for table in [name] if name else [t for t in SCHEMAS if t not in INSIDE]:
            changed: list[str] = []

            def merge(change: Change, table: str = table, changed: list[str] = changed) -> None:
                changed.clear()
                dates = {d: layers for d, layers in change.base.dates(table).items() if _ripe([x["rows"][d] for x in layers])}
                if dates:
                    rows = change.read(table)
                    if list(dates) != [NO_DATE]:
                        rows = rows.where(F.col("date").isin([int(d) for d in dates]))
                    change.merge(table, rows, {d: [x["part"] for x in layers] for d, layers in dates.items()})
                    changed.append(table)

            if any(_ripe([x["rows"][d] for x in layers]) for d, layers in now.dates(table).items()):
                self.commit(merge)
                done += changed
        return done

    # --- one table at a time

    def upsert_dated(self, name: str, rows: DataFrame) -> list[int]:
        """Merge rows by primary key; returns the touched dates."""
        return self.commit(lambda change: change.upsert(name, rows))

    upsert_small = upsert_dated

    def replace_small(self, name: str, rows: DataFrame) -> None:
        self.commit(lambda change: change.replace(name, rows))

    def replace_dates(self, name: str, rows: DataFrame, dates: list[int]) -> int:
        """Make `rows` all that the table has of `dates`. Returns the number of rows written."""
        return self.commit(lambda change: change.replace(name, rows, dates))

    def add_counts(self, name: str, rows: DataFrame, stream: str | None = None, number: int = 0) -> list[int]:
        """Add counts to those stored under equal keys, once for a micro-batch of a stream."""
        key = schemas.PRIMARY_KEYS[name]

        def work(change: Change) -> list[int]:
            if stream is not None and change.done(stream, number):
                return []
            fresh = add_counts(rows, key=key)
            dates = sorted(r.date for r in fresh.select("date").distinct().collect() if r.date is not None)
            # Sums need all that is there, so others must not come between; what is not touched is not read.
            old = change.read(name).where(F.col("date").isin(dates)).select(*key, "count")
            if dates:
                change.replace(name, add_counts(old, fresh, key=key), dates)
            if stream is not None:
                change.batch(stream, number)
            return dates

        return self.commit(work)


def _ripe(rows: list[int]) -> bool:
    """Whether later layers are too many, or too large beside the first."""
    return len(rows) > 1 and (len(rows) - 1 > LAYERS or sum(rows[1:]) > SHARE * rows[0])


def _of_date(salts: dict[str, int], otherwise: int) -> Column:
    """The number of salts of a date: few dates have more than one."""
    found = F.lit(otherwise)
    for date, n in salts.items():
        found = F.when(F.col("date") == int(date), n).otherwise(found)
    return found


def _of_part(places: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), F.col("part"))


def kept(value):
    """A value of a small row as JSON has it."""
    return {"ms": round(value.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)} if isinstance(value, dt.datetime) else value


def restored(value):
    return dt.datetime.fromtimestamp(value["ms"] / 1000, dt.timezone.utc).replace(tzinfo=None) if isinstance(value, dict) else value
