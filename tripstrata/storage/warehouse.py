"""The layers under one root folder, and how a slice of a layer is replaced.

A layer's rows lie in generations, one folder per write. A small numbered file, the layer's
pointer, lists the folders that count; the highest number is the current one. A write adds a
generation and then one pointer file by a single rename, so readers see the table before or
after it and never a mix, whatever the number of slices replaced.

A replaced generation stays for a while: earlier pointers can be read by number, and a frame that
was read before a write still finds its files after it. ``vacuum`` removes what is neither among
the last ``keep`` pointers nor was replaced within ``grace``.

A pointer also holds, per batch, what the rows were built from (the ledger), and beside each
generation lies its manifest (``manifest``). Both change with the same rename as the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tripstrata.schemas import LAYERS, Layer
from tripstrata.session import settings, size_in_bytes
from tripstrata.storage.files import Files
from tripstrata.storage.manifest import Digest, FileEntry, folder_values, measure, total

ALL = "ALL"
Slice = tuple[str, ...]
# generation -> partition folders of it that count ("" for an unpartitioned layer)
Live = dict[str, list[str]]
# a window that touches more files than this is read by folders
MOST_PATHS = 2_000
# files of different folders that a task writes side by side; what belongs into further folders is sorted
MOST_OPEN = 32
# shuffled bytes that a task of an ordered layer sorts: in memory they are about six times as many
SORTED_BYTES = 32 << 20
# halves fingerprints, which are hexadecimal digits, and the amounts' unused digits
CODEC = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def side_by_side() -> dict[str, str]:
    """Settings under which a write into folders keeps their files open, and so need not sort its rows by folder."""
    return {_WRITERS: str(MOST_OPEN)}


def _write_settings(spark: SparkSession, about: Layer) -> dict[str, str]:
    if about.ordered:
        return {_ADVISORY: f"{min(SORTED_BYTES, size_in_bytes(spark.conf.get(_ADVISORY)))}b", _WRITERS: "0"}
    return side_by_side() if about.partition_by else {}


@dataclass(frozen=True)
class State:
    """What a pointer says. ``ledger``: batch -> what it was built from."""

    number: int = 0
    live: Live = field(default_factory=dict)
    ledger: dict[str, dict] = field(default_factory=dict)

    def as_json(self) -> str:
        return json.dumps({"live": self.live, "ledger": self.ledger})

    @classmethod
    def from_json(cls, number: int, content: str) -> State:
        held = json.loads(content)
        return cls(number, held["live"], held["ledger"])


# Pointers and manifests never change once written; the last ones read are kept, by Spark application and path.
_KEPT: dict[tuple[str, str], object] = {}
_MOST_KEPT = 128


def _once(spark: SparkSession, path: str, read: Callable[[], object]):
    key = (spark.sparkContext.applicationId, path)
    if key not in _KEPT:
        while len(_KEPT) >= _MOST_KEPT:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = read()
    return _KEPT[key]


@dataclass(frozen=True)
class Warehouse:
    spark: SparkSession
    root: str
    keep: int = 2
    grace: timedelta = timedelta(days=1)

    @property
    def files(self) -> Files:
        return Files(self.spark)

    def path(self, layer: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}"

    def _data(self, layer: str) -> str:
        return f"{self.path(layer)}/_data"

    def _pointers(self, layer: str) -> str:
        return f"{self.path(layer)}/_pointer"

    def _manifest(self, layer: str, generation: str) -> str:
        return f"{self.path(layer)}/_manifest/{generation}.json"

    # ---------------------------------------------------------------- reading

    def exists(self, layer: str) -> bool:
        return bool(self.files.names(self._pointers(layer)))

    def versions(self, layer: str) -> list[int]:
        """Numbers of the layer's pointers that can be read, the current one last."""
        return sorted(int(name) for name in self.files.names(self._pointers(layer)) if name.isdigit())

    def state(self, layer: str, as_of: int | None = None) -> State:
        """The layer's pointer, the current one or the one of a number; an empty one when it was never written."""
        numbers = self.versions(layer)
        if as_of is not None and as_of not in numbers:
            raise ValueError(f"{layer}: version {as_of} is not there; there are {numbers}")
        if not numbers:
            return State()
        number = numbers[-1] if as_of is None else as_of
        path = f"{self._pointers(layer)}/{number:020d}"
        return _once(self.spark, path, lambda: State.from_json(number, self.files.read_text(path)))

    def _frame(self, layer: str, paths: list[str]) -> DataFrame:
        """The schema is always given: inference would turn month keys into numbers."""
        schema = LAYERS[layer].schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", self._data(layer))
        return reader.parquet(*paths).select(*schema.fieldNames())

    def read(self, layer: str, as_of: int | None = None, batches: Iterable[str] | None = None) -> DataFrame:
        """The layer in declared column order, as it is or as it was; an empty frame when it has no rows.

        With ``batches``, values of the leading partition column, only their folders are listed and read.
        """
        wanted = None if batches is None else set(batches)
        return self._frame(layer, self._folders(layer, self.state(layer, as_of), wanted))

    def _folders(self, layer: str, state: State, wanted: set[str] | None = None) -> list[str]:
        return [
            f"{self._data(layer)}/gen={generation}/{folder}"
            for generation, folders in state.live.items()
            for folder in folders
            if wanted is None or folder_values(folder)[0] in wanted
        ]

    def listed(self, layer: str) -> list[tuple[str, str, int]]:
        """``(folder, name, bytes)`` of the layer's data files as the file system lists them."""
        root = self._data(layer)
        found = [(folder.split("/", 1)[1] if "/" in folder else "", f"{root}/{folder}") for folder in (p.removeprefix(f"{root}/") for p in self._folders(layer, self.state(layer)))]
        return [(folder, name, size) for folder, path in found for name, size, _ in self.files.stamp(path) if name.startswith("part-")]

    def read_between(self, layer: str, start: datetime, end: datetime, as_of: int | None = None) -> DataFrame:
        """The rows of the files that may hold a pickup in ``[start, end)``, found by their manifests.

        Rows outside the window are among them. Without manifests of times, or with more than
        ``MOST_PATHS`` files, the whole layer is read: its folders and the readers' own statistics
        then do the pruning.
        """
        state = self.state(layer, as_of)
        if not LAYERS[layer].time:
            raise ValueError(f"{layer} has no time column")
        chosen = [f"{self._data(layer)}/gen={g}/{entry.path}" for g, entry in self._live_entries(layer, state) if entry.touches(start, end)]
        return self.read(layer, as_of) if len(chosen) > MOST_PATHS else self._frame(layer, chosen)

    def _live_entries(self, layer: str, state: State) -> list[tuple[str, FileEntry]]:
        found = []
        for generation, folders in state.live.items():
            path, counted = self._manifest(layer, generation), set(folders)
            entries = _once(self.spark, path, lambda p=path: [FileEntry.from_json(json.loads(line)) for line in self.files.read_text(p).splitlines()])
            found += [(generation, entry) for entry in entries if entry.folder in counted]
        return found

    def entries(self, layer: str, as_of: int | None = None) -> list[FileEntry]:
        """The files that count of a layer kept by batch, with what they hold."""
        return [entry for _, entry in self._live_entries(layer, self.state(layer, as_of))]

    def paths(self, layer: str, wanted: Callable[[FileEntry], bool]) -> list[str]:
        return [f"{self._data(layer)}/gen={g}/{e.path}" for g, e in self._live_entries(layer, self.state(layer)) if wanted(e)]

    def read_files(self, layer: str, wanted: Callable[[FileEntry], bool]) -> DataFrame:
        """The rows of the files whose entry is wanted."""
        return self._frame(layer, self.paths(layer, wanted))

    def slices(self, layer: str, depth: int = 1) -> set[Slice]:
        """Leading partition values of the layer, from its pointer."""
        return {folder_values(folder)[:depth] for folders in self.state(layer).live.values() for folder in folders}

    def values(self, layer: str) -> list[str]:
        """Values of the leading partition column. Each has at least one row."""
        return sorted(values[0] for values in self.slices(layer))

    def second_values(self, layer: str) -> list[str]:
        """Values of the second partition column over all leading folders."""
        return sorted({values[1] for values in self.slices(layer, 2)})

    def row_count(self, layer: str) -> int:
        """Rows of the layer: from its manifests, or from the file footers of one that has none."""
        if LAYERS[layer].partition_by:
            return sum(entry.rows for entry in self.entries(layer))
        return self.read(layer).count()

    def batches(self, layer: str) -> dict[str, dict]:
        """Ledger of a layer kept by batch: rows, latest load (microseconds) and digest of each, and what it was built from."""
        state = self.state(layer)
        found: dict[str, dict] = {batch: {"rows": 0, "loaded": built.get("loaded"), "digest": Digest()} for batch, built in state.ledger.items()}
        grouped: dict[str, list[FileEntry]] = {}
        for _, entry in self._live_entries(layer, state):
            grouped.setdefault(entry.values[0], []).append(entry)
        for batch, entries in grouped.items():
            loads = [e.loaded for e in entries if e.loaded is not None]
            found[batch] = {"rows": sum(e.rows for e in entries), "loaded": max(loads, default=None), "digest": total(entries)}
        return {batch: facts | {"built": state.ledger.get(batch, {})} for batch, facts in sorted(found.items())}

    # ---------------------------------------------------------------- writing

    def publish(
        self,
        layer: str,
        df: DataFrame,
        replace: Iterable[str | Slice] | str,
        before_swap: Callable[[], None] | None = None,
        built: dict[str, dict] | None = None,
    ) -> list[Slice]:
        """Write ``df`` as a new generation in one job, then make it count by one rename.

        ``replace`` lists what is replaced: values of the leading partition column, or
        value pairs to replace single subfolders, or ``ALL``. Something listed without
        rows in ``df`` disappears. ``built`` says per batch what it was built from; batches
        may be in it that have no rows. A job that fails leaves the table as it was, and so
        does ``before_swap``, which runs before the rename. A driver that is killed leaves at
        most a generation that no pointer lists; ``recover`` removes such.
        """
        about = LAYERS[layer]
        listed = [] if replace == ALL else [v if isinstance(v, tuple) else (v,) for v in replace]
        depth = max((len(v) for v in listed), default=1)
        generation = f"g{uuid.uuid4().hex}"
        target = f"{self._data(layer)}/gen={generation}"
        try:
            writer = df.select(*about.schema.fieldNames()).write.options(**CODEC)
            with settings(self.spark, _write_settings(self.spark, about)):
                (writer.partitionBy(*about.partition_by) if about.partition_by else writer).parquet(target)
            arrived = self.files.leaves(target, len(about.partition_by))
            outside = {folder_values(f)[:depth] for f in arrived} - set(listed)
            if replace != ALL and outside:
                raise ValueError(f"{layer}: rows outside the replaced slices: {sorted(outside)}")
            if arrived and about.partition_by:
                self._describe(layer, generation, target)
            if before_swap:
                before_swap()
            state = self.state(layer)
            stays = lambda values: replace != ALL and values[:depth] not in listed
            kept = {g: left for g, folders in state.live.items() if (left := [f for f in folders if stays(folder_values(f))])}
            # a batch written whole has the generation as its version; replacing a subfolder leaves the batch what it was
            ledger = {b: facts for b, facts in state.ledger.items() if stays((b,))}
            fresh = {folder_values(f)[0] for f in arrived if f and depth == 1} | {*(built or {})}
            ledger |= {b: {"version": generation} | (built or {}).get(b, {}) for b in sorted(fresh)}
            self._point(layer, State(state.number + 1, kept | ({generation: arrived} if arrived else {}), ledger))
        except Exception:
            self.files.delete(target)
            self.files.delete(self._manifest(layer, generation))
            raise
        if not arrived:
            self.files.delete(target)
        self.vacuum([layer])
        return sorted({folder_values(folder)[:depth] for folder in arrived})

    def _describe(self, layer: str, generation: str, target: str) -> None:
        """The generation's manifest, read back from what was written."""
        about = LAYERS[layer]
        names = set(about.schema.fieldNames())
        loaded = "ingested_at" if "ingested_at" in names else None
        fingerprint = "row_fingerprint" if "row_fingerprint" in names else None
        written = self.spark.read.schema(about.schema).option("basePath", self._data(layer)).parquet(target)
        entries = measure(written, f"/gen={generation}/", about.time, loaded, fingerprint)
        self.files.write_text(self._manifest(layer, generation), "\n".join(json.dumps(e.as_json()) for e in entries))

    def _point(self, layer: str, state: State) -> None:
        """The rename that makes a table's new state count."""
        pointers = self._pointers(layer)
        goal = f"{pointers}/{state.number:020d}"
        if self.files.exists(goal):
            raise RuntimeError(f"{layer}: another run wrote version {state.number} meanwhile")
        draft = f"{pointers}/.draft-{uuid.uuid4().hex}"
        self.files.write_text(draft, state.as_json())
        self.files.move(draft, goal)

    def annotate(self, layer: str, facts: dict[str, dict]) -> None:
        """Add to what the ledger says of some batches; the rows stay as they are."""
        state = self.state(layer)
        ledger = state.ledger | {batch: state.ledger[batch] | more for batch, more in facts.items() if batch in state.ledger}
        if ledger != state.ledger:
            self._point(layer, State(state.number + 1, state.live, ledger))

    def publish_whole(self, layer: str, df: DataFrame) -> None:
        """Replace an unpartitioned table."""
        self.publish(layer, df, ALL)

    # ---------------------------------------------------------------- retention

    def vacuum(self, layers: Iterable[str] | None = None, keep: int | None = None, grace: timedelta | None = None) -> dict[str, list[int]]:
        """Remove versions that are neither among the last ``keep`` nor were replaced within ``grace``; returns their numbers."""
        keep = max(1, self.keep if keep is None else keep)
        since = datetime.now(timezone.utc) - (self.grace if grace is None else grace)
        gone: dict[str, list[int]] = {}
        for layer in layers or LAYERS:
            times = [(int(name), at) for name, _, at in self.files.stamp(self._pointers(layer)) if name.isdigit()] if self.exists(layer) else []
            # a version was replaced when the next one was written
            old = [number for (number, _), (_, replaced) in zip(times, times[1:], strict=False) if replaced / 1000 <= since.timestamp()]
            old = [number for number in old if number <= times[-1][0] - keep]
            if old:
                for number in old:
                    self.files.delete(f"{self._pointers(layer)}/{number:020d}")
                self._sweep(layer)
                gone[layer] = old
        return gone

    def _sweep(self, layer: str) -> list[str]:
        """Remove the folders and manifests that no pointer lists."""
        counted: dict[str, set[str]] = {}
        for number in self.versions(layer):
            for generation, folders in self.state(layer, number).live.items():
                counted.setdefault(generation, set()).update(folders)
        gone = []
        for name in self.files.folders(self._data(layer)):
            generation = name.split("=", 1)[1]
            whole = f"{self._data(layer)}/{name}"
            if generation not in counted:
                dead = [""]
                self.files.delete(self._manifest(layer, generation))
            else:
                dead = [f for f in self.files.leaves(whole, len(LAYERS[layer].partition_by)) if f not in counted[generation]]
            for folder in dead:
                self.files.delete(f"{whole}/{folder}".rstrip("/"))
            gone += [f"{name}/{folder}".rstrip("/") for folder in dead]
        return gone

    def recover(self) -> dict[str, list[str]]:
        """Remove what interrupted writes left: generations and folders that no pointer lists. Returns them per layer."""
        return {layer: sorted(gone) for layer in LAYERS if (gone := self._sweep(layer))}
