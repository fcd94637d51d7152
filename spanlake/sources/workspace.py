"""An episode's folder and the series it belongs to, in any store that Spark reaches: layout, pointer, status, and what is missing."""

from __future__ import annotations

import hashlib
import json
import shutil

from pyspark.sql import SparkSession

# The folders of a workspace, the files of a series, where the pointer lies.
FOLDERS = ["materials", "output", ".cache/subtitles", ".cache/audio", ".cache/visual", ".cache/alignment", ".cache/scene_drafts", ".cache/cast"]
CAST, WINDOWS, POINTER = "cast.json", "op_ed_windows.json", ".cache/series.json"
BINARIES = ["ffmpeg", "ffprobe"]
#: settings that a run may have, with what holds where they are not set
SETTINGS = {"spanlake.scenes.most": "35", "spanlake.scenes.least": "8", "spanlake.calls.attempts": "3", "spanlake.calls.base_url": "", "spanlake.calls.key": ""}
SECRET = ["spanlake.calls.key"]


class Store:
    """The few file operations that are needed, through Spark's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def size(self, path: str) -> int | None:
        """Bytes of a file; None if there is none."""
        store, where = self.at(path)
        return store.getFileStatus(where).getLen() if store.exists(where) and store.getFileStatus(where).isFile() else None

    def make(self, path: str) -> None:
        store, where = self.at(path)
        store.mkdirs(where)

    def read(self, path: str) -> bytes | None:
        if self.size(path) is None:
            return None
        store, where = self.at(path)
        stream = store.open(where)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, content: bytes) -> None:
        """Beside its place first, then by a rename, so that no half file is ever seen."""
        store, where = self.at(path + ".new")
        stream = store.create(where, True)
        stream.write(bytearray(content))
        stream.close()
        _, place = self.at(path)
        if store.exists(place):
            store.delete(place, False)
        if not store.rename(where, place):
            raise OSError(f"{path} cannot be put in place")


def _document(store: Store, path: str) -> dict | list | None:
    try:
        return json.loads(store.read(path) or b"null")
    except ValueError:
        return None


def init(spark: SparkSession, root: str) -> list[str]:
    """Make the folders of a workspace; those that are there stay."""
    store = Store(spark)
    for folder in FOLDERS:
        store.make(f"{root}/{folder}")
    return FOLDERS


def bind_series(spark: SparkSession, root: str, series: str) -> dict:
    """Point a workspace at its series, with a snapshot of the cast as it stands. A series that is the workspace itself, or whose
    files are empty, is refused."""
    store = Store(spark)
    if root.rstrip("/") == series.rstrip("/"):
        raise ValueError("a series cannot be the workspace itself")
    for name in (CAST, WINDOWS):
        if store.size(f"{series}/{name}") == 0:
            raise ValueError(f"{series}/{name} is empty")
    content = store.read(f"{series}/{CAST}")
    table = _document(store, f"{series}/{CAST}") or {}
    pointer = {"series": series, "sha256": hashlib.sha256(content).hexdigest() if content else None, "version": table.get("version")}
    if content:
        store.write(f"{root}/.cache/cast/snapshot.json", json.dumps(pointer | {"table": table}, ensure_ascii=False).encode())
    store.write(f"{root}/{POINTER}", json.dumps(pointer).encode())
    return pointer


def series_status(spark: SparkSession, root: str) -> dict:
    """bound, version, and whether the series' cast is another now than when the workspace was bound."""
    store = Store(spark)
    pointer = _document(store, f"{root}/{POINTER}")
    if not isinstance(pointer, dict):
        return {"bound": False, "version": None, "changed": False}
    content = store.read(f"{pointer['series']}/{CAST}")
    now = hashlib.sha256(content).hexdigest() if content else None
    return {"bound": True, "version": pointer["version"], "changed": now != pointer["sha256"] and pointer["version"] != "draft"}


def cast_table(spark: SparkSession, root: str) -> dict:
    """The cast that an episode may use: the series' where it is bound and there, else the snapshot, else an empty one."""
    store = Store(spark)
    pointer = _document(store, f"{root}/{POINTER}")
    table = _document(store, f"{pointer['series']}/{CAST}") if isinstance(pointer, dict) else None
    snapshot = _document(store, f"{root}/.cache/cast/snapshot.json")
    found = table if isinstance(table, dict) else snapshot.get("table") if isinstance(snapshot, dict) else None
    return {"entities": [], "slots": [], "clusters": [], "pending": []} | (found or {})


def doctor(spark: SparkSession, root: str) -> dict[str, bool]:
    """What a run needs: the folders, something in materials, and the programs that other stages call."""
    store, found = Store(spark), {}
    for folder in FOLDERS:
        system, where = store.at(f"{root}/{folder}")
        found[folder] = bool(system.exists(where))
    system, where = store.at(f"{root}/materials")
    found["material"] = bool(system.exists(where)) and len(list(system.listStatus(where))) > 0
    return found | {name: shutil.which(name) is not None for name in BINARIES}


def settings(spark: SparkSession) -> dict[str, str]:
    """Settings as they hold in a session; secrets are only told to be set."""
    held = {name: spark.conf.get(name, default) for name, default in SETTINGS.items()}
    return {name: ("set" if value else "") if name in SECRET else value for name, value in held.items()}
