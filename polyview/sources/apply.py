"""Plans carried out on folders that every executor mounts: archives unpacked, files moved, times set again.

Unpacking has two phases.  First a Spark write stages every archive beside its destination, under a name of its own, and each task lists what it
staged in a journal; the write's commit names the journals of the tasks that count.  Until then no destination has changed, and ``recover`` (or the
write's abort) deletes what was staged.  After it, swaps run as a job over the journals: the old copy moves aside, the staged one
moves in, the old copy goes.  Every step may be run again, so a lost executor repeats its swaps, and ``recover`` finishes those that
a lost driver left.  At any time a destination, or the copy moved aside from it, is whole.

Moves and times need no staging: one rename or one call each, and doing them twice is doing them once.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from polyview.sources.archives import FAULTS

JOURNALS = ".polyview-apply"
_SWAP = "zip string, dest string, staged string, aside string, replace boolean, error string"


def _put(path: str, text: str) -> None:
    """Write a file that is never seen half written."""
    ready = f"{path}.{uuid.uuid4().hex}.ready"
    with open(ready, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(ready, path)


def own_root(names: list[str]) -> str | None:
    """The one top folder that holds every entry, if there is one: it is the destination itself."""
    real = [n for n in names if n.strip("/")]
    tops = {n.split("/")[0] for n in real}
    return tops.pop() if len(tops) == 1 and all("/" in n for n in real) else None


def stage_zip(path: str, staged: str) -> None:
    """Unpack a zip into the new folder ``staged``, without its own top folder; every checksum is tested on the way."""
    with zipfile.ZipFile(path) as z:
        infos = z.infolist()
        names = [i.filename for i in infos]
        if any(n.startswith(("/", "\\")) or ".." in n.replace("\\", "/").split("/") or ":" in n.split("/")[0] for n in names):
            raise ValueError("an entry leaves the archive's folder")
        top = own_root(names)
        os.makedirs(staged)
        for i in infos:
            rel = i.filename[len(top) + 1 :] if top else i.filename
            if not rel.strip("/"):
                continue
            to = os.path.join(staged, rel)
            if i.is_dir():
                os.makedirs(to, exist_ok=True)
                continue
            os.makedirs(os.path.dirname(to), exist_ok=True)
            with z.open(i) as source, open(to, "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)


class UnpackSink(DataSource):
    """Stages rows (zip, dest, replace); options ``root`` and ``run`` say where the journals lie."""

    @classmethod
    def name(cls) -> str:
        return "unpack"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Stager(os.path.join(self.options["root"], JOURNALS, self.options["run"]))


class _Staged(WriterCommitMessage):
    def __init__(self, journal: str):
        self.journal = journal


class _Stager(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> WriterCommitMessage:
        """Stage a task's archives.  One that cannot be read, or whose destination is taken, is noted and harms no other."""
        os.makedirs(self.folder, exist_ok=True)
        mark = uuid.uuid4().hex
        lines = []
        for r in rows:
            entry = {"zip": r["zip"], "dest": r["dest"], "staged": f"{r['dest']}.{mark}.partial", "aside": f"{r['dest']}.replaced", "replace": bool(r["replace"]), "error": None}
            _put(os.path.join(self.folder, f"{mark}.{len(lines)}.staging"), entry["staged"])  # found by recover() if this task dies
            if os.path.isdir(r["dest"]) and os.listdir(r["dest"]) and not entry["replace"]:
                entry["error"] = "the destination exists"
            else:
                try:
                    stage_zip(r["zip"], entry["staged"])
                except FAULTS as e:
                    entry["error"] = f"{type(e).__name__}: {e}"
                    shutil.rmtree(entry["staged"], ignore_errors=True)
            lines.append(json.dumps(entry))
        _put(os.path.join(self.folder, f"{mark}.journal"), "\n".join(lines))
        return _Staged(f"{mark}.journal")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        _put(os.path.join(self.folder, "COMMITTED"), "\n".join(m.journal for m in messages if m))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _roll_back(self.folder)


def _roll_back(folder: str) -> None:
    """Delete what a run staged, and the run."""
    for name in os.listdir(folder) if os.path.isdir(folder) else []:
        if name.endswith(".staging"):
            with open(os.path.join(folder, name)) as f:
                shutil.rmtree(f.read(), ignore_errors=True)
    shutil.rmtree(folder, ignore_errors=True)


def swap(dest: str, staged: str, aside: str, replace: bool) -> str:
    """Move a staged copy to its place; again after any interruption."""
    if os.path.isdir(staged):
        if os.path.isdir(dest) and not os.listdir(dest):
            os.rmdir(dest)  # an empty leftover
        if os.path.isdir(dest):
            if not replace:
                shutil.rmtree(staged, ignore_errors=True)
                return "refused: the destination exists"
            shutil.rmtree(aside, ignore_errors=True)  # of an older swap that was finished but for this
            os.rename(dest, aside)
        os.rename(staged, dest)
    elif not os.path.isdir(dest) and os.path.isdir(aside):
        os.rename(aside, dest)
        return "failed: the staged copy is gone, the old one is back"
    shutil.rmtree(aside, ignore_errors=True)
    return "unpacked"


def _swaps(spark: SparkSession, folder: str) -> DataFrame:
    """Run the swaps of a committed run and return (zip, dest, outcome)."""
    with open(os.path.join(folder, "COMMITTED")) as f:
        journals = [os.path.join(folder, n) for n in f.read().split("\n") if n]
    done = os.path.join(folder, "done")
    if journals and not os.path.exists(os.path.join(done, "_SUCCESS")):

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                b["outcome"] = [f"failed: {e}" if e else swap(d, s, a, r) for d, s, a, r, e in zip(b["dest"], b["staged"], b["aside"], b["replace"], b["error"])]
                yield b[["zip", "dest", "outcome"]]

        rows = spark.read.schema(_SWAP).json([f"file://{j}" for j in journals]).repartition("dest")
        rows.mapInPandas(run, "zip string, dest string, outcome string").write.mode("overwrite").parquet(f"file://{done}")
    for name in os.listdir(folder):
        if name.endswith(".staging"):
            with open(os.path.join(folder, name)) as f:  # of tasks that were run twice
                shutil.rmtree(f.read(), ignore_errors=True)
            os.unlink(os.path.join(folder, name))
    if not journals:
        return spark.createDataFrame([], "zip string, dest string, outcome string")
    return spark.read.parquet(f"file://{done}")


def recover(spark: SparkSession, root: str) -> list[str]:
    """Finish runs that were committed and undo those that were not; what was done, a line a run."""
    base, out = os.path.join(root, JOURNALS), []
    for run in sorted(os.listdir(base)) if os.path.isdir(base) else []:
        folder = os.path.join(base, run)
        if not os.path.exists(os.path.join(folder, "COMMITTED")):
            _roll_back(folder)
            out.append(f"{run}: undone")
        elif not os.path.exists(os.path.join(folder, "done", "_SUCCESS")):
            _swaps(spark, folder)
            out.append(f"{run}: finished")
    return out


def unpack(plan: DataFrame, root: str) -> DataFrame:
    """Carry out a plan (zip, dest, replace): (zip, dest, outcome).  Runs that were interrupted are finished or undone first.

    Of several zips for one destination none is unpacked.  A destination that exists is replaced only where the plan says so.
    """
    spark = plan.sparkSession
    spark.dataSource.register(UnpackSink)
    recover(spark, root)
    run = uuid.uuid4().hex
    rows = plan.select("zip", "dest", F.coalesce("replace", F.lit(False)).alias("replace"))
    contested = rows.groupBy("dest").agg(F.count("*").alias("n")).filter("n > 1").select("dest")
    clear = rows.join(contested, "dest", "left_anti").select("zip", "dest", "replace")
    clear.repartition("dest").write.format("unpack").option("root", root).option("run", run).mode("append").save()
    refused = rows.join(contested, "dest", "left_semi").select("zip", "dest", F.lit("refused: contested destination").alias("outcome"))
    return _swaps(spark, os.path.join(root, JOURNALS, run)).unionByName(refused)


class MoveSink(DataSource):
    """Carries out rows (src, dst): renames where only src exists."""

    @classmethod
    def name(cls) -> str:
        return "move"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Mover()


class _Mover(DataSourceWriter):
    def write(self, rows: Iterator) -> WriterCommitMessage:
        for r in rows:
            if os.path.exists(r["src"]) and not os.path.exists(r["dst"]):
                os.makedirs(os.path.dirname(r["dst"]), exist_ok=True)
                os.rename(r["src"], r["dst"])
        return WriterCommitMessage()


def _present(pairs: DataFrame) -> DataFrame:
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(has_src=[os.path.exists(p) for p in b["src"]], has_dst=[os.path.exists(p) for p in b["dst"]])

    return pairs.select("src", "dst").mapInPandas(look, "src string, dst string, has_src boolean, has_dst boolean")


def move_files(plan: DataFrame) -> dict[str, int]:
    """Rename files of a plan (src, dst): how many were moved, already moved, superseded (both exist; neither is touched) and missing.

    A source or target that two rows name is contested, and none of those rows is carried out.
    """
    spark = plan.sparkSession
    spark.dataSource.register(MoveSink)
    pairs = plan.select("src", "dst").filter("src <> dst").distinct()
    many = [pairs.groupBy(c).agg(F.count("*").alias("n")).filter("n > 1").select(c) for c in ("src", "dst")]
    clear = pairs.join(many[0], "src", "left_anti").join(many[1], "dst", "left_anti").select("src", "dst")
    state = F.when(F.col("has_src") & F.col("has_dst"), "superseded").when(F.col("has_dst"), "already").when(F.col("has_src"), "moved").otherwise("missing")
    counts = {r.state: r["count"] for r in _present(clear).groupBy(state.alias("state")).count().collect()}
    clear.write.format("move").mode("append").save()
    left = _present(clear).filter("has_src AND NOT has_dst").count()
    if left:
        raise OSError(f"{left} files were not moved")
    contested = pairs.count() - clear.count()
    return {s: counts.get(s, 0) for s in ("moved", "already", "superseded", "missing")} | {"contested": contested}


def restore_times(plan: DataFrame, root: str) -> DataFrame:
    """Set the times of a plan (rel, is_dir, mtime_ns) again, files before folders: rel and error of those that failed."""

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for rel, ns in zip(b["rel"], b["mtime_ns"]):
                try:
                    os.utime(os.path.join(root, rel), ns=(os.stat(os.path.join(root, rel)).st_atime_ns, int(ns)))
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pd.DataFrame({"rel": b["rel"], "error": errors})

    spark, failed = plan.sparkSession, []
    for kind in ("NOT is_dir", "is_dir"):  # neither changes the times of the folders above
        out = plan.filter(kind).select("rel", "mtime_ns").repartition("rel").mapInPandas(touch, "rel string, error string")
        failed += out.filter("error IS NOT NULL").collect()
    return spark.createDataFrame(failed, "rel string, error string")
