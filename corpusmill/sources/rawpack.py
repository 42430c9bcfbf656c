"""Raw packs as a Spark data source: int16 matrices of many songs in one blob a shard, read back by byte ranges.

A shard is `shard_<id>.codes`, the little-endian 16-bit codes of its songs as [codebook][frame], songs one after the other, and
`shard_<id>.json`, its names, offsets and totals. `_commits/<n>.json` lists the shards of one write with their first and last
names; a shard that no commit lists is not there. Within a write, songs are in order of name.

    rawpack.write(songs, path, per_shard=5000)          # name, codes [K][T]
    rawpack.write(more, path, per_shard=5000, append=True)
    rawpack.read(spark, path).where("name in ('a', 'b')")  # opens the shards that may hold them, reads their bytes alone

Tasks write into a staging folder of their own write, so that a task that is run again or fails leaves nothing behind that is
read; the commit moves the files and then puts down one small file, and until then readers see the pack as it was. Paths are those
of any file system that pyarrow knows and that the driver and all executors share.

A null name or null codes are refused, and so are codes beyond 16 bits, rows of different lengths and a name that a write has
twice. A song without frames has an empty range. An empty write commits no shard. A pack that is written to holds songs of one
number of codebooks. Columns but name and codes are not kept.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, WriterCommitMessage

FORMAT, FORMAT_VERSION = "rawpack", 2
SCHEMA = "name string, shard_id long, local_idx int, offset long, n_frames int, codes array<array<smallint>>"
#: Bytes of codes in one batch of rows, and moved at once when a blob is put together.
BATCH_BYTES, COPY_BYTES = 8 << 20, 4 << 20
#: Bytes of codes and songs of the shards that one task reads, at most, if it reads more than one.
TASK_BYTES, TASK_SONGS = 32 << 20, 100_000


def _files(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _load(files, path: str) -> dict:
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _store(files, path: str, value: dict) -> None:
    with files.open_output_stream(path) as f:
        f.write(json.dumps(value).encode())


def commits(path: str) -> list[dict]:
    """The commits of a pack in their order; none where there is no pack."""
    from pyarrow import fs

    files, root = _files(path)
    listed = files.get_file_info(fs.FileSelector(f"{root}/_commits", allow_not_found=True))
    return [_load(files, f.path) for f in sorted(listed, key=lambda f: f.path) if f.path.endswith(".json")]


def shards(path: str) -> list[dict]:
    """What the commits say of each shard: shard_id, first and last name, n_songs, total_T and bytes."""
    return [s for c in commits(path) for s in c["shards"]]


# Reading ------------------------------------------------------------------------------------------------------------------


class Shards(InputPartition):
    def __init__(self, shards: list[dict], names: frozenset | None):
        self.shards, self.names = shards, names


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.names = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, In) and f.attribute == ("name",):
                names = f.value
            elif isinstance(f, (EqualTo, EqualNullSafe)) and f.attribute == ("name",):
                names = (f.value,)
            else:
                yield f
                continue
            found = frozenset(x for x in names if x is not None)
            self.names = found if self.names is None else self.names & found

    def partitions(self) -> list[InputPartition]:
        """If names were asked for, a partition for each shard that may hold some, with these; else neighbouring shards share one as
        long as they are small."""
        if self.names is not None:
            inside = [(s, frozenset(x for x in self.names if s["first"] <= x <= s["last"])) for s in shards(self.path)]
            return [Shards([s], names) for s, names in inside if names]
        out, size, songs = [], 0, 0
        for s in shards(self.path):
            size, songs = size + s["bytes"], songs + s["n_songs"]
            if not out or size > TASK_BYTES or songs > TASK_SONGS:
                out.append([])
                size, songs = s["bytes"], s["n_songs"]
            out[-1].append({"shard_id": s["shard_id"]})
        return [Shards(some, None) for some in out]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Shards):  # what Spark asks for where there are no partitions
            return
        files, root = _files(self.path)
        for shard in partition.shards:
            yield from self._songs(files, root, shard["shard_id"], partition.names)

    def _songs(self, files, root: str, shard_id: int, names: frozenset | None) -> Iterator[pa.RecordBatch]:
        meta = _load(files, f"{root}/shard_{shard_id}.json")
        if meta["format_version"] != FORMAT_VERSION:
            raise ValueError(f"shard {meta['shard_id']}: format_version must be {FORMAT_VERSION}")
        info = files.get_file_info(f"{root}/shard_{meta['shard_id']}.codes")
        if info.size != 2 * meta["n_codebooks"] * meta["total_T"]:
            raise ValueError(f"shard {meta['shard_id']}: {info.size} bytes, {2 * meta['n_codebooks'] * meta['total_T']} expected")
        with files.open_input_file(info.path) as blob:
            rows, size = [], 0
            for i, name in enumerate(meta["names"]):
                if names is None or name in names:
                    begin, end = meta["offsets"][i], meta["offsets"][i + 1]
                    parts = [blob.read_at(2 * (end - begin), 2 * (k * meta["total_T"] + begin)) if end > begin else b"" for k in range(meta["n_codebooks"])]
                    rows.append((name, i, begin, end - begin, b"".join(parts)))
                    size += len(rows[-1][-1])
                    if size >= BATCH_BYTES:
                        yield _batch(meta, rows)
                        rows, size = [], 0
            if rows:
                yield _batch(meta, rows)


def _batch(meta: dict, rows: list[tuple]) -> pa.RecordBatch:
    """A batch of rows whose codes are the songs' bytes, codebook after codebook."""
    k, names, places, begins, frames, codes = meta["n_codebooks"], *zip(*rows, strict=True)
    values = np.frombuffer(b"".join(codes), "<i2").astype(np.int16, copy=False)
    inner = np.concatenate([[0], np.cumsum(np.repeat(frames, k))]).astype(np.int32)
    outer = (np.arange(len(rows) + 1) * k).astype(np.int32)
    nested = pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(values)))
    columns = [pa.array(names), pa.array([meta["shard_id"]] * len(rows), pa.int64()), pa.array(places, pa.int32()), pa.array(begins, pa.int64()), pa.array(frames, pa.int32()), nested]
    return pa.RecordBatch.from_arrays(columns, ["name", "shard_id", "local_idx", "offset", "n_frames", "codes"])


# Writing ------------------------------------------------------------------------------------------------------------------


class Written(WriterCommitMessage):
    def __init__(self, shards: list[dict]):
        self.shards = shards


class Blob:
    """One shard as it is written: a spool for each codebook, put behind each other once the shard is whole."""

    def __init__(self, shard_id: int):
        self.shard_id, self.names, self.offsets, self.spools = shard_id, [], [0], []

    def add(self, name: str, codes: list[list[int]]) -> None:
        if name is None or codes is None:
            raise ValueError("a song has no name or no codes")
        if self.names and name <= self.names[-1]:
            raise ValueError(f"{name} does not come after {self.names[-1]}")
        if not self.names:
            self.spools = [tempfile.TemporaryFile() for _ in codes]
        if len(codes) != len(self.spools) or len({len(row) for row in codes}) > 1:
            raise ValueError(f"{name}: codes of another shape than [{len(self.spools)}][T]")
        for spool, row in zip(self.spools, codes, strict=True):
            spool.write(np.asarray(row, "<i2").tobytes())  # a code beyond 16 bits raises
        self.names.append(name)
        self.offsets.append(self.offsets[-1] + (len(codes[0]) if codes else 0))

    def close(self, files, folder: str) -> dict:
        """Writes blob and index, and says what a commit has to know."""
        size = 0
        with files.open_output_stream(f"{folder}/shard_{self.shard_id}.codes") as out:
            for spool in self.spools:
                spool.seek(0)
                while part := spool.read(COPY_BYTES):
                    out.write(part)
                    size += len(part)
                spool.close()
        meta = {"format_version": FORMAT_VERSION, "shard_id": self.shard_id, "n_codebooks": len(self.spools), "total_T": self.offsets[-1], "names": self.names, "offsets": self.offsets}
        _store(files, f"{folder}/shard_{self.shard_id}.json", meta)
        return {"shard_id": self.shard_id, "first": self.names[0], "last": self.names[-1], "n_songs": len(self.names), "n_codebooks": len(self.spools), "total_T": self.offsets[-1], "bytes": size}


class Writer(DataSourceWriter):
    """Rows (shard_id, name, codes), all of a shard in one task and in order of name."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        files, root = _files(self.path)
        folder, made, blob = f"{root}/_staging-{self.run}/{uuid.uuid4().hex}", [], None
        for row in iterator:
            if blob is None or row["shard_id"] != blob.shard_id:
                if blob:
                    made.append(blob.close(files, folder) | {"folder": folder})
                else:
                    files.create_dir(folder)
                blob = Blob(row["shard_id"])
            blob.add(row["name"], row["codes"])
        if blob:
            made.append(blob.close(files, folder) | {"folder": folder})
        return Written(made)

    def commit(self, messages) -> None:
        files, root = _files(self.path)
        made = sorted((s for m in messages if m for s in m.shards), key=lambda s: s["shard_id"])
        before = [] if self.overwrite else commits(self.path)
        books = {s["n_codebooks"] for c in [*before, {"shards": made}] for s in c["shards"]}
        if len(books) > 1 or len({s["shard_id"] for c in [*before, {"shards": made}] for s in c["shards"]}) != sum(len(c["shards"]) for c in [*before, {"shards": made}]):
            self.abort(messages)
            raise ValueError("the songs have other numbers of codebooks than the pack, or shards that are there already")
        if self.overwrite:
            _delete(files, f"{root}/_commits")
        for s in made:
            for kind in ("codes", "json"):
                files.move(f"{s['folder']}/shard_{s['shard_id']}.{kind}", f"{root}/shard_{s['shard_id']}.{kind}")
        files.create_dir(f"{root}/_commits")
        at = f"{root}/_commits/{len(before):08d}.json"
        _store(files, f"{at}.part", {"run": self.run, "shards": [{k: v for k, v in s.items() if k != "folder"} for s in made]})
        files.move(f"{at}.part", at)
        _delete(files, f"{root}/_staging-{self.run}")

    def abort(self, messages) -> None:
        files, root = _files(self.path)
        _delete(files, f"{root}/_staging-{self.run}")


def _delete(files, folder: str) -> None:
    from pyarrow import fs

    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


class RawPack(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


# Functions ----------------------------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    """Makes format("rawpack") known, with filters on names pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawPack)


def read(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """Songs of a pack (name, shard_id, local_idx, offset, n_frames, codes); of some names, only their shards are opened."""
    register(spark)
    songs = spark.read.format(FORMAT).load(path)
    return songs if names is None else songs.where(F.col("name").isin(names))


def write(songs: DataFrame, path: str, per_shard: int, name: str = "name", codes: str = "codes", append: bool = False) -> None:
    """Writes songs in order of name, per_shard to a shard; append numbers shards on from the greatest one there. A shard is written
    by one task, which holds one song at a time."""
    from corpusmill.operators.windows import global_row_number

    register(songs.sparkSession)
    there = shards(path)
    if there and not append:
        raise ValueError(f"there is a pack in {path}")
    first = 1 + max((s["shard_id"] for s in there), default=-1)
    named = songs.select(F.col(name).alias("name"), F.col(codes).cast("array<array<int>>").alias("codes"))
    # Names alone are sorted over the whole table; the codes move once, to the task that writes their shard.
    placed = global_row_number(named.select("name"), ["name"], "_rn").select(F.col("name").alias("_n"), (F.lit(first) + F.floor((F.col("_rn") - 1) / per_shard)).cast("long").alias("shard_id"))
    rows = named.join(placed.dropDuplicates(["_n"]), F.col("name").eqNullSafe(F.col("_n"))).select("shard_id", "name", "codes")
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "name").write.format(FORMAT).mode("append").save(path)
