"""Files from ZIP archives, one archive per repository.

``read_archives`` reads whole archives as rows of the ``binaryFile`` source (2 GB at most each). ``read_archives_by_range`` reads the
directories of the archives first and deals the members to tasks by where they lie; a task reads the bytes of its members only.
"""
from __future__ import annotations

import bz2
import io
import lzma
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths, text, vocab
from ..operators.inventory import skip_dirs
from .scratch import saved

_MEMBERS = "archive string, repo_id string, path string, bytes binary, error string"
# Rows are handed over once this much text is decompressed, so a large archive is never whole in memory.
_FLUSH_BYTES = 16 << 20
_FLUSH_ROWS = 10_000
_MEMBER_FIELDS = pa.schema([("archive", pa.string()), ("repo_id", pa.string()), ("path", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])


_DAMAGE = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, lzma.LZMAError, NotImplementedError, RuntimeError, EOFError, OSError, ValueError)


def _place(name: str) -> tuple[str, ...]:
    """Where a member lands: its parts without '.', empty and '..' ones."""
    out: list[str] = []
    for part in name.split("/"):
        if part == "..":
            out = out[:-1] if out else [name, part]  # leaves the archive: a place of its own, dropped later
        elif part not in ("", "."):
            out.append(part)
    return tuple(out)


def _wanted(z: zipfile.ZipFile) -> Iterator[tuple[zipfile.ZipInfo, str]]:
    """The members outside skipped folders with their names; of members of one place the last, as on a disk."""
    skipped = set(vocab.SKIP_DIRS["inventory"])
    names = [(m, m.filename.replace("\\", "/")) for m in z.infolist() if not m.is_dir()]
    last = {_place(name): m for m, name in names}
    for member, name in names:
        if not skipped & set(name.split("/")) and last[_place(name)] is member:
            yield member, name


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, of which one at a time is a Python value; a batch is let go before the next one comes."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k].as_py() for c in batch.columns)
        del batch


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for archive, repo_id, data in _one_by_one(batches):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for member, name in _wanted(z):  # skipped folders are dropped before they are decompressed
                    try:
                        data_of_member = z.read(member)
                    except _DAMAGE as e:  # only this member is lost
                        rows.append((archive, repo_id, name, None, f"{type(e).__name__}: {e}"))
                        continue
                    rows.append((archive, repo_id, name, data_of_member, None))
                    held += len(data_of_member)
                    if held > _FLUSH_BYTES:
                        yield _arrow(rows)
                        rows, held = [], 0
        except _DAMAGE as e:
            rows.append((archive, repo_id, None, None, f"{type(e).__name__}: {e}"))
        if len(rows) >= _FLUSH_ROWS:
            yield _arrow(rows)
            rows, held = [], 0
    yield _arrow(rows)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MEMBER_FIELDS)], schema=_MEMBER_FIELDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["archive", "repo_id", "path", "bytes", "error"])


def unpack_archives(archives: DataFrame) -> DataFrame:
    """Member rows of (archive, repo_id, content) rows: (archive, repo_id, path, bytes, error).

    An archive that cannot be opened gives one row with ``error`` and no path, a damaged member one with its path; all other
    members are kept. Of members of the same normalised path only the last one counts, as on a disk.
    """
    return archives.select("archive", "repo_id", "content").mapInArrow(_unpack, _MEMBERS)


def files_of(members: DataFrame) -> DataFrame:
    """(repo_id, path, content, size) of the good members, with safe, normalised paths."""
    path = paths.normalise(F.col("path"))
    good = members.filter("error is null").select(
        "repo_id", path.alias("path"), text.decode_text(F.col("bytes")).alias("content"),
        F.octet_length("bytes").cast("bigint").alias("size"))
    # Again after normalising: 'a/./build/x' only shows its folder now.
    return skip_dirs(good.filter("path is not null"), dirs=vocab.SKIP_DIRS["inventory"], match="any_part")


def bad_archives(members: DataFrame) -> DataFrame:
    """(archive, repo_id, path, error); path is null where the archive as a whole cannot be read."""
    return members.filter("error is not null").select("archive", "repo_id", "path", "error")


def archive_rows(binary: DataFrame) -> DataFrame:
    """(archive, repo_id, content) of ``binaryFile`` rows; the repository is named after the archive."""
    repo = F.regexp_replace(paths.name(F.col("path")), r"(?i)\.zip$", "")
    return binary.select(F.col("path").alias("archive"), repo.alias("repo_id"), "content")


def read_archives(spark: SparkSession, glob: str) -> DataFrame:
    """Member rows of all archives below a glob; pass them to ``files_of`` and ``bad_archives``."""
    return unpack_archives(archive_rows(spark.read.format("binaryFile").load(glob)))


# --- members by range ------------------------------------------------------------------------------------

#: Members that begin in the same range of so many bytes of an archive are read by one task, in order.
RANGE_BYTES = 64 << 20
#: Tasks for each core that list archives, at most.
LISTING_TASKS = 8
_LISTED = "archive string, repo_id string, path string, at bigint, packed bigint, size bigint, method int, crc bigint, locked boolean, error string"
Opener = Callable[[str], BinaryIO]


def address(path: str) -> str:
    """A path as Spark writes it (``file:/x``, ``/x``) as an address with ``//``."""
    scheme, colon, rest = path.partition(":")
    return path if colon and rest.startswith("//") else f"file://{rest if colon and scheme == 'file' else path}"


def open_uri(path: str) -> BinaryIO:
    """A seekable file of any store that pyarrow opens by its address: local, HDFS, S3, GCS."""
    from pyarrow import fs
    store, inside = fs.FileSystem.from_uri(address(path))
    return store.open_input_file(inside)


def list_members(archives: DataFrame, opener: Opener = open_uri) -> DataFrame:
    """A row per wanted member of (archive, repo_id) rows: where it begins, its packed and whole size, method and checksum.

    Only the end and the central directory of an archive are read. One that has none gives a row with ``error`` and no path.
    """
    names = [f.split()[0] for f in _LISTED.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, repo_id in zip(batch["archive"], batch["repo_id"]):
                rows = []
                try:
                    with opener(archive) as f, zipfile.ZipFile(f) as z:
                        for m, name in _wanted(z):
                            rows.append((archive, repo_id, name, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC,
                                         bool(m.flag_bits & 1), None))
                            if len(rows) == 10_000:
                                yield pd.DataFrame(rows, columns=names)
                                rows = []
                except _DAMAGE as e:
                    rows.append((archive, repo_id, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=names)

    return archives.select("archive", "repo_id").mapInPandas(task, _LISTED)


def _member(f: BinaryIO, at: int, packed: int, size: int, method: int, crc: int, locked: bool) -> bytes:
    """The bytes of one member: behind its local header, unpacked and checked."""
    if locked:
        raise RuntimeError("the member is encrypted")
    if size >= 1 << 31:
        raise OverflowError("the member has 2 GB or more")
    f.seek(at)
    header = f.read(30)
    if len(header) < 30 or header[:4] != b"PK\x03\x04":
        raise zipfile.BadZipFile("no local header where the directory has one")
    f.seek(at + 30 + sum(struct.unpack("<HH", header[26:30])))
    data = f.read(packed)
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, size + 1)
    elif method == zipfile.ZIP_BZIP2:
        data = bz2.decompress(data)
    elif method != zipfile.ZIP_STORED:
        raise NotImplementedError(f"compression method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise zipfile.BadZipFile("Bad CRC-32 or size")
    return data


def read_members(listed: DataFrame, opener: Opener = open_uri, range_bytes: int = RANGE_BYTES, tasks: int | None = None) -> DataFrame:
    """Member rows (see ``unpack_archives``) of listed members.

    A task has the members of some ranges in the order of their bytes, and one member at a time in memory. So a large archive is
    read by many tasks, and many small ones by few: by ``tasks`` if given, else by as many as the rows of the list fill.
    """
    members = listed.filter("error is null").withColumn("range", F.floor(F.col("at") / range_bytes))
    dealt = members.repartition(*([tasks] if tasks else []), "archive", "range").sortWithinPartitions("archive", "at")

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        try:
            for batch in batches:
                rows, held = [], 0
                for r in batch.itertuples(index=False):
                    try:
                        if r.archive != name:
                            if file is not None:
                                file.close()
                            name, file = None, opener(r.archive)
                            name = r.archive
                        data = _member(file, int(r.at), int(r.packed), int(r.size), int(r.method), int(r.crc), bool(r.locked))
                        rows.append((r.archive, r.repo_id, r.path, data, None))
                        held += len(data)
                    except (*_DAMAGE, OverflowError) as e:  # only this member is lost
                        rows.append((r.archive, r.repo_id, r.path, None, f"{type(e).__name__}: {e}"))
                    if held > _FLUSH_BYTES:
                        yield _frame(rows)
                        rows, held = [], 0
                yield _frame(rows)
        finally:
            if file is not None:
                file.close()

    whole = listed.filter("error is not null").select("archive", "repo_id", "path", F.lit(None).cast("binary").alias("bytes"), "error")
    return dealt.mapInPandas(task, _MEMBERS).unionByName(whole)


def read_archives_by_range(spark: SparkSession, glob: str, opener: Opener = open_uri, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Member rows of all archives below a glob, of any size; pass them to ``files_of`` and ``bad_archives``.

    ``opener`` opens an archive's path on an executor, for stores that pyarrow does not know.
    """
    names = archive_rows(spark.read.format("binaryFile").load(glob)).select("archive", "repo_id")  # lists; opens nothing
    cores = spark.sparkContext.defaultParallelism
    # The source deals small archives out to tasks by ones, at so many bytes for opening each.
    listed = saved(list_members(names.coalesce(LISTING_TASKS * cores), opener), "members")
    n, unpacked = listed.agg(F.count("at"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return read_members(listed, opener, range_bytes, tasks=max(min(n, 2 * cores), int(unpacked) // RANGE_BYTES, 1))
