"""Members of zip archives as rows: the central directory is read by a task, members by byte ranges in others."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_HEADER = struct.Struct("<4s5H3L2H")  # fixed values of the zip format: the header before each member
STORED, DEFLATED = 0, 8
MEMBERS = "archive string, name string, at long, packed long, size long, method int, crc long"


class DamagedMember(ValueError):
    """A member whose bytes are not what the directory says."""


def directory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """MEMBERS of the archives, one task an archive; folders are left out. 64-bit archives are read too."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = pafs.FileSystem.from_uri(path)
                with files.open_input_file(at) as file, zipfile.ZipFile(file) as archive:
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                for first in range(0, len(infos), 4096):
                    part = infos[first : first + 4096]
                    columns = [[path] * len(part), [i.filename for i in part], [i.header_offset for i in part], [i.compress_size for i in part], [i.file_size for i in part], [i.compress_type for i in part], [i.CRC for i in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], [c.split()[0] for c in MEMBERS.split(", ")])

    return spark.createDataFrame([(p if "://" in p else f"file://{p}",) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(listed, MEMBERS)


def member(file: pa.NativeFile, at: int, packed: int, method: int, crc: int) -> bytes:
    """A member's bytes, read from its place and checked."""
    file.seek(at)
    head = file.read(LOCAL_HEADER.size)
    if len(head) < LOCAL_HEADER.size or head[:4] != b"PK\x03\x04":
        raise DamagedMember(f"no member starts at byte {at}")
    *_, name, extra = LOCAL_HEADER.unpack(head)
    file.seek(at + LOCAL_HEADER.size + name + extra)
    data = file.read(packed)
    if method not in (STORED, DEFLATED):
        raise DamagedMember(f"method {method} is not read")
    try:
        data = data if method == STORED else zlib.decompressobj(-15).decompress(data)
    except zlib.error as e:
        raise DamagedMember(f"member at byte {at}: {e}") from e
    if zlib.crc32(data) != crc:
        raise DamagedMember(f"member at byte {at} has another checksum")
    return data


def contents(members: DataFrame) -> DataFrame:
    """archive, name, value (bytes) of MEMBERS rows, in order of place within a task. A damaged member fails the read.

    Select the members first: only theirs bytes are read. Ranges of places go to tasks, so neighbours are read together.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            for archive, name, at, packed, _, method, crc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != path:
                    files, place = pafs.FileSystem.from_uri(archive)
                    path, file = archive, files.open_input_file(place)
                value = member(file, at, packed, method, crc)
                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([value], pa.binary())], ["archive", "name", "value"])

    ordered = members.select([c.split()[0] for c in MEMBERS.split(", ")]).repartitionByRange("archive", "at").sortWithinPartitions("archive", "at")
    return ordered.mapInArrow(read, "archive string, name string, value binary")


def papers_by_key(spark: SparkSession, keys: DataFrame, folder: str | None, archives: list[str]) -> DataFrame:
    """title_key, value (JSON text) of the papers that keys (title_key) names: a file of that name in the folder, else a member of an archive.

    Of several archives the first that has the name counts. Keys that are in neither give no row.
    """
    keys = keys.select("title_key").filter("title_key <> ''").distinct()
    found = spark.createDataFrame([], "title_key string, value string")
    if folder:
        files = spark.read.format("binaryFile").load(folder)
        name = F.url_decode(F.element_at(F.split("path", "/"), -1))
        found = files.select(name.alias("title_key"), F.decode("content", "UTF-8").alias("value")).join(keys, "title_key", "left_semi")
    if archives:
        order = F.array_position(F.array(*[F.lit(p if "://" in p else f"file://{p}") for p in archives]), F.col("archive"))
        left = keys.join(found.select("title_key"), "title_key", "left_anti")
        wanted = directory(spark, archives).join(left, F.col("name") == F.col("title_key"), "left_semi")
        first = wanted.groupBy("name").agg(F.min_by(F.struct(*wanted.columns), order * F.lit(1 << 40) - F.col("at")).alias("m")).select("m.*")
        found = found.unionByName(contents(first).select(F.col("name").alias("title_key"), F.decode("value", "UTF-8").alias("value")))
    return found
