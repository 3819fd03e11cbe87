"""Role-tagged sources and budgeted ingestion of their clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.constants import AUDIO_SUFFIXES, SOURCE_ROLES
from earshot.functions import scalars
from earshot.operators.positions import prefix_sum


def parse_sources(entries: DataFrame) -> DataFrame:
    """Add ``role`` and ``source`` to rows with an ``entry`` of the form role=SOURCE.

    An entry without a known role is an ``env`` source, taken whole.
    """
    cut = F.instr("entry", "=")
    prefix = F.substring_index("entry", "=", 1)
    tagged = (cut > 0) & prefix.isin(SOURCE_ROLES)
    return entries.withColumns({
        "role": F.when(tagged, prefix).otherwise(F.lit("env")),
        "source": F.when(tagged, F.substring(F.col("entry"), cut + 1, F.length("entry")))
        .otherwise(F.col("entry")),
    })


def label_allows(role: Column, tags: Column) -> Column:
    """Whether a clip's tags suit the role; clips without tags suit any role."""
    text = F.lower(F.array_join(tags, " "))
    music, speech = text.contains("music"), text.contains("speech")
    fits = (
        F.when(role == "music", music)
        .when(role == "env", ~music & ~speech)
        .when(role == "speech", speech)
        .otherwise(F.lit(True))
    )
    return F.coalesce(fits, F.lit(True))


def read_audio_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet shards of ``audio`` structs; ``human_labels`` is NULL where absent."""
    rows = spark.read.parquet(path)
    labels = (
        F.col("human_labels") if "human_labels" in rows.columns
        else F.lit(None).cast("array<string>")
    )
    return rows.select(
        F.col("audio.path").alias("path"), F.col("audio.bytes").alias("content"),
        labels.alias("human_labels"),
    )


def with_labels(rows: DataFrame, column: str = "human_labels") -> DataFrame:
    """Give rows of a source without tags a NULL tag column."""
    if column in rows.columns:
        return rows
    return rows.withColumn(column, F.lit(None).cast("array<string>"))


def scan_audio_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, length) of audio files under ``root``, by suffix in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(scalars.path_suffix("path").isin(AUDIO_SUFFIXES)).select(
        "path", "content", "length"
    )


def scan_archives(spark: SparkSession, root: str) -> DataFrame:
    """(archive, path, content) of the audio members of zip and tar files under ``root``.

    Members of zip and plain tar files are listed first and then read one by one
    by many tasks, so one large archive is not one task. Compressed tar files can
    only be read from the start and stay whole. ``root`` is on mounted storage.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        .select(F.regexp_replace("path", "^file:/*", "/").alias("archive"))
    )
    suffix = scalars.path_suffix("archive")
    listed = files.where(suffix.isin("zip", "tar")).mapInPandas(
        _list_members, "archive string, path string, at bigint, size bigint"
    )
    out = "archive string, path string, content binary"
    seekable = listed.repartition("archive", "path").mapInPandas(_read_members, out)
    name = F.lower("archive")
    packed = files.where(name.rlike(_COMPRESSED)).mapInPandas(_unpack, out)
    return seekable.unionByName(packed)


#: Compressed tar files; a plain .gz of a single file is none.
_COMPRESSED = r"\.(tgz|tbz2|txz|tar\.gz|tar\.bz2|tar\.xz)$"


def _is_audio(name: str) -> bool:
    return "." in name and name.rsplit(".", 1)[-1].lower() in AUDIO_SUFFIXES


def _list_members(batches):
    import tarfile
    import zipfile

    import pandas as pd

    for batch in batches:
        for path in batch["archive"]:
            if path.lower().endswith(".zip"):
                with zipfile.ZipFile(path) as archive:
                    found = [(i.filename, i.header_offset, i.file_size)
                             for i in archive.infolist() if not i.is_dir()]
            else:
                with tarfile.open(path) as archive:
                    found = [(m.name, m.offset_data, m.size) for m in archive if m.isfile()]
            rows = [(path, *row) for row in found if _is_audio(row[0])]
            yield pd.DataFrame(rows, columns=["archive", "path", "at", "size"])


def _read_members(batches):
    import zipfile

    import pandas as pd

    for batch in batches:
        for archive, members in batch.groupby("archive"):
            if archive.lower().endswith(".zip"):
                with zipfile.ZipFile(archive) as opened:
                    for name in members["path"]:
                        yield pd.DataFrame(
                            {"archive": [archive], "path": [name], "content": [opened.read(name)]})
            else:
                with open(archive, "rb") as opened:
                    for name, at, size in zip(members["path"], members["at"], members["size"]):
                        opened.seek(at)
                        yield pd.DataFrame(
                            {"archive": [archive], "path": [name], "content": [opened.read(size)]})


def _unpack(batches):
    import tarfile

    import pandas as pd

    for batch in batches:
        for path in batch["archive"]:
            with tarfile.open(path, mode="r|*") as archive:
                for member in archive:
                    if member.isfile() and _is_audio(member.name):
                        yield pd.DataFrame({
                            "archive": [path], "path": [member.name],
                            "content": [archive.extractfile(member).read()]})


def budget_cap(hours: float, rate: int) -> int:
    """Samples a role may ingest: the hours asked for, a quarter more and two minutes."""
    return int((hours * 3600 * 1.25 + 120) * rate)


def budgeted_ingest(
    clips: DataFrame, order: list[str], cap: int, rows_per_task: int | None = None
) -> DataFrame:
    """Rows met before each role's budget runs out, with ``before``, ``kept``, ``stored``.

    ``clips`` has ``role, stem, n_samples, allowed`` (n_samples NULL when it cannot
    be decoded) and a unique ``order`` within the role. A row is met while the total
    before it is below ``cap``, so the row that crosses is kept. A stem that was
    already stored is neither decoded nor written again, and the stored clip's length
    counts again for every allowed row after it, readable or not.
    """
    usable = F.col("allowed") & F.col("n_samples").isNotNull()
    place = F.struct(*order)
    first = F.struct(*[F.col(f"first.{c}").alias(c) for c in order])
    firsts = clips.where(usable).groupBy("role", "stem").agg(
        F.min(F.struct(*order, "n_samples")).alias("first")
    )
    counted = F.when(F.col("allowed") & (place >= first), F.col("first.n_samples")).otherwise(0)
    is_first = usable & (place == first)
    scan = clips.join(firsts, ["role", "stem"], "left").select(
        *clips.columns, counted.cast("long").alias("counted"),
        F.coalesce(is_first, F.lit(False)).alias("stored"),
    )
    extra = {} if rows_per_task is None else {"rows_per_task": rows_per_task}
    scan = prefix_sum(scan, ["role"], order, "counted", "before", **extra)
    return scan.where(F.col("before") < cap).withColumn("kept", F.col("allowed"))


def storage_keys(rows: DataFrame, shard: str = "shard", number: str = "n", path: str = "path") -> DataFrame:
    """Add ``stem``: the file name without folder and suffix, or shard_number for rows
    without a path."""
    own = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    return rows.withColumn(
        "stem", F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.concat_ws("_", shard, number))
    )


def ingest_report(met: DataFrame, rate: int) -> DataFrame:
    """Hours added, rows kept and rows dropped by label, per role."""
    return met.groupBy("role").agg(
        F.sum("counted").alias("samples"),
        F.round(F.sum("counted") / rate / 3600, 2).alias("hours"),
        F.count_if("kept").alias("rows_kept"),
        F.count_if(~F.col("kept")).alias("dropped_by_label"),
    )


def require_audio(report: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Fail the job when a role has ingested nothing, also when it had no rows at all.

    ``roles`` lists the roles that were asked for; without it only those in the report
    can be checked. The test is on samples, not on rounded hours.
    """
    if roles is not None:
        report = roles.select("role").distinct().join(report, "role", "left")
    check = F.assert_true(
        F.coalesce("samples", F.lit(0)) > 0, F.concat(F.lit("no audio ingested for role "), F.col("role"))
    )
    return report.where(check.isNull())
