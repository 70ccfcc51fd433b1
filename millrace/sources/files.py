"""File sources and sinks: JSON lines, JSON arrays, verified artifacts, registered datasets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.session import fresh, remove

MARKER = "_COMMITTED.json"


class SourceError(ValueError):
    """A source that breaks its contract; names no content."""


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, plain or gzip by suffix; the schema is given, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that are one JSON array each."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", "true").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejects as hashes of their lines: a reject shows no content."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", schema + ", __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}).alias("r"), F.sha2("value", 256).alias("raw_sha256"))
    good = parsed.where("r is not null and r.__bad is null").select("r.*").drop("__bad")
    return good, parsed.where("r is null or r.__bad is not null").select("raw_sha256", F.lit("malformed_row").alias("reason"))


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, once no key is there twice or null; else SourceError with the number of such keys."""
    bad = rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).count()
    if bad:
        raise SourceError(f"{bad} keys of {key} are null or repeated")
    return rows


def artifact_digests(spark: SparkSession, path: str) -> DataFrame:
    """``name, size, sha256`` of every file under ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify_artifacts(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Expected files (``name, size, sha256``) that are missing or differ, with the reason."""
    found = artifact_digests(spark, path).select("name", F.col("size").alias("__s"), F.col("sha256").alias("__h"))
    joined = expected.join(found, "name", "left")
    reason = F.when(F.col("__h").isNull(), "missing").when(F.col("__s") != F.col("size"), "size_mismatch").when(F.col("__h") != F.col("sha256"), "digest_mismatch")
    return joined.select("name", reason.alias("reason")).where("reason is not null")


def tree_digest(spark: SparkSession, path: str) -> str:
    """A digest of all files' names, sizes and contents: a sum over hashes, which needs no list of files in one place."""
    line = F.concat_ws("\0", "name", F.col("size").cast("string"), "sha256")
    part = F.conv(F.substring(F.sha2(line, 256), 1, 14), 16, 10).cast("decimal(38,0)")
    n, total = artifact_digests(spark, path).agg(F.count("*"), F.sum(part)).first()
    return f"{n:x}-{int(total or 0):x}"


def write_jsonl(rows: DataFrame, path: str, order: list[str] = (), compression: str = "none") -> None:
    """Canonical lines: fields by name, nulls kept; sorted within files if ``order`` is given."""
    fields = [F.col(c) for c in sorted(rows.columns)]
    lines = rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"), *order)
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("value").write.option("compression", compression).text(path)


def register(rows: DataFrame, path: str, partition: str = "split", version: str = "1") -> str:
    """Writes a dataset to a staging folder, then a marker, then renames it into place.

    Registering equal content again changes nothing; other content under the same path
    fails. Returns the content's digest, a sum over row hashes that order can't change.
    """
    spark = rows.sparkSession
    digest = content_digest(rows)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = fs_path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        if marker(spark, path).get("digest") != digest:
            raise SourceError("another dataset is registered there")
        return digest
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        rows.write.partitionBy(partition).parquet(f"{staging}/data")
        spark.createDataFrame([(digest, version, rows.count())], "digest string, version string, n_rows long").coalesce(1).write.json(f"{staging}/{MARKER}")
        if not fs.rename(fs_path(staging), target):
            raise SourceError("the dataset can't be moved into place")
    finally:
        if fs.exists(fs_path(staging)):
            remove(spark, staging)
    return digest


def content_digest(rows: DataFrame) -> str:
    text = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    part = F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("decimal(38,0)")
    n, s = rows.agg(F.count("*"), F.sum(part)).first()
    return f"{n:x}-{int(s or 0):x}"


def marker(spark: SparkSession, path: str) -> dict:
    return spark.read.schema("digest string, version string, n_rows long").json(f"{path}/{MARKER}").first().asDict()


def open_registered(spark: SparkSession, path: str, schema: StructType | str | None = None, verify: bool = True) -> DataFrame:
    """A registered dataset; its content is checked against the marker unless told not to."""
    found = marker(spark, path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    rows = reader.parquet(f"{path}/data")
    if verify and content_digest(rows) != found["digest"]:
        raise SourceError("the registered content has changed")
    return rows


def run_manifests(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """``run.json`` files anywhere below ``root``, with their place."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "run.json").json(root)
    return rows.select("*", F.col("_metadata.file_path").alias("manifest_path"))


def alias(first: Column, second: Column) -> tuple[Column, Column]:
    """A value that goes by two names, and whether the two disagree; blank texts are no values."""
    one, two = (F.when(F.trim(c) != "", c) for c in (first, second))
    return F.coalesce(one, two), F.coalesce(one != two, F.lit(False))


def benchmark_evidence(rows: DataFrame, key: list[str], run: str = "run_id", status: str = "status") -> DataFrame:
    """Rows that passed, once no key and no run is there twice among them; else SourceError with the number of such."""
    good = rows.where(F.col(status) == "pass")
    for columns in (key, [run]):
        if twice := good.groupBy(*columns).count().where("count > 1").count():
            raise SourceError(f"{twice} values of {', '.join(columns)} have several results")
    return good


def read_evidence(spark: SparkSession, root: str, schema: StructType | str, key: list[str], name: str = "summary.json") -> DataFrame:
    """Results in files of one name anywhere below ``root``."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)
    return benchmark_evidence(rows, key)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds events to a log of JSON lines; what is there stays, and a failed append leaves nothing."""
    rows.select(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def follow(log: DataFrame, key: str, sequence: str, terminal: Column, after: Column | int = 0) -> DataFrame:
    """A log's rows after a cursor, up to each key's first terminal event; one combinable minimum per key."""
    of, last = fresh(log.columns, "of", "last")
    ends = log.groupBy(F.col(key).alias(of)).agg(F.min(F.when(terminal, F.col(sequence))).alias(last))
    joined = log.join(ends, F.col(key).eqNullSafe(F.col(of)))
    return joined.where((F.col(sequence) > after) & F.coalesce(F.col(sequence) <= F.col(last), F.lit(True))).select(*log.columns)


def acquire(spark: SparkSession, origin: str, cache: str, name: str, size: int, sha256: str, offline: bool = False) -> str:
    """The place of a pinned file in the cache: taken from ``origin`` where it isn't there yet, checked, then renamed into place.

    Offline a file that isn't cached is an error; so is one whose size or digest differs,
    which never gets its name.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = fs_path(f"{cache}/{sha256}/{name}")
    fs = target.getFileSystem(conf)

    def check(path: str) -> None:
        expected = spark.createDataFrame([(path.rsplit("/", 1)[-1], size, sha256)], "name string, size long, sha256 string")
        if bad := verify_artifacts(spark, path, expected).first():
            raise SourceError(f"{name}: {bad['reason']}")

    if not fs.exists(target):
        if offline:
            raise SourceError(f"{name} is not cached")
        staging = fs_path(f"{cache}/{sha256}/staging-{uuid.uuid4().hex}")
        source = fs_path(origin)
        spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, fs, staging, False, conf)
        try:
            check(staging.toString())
            if not fs.rename(staging, target) and not fs.exists(target):
                raise SourceError(f"{name} can't be moved into place")
        finally:
            if fs.exists(staging):
                fs.delete(staging, False)
    check(target.toString())
    return target.toString()


def write_shards(rows: DataFrame, path: str, split: str, order: list[str], size: str, limit: int) -> None:
    """A folder per split and shard: rows in order, a new shard where the next row would pass ``limit``."""
    from millrace.operators.sampling import next_fit

    next_fit(rows, split, order, size, limit).withColumnRenamed("bin", "shard").write.partitionBy(split, "shard").parquet(path)


def publish(rows: DataFrame, root: str) -> str:
    """Writes a version of a table, named by its content, and makes it the current one; returns its name."""
    spark, version = rows.sparkSession, content_digest(rows)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, staging = fs_path(f"{root}/versions/{version}"), fs_path(f"{root}/staging-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        rows.write.parquet(staging.toString())
        fs.mkdirs(target.getParent())
        if not fs.rename(staging, target) and not fs.exists(target):
            raise SourceError("the version can't be moved into place")
    point(spark, root, version)
    return version


def pointers(spark: SparkSession, root: str) -> list[str]:
    """Versions that were current, oldest first: one short file each."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
    return [n.split("-", 1)[1] for n in names]


def point(spark: SparkSession, root: str, version: str) -> None:
    """Makes a version current. Pointers are numbered and never overwritten."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path(f"{root}/versions/{version}")):
        raise SourceError("there is no such version")
    number = len(pointers(spark, root))
    fs.create(fs_path(f"{root}/pointers/{number:010d}-{version}"), False).close()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a published table."""
    versions = pointers(spark, root)
    if not versions:
        raise SourceError("nothing is published there")
    return spark.read.parquet(f"{root}/versions/{versions[-1]}")


def rollback(spark: SparkSession, root: str) -> str:
    """Makes the version before the current one current again."""
    versions = pointers(spark, root)
    before = [v for v in versions if v != versions[-1]]
    if not before:
        raise SourceError("there is no earlier version")
    point(spark, root, before[-1])
    return before[-1]
