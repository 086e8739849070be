"""The search index: a folder of Parquet segments and a manifest that is swapped whole.

Every append writes its segments (chunks, postings, lengths) under new names and then one new manifest, so readers see all of it or
nothing. A delete adds a tombstone segment; rows older than it are gone. There is one writer at a time. Paths go through Hadoop's file
system, so a shared or object store works as a local folder does.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.regex import is_blank
from foliospark.operators import retrieval
from foliospark.operators.upsert import one_per_key
from foliospark.schema import FILES, INDEX
from foliospark.session import materialise


@dataclass(frozen=True)
class Result:
    """What an operation on the index did."""

    success: bool
    message: str
    rows: int = 0
    rejected: int = 0


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- files --

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(f"{self.path}/manifest.json")
        return fs.exists(p)

    def manifest(self) -> dict:
        fs, p = self._fs(f"{self.path}/manifest.json")
        if not fs.exists(p):
            raise FileNotFoundError(f"no index at {self.path}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        fs, new = self._fs(f"{self.path}/manifest-{uuid.uuid4().hex}.json")
        out = fs.create(new)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/manifest.json")
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration()) if new.toUri().getScheme() else self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.spark._jsc.hadoopConfiguration())
        array = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        context.rename(new, final, array)

    # -- life --

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int = 768) -> Index:
        """The index at the path, made if it isn't there; an index of another dimension is an error."""
        if isinstance(dimension, bool) or not isinstance(dimension, int) or dimension <= 0:
            raise ValueError("dimension must be a positive integer")
        index = cls(spark, path)
        if index.exists():
            there = index.manifest()["dimension"]
            if there != dimension:
                raise ValueError(f"the index has dimension {there}")
        else:
            fs, p = index._fs(index.path)
            fs.mkdirs(p)
            index._publish({"dimension": dimension, "seq": 0, "segments": [], "tombstones": []})
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        index = cls(spark, path)
        index.manifest()
        return index

    # -- reading --

    def _read(self, part: str, schema: str | None = None) -> DataFrame | None:
        m = self.manifest()
        paths = [f"{self.path}/{s}/{part}" for s in m["segments"]]
        return self.spark.read.parquet(*paths) if paths else None

    def _alive(self, df: DataFrame) -> DataFrame:
        tombs = self.manifest()["tombstones"]
        if not tombs:
            return df.drop("seq", "filename_key")
        dead = self.spark.read.parquet(*[f"{self.path}/{t}" for t in tombs]).groupBy("filename_key").agg(F.max("dead_seq").alias("dead_seq"))
        joined = df.join(dead, "filename_key", "left").filter(F.col("dead_seq").isNull() | (F.col("seq") > F.col("dead_seq")))
        return joined.drop("seq", "filename_key", "dead_seq")

    def chunks(self) -> DataFrame:
        """The rows of the index."""
        df = self._read("chunks")
        return self.spark.createDataFrame([], INDEX) if df is None else self._alive(df)

    def files(self) -> DataFrame:
        """file_hash, filename of every file that has rows."""
        df = self._read("files")
        return self.spark.createDataFrame([], FILES).select("file_hash", "filename") if df is None else self._alive(df)

    def postings(self) -> DataFrame:
        df = self._read("postings")
        return self.spark.createDataFrame([], "term string, id string, tf bigint") if df is None else self._alive(df)

    def lengths(self) -> DataFrame:
        df = self._read("lengths")
        return self.spark.createDataFrame([], "id string, dl bigint") if df is None else self._alive(df)

    def has_file(self, file_hash: str) -> bool:
        """Whether a file of this hash is indexed; reads one column and stops at the first row."""
        return bool(self.files().filter(F.col("file_hash") == file_hash).limit(1).count())

    def has_filename(self, filename: str) -> bool:
        return bool(self.files().filter(F.col("filename") == filename).limit(1).count())

    # -- writing --

    def append(self, rows: DataFrame, on_conflict: str = "reject") -> Result:
        """Adds rows of the index schema. Files whose hash or name is known are rejected, or by "replace" take the old one's place.

        Several files of one name or hash within the rows are one file if both agree; else all but the first hash of a name go. Of several
        rows with one id the least by content, page and vector stays. The rows are evaluated once.
        """
        m = self.manifest()
        key = F.col("metadata.filename").alias("filename_key")
        rows = materialise(rows.select(*[F.col(f.name).cast(f.dataType) for f in INDEX.fields]), "rows")
        bad = rows.filter(F.col("embedding").isNotNull() & (F.size("embedding") != m["dimension"])).limit(1).count()
        if bad:
            return Result(False, f"an embedding has not {m['dimension']} numbers")
        files = rows.select(F.col("document_id").alias("file_hash"), F.col("metadata.filename").alias("filename")).filter(F.col("file_hash").isNotNull()).distinct()
        one_name = files.groupBy("filename").agg(F.min("file_hash").alias("file_hash"))
        known = self.files()
        if on_conflict == "replace":
            fresh = one_name.join(known.select("file_hash"), "file_hash", "left_anti") if known.limit(1).count() else one_name
            clash = fresh.join(known.select("filename").distinct(), "filename", "left_semi")
        else:
            fresh, clash = one_name.join(known.select("file_hash").distinct(), "file_hash", "left_anti").join(known.select("filename").distinct(), "filename", "left_anti"), None
        segment = f"segment-{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.path}/{segment}"
        seq = F.lit(m["seq"] + 1).alias("seq")
        fresh.select("file_hash", "filename", F.col("filename").alias("filename_key"), seq).write.parquet(f"{base}/files")
        kept = self.spark.read.parquet(f"{base}/files")
        total, accepted = files.count(), kept.count()
        if not accepted:
            return Result(False, "nothing to index" if not total else "duplicate file or filename", 0, total)
        chosen = rows.join(kept.select(F.col("file_hash").alias("document_id"), F.col("filename").alias("_name")), "document_id", "left_semi")
        chosen = one_per_key(chosen, "id", ("content", "page_number", "chunk_id", "embedding"))
        chosen.select("*", key, seq).write.parquet(f"{base}/chunks")
        stored = self.spark.read.parquet(f"{base}/chunks")
        text = stored.filter(~is_blank(F.col("content")))
        names = stored.select("id", "filename_key")
        posted = retrieval.postings(text).join(names, "id").select("term", "id", "tf", "filename_key", seq)
        posted.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/postings")  # so that a term's row groups are few
        retrieval.lengths(stored).join(names, "id").select("id", "dl", "filename_key", seq).write.parquet(f"{base}/lengths")
        tombs = list(m["tombstones"])
        if clash is not None and clash.limit(1).count():
            tombs.append(self._bury(clash, m["seq"]))
        self._publish(m | {"seq": m["seq"] + 1, "segments": [*m["segments"], segment], "tombstones": tombs})
        return Result(True, "indexed", stored.count(), total - accepted)

    def _bury(self, names: DataFrame, seq: int) -> str:
        tomb = f"tombstones-{seq:08d}-{uuid.uuid4().hex[:8]}"
        names.select(F.col("filename").alias("filename_key"), F.lit(seq).alias("dead_seq")).distinct().write.parquet(f"{self.path}/{tomb}")
        return tomb

    def delete_by_filename(self, filename: str) -> Result:
        """Takes a file's rows out of the index; a later append of the same name counts as new."""
        m = self.manifest()
        gone = self.chunks().filter(F.col("metadata.filename") == filename).count()
        if not gone:
            return Result(False, "no such file")
        tomb = self._bury(self.spark.createDataFrame([(filename,)], "filename string"), m["seq"])
        self._publish(m | {"seq": m["seq"] + 1, "tombstones": [*m["tombstones"], tomb]})
        return Result(True, "deleted", gone)

    def compact(self) -> Result:
        """Writes the living rows as one segment; older segments stay for readers that still use them."""
        m = self.manifest()
        segment = f"segment-{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        base, seq = f"{self.path}/{segment}", F.lit(m["seq"] + 1).alias("seq")
        rows = self.chunks().select("*", F.col("metadata.filename").alias("filename_key"), seq)
        names = rows.select("id", "filename_key")
        rows.write.parquet(f"{base}/chunks")
        self.files().select("file_hash", "filename", F.col("filename").alias("filename_key"), seq).write.parquet(f"{base}/files")
        self.postings().join(names, "id").select("term", "id", "tf", "filename_key", seq).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{base}/postings")
        self.lengths().join(names, "id").select("id", "dl", "filename_key", seq).write.parquet(f"{base}/lengths")
        self._publish(m | {"seq": m["seq"] + 1, "segments": [segment], "tombstones": []})
        return Result(True, "compacted", self.chunks().count())
