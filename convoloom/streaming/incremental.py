"""Incremental sessions: touched sessions are made anew as a whole and replaced only where their content changed.

Sessions are spread over a fixed number of parts by a hash of their id. A batch writes the parts it touches and no
others; a version is a small table that says of each part which write holds it, and it counts once its mark is there,
the last thing to be written. A store that is opened again goes on from the last version that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.operators.snapshots import replacements, session_fingerprints

ROWS = "session_id string, msg_id bigint, role string, content string"


class SessionStore:
    """Sessions below a folder that all executors share. parts must stay what it was when the store was made."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 64):
        self.spark, self.folder, self.parts = spark, folder.rstrip("/"), parts
        self.version, self.holds = self._last()

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _last(self) -> tuple[int, dict[int, int]]:
        """The last version that counts, and of each part (as many as parts says) the write that holds it."""
        fs, p = self._fs(f"{self.folder}/versions")
        done = [int(f.getPath().getName()) for f in fs.listStatus(p) if fs.exists(self._fs(f"{f.getPath()}/_SUCCESS")[1])] if fs.exists(p) else []
        if not done:
            return 0, {}
        got = self.spark.read.schema("part int, held_by int").parquet(f"{self.folder}/versions/{max(done)}").collect()
        return max(done), {r["part"]: r["held_by"] for r in got}

    def _part(self, key: str = "session_id"):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def rows(self, parts: list[int] | None = None) -> DataFrame | None:
        """All rows as of the last version, or those of some parts."""
        wanted = [f"{self.folder}/rows/v={v}/part={k}" for k, v in self.holds.items() if parts is None or k in parts]
        return self.spark.read.schema(ROWS).parquet(*wanted) if wanted else None

    def upsert(self, batch: DataFrame) -> dict:
        """Takes message rows (session_id, msg_id, role, content). A session's new state is its old rows with the batch's laid over by msg_id. Gives the number of sessions written; an equal batch writes none and leaves the version."""
        fresh = batch.select("session_id", "msg_id", "role", "content").where("session_id is not null").dropDuplicates(["session_id", "msg_id"])
        touched = [r["part"] for r in fresh.select(self._part().alias("part")).distinct().collect()]
        old = self.rows(touched)
        if old is None:
            new, changed = fresh, session_fingerprints(fresh)
        else:
            new = old.join(fresh.select("session_id", "msg_id"), ["session_id", "msg_id"], "left_anti").unionByName(fresh)
            changed = replacements(session_fingerprints(old), session_fingerprints(new), "session_id", "fingerprint")
        changed = changed.select("session_id", self._part().alias("part")).groupBy("part").count().collect()
        if not changed:
            return {"written": 0, "version": self.version}
        version = self.version + 1
        written = {r["part"] for r in changed}
        # what an earlier try of this version left is overwritten
        new.withColumn("part", self._part()).where(F.col("part").isin(*written)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/rows/v={version}")
        holds = self.holds | dict.fromkeys(written, version)
        self.spark.createDataFrame(sorted(holds.items()), "part int, held_by int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{version}")
        self.version, self.holds = version, holds
        return {"written": sum(r["count"] for r in changed), "version": version}

    def run(self, stream: DataFrame) -> list[dict]:
        """Upserts every micro-batch of a stream of message rows, all that is available."""
        log: list[dict] = []
        query = stream.writeStream.foreachBatch(lambda df, _: log.append(self.upsert(df))).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return log


def current_sessions(store: SessionStore) -> DataFrame:
    return store.rows().groupBy("session_id").agg(F.count("*").alias("n_messages"))
