"""Changes of a stream, kept so that the state can be read as of any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.operators.state import snapshot_at
from relflow.sinks.writers import LatestStateTable


class ChangeHistory(LatestStateTable):
    """All changes per key with their times, one version for each micro-batch.

    Every ``base_every`` batches the state as of the newest time so far is written as
    a base. A read as of time ``t`` takes the newest base that is not after ``t`` and
    the versions written since that base, so it reads a state and a bounded number of
    batches, not the whole history. A late change, older than a base, stands in a version
    written after that base: reads from an older base or before it meet it by its time,
    later reads by its order among the key's changes. All versions and bases stay:
    any past time can be read. A batch id that is committed is not written again.
    """

    def __init__(self, spark: SparkSession, path: str, value: str = "raw_score", keys=("actor1", "actor2"), order=(),
                 ts_col: str = "ts", base_every: int = 16):
        super().__init__(spark, path, keys, (ts_col, *order))
        self.value, self.ts_col, self.base_every = value, ts_col, base_every

    def append(self, changes: DataFrame, batch_id: int) -> None:
        """The changes of one micro-batch; a row needs the keys, the time, the order
        columns and the value."""
        p = self._read_pointer() or {"batch_id": None, "versions": [], "bases": []}
        if p["batch_id"] is not None and batch_id <= p["batch_id"]:
            return
        folder = f"{self.path}/v={batch_id}"
        changes.select(*self.keys, *self.order, self.value).write.mode("overwrite").parquet(folder)
        lo, hi = self.spark.read.parquet(folder).agg(F.min(self.ts_col), F.max(self.ts_col)).first()
        versions = p["versions"] + ([{"batch": int(batch_id), "lo": lo, "hi": hi}] if lo is not None else [])
        p = {"batch_id": int(batch_id), "versions": versions, "bases": p["bases"]}
        since = [v for v in versions if not p["bases"] or v["batch"] > p["bases"][-1]["batch"]]
        if len(since) >= self.base_every:
            top = max(v["hi"] for v in versions)
            base = p["bases"][-1] if p["bases"] else None
            last = self._rows(base, since).groupBy(*self.keys).agg(F.max_by(F.struct("*"), F.struct(*self.order)).alias("r")).select("r.*")
            last.write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
            p["bases"] = p["bases"] + [{"batch": int(batch_id), "ts": top}]
        self._write_pointer(p)

    def _rows(self, base: dict | None, versions: list[dict]) -> DataFrame | None:
        folders = ([f"{self.path}/base={base['batch']}"] if base else []) + [f"{self.path}/v={v['batch']}" for v in versions]
        return self.spark.read.parquet(*folders) if folders else None

    def as_of(self, requests: DataFrame, request_col: str = "request_ts") -> DataFrame:
        """``(request_ts (ms), keys, value)``: for each request time each key's last
        change at or before it."""
        p = self._read_pointer() or {"versions": [], "bases": []}
        bases = sorted(p["bases"], key=lambda b: (b["ts"], b["batch"]))
        reqs = requests.select(F.unix_millis(F.col(request_col).cast("timestamp")).alias("r")).where("r IS NOT NULL").distinct()
        starts = [b["ts"] for b in bases]
        # the base of a request: its number among the bases' times
        number = F.size(F.filter(F.array(*[F.lit(t).cast("long") for t in starts]), lambda t: t <= F.col("r"))) if starts else F.lit(0)
        reqs = reqs.select(F.timestamp_millis("r").alias("request_ts"), number.alias("base"), "r").checkpoint()
        out = None
        for row in reqs.groupBy("base").agg(F.max("r").alias("r")).collect():       # at most one row a base
            base = bases[row["base"] - 1] if row["base"] else None
            since = [v for v in p["versions"] if (base is None or v["batch"] > base["batch"]) and v["lo"] <= row["r"]]
            rows = self._rows(base, since)
            if rows is None:
                continue
            part = snapshot_at(reqs.where(F.col("base") == row["base"]), rows.where(F.col(self.ts_col) <= row["r"]), self.value, ts_col=self.ts_col,
                               keys=self.keys, order=[o for o in self.order if o != self.ts_col])
            out = part if out is None else out.unionByName(part)
        if out is not None:
            return out
        empty = ", ".join(["request_ts long", *(f"{k} string" for k in self.keys), f"{self.value} double"])
        return self.spark.createDataFrame([], empty)

    def times(self) -> tuple[int | None, int | None]:
        """Earliest and latest time of the changes."""
        versions = (self._read_pointer() or {"versions": []})["versions"]
        return min((v["lo"] for v in versions), default=None), max((v["hi"] for v in versions), default=None)

    def read(self) -> DataFrame | None:
        """The latest state."""
        p = self._read_pointer()
        if not p or not p["versions"]:
            return None
        base = p["bases"][-1] if p["bases"] else None
        rows = self._rows(base, [v for v in p["versions"] if base is None or v["batch"] > base["batch"]])
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct("*"), F.struct(*self.order)).alias("r")).select("r.*")


