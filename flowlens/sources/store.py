"""The alert store: tables filed by date, files of changes, and an append-only alert log for streams."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.alerts import apply_backfills, last_id
from ..schemas import STORE_SCHEMAS, _struct, LONG, STRING, TIMESTAMP
from ..session import broadcast_if_small

BACKFILL_SCHEMA = _struct(id=LONG, explanation_summary=STRING, updated_at=TIMESTAMP)

# Tables that streams write to, and the folders of their batches.
LOGS = {"alerts": "alert_log", "audit_log": "audit_batches"}
# Column with the time, in milliseconds, by whose date the rows of a table are filed; else it is `created_at`.
FILED_BY = {"alerts": "timestamp", "performance_metrics": "hour_timestamp"}
DAY_MS = 86_400_000


def day_of(ms) -> Column:
    """UTC date of a time in milliseconds as text; `none` without one."""
    return F.coalesce(F.date_from_unix_date(F.floor(ms / F.lit(float(DAY_MS))).cast("int")).cast("string"), F.lit("none"))


def _filed(name: str) -> Column:
    return day_of(F.col(FILED_BY[name]) if name in FILED_BY else F.unix_millis("created_at"))


class AlertStore:
    """Parquet tables under one shared folder, filed by date, written by one writer at a time.

    The rows of a table lie in `<table>/version=N/day=D`. `<table>_days/version=N` lists the days of snapshot N and the version that
    each was last written in; the newest list that Spark marked complete is current. Changes of rows go to `<table>_changes/change=N`:
    ids and the new values of the changed columns, nothing else. Streams add to `alert_log/batch=N`, `alert_backfills/batch=N` and
    `audit_batches/batch=N`; a batch that is complete is not written again, so a retry changes nothing. Loads put the parts together;
    `compact` folds changes and batches in and writes the days anew that they touch. A snapshot remembers the last batch and change it holds.
    A store belongs to one stream checkpoint, whose batch numbers only rise.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # The last batch and change that a load of each table held.
        self._seen: dict[str, tuple[int, int]] = {}

    def _listed(self, folder: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [status.getPath() for status in fs.listStatus(path)] if fs.exists(path) else []

    def _numbered(self, folder: str, prefix: str) -> list[int]:
        names = [p for p in self._listed(folder) if p.getName().startswith(f"{prefix}=")]
        fs = names[0].getFileSystem(self.spark._jsc.hadoopConfiguration()) if names else None
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def days(self, name: str) -> dict[str, int]:
        """Day → version of the snapshot's folder; one entry per date."""
        versions = self._numbered(f"{name}_days", "version")
        if not versions:
            return {}
        listed = self.spark.read.schema("day string, version int").json(f"{self.root}/{name}_days/version={versions[-1]}")
        return {r["day"]: r["version"] for r in listed.collect()}

    def _snapshot(self, name: str, days=None) -> DataFrame:
        """Rows of the snapshot; with `days`, a test of dates, only of the days that pass it."""
        schema = STORE_SCHEMAS[name]
        paths = [f"{self.root}/{name}/version={v}/day={d}" for d, v in self.days(name).items() if days is None or days(d)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _batches(self, folder: str, schema, after: int, before: int | None) -> DataFrame:
        batches = [b for b in self._numbered(folder, "batch") if b > after and (before is None or b < before)]
        if not batches:
            return self.spark.createDataFrame([], schema)
        # The folder name is the `batch` partition, so the filter prunes folders.
        log = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        return log.filter(F.col("batch").between(batches[0], batches[-1])).drop("batch")

    def _changes(self, name: str, after: int) -> DataFrame:
        """(id, new values) of the rows changed after that change: of each column the newest value that is not null."""
        schema = STORE_SCHEMAS[name]
        numbers = [c for c in self._numbered(f"{name}_changes", "change") if c > after]
        if not numbers:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/{name}_changes").filter(F.col("change").between(numbers[0], numbers[-1]))
        newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change"))).alias(c) for c in schema.fieldNames() if c != "id"]
        return rows.groupBy("id").agg(*newest)

    def _through(self, name: str) -> tuple[int, int]:
        """The last stream batch and the last change that the current snapshot holds."""
        versions = self._numbered(f"{name}_days", "version")
        if not versions:
            return -1, -1
        return tuple(self.spark.read.schema("batch long, change long").json(f"{self.root}/{name}_through/version={versions[-1]}").first())

    def load(self, name: str, before_batch: int | None = None, days=None) -> DataFrame:
        """The current table: the snapshot, the later batches with late explanations filled in, and the later changes.

        With `days`, a test of dates such as `"2024-01-05".__le__`, days of the snapshot that do not pass it are not read.
        """
        batch, change = self._through(name)
        table = self._snapshot(name, days)
        if before_batch is None:
            self._seen[name] = (
                max([batch, *(self._numbered(LOGS[name], "batch") if name in LOGS else [])]), max([change, *self._numbered(f"{name}_changes", "change")]))
        if name in LOGS:
            table = table.unionByName(self._batches(LOGS[name], STORE_SCHEMAS[name], batch, before_batch))
        if name == "alerts":
            backfills = self._batches("alert_backfills", BACKFILL_SCHEMA, batch, before_batch)
            first = backfills.groupBy("id").agg(
                F.min_by(F.struct("explanation_summary", "updated_at"), "updated_at").alias("_f")
            ).select("id", "_f.*")
            table = apply_backfills(table, first)
        if not [c for c in self._numbered(f"{name}_changes", "change") if c > change]:
            return table
        changes = self._changes(name, change)
        given = broadcast_if_small(changes.select("id", *(F.col(c).alias(f"_new_{c}") for c in table.columns if c != "id")))
        return table.join(given, "id", "left").select("id", *(F.coalesce(f"_new_{c}", c).alias(c) for c in table.columns if c != "id"))

    def last_alert_id(self, before_batch: int | None = None) -> int:
        """Largest alert id: the newest later batch that holds rows knows it, else the snapshot."""
        through, _ = self._through("alerts")
        batches = [b for b in self._numbered("alert_log", "batch") if b > through and (before_batch is None or b < before_batch)]
        for batch in reversed(batches):
            newest = last_id(self.spark.read.schema(STORE_SCHEMAS["alerts"]).parquet(f"{self.root}/alert_log/batch={batch}"))
            if newest:
                return newest
        return last_id(self._snapshot("alerts"))

    def _write(self, name: str, rows: DataFrame, through: tuple[int, int], kept: dict[str, int]) -> list[str]:
        """Writes `rows` by day as the next version, then the list of days, those of `kept` as they are; returns the days written."""
        versions = self._numbered(f"{name}_days", "version")
        version = (versions[-1] if versions else 0) + 1
        filed = rows.select(*STORE_SCHEMAS[name].fieldNames(), _filed(name).alias("day"))
        # Few files a day; a day with very many rows is split.
        filed.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/{name}/version={version}")
        written = sorted(p.getName().split("=", 1)[1] for p in self._listed(f"{name}/version={version}") if p.getName().startswith("day="))
        mark = self.spark.createDataFrame([through], "batch long, change long")
        mark.coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}_through/version={version}")
        listed = {**kept, **dict.fromkeys(written, version)}
        days = self.spark.createDataFrame([*listed.items()], "day string, version int")
        days.coalesce(1).write.mode("overwrite").json(f"{self.root}/{name}_days/version={version}")
        return written

    def save(self, name: str, table: DataFrame) -> None:
        """Writes the next snapshot, all days of it; readers switch to it once it is complete.

        A table that streams or changes are written to must come from this store's last `load`: the snapshot then stands for all
        that load saw, and what came later is added to it.
        """
        self._write(name, table, self._seen.get(name, self._through(name)), {})

    def change(self, name: str, changes: DataFrame, now) -> None:
        """Changes rows: `changes` has `id` and the columns to set, one row per id; a null leaves the value, and so does an empty text in an investigation.

        Only the changes are written. Unknown ids do nothing. The date that a row is filed by cannot be changed.
        """
        fields = [c for c in changes.columns if c != "id"]
        filed = FILED_BY.get(name, "created_at")
        unknown = set(fields) - set(STORE_SCHEMAS[name].fieldNames()) | {filed} & set(fields)
        if unknown:
            raise ValueError(f"cannot be changed: {sorted(unknown)}")
        types = {f.name: f.dataType for f in STORE_SCHEMAS[name]}
        value = lambda c: F.nullif(c, F.lit("")) if name == "alert_investigations" and types[c] == STRING else F.col(c)
        rows = changes.select("id", *(value(c).cast(types[c]).alias(c) for c in fields))
        if "updated_at" in types:
            rows = rows.withColumn("updated_at", F.lit(now).cast("timestamp"))
        number = max(self._numbered(f"{name}_changes", "change"), default=-1) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}_changes/change={number}")

    def compact(self, name: str = "alerts") -> list[str]:
        """Folds changes and the stream's batches into the snapshot, so that later loads read fewer files; returns the days written anew.

        Days that no change or batch touches stay as they are, unread but for their ids.
        """
        batch, change = self._through(name)
        ids = self._changes(name, change).select("id")
        touched = []
        if name in LOGS:
            touched.append(self._batches(LOGS[name], STORE_SCHEMAS[name], batch, None).select(_filed(name).alias("day")))
        if name == "alerts":
            ids = ids.unionByName(self._batches("alert_backfills", BACKFILL_SCHEMA, batch, None).select("id"))
        touched.append(self._snapshot(name).join(broadcast_if_small(ids.distinct()), "id", "left_semi").select(_filed(name).alias("day")))
        days = {r[0] for rows in touched for r in rows.distinct().collect()}
        rows = self.load(name, days=days.__contains__)
        if days:
            self._write(name, rows, self._seen[name], self.days(name))
        return sorted(days)

    def append_batch(self, added: DataFrame, backfills: DataFrame, batch: int, audit: DataFrame | None = None) -> None:
        """Writes one stream batch; one that is complete stays as it is, so readers of the log see each row once."""
        if batch in self._numbered("alert_log", "batch"):
            return
        backfills.write.mode("overwrite").parquet(f"{self.root}/alert_backfills/batch={batch}")
        if audit is not None:
            audit.select(STORE_SCHEMAS["audit_log"].fieldNames()).write.mode("overwrite").parquet(f"{self.root}/audit_batches/batch={batch}")
        added.write.mode("overwrite").parquet(f"{self.root}/alert_log/batch={batch}")

    @property
    def log_path(self) -> str:
        return f"{self.root}/alert_log"


def read_jdbc_table(
    spark: SparkSession, url: str, name: str, lower: int, upper: int, partitions: int = 200, **properties,
) -> DataFrame:
    """A store table from a database, read in id ranges by many tasks."""
    return spark.read.jdbc(
        url, name, column="id", lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties=properties,
    ).select(STORE_SCHEMAS[name].fieldNames())
