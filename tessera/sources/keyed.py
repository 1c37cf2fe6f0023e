"""Tables of one row a key, in buckets: a change rewrites the buckets it touches and no other, once for each epoch.

A table is partitioned by a bucket, the hash of its key. A batch of changes is merged with the rows of the buckets that
it touches, written to a table of its own beside the first (the stage), and from there over the buckets, by dynamic
partition overwrite. A stage that is complete says so, and is finished before anything else is done, so that a writer
that dies leaves either the old rows or enough to make the new ones. The last epoch of each stream of batches is a
property of the table (the ledger): a batch that comes again changes nothing.

One writer at a time for each table, as a streaming query is. Readers that began before an overwrite may have to read
again, as with any overwrite of files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET = "bucket"
#: Buckets of a new table. A bucket is what the smallest change rewrites, so take more for larger tables.
BUCKETS = 64


class Keyed:
    """The table ``database.name`` with a row for each value of ``key``."""

    def __init__(self, spark: SparkSession, database: str, name: str, key: Sequence[str], by: Sequence[str] | None = None):
        """``by``: the columns of the key that decide on the bucket; all by default."""
        self.spark, self.database, self.plain, self.key, self.by = spark, database, name, list(key), list(by or key)
        self.name, self.stage = f"`{database}`.`{name}`", f"`{database}`.`{name}__stage`"

    def using(self, spark: SparkSession) -> Keyed:
        """The same table in another session, such as that of a micro-batch."""
        return Keyed(spark, self.database, self.plain, self.key, self.by)

    # ---- the table as a whole

    def create(self, columns: str, buckets: int = BUCKETS, **properties: str) -> None:
        listed = ", ".join(f"'{k}' = '{v}'" for k, v in (properties | {"buckets": str(int(buckets))}).items())
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET}) TBLPROPERTIES ({listed})")

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def drop(self) -> None:
        for name in (self.name, self.stage):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def properties(self, name: str | None = None) -> dict[str, str]:
        return {r.key: r.value for r in self.spark.sql(f"SHOW TBLPROPERTIES {name or self.name}").collect()}

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.table(self.name).drop(BUCKET)

    def bucket(self, properties: dict[str, str] | None = None) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(int((properties or self.properties())["buckets"]))).cast("int")

    def clear(self) -> None:
        self._settle(None)
        self.spark.sql(f"TRUNCATE TABLE {self.name}")

    def replace(self, rows: DataFrame) -> None:
        """All rows anew. What stands in the way of half a table is the stage, as with ``apply``."""
        self.recover()
        self._write_stage(self._arranged(rows), None, None)
        self.recover()

    # ---- changes

    def epoch(self, stream: str) -> int:
        """The last epoch of a stream of batches that the table holds; -1 before the first."""
        self.recover()
        return int(self.properties().get(f"epoch.{stream}", -1))

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, order: str | None = None, stream: str | None = None, epoch: int | None = None) -> bool:
        """Deletes, then upserts; of several rows of a key that of the largest ``order`` (any, without one). Whether it was done: an epoch that the ledger holds is not done again.

        The new rows are read twice (for the buckets, and to be merged): persist what is dear to make.
        """
        self.recover()
        properties = self.properties()
        if epoch is not None and epoch <= int(properties.get(f"epoch.{stream}", -1)):
            return False
        now = self.spark.table(self.name)
        columns, bucket = [c for c in now.columns if c != BUCKET], self.bucket(properties)
        sides = []
        if upserts is not None:
            upserts = upserts.select(*[F.col(f"`{c}`") if c in upserts.columns else F.lit(None).cast(now.schema[c].dataType).alias(c) for c in columns])
            last = W.partitionBy(*self.key).orderBy(F.desc_nulls_last(order) if order else F.lit(0))
            upserts = upserts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n").withColumn(BUCKET, bucket)
            sides.append(upserts.select(*self.key, BUCKET))
        if deletes is not None:
            sides.append(deletes.select(*self.key).withColumn(BUCKET, bucket))
        if sides:
            changed = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
            # At most as many as the table has buckets; with them as literals the scan leaves out the other partitions.
            touched = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
            kept = now.where(F.col(BUCKET).isin(touched)).join(changed.distinct(), [*self.key, BUCKET], "left_anti").select(*columns, BUCKET)
            self._write_stage(kept if upserts is None else kept.unionByName(upserts.select(*columns, BUCKET)), touched, {} if epoch is None else {f"epoch.{stream}": str(epoch)})
            self.recover()
        elif epoch is not None:
            self._set(self.name, {f"epoch.{stream}": str(epoch)})
        return True

    # ---- the stage

    def _arranged(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in self.spark.table(self.name).columns if c != BUCKET]
        return rows.select(*columns).withColumn(BUCKET, self.bucket())

    def _set(self, name: str, properties: dict[str, str]) -> None:
        if properties:
            self.spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{chr(39)}{k}{chr(39)} = {chr(39)}{v}{chr(39)}' for k, v in properties.items())})")

    def _write_stage(self, rows: DataFrame, touched: list[int] | None, ledger: dict[str, str] | None) -> None:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != BUCKET)
        self.spark.sql(f"CREATE TABLE {self.stage} ({columns}, {BUCKET} INT) USING parquet PARTITIONED BY ({BUCKET})")
        # A file a bucket, or several where a bucket is large.
        rows.hint("rebalance", BUCKET).write.insertInto(self.stage)
        said = {"touched": "all" if touched is None else ",".join(map(str, touched)), "complete": "yes"}
        self._set(self.stage, said | (ledger or {}))

    def recover(self) -> None:
        """Finishes what a complete stage holds, and drops a stage that is not complete."""
        if self.spark.catalog.tableExists(self.stage):
            self._settle(self.properties(self.stage))

    def _settle(self, said: dict[str, str] | None) -> None:
        if said and said.get("complete") == "yes":
            stage = self.spark.table(self.stage)
            old = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
            try:
                stage.hint("rebalance", BUCKET).write.mode("overwrite").insertInto(self.name)
            finally:
                self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)
            held = {int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.stage}").collect()}
            there = {int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}
            touched = there if said["touched"] == "all" else {int(b) for b in said["touched"].split(",") if b}
            empty = sorted((touched & there) - held)
            if empty:  # nothing is left in these, so nothing has overwritten them
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {', '.join(f'PARTITION ({BUCKET} = {b})' for b in empty)}")
            self._set(self.name, {k: v for k, v in said.items() if k.startswith("epoch.")})
        self.spark.sql(f"DROP TABLE IF EXISTS {self.stage}")
