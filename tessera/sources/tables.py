"""Vector collections and graph spaces as tables, with upserts, deletes and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.keyed import BUCKETS, Keyed


class Collections:
    """Vector collections: a keyed table each in a catalog database, with dimension and metric as properties."""

    COLUMNS = "id STRING, vector ARRAY<FLOAT>, payload MAP<STRING, STRING>, ts TIMESTAMP"

    def __init__(self, spark: SparkSession, database: str = "vectors"):
        self.spark, self.database = spark, database
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def keyed(self, name: str) -> Keyed:
        return Keyed(self.spark, self.database, name, ["id"])

    def create(self, name: str, dim: int, metric: str = "cosine", buckets: int = BUCKETS) -> None:
        self.keyed(name).create(self.COLUMNS, buckets, dim=str(int(dim)), metric=metric)

    def exists(self, name: str) -> bool:
        return self.keyed(name).exists()

    def names(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self.database) if not t.name.endswith("__stage"))

    def drop(self, name: str) -> None:
        self.keyed(name).drop()

    def table(self, name: str) -> DataFrame:
        return self.keyed(name).read()

    def info(self, name: str) -> dict[str, str]:
        props = self.keyed(name).properties()
        return {"name": name, "dim": props.get("dim", ""), "metric": props.get("metric", ""), "points": str(self.table(name).count())}

    def replace(self, name: str, rows: DataFrame) -> None:
        self.keyed(name).replace(rows)

    def recover(self, name: str) -> None:
        """Finishes what a change left unfinished, as every read and change does; a complete copy beside a table that is gone takes its place."""
        for left in (f"{name}__new", f"{name}__old"):
            if not self.exists(name) and self.exists(left):
                self.spark.sql(f"ALTER TABLE {self.keyed(left).name} RENAME TO {self.keyed(name).name}")
        self.keyed(name).recover()

    def clear(self, name: str) -> None:
        self.keyed(name).clear()

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Last write wins for each id."""
        self.keyed(name).apply(rows, order="ts")

    def delete(self, name: str, ids: DataFrame) -> None:
        self.keyed(name).apply(deletes=ids)

    def ids(self, name: str, where: Column) -> DataFrame:
        return self.table(name).where(where).select("id")


class Spaces:
    """Graph spaces: a catalog database each, with a keyed table of vertices and one of edges."""

    VERTICES = "tag STRING, id STRING, properties MAP<STRING, STRING>"
    EDGES = "type STRING, src STRING, dst STRING, properties MAP<STRING, STRING>"

    def __init__(self, spark: SparkSession, prefix: str = "graph_"):
        self.spark, self.prefix = spark, prefix

    def keyed(self, space: str, table: str) -> Keyed:
        """A vertex is known by its id; an edge by type and ends, and it lies in the bucket of its source."""
        key, by = (["id"], ["id"]) if table == "vertices" else (["type", "src", "dst"], ["src"])
        return Keyed(self.spark, f"{self.prefix}{space}", table, key, by)

    def create(self, space: str, buckets: int = BUCKETS) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.prefix}{space}`")
        for table, columns in (("vertices", self.VERTICES), ("edges", self.EDGES)):
            self.keyed(space, table).create(columns, buckets)

    def names(self) -> list[str]:
        return sorted(d.name.removeprefix(self.prefix) for d in self.spark.catalog.listDatabases(f"{self.prefix}*"))

    def drop(self, space: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self.prefix}{space}` CASCADE")

    def clear(self, space: str) -> None:
        for table in ("vertices", "edges"):
            self.keyed(space, table).clear()

    def vertices(self, space: str) -> DataFrame:
        return self.keyed(space, "vertices").read()

    def edges(self, space: str) -> DataFrame:
        return self.keyed(space, "edges").read()

    def size(self, space: str) -> dict[str, int]:
        return {"vertices": self.vertices(space).count(), "edges": self.edges(space).count()}

    def insert(self, space: str, vertices: DataFrame | None = None, edges: DataFrame | None = None) -> None:
        """Vertices and edges that the space has already take the new properties."""
        for table, rows in (("vertices", vertices), ("edges", edges)):
            if rows is not None:
                self.keyed(space, table).apply(rows)


def by_tag(rows: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Rows of several tags, each with columns of its own, as one table of vertices: the properties of all tags' columns, null where a row has none."""
    names = sorted({c for df in rows.values() for c in df.columns if c != key})

    def one(tag: str, df: DataFrame) -> DataFrame:
        value = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
        props = F.create_map(*[x for c in names for x in (F.lit(c), value(c))]) if names else F.create_map().cast("map<string,string>")
        return df.select(F.lit(tag).alias("tag"), F.col(key).cast("string").alias("id"), props.alias("properties"))

    return reduce(lambda a, b: a.unionByName(b), [one(t, df) for t, df in rows.items()])


# ---- graph rows

def graph_of_files(files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of files (project, path, language, imports) and chunks (path, kind, name)."""
    vertex = lambda df, tag, key, **props: df.select(F.lit(tag).alias("tag"), key.alias("id"), F.create_map(*[x for k, v in props.items() for x in (F.lit(k), v.cast("string"))]).alias("properties"))
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), a.alias("src"), b.alias("dst"))
    path, inside = F.col("path"), F.concat_ws("#", "path", "name")
    imports = files.select("path", F.explode("imports").alias("module"))
    vertices = [
        vertex(files, "File", path, language=F.col("language")),
        vertex(chunks.where("kind = 'function'"), "Function", inside, name=F.col("name")),
        vertex(chunks.where("kind = 'class'"), "Class", inside, name=F.col("name")),
        vertex(imports.select("module").distinct(), "Import", F.col("module"), module=F.col("module")),
        vertex(files.select("project").distinct(), "Project", F.col("project"), name=F.col("project")),
    ]
    edges = [edge(files, "BELONGS_TO", path, F.col("project")), edge(chunks, "CONTAINS", path, inside), edge(imports, "IMPORTS", path, F.col("module"))]
    union = lambda xs: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), xs)
    return union(vertices), union(edges).distinct()


def update_properties(vertices: DataFrame, changes: DataFrame) -> DataFrame:
    """Vertices with the properties of ``changes`` (id, properties) written over theirs."""
    c = changes.select("id", F.col("properties").alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter("properties", lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("_new", empty)), k))
    return vertices.join(c, "id", "left").withColumn("properties", F.map_concat(own, F.coalesce("_new", empty))).drop("_new")


def delete_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the vertices and without the edges at either end of them."""
    left = edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti")
    return vertices.join(ids, "id", "left_anti"), left.select(*edges.columns)


# ---- exports

def export(df: DataFrame, path: str, form: str = "json") -> None:
    """JSON lines or CSV with a header; nested columns become JSON in CSV."""
    if form == "json":
        df.write.mode("overwrite").json(path)
    elif form == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode("overwrite").option("header", True).csv(path)
    else:
        raise ValueError(f"no form {form!r}")


def mappings_to_json(mappings: DataFrame) -> DataFrame:
    return mappings.select(F.to_json(F.struct("*")).alias("value"))


def mappings_from_json(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("value", schema).alias("m")).select("m.*")
