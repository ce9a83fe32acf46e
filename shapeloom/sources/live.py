"""Entities of a live Wikibase as they are needed, kept in a cache table.

What is asked for and not in the cache is fetched in tasks and added in one
move (a folder that gets its name when it is complete); then the entities that
the new ones name are asked for, until nothing is missing.  A second run over the
same cache fetches nothing.  Entities that the server does not have are kept as
such.

    cache = live.Cache(spark, "/data/cache", "https://host/wiki/Special:EntityData/{}.json")
    entities = cache.closure(ids, follow={"P31", "P279"})

Defined results: null ids are left out, repeated ones asked for once; an empty
table of ids gives an empty table of entities.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import keep
from ..wikibase.model import parse_json
from .endpoint import _fetch

_ROW = "id string, value string"


class Cache:
    """A folder of fetched documents (id, value; value is null for what does not exist)."""

    def __init__(self, spark: SparkSession, path: str, url: str, tasks: int = 8, timeout: float = 60):
        self.spark, self.path, self.url, self.tasks, self.timeout = spark, path.rstrip("/"), url, tasks, timeout
        self.fetched = 0

    def _fs(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def table(self) -> DataFrame:
        """(id, value) of all batches."""
        fs, top = self._fs(), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(top)] if fs.exists(top) else []
        batches = [f"{self.path}/{n}" for n in names if n.startswith("batch-")]
        return self.spark.read.schema(_ROW).parquet(*batches) if batches else self.spark.createDataFrame([], _ROW)

    def need(self, ids: DataFrame) -> int:
        """Fetch what is missing of ``ids`` (id); how many that was."""
        missing = keep(ids.where("id IS NOT NULL").select("id").distinct().join(self.table().select("id"), "id", "left_anti"))
        n = missing.count()
        if not n:
            return 0
        url, timeout = self.url, self.timeout

        def run(frames):
            from urllib.error import HTTPError

            import pandas as pd

            for pdf in frames:
                texts = []
                for i in pdf["id"]:
                    try:
                        texts.append(_fetch(url.format(i), "application/json", timeout))
                    except HTTPError as e:
                        if e.code not in (404, 410):
                            raise
                        texts.append(None)
                yield pd.DataFrame({"id": pdf["id"], "value": texts})

        name = uuid.uuid4().hex
        missing.repartition(self.tasks, "id").mapInPandas(run, _ROW).write.parquet(f"{self.path}/_new-{name}")
        if not self._fs().rename(self._at(f"_new-{name}"), self._at(f"batch-{name}")):
            raise OSError(f"cannot add to the cache {self.path}")
        self.fetched += n
        return n

    def entities(self, ids: DataFrame) -> DataFrame:
        """Entity rows of those of ``ids`` that exist; nothing is fetched."""
        mine = self.table().where("value IS NOT NULL").dropDuplicates(["id"]).join(ids.select("id").distinct(), "id", "left_semi")
        inner = F.map_values(F.from_json(F.get_json_object("value", "$.entities"), "MAP<STRING, STRING>"))
        return parse_json(mine.select(F.explode(F.coalesce(inner, F.array("value"))).alias("value"))).drop("_bad")

    def closure(self, ids: DataFrame, follow: set[str] | None = None, hops: int | None = None) -> DataFrame:
        """Entity rows of ``ids`` and of all that they name in statements of ``follow`` (None: of any property), over ``hops`` steps or until there are no more."""
        seen = fresh = keep(ids.where("id IS NOT NULL").select("id").distinct())
        step = 0
        while True:
            self.need(fresh)
            if hops is not None and step >= hops:
                break
            s = F.explode("statements").alias("s")
            named = self.entities(fresh).select(s).where(F.lit(True) if follow is None else F.col("s.property").isin(sorted(follow)))
            snaks = F.concat(F.array("s.snak"), F.col("s.qualifiers"), F.flatten("s.refs"))
            more = named.select(F.explode(snaks).alias("x")).where("x.vtype = 'entity' AND x.value IS NOT NULL").select(F.col("x.value").alias("id")).distinct()
            fresh = keep(more.join(seen, "id", "left_anti"))
            if fresh.isEmpty():
                break
            seen, step = keep(seen.unionByName(fresh)), step + 1
        return self.entities(seen)
