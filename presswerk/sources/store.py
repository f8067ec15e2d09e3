"""The stored article table, JSON artifacts and YAML configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from presswerk.operators.records import ARTICLE, conformed, latest
from presswerk.session import Numbered, release


class Deltas:
    """A keyed table as parts below one folder of any file system: a base and what was merged since.

    A merge writes only its own rows and then a manifest that names the parts in force, so readers never see half, a
    writer that dies changes nothing, and whoever opens the folder later goes on from the manifest. A part given again
    under its name (a repeated micro-batch) replaces itself. Reading takes the last row of each key over all parts;
    after ``compact_every`` parts of one size they are merged into one, so a row is rewritten a few times in all.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, order: str = "row_id", compact_every: int = 8) -> None:
        self.spark, self.path, self.schema, self.order, self.compact_every = spark, path.rstrip("/"), schema, order, compact_every
        self.manifest = Numbered(spark, self.path)

    def _held(self) -> dict:
        return self.manifest.read() or {"made": 0, "parts": []}

    def _union(self, parts: list[dict]) -> DataFrame:
        """The rows of the parts with ``_at``, the number under which they came; columns that a part lacks are null."""
        shape = StructType([*self.schema.fields, StructField("_at", LongType())])
        return self.spark.read.schema(shape).parquet(*(f"{self.path}/{p['folder']}" for p in parts))

    def read(self) -> DataFrame:
        parts = self._held()["parts"]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return latest(self._union(parts), ["_at", self.order]).select(*self.schema.names)

    def merge(self, rows: DataFrame, name: str | None = None) -> None:
        """Merge rows in; of several for one key the last by ``order`` wins, and those of later merges before earlier ones."""
        held = self._held()
        again = next((p for p in held["parts"] if name is not None and p["name"] == name), None)
        if name is not None and again is None and name in held.get("done", []):
            return  # a repeat of what has been compacted already
        number = held["made"] + 1
        at = again["at"] if again else number
        folder = f"part-{number}"
        written = rows.select(*self.schema.names).withColumn("_at", F.lit(at).cast("bigint"))
        latest(written, [self.order]).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        parts = [p for p in held["parts"] if p is not again] + [{"folder": folder, "name": name, "at": at, "tier": 0}]
        old = [again["folder"]] if again else []
        done = held.get("done", [])
        while len(due := [p for p in parts if p["tier"] == min(q["tier"] for q in parts)]) >= self.compact_every:
            number += 1
            folder = f"part-{number}"
            latest(self._union(due), ["_at", self.order]).write.mode("overwrite").parquet(f"{self.path}/{folder}")
            done = [*done, *(p["name"] for p in due if p["name"] is not None)][-1000:]
            parts = [p for p in parts if p not in due] + [{"folder": folder, "name": None, "at": max(p["at"] for p in due), "tier": due[0]["tier"] + 1}]
            old += [p["folder"] for p in due]
        self.manifest.write({"made": number, "parts": parts, "done": done})
        for folder in old:
            release(self.spark, f"{self.path}/{folder}")


class ArticleStore:
    """The stored articles, merged by address or id; parts of older shape are read in today's."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._deltas = Deltas(spark, path, ARTICLE, "fetched_at")

    def read(self) -> DataFrame:
        return conformed(self._deltas.read())

    def upsert(self, rows: DataFrame, name: str | None = None) -> None:
        """Merge article rows in; the last by ``fetched_at`` wins where several share an address or id."""
        self._deltas.merge(conformed(rows), name)

    def count(self) -> int:
        return self.read().count()


def read_yaml(path: str | Path) -> dict:
    """A YAML mapping; an empty file is empty, a missing one or another shape is an error."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{path} must hold a mapping")
    return data


def write_artifact(result: dict, path: str | Path) -> Path:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(result, indent=2, ensure_ascii=False), encoding="utf-8")
    return target


def load_or_compute(path: str | Path, compute: Callable[[], dict]) -> dict:
    """The artifact if it is there, else what ``compute`` gives, written for the next time."""
    if Path(path).exists():
        return json.loads(Path(path).read_text(encoding="utf-8"))
    result = compute()
    write_artifact(result, path)
    return result


def to_documents(items: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return items.select(F.to_json(F.struct(*items.columns)).alias("json"))
