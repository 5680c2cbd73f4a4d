"""Fitted artefacts: ``pyspark.ml`` models that are saved and loaded whole, alone or as stages of a ``PipelineModel``."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class Fitted(Model, MLWritable, MLReadable):
    """A model whose state is numbers and texts (``state``, kept as JSON), tables of any size (``tables``) and other models (``models``).

    Subclasses say in ``_transform`` what they do with it. JSON keeps every double exactly.
    """

    def __init__(self, state: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None, models: dict[str, Any] | None = None):
        super().__init__()
        self.state, self.tables, self.models = state or {}, tables or {}, models or {}

    def write(self) -> FittedWriter:
        return FittedWriter(self)

    @classmethod
    def read(cls) -> FittedReader:
        return FittedReader(cls)

    def save(self, path: str) -> str:
        """Replaces what lies at ``path``."""
        self.write().overwrite().save(path)
        return path

    def into(self, column: str) -> Fitted:
        """The same model as a stage that writes its score to ``column``."""
        out = copy.copy(self)
        out.state = {**self.state, "output": column}
        return out

    def _loaded(self) -> None:
        """Called after loading, for subclasses that hold more than the plain state."""

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


class FittedWriter(MLWriter):
    def __init__(self, instance: Fitted):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        it = self.instance
        DefaultParamsWriter.saveMetadata(it, path, self.sparkSession, {"state": it.state, "tables": sorted(it.tables), "models": sorted(it.models)})
        for name, table in it.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        for name, model in it.models.items():
            model.write().overwrite().save(f"{path}/models/{name}")


class FittedReader(MLReader):
    def __init__(self, kind: type[Fitted]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Fitted:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        tables = {name: spark.read.parquet(f"{path}/tables/{name}") for name in meta["tables"]}
        models = {name: DefaultParamsReader.loadParamsInstance(f"{path}/models/{name}", spark) for name in meta["models"]}
        out = self.kind.__new__(self.kind)
        Fitted.__init__(out, meta["state"], tables, models)
        out._resetUid(meta["uid"])
        out._loaded()
        return out

