"""M01 setup: ignore list, impute (mean/mode), one-hot, assemble, z-score.

Fitted once (three aggregate jobs + the scaler's one summary pass); the
result transforms any frame with the same input columns into
(input columns..., ``features`` vector)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from tabloom.operators.encode import FittedOneHot, OneHot
from tabloom.operators.missing import FittedImpute, SimpleImputer


@dataclass
class Prepared:
    target: str
    ignore: list[str]
    imputer: FittedImpute
    onehot: FittedOneHot
    features: list[str]
    model: object          # PipelineModel of assembler (+ scaler)

    def encode(self, df: DataFrame) -> DataFrame:
        x = self.onehot.transform(self.imputer.transform(df))
        return x

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.encode(df))


def prepare(df: DataFrame, target: str, ignore: Sequence[str] = (), normalize: bool = True,
            max_cardinality: int = 10) -> Prepared:
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    ignore = list(ignore)
    cols = [c for c in df.columns if c not in ignore and c != target]
    x = df.select(*cols)
    imputer = SimpleImputer().fit(x)
    filled = imputer.transform(x)
    onehot = OneHot(max_cardinality=max_cardinality).fit(filled)
    enc = onehot.transform(filled)
    feats = [f.name for f in enc.schema.fields if isinstance(f.dataType, NumericType)]
    stages = [VectorAssembler(inputCols=feats, outputCol="features" if not normalize else "_raw",
                              handleInvalid="keep")]
    if normalize:
        stages.append(StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True))
    model = Pipeline(stages=stages).fit(enc)
    return Prepared(target, ignore, imputer, onehot, feats, model)
