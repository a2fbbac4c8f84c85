"""Operator 3: a quality score from a kernel model of document statistics.

Random Fourier features of standardised statistics approximate a Gaussian kernel. Partitions
sum the normal equations of their labelled rows, the sums are added up in two steps, and the
ridge solution is calibrated by isotonic regression on labelled rows kept out of the fit.

Defined cases: null and empty texts have statistics of 0 and get a score like all others;
without labels of both classes every score is the share of good labels (0.5 without any);
repeated rows are scored and learned from each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.quality_rules import features, statistics
from reviewlens.session import stage


@dataclass(frozen=True)
class Settings:
    features: int = 256
    width: float = 2.0
    ridge: float = 1e-3
    bins: int = 2000
    seed: int = 7
    calibration_folds: int = 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    solution: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.phases
        return np.hstack([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.solution

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising values for ``good`` of ``n`` at rising ``x``, by pooling adjacent violators."""
    blocks: list[list[float]] = []  # good, n, first x, last x
    for at, g, m in zip(x, good, n):
        blocks.append([g, m, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            g2, m2, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + g2, blocks[-1][1] + m2, blocks[-1][2], last]
    knots = [k for b in blocks for k in (b[2], b[3])]
    values = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(knots), np.array(values)


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy() for n in names])


def learn(rows: DataFrame, names: list[str], settings: Settings = Settings()) -> Model:
    """``rows``: doc_id, the named statistics and ``good`` (0 or 1)."""
    moments = rows.agg(
        F.avg("good").alias("share"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.stddev_pop(n).alias(f"s_{n}") for n in names],
    ).first()
    share = moments["share"]
    dealt = np.random.default_rng(settings.seed)
    model = Model(
        mean=np.array([moments[f"m_{n}"] or 0.0 for n in names]),
        scale=np.array([moments[f"s_{n}"] or 1.0 for n in names]),
        weights=dealt.normal(0, 1 / settings.width, (len(names), settings.features)),
        phases=dealt.uniform(0, 2 * np.pi, settings.features),
        solution=np.zeros(settings.features + 1),
        knots=np.array([0.0]),
        values=np.array([0.5 if share is None else share]),
    )
    if share in (None, 0.0, 1.0):
        return model
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)), F.lit(settings.calibration_folds))
    size = settings.features + 1

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((size, size + 1))
        for batch in batches:
            x = model.expand(_matrix(batch, names))
            good = batch.column(batch.schema.get_field_index("good")).to_numpy().astype(float)
            total += x.T @ np.column_stack([x, good])
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % 16]), pa.array([total.tobytes()], pa.binary())],
            names=["part", "sums"],
        )

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), float) for s in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    fitted = rows.filter(fold > 0).select(*names, "good")
    sums = (
        fitted.mapInArrow(add_up, "part long, sums binary")
        .groupBy("part")
        .applyInArrow(merge, "sums binary")
        .collect()
    )
    total = sum(np.frombuffer(r["sums"], float) for r in sums).reshape(size, size + 1)
    n = total[size - 1, size - 1]
    penalty = settings.ridge * max(n, 1.0) * np.eye(size)
    penalty[-1, -1] = 0.0
    model.solution = np.linalg.lstsq(total[:, :size] + penalty, total[:, size], rcond=None)[0]

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(model.raw(_matrix(batch, names)), -1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.round((at + 1) / 3 * settings.bins).astype(np.int64)),
                    batch.column(batch.schema.get_field_index("good")).cast(pa.int64()),
                ],
                names=["bin", "good"],
            )

    binned = (
        rows.filter(fold == 0)
        .select(*names, "good")
        .mapInArrow(raw, "bin long, good long")
        .groupBy("bin")
        .agg(F.sum("good").alias("good"), F.count("*").alias("n"))
        .collect()
    )
    if binned:
        binned.sort(key=lambda r: r["bin"])
        x = np.array([r["bin"] for r in binned]) * 3 / settings.bins - 1
        model.knots, model.values = isotonic(
            x, np.array([float(r["good"]) for r in binned]), np.array([float(r["n"]) for r in binned])
        )
    return model


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``docs`` (doc_id, text)."""
    at = features()
    names = list(at)
    stats = stage(
        statistics(docs, F.col("text"), [F.col("doc_id")]).select(
            "doc_id", held_out(F.col("doc_id")).alias("held_out"), *[c.alias(n) for n, c in at.items()]
        ),
        "quality-features",
    )
    of = labels.filter("quality is not null").select(
        F.col("doc_id").alias("_labelled"), F.col("quality").cast("long").alias("good")
    )
    training = stats.filter("not held_out").join(of, F.col("doc_id") == F.col("_labelled"))
    model = learn(stage(training.select("doc_id", *names, "good"), "quality-training"), names, settings)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(model.score(_matrix(batch, names)))],
                names=["doc_id", "held_out", "score"],
            )

    return stats.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        score, "doc_id long, held_out boolean, score double"
    )
