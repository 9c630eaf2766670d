"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

Two dictionaries are trained, one from pieces of good texts and one from pieces of bad ones. A text is compressed with
each, piece by piece over its whole length so that a long text meets the dictionaries everywhere. The difference of the
compressed sizes, normalised by the text's length, says whose dictionary knows it better; a logistic curve, fitted on
labelled texts that neither dictionary saw, makes it a calibrated probability.

Fitting reads a bounded sample: SAMPLE_ROWS labelled rows for each of the two steps (those with the smallest hash of
their id), and PIECES pieces of each for the dictionaries, spread over the text. Scoring is one pass without a shuffle.

Defined results. Null and empty text: difference 0, the curve's value there. Labels other than 0 and 1 and labels of
null ids are left out; a row labelled twice counts as the larger label. With labels of one class or none, every score is
that class's smoothed share (0.5 without labels). Null and repeated ids: a row each. Empty table: no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 6000
PIECES = 8
PIECE = 1024
DICTIONARY = 32768
LEVEL = 3
PRIOR_LENGTH = 64


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / (length + PRIOR_LENGTH)."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        packers = [_packer(d) for d in (self.bad, self.good)]
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            raw = (text or "").encode()
            sizes = [sum(len(pack(raw[at : at + PIECE])) for at in range(0, len(raw), PIECE)) for pack in packers]
            out[i] = (sizes[0] - sizes[1]) / (len(raw) + PRIOR_LENGTH)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.intercept, -40, 40)))


def _packer(dictionary: bytes):
    loaded = zstandard.ZstdCompressionDict(dictionary)
    loaded.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def _pieces(text: str | None) -> list[bytes]:
    """PIECES pieces at most, spread evenly over the whole text."""
    raw = (text or "").encode()
    n = -(-len(raw) // PIECE)
    return [raw[i * PIECE : (i + 1) * PIECE] for i in sorted({k * n // PIECES for k in range(PIECES)}) if i < n]


def _dictionary(pieces: list[bytes]) -> bytes:
    if sum(map(len, pieces)) < 1024 or len(pieces) < 8:
        return b"".join(pieces)
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, pieces)) // 4)), pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too even samples: their raw text serves as the dictionary
        return b"".join(pieces)[:DICTIONARY]


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a lightly damped logistic regression, by Newton's method on the scaled variable."""
    scale = float(np.std(x)) or 1.0
    design, weights = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -40, 40)))
        gradient = design.T @ (y - p) - 0.1 * weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0] / scale), float(weights[1])


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None) -> QualityModel:
    """A model from the labelled rows of `docs`, or from those for which `learn` (a condition on the key) holds."""
    marks = labels.select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("mark"))
    if learn is not None:
        marks = labels.where(learn).select(F.col(key).alias("doc_id"), F.col(label).cast("int").alias("mark"))
    marks = marks.where("doc_id is not null and mark in (0, 1)").groupBy("doc_id").agg(F.max("mark").alias("mark"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(5))
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def sample(which: Column) -> DataFrame:
        chosen = marks.where(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        return texts.join(F.broadcast(chosen), "doc_id")  # SAMPLE_ROWS rows of two numbers

    def bounded(rows: DataFrame, made: str, make) -> list:
        """The first SAMPLE_ROWS results by a hash of the row, in that order."""
        found = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("order"), "mark", "text").mapInArrow(make, f"`order` BIGINT, doc_id BIGINT, mark INT, {made}")
        return found.orderBy("order", "doc_id").limit(SAMPLE_ROWS).collect()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [_pieces(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("order", "doc_id", "mark")), pa.array(pieces, pa.list_(pa.binary()))], names=["order", "doc_id", "mark", "pieces"])

    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for row in bounded(sample(part < 3), "pieces ARRAY<BINARY>", cut):
        pieces[row["mark"]] += [bytes(p) for p in row["pieces"]]
    draft = QualityModel(_dictionary(pieces[1]), _dictionary(pieces[0]), 0.0, 0.0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = draft.differences(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("order", "doc_id", "mark")), pa.array(found)], names=["order", "doc_id", "mark", "x"])

    rows = bounded(sample(part >= 3), "x DOUBLE", measure)
    x, y = np.array([r["x"] for r in rows]), np.array([float(r["mark"]) for r in rows])
    if len(set(y)) < 2 or not draft.good or not draft.bad:
        share = (sum(y) + len(pieces[1]) + 1) / (len(y) + len(pieces[0]) + len(pieces[1]) + 2)
        return QualityModel(draft.good, draft.bad, 0.0, float(np.log(share / (1 - share))))
    return QualityModel(draft.good, draft.bad, *_fit_curve(x, y))


def score_quality(docs: DataFrame, model: QualityModel, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, *carry, score) for every row; name the text in `carry` to keep it."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes
    names = [key, *(c for c in carry if c != key)]
    inside = text in names
    rows = docs.select(F.struct(*map(F.col, names)).alias("kept"), *([] if inside else [F.col(text).alias("text")]))
    schema = f"kept {rows.schema['kept'].dataType.simpleString()}, score DOUBLE"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("kept").field(names.index(text)) if inside else batch.column("text")
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(shared.value.scores(texts.to_pylist()))], names=["kept", "score"])

    return rows.mapInArrow(score, schema).select("kept.*", "score")


def keep_accepted(docs: DataFrame, model: QualityModel, least: float, text: str = "text") -> DataFrame:
    """The rows whose text scores `least` or more, with all their columns as they are, whatever their names."""
    nested = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return score_quality(nested, model, key="row").where(F.col("score") >= least).select("row.*")


def in_learning_part(key: Column) -> Column:
    """Rows to learn from; the others are held out."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(5)) != 0
