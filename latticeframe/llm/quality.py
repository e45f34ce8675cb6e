"""Quality classifier: zstandard dictionaries trained on good and on bad labelled text, and a calibrated score.

Fitting takes a bounded, hash-ordered sample of labelled rows. Two of three texts of a class train its dictionary, the
third calibrates. A text is cut into blocks that cover all of it; each block is compressed with either dictionary, and
the normalised difference of the summed sizes becomes the score through a logistic calibration.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import slices

BLOCK = 1_024
OVERHEAD = 8  # bytes of a block that say nothing about it
PARTS = 30


@dataclass(frozen=True)
class Model:
    """The two dictionaries, the compression level, and the calibration: score = logistic(weights[0] + weights[1] * difference)."""

    good: bytes
    bad: bytes
    level: int
    weights: tuple[float, float]


@lru_cache(maxsize=2)
def compressors(good: bytes, bad: bytes, level: int):
    out = []
    for content in (good, bad):
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level)
        out.append(zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
    return out


def difference(text: str, good: bytes, bad: bytes, level: int) -> float:
    """(bad size - good size) / (bad size + good size), sizes summed over all blocks; 0 for an empty text."""
    raw = text.encode("utf-8", "surrogatepass")
    blocks = [raw[low : low + BLOCK] for low in range(0, len(raw), BLOCK)]
    g, b = (sum(len(compress(x)) - OVERHEAD for x in blocks) for compress in compressors(good, bad, level))
    return (b - g) / max(b + g, 1)


def design(differences: list[float]) -> np.ndarray:
    """Inputs of the calibration."""
    return np.stack([np.ones(len(differences)), 10 * np.array(differences, float)], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Newton's method for a penalised logistic regression."""
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on all blocks of all texts; their bytes themselves where there are too few to train on."""
    blocks = [t[low : low + BLOCK] for t in texts for low in range(0, len(t), BLOCK)]
    total = sum(map(len, blocks))
    try:
        return zstandard.train_dictionary(min(size, max(1_024, total // 2)), blocks, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size] or b"empty text"


def learn(texts: list[str], quality: list[int], dictionary_bytes: int = 400 << 10, level: int = 3) -> Model:
    """A model of texts in a fixed order; every third text of a class calibrates, the others train its dictionary. Without one of the classes the score is the other's share."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    y = np.array(quality, float)
    turn = np.zeros(len(y), int)
    for k in (0, 1):
        turn[y == k] = np.arange((y == k).sum()) % 3
    if not len(y) or y.min() == y.max():
        return Model(b"good text", b"bad text", level, (30.0 if len(y) and y[0] == 1 else -30.0 if len(y) else 0.0, 0.0))
    dicts = [train_dictionary([r for r, q, t in zip(raw, quality, turn, strict=True) if q == k and t < 2], dictionary_bytes) for k in (1, 0)]
    held = np.flatnonzero(turn == 2)
    if len(set(y[held])) < 2:
        held = np.arange(len(y))
    weights = fit_logistic(design([difference(texts[i], *dicts, level) for i in held]), y[held])
    return Model(dicts[0], dicts[1], level, tuple(weights))


def spread(text: Column, most: int) -> Column:
    """The text, or of a text of more than most characters PARTS pieces at equal distances, from its start to its end, of most characters together."""
    piece = most // PARTS
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(text, (F.lit(1) + F.floor(i * (F.length(text) - piece) / (PARTS - 1))).cast("int"), F.lit(piece)))
    return F.when(F.length(text) <= most, text).otherwise(F.array_join(pieces, ""))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 1500, max_chars: int = 30_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on labelled rows whose crc32(id as text) mod 3 is not 1.

    Of each class at most max_rows ids, those with the smallest hashes; a text of more than max_chars characters teaches
    with pieces from all over it. This bounds what reaches the driver. An id with several labels counts as good if any
    says so; of several texts of an id the smallest counts, a null text as empty. Without labelled rows every score is 0.5.
    """
    teach = labels.where(f"`{id_col}` is not null and quality in (0, 1) and crc32(cast(`{id_col}` as string)) % 3 <> 1").groupBy(id_col).agg(F.max("quality").cast("int").alias("quality"))
    picked = [r for k in (0, 1) for r in teach.where(F.col("quality") == k).orderBy(F.xxhash64(id_col), id_col).limit(max_rows).collect()]
    if not picked:
        return learn([], [])
    ids = docs.sparkSession.createDataFrame(picked, teach.schema)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), id_col)  # 2 * max_rows ids
    rows = rows.groupBy(id_col).agg(F.max("quality").alias("quality"), F.min(spread(F.col("text"), max_chars)).alias("text")).orderBy(F.xxhash64(id_col, F.lit(1)), id_col).collect()
    return learn([r["text"] for r in rows], [r["quality"] for r in rows])


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x = design([difference(t or "", model.good, model.bad, model.level) for t in texts])
    return 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights), -30, 30)))


def classify(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """docs with score_col, the probability that a text is good, from the whole text alone; a column of that name is replaced.

    Every row keeps its place and other columns; no shuffle. A null text counts as empty; an empty text gets the score of
    no evidence; an empty table gives no rows.
    """
    rest = [c for c in docs.columns if c != score_col]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text_col)
    schema = frame.withColumn(score_col, F.lit(0.0)).schema

    def run(batches):
        for part in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(part.column(at).to_pylist(), model), pa.float64())], [*rest, score_col])

    return frame.mapInArrow(run, schema)
