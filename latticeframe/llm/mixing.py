"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token weights are summed by cell (source, language, topic). Categories that the targets do not name share one
category, so the cells are as many as the targets allow, whatever the input. A cell's probability is
min(1, a[source] * b[language] * c[topic]); each step of the fitting sets the factors of one axis so that the kept
tokens of each of its categories meet the target with the cap in force, until no marginal is off by more than a
tolerance. A category whose present tokens do not suffice is kept whole, and the others of its axis make up for it in
proportion to their targets. A document is kept when its hash, uniform in [0, 1), lies below its cell's probability.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import slices

REST = "*"


def uniform(id_col: str, seed: int) -> Column:
    """A hash of the id, uniform in [0, 1): the first 8 hexadecimal digits of the MD5 of "seed:id"; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def topics_of(texts: pa.Array, lexicons: dict[str, list[str]]) -> pa.Array:
    """The topic with the most lexicon hits in the lower-cased text, the first in order of names among equals; REST without hits. Null counts as empty."""
    low, names = pc.utf8_lower(pc.fill_null(texts, "")), sorted(lexicons)
    hits = np.zeros((len(names) + 1, len(texts)), np.int64)
    for k, name in enumerate(names):
        hits[k] = pc.count_substring_regex(low, "|".join(lexicons[name])).to_numpy()
    top = hits.argmax(0)
    return pa.array([*names, REST]).take(pa.array(np.where(hits.max(0) > 0, top, len(names))))


def words_of(texts: pa.Array) -> np.ndarray:
    """Of each text how many words, divided by spaces, tabs and line ends, it has. Null counts as empty."""
    raw = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = (data != 32) & ((data < 9) | (data > 13) | (data == 11) | (data == 12))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][np.diff(ends) > 0]
    first[begins] = inside[begins]
    return np.diff(np.concatenate([[0], np.cumsum(first)])[ends])


def with_topics(docs: DataFrame, lexicons: dict[str, list[str]], text_col: str, topic_col: str, tokens_col: str) -> DataFrame:
    """docs with the topic and the number of words (divided by spaces, tabs and line ends) of each text, in one pass; no shuffle."""
    rest, at = docs.columns, docs.columns.index(text_col)
    schema = docs.withColumn(topic_col, F.lit("")).withColumn(tokens_col, F.lit(0).cast("long")).schema

    def run(batches):
        for part in slices(batches, at):
            texts = part.column(at)
            yield pa.RecordBatch.from_arrays([*part.columns, topics_of(texts, lexicons), pa.array(words_of(texts), pa.int64())], [*rest, topic_col, tokens_col])

    return docs.mapInArrow(run, schema)


def category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin([t for t in targets if t != REST]), value).otherwise(F.lit(REST))


def reachable(have: np.ndarray, target: np.ndarray, total: float) -> np.ndarray:
    """Tokens to keep of each category, total together: its target's part, or all it has where that is less, the others filling up in proportion."""
    want = np.zeros(len(have))
    open_ = (have > 0) & (target > 0)
    while open_.any():
        part = (total - want[~open_].sum()) * target / target[open_].sum()
        short = open_ & (part >= have)
        if not short.any():
            want[open_] = part[open_]
            break
        want[short] = have[short]
        open_ &= ~short
    return want


def scale(weights: np.ndarray, factors: np.ndarray, budget: float) -> float:
    """The c for which sum(weights * min(1, c * factors)) is budget; infinite where all that have a factor do not suffice."""
    order = np.argsort(-factors, kind="stable")
    w, f = weights[order], factors[order]
    keep = (w > 0) & (f > 0)
    w, f = w[keep], f[keep]
    if not len(w) or budget <= 0:
        return 0.0
    if budget >= w.sum() * (1 - 1e-12):
        return np.inf
    full = np.concatenate([[0.0], np.cumsum(w)[:-1]])  # tokens of the cells already kept whole
    c = (budget - full) / np.cumsum((w * f)[::-1])[::-1]
    return float(c[np.flatnonzero(c * f <= 1)[0]])


@dataclass(frozen=True)
class Fit:
    """Probabilities by cell, the most that any marginal is off its wanted share of the kept tokens, and of each axis the wanted shares."""

    probabilities: np.ndarray
    residual: float
    wanted: list[np.ndarray]


def rake(weights: np.ndarray, targets: list[np.ndarray], share: float, tolerance: float = 1e-10, sweeps: int = 1_000) -> Fit:
    """Probabilities min(1, product of the axes' factors) that keep share of all tokens with the marginals that targets ask for, as far as the categories' tokens reach.

    A slice without tokens stays empty, one without a target gets 0. The axes' wanted marginals may contradict each other
    where cells are empty or full; the residual then stays above the tolerance after the last sweep, and is returned.
    """
    axes = range(weights.ndim)
    others = [tuple(k for k in axes if k != axis) for axis in axes]
    allowed = weights.copy()
    for axis, target in enumerate(targets):
        allowed *= (target > 0).reshape([-1 if k == axis else 1 for k in axes])
    total = min(share * weights.sum(), allowed.sum())
    wanted = [reachable(allowed.sum(others[axis]), target, total) for axis, target in enumerate(targets)]
    factors = (allowed > 0).astype(float)
    residual = np.inf
    for _ in range(sweeps if total > 0 else 0):
        for axis in axes:
            rows, f = (np.moveaxis(x, axis, 0).reshape(x.shape[axis], -1) for x in (allowed, factors))
            c = np.array([scale(w, g, b) for w, g, b in zip(rows, f, wanted[axis], strict=True)])
            top = np.divide(1.0, np.where(f > 0, f, np.inf).min(1))  # enough to keep all of a slice
            c = np.where(np.isfinite(c), c, top)
            factors = factors * c.reshape([-1 if k == axis else 1 for k in axes])
        kept = allowed * np.minimum(1, factors)
        residual = max(np.abs(kept.sum(others[axis]) - wanted[axis]).max() for axis in axes) / total
        if residual <= tolerance:
            break
    return Fit(np.minimum(1, factors), float(residual) if total > 0 else 0.0, [w / max(total, 1e-300) for w in wanted])


def target_array(targets: dict[str, float], names: list[str]) -> np.ndarray:
    return np.array([targets.get(n, 0.0) for n in names])


def mix(
    docs: DataFrame, sources: dict[str, float], languages: dict[str, float], topics: dict[str, float], lexicons: dict[str, list[str]], share: float = 0.5, seed: int = 0, most_off: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """docs with mix_probability, and mix_kept, the decision for each row; columns of these names are replaced.

    Targets are shares of tokens, taken relative to their sum over the categories present; each may name "*" for all
    categories it does not name. Null values and unnamed categories are "*"; without a target for "*" their rows get
    probability 0. The expected kept tokens are share of all, and their marginals the targets; a category with fewer
    tokens than its target asks for is kept whole, the others of its axis then share the rest in proportion. Targets of
    several axes may contradict each other at this share; a marginal that then stays off by over half a percent of the
    kept tokens gives a warning, and one off by more than most_off, if given, a ValueError. A document without tokens has
    its cell's probability. Equal ids share one draw. An empty table gives no rows. Only cell sums, bounded by the
    targets' sizes, reach the driver; they are summed while the result is planned.
    """
    out = [c for c in docs.columns if c not in ("mix_probability", "mix_kept")]
    axes = [sorted({*x, REST}) for x in (sources, languages, topics)]
    names = ["mix source", "mix language", "mix topic", "mix tokens"]

    def keyed(rows: DataFrame) -> DataFrame:
        """rows (kept fields ..., text, s, l) with the cell's keys."""
        found = with_topics(rows, lexicons, "text", names[2], names[3])
        return found.withColumn(names[0], category(F.col("s"), sources)).withColumn(names[1], category(F.col("l"), languages)).withColumn(names[2], category(F.col(names[2]), topics))

    fields = [F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("s"), F.col(f"`{lang_col}`").alias("l")]
    cells = keyed(docs.select(*fields)).groupBy(*[f"`{n}`" for n in names[:3]]).agg(F.sum(f"`{names[3]}`").alias("n")).collect()
    weights = np.zeros([len(a) for a in axes])
    for r in cells:
        weights[tuple(a.index(v) for a, v in zip(axes, r[:3], strict=True))] += r["n"] or 0
    fit = rake(weights, [target_array(t, a) for t, a in zip((sources, languages, topics), axes, strict=True)], share)
    if fit.residual > 0.005:
        off = f"targets contradict each other: a marginal stays off by {fit.residual:.4f} of the kept tokens"
        if most_off is not None and fit.residual > most_off:
            raise ValueError(off)
        warnings.warn(off, stacklevel=2)
    # cells are looked up in an array literal: no join, so no row moves
    literal = F.lit(fit.probabilities.ravel().tolist())
    place = lambda n, axis: F.array_position(F.lit(axis), F.col(f"`{n}`")).cast("int") - 1
    at = (place(names[0], axes[0]) * len(axes[1]) + place(names[1], axes[1])) * len(axes[2]) + place(names[2], axes[2])
    others = [c for c in out if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(True).alias("mix rest")).alias("rest")
    found = keyed(docs.select(rest, uniform(f"`{id_col}`", seed).alias("u"), *fields)).withColumn("mix_probability", F.element_at(literal, at + 1))
    kept = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in out]
    return found.select(*kept, "mix_probability", (F.col("u") < F.col("mix_probability")).alias("mix_kept"))
