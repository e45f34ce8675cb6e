"""SentencePiece encoding and decoding: a batched numpy Viterbi.

Distinct words of a batch are grouped by length, and all words of one length advance together, one end position at a
time. Substring hashes (differences of prefix hashes) probe the sorted hashes of the vocabulary's pieces; hits are
compared character by character, so a chance hash match cannot pass. An argmax over start positions, earliest first,
keeps the backpointers with the vocabulary's tie rule.
"""

from __future__ import annotations

import codecs
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Codes, mix, slices
from latticeframe.llm.pieces import DEFAULT_MODEL, SPACE, load

BASE = np.uint64(0x100000001B3)
PROBES = 300_000
KEPT_WORDS = 150_000
KEPT_LENGTH = 40
SLICE_IDS = 500_000

codecs.register_error("latticeframe-each", lambda e: ("�", e.start + 1))


class Encoder:
    def __init__(self, path: str):
        self.pieces = p = load(path)
        surfaces = list(p.normal)
        codes = np.zeros((len(surfaces), p.longest), np.uint32)
        for row, surface in enumerate(surfaces):
            codes[row, : len(surface)] = np.frombuffer(surface.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(s) for s in surfaces])
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(p.longest, BASE)]).astype(np.uint64))
            hashes = np.zeros(len(surfaces), np.uint64)
            for k in range(p.longest):
                hashes = np.where(k < lengths, hashes * BASE + mix(codes[:, k].astype(np.uint64)), hashes)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.codes, self.lengths = hashes[order], codes[order], lengths[order]
        self.ids = np.array([p.normal[s][0] for s in surfaces], np.int32)[order]
        self.scores = np.array([p.normal[s][1] for s in surfaces])[order]
        assert len(np.unique(self.keys)) == len(self.keys), "piece hashes clash"
        self.forget()

    def forget(self) -> None:
        """Empties the table of words met before: their numbers, and of each the ids as flat[offsets[n]:offsets[n + 1]]."""
        self.known, self.flat, self.offsets = Codes(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def equal(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, chars (n, length): (n, length + 1) backpointers as starts and ids; an unknown character has the id -1."""
        n, length = chars.shape
        longest = self.pieces.longest
        with np.errstate(over="ignore"):
            prefix = np.zeros((n, length + 1), np.uint64)
            mixed = mix(chars.astype(np.uint64))
            for k in range(length):
                prefix[:, k + 1] = prefix[:, k] * BASE + mixed[:, k]
        best = np.zeros((n, length + 1))
        starts, ids = np.zeros((n, length + 1), np.int32), np.zeros((n, length + 1), np.int32)
        rows = np.arange(n)
        for end in range(1, length + 1):
            first = max(0, end - longest)
            with np.errstate(over="ignore"):
                probe = prefix[:, end, None] - prefix[:, first:end] * self.powers[end - first : 0 : -1]
            at = np.minimum(np.searchsorted(self.keys, probe.ravel()), len(self.keys) - 1).reshape(probe.shape)
            r, s = np.nonzero(self.keys[at] == probe)
            hit = at[r, s]
            true = self.lengths[hit] == end - first - s
            for k in range(end - first):  # the characters of each hit, one position at a time
                true &= (k >= self.lengths[hit]) | (self.codes[hit, np.minimum(k, longest - 1)] == chars[r, np.minimum(first + s + k, length - 1)])
            r, s, hit = r[true], s[true], hit[true]
            scores = np.full(probe.shape, -np.inf)
            scores[r, s] = best[r, first + s] + self.scores[hit]
            single = scores[:, -1] > -np.inf
            scores[~single, -1] = best[~single, end - 1] + self.pieces.unknown_score
            top = scores.argmax(1)
            best[:, end] = scores[rows, top]
            starts[:, end] = first + top
            ids[:, end] = np.where((top == end - first - 1) & ~single, -1, self.ids[at[rows, top]])
        return starts, ids

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and where each word's begin (one more entry at the end)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        out: list = [None] * len(words)
        flat_parts, flat_rows, counts = [], [], np.zeros(len(words), np.int64)
        bounds = np.flatnonzero(np.diff(np.concatenate([[-1], sizes[order], [-1]])))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            length = int(sizes[order[low]])
            step = max(1, PROBES // (min(length, self.pieces.longest) * max(1, length // 8)))
            for begin in range(low, high, step):
                part = order[begin : min(begin + step, high)]
                chars = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                starts, ids = self.equal(chars)
                pos, alive, steps = np.full(len(part), length), np.arange(len(part)), []
                while len(alive):
                    here = pos[alive]
                    back = starts[alive, here]
                    steps.append((alive, ids[alive, here], back))
                    pos[alive] = back
                    alive = alive[back > 0]
                who = np.concatenate([x[0] for x in steps])
                got = np.concatenate([x[1] for x in steps])
                depth = np.repeat(np.arange(len(steps)), [len(x[0]) for x in steps])
                by = np.lexsort((-depth, who))
                who, got = who[by], got[by]
                if (got < 0).any():
                    where = np.concatenate([x[2] for x in steps])[by]
                    unknown = got < 0
                    expanded = [self.pieces.unknown_ids(chr(c)) for c in chars[who[unknown], where[unknown]]]
                    times = np.ones(len(got), np.int64)
                    times[unknown] = [len(x) for x in expanded]
                    who, long = np.repeat(who, times), np.repeat(unknown, times)
                    got = np.repeat(got, times)
                    got[long] = [i for x in expanded for i in x]
                counts[part] = np.bincount(who, minlength=len(part))
                flat_parts.append(got.astype(np.int32))
                flat_rows.append(part)
        del out
        offsets = np.concatenate([[0], np.cumsum(counts)])
        flat = np.empty(offsets[-1], np.int32)
        for got, part in zip(flat_parts, flat_rows, strict=True):
            lengths = counts[part]
            flat[np.repeat(offsets[part] - np.cumsum(lengths) + lengths, lengths) + np.arange(len(got))] = got
        return flat, offsets

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin (one more entry at the end).

        Words stay known from call to call; the table starts anew once it has KEPT_WORDS words or some word is very long.
        """
        counts, numbered, number = [], [], self.known.__getitem__
        for t in texts:
            words = self.pieces.segments(t) if t else []
            counts.append(len(words))
            numbered.append(np.fromiter(map(number, words), np.int32, len(words)))
        segments = np.concatenate(numbered) if numbered else np.zeros(0, np.int32)
        new = list(islice(self.known, len(self.offsets) - 1, None))
        if new:
            flat, offsets = self.words(new)
            self.flat, self.offsets = np.concatenate([self.flat, flat]), np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        lengths = np.diff(self.offsets)[segments]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.offsets[segments] - ends[:-1], lengths) + np.arange(ends[-1])]
        if len(self.known) > KEPT_WORDS or len(self.flat) > KEPT_WORDS * KEPT_LENGTH:
            self.forget()
        return ids, ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, one after another, and where each id's begin; the last entry, for what is no id, is empty."""
    p = load(path)
    each = [b"" if i in p.control else " ⁇ ".encode() if i == p.unknown else bytes([p.byte_of[i]]) if i in p.byte_of else s.replace(SPACE, " ").encode() for i, s in enumerate(p.surface)]
    return np.frombuffer(b"".join(each), np.uint8), np.cumsum([0, *map(len, each), 0])


def decode_ids(ids: np.ndarray, ends: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """Texts of the ids, text i's being ids[ends[i]:ends[i + 1]]: pieces joined, one leading space (the encoder's) taken off; each byte that is not UTF-8 becomes U+FFFD."""
    data, starts = table
    none = len(starts) - 2
    ids = np.where((ids >= 0) & (ids < none), ids, none)
    lengths = np.diff(starts)[ids]
    after = np.concatenate([[0], np.cumsum(lengths)])
    raw = data[np.repeat(starts[ids] - after[:-1], lengths) + np.arange(after[-1])]
    cuts = after[ends]
    led = np.flatnonzero(np.diff(cuts) > 0)
    led = led[raw[cuts[led]] == 32]
    raw = np.delete(raw, cuts[led])
    cuts[1:] -= np.cumsum(np.bincount(led, minlength=len(cuts) - 1))
    joined = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(raw)])
    try:
        return joined.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "latticeframe-each") for x in joined.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the column ids_col, array<int> of the text's token ids; a column of that name is replaced.

    Every row keeps its place and its other columns, repeated rows included; there is no shuffle. A null text has null
    ids, an empty text an empty array; an empty table gives no rows. Characters that no piece covers become byte tokens.
    Ties go as pieces.py says: the file's scores are those of a unigram model, so a file trained as byte pairs gives
    other ids than the library's merges, which decode to the same text.
    """
    rest = [c for c in docs.columns if c != ids_col]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(text_col)
    schema = frame.withColumn(ids_col, F.lit(None).cast("array<int>")).schema

    def run(batches):
        enc = encoder(model)
        for part in slices(batches, at):
            texts = part.column(at).to_pylist()
            ids, ends = enc.texts(texts)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], [*rest, ids_col])

    return frame.mapInArrow(run, schema)


def decode(docs: DataFrame, model: str = DEFAULT_MODEL, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the column text_col, the text of the ids; a column of that name is replaced. Null ids give a null text, unknown ids and null entries nothing; an empty table gives no rows."""
    rest = [c for c in docs.columns if c != text_col]
    frame = docs.select(*[F.col(f"`{c}`") for c in rest])
    at = rest.index(ids_col)
    schema = frame.withColumn(text_col, F.lit(None).cast("string")).schema

    def run(batches):
        table = id_bytes(model)
        for part in slices(batches, at, SLICE_IDS):
            lists = part.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            texts = decode_ids(flat, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), table)
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*part.columns, texts], [*rest, text_col])

    return frame.mapInArrow(run, schema)
