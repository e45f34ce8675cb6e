"""Line dedup: an exact set-similarity join of lines.

A line is the set of its tokens (divided by ASCII white space); its position is (document id, line number). It is
removed if some line at an earlier position, anywhere, has a token set of Jaccard similarity at or above the threshold.

1. Token rarity is counted over all documents in a table of fixed size, indexed by token hash. Any order of tokens is
   right for the prefix filter; hash clashes there only cost speed.
2. Lines of equal sets are grouped by hash, packed by buckets of hashes; all but the first go. A slice of texts sends
   the first of its equal lines only, so a line that is everywhere makes few rows.
3. Each line's rarest tokens, its prefix, go to the tasks that own them, packed by buckets of tokens. There lines that share a prefix token meet in
   order of position, pass the length, positional and parity-bitmap filters, and each line keeps its nearest candidates
   for that token, so that large families of similar lines give few rows a line and not one a pair. Two lines are a
   pair at the first token they share, and at others only after tokens they do not share.
4. Candidates are verified on the hashes of the lines' tokens (64 bits each), first the nearest one of each line, then
   the others of lines that failed. A line whose candidates all fail though it may have more meets all earlier lines of
   those tokens, from the prefix rows, which are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticeframe.llm.common import Tables, bit_table, held, mix, slices, word_hashes

COUNT_BITS = 24
CHUNK_BITS = 14
GROUP_ROWS = 4_096
NEAREST = 3
NULL_ID = -(2**63)
PREFIX_NAMES = ["tok", "doc", "line", "n", "at", "bits", "more"]
PREFIX = "tok long, doc long, line int, n int, at int, bits long, more long"
LINE_NAMES = ["sig", "bits", "n", "doc", "line"]


def need(n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """The least overlap of sets of n and m tokens at the threshold."""
    return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9)


def prefix_length(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


class Lines:
    """The lines of a column of texts: row and number of each, which distinct line it is, and the distinct lines' tokens as places in hashes.

    wanted: called before lines are divided into tokens; says of which distinct lines tokens are wanted.
    """

    def __init__(self, texts: pa.Array, wanted=None):
        per_text = pc.split_pattern(pc.fill_null(texts, "").cast(pa.large_string()), "\n")
        counts = np.diff(per_text.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.number = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        encoded = per_text.flatten().dictionary_encode()
        self.distinct, self.n_lines = encoded.indices.to_numpy(), len(encoded.dictionary)
        some = np.arange(self.n_lines) if wanted is None else np.flatnonzero(wanted(self))
        tokens = pc.ascii_split_whitespace(encoded.dictionary.take(pa.array(some)) if len(some) < self.n_lines else encoded.dictionary)
        words = tokens.flatten().dictionary_encode()
        self.code = words.indices.to_numpy()
        self.owner = np.repeat(some, np.diff(tokens.offsets.to_numpy()))
        self.hashes = word_hashes(words.dictionary)
        empty = pc.index(words.dictionary, pa.scalar("", words.dictionary.type)).as_py()
        if empty >= 0:
            full = self.code != empty
            self.code, self.owner = self.code[full], self.owner[full]


SURVEY = {"kind": pa.int32(), "place": pa.int64(), "total": pa.int64(), "doc": pa.int64(), "line": pa.int32(), "to_doc": pa.int64(), "to_line": pa.int32(), "packed": pa.binary()}
SURVEYED = "kind int, place long, total long, doc long, line int, to_doc long, to_line int, packed binary"
REPEATED, FIRSTS, COUNTS = range(3)


def survey_rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    """n rows SURVEYED of a kind; columns not given are null."""
    arrays = {k: pa.array(v, SURVEY[k]) for k, v in columns.items()} | {"kind": pa.array(np.full(n, kind, np.int32))}
    return pa.RecordBatch.from_arrays([arrays[k] if k in arrays else pa.nulls(n, t) for k, t in SURVEY.items()], list(SURVEY))


def set_keys(lines: Lines, rank: np.ndarray | None = None):
    """Of the distinct lines with tokens: their numbers, sizes, set hashes and the two words of their parity bitmaps, and the (line, token) rows by line, and by rank if given: line's place, place in the line, token."""
    words = len(lines.hashes)
    number = rank if rank is not None else np.arange(words)
    rows = np.sort(lines.owner.astype(np.int64) << 32 | number[lines.code])
    rows = rows[np.concatenate([[True], rows[1:] != rows[:-1]])] if len(rows) else rows
    owner, word = rows >> 32, rows & 0xFFFFFFFF
    if rank is not None:
        back = np.empty(words, np.int64)
        back[rank] = np.arange(words)
        word = back[word]
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(rows) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(rows)]]))
    with np.errstate(over="ignore"):
        sig = np.add.reduceat(mix(lines.hashes, 1)[word], start)
    flip = mix(lines.hashes, 2) >> np.uint64(57)  # which of 128 bits a token flips
    one = np.uint64(1) << (flip & np.uint64(63))
    bits = np.bitwise_xor.reduceat(np.where(flip < 64, one, 0).astype(np.uint64)[word], start)
    more = np.bitwise_xor.reduceat(np.where(flip < 64, 0, one).astype(np.uint64)[word], start)
    place = np.repeat(np.arange(len(start)), size)
    return owner[start], size, sig.view(np.int64), bits.view(np.int64), more.view(np.int64), place, np.arange(len(rows)) - np.repeat(start, size), word


def survey(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """One pass over all texts. Rows SURVEYED. FIRSTS: packed, the lines with tokens that are the first of their kind in their slice, by buckets of set hashes (place). REPEATED: a row for each other line and the place of that first. COUNTS: a task's token counts (equal lines of a slice counted once), the number of the chunk in place."""

    def flush(rows):
        now = joined(rows, LINE_NAMES)
        bucket = now["sig"] % buckets
        place, packed = packs(now, bucket, np.argsort(bucket, kind="stable"))
        return survey_rows(FIRSTS, len(place), place=place, packed=packed)

    def run(batches):
        counts = np.zeros(1 << COUNT_BITS, np.uint16)  # of the task, which is enough to tell rare tokens from common ones
        rows, n = [], 0
        for part in slices(batches, 1):
            lines = Lines(part.column(1))
            if not len(lines.code):
                continue
            bucket = np.sort((lines.hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)[lines.code])
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            times = np.diff(np.concatenate([first, [len(bucket)]]))
            counts[bucket[first]] = np.minimum(counts[bucket[first]] + times, 65_535)
            which, size, sig, bits, *_ = set_keys(lines)
            slot = np.full(lines.n_lines, -1)
            slot[which] = np.arange(len(which))
            row = np.flatnonzero(slot[lines.distinct] >= 0)
            own = slot[lines.distinct[row]]
            doc = pc.fill_null(part.column(0), NULL_ID).to_numpy(zero_copy_only=False)[lines.row[row]]
            line = lines.number[row].astype(np.int32)
            at, is_head, by = firsts(sig[own], bits[own], size[own], doc, line)
            own, doc, line = own[by], doc[by], line[by]
            away = (doc != doc[at]) | (line != line[at])
            if away.any():
                yield survey_rows(REPEATED, int(away.sum()), doc=doc[away], line=line[away], to_doc=doc[at][away], to_line=line[at][away])
            own = own[is_head]
            rows.append({"sig": sig[own], "bits": bits[own], "n": size[own].astype(np.int32), "doc": doc[is_head], "line": line[is_head]})
            n += len(own)
            if n >= PACKED_ROWS:
                yield flush(rows)
                n = 0
        if n:
            yield flush(rows)
        chunks = counts.reshape(-1, 1 << CHUNK_BITS)
        some = np.flatnonzero(chunks.any(1))
        for low in range(0, len(some), 64):
            now = some[low : low + 64]
            yield survey_rows(COUNTS, len(now), place=now, packed=[zstandard.compress(chunks[i].tobytes(), 1) for i in now])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(run, SURVEYED)


def firsts(sig, bits, n, doc, line) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of lines by set and position; for each in that order the place of the first line of its set there; and whether it is that line. Lines that differ may have equal sets."""
    by = np.lexsort((line, doc, n, bits, sig))
    is_head = np.concatenate([[True], np.any([x[by[1:]] != x[by[:-1]] for x in (sig, bits, n)], axis=0)])
    head = np.flatnonzero(is_head)
    return np.repeat(head, np.diff(np.append(head, len(by)))), is_head, by


def equal_lines(surveyed: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Rows SURVEYED of a survey's FIRSTS. REPEATED: the lines of a set but the first, and its place. FIRSTS: all others, packed, doc and line only; total is how many prefix rows they have, about."""

    def run(batches):
        for bucket, now in by_bucket(((k, p) for b in batches for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True)), LINE_NAMES):
            at, _, by = firsts(*[now[k] for k in LINE_NAMES])
            doc, line, n = now["doc"][by], now["line"][by], now["n"][by]
            away = (doc != doc[at]) | (line != line[at])
            if away.any():
                yield survey_rows(REPEATED, int(away.sum()), doc=doc[away], line=line[away], to_doc=doc[at][away], to_line=line[at][away])
            yield survey_rows(FIRSTS, 1, place=[bucket], total=[int((n[~away] * (1 - threshold) + 1).sum())], packed=[pack_rows({"doc": doc[~away], "line": line[~away]})])

    rows = surveyed.where(f"kind = {FIRSTS}").select("place", "packed")
    return rows.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(run, SURVEYED)


def rarity(surveyed: DataFrame, partitions: int) -> np.ndarray:
    """For each hash bucket of tokens how often they occur, over all texts, as 8 log2 of the count; 0 for once or never. An array of fixed size, whatever the input."""

    def run(batches):
        last, total = None, None
        for b in batches:
            for chunk, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if chunk != last and last is not None:
                    yield done(last, total)
                if chunk != last:
                    last, total = chunk, np.zeros(1 << CHUNK_BITS, np.int64)
                total += np.frombuffer(zstandard.decompress(packed.as_buffer()), np.uint16)
        if last is not None:
            yield done(last, total)

    def done(chunk, total):
        scaled = np.minimum(np.round(8 * np.log2(np.maximum(total, 1))), 255).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([zstandard.compress(scaled.tobytes(), 1)], pa.binary())], ["place", "packed"])

    rows = surveyed.where(f"kind = {COUNTS}").select("place", "packed").repartition(partitions, "place").sortWithinPartitions("place")
    got = rows.mapInArrow(run, "place long, packed binary").toArrow()
    out = np.zeros((1 << (COUNT_BITS - CHUNK_BITS), 1 << CHUNK_BITS), np.uint8)
    for chunk, packed in zip(got["place"].to_pylist(), got["packed"], strict=True):
        out[chunk] = np.frombuffer(zstandard.decompress(packed.as_buffer()), np.uint8)
    return out.ravel()


def token_key(hashes: np.ndarray) -> np.ndarray:
    """What stands for a token in the prefix rows: 40 bits of its hash. A clash lets lines meet in vain, and no more."""
    return hashes >> np.uint64(24)


PACKED_ROWS = 150_000
BUCKET_ROWS = 200_000
MEETINGS = 1_000_000
NEAR_ROWS = 100_000
HOT = 8 * 19  # tokens counted 2 ** 19 times or more
ROW_NAMES = [*PREFIX_NAMES, "prev"]  # prev: the token of the line's prefix row before, or -1
PACKED = "bucket int, packed binary, " + PREFIX + ", prev long"
KINDS = dict(zip(PREFIX_NAMES, (np.int64, np.int64, np.int32, np.int32, np.int32, np.int64, np.int64), strict=True)) | {"prev": np.int64, "sig": np.int64}


def pack_rows(rows: dict[str, np.ndarray]) -> bytes:
    """Rows by column and byte, compressed; tokens, which lie in order, as steps."""
    parts = [np.diff(x, prepend=0) if k == "tok" else x for k, x in rows.items()]
    return zstandard.compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in parts), 1)


def unpack_rows(packed: bytes, names: list[str], of=None) -> dict[str, np.ndarray]:
    """of: which rows to take, given their tokens, the first column; only of these the others are unpacked."""
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n, low, out, some = len(data) // sum(np.dtype(KINDS[k]).itemsize for k in names), 0, {}, None
    for k in names:
        width = np.dtype(KINDS[k]).itemsize
        column = data[low : low + n * width].reshape(width, n)
        out[k] = np.ascontiguousarray((column if some is None else column[:, some]).T).view(KINDS[k]).ravel()
        low += n * width
        if k == "tok":
            out[k] = np.cumsum(out[k])
            if of is not None:
                some = np.flatnonzero(of(out[k]))
                out[k] = out[k][some]
    return out


def joined(rows: list[dict[str, np.ndarray]], names) -> dict[str, np.ndarray]:
    """The rows as one, taken out of the list."""
    now = {k: np.concatenate([r.pop(k) for r in rows]) for k in names}
    rows.clear()
    return now


def packs(now: dict[str, np.ndarray], bucket: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For rows in an order in which buckets lie together: the buckets, and a packed row for each."""
    at = bucket[order]
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    now, ends = {k: x[order] for k, x in now.items()}, [*start[1:].tolist(), len(at)]
    return at[start], [pack_rows({k: x[low:high] for k, x in now.items()}) for low, high in zip(start.tolist(), ends, strict=True)]


def by_bucket(pairs, names: list[str]):
    """Of (bucket, packed) pairs that lie by bucket: each bucket and its rows."""
    last, rows = None, []
    for bucket, packed in pairs:
        if rows and bucket != last:
            yield last, joined(rows, names)
        last = bucket
        rows.append(unpack_rows(packed.as_buffer(), names))
    if rows:
        yield last, joined(rows, names)


def packed_batch(bucket, packed: list[bytes], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(packed, pa.binary()), *[pa.nulls(len(packed), pa.from_numpy_dtype(KINDS[k])) for k in names]], ["bucket", "packed", *names])


def pack_prefixes(batches, hot: np.ndarray, buckets: int):
    """Rows PACKED of batches of prefix rows: for many rows at a time one packed row for each bucket of tokens, and as they are, in buckets below 0, the rows of tokens whose place in the count table is set in hot, which may be too many for one task's memory."""

    def flush(rows, names):
        now = joined(rows, names)
        plain = hot[now["tok"] >> (40 - COUNT_BITS)]
        bucket = (now["tok"] % buckets).astype(np.int32)
        if plain.any():
            n = int(plain.sum())
            yield pa.RecordBatch.from_arrays([pa.array(-1 - bucket[plain]), pa.nulls(n, pa.binary()), *[pa.array(now[k][plain]) for k in names]], ["bucket", "packed", *names])
        order = np.argsort(bucket.astype(np.int64) << 40 | now["tok"], kind="stable")
        order = order[~plain[order]]
        if len(order):
            yield packed_batch(*packs(now, bucket, order), names)

    rows, n, names = [], 0, PREFIX_NAMES
    for b in batches:
        names = b.schema.names
        rows.append({k: b.column(i).to_numpy() for i, k in enumerate(names)})
        n += b.num_rows
        if n >= PACKED_ROWS:
            yield from flush(rows, names)
            n = 0
    if n:
        yield from flush(rows, names)


def unpack_prefixes(batches):
    """Batches of prefix rows by token and position, of rows PACKED that lie by bucket, token and position."""

    def together(held):
        names, now = list(held[0]), joined(held, list(held[0]))
        by = np.lexsort((now["line"], now["doc"], now["tok"]))
        return pa.RecordBatch.from_arrays([pa.array(now[k][by]) for k in names], names)

    last, held = None, []
    for b in batches:
        names = b.schema.names[2:]
        plain = b.filter(pc.is_null(b.column(1)))
        if plain.num_rows:
            yield pa.RecordBatch.from_arrays(plain.columns[2:], names)
        for bucket, packed in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if packed.is_valid:
                if held and bucket != last:
                    yield together(held)
                last = bucket
                held.append(unpack_rows(packed.as_buffer(), names))
    if held:
        yield together(held)


def prefix_rows(docs: DataFrame, counts, threshold: float, id_col: str, text_col: str, gone, but, buckets: int) -> DataFrame:
    """Rows PACKED for the lines' prefix tokens, once for equal lines of a batch. Broadcast bit tables: lines in gone, unless in but, are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(zstandard.compress(counts.tobytes(), 1))  # of fixed size
    # a set of up to least - 1 tokens is similar to no other set
    least = int(np.ceil(threshold / (1 - threshold) - 1e-9))

    def stays(lines, doc, places):
        """Which distinct lines are not gone; adds to places where each is first."""
        by = np.lexsort((lines.number, doc[lines.row]))
        first = np.empty(lines.n_lines, np.int64)
        first[lines.distinct[by][::-1]] = by[::-1]
        places.append(first)
        at_line = line_hash(doc[lines.row[first]], lines.number[first])
        return ~(held(gone.value, at_line) & ~held(but.value, at_line))

    def run(batches, counts):
        for part in slices(batches, 1):
            doc = pc.fill_null(part.column(0), NULL_ID).to_numpy(zero_copy_only=False)
            first = []
            lines = Lines(part.column(1), lambda lines, doc=doc, first=first: stays(lines, doc, first))
            if not len(lines.code):
                continue
            first = first[0]
            times = counts[(lines.hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            order = np.argsort((times.astype(np.uint64) << np.uint64(56)) | (lines.hashes >> np.uint64(8)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            which, size, _, bits, more, place, at, word = set_keys(lines, rank)
            # a token counted once is in one line only
            good = np.flatnonzero((at < prefix_length(size, threshold)[place]) & (times[word] > 0) & (size >= least)[place])
            p, line = place[good], first[which[place[good]]]
            tok = token_key(lines.hashes)[word[good]].view(np.int64)
            prev = np.concatenate([[-1], np.where(p[1:] == p[:-1], tok[:-1], -1)])[: len(tok)]
            arrays = [tok, doc[lines.row[line]], lines.number[line].astype(np.int32), size[p].astype(np.int32), at[good].astype(np.int32), bits[p], more[p], prev]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ROW_NAMES)

    def packed(batches):
        counts = np.frombuffer(zstandard.decompress(shared.value), np.uint8)
        is_hot = counts >= hot if counts.max() >= hot else np.zeros(len(counts), bool)  # untouched zeros take no memory
        yield from pack_prefixes(run(batches, counts), is_hot, buckets)

    hot = HOT
    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(packed, PACKED)


def passes(n, at, m, bt, differ, threshold: float) -> np.ndarray:
    """Length, positional and parity-bitmap filters; no pair at the threshold fails them at the first token it shares."""
    overlap = need(n, m, threshold)
    fits = (np.minimum(n, m) >= np.ceil(threshold * np.maximum(n, m) - 1e-9)) & (1 + np.minimum(n - at - 1, m - bt - 1) >= overlap)
    return fits & (differ <= n + m - 2 * overlap)


def passes_sql(threshold: float) -> str:
    """The same, and the rule of meets(), for rows x and y of the prefix table."""
    overlap = f"ceil({threshold / (1 + threshold)!r} * (x.n + y.n) - 1e-9)"
    return (
        f"least(x.n, y.n) >= ceil({threshold!r} * greatest(x.n, y.n) - 1e-9) and 1 + least(x.n - x.at - 1, y.n - y.at - 1) >= {overlap}"
        " and (x.prev < 0 or x.prev <> y.prev)"
        f" and bit_count(x.bits ^ y.bits) + bit_count(x.more ^ y.more) <= x.n + y.n - 2 * {overlap} and (y.doc < x.doc or (y.doc = x.doc and y.line < x.line))"
    )


def meets(columns: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows x and y of a token pass, and how many bits they differ in. Rows with the same token before have met there, and passed if they would here."""
    n, at, bits, more, prev = (columns[k] for k in ("n", "at", "bits", "more", "prev"))
    differ = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(more[x] ^ more[y])
    return passes(n[x], at[x], n[y], at[y], differ, threshold) & ((prev[x] < 0) | (prev[x] != prev[y])), differ


def wide(b: pa.RecordBatch) -> dict[str, np.ndarray]:
    """The columns of prefix rows; without prev none has a token before."""
    now = {k: b.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(b.schema.names)}
    return now if "prev" in now else now | {"prev": np.full(b.num_rows, -1)}


def unsigned(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """With numbers to reckon with: bits unsigned, sizes and places wide."""
    return columns | {k: columns[k].astype(np.int64) for k in ("n", "at")} | {k: columns[k].view(np.uint64) for k in ("bits", "more")}


def most_bits(n: np.ndarray, threshold: float) -> np.ndarray:
    """The most bits that a set of n tokens and another one may differ in and pass: the other has n / threshold tokens at most."""
    return np.minimum((1 - threshold) / threshold * n + 1e-6, 128).astype(np.uint8)


def near(columns: dict[str, np.ndarray], start: np.ndarray, size: np.ndarray, threshold: float):
    """Rows x and earlier rows y of their tokens that differ in no more bits than most_bits(x), in parts of some NEAR_ROWS pairs or more; size: of a row's token, 0 for rows to leave out.

    All rows are compared with the rows k places before, for one k after the other; large tokens lie first, so those with more than k rows lie together.
    """
    order = np.argsort(-size, kind="stable")
    order = order[: np.count_nonzero(size)]
    bits, more, depth = columns["bits"][order], columns["more"][order], (np.arange(len(start)) - start)[order]
    most = most_bits(columns["n"][order], threshold)
    last = np.searchsorted(-size[order], -np.arange(size.max(initial=0)))  # rows of tokens with more than k rows
    found, n = [], 0
    for k in range(1, len(last)):
        high = last[k]
        differ = np.bitwise_count(bits[k:high] ^ bits[: high - k])
        differ += np.bitwise_count(more[k:high] ^ more[: high - k])
        hit = np.flatnonzero((differ <= most[k:high]) & (depth[k:high] >= k))
        if len(hit):
            found.append((order[hit + k], order[hit]))
            n += len(hit)
        if n >= NEAR_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))
            found, n = [], 0
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest(row: np.ndarray, to: np.ndarray, far: np.ndarray, best: np.ndarray, least: np.ndarray) -> None:
    """Adds rows' candidates to those in best and least: the nearest stay, of equally near ones the earliest."""
    rows = np.unique(row)
    held_row, slot = np.nonzero(best[rows] >= 0)
    held_row = rows[held_row]
    row, to, far = (np.concatenate(x) for x in ((row, held_row), (to, best[held_row, slot]), (far, least[held_row, slot])))
    by = np.lexsort((to, far, row))
    row, to, far = row[by], to[by], far[by]
    first = np.maximum.accumulate(np.where(np.concatenate([[True], row[1:] != row[:-1]]), np.arange(len(row)), 0))
    slot = np.arange(len(row)) - first
    stays = slot < NEAREST
    best[row[stays], slot[stays]], least[row[stays], slot[stays]] = to[stays], far[stays]


def meet(columns: dict[str, np.ndarray], known: int, threshold: float, cut: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows by token and position: of the earlier rows of its token that pass, the NEAREST ones by bitmap, or -1; how many bits they differ in; and whether there may be more.

    Rows before known are only candidates; cut: between them and the next row, earlier rows of their token are left out.
    A row meets the first GROUP_ROWS rows of its token.
    """
    tok, columns = columns["tok"], unsigned(columns)
    rows = np.arange(len(tok))
    head = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
    size = np.diff(np.append(head, len(tok)))
    start, size = np.repeat(head, size), np.repeat(size, size)
    best, least = np.full((len(tok), NEAREST), -1), np.full((len(tok), NEAREST), 1 << 20)
    passed = np.zeros(len(tok), np.int64)
    depth = rows - start

    def add(x, y):
        hit, differ = meets(columns, x, y, threshold)
        if hit.any():
            x, y, differ = x[hit], y[hit], differ[hit]
            np.add.at(passed, x, 1)
            nearest(x, y, differ, best, least)

    for x, y in near(columns, start, np.where((size > 1) & (size <= GROUP_ROWS), size, 0), threshold):
        add(x[x >= known], y[x >= known])
    alive = rows[(size > GROUP_ROWS) & (depth > 0) & (rows >= known)]
    k = 0
    while len(alive):  # the k-th row of each large group against all rows after it
        add(alive, start[alive] + k)
        k += 1
        alive = alive[depth[alive] > k] if k < GROUP_ROWS else alive[:0]
    unmet = (depth > GROUP_ROWS) | (cut & (start == 0) & (rows >= known))
    return best, least, (passed > NEAREST) | unmet


CANDIDATES = PREFIX + ", prev long, to_doc long, to_line int, far int, more_to boolean"


def candidates(prefixes: DataFrame, threshold: float, packed: bool = False) -> DataFrame:
    """Rows CANDIDATES, from prefix rows that lie by token and position in their partitions, or if packed from rows PACKED by bucket, token and position: one for each candidate kept, far being the bits in which it differs.

    more_to: there may be further earlier rows of the token that pass the filters; without a candidate kept to_doc is
    null. Of the prefix row all but doc and line is null unless more_to is set.
    """
    names = ROW_NAMES

    def run(batches):
        last, cut = None, False  # the first rows of the group that the last batch ended in, and whether it had more
        for b in unpack_prefixes(batches) if packed else batches:
            now = wide(b)
            known = 0
            if last is not None and b.num_rows and last["tok"][0] == now["tok"][0]:
                known = len(last["tok"])
                now = {k: np.concatenate([last[k], now[k]]) for k in names}
            if not len(now["tok"]):
                continue
            best, differ, part = meet(now, known, threshold, cut and known > 0)
            for slot in range(NEAREST):
                more = part & (slot == 0)
                some = np.flatnonzero((best[:, slot] >= 0) | more)
                to, plain = best[some, slot], ~more[some]
                ends = [pa.array(now["doc"][to], mask=to < 0), pa.array(now["line"][to], mask=to < 0), pa.array(differ[some, slot].astype(np.int32)), pa.array(~plain)]
                yield pa.RecordBatch.from_arrays([*[pa.array(now[c][some], mask=None if c in ("doc", "line") else plain) for c in names], *ends], [*names, "to_doc", "to_line", "far", "more_to"])
            low = int(np.searchsorted(now["tok"], now["tok"][-1]))
            cut = len(now["tok"]) - low > GROUP_ROWS or (cut and known > 0 and low == 0)
            last = {k: now[k][low : low + GROUP_ROWS] for k in names}

    return prefixes.mapInArrow(run, CANDIDATES)


def row_hash(tok: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(tok.view(np.uint64), 53) ^ line_hash(doc, line)


def of_tokens(prefixes: DataFrame, tokens) -> DataFrame:
    """Of rows PACKED those of the tokens in a bit table, and of few others."""

    def run(batches):
        for b in batches:
            names, packed, bucket = b.schema.names[2:], [], []
            plain = b.filter(pc.is_null(b.column(1)))
            if plain.num_rows:
                yield plain.filter(pa.array(held(tokens.value, plain.column(2).to_numpy().view(np.uint64))))
            for k, p in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if p.is_valid:
                    now = unpack_rows(p.as_buffer(), names, lambda tok: held(tokens.value, tok.view(np.uint64)))
                    if len(now["tok"]):
                        bucket.append(k)
                        packed.append(pack_rows(now))
            if packed:
                yield packed_batch(bucket, packed, names)

    return prefixes.mapInArrow(run, PACKED)


def earlier_rows(prefixes: DataFrame, left, threshold: float) -> DataFrame:
    """Rows (tok, doc, line, to_doc, to_line), from rows PACKED by bucket that are packed: for the rows in a bit table, and few others, all earlier rows of their token that pass."""

    def run(batches):
        for b in unpack_prefixes(batches):
            now = wide(b)
            tok, doc, line, columns = now["tok"], now["doc"], now["line"], unsigned(now)
            rows = np.arange(len(tok))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], tok[1:] != tok[:-1]]), rows, 0))
            rows = np.flatnonzero(held(left.value, row_hash(tok, doc, line)))
            depth = rows - start[rows]
            ends, low = np.cumsum(depth), 0
            while low < len(rows):
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + MEETINGS, "right")))
                d = depth[low:high]
                x, y = np.repeat(rows[low:high], d), np.arange(d.sum()) - np.repeat(np.cumsum(d) - d, d) + np.repeat(start[rows[low:high]], d)
                hit = meets(columns, x, y, threshold)[0] & ((doc[x] != doc[y]) | (line[x] != line[y]))
                x, y = x[hit], y[hit]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (tok[x], doc[x], line[x], doc[y], line[y])], ["tok", "doc", "line", "to_doc", "to_line"])
                low = high

    return prefixes.mapInArrow(run, "tok long, doc long, line int, to_doc long, to_line int")


def key_of(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))


def line_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.astype(np.int64).view(np.uint64), 52) ^ line.astype(np.uint64)


def doubtful(firsts: DataFrame, table) -> DataFrame:
    """(doc, line) of the lines, packed in rows SURVEYED, that a bit table of others takes for its own."""

    def run(batches):
        for b in batches:
            for packed in b.column(0):
                now = unpack_rows(packed.as_buffer(), ["doc", "line"])
                some = held(table.value, line_hash(now["doc"], now["line"]))
                yield pa.RecordBatch.from_arrays([pa.array(now["doc"][some]), pa.array(now["line"][some])], ["doc", "line"])

    return firsts.select("packed").mapInArrow(run, "doc long, line int")


def ends_of(pairs: DataFrame):
    """A function of line hashes: which are of later and which of earlier lines of pairs, and few others, by broadcast bit tables of bounded size."""
    share = pairs.sparkSession.sparkContext.broadcast
    later = share(bit_table(pairs.select("doc", "line"), line_hash))
    earlier = share(bit_table(pairs.select("to_doc", "to_line"), line_hash))
    return lambda at: (held(later.value, at), held(earlier.value, at))


SETS = "doc long, line int, later boolean, earlier boolean, tokens array<long>"


def line_sets(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows SETS with the sorted token hashes of the lines in pairs, and of few others that a bit table lets out of the scan; later, earlier: at which ends."""
    ends = ends_of(pairs)

    def run(batches):
        for part in slices(batches, 1):
            per_text = pc.split_pattern(pc.fill_null(part.column(1), "").cast(pa.large_string()), "\n")
            counts = np.diff(per_text.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), counts)
            number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            doc = pc.fill_null(part.column(0), NULL_ID).to_numpy(zero_copy_only=False)[row]
            later, earlier = ends(line_hash(doc, number))
            hit = np.flatnonzero(later | earlier)
            if not len(hit):
                continue
            words = pc.ascii_split_whitespace(per_text.flatten().take(pa.array(hit)))
            hashes = word_hashes(words.flatten())
            owner = np.repeat(np.arange(len(hit)), np.diff(words.offsets.to_numpy()))
            full = pc.not_equal(words.flatten(), "").to_numpy(zero_copy_only=False)
            hashes, owner = hashes[full], owner[full]
            by = np.lexsort((hashes, owner))
            hashes, owner = hashes[by], owner[by]
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])[: len(hashes)]
            ends_at = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(hit)))])
            lists = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(hashes[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(number[hit].astype(np.int32)), pa.array(later[hit]), pa.array(earlier[hit]), lists], ["doc", "line", "later", "earlier", "tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), text_col).mapInArrow(run, SETS)


def some_of(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the lines in pairs and of few others."""
    ends = ends_of(pairs)

    def run(batches):
        for b in batches:
            later, earlier = ends(line_hash(b.column(0).to_numpy(), b.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(later), pa.array(earlier), b.column(4)], b.schema.names).filter(pa.array(later | earlier))

    return sets.mapInArrow(run, SETS)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (doc, line, to_doc, to_line) whose token sets reach the threshold."""
    left = pairs.join(sets.where("later").select("doc", "line", "tokens"), ["doc", "line"])
    right = sets.where("earlier").select(F.col("doc").alias("to_doc"), F.col("line").alias("to_line"), F.col("tokens").alias("to_tokens"))
    both = left.join(right, ["to_doc", "to_line"])
    shared = F.size(F.array_intersect("tokens", "to_tokens"))
    return both.where(shared >= F.ceil(F.lit(threshold) * (F.size("tokens") + F.size("to_tokens") - shared) - 1e-9)).select("doc", "line", "to_doc", "to_line").distinct()


def repeated_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, line, to_id, to_line), one for each line to remove: its place, and that of an earlier line that it repeats.

    Lines end at "\\n"; numbers start at 0. Lines without tokens are never removed. Ids are integers; a null id comes
    before all others. Rows that share an id count as one document: a line number removed in one is removed in all, and
    equal lines at one place do not remove each other. Null texts are empty. Among several earlier lines the one given
    is the earliest found, of an equal set if there is one. An empty table gives no rows. Sets are compared by 64-bit
    hashes of their tokens, equal sets by hashes of 128 bits and their size.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    surveyed = tables.keep(survey(docs, id_col, text_col, max(256, 4 * parts)))
    grouped = tables.keep(equal_lines(surveyed, parts, threshold))
    repeated = [x.where(f"kind = {REPEATED}").select("doc", "line", "to_doc", "to_line") for x in (surveyed, grouped)]
    found = tables.keep(repeated[0].unionByName(repeated[1]))
    if threshold < 1:
        counts = rarity(surveyed, parts)
        tables.drop(surveyed)
        share = spark.sparkContext.broadcast
        firsts = grouped.where(f"kind = {FIRSTS}")
        gone = share(bit_table(found.select("doc", "line"), line_hash))
        but = share(bit_table(doubtful(firsts, gone), line_hash))
        most = firsts.agg(F.sum("total")).first()[0] or 0  # prefix rows, about
        buckets = max(4 * parts, int(most / BUCKET_ROWS) + 1)
        prefixes = tables.keep(prefix_rows(docs, counts, threshold, id_col, text_col, gone, but, buckets), "uncompressed")  # packed already
        rows = tables.keep(candidates(prefixes.repartition(parts, "bucket").sortWithinPartitions("bucket", "tok", "doc", "line"), threshold, packed=True))
        pairs = rows.where("to_doc is not null").select("doc", "line", "to_doc", "to_line", "far")
        sets = tables.keep(line_sets(docs, pairs, id_col, text_col))
        nearest = pairs.groupBy("doc", "line").agg(F.min(F.struct("far", "to_doc", "to_line")).alias("to")).select("doc", "line", "to.to_doc", "to.to_line")
        true = tables.keep(verified(nearest, sets, threshold))
        ok = true.select("doc", "line")
        others = tables.keep(pairs.drop("far").join(ok, ["doc", "line"], "left_anti").distinct())
        few = tables.keep(some_of(sets, others))  # both sides of the join read it
        true = tables.keep(true.unionByName(verified(others, few, threshold)))
        found = found.unionByName(true)
        left = tables.keep(rows.where("more_to").select(*ROW_NAMES).join(true.select("doc", "line").distinct(), ["doc", "line"], "left_anti").select(*ROW_NAMES).distinct())
        if not left.isEmpty():
            tokens = share(bit_table(left.select("tok").distinct(), lambda tok: tok.view(np.uint64)))
            mine = share(bit_table(left.select("tok", "doc", "line"), row_hash))
            met = of_tokens(prefixes.where("packed is not null"), tokens).repartition(parts, "bucket").sortWithinPartitions("bucket")
            again = earlier_rows(met, mine, threshold).join(left.select("tok", "doc", "line"), ["tok", "doc", "line"], "left_semi").drop("tok")
            if counts.max() >= HOT:
                earlier = of_tokens(prefixes.where("packed is null"), tokens)
                again = again.unionByName(left.alias("x").join(earlier.alias("y"), F.expr(f"x.tok = y.tok and {passes_sql(threshold)}")).select("x.doc", "x.line", F.col("y.doc").alias("to_doc"), F.col("y.line").alias("to_line")))
            again = tables.keep(again.distinct().join(others, ["doc", "line", "to_doc", "to_line"], "left_anti"))
            sets = tables.keep(line_sets(docs, again, id_col, text_col))  # both sides of the join read it
            found = found.unionByName(verified(again, sets, threshold))
    best = found.groupBy("doc", "line").agg(F.min(F.struct("to_doc", "to_line")).alias("to"))
    name = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return best.select(name("doc").alias(id_col), "line", name("to.to_doc").alias(f"to_{id_col}"), F.col("to.to_line").alias("to_line"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without repeated lines, with the column lines_removed (a column of that name is replaced).

    The other columns stay as they are. A document that has lost all its lines with tokens goes; one that had none to
    begin with, null texts too, stays as it is. What counts as repeated: see repeated_lines.
    """
    columns = [c for c in docs.columns if c != "lines_removed"]
    gone = repeated_lines(docs, threshold, id_col, text_col).groupBy(key_of(id_col).alias("doc")).agg(F.collect_list("line").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), key_of(id_col).alias("doc"), F.split(F.col(text_col), "\n").alias("lines"))
    rows = rows.join(gone, "doc", "left").withColumn("kept", F.expr("filter(lines, (line, i) -> not array_contains(gone, i))"))
    rows = rows.where(F.col("gone").isNull() | F.exists("kept", lambda line: line.rlike(r"\S")))
    text = F.when(F.col("gone").isNull(), F.col(f"row.{text_col}")).otherwise(F.array_join("kept", "\n"))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns], F.coalesce(F.size("gone"), F.lit(0)).alias("lines_removed"))
