"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The field tags whitespace tokens as outside, begin or inside of a secret. A token's scores come from its own shape,
from the words beside it and from features of its file. Training maximises the likelihood on a bounded sample whose
tags are the pattern matches, each of which also teaches without its keyword and in other company, so that the field
finds what the patterns miss; unusual tokens that match no pattern teach what no secret is. Decoding is Viterbi over
whole texts. A token whose "outside" score leads by more than
transitions could ever return is outside on every best path, so Viterbi runs only over the stretches between such tokens.
"""

from __future__ import annotations

import hashlib
import re
import string
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticeframe.llm.common import slices
from latticeframe.llm.quality import spread

# Fixed patterns: kinds in their order, and the least lengths of what they must match.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_ADDED = 6, 20, 8

O, B, I = 0, 1, 2
SLOTS = 9  # features of a token
KEPT_LENGTH = 64
EDGES = "\"'`,;:()[]{}<>=.!?*&%$#|"


def has_keyword(text: str) -> bool:
    low = text.lower()
    return any(k in low for k in KEYWORDS)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, kind's number, ...) of all pattern matches as (start, end, kind, start of the secret itself), ordered by start and kind."""
    out = []
    if has_keyword(text):
        out += [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Shapes(dict):
    """Character classes for str.translate: A upper, a lower, 9 digit, f hexadecimal letter, u other letter; the rest stands for itself."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = s = "9" if c.isdigit() else "f" if c in "abcdef" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else ("u" if c.isalpha() else c)
        return s


SHAPES = Shapes()
RUNS = re.compile(r"(.)\1+", re.DOTALL)
MIXED = re.compile("[af]+")


def signature(word: str) -> str:
    """A token's shape: classes with runs shortened, a length class, and for long tokens whether letters and digits alternate."""
    s = word.translate(SHAPES)
    size = min(len(word).bit_length(), 8)
    if size < 5:
        return f"{size}{RUNS.sub(r'\1', MIXED.sub('a', s))[:8]}"
    kinds = "".join(sorted(set(s)))
    swaps = len(RUNS.sub(r"\1", s.replace("f", "a"))) - 1
    return f"{size}{kinds if len(kinds) < 8 else '*'}:{min(swaps * 4 // len(s), 4)}"


def plain(word: str) -> str:
    """A word as its neighbours see it."""
    return word.strip(EDGES).lower() or word[:2]


def own_features(sig: str) -> list[str]:
    digits, letters = "9" in sig[1:], any(c in sig for c in "afAu")
    return [f"s={sig}", f"len={sig[0]}", f"kinds={''.join(sorted(set(sig[1:])))}", f"mixed={digits}{letters}{sig[0] > '4'}"]


def file_features(text: str, n_tokens: int) -> list[str]:
    return [f"size={min(n_tokens.bit_length(), 12)}", f"keyword={has_keyword(text)}"]


@dataclass(frozen=True)
class Model:
    """Scores by feature, three tags each; transitions[x, y] from tag x to tag y. vocabulary: words that neighbours know; the rest are one word."""

    scores: dict[str, tuple[float, float, float]]
    transitions: np.ndarray
    vocabulary: frozenset[str]

    def emission(self, features) -> np.ndarray:
        return np.sum([self.scores[f] for f in features if f in self.scores] or [(0.0, 0.0, 0.0)], axis=0)

    def near(self, side: str, word: str) -> list[str]:
        p = plain(word)
        return [f"{side}={p if p in self.vocabulary else signature(word)}"]


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\S+", text)]


def gold_tags(spans: list[tuple[int, int]], text: str) -> tuple[list[int], list[str]]:
    """Tags of tokens, those that hold a pattern's secret being begin or inside; and the tokens as they are without the patterns' keywords: of a token with a secret the secret, of one that only leads to it nothing."""
    tags, bare = [O] * len(spans), [text[a:b] for a, b in spans]
    ends = [b for _, b in spans]
    for start, high, _, low in base_spans(text):
        first = True
        for i in range(bisect_right(ends, start), len(spans)):
            a, b = spans[i]
            if a >= high:
                break
            if b <= low:
                bare[i] = ""
                continue
            tags[i], first = tags[i] or (B if first else I), False
            bare[i] = text[max(a, low) : b]
    return tags, bare


def unusual(word: str) -> bool:
    """Long, in capitals, or of letters and digits: what a shape alone might take for a secret."""
    return len(word) >= LEAST_ADDED and (len(word) >= 16 or word.isupper() or (any(c.isdigit() for c in word) and any(c.isalpha() for c in word)))


ALPHABETS = [("0123456789abcdef", 20), (string.digits + string.ascii_letters, 24), (string.digits + string.ascii_uppercase, 18), (string.digits + string.ascii_letters + "-_", 40)]


def disguises(secret: str) -> list[str]:
    """Made-up secrets that no pattern matches, one for each alphabet; they follow from the secret, so training repeats."""
    out = []
    for n, (letters, size) in enumerate(ALPHABETS):
        raw = hashlib.sha512(f"{n}:{secret}".encode("utf-8", "surrogatepass")).digest()
        out.append("".join(letters[x % len(letters)] for x in raw[: size - raw[-1] % (size // 3)]))
    return out


def evenly(places: list[int], most: int) -> list[int]:
    """At most so many of the places, from the first to the last at equal distances."""
    return places if len(places) <= most else [places[i * (len(places) - 1) // (most - 1)] for i in range(most)]


def learn(texts: list[str], width: int = 12, vocabulary_size: int = 400, rounds: int = 100, penalty: float = 0.01, most_windows: int = 8) -> Model:
    """A conditional random field fitted to texts by its likelihood gradient (forward-backward over all windows at once, Adam steps).

    A window is width tokens on either side of a tagged token, of an unusual token without a tag, or of the middle of a
    text without either; of each sort at most most_windows a text, spread over all of it. A window with a tag
    comes as it is, and again without the keyword, the words beside the secret replaced by others of the text: once with
    the secret, and once with each of its disguises.
    """
    windows, words_near = [], Counter()
    for text in texts:
        spans = token_spans(text)
        if not spans:
            continue
        tags, bare = gold_tags(spans, text)
        words = [text[a:b] for a, b in spans]
        marked = [i for i, t in enumerate(tags) if t]
        odd = [i for i, t in enumerate(tags) if not t and bare[i] and unusual(words[i])]
        for i in marked:
            words_near.update(plain(words[j]) for j in (i - 1, i + 1) if 0 <= j < len(words))
        of_file = file_features(text, len(words))
        without = [f for f in of_file if not f.startswith("keyword=")] + ["keyword=False"]
        others = [w for w, t, x in zip(words, tags, bare, strict=True) if not t and x == w and not unusual(w)]
        for i in evenly(marked, most_windows) + evenly(odd, most_windows) or [len(words) // 2]:
            low, high = max(0, i - width), i + width + 1
            ends = words[low - 1] if low else "", words[high] if high < len(words) else ""
            windows.append((words[low:high], tags[low:high], *ends, of_file))
            if tags[i] and others:
                left = [(x, t) for x, t in zip(bare[low:high], tags[low:high], strict=True) if x]
                beside = {j for k, (_, t) in enumerate(left) if t for j in (k - 1, k + 1)}
                for n, secret in enumerate([None, *disguises(bare[i])]):
                    changed = [others[(7 * i + 13 * k + n) % len(others)] if k in beside and not t else secret if t and secret else x for k, (x, t) in enumerate(left)]
                    windows.append((changed, [t for _, t in left], *ends, without))
    model = Model({}, np.zeros((3, 3)), frozenset(w for w, _ in words_near.most_common(vocabulary_size)))
    if not any(t for w in windows for t in w[1]):
        return Model({"len=0": (0.0, 0.0, 0.0), "bias": (8.0, 0.0, 0.0)}, np.zeros((3, 3)), frozenset())
    number: dict[str, int] = {}
    longest, n = max(len(w[0]) for w in windows), len(windows)
    features = np.zeros((n, longest, SLOTS), np.int64)
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (words, tags, before, after, of_file) in enumerate(windows):
        around = [before, *words, after]
        for i, word in enumerate(words):
            names = ["bias", *own_features(signature(word)), *model.near("prev", around[i]), *model.near("next", around[i + 2]), *of_file]
            features[k, i, : len(names)] = [number.setdefault(f, len(number) + 1) for f in names]
        gold[k, : len(tags)], mask[k, : len(tags)] = tags, True
    w, t = np.zeros((len(number) + 1, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    onehot = np.eye(3)[gold] * mask[..., None]
    pair_mask = mask[:, 1:, None, None] & mask[:, :-1, None, None]
    gold_pairs = (np.eye(3)[gold[:, :-1]][..., :, None] * np.eye(3)[gold[:, 1:]][..., None, :] * pair_mask).sum((0, 1))

    def lse(x, axis):
        m = x.max(axis, keepdims=True)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))

    for step in range(1, rounds + 1):
        w[0] = 0
        e = w[features].sum(2) * mask[..., None]
        alpha, beta = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
        alpha[:, 0] = e[:, 0]
        for i in range(1, longest):
            alpha[:, i] = np.where(mask[:, i, None], lse(alpha[:, i - 1, :, None] + t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = lse(alpha[:, -1], 1)
        marginal = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * pair_mask
        slack = marginal - onehot
        g = np.stack([np.bincount(features.ravel(), np.repeat(slack[..., y], SLOTS, -1).ravel(), len(w)) for y in range(3)], 1) + penalty * w
        gt = pairs.sum((0, 1)) - gold_pairs + penalty * t
        for x, grad, m, v in ((w, g, *moments[:2]), (t, gt, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x -= 0.25 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model({f: tuple(w[i]) for f, i in number.items()}, t.copy(), model.vocabulary)


def viterbi(e: np.ndarray, t: np.ndarray, before: int | None, after: int | None) -> list[int]:
    """The best tags for emissions e (n, 3) between given tags; ties go to the smaller tag."""
    best = e[0] + (t[before] if before is not None else 0)
    back = []
    for i in range(1, len(e)):
        step = best[:, None] + t
        back.append(step.argmax(0))
        best = step.max(0) + e[i]
    tags = [int((best + (t[:, after] if after is not None else 0)).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


class Decoder:
    """Decodes texts with a model. It keeps scores of recent words in tables of bounded size."""

    KEPT = 500_000

    def __init__(self, model: Model):
        self.model, self.t = model, model.transitions
        self.bias = model.emission(["bias"])
        # the most that a tag other than "outside" can gain over it from its two transitions
        into, out = self.t - self.t[:, :1], self.t - self.t[:1, :]
        self.margin = float(max(0.0, into.max()) + max(0.0, out.max()))
        self.clear()

    def clear(self) -> None:
        self.kept: dict[str, int] = {}
        self.table = np.zeros((256, 3, 3))
        self.by_signature: dict[tuple, int] = {}
        self.number("")

    def number(self, word: str) -> int:
        """The row of the table that holds the word's scores for itself, for the token after it and for the token before it; words of one shape share a row."""
        p = plain(word)
        known = p if p in self.model.vocabulary else None
        core = word.rstrip(".,")
        if known is None and len(word) < 16 and core.isascii() and core.isalpha() and (core.islower() or core.istitle()):
            key = (len(word).bit_length(), min(len(core), 2), core.islower(), word[len(core) :])  # such words have one signature
        else:
            key = (signature(word), known)
        n = self.by_signature.get(key)
        if n is None:
            n = self.by_signature[key] = len(self.by_signature)
            if n >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            m = self.model
            self.table[n] = m.emission(own_features(signature(word))), m.emission(m.near("prev", word)), m.emission(m.near("next", word))
        if len(word) <= KEPT_LENGTH:
            self.kept[word] = n
        return n

    def tags(self, text: str, words: list[str]) -> np.ndarray:
        if len(self.kept) >= self.KEPT or len(self.by_signature) >= self.KEPT // 8:
            self.clear()
        ids = list(map(self.kept.get, words))
        if None in ids:
            for i, n in enumerate(ids):
                if n is None:
                    n = self.kept.get(words[i])
                    ids[i] = self.number(words[i]) if n is None else n
        around = np.array([0, *ids, 0])
        ids = around[1:-1]
        e = self.table[ids, 0] + self.table[around[:-2], 1] + self.table[around[2:], 2] + (self.bias + self.model.emission(file_features(text, len(words))))
        tags = np.zeros(len(words), np.int64)
        unsure = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= self.margin)
        if len(unsure):
            for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1):
                low, high = run[0], run[-1] + 1
                tags[low:high] = viterbi(e[low:high], self.t, O if low else None, O if high < len(words) else None)
        return tags

    def spans(self, text: str, base: list[tuple]) -> list[tuple[int, int, str, int]]:
        """Spans that the field adds: tagged tokens without edge punctuation, at least LEAST_ADDED long, clear of the base spans."""
        words = text.split()
        if not words:
            return []
        tags = self.tags(text, words)
        if not tags.any():
            return []
        at, out, open_span = token_spans(text), [], None
        for i in [*np.flatnonzero(tags).tolist(), -1]:
            if open_span and (i < 0 or tags[i] == B or i != open_span[1] + 1):
                low, high = at[open_span[0]][0], at[open_span[1]][1]
                body = text[low:high]
                low, high = low + len(body) - len(body.lstrip(EDGES)), high - (len(body) - len(body.rstrip(EDGES)))
                if high - low >= LEAST_ADDED and not any(s[0] < high and s[1] > low for s in base):
                    out.append((low, high, "crf", low))
                open_span = None
            open_span = [i, i] if open_span is None else [open_span[0], i]
        return out


def fit(docs: DataFrame, with_keyword: int = 300, without: int = 500, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of a bounded sample: the texts with the smallest id hashes, with_keyword of those that name a keyword or hold a long hexadecimal run, and so many without.

    A text of more than max_chars characters teaches with pieces from all over it. Of texts that share an id the smallest
    counts; null ids and null or empty texts do not teach. Without any text that a pattern matches the field adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = low.contains("token") | low.contains("secret") | low.contains("passw") | low.contains("api") | text.contains("AKIA") | text.rlike("[0-9a-f]{24}")
    ids = docs.where(f"`{text_col}` <> '' and `{id_col}` is not null").select(F.col(id_col).alias("id"), named.alias("named"))
    first = ids.withColumn("rank", F.row_number().over(W.partitionBy("named").orderBy(F.xxhash64("id"), "id")))  # each task sends as many rows as are wanted
    picked = [r["id"] for r in first.where((F.col("rank") <= with_keyword) & F.col("named") | (F.col("rank") <= without) & ~F.col("named")).where(F.col("rank") <= max(with_keyword, without)).select("id").collect()]
    rows = docs.where(F.col(id_col).isin(picked)).select(F.col(id_col).alias("id"), spread(text, max_chars).alias("text")).groupBy("id").agg(F.min("text").alias("text")).orderBy("id").collect()
    return learn([r["text"] for r in rows])


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans array<struct<kind, start, end>>), one for each row of docs; no shuffle.

    Spans are in code points, end exclusive, by start and then kind. A null text counts as empty and has no spans;
    repeated rows give repeated results; other columns are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    element = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        decoder = Decoder(model)
        for part in slices(batches, 1):
            out = []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                found = sorted(base + decoder.spans(text or "", base), key=lambda s: (s[0], KINDS.index(s[2])))
                out.append([{"kind": s[2], "start": s[0], "end": s[1]} for s in found])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(element))], [id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, spans array<struct<kind string, start long, end long>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
