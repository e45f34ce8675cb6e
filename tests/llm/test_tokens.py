import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticeframe.llm.piece_codec import decode, decode_ids, encode, encoder, id_bytes
from latticeframe.llm.pieces import DEFAULT_MODEL, SPACE, load
from latticeframe.llm.token_count import counter, token_counts

TEXTS = ["", " ", "the theory of everything", "  two  spaces ", "line\nbreak\t tab", "naïve café — Straße", "emoji 😀 and 漢字", "a" * 300, "▁literal", "x" * 5000 + " the end", "0123456789 3.14", "ÄÖÜ ß é"]


def by_definition(word):
    """Pieces of a word by plain dynamic programming over all starts, earliest first."""
    p = load(DEFAULT_MODEL)
    best, back = [0.0] + [float("-inf")] * len(word), [None] * (len(word) + 1)
    for start in range(len(word)):
        single = False
        for end in range(start + 1, min(len(word), start + p.longest) + 1):
            piece = p.normal.get(word[start:end])
            if piece:
                single |= end == start + 1
                if best[start] + piece[1] > best[end]:
                    best[end], back[end] = best[start] + piece[1], (start, [piece[0]])
        if not single and best[start] + p.unknown_score > best[start + 1]:
            best[start + 1], back[start + 1] = best[start] + p.unknown_score, (start, p.unknown_ids(word[start]))
    ids, end = [], len(word)
    while end:
        end, got = back[end][0], back[end][1]
        ids = got + ids
    return ids


def expected(text):
    return [i for w in load(DEFAULT_MODEL).segments(text) for i in by_definition(w)]


def ids_of(texts):
    ids, ends = encoder(DEFAULT_MODEL).texts(texts)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["the", "er", "in", "on", "tion", "x", "é", "🙂", "qu", "a", "-", "\n"]) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_encoder_and_counter_against_the_definition():
    texts = TEXTS + words(400, 1) + [" ".join(words(30, 2))]
    want = [expected(t) for t in texts]
    assert ids_of(texts) == want
    assert [counter(DEFAULT_MODEL).text(t)[1] for t in texts] == [len(w) for w in want]


def test_against_the_library():
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    model = pb.ModelProto()
    with open(DEFAULT_MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # unigram
    for p in model.pieces:
        p.score = max(p.score, -40_000.0)  # the library adds up in single precision, where scores of -1e9 drown all others
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [w.replace("🙂", "").replace("\n", "") or "a" for w in words(3000, 3)] + [" ".join(w.replace("🙂", "").replace("\n", "") for w in words(12, k)) for k in range(50)]
    texts += ["  two  spaces ", " led", "trailing   ", "a  b   c    d"]
    assert ids_of(texts) == library.encode(texts)
    original = SentencePieceProcessor(model_file=DEFAULT_MODEL)
    table = id_bytes(DEFAULT_MODEL)
    lists = [original.encode(t) for t in TEXTS] + [[1, 5, 2], [3, 200, 131, 100]]
    for some in (lists, lists[:-1]):
        ends = np.cumsum([0, *map(len, some)])
        assert decode_ids(np.array([i for ids in some for i in ids]), ends, table).to_pylist() == [original.decode(ids) for ids in some]


def test_round_trip_and_edges(spark):
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS if SPACE not in t)] + [(98, None), (None, "null id"), (3, "repeated id"), (3, "repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = decode(encode(df)).collect()
    assert len(got) == len(rows)
    assert all(r["decoded"] == r["text"] for r in got)
    assert [r["ids"] for r in got if r["text"] is None] == [None]
    counts = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(df).collect())
    assert counts == sorted((str(r["doc_id"]), len(r["ids"] or [])) for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert encode(empty).count() == token_counts(empty).count() == 0
    assert decode(spark.createDataFrame([([None, -5, 10**6],)], "ids array<int>")).first()["decoded"] == ""


def test_table_of_known_words_starts_anew(monkeypatch):
    from latticeframe.llm import piece_codec

    monkeypatch.setattr(piece_codec, "KEPT_WORDS", 20)
    texts = [" ".join(words(9, k % 5)) for k in range(15)]
    assert [ids_of([t])[0] for t in texts] == [expected(t) for t in texts]
    assert ids_of(texts) == [expected(t) for t in texts]


def test_slices_of_one_row_give_the_same(spark, monkeypatch):
    from latticeframe.llm import common

    monkeypatch.setattr(common.slices, "__defaults__", (1,))
    t = __import__("pyarrow").record_batch({"text": ["a b", None, "", "c" * 50], "ids": [[1], None, [], [2, 3]]})
    assert [r for p in common.slices([t], 0) for r in p.to_pylist()] == t.to_pylist()
    assert [r for p in common.slices([t], 1) for r in p.to_pylist()] == t.to_pylist()


def test_words_of_one_length_do_not_mix():
    a = encoder(DEFAULT_MODEL)
    some = ["▁the", "▁of.", "▁qqq", "▁ééé"]
    flat, offsets = a.words(some)
    assert [flat[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:], strict=True)] == [by_definition(w) for w in some]
    assert np.all(np.diff(offsets) > 0)
