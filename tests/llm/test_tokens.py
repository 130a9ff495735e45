"""Byte-level BPE and token records against the public libraries."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from civicgraph.llm import bpe, records

SCHEMA = "doc_id long, text string, ids string"
TEXTS = ["", "The quick brown fox.", "it's we'll  two  blanks\n\n tail ", "日本語テキスト" * 20, "😀😀 ünḯ ‍ \x00", "a" * 300,
         "x  y  z", " lead", "\n", "UPPER lower 12345 !!??", "<|endoftext|> plain", "don't 'tis"]


def rows():
    rng = random.Random(4)
    texts = TEXTS + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x500), 32, 10]))
                             for _ in range(rng.randrange(400))) for _ in range(60)]
    return [(100 - k, t, "clash") for k, t in enumerate(texts)] + [(7777, None, "clash"), (7778, "word " * 30_000, None)]


@pytest.fixture(scope="module")
def encoder():
    return bpe.public_bpe()


def reference():
    import tiktoken
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, encoder):
    want, data = reference(), rows()
    for _, text, _ in data:
        ids = want.encode_ordinary(text or "")
        assert bpe.Encoder(encoder)(text) == ids
        assert encoder.decode(ids) == (text or "").encode()
    got = {r.doc_id: r for r in bpe.encode_digests(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, text, _ in data:
        ids = want.encode_ordinary(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())
    full = {r.doc_id: r for r in bpe.encode_documents(spark.createDataFrame(data, SCHEMA)).collect()}
    assert all(full[i].decoded == (text or "") and full[i].n_tokens == len(full[i].ids) for i, text, _ in data)
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_perfect_hash_is_minimal_and_perfect(encoder):
    keys = [bytes([a, b]) for a in range(60) for b in range(60)]
    table = bpe.PerfectHash(keys)
    assert sorted(map(table, keys)) == list(range(len(keys)))
    assert all(encoder.lookup(token) == rank for token, rank in list(encoder.ranks.items())[::97])
    assert encoder.lookup(b"\xff\xfe no such token") is None


def test_merging_with_small_memo_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    encode, want = bpe.Encoder(encoder), reference()
    for text in TEXTS * 2:
        assert encode(text) == want.encode_ordinary(text)


def test_records_read_back(spark):
    data = rows() + [(50, "again", None), (None, "no id", None)]
    tokenizer = Tokenizer.from_file(P.path(records.TOKENIZER))
    manifest = records.write(spark.createDataFrame(data, SCHEMA))
    got = sorted(records.read_back(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in data), key=lambda i: (i is not None, i or 0))
    ids = {}
    for i, text, _ in data:
        ids.setdefault(i, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [records.END_ID])
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in [
            (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
        at += r.n_tokens
    assert records.read_back(records.write(spark.createDataFrame([], SCHEMA))).count() == 0


def test_index_finds_any_record(spark):
    data = [(k, f"text number {k} " * (k % 5 + 1), None) for k in range(40)]
    row = records.write(spark.createDataFrame(data, SCHEMA).coalesce(1)).orderBy("part").first()
    forward = list(records.read_shuffled(row["data"], row["index"], range(row["docs"])))
    backward = list(records.read_shuffled(row["data"], row["index"], range(row["docs"] - 1, -1, -1)))
    assert [(i, x.tolist()) for i, x in forward] == [(i, x.tolist()) for i, x in reversed(backward)]
    assert len(records.read_index(row["index"])[0]) == row["docs"]


def test_damage_is_noticed():
    good = records.frame(records.pack(7, np.array([1, 2, 3], "<u2").tobytes(), 2))
    doc_id, ids = records.unpack(records.read_record(io.BytesIO(good)))
    assert (doc_id, ids.tolist()) == (7, [1, 2, 3])
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(records.Corrupt):
            records.read_record(io.BytesIO(bytes(bad)))
    for k in range(1, len(good)):
        with pytest.raises(records.Corrupt):
            records.read_record(io.BytesIO(good[:k]))
    assert records.read_record(io.BytesIO(b"")) is None


def test_pieces_equal_the_whole_text():
    words = records.Words(P.path(records.TOKENIZER))
    assert words.width == 2
    for text in TEXTS:
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == ids


@pytest.mark.parametrize("text", [
    "a\x1cb", "\x1c", "a \x1d\x1e b\x1f", "\x1fa.\u2003b\x85c", "\u0130!", "\u0958.", "x\u09dc,", "\u09df;", "caf\u00e9.", "\u0130\x1c!",
    "e\u0301!", "\u03a3.", "tail... \u0130?! end."])
def test_rare_letters_and_controls_equal_the_whole_text(text):
    words = records.Words(P.path(records.TOKENIZER))
    ids = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(words.encode(text), words.dtype).tolist() == ids


def test_plain_words_equal_the_library():
    """Words that take the short way to the model, alone and beside letters and marks that must not."""
    words = records.Words(P.path(records.TOKENIZER))
    assert words.spelled
    plain = "".join(sorted(records.LETTERS))
    mixed = plain + "\u0301\u0308\u0327\u0345'.,!?;:-\u00b5\u00aa\u00df\u0130\u0391\u03a3\u09a10" + "eeiostn" * 8
    dice = random.Random(7)
    for k in range(20_000):
        text = "".join(dice.choices(mixed if k % 2 else plain, k=dice.randint(1, 14)))
        ids = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(words.encode(text), words.dtype).tolist() == ids, ascii(text)


def test_blanks_are_those_of_the_tokenizer():
    words = records.Words(P.path(records.TOKENIZER))
    whole = words.tokenizer.encode("a b", add_special_tokens=False).ids
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    found = words.tokenizer.encode_batch([f"a{c}b" for c in chars], add_special_tokens=False)
    assert [c for c, e in zip(chars, found) if e.ids == whole] == [c for c in chars if records.BLANK.fullmatch(c)]


def test_memos_are_dropped_where_memory_is_needed(encoder):
    from types import SimpleNamespace

    from civicgraph.llm import common
    encode = bpe._encoder(SimpleNamespace(value=encoder))
    ids = encode("some text to remember")
    assert encode.chunks and encode.pieces
    common.forget_memos()
    assert not encode.chunks and not encode.pieces and encode("some text to remember") == ids


def test_memo_beside_other_operators_is_small(encoder, monkeypatch):
    from types import SimpleNamespace
    monkeypatch.setattr(bpe, "BESIDE", 50)
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 60))) for _ in range(400)]
    encode, want = bpe._encoder(SimpleNamespace(value=encoder), bpe.BESIDE), reference()
    for k in range(0, 400, 20):
        text = " ".join(words[k:k + 40])
        assert encode(text) == want.encode_ordinary(text)
    for memo in (encode.chunks, encode.pieces):
        assert 0 < len(memo) <= 50 and len(memo.old) <= 50
        assert max(map(len, [*memo, *memo.old])) <= bpe.LONGEST


def test_whole_documents_are_encoded_beside_other_operators(encoder, monkeypatch):
    """The pipeline's worker keeps few strings; the query on its own keeps many."""
    from types import SimpleNamespace
    kept = []

    context = SimpleNamespace(broadcast=lambda table: SimpleNamespace(value=table))
    texts = SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context), mapInArrow=lambda task, schema: task)
    monkeypatch.setattr(bpe, "_encoder", lambda shared, most=None: kept.append(most))
    for make in (bpe.encoded, bpe.digests):
        assert list(make(texts, encoder)([])) == []
    assert kept == [bpe.BESIDE, None] and bpe.BESIDE < bpe.MEMO


def test_short_and_long_merges_agree(encoder):
    rng = random.Random(9)
    for _ in range(400):
        piece = bytes(rng.choices(b"aeinorst \xe6\x97\xa5\xff", k=rng.randrange(1, 60)))
        assert encoder._merge_short(piece) == encoder._merge_long(piece)


def test_tasks_drop_memos_and_give_memory_back(monkeypatch):
    from civicgraph.llm import common
    done = []
    monkeypatch.setattr(common, "REMEMBERED", {"x": lambda: done.append("forgot")})
    monkeypatch.setattr(common, "give_back", lambda: done.append("gave"))
    assert list(common.lean(iter)([1, 2])) == [1, 2] and done == ["forgot", "gave"]
    assert list(common.lean(iter, forget=False)([])) == [] and done == ["forgot", "gave", "gave"]
