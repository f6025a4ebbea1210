"""Tokenizer operators against their libraries, and on odd rows."""

import base64
import hashlib
import io
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from basaltic.llm import bpe_codec, packed_ids, splitting, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_tokens string, n_bytes string"
ODD = [
    (3, "The cat's\n  sat.", "en", "s", "x", "y"),
    (1, None, None, None, None, None),
    (2, "", "en", "s", None, None),
    (3, "The cat's\n  sat.", "en", "s", "x", "y"),
    (None, "null id", "en", None, None, None),
    (5, "<|endoftext|> ÀÉ ß 中文 \x1c é " + "ab" * 40_000, "en", "s", None, None),
    (4, " \t\n", "en", "s", None, None),
]
LETTERS = [*"abcehilnorstu  '0123\n\t.,éÉ中aİΣßı", "<|endoftext|>", "<|startoftext|>", "<|", "́", "\x1c", "\x85", "\xa0", "'s"]


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) + rng.choice("ab- ") * rng.randint(0, 60) * (i % 3 == 0) for i in range(n)]


def frames(spark):
    return spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def counted():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_counts_equal_the_library(counted, monkeypatch):
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    rows = texts(3000)
    wanted = [len(e.ids) for e in counted.encode_batch(rows, add_special_tokens=False)]
    assert [counter.count(t) for t in rows] == wanted
    monkeypatch.setattr(token_counts, "CHUNK", 7)  # state maps of many chunks, composed
    assert [counter.count(t) for t in rows] == wanted


def test_composition_is_associative():
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    a, b, c = (counter.chunk_map(x) for x in ("thorou", "ghly good", "ness 's all"))
    assert counter.compose(counter.compose(a, b), c) == counter.compose(a, counter.compose(b, c))


def test_count_rows(spark, counted):
    odd, none = frames(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, path).collect()), key=str)
    size = lambda t: len(counted.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), size(t), size(t) > 2048) for i, t, *_ in ODD), key=str)
    assert token_counts.token_counts(none, path).count() == 0


@pytest.fixture(scope="module")
def ranks():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_codec_equals_the_library(ranks):
    codec = bpe_codec.Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts(3000):
        ids = codec.encode(t)
        assert ids == own.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_codec_rows(spark, ranks):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd, none = frames(spark)
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    sha = lambda b: hashlib.sha256(b).hexdigest()
    wanted = [(i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, *_ in ODD for ids in [own.encode_ordinary(t or "")]]
    assert sorted((tuple(r) for r in bpe_codec.encode_digests(odd, *args).collect()), key=str) == sorted(wanted, key=str)
    assert bpe_codec.encode_digests(none, *args).count() == 0
    back = bpe_codec.decode_ids(bpe_codec.encode_ids(odd, *args), args[0])
    assert sorted(bytes(r.content) for r in back.collect()) == sorted((t or "").encode() for _, t, *_ in ODD)


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001).astype("<u4")
    assert (packed_ids.unpack(packed_ids.pack(ids, bits), len(ids), bits) == ids).all()
    sink = io.BytesIO()
    writer = packed_ids.ShardWriter(sink, bits, block=64)
    cuts = [0, 0, 5, 70, 7000, 10_001]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        writer.add(None if k == 0 else k, ids[a:b])
    assert writer.close() == (len(ids), 5)
    shard = packed_ids.Shard(pa.PythonFile(io.BytesIO(sink.getvalue()), mode="r"))
    assert (shard.read(60, 200) == ids[60:200]).all() and (shard.document(3) == ids[70:7000]).all()
    assert [(d, s, len(x)) for d, s, x in shard.documents()] == [(None, 0, 0), (1, 0, 5), (2, 5, 65), (3, 70, 6930), (4, 7000, 3001)]


def test_packed_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd, none = frames(spark)
    args = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    got = sorted((tuple(r) for r in packed_ids.packed(odd, *args).collect()), key=lambda r: r[1])
    wanted, start = [], 0
    for i, t, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == wanted
    assert packed_ids.packed(none, *args).count() == 0


def test_encoder_equals_the_library():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packed_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rows = texts(3000)
    assert [x.tolist() for x in own.encode(rows)] == [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]


def seconds(run):
    at = time.process_time()
    run()
    return time.process_time() - at


@pytest.mark.parametrize("section", [1, 2, 7, 1 << 20])
def test_sure_cuts_keep_all_matches(monkeypatch, section):
    monkeypatch.setattr(splitting, "SECTION", section)
    assert splitting.SURELY_CUT == public_tokenizers.PATTERN
    rng, full = random.Random(6), splitting.splitter(public_tokenizers.PATTERN).full
    letters = [*map(chr, range(0x80)), *"    \n\n''..__aZ09", "'s", "'ll", *"éßñ中。—“×\x85\xa0\u1680\u2003\u202f\u3000\ufeff\U0001f600"]
    rows = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(20_000 if section > 7 else 500)]
    raw = [t.encode() for t in rows]
    data, ends = b"".join(raw), np.cumsum([0, *map(len, raw)])
    starts = splitting.sure_cuts(data, ends).tolist()
    assert set(ends[ends < len(data)].tolist()) <= set(starts)
    parts = [data[a:b].decode() for a, b in zip(starts, [*starts[1:], len(data)])]
    assert [p for part in parts for p in full.findall(part)] == [p for t in rows for p in full.findall(t)]
    assert len(splitting.sure_cuts(b"", np.array([0]))) == len(splitting.sure_cuts(b"", np.array([0, 0]))) == 0
    assert list(splitting.sure_cuts(b"a", np.array([0, 0, 1, 1]))) == [0]


@pytest.mark.parametrize("memo", [1, 50, 250_000])
@pytest.mark.parametrize("pattern", [public_tokenizers.PATTERN, f"(?:{public_tokenizers.PATTERN})", r"\p{L}+"])
def test_encoder_on_odd_texts(monkeypatch, memo, pattern):
    monkeypatch.setattr(packed_ids, "MEMO", memo)
    monkeypatch.setattr(packed_ids, "SOME", memo)
    monkeypatch.setattr(packed_ids, "LONG", 8 if memo == 50 else 4096)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packed_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), pattern)
    some = texts(600)
    rows = [*some, "", " ", "  ", "\n", " \n x\n\ny  z \n", "<|endoftext|>", "a <|endoftext|> b", "", "中文。 字", "x" * 300, "\x00", *some]
    wanted = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(rows)] == wanted
    assert [own.encode([t])[0].tolist() for t in rows] == wanted
    assert own.encode([]) == [] and [len(x) for x in own.encode(["", ""])] == [0, 0]
    assert len(own.memo) <= memo and len(own.elder) <= memo


def test_texts_stay_in_order_over_groups(monkeypatch):
    monkeypatch.setattr(packed_ids, "GROUP", 10)
    rows = list(enumerate([None, "", "12345", "123456", "x" * 50, "y", None, "z"]))
    batch = pa.RecordBatch.from_pylist([{"doc_id": k, "text": t} for k, t in rows])
    got = list(packed_ids.groups_of(batch))
    assert [len(ids) for ids, _ in got] == [3, 1, 1, 3]
    assert [x for ids, some in got for x in zip(ids, some)] == [(k, t or "") for k, t in rows]
    assert list(packed_ids.groups_of(batch.slice(0, 0))) == []


def test_known_parts_take_less_time_than_the_pattern():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(5000)]
    rows = [" ".join(rng.choices(words, k=500)) + ".\n" for _ in range(2000)]
    own = packed_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    pattern = splitting.splitter(public_tokenizers.PATTERN)
    own.encode(rows)
    took = min(seconds(lambda: own.encode(rows)) for _ in range(3))
    assert took < min(seconds(lambda: [pattern.findall(t) for t in rows]) for _ in range(3))


@pytest.mark.parametrize("kind", ["letters", "unspaced"])
def test_long_pieces_take_time_in_proportion(kind):
    codec = bpe_codec.Codec.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnop") if kind == "letters" else chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(400_000))
    codec.encode(text[:100_000])
    assert seconds(lambda: codec.encode(text)) < 10 * seconds(lambda: codec.encode(text[-100_000:])) + 0.5
    assert codec.decode(codec.encode(text)) == text.encode()


def test_states_start_anew_within_a_word(counted, monkeypatch):
    counter = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 1, 60, 3000, 3000)]
    assert [counter.count(w) for w in words] == [len(counted.encode(w, add_special_tokens=False).ids) for w in words]
    assert len(counter.machine.states) <= 60
