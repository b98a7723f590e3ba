"""Token operators against the tokenizer libraries themselves and brute force."""

import base64
import bisect
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import common
from docloom.llm.op2_best_fit_packing import pack, plan
from docloom.llm.op4_token_files import Shard, read_files, token_files, write_shard
from docloom.llm.op7_byte_bpe import encode_decode, rank_encoder
from docloom.llm.op9_token_counts import token_counts

from .conftest import by_id

WORD = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
BYTE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["nasty", "table", "empty"])
def rows(request, spark, sf_dir, nasty):
    return {"nasty": nasty, "table": texts(spark, sf_dir), "empty": []}[request.param]


def test_token_counts(make_docs, rows):
    got = token_counts(make_docs(rows, extra=True)).collect()
    want = []
    for i, t in rows:
        n = len(WORD.encode(t or "", add_special_tokens=False).ids)
        want.append({"i": i, "b": len((t or "").encode()), "n": n, "o": n > 2048})
    assert by_id(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == by_id(want, "i", "b", "n", "o")


def test_packing(make_docs, rows):
    got = pack(make_docs(rows, extra=True)).collect()
    want, total = [], 0
    for i, t in rows:
        ids = [*WORD.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want.append({"i": i, "p": p // 2048, "s": p, "l": len(part), "c": crc(part)})
    assert by_id(got, "doc_id", "piece", "start", "length", "ids_crc32") == by_id(want, "i", "p", "s", "l", "c")
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for part in places.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == _best_fit([x["l"] for x in want])
    assert len(places) <= -(-total // 2048) * 1.25 + 1


def _best_fit(lengths, size=2048):
    """Sequences that best-fit decreasing takes, one piece at a time."""
    rooms, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms.pop(at)
        else:
            room, n = size, n + 1
        if room > length:
            bisect.insort(rooms, room - length)
    return n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40)))
def test_plan_is_best_fit(counts):
    slots = plan(counts, 64)
    bins = defaultdict(list)
    for length, low, high, first, each, base in slots:
        for rank in range(low, high):
            bins[first + (rank - low) // each].append((base + (rank - low) % each * length, length))
    for part in bins.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at
            at += length
        assert at <= 64
    placed = defaultdict(int)
    for part in bins.values():
        for _, length in part:
            placed[length] += 1
    assert placed == {k: v for k, v in counts.items() if v}
    assert len(bins) == _best_fit([k for k, v in counts.items() for _ in range(v)], 64)


def test_token_files(make_docs, rows):
    files = token_files(make_docs(rows, extra=True), target=5_000)
    got = read_files(common.materialize(files, "t")).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*BYTE.encode(t or "", add_special_tokens=False).ids, 2]
        want.append({"i": i, "s": start, "n": len(ids), "c": crc(ids)})
        start += len(ids)
    assert by_id(got, "doc_id", "start", "n_tokens", "ids_crc32") == by_id(want, "i", "s", "n", "c")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=400), max_size=12))
def test_shard_round_trip(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs], dtype=np.int64)]).astype(np.int64)
    shard = Shard(write_shard(list(range(len(docs))), ids, begin, end=2))
    for k, d in enumerate(docs):
        assert shard.ids(k).tolist() == [*d, 2]
        assert shard.ids(k, 3, 9).tolist() == [*d, 2][3:9]
    assert np.diff(shard.begin()).tolist() == [len(d) + 1 for d in docs]


def test_memo_keeps_frequent_chunks(monkeypatch):
    monkeypatch.setattr(common.Chunks, "MEMO", 40)
    enc = common.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    for _ in range(20):
        parts = [" ".join([rng.choice(["the", "cat", "sat"]), "".join(rng.choice("abc") for _ in range(5)), "on"]) for _ in range(9)]
        ids, begin = enc.ids(common.pa.array(parts))
        for k, t in enumerate(parts):
            assert ids[begin[k] : begin[k + 1]].tolist() == BYTE.encode(t, add_special_tokens=False).ids
    assert b" on" in enc.memo and len(enc.memo) <= 60


def test_shard_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    content = write_shard([1], ids, np.array([0, len(ids)]))
    assert len(content) < len(ids)  # under half a symbol of two bytes for each id


def ranks():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), table


def test_byte_bpe(make_docs, rows):
    enc, _ = ranks()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append({"i": i, "n": len(ids), "h": hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), "d": hashlib.sha256((t or "").encode()).hexdigest()})
    got = encode_decode(make_docs(rows, extra=True)).collect()
    assert by_id(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == by_id(want, "i", "n", "h", "d")


def test_byte_bpe_is_exact_on_random_text():
    enc, table = ranks()
    mine = rank_encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rng = random.Random(3)
    entries = list(table)
    for k in range(3000):
        if k % 3 == 0:
            t = b"".join(rng.choice(entries) for _ in range(4)).decode("utf-8", "ignore")
        elif k % 3 == 1:
            t = "".join(rng.choice("abcdeé ,.\n'st漢") for _ in range(rng.randint(0, 60)))
        else:
            t = "".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x4E00, 0x4E40), 0x85, 0x1C, 0x2003])) for _ in range(20))
        ids, _ = mine.ids(common.pa.array([t]))
        assert ids.tolist() == enc.encode_ordinary(t), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aZé×ßΣ .,!'\n\t1#<|>", "  ", "'s", "'LL", "<|endoftext|>", "́", "漢", " ", " "]), max_size=30).map("".join), max_size=6))
def test_cuts_change_nothing(parts):
    for name, tok in (("word_bpe_49k.json", WORD), ("byte_bpe_50k.json", BYTE)):
        ids, begin = common.encoder(public_tokenizers.path(name)).ids(common.pa.array(parts, common.pa.string()))
        for k, t in enumerate(parts):
            assert ids[begin[k] : begin[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids
