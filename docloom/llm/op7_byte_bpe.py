"""Byte-level BPE by automaton and backtracking.

Bytes map to Latin-1 characters, so that one pyahocorasick automaton finds every vocabulary entry in a piece. Encoding
takes the longest entry at each place that may stand after the entry before it, and goes back where none can follow; a
place found to be a dead end is not tried again, so the time is linear in the length of a piece. Two entries may stand
side by side if merging their bytes by rank never joins anything across their border: this is found by undoing merges
from the border, and memoised. The ids are those of exact merging by rank.

Texts are cut at safe places (see ``common.cuts``) and each distinct chunk is split by the pattern once.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_PAIRS, _PIECES = 1_000_000, 200_000


class RankEncoder(common.Chunks):
    """Encodes and decodes by a file of ranks; ``pattern`` splits the text before."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: x for x, i in self.ranks.items()}
        self.split = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.halves: dict[int, tuple[int, int]] = {}
        self.unmade: set[int] = set()
        self.fits: dict[int, bool] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.found = ahocorasick.Automaton()
        for x, i in self.ranks.items():
            self.found.add_word(x.decode("latin-1"), (len(x), i))
        self.found.make_automaton()
        size = max(self.tokens) + 1
        self.table = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)
        self.table_begin = np.concatenate([[0], np.cumsum([len(self.tokens.get(i, b"")) for i in range(size)])]).astype(np.int64)

    def half(self, token: int) -> tuple[int, int]:
        """The two entries whose merge makes ``token`` when its bytes are merged by rank; itself twice if none do."""
        out = self.halves.get(token)
        if out is None:
            parts = [bytes([x]) for x in self.tokens[token]]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            out = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
            self.halves[token] = out
            if out[0] == token and len(self.tokens[token]) > 1:
                self.unmade.add(token)
        return out

    def made(self, token: int) -> bool:
        """Whether merging by rank can make ``token``."""
        self.half(token)
        return token not in self.unmade

    def beside(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` can stand side by side in merged text."""
        key = a << 32 | b
        out = self.fits.get(key)
        if out is None:
            if len(self.fits) >= _PAIRS:
                self.fits.clear()
            out = self.fits[key] = self._beside(a, b)
        return out

    def _beside(self, a: int, b: int) -> bool:
        bound = 1 << 30  # merges of this rank and above have been undone
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < bound and self.half(joined) == (a, b):
                return False
            # undo the later merge of the two; on the left the right half touches the border, on the right the left half
            left, right = self.half(a), self.half(b)
            if a > b and left[0] != a:
                bound, a = a, left[1]
            elif right[0] != b:
                bound, b = b + 1, right[0]
            elif left[0] != a:
                bound, a = a, left[1]
            else:
                return True

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        out = self.pieces.get(data)
        if out is None:
            whole = self.ranks.get(data)
            out = (whole,) if whole is not None else self._backtrack(data)
            if len(data) < 64:
                if len(self.pieces) >= _PIECES:
                    self.pieces.clear()
                self.pieces[data] = out
        return out

    def _backtrack(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        starting: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # by the place before: (size, id) from short to long
        for last, entry in self.found.iter(data.decode("latin-1")):
            starting[last - entry[0]].append(entry)
        fits, beside, halves, made = self.fits.get, self.beside, self.halves, self.made
        unmade = self.unmade
        ids: list[int] = []
        taken: list[tuple[int, int]] = []  # (start, which of those that start there)
        dead = bytearray(n + 1)
        at, which, before = 0, len(starting[-1]) - 1, -1
        while at < n:
            options = starting[at - 1]
            while which >= 0:
                size, token = options[which]
                if not dead[at + size] and (token in halves or made(token)) and token not in unmade:
                    if before < 0:
                        break
                    fit = fits(before << 32 | token)
                    if beside(before, token) if fit is None else fit:
                        break
                which -= 1
            if which >= 0:
                taken.append((at, which))
                ids.append(token)
                before, at = token, at + size
                which = len(starting[at - 1]) - 1
            else:
                dead[at] = 1
                at, which = taken.pop()
                ids.pop()
                before = ids[-1] if ids else -1
                which -= 1
        return tuple(ids)

    def _fresh(self, chunks: list[str]) -> tuple[range, np.ndarray, np.ndarray]:
        split, piece = self.split, self.piece
        out = [[i for x in split(chunk) for i in piece(x.encode())] for chunk in chunks]
        return range(len(chunks)), np.array([i for x in out for i in x], np.uint32), np.array([len(x) for x in out], np.int64)

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each text's begin."""
        return common.spread(ids, self.table, self.table_begin, begin)


_ENCODERS: dict[tuple[str, str], RankEncoder] = {}


def rank_encoder(path: str, pattern: str | None = None) -> RankEncoder:
    """One encoder for each file, pattern and worker process; by default the pattern published with the files."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = RankEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_decode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (bytes decoded from the ids).

    Null and empty texts have no ids; both digests are then that of no bytes. Special strings are ordinary text.
    Repeated rows are encoded each; an empty table gives no rows. Narrow plan without a shuffle.
    """

    def encode(batches):
        enc = rank_encoder(common.vocabulary(vocabulary), pattern)
        for batch in common.text_slices(batches):
            ids, begin = enc.ids(batch.column(1))
            data, ends = enc.decode(ids, begin)
            hashes = []
            for x, b in ((np.ascontiguousarray(ids, "<u4"), begin * 4), (np.ascontiguousarray(data), ends)):
                view = memoryview(x).cast("B") if len(x) else memoryview(b"")
                hashes.append([hashlib.sha256(view[i:j]).hexdigest() for i, j in zip(b[:-1].tolist(), b[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(begin)), pa.array(hashes[0], pa.string()), pa.array(hashes[1], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.id_text(docs).mapInArrow(encode, SCHEMA)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir))
