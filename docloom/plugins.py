"""Models as plug-ins, with deterministic defaults that need no network.

An embedder maps a text column to ``array<float>``; a scorer maps (query, text) to a logit; a generator maps (prompt,
chosen texts) to an answer; a parser maps file bytes to words or lines. A learned model replaces a default by a
``pandas_udf`` of the same shape, loaded once for each Python worker.
"""

from __future__ import annotations

import hashlib
import html.entities
import itertools
import json
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from .functions import text as T

DIMENSION = 64
_TOKEN = re.compile(r"[^\W]+(?:-[^\W]+)*")
Embedder = Callable[[Column], Column]
Scorer = Callable[[Column, Column], Column]
Generator = Callable[[Column, Column], Column]


_MEMO = 200_000


class _Places(dict):
    """Twice the bucket of a token, and one more for a positive sign; each is hashed once as long as it is held."""

    def __missing__(self, token: str) -> int:
        if len(self) >= _MEMO:
            self.clear()
        digest = hashlib.md5(token.encode()).digest()
        out = self[token] = 2 * (digest[0] % DIMENSION) + digest[1] % 2
        return out


class _Hasher:
    """Signed feature hashing of tokens by md5."""

    def __init__(self):
        self.places = _Places()

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        """A row of length one for each text, of zeros for one without tokens."""
        found = [_TOKEN.findall((t or "").lower()) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        place = np.fromiter(map(self.places.__getitem__, itertools.chain.from_iterable(found)), np.int64, len(row))
        sums = np.bincount(row * DIMENSION + place // 2, place % 2 * 2.0 - 1, len(texts) * DIMENSION).reshape(-1, DIMENSION)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        return (sums / np.where(size > 0, size, 1)).astype(np.float32)


@pandas_udf(ArrayType(FloatType()))
def _hash_embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    hasher = _Hasher()
    for batch in batches:
        yield pd.Series(list(hasher.vectors(batch.tolist())), index=batch.index, dtype=object)


def hash_embedder(text: Column) -> Column:
    return _hash_embed(text)


def overlap_scorer(query: Column, text: Column) -> Column:
    """A logit from shared keywords: 6 times their Jaccard similarity, less 1."""
    return overlap_scorer.compare(T.keywords(query), T.keywords(text))


#: A scorer may say what it needs of a text alone (``prepare``) and compare two of those, so that each text is read once.
overlap_scorer.prepare = T.keyword_ids
overlap_scorer.compare = lambda query, text: 6 * T.keyword_jaccard(query, text) - 1


def prepared(scorer: Scorer) -> tuple[Callable[[Column], Column], Scorer]:
    """(what a scorer needs of one text, the logit of two of those)."""
    return getattr(scorer, "prepare", lambda text: text), getattr(scorer, "compare", scorer)


def extractive_generator(prompt: Column, texts: Column) -> Column:
    """The first sentence of each chosen text."""
    return F.array_join(F.filter(F.transform(texts, lambda t: F.get(T.sentences(t), 0)), lambda s: s.isNotNull()), " ")


def http_generator(url: str, model: str, tokens: int = 512, temperature: float = 0.1, timeout: float = 120.0) -> Generator:
    """Answers of a model behind ``url``: a POST of model, prompt and options as JSON; the answer is its ``response``."""

    @pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        def one(prompt: str) -> str:
            body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": tokens}}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"}, method="POST")
            try:
                with urllib.request.urlopen(request, timeout=timeout) as reply:
                    return json.loads(reply.read()).get("response", "").strip()
            except urllib.error.HTTPError as e:
                raise RuntimeError(f"the generator at {url} failed: {e.read().decode(errors='replace')[:500] or e}") from e
            except urllib.error.URLError as e:
                raise RuntimeError(f"no generator answers at {url}: {e.reason}") from e

        return prompts.map(one)

    return lambda prompt, texts: ask(prompt)


def local_generator(load: Callable[[], Callable[[list[str]], list[str]]]) -> Generator:
    """Answers of a model in the Python workers: ``load`` runs once in each and returns a function of prompts."""
    held: list = []

    @pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            if not held:
                held.append(load())
            yield pd.Series(held[0](prompts.tolist()), index=prompts.index, dtype=object)

    return lambda prompt, texts: ask(prompt)


GENERATORS: dict[str, Generator] = {"extractive": extractive_generator}


def register(name: str, made: Generator) -> None:
    """Offer a generator by name."""
    GENERATORS[name] = made


def generator(name: str) -> Generator:
    if name not in GENERATORS:
        raise ValueError(f"unknown generator {name!r}; registered: {', '.join(sorted(GENERATORS))}")
    return GENERATORS[name]


_BLOCK = "(?is)" + "|".join(rf"<{tag}[^>]*>.*?</{tag}>" for tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"))
_NAMES = {f"&{k};": chr(v) for k, v in html.entities.name2codepoint.items()} | {"&apos;": "'"}


def unescape(text: Column) -> Column:
    """Named entities of HTML 4 and numbered ones, in one pass; anything else stays."""
    names = F.create_map(*[F.lit(x) for pair in sorted(_NAMES.items()) for x in pair])

    def one(x: Column) -> Column:
        code = F.coalesce(F.regexp_extract(x, r"^&#(\d{1,7});$", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]{1,6});$", 1), F.lit("")), 16, 10).try_cast("int"))
        number = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(names, x), number, x)

    pieces = F.split(text, r"(?=&[A-Za-z0-9#]{1,10};)|(?<=;)")
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def html_lines(pages: DataFrame) -> DataFrame:
    """Lines of web pages (page_id, html): headings by their level, paragraphs as body text; numbered with empty blocks."""
    blocks = pages.select(F.col("page_id").cast("long").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(_BLOCK), F.lit(0))).alias("line_no", "b"))
    tag = F.lower(F.regexp_extract("b", "^<([A-Za-z]+[1-6]?)", 1))
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace("b", "^<[^>]*>", ""), r"</[A-Za-z]+[1-6]?>$", ""), "<[^>]+>", "")
    rows = blocks.select("doc_id", "line_no", tag.alias("tag"), T.strip(F.regexp_replace(unescape(inner), r"(?U)\s+", " ")).alias("text")).where("text <> ''")
    size = F.when(F.col("tag") == "h1", 16.0).when(F.col("tag") == "h2", 12.0).otherwise(10.0)
    said = F.when((F.col("tag") != "p") & (size == 10.0), F.upper("text")).otherwise(F.col("text"))
    return rows.select(
        "doc_id", F.lit(1).alias("page"), F.lit(0).alias("col"), "line_no", said.alias("text"), size.alias("size"), (F.col("tag") != "p").alias("bold"),
        ((F.upper(said) == said) & said.rlike(r"\p{L}")).alias("upper"), (14.0 * F.col("line_no")).alias("y_top"), (14.0 * F.col("line_no") + 10).alias("y_bot"),
    )


def as_matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
