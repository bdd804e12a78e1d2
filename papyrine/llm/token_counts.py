"""Token counts through a digest cache.

The cache is a Parquet table of (content digest, tokens), one folder per tokenizer
version; the version is the digest of the vocabulary file and of the rules below.
Content is normalised only as far as the tokenizer's count cannot change: a null
text is the empty text. A run joins the digests of its texts to the cache, encodes
each missing text once, and appends the new counts.

Texts are encoded by the tokenizer's own library, without begin, end or added
special tokens. A byte-level vocabulary splits a text into pieces that are encoded
one by one, so tasks keep the counts of the pieces they have met; a text with a
special string or with space characters on which libraries differ goes to the
library whole. Empty texts have 0 tokens; equal texts are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.llm.hot_keys import hot_keys, split_join
from papyrine.workspace import exists, written

#: Counts of pieces that a task keeps; it starts afresh beyond.
PIECES = 300_000
#: Missing texts that are looked up by a broadcast of their digests (40 bytes each) at most.
BROADCAST_DIGESTS = 100_000
#: The library's byte-level splitter breaks a text at these places too: before a blank that starts
#: a word, around white space, and between a run of plain letters and a run of plain marks.
_SPACE = " \t-\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
WORD = rf" ?[{_LETTERS}]+(?=[\x00-@\[-`{{-\x7f]|\Z)"
MARKS = rf" ?[{_MARKS}]+(?=[ \t-\rA-Za-z0-9]|\Z)"
PIECE = re.compile(rf"{WORD}|{MARKS}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
PLAIN = re.compile(rf"(?: ?[{_LETTERS}]+| ?[{_MARKS}]+)\Z")
DOUBTFUL = re.compile(r"[\x1c-\x1f\x85᠎​﻿]")


def _byte_signs() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the signs
    from U+0100 on in their order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


@lru_cache(maxsize=4)
def counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for the vocabulary file at ``path``."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    config = json.loads(tokenizer.to_str())
    special = [t["content"] for t in config.get("added_tokens") or []]

    def whole(texts: list[str]) -> list[int]:
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]

    splitter = config.get("pre_tokenizer") or {}
    if config.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True):
        return whole
    known: dict[str, int] = {}
    signs = _byte_signs()

    def of_piece(piece: str) -> int:
        if PLAIN.match(piece):  # one word of the splitter: straight to the merges
            return len(tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(signs)))
        return len(tokenizer.encode(piece, add_special_tokens=False).ids)

    def by_pieces(texts: list[str]) -> list[int]:
        counts = []
        for text in texts:
            if DOUBTFUL.search(text) or any(s in text for s in special):
                counts += whole([text])
                continue
            pieces = PIECE.findall(text)
            try:
                counts.append(sum(map(known.__getitem__, pieces)))
            except KeyError:
                if len(known) > PIECES:
                    known.clear()
                new = [p for p in set(pieces) if p not in known]
                known.update(zip(new, map(of_piece, new)))
                counts.append(sum(map(known.__getitem__, pieces)))
        return counts

    return by_pieces


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file: counts of different vocabularies never meet."""
    with open(path, "rb") as file:
        return hashlib.sha256(b"counts-1:" + file.read()).hexdigest()[:32]


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row of ``docs``; ``vocabulary`` is the file's path on
    every machine, ``cache`` the cache's folder in shared storage."""
    spark = docs.sparkSession
    folder = f"{cache.rstrip('/')}/{tokenizer_version(vocabulary)}"
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content, 256))
    keys = written(docs.select(key, digest.alias("digest"), F.octet_length(content).cast("long").alias("n_bytes")), "text-digests")
    own = written(keys.groupBy("digest").agg(F.count("*").alias("n")), "distinct-digests")
    misses = own.select("digest")
    if exists(spark, folder):
        misses = misses.join(spark.read.schema("digest binary, n_tokens long").parquet(folder), "digest", "left_anti")
    misses = written(misses, "missing-digests")
    n_missing = misses.count()
    if n_missing:
        texts = docs.select(digest.alias("digest"), content.alias("content"))
        texts = texts.join(F.broadcast(misses) if n_missing <= BROADCAST_DIGESTS else misses, "digest", "left_semi")
        once = texts.groupBy("digest").agg(F.first("content").alias("content"))

        def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count = counter(vocabulary)
            for batch in batches:
                yield pd.DataFrame({"digest": batch["digest"], "n_tokens": count(batch["content"].tolist())})

        once.mapInPandas(encode, "digest binary, n_tokens long").write.mode("append").parquet(folder)
    if not exists(spark, folder):  # no texts and nothing cached yet
        return keys.select(key, "n_bytes", F.lit(0).cast("long").alias("n_tokens"))
    # of the cache, only this run's digests; two runs may have appended the same one with the same count
    cached = spark.read.schema("digest binary, n_tokens long").parquet(folder).join(own, "digest", "left_semi")
    counts = cached.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    hot = hot_keys(own, "digest", "n", keys.count())
    return split_join(keys, counts, "digest", hot).select(key, "n_bytes", "n_tokens")
