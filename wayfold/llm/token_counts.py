"""Token counts without encoding texts: pre-tokens are looked up in two tiers, both on the map side.

A text falls into pre-tokens, whose numbers of tokens add up. Tier 1 is a broadcast table of frequent pre-tokens with their lengths
in tokens: at most FREQUENT entries of at most LONG characters, so a few MB whatever the corpus, counted on about SAMPLE rows, drawn by a hash of
id and text and counted where they lie: what is shuffled are at most FREQUENT counts of each task that holds sampled rows, never a text
(the table only saves time; no result depends on it). Tier 2 is a cache in each worker, bounded by bytes, which has the library encode what it misses.
The count itself shuffles nothing, and rows stay where they are.

As the library does by default, special tokens' strings inside of a text are those tokens, one each, found before anything else.
Defined results: a null text is the empty text with 0 bytes and 0 tokens; a row's result depends on its text alone, however long it is, so repeated rows
agree; null ids are kept; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, beside, by_share, col, share_of, small_batches, table, tidy, worker_state

MODEL, LIMIT = "word_bpe_49k.json", 2048
FREQUENT, SAMPLE, CACHE, LONG = 32_768, 1_000, 64 << 20, 48

#: The model's own split of lower-cased text into pre-tokens (a fixed value of the vocabulary file, tested against it).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Counting:
    """What a worker needs to count tokens by one model file."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # pre-tokens are normalised already, and that isn't idempotent: lower case makes new sequences of marks, which a second NFC would reorder
        self.model = Tokenizer.from_str(json.dumps(json.loads(self.library.to_str()) | {"normalizer": None}))
        specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True))))
        self.find = regex.compile(PRE_TOKEN).findall
        self.recent = Recent(self.length, CACHE)

    def length(self, pre_token: str) -> int:
        return len(self.model.encode(pre_token, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str]:
        return self.find(text.lower() if text.isascii() else self.library.normalizer.normalize_str(text))

    def parts(self, text: str) -> list[str]:
        """The text between special tokens; their number is one less."""
        return self.special.split(text) if "<|" in text else [text]

    def count(self, text: str, frequent: dict[str, int]) -> int:
        parts = self.parts(text)
        total = len(parts) - 1
        for part in parts:
            for word in self.pre_tokens(part):
                n = frequent.get(word)
                total += n if n is not None else self.recent[word] if len(word) <= LONG else self.length(word)
        return total


def counting(path: str) -> Counting:
    """One for each worker process and model file."""
    return worker_state(("tokens", path), lambda: Counting(path))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_lengths(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, size: int = FREQUENT) -> dict[str, int]:
    """Tier 1: the most frequent pre-tokens of a bounded sample, with their numbers of tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, seen = counting(path or model_path()), Counter()
        for batch in batches:
            for text in batch["_text"]:
                for part in own.parts(text or ""):
                    seen.update(w for w in own.pre_tokens(part) if len(w) <= LONG)
        top = seen.most_common(size)
        if top:
            yield pd.DataFrame({"word": [w for w, _ in top], "n": [n for _, n in top], "length": [own.recent[w] for w, _ in top]})

    small_batches(docs.sparkSession)
    picked = docs.where(by_share(share_of(sample, docs.count()), col(id_col), col(text_col))).select(col(text_col).alias("_text"))
    counts = picked.mapInPandas(tidy(run, "tokens"), "word string, n long, length int").groupBy("word", "length").agg(F.sum("n").alias("n"))
    return {r.word: r.length for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()}


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, n_bytes, n_tokens) for each row. path is a tokenizer file that every worker can read (default: the installed one)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_lengths(docs, path, id_col, text_col))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, frequent = counting(path or model_path()), shared.value
        for batch in batches:
            texts = [t or "" for t in batch]
            yield pd.DataFrame({"n_bytes": [len(t.encode()) for t in texts], "n_tokens": [own.count(t, frequent) for t in texts]})

    rows = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"))
    return beside(rows, tidy(run, "tokens"), "n_bytes long, n_tokens long", "_text").select("_id", "n_bytes", "n_tokens")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select(F.col("_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
