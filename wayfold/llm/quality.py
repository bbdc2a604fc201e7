"""Quality classifier from weak labels: heuristic labellers vote, EM weighs them, a hashed linear scorer learns the posterior.

Labellers are expressions that vote 1 (good), 0 (bad) or -1 (no opinion) on whole texts. Votes are counted by pattern (at most 3^labellers rows,
whatever the corpus), over all documents. EM on the counts estimates the share of good documents and each labeller's accuracy on either class;
it starts from the majority vote, which also fixes which class is the good one. Posteriors go back to documents by a join with the patterns.
A bounded sample (ROWS documents in the order of a hash of id and text: a documented bound of the fit alone) trains logistic regression on hashed words
and word shapes of whole texts against the posteriors: tasks send feature counts, at most BUCKETS for each row. The scorer then reads every whole text.
Votes are taken in the pass that counts patterns and again in the one that scores: taking them once would write and read back all texts instead.

Defined results: null, empty and blank texts are no documents to keep: posterior as their votes say, score 0, not kept; a null doc_id is kept
as such; repeated rows agree; if nothing can be learned, score is the posterior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Recent, beside, by_share, col, let, share_of, small_batches, table, tidy

ROWS, BUCKETS, EPOCHS, CACHE, KEEP = 3_000, 1 << 16, 6, 48 << 20, 0.5
SYMBOLS = "#$%&*{}<>|\\^~=_@"
#: Frequent function words of the corpus's four languages.
FUNCTION_WORDS = "the of and to in is was for that with a le la les de des et un une est que der die das und ein eine ist mit von zu el los las y en por una con"


def _by_letter(words: list[str]) -> str:
    """The words as alternatives, grouped by first letter: a matcher gives up after one letter on most words."""
    groups: dict[str, list[str]] = {}
    for w in words:
        groups.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{a}(?:{'|'.join(sorted(set(rest), key=len, reverse=True))})" for a, rest in groups.items())


def vote_pattern(text: Column) -> Column:
    """The votes of all labellers on a text, comma-joined; measures are taken once. Words are runs without white space, empty lines are no lines."""
    t = F.coalesce(text, F.lit(""))
    count = lambda chars: F.regexp_count(t, F.lit(f"[{regex.escape(chars)}]"))
    lines = let(F.array_remove(F.split(t, "\n"), ""), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    measures = F.struct(
        F.size(F.array_remove(F.split(t, r"\s+"), "")).alias("words"), F.char_length(t).alias("chars"), count(SYMBOLS).alias("symbols"), count("0123456789").alias("digits"), lines.alias("lines"),
        F.regexp_count(t, F.lit(r"[.!?][\x20]*(?:\n|$)")).alias("ended"), F.regexp_count(t, F.lit(rf"(?i)(?<!\S)(?:{_by_letter(FUNCTION_WORDS.split())})(?!\S)")).alias("function"),
    )

    def votes(m: Column) -> Column:
        per_word = lambda n: n / F.greatest(F.lit(1), m["words"])
        vote = lambda good, bad: F.when(bad, 0).when(good, 1).otherwise(-1).cast("int")
        size = per_word(m["chars"] - m["words"])
        lines, distinct = m["lines"]["n"], m["lines"]["distinct"]
        symbols, digits, function = per_word(m["symbols"]), per_word(m["digits"]), per_word(m["function"])
        found = {
            "length": vote(m["words"] >= 60, m["words"] < 15),
            "symbols": vote(symbols < 0.02, symbols > 0.15),
            "word_size": vote(size.between(3.0, 9.0), ~size.between(2.0, 14.0)),
            "repeats": vote((lines >= 3) & (distinct == lines), (lines >= 3) & (distinct < 0.7 * lines)),
            "sentences": vote((lines > 0) & (m["ended"] >= 0.7 * lines), (lines > 0) & (m["ended"] < 0.2 * lines)),
            "function_words": vote(function >= 0.12, function < 0.03),
            "digits": vote(digits < 0.1, digits > 1.0),
        }
        return F.concat_ws(",", *[v.cast("string") for v in found.values()])

    return let(measures, votes)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """votes (patterns, labellers) and their counts to the posterior of good for each pattern, accuracies (labellers, 2), share of good."""
    said, up = votes >= 0, votes == 1
    good = np.where(said.any(axis=1), (up.sum(axis=1) + 1) / (said.sum(axis=1) + 2), 0.5)
    share, right = 0.5, np.full((votes.shape[1], 2), 0.7)
    for _ in range(rounds):
        before = good
        share = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        for k, weight in enumerate((1 - good, good)):
            w = (weight * counts)[:, None] * said
            right[:, k] = ((w * (up == bool(k))).sum(axis=0) + 4) / (w.sum(axis=0) + 5)
        right = np.clip(right, 0.05, 0.99)
        bad_odds = np.log(1 - share) + (said * np.where(up, np.log(1 - right[:, 0]), np.log(right[:, 0]))).sum(axis=1)
        good_odds = np.log(share) + (said * np.where(up, np.log(right[:, 1]), np.log(1 - right[:, 1]))).sum(axis=1)
        good = 1 / (1 + np.exp(np.clip(bad_odds - good_odds, -50, 50)))
        if np.abs(good - before).max(initial=0) < 1e-9:
            break
    return good, right, share


_LETTER, _DIGIT = regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+")


def features(word: str) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    shape = _DIGIT.sub("0", _LETTER.sub("a", word))
    return xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS, xxhash.xxh3_64_intdigest("\0" + shape) % BUCKETS


def counted_features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets of a whole text and their mean counts by word, or None without words."""
    words = (text or "").split()
    if not words:
        return None
    ids, n = np.unique(np.array([f for w in words for f in features(w)], np.int32), return_counts=True)
    return ids, (n / len(words)).astype(np.float32)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], posteriors: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on mean hashed features, by AdaGrad."""
    rng = np.random.default_rng(seed)
    weights, bias, seen, seen_bias = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, x = rows[i]
            error = 1 / (1 + np.exp(-np.clip(weights[ids] @ x + bias, -30, 30))) - posteriors[i]
            g = error * x + 1e-5 * weights[ids]
            seen[ids] += g * g
            weights[ids] -= 0.3 * g / np.sqrt(seen[ids])
            seen_bias += error * error
            bias -= 0.3 * error / np.sqrt(seen_bias)
    return weights, bias


def sampled_features(docs: DataFrame, rows: int, n: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(pattern, buckets, counts) of about `rows` of the n rows of docs(_id, _text), in the order of a hash; texts stay in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(h, p, *f) for h, p, t in zip(batch["_h"], batch["_pattern"], batch["_text"]) if (f := counted_features(t))]
            yield pd.DataFrame([(h, p, i.tobytes(), x.tobytes()) for h, p, i, x in found], columns=["_h", "_pattern", "_ids", "_x"])

    picked = docs.where(by_share(share_of(rows, n), "_id", "_text")).withColumn("_pattern", vote_pattern(F.col("_text")))
    sent = picked.select(F.xxhash64("_id", "_text").alias("_h"), "_pattern", "_text").mapInPandas(tidy(run), "_h long, _pattern string, _ids binary, _x binary")
    drawn = sorted((tuple(r) for r in sent.limit(2 * rows).collect()), key=lambda r: (r[0] % 2**52, r[2], r[3]))[:rows]
    return [(p, np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for _, p, i, x in drawn]


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """(_id, _posterior, _score, _kept) for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"))
    voted = docs.withColumn("_pattern", vote_pattern(F.col("_text")))
    counted = voted.groupBy("_pattern").count().orderBy("_pattern").collect()
    if counted:
        good, _, _ = expectation_maximisation(np.array([[int(x) for x in r["_pattern"].split(",")] for r in counted]), np.array([r["count"] for r in counted], float))
    known = {r["_pattern"]: float(g) for r, g in zip(counted, good)} if counted else {}
    sample = sampled_features(docs, rows, sum(r["count"] for r in counted))
    fitted = fit_scorer([(ids, x) for _, ids, x in sample], np.array([known[p] for p, _, _ in sample])) if sample else None
    shared = spark.sparkContext.broadcast((known, fitted))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        posterior, model = shared.value
        if model:
            weights, bias = model
            worth = Recent(lambda w: float(sum(weights[f] for f in features(w))), CACHE)
        for texts, patterns in batches:
            p = [posterior[x] for x in patterns]
            scores = []
            for text, own in zip(texts, p):
                words = text.split() if text else []
                if not words:
                    scores.append(0.0)
                elif model is None:
                    scores.append(own)
                else:
                    z = sum(map(worth.__getitem__, words)) / len(words) + bias
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            yield pd.DataFrame({"_posterior": p, "_score": scores, "_kept": [s >= KEEP for s in scores]})

    found = beside(voted, tidy(run), "_posterior double, _score double, _kept boolean", "_text", "_pattern")
    return found.select("_id", "_posterior", "_score", "_kept")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("_id").alias("doc_id"), F.col("_posterior").alias("posterior"), F.col("_score").alias("score"), F.col("_kept").alias("kept"))
