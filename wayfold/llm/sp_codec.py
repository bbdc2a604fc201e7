"""SentencePiece encoding by a prefix table of merge-type (BPE) pieces, and decoding.

The model merges, again and again, the adjacent pair whose joined piece has the best score (the leftmost on ties). For such merges the
encoding of every prefix has one last token, and a token is last exactly if it can stand alone (it encodes to itself) and is
compatible with the last token of what comes before it: the pair encodes to just that pair. So one pass over the text stores each
prefix's last token, with an automaton listing the pieces that end at a position, and the ids come out backwards.

Pieces never hold a space mark after another character, so text falls into units that merges never cross: the marks before a word
and the word. Encoded units and tested pairs are kept in bounded worker caches; a unit that isn't in the cache is encoded by the
table. Runs of two and more marks have pieces of one shared score, the lowest, so they merge last and from the left,
after the run's last mark had its chance to join the word: the left end grows to the longest piece again and again.

Characters without a piece become the bytes of their UTF-8 form. Decoding is the library's decode(ids).

Defined results: a null text is the empty text, which is the ids of begin and end; a text of any length is encoded whole, and memory beside it and its
ids is bounded by the caches' bytes; repeated rows get equal results; null ids are kept; an empty table gives an empty one; other columns play no part.
A model whose normaliser changes texts, or that handles spaces otherwise than this one, is refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Recent, beside, col, table, tidy, worker_state

MARK = "▁"
#: Bytes of the worker caches of units and pairs, and characters of the longest unit that is kept in one.
CACHE, PAIRS, LONG = 112 << 20, 40 << 20, 64
#: A pair of piece ids as one integer.
SHIFT = 20
MODEL = "piece_bpe_32k.model"
#: Below the score of any piece.
_NONE = float("-inf")


def _raw(i: int) -> bytes:
    return i.to_bytes(4, "little")


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(sp.vocab_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[sp.id_to_piece(i)], self.id[sp.id_to_piece(i)] = sp.get_score(i), i
        self.piece = {i: p for p, i in self.id.items()}
        self.own = {p: _raw(i) for p, i in self.id.items()}
        self.byte = [_raw(sp.piece_to_id(f"<0x{b:02X}>")) for b in range(256)]
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.runs = max((len(p) for p in self.id if not p.strip(MARK)), default=1)
        samples = ("a", " a", "a ", "  a  b", "\t", "\u00a0a\u3000", "ﬁ ⅷ Ａ", "e\u0301", "A\nb", "\u200b")
        if any(self.library.normalize(t) != (MARK + t.replace(" ", MARK)) for t in samples):
            raise ValueError("only the identity normaliser with a mark put before and no space removed is supported")
        if any(MARK in p.lstrip(MARK) for p in self.id) or any(p.startswith(MARK * 2) and p.strip(MARK) for p in self.id):
            raise ValueError("pieces with space marks inside are not supported")
        self.ends = ahocorasick.Automaton()
        for p in self.id:
            if p == MARK or not p.startswith(MARK * 2):
                if self.merged(p) == [p]:
                    self.ends.add_word(p, (self.id[p], len(p)))
        self.ends.make_automaton()
        self.pairs = Recent(self.stay, PAIRS)
        self.units = Recent(self.unit, CACHE)

    def merged(self, text: str) -> list[str]:
        """The definition, pair by pair; used on single pieces and pairs of them only."""
        parts, score = list(text), self.score.get
        scores = [score(x + y, _NONE) for x, y in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > _NONE:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], _NONE)
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], _NONE)
        return parts

    def stay(self, pair: int) -> bool:
        """Whether two pieces stay as they are when one follows the other."""
        a, b = self.piece[pair >> SHIFT], self.piece[pair & (1 << SHIFT) - 1]
        return self.merged(a + b) == [a, b]

    def tokens(self, unit: str) -> list[str]:
        """Tokens of a unit with at most one leading mark: the prefix table, read backwards.

        last and size have each prefix's last piece and its length. A position that no piece fits ends a character without a piece, which nothing
        merges with; the automaton reports matches in the order of their ends, so earlier positions are final when they are asked for.
        """
        n, pairs = len(unit), self.pairs
        last, size = [-1] * (n + 1), [1] * (n + 1)
        for end, (piece, length) in self.ends.iter(unit):
            end += 1
            if last[end] < 0:
                before = last[end - length] if end > length else -1
                if before < 0 or pairs[before << SHIFT | piece]:
                    last[end], size[end] = piece, length
        out = []
        while n:
            out.append(unit[n - size[n] : n])
            n -= size[n]
        return out[::-1]

    def spelled(self, token: str) -> bytes:
        """Ids of a token: its own, or those of its UTF-8 bytes."""
        found = self.id.get(token)
        return b"".join(self.byte[b] for b in token.encode()) if found is None else _raw(found)

    def unit(self, unit: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of the spaces before a word and the word."""
        word = unit.lstrip(" ")
        marks = len(unit) - len(word)
        tokens = self.tokens((MARK if marks else "") + word) if word else []
        if marks and word:
            marks -= 1
            if tokens[0] == MARK:
                marks, tokens = marks + 1, tokens[1:]
        own = self.own
        body = b"".join([own.get(t) or self.spelled(t) for t in tokens])
        if not marks:
            return body
        full = max(0, marks // self.runs - 1)
        return own[MARK * self.runs] * full + b"".join(own[p] for p in self.merged(MARK * (marks - full * self.runs))) + body

    def encode(self, text: str) -> bytes:
        """All ids of a text, begin and end included, as little-endian unsigned 32-bit integers."""
        out = [_raw(self.begin)]
        if text:
            out += [self.units[u] if len(u) <= LONG else self.unit(u) for u in _UNIT.findall(" " + text.replace(MARK, " "))]
        out.append(_raw(self.end))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


#: A unit: spaces, which become marks, and the word after them. Line breaks have no piece and stand alone.
_UNIT = re.compile("\n| *[^ \n]+| +")


def codec(path: str) -> PieceCodec:
    """One codec for each worker process and model file."""
    return worker_state(("pieces", path), lambda: PieceCodec(path))


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids binary) for each row. A null text is the empty text.

    path is a model file that every worker can read; without it the installed public model's own path is looked up where it is used.
    No shuffle: a row's result depends on its text alone.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = codec(path or model_path())
        for texts in batches:
            out = []
            for text in texts:
                ids = own.encode(text or "")
                decoded = own.decode(ids)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids)[: 3 + keep_ids])
            yield pd.DataFrame(out, columns=names)

    names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 3 + keep_ids]
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return beside(docs.select(col(id_col).alias("_id"), col(text_col).alias("_text")), tidy(run, "pieces"), kind, "_text").select("_id", *names)


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).withColumnRenamed("_id", "doc_id")
