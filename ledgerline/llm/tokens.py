"""Token counts of a byte-pair vocabulary by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps

MARK = "▁"
#: Counts of pre-tokens that a task keeps.
CACHE = 1 << 16
_PRE_TOKEN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.int64(2**62)


class Vocabulary:
    """Pairs of symbols that join to a piece, with ranks (0 first; equal scores, equal ranks).

    Symbols are pieces and single characters. A character that is no piece has as many tokens as
    UTF-8 bytes. The vocabulary must mark blanks with U+2581, join best scores first and have no
    piece with a mark behind another character, so that texts fall apart before each run of marks.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        order = {s: r for r, s in enumerate(sorted({score for _, score in pieces}, reverse=True))}
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece crosses the border of a pre-token")
        self.number: dict[str, int] = {}
        for piece, _ in pieces:
            self.number.setdefault(piece, len(self.number))
        n_pieces = len(self.number)
        for piece, _ in pieces:
            for char in piece:
                self.number.setdefault(char, len(self.number))
        self.cost = np.ones(len(self.number), np.int64)
        for char, i in self.number.items():
            if i >= n_pieces:
                self.cost[i] = len(char.encode())
        #: All other characters share a number for each length in bytes.
        self.other = np.arange(1, 5) + len(self.number) - 1
        self.cost = np.concatenate([self.cost, np.arange(1, 5)])
        pairs = {}
        for piece, score in pieces:
            for k in range(1, len(piece)):
                left, right = self.number.get(piece[:k]), self.number.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (order[score], self.number[piece])
        beside = {self.number[a] << 32 | self.number[b] for piece, _ in pieces
                  for a, b in zip(piece, piece[1:], strict=False)}
        #: Characters that stand side by side in a piece; no merge crosses any others.
        self.beside = np.array(sorted(beside), np.int64)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.joined = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Of a sentencepiece model with byte fallback and no normalisation but the marks."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return cls([(model.id_to_piece(i), model.get_score(i)) for i in range(len(model))
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                            or model.is_unused(i))])

    def numbered(self, text: str) -> list[int]:
        known, other = self.number, self.other
        return [known[c] if c in known else int(other[len(c.encode("utf-8", "surrogatepass")) - 1])
                for c in text]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of self.ranks and self.joined for each pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else (
            np.zeros(len(key), np.int64))

    def _parted(self, symbols: np.ndarray) -> np.ndarray:
        """Whether no piece holds a character and the next one side by side."""
        key = symbols[:-1] << 32 | symbols[1:]
        if not len(self.beside):
            return np.ones(len(key), bool)
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        return self.beside[at] != key

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token.

        All lie behind each other in one array, cut further wherever no piece spans two
        characters, which leaves short sequences also in scripts without blanks. A round finds the
        lowest rank of each sequence, joins its pairs of that rank from left to right in all
        sequences at once and looks up the pairs beside them. Where a joined symbol gets a pair of
        the same or a lower rank, that one may come first, so only the leftmost is joined in this
        round. Sequences without a pair leave with the symbols they have left.
        """
        lengths = np.array([len(t) for t in tokens], np.int64)
        symbols = np.array(self.numbered("".join(tokens)), np.int64)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        out = np.zeros(len(tokens), np.int64)
        if not len(symbols):
            return out
        cut = np.ones(len(symbols) + 1, bool)
        cut[1:-1] = (owner[1:] != owner[:-1]) | self._parted(symbols)
        start = np.flatnonzero(cut)
        live = owner[start[:-1]]
        none = len(self.keys)
        pair = np.full(len(symbols), none, np.int64)
        pair[:-1] = self.look_up(symbols[:-1], symbols[1:])
        pair[start[1:] - 1] = none
        while len(live):
            sizes = np.diff(start)
            rank = self.ranks[pair]
            lowest = np.minimum.reduceat(rank, start[:-1])
            going = lowest < _NONE
            if not going.all():
                sums = np.add.reduceat(self.cost[symbols], start[:-1])
                np.add.at(out, live[~going], sums[~going])
                stay = np.repeat(going, sizes)
                symbols, pair, rank = symbols[stay], pair[stay], rank[stay]
                live, lowest, sizes = live[going], lowest[going], sizes[going]
                start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                if not len(live):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of pairs that share a symbol every other one is joined, from the left.
            first = np.ones(len(at), bool)
            first[1:] = at[1:] != at[:-1] + 1
            run = np.flatnonzero(first)[np.cumsum(first) - 1]
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            of = np.searchsorted(start, at, "right") - 1
            at = at[self._in_order(symbols, pair, at, of, start, lowest)]
            of = np.searchsorted(start, at, "right") - 1
            symbols[at] = self.joined[pair[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            at = (np.cumsum(stay) - 1)[at]
            symbols, pair = symbols[stay], pair[stay]
            sizes = sizes - np.bincount(of, minlength=len(live))
            start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            inner = at < start[of + 1] - 1
            pair[at] = none
            pair[at[inner]] = self.look_up(symbols[at[inner]], symbols[at[inner] + 1])
            behind = at[at > start[of]]
            pair[behind - 1] = self.look_up(symbols[behind - 1], symbols[behind])
        return out

    def _in_order(self, symbols: np.ndarray, pair: np.ndarray, at: np.ndarray, of: np.ndarray,
                  start: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Which of the pairs at `at` can be joined in one round: all of a sequence, or its first
        if joining one from the left makes a pair that ranks no later."""
        joined = self.joined[pair[at]]
        left = symbols[np.maximum(at - 1, 0)]
        after = np.zeros(len(at), bool)
        after[1:] = at[1:] == at[:-1] + 2
        left[1:] = np.where(after[1:], joined[:-1], left[1:])
        right = symbols[np.minimum(at + 2, len(symbols) - 1)]
        early = (self.ranks[self.look_up(left, joined)] <= lowest[of]) & (at > start[of])
        early |= (self.ranks[self.look_up(joined, right)] <= lowest[of]) & (at + 2 < start[of + 1])
        mixed = np.zeros(len(lowest), bool)
        mixed[of[early]] = True
        leftmost = np.ones(len(at), bool)
        leftmost[1:] = of[1:] != of[:-1]
        return leftmost | ~mixed[of]


def _pre_tokens(text: str) -> list[str]:
    return _PRE_TOKEN.findall(MARK + text.replace(" ", MARK)) if text else []


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs(doc_id, text).

    path names the vocabulary file, which every executor has. Whole texts are counted as the
    library encodes them, with its leading mark and without begin or end tokens. Distinct
    pre-tokens of a step of texts are merged together, of any length; a task keeps the counts of the
    latest ones. Nothing is shuffled. A null text counts as empty: no bytes, no tokens.
    A null doc_id stays null, other columns are left out. Repeated rows get the same result each; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.from_file(path)
        known: OrderedDict[str, int] = OrderedDict()
        for batch in batches:
            for part in steps(batch, "text"):
                split = [_pre_tokens(t or "") for t in part["text"].to_pylist()]
                new = list({t for tokens in split for t in tokens}.difference(known))
                known.update(zip(new, vocabulary.count(new).tolist(), strict=True))
                sums = [sum(map(known.__getitem__, tokens)) for tokens in split]
                while len(known) > CACHE:
                    known.popitem(last=False)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["n_bytes"], pa.array(sums, pa.int64()),
                     pa.array([n > limit for n in sums], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       size.alias("n_bytes")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
