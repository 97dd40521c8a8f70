"""Text similarity on a 0-100 scale, based on the longest common subsequence (LCS).

token_set: compare the distinct blank-separated tokens of two texts. With `both` the joined common
tokens, `left`/`right` the joined sorted remainders, the score is the best of three Indel ratios:
both+left against both+right, both against both+left, both against both+right. It is 100 when one
token set contains the other, and 0 when a side has no token. Case matters.

partial: best Indel ratio of the shorter text against all windows of the longer one that are not
longer than it.

The helpers here work on single values inside tasks; `block_best` compares one batch of probes with
one block of choices and is what the fuzzy join runs.
"""

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import constants as K


def _places(a: str) -> dict[str, int]:
    """Bit set of the positions of every character."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    return places


def _lcs(places: dict[str, int], size: int, b: str) -> int:
    """Bit-parallel LCS: one bit per character of the first text, cleared where a chain grows."""
    full = (1 << size) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def lcs_length(a: str, b: str) -> int:
    return _lcs(_places(a), len(a), b) if a and b else 0


def _ratio(distance: int, total: int) -> float:
    return 100.0 - 100.0 * distance / total if total else 100.0


def token_set_score(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    if both and (len(both) == len(left) or len(both) == len(right)):
        return 100.0
    rest_left = " ".join(sorted(left - both))
    rest_right = " ".join(sorted(right - both))
    shared = sum(map(len, both)) + len(both) - 1 if both else 0
    gap = 1 if shared else 0
    left_len, right_len = shared + gap + len(rest_left), shared + gap + len(rest_right)
    distance = len(rest_left) + len(rest_right) - 2 * lcs_length(rest_left, rest_right)
    score = _ratio(distance, left_len + right_len)
    if shared:
        score = max(score, _ratio(gap + len(rest_left), shared + left_len),
                    _ratio(gap + len(rest_right), shared + right_len))
    return score


def _best_window(needle: str, text: str) -> float:
    n = len(needle)
    windows = {text[max(0, end - n):end] for end in range(1, len(text) + 1)}
    windows |= {text[start:start + n] for start in range(len(text))}
    return max(_ratio(n + len(w) - 2 * lcs_length(needle, w), n + len(w)) for w in windows)


def partial_score(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    if len(a) == len(b):
        best = max(best, _best_window(long, short))
    return best


def _pairwise(score):
    @F.pandas_udf(T.DoubleType())
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b)],
                         dtype="float64")
    return scored


token_set_ratio = _pairwise(token_set_score)
partial_ratio = _pairwise(partial_score)


# --- header cells against the column aliases ---------------------------------------

def with_field_scores(df: DataFrame, column: str, score) -> DataFrame:
    """Adds `scores`: for every cell of an array column, its best score per field, null for null.

    Runs as a step of its own, so that later expressions read the result and never repeat it.
    """
    def scored(batches):
        for batch in batches:
            rows = batch.column(column).to_pylist()
            known: dict = {None: None}  # headings repeat from document to document
            for cell in {c for row in rows if row is not None for c in row if c is not None}:
                known[cell] = [max(score(cell, alias) for alias in aliases)
                               for aliases in K.COLUMN_ALIASES.values()]
            scores = [None if row is None else [known[c] for c in row] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.list_(pa.list_(pa.float64())))],
                names=[*batch.schema.names, "scores"])

    schema = T.StructType([*df.schema.fields, T.StructField(
        "scores", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return df.mapInArrow(scored, schema)


# --- one batch of probes against one block of choices --------------------------------

MATCHES = T.ArrayType(T.StructType([
    T.StructField("probe", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("row_pos", T.LongType()),
]))


_NOWHERE = np.iinfo(np.int64).max


#: Blocks of fewer choices are compared one by one; larger ones are walked as a tree of prefixes if it
#: has at most so many nodes for each choice, as names with common beginnings do.
TREE_CHOICES, TREE_NODES = 256, 4
#: Pairs of a probe and a prefix that one step of the walk handles, and those that the first, greedy
#: walk follows for each probe.
WALK_PAIRS, GREEDY = 1 << 15, 4
_CLOSE = 1e-9
_LOW_BITS = np.array([(1 << i) - 1 for i in range(65)], dtype=np.uint64)


class _Block:
    """Lengths, character counts, token postings and character codes of a block of choices."""

    def __init__(self, texts: list[str]):
        tokens = [frozenset(t.split()) for t in texts]
        self.canon = [" ".join(sorted(t)) for t in tokens]
        self.size = np.array([len(c) for c in self.canon], dtype=np.int64)
        points = np.frombuffer("".join(self.canon).encode("utf-32-le", "surrogatepass"), np.uint32)
        known, self.flat = np.unique(points, return_inverse=True)
        self.code = {chr(c): i for i, c in enumerate(known.tolist())}
        self.offset = np.cumsum(self.size) - self.size
        self.postings: dict[str, list[int]] = {}
        for i, of_text in enumerate(tokens):
            for token in of_text:
                self.postings.setdefault(token, []).append(i)

    def tokens(self, i: int) -> frozenset:
        return frozenset(self.canon[i].split(" "))

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each character is in each choice."""
        counter = np.uint8 if self.size.max(initial=0) < 256 else np.int32
        counts = np.zeros((len(self.code), len(self.canon)), dtype=counter)
        np.add.at(counts, (self.flat, np.repeat(np.arange(len(self.canon)), self.size)), 1)
        return counts

    @cached_property
    def tree(self) -> "_Tree":
        return _Tree(self)

    def common_characters(self, canon: str, picks: np.ndarray) -> np.ndarray:
        """Size of the character-bag intersection with the picked choices: an upper bound of any LCS."""
        bag: dict[str, int] = {}
        for ch in canon:
            if ch in self.code:
                bag[ch] = bag.get(ch, 0) + 1
        counter = self.counts.dtype.type
        most = int(np.iinfo(counter).max)
        # A sum of these counts is at most the length of the choice and fits the counter.
        common = np.zeros(len(picks), dtype=counter)
        every = len(picks) == len(self.canon)
        for ch, n in bag.items():
            of_char = self.counts[self.code[ch]]
            common += np.minimum(of_char if every else of_char[picks], counter(min(n, most)))
        return common.astype(np.int64)

    def shared_length(self, probe_tokens: frozenset) -> np.ndarray:
        """Length of the joined common tokens with every choice."""
        shared = np.zeros(len(self.canon), dtype=np.int64)
        for token in probe_tokens:
            hits = self.postings.get(token)
            if hits:
                shared[hits] += len(token) + 1
        return np.maximum(shared - 1, 0)

    def lcs(self, canon: str, picks: np.ndarray) -> np.ndarray:
        """LCS with the picked choices; many at once if the probe has at most 64 characters."""
        if len(picks) < 128 or len(canon) > 64:
            places = _places(canon)
            return np.array([_lcs(places, len(canon), self.canon[i]) for i in picks],
                            dtype=np.int64)
        places = np.zeros(len(self.code), dtype=np.uint64)
        for i, ch in enumerate(canon):
            if ch in self.code:
                places[self.code[ch]] |= np.uint64(1 << i)
        row = np.full(len(picks), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(int(self.size[picks].max())):
            longer = np.flatnonzero(self.size[picks] > j)
            at = row[longer]
            hit = at & places[self.flat[self.offset[picks[longer]] + j]]
            row[longer] = (at + hit) | (at - hit)
        mask = np.uint64((1 << len(canon)) - 1)
        return np.bitwise_count(~row & mask).astype(np.int64)


class _Tree:
    """The prefixes of a block's choices; node 0 is the empty one, the nodes of a depth stand together.

    The LCS row of a prefix serves all choices that begin with it. With n characters in the probe and
    at most r to come, the LCS grows from that of the probe's first n - r characters by r at the most,
    so a prefix whose choices cannot reach the score found so far is left with all of them.
    """

    def __init__(self, block: _Block):
        self.block = block
        rows = np.array(sorted((i for i, c in enumerate(block.canon) if c),
                               key=block.canon.__getitem__), dtype=np.int64)
        flat, offset, size = block.flat, block.offset, block.size
        # Length of the prefix that a choice shares with the one before it.
        alike = np.zeros(len(rows), dtype=np.int64)
        alike[:1] = -1
        open_ = np.arange(1, len(rows))
        while len(open_):
            depth = alike[open_[0]]
            open_ = open_[np.minimum(size[rows[open_ - 1]], size[rows[open_]]) > depth]
            open_ = open_[flat[offset[rows[open_ - 1]] + depth] == flat[offset[rows[open_]] + depth]]
            alike[open_] += 1
        # Equal texts of tokens, in whatever order: one choice.
        self.choice_of = rows
        depth, parts, firsts, first_node = 0, [], np.zeros(1, np.int64), 0
        at = np.arange(len(rows))
        names = ("code", "depth", "shortest", "longest", "row")
        parts.append((np.zeros(1, np.int64), np.zeros(1, np.int64),
                      np.array([size[rows].min(initial=0)]), np.array([size[rows].max(initial=0)]),
                      np.zeros(1, np.int64)))
        begins, ends = [], []
        n_nodes = 1
        while True:
            depth += 1
            at = at[size[rows[at]] >= depth]
            heads = np.flatnonzero(alike[at] < depth)
            starts = at[heads]
            place = np.searchsorted(starts, firsts)
            begins.append(n_nodes + place)
            ends.append(n_nodes + np.append(place[1:], len(starts)))
            if not len(at):
                break
            sizes = size[rows[at]]
            parts.append((flat[offset[rows[starts]] + depth - 1], np.full(len(starts), depth),
                          np.minimum.reduceat(sizes, heads), np.maximum.reduceat(sizes, heads),
                          starts))
            firsts = starts
            n_nodes += len(starts)
        for name, columns in zip(names, zip(*parts)):
            setattr(self, name, np.concatenate(columns).astype(np.int64))
        self.begin, self.end = np.concatenate(begins), np.concatenate(ends)
        #: Choices with the same tokens stand in a row at the node where they end.
        self.ends_here = np.zeros(n_nodes, bool)
        if len(rows):
            self.ends_here[1:] = size[rows[self.row[1:]]] == self.depth[1:]
        self.earliest = None

    def placed(self, positions: np.ndarray) -> None:
        """Lowest position of the choices below each node, and of those that end there."""
        of_row = positions[self.choice_of]
        size = self.block.size[self.choice_of]
        self.earliest = np.full(len(self.row), _NOWHERE)
        self.lowest = np.full(len(self.row), _NOWHERE)
        last = np.zeros(len(of_row), dtype=np.int64)
        for depth in range(1, int(size.max(initial=0)) + 1):
            first, stop = np.searchsorted(self.depth, [depth, depth + 1])
            alive = np.flatnonzero(size >= depth)
            node = np.searchsorted(self.row[first:stop], alive, "right") - 1 + first
            np.minimum.at(self.earliest, node, of_row[alive])
            last[alive] = node
        if len(of_row):
            np.minimum.at(self.lowest, last, of_row)

    def search(self, canons: list[str], tokens: list[frozenset], score: np.ndarray,
               at: np.ndarray) -> None:
        """Raises score and at of each probe to its best choice without a common token."""
        code = self.block.code
        kept = [[code[ch] for ch in c if ch in code] for c in canons]
        self.kept = np.array([len(k) for k in kept], dtype=np.int64)
        self.whole = np.array([len(c) for c in canons], dtype=np.int64)
        self.places = np.zeros((len(canons), max(len(code), 1)), dtype=np.uint64)
        for p, codes in enumerate(kept):
            for i, c in enumerate(codes):
                self.places[p, c] |= np.uint64(1 << i)
        self.tokens, self.score, self.at = tokens, score, at
        n = len(canons)
        start = (np.arange(n), np.zeros(n, np.int64), np.full(n, _LOW_BITS[64]),
                 np.full(n, 100.0))
        step = start
        while len(step[0]):
            step = self._below(*step)
            order = np.lexsort((-step[3], step[0]))
            probe = step[0][order]
            nth = np.arange(len(order)) - np.searchsorted(probe, probe)
            step = tuple(x[order[nth < GREEDY]] for x in step)
        open_ = [start]
        while open_:
            step = open_.pop()
            wins = self._can_win(step[0], step[1], step[3])
            step = self._below(*(x[wins] for x in step))
            # The deepest and most promising pairs go on first; what waits stays small.
            order = np.argsort(step[3], kind="stable")
            for a in range(0, len(order), WALK_PAIRS):
                open_.append(tuple(x[order[a:a + WALK_PAIRS]] for x in step))

    def _can_win(self, probe, node, bound) -> np.ndarray:
        score = self.score[probe]
        return (bound > score + _CLOSE) | ((bound > score - _CLOSE)
                                           & (self.earliest[node] < self.at[probe]))

    def _below(self, probe, node, row, _):
        """The prefixes one longer that can still win, after the choices among them are scored."""
        begin, count = self.begin[node], self.end[node] - self.begin[node]
        which = np.repeat(np.arange(len(node)), count)
        node = np.arange(len(which)) + np.repeat(begin - (np.cumsum(count) - count), count)
        probe, row = probe[which], row[which]
        hit = row & self.places[probe, self.code[node]]
        row = (row + hit) | (row - hit)
        kept, depth = self.kept[probe], self.depth[node]
        rest = self.longest[node] - depth
        head = np.maximum(kept - rest, 0)
        most = head - np.bitwise_count(row & _LOW_BITS[head]) + np.minimum(rest, kept)
        now = kept - np.bitwise_count(row & _LOW_BITS[kept])
        total = self.whole[probe] + np.maximum(self.shortest[node], depth + most - now)
        bound = 100.0 - 100.0 * (total - 2 * most) / total
        wins = self._can_win(probe, node, bound)
        scored = np.flatnonzero(wins & self.ends_here[node])
        if len(scored):
            total = self.whole[probe[scored]] + depth[scored]
            self._take(probe[scored], node[scored],
                       100.0 - 100.0 * (total - 2 * now[scored]) / total)
            wins = self._can_win(probe, node, bound)
        wins &= self.end[node] > self.begin[node]
        return probe[wins], node[wins], row[wins], bound[wins]

    def _take(self, probe, node, score) -> None:
        lowest = self.lowest[node]
        better = np.flatnonzero((score > self.score[probe])
                                | ((score == self.score[probe]) & (lowest < self.at[probe])))
        order = better[np.lexsort((lowest[better], -score[better], probe[better]))]
        done = -1
        for p, k in zip(probe[order].tolist(), order.tolist()):
            if p == done:
                continue
            choice = self.choice_of[self.row[node[k]]]
            if self.tokens[p].isdisjoint(self.block.tokens(choice)):
                self.score[p], self.at[p], done = score[k], lowest[k], p


def _full_ratios(block: _Block, tokens: frozenset, canon: str, shared: np.ndarray,
                 picks: np.ndarray) -> np.ndarray:
    """Ratio of both+left against both+right for the picked choices (none contains the other)."""
    total = len(canon) + block.size[picks]
    matched = np.zeros(len(picks), dtype=np.int64)
    alone = shared[picks] == 0
    if alone.any():
        matched[alone] = block.lcs(canon, picks[alone])
    for k in np.flatnonzero(~alone):
        other = block.tokens(picks[k])
        matched[k] = shared[picks[k]] + 1 + lcs_length(" ".join(sorted(tokens - other)),
                                                       " ".join(sorted(other - tokens)))
    return 100.0 - 100.0 * (total - 2 * matched) / total


def best_of_block(texts, positions, cutoff: float):
    """mapInPandas step: batches of distinct probe texts -> (text, score, row_pos) of the best."""
    def run(batches):
        block = _Block(list(texts))
        for batch in batches:
            found = block_best(batch["text"], [cutoff] * len(batch), block, positions, cutoff)
            yield pd.DataFrame(found, columns=["probe", "score", "row_pos"])\
                .rename(columns={"probe": "text"})
    return run


def block_best(probes, floors, block: _Block, positions, cutoff: float) -> list[dict]:
    """Best choice per probe: highest score, then lowest position; only scores >= its floor.

    Choices with a common token are scored one by one; of a large block with common prefixes, those
    without one along the tree of its prefixes.
    """
    positions = np.asarray(positions, dtype=np.int64)
    by_tree = (len(block.canon) >= TREE_CHOICES
               and len(block.tree.row) <= TREE_NODES * len(block.canon))
    found, walked = [], []
    for probe, floor in zip(probes, floors):
        tokens = frozenset(probe.split())
        if not tokens:
            continue
        canon = " ".join(sorted(tokens))
        walks = by_tree and len(canon) <= 64
        if walks and not any(t in block.postings for t in tokens):
            score, at, rest = max(cutoff, floor), _NOWHERE, True
        else:
            score, at, rest = _scan(tokens, canon, floor, block, positions, cutoff, walks)
        if walks and rest:
            walked.append(len(found))
        found.append([probe, canon, tokens, score, at])
    if walked:
        if block.tree.earliest is None:
            block.tree.placed(positions)
        # The table of places stays small, whatever the alphabet.
        step = max(16, min(4096, (1 << 20) // max(len(block.code), 1)))
        for a in range(0, len(walked), step):
            part = [found[i] for i in walked[a:a + step]]
            score, at = np.array([f[3] for f in part]), np.array([f[4] for f in part])
            block.tree.search([f[1] for f in part], [f[2] for f in part], score, at)
            for f, s, p in zip(part, score.tolist(), at.tolist()):
                f[3:] = s, p
    return [{"probe": f[0], "score": float(f[3]), "row_pos": int(f[4])}
            for f in found if f[4] < _NOWHERE]


def _scan(tokens: frozenset, canon: str, floor: float, block: _Block, positions: np.ndarray,
          cutoff: float, sharing_only: bool) -> tuple[float, int, bool]:
    """(score, position, whether choices are left) of one probe against the choices of a block.

    Closed-form scores come first. The LCS runs only for choices whose upper bound can still win,
    best bound first, so no choice that could win is skipped.
    """
    total = len(canon) + block.size
    shared = block.shared_length(tokens)
    shorter = np.minimum(len(canon), block.size)
    sharing = np.flatnonzero(shared)
    scores = np.zeros(len(shared))
    scores[sharing] = 100.0 - (100.0 * (shorter[sharing] - shared[sharing])
                               / (shorter[sharing] + shared[sharing]))
    contained = (shared > 0) & (shared == shorter)
    scores[contained] = 100.0

    score, at = max(cutoff, floor), _NOWHERE
    top = scores.max(initial=0.0)
    if top >= score:
        score, at = top, positions[scores == top].min()
    left = sharing if sharing_only else np.flatnonzero(block.size > 0)
    left = left[~contained[left]]
    bounds = np.zeros(len(shared))
    bounds[left] = 100.0 - 100.0 * (total[left] - 2 * block.common_characters(canon, left)) \
        / total[left]
    left = left[bounds[left] >= score]
    step = 16
    while len(left):
        # The most promising choices first; what they reach closes most of the others.
        if len(left) > step:
            best = np.argpartition(-bounds[left], step)
            picks, left = left[best[:step]], left[best[step:]]
        else:
            picks, left = left, left[:0]
        ratios = _full_ratios(block, tokens, canon, shared, picks)
        top = ratios.max()
        if top >= score:
            first = positions[picks[ratios == top]].min()
            at = first if top > score else min(at, first)
            score = top
        left = left[bounds[left] >= score]
        step = 512
    return score, at, len(sharing) < len(shared) and score < 100.0


def block_matches(cutoff: float):
    @F.pandas_udf(MATCHES)
    def matches(probes: pd.Series, floors: pd.Series, texts: pd.Series,
                positions: pd.Series) -> pd.Series:
        return pd.Series([block_best(p, f, _Block(list(t)), pos, cutoff) for p, f, t, pos in
                          zip(probes, floors, texts, positions)])
    return matches
