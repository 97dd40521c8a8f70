"""Byte-level BPE by backtracking over longest matches; decoding by an offset table."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress, count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps

#: Pre-tokens whose ids a task keeps, and entries of its table of pairs.
CACHE = 1 << 18
PAIRS = 1 << 19
#: Pre-tokens of more bytes are encoded anew each time they come.
LONGEST_KEPT = 256
#: Token ids that one numpy step of decoding handles; a longer single list is a step of its own.
STEP_IDS = 1 << 20
# The contractions and character classes at which byte-level vocabularies cut texts.
_CUTS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Stands for a character that is neither letter, number nor blank; no character of a vocabulary's
#: bytes, so it also parts the pre-tokens of one search.
_OTHER, _PART = "†", chr(256)


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def _spelled_out(cuts: str) -> str:
    """The cuts for characters up to U+FFFF, each class as ranges of the regex module's characters."""
    members = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = [run for first, last in ((0, 0xD7FF), (0xE000, 0xFFFF))
                for run in regex.findall(name + "+", "".join(map(chr, range(first, last + 1))))]
        members[name] = "".join(f"\\u{ord(r[0]):04x}-\\u{ord(r[-1]):04x}" for r in runs)
    parts = re.split(r"(\[[^]]*\]|\\p\{.\}|\\s|\\S)", cuts)
    for i, part in enumerate(parts):
        if part.startswith("["):
            for name, ranges in members.items():
                part = part.replace(name, ranges)
        elif part in members:
            part = f"[{members[part]}]"
        elif part == r"\S":
            part = f"[^{members[r'\s']}]"
        parts[i] = part
    return "".join(parts)


def _runs(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[begins[k]:begins[k] + sizes[k]] behind one another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(begins - (ends - sizes), sizes)
                  + np.arange(ends[-1] if len(ends) else 0)]


class PreTokens:
    """Cuts texts where the library does.

    The classes of characters come from the regex module. Characters that Python's own tables do
    not know yet may be newer than the library's; the library is asked for each of them once. Texts
    without characters beyond U+FFFF are cut by Python's own, faster expressions with the same
    classes spelled out.
    """

    def __init__(self):
        from tokenizers.pre_tokenizers import ByteLevel

        asked = ByteLevel(add_prefix_space=False)
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        newer = [c for c in regex.findall(r"[\p{L}\p{N}]", every)
                 if unicodedata.category(c) == "Cn"]
        self.others = {c for c in newer if len(asked.pre_tokenize_str(f"!{c}!")) == 1}
        self.cuts = regex.compile(_CUTS)
        self.plain = re.compile(_spelled_out(_CUTS))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.table = dict.fromkeys(map(ord, self.others), _OTHER)
        self.first = re.compile(f"[{min(self.others, default=chr(0x10FFFF))}-{chr(0x10FFFF)}]")

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text)
        if not self.first.search(text) or self.others.isdisjoint(text):
            return self._pattern(text).findall(text)
        known = text.translate(self.table)
        return [text[m.start():m.end()] for m in self._pattern(known).finditer(known)]

    def _pattern(self, text: str):
        return self.cuts if self.beyond.search(text) else self.plain


class ByteBPE:
    """A byte-level BPE vocabulary, its tokens numbered in the order in which merges make them.

    Two tokens stand side by side in a result if no merge joins the symbols at their border before
    both are made; a sequence is the result of merging if that holds at every border. So the
    encoder takes the longest token at each place that suits its neighbour, a shorter one if the
    text cannot go on behind it, and steps back if none is left. Each place fails once at most, so
    the time is linear in the text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts["pre_tokenizer"] or {}
        model = parts["model"]
        if (parts["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
                or not cut.get("use_regex", True) or model.get("type") != "BPE"
                or model.get("dropout") or model.get("ignore_merges")):
            raise ValueError("not a plain byte-level vocabulary")
        of_letter = {c: b for b, c in enumerate(byte_letters())}

        def as_bytes(entry: str) -> str:
            return bytes(of_letter[c] for c in entry).decode("latin-1")

        ids = {as_bytes(entry): i for entry, i in model["vocab"].items()}
        number = {chr(b): b for b in range(256)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[int, int] = {}
        for pair in model["merges"]:
            a, b = (as_bytes(e) for e in (pair.split(" ") if isinstance(pair, str) else pair))
            if a + b in number:
                raise ValueError("two merges make one token")
            made = number[a + b] = len(number)
            self.left.append(number[a])
            self.right.append(number[b])
            self.joined[number[a] << 32 | number[b]] = made
        self.id_of = np.array([ids[token] for token in number], np.int32)
        self.size = [len(token) for token in number]
        self.widest = max(self.size)
        # Tokens that merging their own bytes does not give cannot occur.
        valid = [True] * 256
        for t in range(256, len(number)):
            a, b = self.left[t], self.right[t]
            valid.append(valid[a] and valid[b] and self._apart(a, b, t))
        self.find = ahocorasick.Automaton()
        for token, t in number.items():
            if valid[t]:
                self.find.add_word(token, t)
        self.find.make_automaton()
        #: The longest token that begins a token; -1 for single bytes.
        self.shorter = [-1] * len(number)
        for token, t in number.items():
            for k in range(len(token) - 1, 0, -1):
                start = number.get(token[:k], -1)
                if start >= 0 and valid[start]:
                    self.shorter[t] = start
                    break
        #: Pairs of tokens looked at so far, and whether they stand side by side in a result.
        self.suits: dict[int, bool] = {}
        added = sorted(parts.get("added_tokens") or [], key=lambda t: -len(t["content"]))
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens must be plain strings")
        self.added = {t["content"]: t["id"] for t in added}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") \
            if added else None
        self.pre_tokens = PreTokens()
        self._keep((), np.zeros(0, np.int64), np.zeros(0, np.int32))
        entries = {i: token.encode("latin-1") for token, i in ids.items()}
        entries |= {i: content.encode() for content, i in self.added.items()}
        sizes = [len(entries.get(i, b"")) for i in range(max(entries) + 1)]
        self.bytes = np.frombuffer(b"".join(entries[i] for i in sorted(entries)), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def _apart(self, a: int, b: int, until: int = 1 << 60) -> bool:
        """Whether no merge before `until` crosses the border of a and b.

        Both are taken apart, the later made first, down to the bytes at the border: each pair of
        symbols that met there must not merge before one of them went on. A right symbol's own
        merge counts too, since of equal merges the left one comes first.
        """
        while True:
            if self.joined.get(a << 32 | b, until) < until:
                return False
            if a > b or b < 256:
                if a < 256:
                    return True
                until, a = a, self.right[a]
            else:
                until, b = b + 1, self.left[b]

    def _beside(self, pair: int) -> bool:
        """Whether the tokens of a pair, as left << 32 | right, suit each other."""
        suits = self.suits.get(pair)
        if suits is None:
            suits = self.suits[pair] = self._apart(pair >> 32, pair & 0xFFFFFFFF)
        return suits

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens in a row and the number of each one's.

        One search takes the longest match at each place where the one before it ends. Where all
        these suit each other they are the result; the other pre-tokens are walked from the first
        match that does not suit the one before it."""
        data = [p.encode().decode("latin-1") for p in pieces]
        found = np.fromiter(chain.from_iterable(self.find.iter_long(_PART.join(data))), np.int64)
        ends, tokens = found[::2], found[1::2]
        # The last match of each pre-token; the pair that it makes with the next is none.
        last = np.searchsorted(ends, np.cumsum([len(d) + 1 for d in data]) - 2)
        sizes = np.diff(last, prepend=-1)
        inner = np.ones(len(tokens), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        pairs, which = np.unique(tokens[at] << 32 | tokens[at + 1], return_inverse=True)
        good = np.fromiter(map(self._beside, pairs.tolist()), bool, len(pairs))
        bad = at[~good[which]]
        open_, first = np.unique(np.searchsorted(last, bad), return_index=True)
        begins = last + 1 - sizes
        listed = tokens.tolist() if len(open_) else []
        walked = [self._walk(data[k], listed[a:b], listed[b]) for k, a, b in zip(
            open_.tolist(), begins[open_].tolist(), (bad[first] + 1).tolist(), strict=True)]
        sizes[open_] = [len(w) for w in walked]
        begins[open_] = len(tokens) + np.cumsum(sizes[open_]) - sizes[open_]
        tokens = np.concatenate([tokens, np.fromiter(chain.from_iterable(walked), np.int64)])
        if len(self.suits) > PAIRS:
            self.suits.clear()
        return self.id_of[_runs(tokens, begins, sizes)], sizes

    def _walk(self, piece: str, taken: list[int], token: int) -> list[int]:
        """Tokens of a pre-token that begins with those taken, behind which the longest one, token,
        does not suit. A place is reached once: it is left for the end or as failed."""
        size, shorter, suits, widest, find = \
            self.size, self.shorter, self.suits, self.widest, self.find
        stop = len(piece)
        failed: set[int] = set()
        at, last = sum([size[t] for t in taken]), taken[-1]
        while True:
            token = shorter[token]
            while token < 0:
                failed.add(at)
                token = taken.pop()
                last = taken[-1] if taken else -1
                at -= size[token]
                token = shorter[token]
            while True:
                end = at + size[token]
                if end in failed:
                    break
                if last >= 0:
                    pair = last << 32 | token
                    fits = suits.get(pair)
                    if fits is None:
                        fits = suits[pair] = self._apart(last, token)
                    if not fits:
                        break
                taken.append(token)
                if end == stop:
                    return taken
                at, last = end, token
                token = next(find.iter_long(piece[at:at + widest]))[1]

    def split(self, text: str, special: bool) -> list[str | int]:
        """Pre-tokens; strings of added tokens are their ids if special, else they are plain text."""
        if not special or self.special is None or not self.special.search(text):
            return self.pre_tokens(text)
        return [p for i, part in enumerate(self.special.split(text))
                for p in ([self.added[part]] if i % 2 else self.pre_tokens(part))]

    def _keep(self, pieces: Iterable[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Number the added tokens, then these pre-tokens, and keep the ids of both by number. A
        pre-token that is looked up for the first time gets the next number."""
        added = list(dict.fromkeys(self.added.values()))
        self.known = defaultdict(None, zip(chain(added, pieces), count()))
        self.known.default_factory = count(len(self.known)).__next__
        self.ids = np.concatenate([np.array(added, np.int32), ids])
        self.sizes = np.concatenate([np.ones(len(added), np.int64), sizes])

    def _shrink(self) -> None:
        """Keep the ids of the latest pre-tokens only, and of none that is very long."""
        n_added = len(set(self.added.values()))
        pieces = list(self.known)[n_added:]
        stays = np.fromiter(map(len, pieces), np.int64, len(pieces)) <= LONGEST_KEPT
        if len(pieces) > CACHE:
            stays[:len(pieces) - 3 * CACHE // 4] = False
        sizes = self.sizes[n_added:]
        self._keep(compress(pieces, stays.tolist()), sizes[stays],
                   self.ids[n_added:][np.repeat(stays, sizes)])

    def encode_flat(self, texts: list[str], special: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of each text's. Distinct pre-tokens are encoded
        together and kept for later texts."""
        if len(self.known) != len(self.sizes):  # a call before did not come to its end
            self._keep((), np.zeros(0, np.int64), np.zeros(0, np.int32))
        before = len(self.known)
        split = [self.split(t, special) for t in texts]
        n_pieces = np.array([len(pieces) for pieces in split], np.int64)
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64,
                              int(n_pieces.sum()))
        new = list(islice(self.known, before, None))
        if new:
            ids, sizes = self.encode_pieces(new)
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
        begins = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[numbers]
        ids = _runs(self.ids, begins[numbers], sizes)
        if len(self.known) > CACHE or max(map(len, new), default=0) > LONGEST_KEPT:
            self._shrink()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(ends[np.cumsum(n_pieces)], prepend=0)

    def encode(self, texts: list[str], special: bool = True) -> list[list[int]]:
        """Ids of each text."""
        ids, sizes = self.encode_flat(texts, special)
        all_, ends = ids.tolist(), np.cumsum(sizes).tolist()
        return [all_[end - n:end] for end, n in zip(ends, sizes.tolist(), strict=True)]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each list; list k is ids[starts[k]:starts[k + 1]]. Ids of no entry have no
        bytes, and bytes that are no UTF-8 become U+FFFD."""
        ids = np.where((ids >= 0) & (ids < len(self.offsets) - 1), ids, -1)
        first = np.where(ids < 0, 0, self.offsets[ids])
        sizes = np.where(ids < 0, 0, self.offsets[ids + 1] - first)
        data = _runs(self.bytes, first, sizes).tobytes()
        border = np.concatenate([[0], np.cumsum(sizes)])[starts].tolist()
        return [data[a:b].decode("utf-8", "replace")
                for a, b in zip(border[:-1], border[1:], strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    """The vocabulary of a file, read once by each Python worker."""
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """Rows (doc_id, ids), one for each row of docs(doc_id, text); other columns are left out.

    path names the vocabulary file, which every executor has. Whole texts are encoded as the
    library does without added begin or end tokens; special: strings of special tokens in a text
    are such tokens (else plain text). Nothing is shuffled. A null or empty text has no ids;
    repeated rows get the same ids each; an empty table gives no rows. A text of any length is
    encoded in time linear in it; one task holds it with its ids.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, sizes = bpe.encode_flat([t or "" for t in part["text"].to_pylist()], special)
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.ListArray.from_arrays(ends, pa.array(ids))],
                    ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows (*keep, text), one for each row of encoded(ids, *keep).

    A null list gives a null text, an empty one an empty text; ids without an entry and nulls in a
    list are passed over, as the library does.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            ends = np.cumsum(batch["ids"].value_lengths().fill_null(0).to_numpy())
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + STEP_IDS)))
                part = batch.slice(start, stop - start)
                ids = part["ids"].flatten().fill_null(-1).to_numpy()
                texts = bpe.decode(ids, np.concatenate([[before], ends[start:stop]]) - before)
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in keep] + [pa.array(
                        texts, pa.string(), mask=part["ids"].is_null().to_numpy(False))],
                    [*keep, "text"])
                start = stop

    small_batches(encoded.sparkSession)
    asked = encoded.select("ids", *keep)
    schema = asked.select(*keep).schema.add("text", "string")
    return asked.mapInArrow(run, schema)
