"""Mapping of heading cells to fields.

A mapping is an array with one entry per column: the index into `constants.FIELDS`, or -1.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import constants as K
from ledgerline.functions.scoring import partial_score, token_set_score

UNMAPPED = -1
_ALIASES = [alias for aliases in K.COLUMN_ALIASES.values() for alias in aliases]
_ALIAS_TOKENS = {t for alias in _ALIASES for t in alias.split()}
_ALIAS_TEXTS = sorted({" ".join(sorted(set(alias.split()))) for alias in _ALIASES})
_LETTERS = np.array(sorted(map(ord, set("".join(_ALIAS_TEXTS)))), np.uint32)
_ALIAS_LETTERS = {alias: np.array([alias.count(chr(c)) for c in _LETTERS]) for alias in _ALIAS_TEXTS}


def _can_be_near(texts: list[str], cutoff: float) -> np.ndarray:
    """Whether a text without a common token can reach the cutoff with some alias.

    Its score is 100 (2 lcs / (la + lb)), and the characters that both hold are never fewer than
    the LCS.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_of = np.repeat(np.arange(len(texts)), sizes)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    code = np.minimum(np.searchsorted(_LETTERS, chars), len(_LETTERS) - 1)
    known = _LETTERS[code] == chars
    counts = np.bincount(text_of[known] * len(_LETTERS) + code[known],
                         minlength=len(texts) * len(_LETTERS)).reshape(len(texts), len(_LETTERS))
    near = np.zeros(len(texts), bool)
    for alias, letters in _ALIAS_LETTERS.items():
        # Only texts of a length that could reach the cutoff by itself are compared.
        least = cutoff / 200.0 * (sizes + len(alias)) - 1e-9
        some = np.flatnonzero(~near & (np.minimum(sizes, len(alias)) >= least))
        near[some] = np.minimum(counts[some], letters).sum(axis=1) >= least[some]
    return near


def near_texts(cells: pa.Array, cutoff: float = K.HEADER_CUTOFF) -> list[str | None]:
    """Texts as they are compared with the aliases, None where no alias can reach the cutoff."""
    near: list[str | None] = [None] * len(cells)
    # Numbers share no letter with an alias and leave first.
    open_ = pc.fill_null(pc.match_substring_regex(cells, r"[^0-9.,\-]"), False)
    found, canon = [], []
    for i in np.flatnonzero(open_.to_numpy(zero_copy_only=False)).tolist():
        text = cells[i].as_py().strip().lower()
        words = set(text.split())
        if text.startswith("unnamed:"):
            continue
        if not words.isdisjoint(_ALIAS_TOKENS):
            near[i] = text
        else:
            found.append((i, text))
            canon.append(" ".join(sorted(words)))
    for k in np.flatnonzero(_can_be_near(canon, cutoff)).tolist():
        near[found[k][0]] = found[k][1]
    return near


def near_headings(cells: Column, cutoff: float = K.HEADER_CUTOFF) -> Column:
    """`near_texts` of the cells of every row. Never misses a cell."""
    @F.arrow_udf("array<string>")
    def near(rows: pa.Array) -> pa.Array:
        flat = iter(near_texts(rows.flatten(), cutoff))
        return pa.array([None if row is None else [next(flat) for _ in row]
                         for row in rows.to_pylist()], pa.list_(pa.string()))
    return near(cells)


@lru_cache(maxsize=4096)
def _field_scores(text: str, score) -> list[float]:
    return [max(score(text, alias) for alias in aliases) for aliases in K.COLUMN_ALIASES.values()]


def _best(scores: list[float], open_: list[int], cutoff: float) -> int:
    best = max(open_, key=lambda f: (scores[f], -f), default=UNMAPPED)
    return best if open_ and scores[best] >= cutoff else UNMAPPED


def _first(scores: list[float], open_: list[int], cutoff: float) -> int:
    return next((f for f in open_ if scores[f] >= cutoff), UNMAPPED)


@lru_cache(maxsize=4096)
def _mapping(texts: tuple[str | None, ...], score, pick, cutoff: float) -> list[int]:
    """Left to right, each column takes one field that no earlier column took. Headings repeat from
    document to document, so the last ones are kept."""
    mapping: list[int] = []
    for text in texts:
        open_ = [f for f in range(len(K.FIELDS)) if f not in mapping]
        mapping.append(UNMAPPED if text is None
                       else pick(_field_scores(text, score), open_, cutoff))
    return mapping


def _with_mapping(batch: pa.RecordBatch, mappings: list[list[int] | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(mappings, pa.list_(pa.int32()))],
                                      names=[*batch.schema.names, "mapping"])


def _mapped(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields,
                         T.StructField("mapping", T.ArrayType(T.IntegerType()))])


def mapped_headings(rows: DataFrame, min_fields: int, cutoff: float = K.HEADER_CUTOFF) -> DataFrame:
    """Rows with at least `min_fields` near headings, and rows 0, with `mapping`: each column takes
    its best field by token-set score, as in `best_field_mapping`.

    One pass over rows(row_idx, cells, ...). Only distinct texts of a batch are looked at, and only
    those of the rows that are kept are scored.
    """
    def mapped(batches):
        for batch in batches:
            cells = batch.column("cells")
            texts = cells.flatten().dictionary_encode()
            row = pc.list_parent_indices(cells).to_numpy()
            near = near_texts(texts.dictionary, cutoff)
            is_near = np.array([n is not None for n in near] + [False])
            near.append(None)  # of a null cell
            code = pc.fill_null(texts.indices, len(near) - 1).to_numpy(zero_copy_only=False)
            hits = np.bincount(row[is_near[code]], minlength=batch.num_rows)
            first = pc.fill_null(pc.equal(batch.column("row_idx"), 0), False)
            taken = np.flatnonzero(first.to_numpy(zero_copy_only=False) | (hits >= min_fields))
            start = np.searchsorted(row, taken).tolist()
            end = np.searchsorted(row, taken, side="right").tolist()
            missing = cells.is_null().to_numpy(zero_copy_only=False)[taken].tolist()
            mappings = [None if gone else _mapping(tuple([near[c] for c in code[a:b].tolist()]),
                                                   token_set_score, _best, cutoff)
                        for a, b, gone in zip(start, end, missing, strict=True)]
            yield _with_mapping(batch.take(pa.array(taken)), mappings)
    return rows.mapInArrow(mapped, _mapped(rows))


def first_mapped(headers: DataFrame, column: str, cutoff: float = K.HEADER_CUTOFF) -> DataFrame:
    """Adds `mapping` of an array column of headings: each takes the first field whose partial
    score reaches the cutoff, as in `first_field_mapping`."""
    def mapped(batches):
        for batch in batches:
            rows = batch.column(column)
            cells = rows.flatten().dictionary_encode()
            texts = [*cells.dictionary.to_pylist(), None]
            code = pc.fill_null(cells.indices, len(texts) - 1).to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            # Rows of the same texts are mapped once.
            known, mappings, which = {}, [], []
            for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                row = code[start:start + max(size, 0)]
                key = None if size < 0 else row.tobytes()
                if key not in known:
                    known[key] = len(mappings)
                    mappings.append(None if size < 0 else _mapping(
                        tuple([texts[c] for c in row.tolist()]), partial_score, _first, cutoff))
                which.append(known[key])
            taken = pa.array(mappings, pa.list_(pa.int32())).take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, taken],
                                             names=[*batch.schema.names, "mapping"])
    return headers.mapInArrow(mapped, _mapped(headers))


def _open_scores(scores: Column, taken: Column) -> Column:
    return F.transform(scores, lambda s, i: F.when(F.array_contains(taken, i), F.lit(-1.0))
                       .otherwise(s))


def _assign(scores: Column, pick) -> Column:
    """Left to right, each column takes one field that no earlier column took."""
    return F.aggregate(
        scores, F.array().cast("array<int>"),
        lambda taken, s: F.concat(taken, F.array(F.coalesce(
            pick(_open_scores(s, taken)), F.lit(UNMAPPED)).cast("int"))))


def best_field_mapping(scores: Column, cutoff: float = K.HEADER_CUTOFF) -> Column:
    """Each column takes its best field by token-set score; an earlier field wins ties."""
    def pick(scores):
        best = F.array_max(scores)
        return F.when(best >= cutoff, F.array_position(scores, best) - 1)
    return _assign(scores, pick)


def first_field_mapping(scores: Column, cutoff: float = K.HEADER_CUTOFF) -> Column:
    """Each column takes the first field whose partial score reaches the cutoff."""
    def pick(scores):
        fits = F.transform(scores, lambda s: s >= cutoff)
        return F.when(F.exists(fits, lambda x: x), F.array_position(fits, True) - 1)
    return _assign(scores, pick)


def mapped_count(mapping: Column) -> Column:
    return F.size(F.filter(mapping, lambda f: f != UNMAPPED))


def has_field(mapping: Column, field: str) -> Column:
    return F.array_contains(mapping, K.FIELDS.index(field))


def field_value(cells: Column, mapping: Column, field: str) -> Column:
    """Cell of the column mapped to `field`, null without one."""
    at = F.array_position(mapping, K.FIELDS.index(field)).cast("int")
    return F.when(at > 0, F.get(cells, at - 1))
