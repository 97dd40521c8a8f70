import random

import pytest
from pyspark.sql import functions as F

from ledgerline import constants as K
from ledgerline.functions import scoring
from ledgerline.functions.scoring import (
    _Block, block_best, lcs_length, partial_score, token_set_score)
from ledgerline.operators.fuzzy import fuzzy_top1
from ledgerline.operators.headings import near_headings


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def random_name(rng, words=5):
    return " ".join("".join(rng.choice("abcdeXY") for _ in range(rng.randint(1, 6)))
                    for _ in range(rng.randint(0, words)))


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(1000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 80))) for _ in "xy")
        assert lcs_length(a, b) == table_lcs(a, b)


def test_token_set_examples():
    assert round(token_set_score("Clearline Hygiene", "ClearLine Hygiene GmbH"), 4) == 82.0513
    assert round(token_set_score("Microfiber Cloths 10 pack", "Microfiber Cloth Pack of 10"), 4) \
        == 88.4615
    assert token_set_score("a b", "c b a") == 100.0
    assert token_set_score("", "a") == 0.0


def test_partial_examples():
    assert partial_score("item description", "description") == 100.0
    assert partial_score("title", "article") == 80.0
    assert partial_score("", "x") == 0.0
    assert partial_score("ab", "ba") == partial_score("ba", "ab")


def best_by_hand(probe, choices, cutoff):
    score, place = max((token_set_score(probe, c), -i) for i, c in enumerate(choices))
    return (score, -place) if score >= cutoff else None


@pytest.mark.parametrize("cutoff", [50.0, 60.0, 90.0])
def test_block_kernel_against_all_pairs(cutoff):
    rng = random.Random(2)
    choices = [random_name(rng) * (4 if rng.random() < .1 else 1) for _ in range(250)]
    probes = [random_name(rng) for _ in range(60)] + [random_name(rng) * 5 for _ in range(5)]
    found = {m["probe"]: (m["score"], m["row_pos"]) for m in block_best(
        probes, [0.0] * len(probes), _Block(choices), range(len(choices)), cutoff)}
    for probe in probes:
        assert found.get(probe) == best_by_hand(probe, choices, cutoff)


@pytest.mark.parametrize("cutoff", [50.0, 60.0, 90.0])
def test_prefix_tree_against_all_pairs(cutoff, monkeypatch):
    """Names with common beginnings, equal token sets, common tokens, characters of no choice."""
    monkeypatch.setattr(scoring, "TREE_NODES", 1000)
    monkeypatch.setattr(scoring, "WALK_PAIRS", 50)
    rng = random.Random(7)
    for kind in range(2):
        choices = [random_name(rng, 3) if kind else f"Name#{rng.randrange(2000):05d}"
                   for _ in range(300)]
        positions = rng.sample(range(1000), 300)
        probes = [c[3:-1] for c in choices[:40]] + [f"#{rng.randrange(2000)} päck" for _ in "x" * 20] \
            + [random_name(rng, 2) for _ in range(40)] + [choices[0] * 15, "vvvv jjjj"]
        found = {m["probe"]: (m["score"], m["row_pos"]) for m in block_best(
            probes, [0.0] * len(probes), _Block(choices), positions, cutoff)}
        for probe in probes:
            score, place = max((token_set_score(probe, c), -p) for c, p in zip(choices, positions))
            assert found.get(probe) == ((score, -place) if score >= cutoff else None)


def test_work_for_a_probe_does_not_grow_with_the_block(monkeypatch):
    """A name of many alike is compared with few of them, not with as many as there are."""
    def compared(n):
        steps = []
        plain, below = _Block.lcs, scoring._Tree._below
        monkeypatch.setattr(_Block, "lcs", lambda self, canon, picks: (
            steps.append(len(picks)), plain(self, canon, picks))[1])
        monkeypatch.setattr(scoring._Tree, "_below", lambda self, *pairs: (
            steps.append(len(pairs[0])), below(self, *pairs))[1])
        block = _Block([f"Supplier#{i:09d}" for i in range(n)])
        probes = [f"#{i:09d} pack" for i in range(0, n, n // 50)]
        assert len(block_best(probes, [50.0] * len(probes), block, range(n), 50.0)) == len(probes)
        monkeypatch.undo()
        return sum(steps)
    assert compared(20_000) < 2 * compared(2_000) < 100_000


@pytest.mark.parametrize("cutoff, chars, block", [
    (50.0, 1 << 25, 8), (60.0, 0, 8), (60.0, 1 << 25, 2048)])
def test_fuzzy_join_against_all_pairs(spark, cutoff, chars, block):
    """Small blocks take the token and length joins, broadcast or shuffled; a large one is sent."""
    rng = random.Random(4)
    choices = [random_name(rng) * (3 if rng.random() < .1 else 1) for _ in range(200)]
    probes = list({random_name(rng) for _ in range(80)} | set(choices[:5]) | {"", " "})
    frame = spark.createDataFrame([(p,) for p in probes + [None]], "text string")
    master = spark.createDataFrame(list(enumerate(choices)), "row_pos long, text string")
    found = {r.text: (r.score, r.row_pos)
             for r in fuzzy_top1(frame, master, cutoff, chars, block).collect()}
    for probe in probes:
        assert found.get(probe) == best_by_hand(probe, choices, cutoff)


def test_heading_filter_misses_nothing(spark):
    """Random edits of aliases: every cell that scores 80 with some alias passes the filter."""
    rng = random.Random(6)
    aliases = [a for group in K.COLUMN_ALIASES.values() for a in group]
    cells = set(aliases) | {"su", "sk", "id", "($)", "the price", "unnamed: 1"}
    for _ in range(3000):
        text = list(rng.choice(aliases))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(text) + 1)
            if rng.random() < .5:
                text.insert(at, rng.choice("aeiot xy("))
            elif text[at:]:
                del text[at]
        cells.add("".join(text).strip())
    cells = sorted(c for c in cells if c)
    rows = spark.createDataFrame([(cells[i:i + 10],) for i in range(0, len(cells), 10)],
                                 "cells array<string>")
    passed = {c for r in rows.select(near_headings(F.col("cells")).alias("n")).collect()
              for c in r.n if c is not None}
    wanted = {c for c in cells if not c.startswith("unnamed:")
              and max(token_set_score(c, a) for a in aliases) >= 80}
    assert wanted <= passed
    assert len(passed) < len(cells)
