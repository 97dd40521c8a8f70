"""Each operator against brute force, and on nulls, empty texts, ties, copies and odd columns."""

import base64
import collections
import hashlib
import os
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import (components, decontaminate, fingerprints, langid, licenses, mixture,
                            neardup, pii, sharding, tokens, warc)
from ledgerline.llm.common import shared_folder

DOC = "doc_id long, text string, lang string, source string, size string"
ODD = [(None, "lonely text without a name", None, None, "s"), (1, None, "en", "a", "s"),
       (2, "", None, "b", "s"), (3, " \n\t", "en", None, "s"), (4, "same words here again", "en", "a", "s"),
       (4, "same words here again", "en", "a", "s"), (5, "same words here again", "en", "b", "s"),
       (6, "12 34 ## !!", None, "a", "s"), (7, "word " * 30_000, "en", "a", "s"), (-8, "x", "de", "c", "s")]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOC)


def corpus(n=120, seed=3):
    """Texts in groups of copies with a few words changed."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8)))
             for _ in range(800)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = [rng.choice(words).title() if rng.random() < 0.1 else rng.choice(words)
                   for _ in range(rng.randint(1, 90))]
        texts.append(" ".join(own))
    return [(i * 3 + 1, t, rng.choice(["en", "fr"]), rng.choice("aaaab"), "s")
            for i, t in enumerate(texts)]


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = corpus()
    sets = {d: shingles(t, k) for d, t, *_ in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
             for r in neardup.classes(frame(spark, rows), k, percent).collect()}
    assert found == {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def test_near_duplicates_of_odd_rows(spark):
    found = sorted(map(tuple, neardup.classes(frame(spark)).select(
        F.coalesce("doc_id", F.lit(-99)), "n_shingles", F.coalesce("component_id", F.lit(-99)),
        "kept").collect()))
    assert found == [(-99, 1, -99, True), (-8, 1, -8, True), (1, 0, 1, True), (2, 0, 2, True),
                     (3, 0, 3, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False),
                     (6, 1, 6, True), (7, 1, 7, True)]
    assert neardup.classes(frame(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    rows = [(order[i], order[i + 1]) for i in range(59)] + [(100, 101), (101, 100), (200, 200)]
    found = {r.id: r.component for r in components.components(
        spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    rows = sorted(corpus(60))
    found = {r.doc_id: r for r in fingerprints.with_edits(frame(spark, rows)).collect()}
    for i, (d, text, *_) in enumerate(rows):
        m = len(text) // 4
        edited = text[:len(text) - m] + rows[(i + 1) % len(rows)][1][:m]
        assert found[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert found[d].n_chars == len(text)
    # Seven words in a row that two texts share give them a common hash.
    passage = "one two three four five six seven"
    texts = [(1, f"a b c {passage} d e f g h"), (2, f"{passage} z y x w v u t"), (3, None)]
    marked = fingerprints.fingerprint(spark.createDataFrame(texts, "doc_id long, text string"))
    a, b, c = ({m >> 31 for m in r.marks} for r in marked.orderBy("doc_id").collect())
    assert a & b and not c


def test_fingerprints_follow_the_definition(spark):
    rng = random.Random(4)
    words = [rng.choice("abc") for _ in range(200)]
    [row] = fingerprints.fingerprint(spark.createDataFrame(
        [(" ".join(words),)], "text string")).collect()
    names = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(fingerprints.PRIME)).alias(w)
                                    for w in "abc"]).first()
    assert [(m >> 31, 2**31 - 1 - m % 2**31) for m in row.marks] == winnowed(
        [names[w] for w in words])


def winnowed(hashes):
    """(hash, position) by the definition, with three end marks on either side."""
    padded = [fingerprints._END] * 3 + hashes + [fingerprints._END] * 3 if hashes else []
    grams = []
    for i in range(len(padded) - 3):
        h = 0
        for w in padded[i:i + 4]:
            h = (h * fingerprints.BASE + w) % fingerprints.PRIME
        grams.append(h)
    chosen = []
    for i in range(len(grams) - 3):
        at = max(j for j in range(i, i + 4) if grams[j] == min(grams[i:i + 4]))
        if at not in chosen:
            chosen.append(at)
    return [(grams[j], j) for j in chosen]


def test_likeness_of_neighbours(spark):
    """near_edited and near_next recomputed, for texts of one to fifteen words."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(6)]
    names = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(fingerprints.PRIME)).alias(w)
                                    for w in words]).first().asDict()
    rows = [(i, " ".join(rng.choice(words) for _ in range(i % 15 + 1)), None, None, None)
            for i in range(40)]

    def marks(text):
        used = [w for w in text.split(" ") if w]
        for w in used:
            if w not in names:
                names[w] = spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(
                    fingerprints.PRIME))).first()[0]
        return {h for h, _ in winnowed([names[w] for w in used])}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    for r in fingerprints.with_edits(frame(spark, rows)).collect():
        text, after = rows[r.doc_id][1], rows[(r.doc_id + 1) % len(rows)][1]
        quarter = len(text) // 4
        assert r.near_edited == like(marks(text), marks(text[:len(text) - quarter] + after[:quarter]))
        assert r.near_next == like(marks(text), marks(after))


def test_fingerprints_have_no_border_of_length(spark):
    rows = [(n, " ".join(f"v{i}" for i in range(n)), None, None, None) for n in range(1, 12)]
    rows += [(100 + n, " ".join(["other", *(f"v{i}" for i in range(1, n))]), None, None, None)
             for n in range(1, 12)]
    marked = {r.doc_id: {m >> 31 for m in r.marks}
              for r in fingerprints.fingerprint(frame(spark, rows)).collect()}
    assert all(marked[n] & marked[100 + n] for n in range(5, 12))
    assert all(1 <= len(marked[n]) <= n for n in range(1, 12))


def test_fingerprints_of_odd_rows(spark):
    found = fingerprints.with_edits(frame(spark)).collect()
    assert len(found) == len(ODD)
    same = {r.fingerprint for r in found if r.doc_id in (4, 5)}
    assert len(same) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert fingerprints.with_edits(frame(spark, [])).count() == 0
    [one] = fingerprints.with_edits(frame(spark, ODD[4:5])).collect()
    assert one.near_next == 1.0


def by_rounds(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full) or 1
        goal = {s: most * sizes[s] if s in full else rest * weight[s] / share for s in order}
        more = {s for s in order if s not in full and goal[s] > most * sizes[s]}
        if not more:
            return goal
        full |= more


@pytest.mark.parametrize("seed", range(3))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice([None, *"abbbbbbbbbbbccdd"]), "s")
            for i in range(1500)]
    rows.append((9999, "w", "en", "tiny", "s"))
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
    goal = by_rounds(size)
    found = mixture.mix(frame(spark, rows)).collect()
    taken = collections.Counter()
    for r in found:
        assert r.size == len(r.text.split()) and r.source_size == size[r.source]
        assert r.target == pytest.approx(goal[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    assert len(found) == len(rows)
    for s in size:
        assert abs(taken[s] - goal[s]) <= max(80, 0.05 * goal[s])
    again = mixture.mix(frame(spark, rows).repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in found}


def test_mixture_of_odd_rows(spark):
    found = mixture.mix(frame(spark)).collect()
    assert len(found) == len(ODD) and all(isinstance(r["size"], int) for r in found)
    assert mixture.copies(mixture.mix(frame(spark))).count() == sum(r.copies for r in found)
    assert mixture.mix(frame(spark, [])).count() == 0


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(rng.randint(-2**62, 2**62), "common" if i % 3 == 0 else "t" * rng.randint(0, 300),
             "en", "a", "s") for i in range(3000)]
    found = sharding.shard(frame(spark, rows), shards=5, parts_per_shard=3).collect()
    total = collections.Counter()
    for r in found:
        data = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "bytes")
        total[r.shard] += r.size
    for s in range(5):
        assert sorted(r.slot for r in found if r.shard == s) == list(
            range(sum(r.shard == s for r in found)))
    mean = sum(total.values()) / 5
    assert len(total) == 5 and all(abs(t - mean) < 0.03 * mean for t in total.values())
    short = [t for _, t, *_ in rows if t != "common"]
    split = collections.defaultdict(set)
    for r in found:
        split[r.text].add(r.shard)
    assert sum(len(split[t]) > 1 for t in set(short)) <= 4


def test_sharding_of_odd_rows(spark):
    found = sharding.shard(frame(spark)).collect()
    assert len(found) == len(ODD) and {0} < {r.shard for r in found} <= set(range(24))
    assert sorted(r.size for r in found)[0] == 8
    assert sharding.shard(frame(spark, [])).count() == 0


def test_decontamination(spark):
    rng = random.Random(2)
    rows = corpus(80, seed=8)
    items = [(i, " ".join(t.split()[5:5 + rng.randint(3, 60)])) for i, t in
             enumerate(r[1] for r in rng.sample(rows, 30))] + [(None, rows[0][1]), (77, ""), (78, None)]
    changed = [(d, t.replace(" ", ", ", 2).upper() if d % 2 else t, *r) for d, t, *r in rows]

    def words(text):
        own = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())
        return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    wanted = {(d, i, len(words(t) & words(q))) for d, t, *_ in changed for i, q in items
              if i is not None and words(q) and 100 * len(words(t) & words(q)) >= 80 * len(words(q))}
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, changed)
    found = {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.leaks(docs, table).collect()}
    assert found == wanted and len(wanted) >= 30
    kept = {r.doc_id for r in decontaminate.clean(docs, table).collect()}
    assert kept == {d for d, *_ in changed} - {d for d, *_ in wanted}


def test_decontamination_in_blocks(spark, monkeypatch):
    rows = corpus(20)
    table = spark.createDataFrame([(d, t) for d, t, *_ in rows[:8]], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.leaks(frame(spark, rows), table).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 50)
    assert sorted(map(tuple, decontaminate.leaks(frame(spark, rows), table).collect())) == whole
    none = table.limit(0)
    assert decontaminate.leaks(frame(spark), none).count() == 0
    assert decontaminate.clean(frame(spark), table).count() == len(ODD)


def test_decontamination_of_short_items_and_other_scripts(spark):
    items = [(1, "日本語の文章です。"), (2, "ไทย กข"), (3, "École Nº 5"), (4, "word"), (5, "one two three"),
             (6, "\u201csix seven eight nine ten\u201d"), (7, "ΟΔΟΣ ΜΟΥ"), (8, "日本"), (9, "...")]
    docs = [(1, "これは日本語の文章ですから、長い。"), (2, "กไทยกขค"), (3, "l'école\u00a0nº 5!"), (4, "words"),
            (5, "zero ONE, two\u3000three four five six"), (6, "five six seven eight nine ten eleven"),
            (7, "η οδος μου"), (8, "one two"), (9, "one two, four three"), (10, "a word b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(*d, "en", "a", "s") for d in docs])
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(
        docs, table, short_inside=True).collect()) == [
        (1, 1), (1, 8), (2, 2), (3, 3), (5, 5), (6, 6), (7, 7), (10, 4)]
    assert sorted(r.doc_id for r in decontaminate.clean(
        docs, table, short_inside=True).collect()) == [4, 8, 9]
    assert (5, 5) not in {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, table).collect()}


def test_language(spark):
    rng = random.Random(5)
    kinds = {"en": "the of and thing er on", "es": "ñ ción la os el mente"}
    rows = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(20)), k, "a", "s")
            for i, k in enumerate(rng.choice(["en", "es"]) for _ in range(200))]
    found = langid.identify(frame(spark, rows)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    truth = {d: k for d, _, k, *_ in rows}
    held = [r for r in found if r.held_out]
    assert held and all(r.lang_pred == truth[r.doc_id] and 0.9 < r.score <= 1 for r in held)
    odd = langid.identify(frame(spark)).collect()
    assert len(odd) == len(ODD)
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 6)} == {"und"}
    assert all(r.score == 0 for r in odd if r.lang_pred == "und")
    assert langid.identify(frame(spark, [])).count() == 0


def counted(texts):
    out = collections.Counter()
    for bucket, owner in langid.grams(texts):
        out.update(zip(bucket.tolist(), owner.tolist(), strict=True))
    return out


def plain_grams(text):
    """Buckets of the n-grams of one text, one by one."""
    import regex
    if not text or not regex.search(r"\p{L}", text):
        return collections.Counter()
    text = " " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip(" ") + " "
    out = collections.Counter()
    for n in langid.ORDERS:
        for i in range(len(text) - n + 1):
            if text[i:i + n] != " ":
                key = n + sum(ord(c) * int(langid._PLACE[k]) for k, c in enumerate(text[i:i + n]))
                key %= 2**64
                key = (key ^ key >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                key = (key ^ key >> 27) * 0x94D049BB133111EB % 2**64
                out[(key ^ key >> 31) >> 48] += 1
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 40, 1 << 18])
def test_language_counts_do_not_depend_on_chunks(monkeypatch, chunk):
    texts = ["Aé b-c  d" * 9, None, "", "日本 語x" * 5, "..", "q", "²½ ①Ⅷ", "नमस्ते", "a\u0301"]
    monkeypatch.setattr(langid, "_CHUNK", chunk)
    plain = collections.Counter()
    for i, text in enumerate(texts):
        plain.update({(b, i): n for b, n in plain_grams(text).items()})
    assert counted(texts) == plain
    assert {o for _, o in plain} == {0, 3, 5, 7, 8}


def test_language_against_a_second_bayes(spark):
    import math
    rng = random.Random(2)
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(6)), lang,
             "s", "s") for i in range(80) for lang, letters in [("ab", "aeboi"), ("bc", "bcoi")]
            if i % 2 == (lang == "ab")]
    rows += [(1000, "①½ 12", None, "s", "s"), (1001, "zzz", "ab", "s", "s")]
    sums = {}
    for d, text, lang, *_ in rows:
        if lang and zlib.crc32(str(d).encode()) % 4 != 2:
            sums.setdefault(lang, collections.Counter()).update(plain_grams(text))
    total = {lang: sum(c.values()) + langid.SMOOTHING * langid.BUCKETS for lang, c in sums.items()}
    for r in langid.identify(frame(spark, rows)).collect():
        grams = plain_grams(next(t for d, t, *_ in rows if d == r.doc_id))
        score = {lang: sum(n * math.log((sums[lang][b] + langid.SMOOTHING) / total[lang])
                           for b, n in grams.items()) / len(langid.ORDERS) for lang in sums}
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(sorted(score), key=score.get)
        assert r.lang_pred == best
        assert r.score == pytest.approx(1 / sum(math.exp(v - score[best]) for v in score.values()),
                                        rel=1e-3)


def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_tokens(spark):
    from sentencepiece import SentencePieceProcessor
    own = SentencePieceProcessor(model_file=model_path())
    rng = random.Random(7)
    texts = ["", " ", "  a", "a  b ", "</s> <s> <0x41>", "▁x▁▁y", "ＡＢ\x00﻿", "日本語の文", "naïve café\n\ttab",
             " " * 70, "a" * 700, "ab" * 900 + " " * 40, "the the theatre", None,
             *("".join(rng.choice(" aeinrst\n▁éß日😀.") for _ in range(rng.randint(1, 700)))
               for _ in range(150))]
    rows = [(i, t, None, None, "s") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in tokens.count_tokens(frame(spark, rows), model_path(), 100).collect()}
    for i, t in enumerate(texts):
        n = len(own.encode(t or "", num_threads=1))
        assert (found[i].n_tokens, found[i].n_bytes, found[i].over_limit) == (
            n, len((t or "").encode()), n > 100), repr(t)
    assert tokens.count_tokens(frame(spark, []), model_path()).count() == 0


def merged(vocabulary, token):
    """Plain merging, one pair at a time: the best rank, then the leftmost."""
    pairs = {int(k): (int(r), int(j)) for k, r, j in zip(
        vocabulary.keys, vocabulary.ranks, vocabulary.joined, strict=False)}
    symbols = vocabulary.numbered(token)
    while True:
        best = min(((pairs[k][0], i) for i in range(len(symbols) - 1)
                    if (k := symbols[i] << 32 | symbols[i + 1]) in pairs), default=None)
        if best is None:
            return sum(int(vocabulary.cost[s]) for s in symbols)
        i = best[1]
        symbols[i:i + 2] = [pairs[symbols[i] << 32 | symbols[i + 1]][1]]


@pytest.mark.parametrize("seed", range(40))
def test_rounds_merge_as_one_pair_at_a_time(seed):
    """Small vocabularies with equal ranks, and pairs that arise late but rank early."""
    rng = random.Random(seed)
    pieces = {c: -100.0 for c in "abc"}
    for _ in range(rng.randint(1, 10)):
        pieces.setdefault(rng.choice(list(pieces)) + rng.choice(list(pieces)), -rng.randint(1, 6))
    vocabulary = tokens.Vocabulary(list(pieces.items()))
    texts = ["".join(rng.choice("abc" if seed % 2 else "ab") for _ in range(rng.randint(1, 40)))
             for _ in range(30)] + ["a" * 700, "ab" * 500, "?"]
    assert vocabulary.count(texts).tolist() == [merged(vocabulary, t) for t in texts]


def test_tokens_of_odd_rows(spark):
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=model_path())
    rows = [*ODD, (20, "日本国東京大学" * 600, None, None, "s"), (21, "=" * 4000, None, None, "s"),
            (22, "<s> <0x41> \u2581x", None, None, "s")]
    found = tokens.count_tokens(frame(spark, rows), model_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_bytes, r.over_limit)
                  for r in found) == sorted(
        (d is None, d or 0, n, len((t or "").encode()), n > 4096) for d, t, *_ in rows
        for n in [len(model.encode(t or ""))])


def test_archives(spark):
    texts = ["<p>one</p>", "<p>one</p>", "", None, "é" * 100_000, "line\r\n\r\nWARC/1.1\r\n", "<p>one</p>", "é" * 100_000]
    rows = [(i, None if i == 2 else f"http://x/{i}\n?ü", t) for i, t in enumerate(texts)]
    rows += [(None, "http://none", "no id"), rows[5]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    table = warc.read(warc.write(pages, shared_folder(spark)))
    found = table.collect()
    ends = [r for r in found if r.last]
    assert len(ends) == len(rows) and all(r.complete for r in ends)
    largest = {}
    for i, _, t in rows:
        if i is not None:
            largest[t or ""] = max(i, largest.get(t or "", i))
    for r in ends:
        data = ((texts[r.page_id] or "") if r.page_id is not None else "no id").encode()
        assert r.payload_bytes == len(data)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        other = None if r.page_id is None else largest[data.decode()]
        if r.page_id == 5:  # two rows of one page and payload: one stands, the other refers to it
            assert (r.record_type, r.refers_to) in [("response", None), ("revisit", 5)]
            continue
        revisit = r.page_id is not None and other != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", other) if revisit else ("response", None))
    assert sorted(r.record_type for r in ends if r.page_id == 5) == ["response", "revisit"]
    long = sorted((r for r in found if r.page_id == 7), key=lambda r: r.chunk_no)
    assert len(long) == 4 and b"".join(r.data for r in long) == texts[7].encode()
    assert [r.chunk_no for r in long] == [0, 1, 2, 3] and not long[0].last
    assert max(len(r.data) for r in found) <= warc.CHUNK
    short = {r.page_id: r.record_type for r in warc.read(warc.write(
        pages, shared_folder(spark), least_bytes=11)).filter("last").collect()}
    assert short[0] == "response" and short[4] == "revisit"
    assert warc.read(warc.write(pages.limit(0), shared_folder(spark))).count() == 0


def test_surrogates(spark):
    texts = {
        1: "Write to Ann.Lee@Corp.example.com or ann.lee@corp.example.com, call +1 (415) 555-0134.",
        2: "Mr. Albert Stone met Mrs. Clara Stone; Herr Müller paid with 4111 1111 1111 1111.",
        3: "token = \"deadbeef01deadbeef02\" from 10.1.2.3 and 10.1.2.4; later Mr. Stone left.",
        4: "Nothing personal here, version 1.2.3 of 2024.", 5: "", 6: None}
    rows = [(d, t, None, None, "s") for d, t in texts.items()] + [(None, texts[2], None, None, "s")]
    found = pii.replace(frame(spark, rows)).collect()
    out = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and out[4].text == texts[4] and out[6].text is None
    assert out[None].text == out[2].text and out[4].n_entities == 0
    for gone in ["@Corp", "@corp", "555-0134", "Albert", "Stone", "Clara", "Müller", "4111", "deadbeef",
                 "10.1.2.3"]:
        assert not any(gone in (r.text or "") for r in found), gone
    mails = re.findall(r"\S+@[\w.]+\w", out[1].text)
    assert len(mails) == 2 and mails[0] == mails[1]
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}\.$", out[1].text)
    first, second = re.search(r"Mr\. (\w+ \w+) met Mrs\. (\w+ \w+);", out[2].text).groups()
    assert first.split()[1] == second.split()[1] == re.search(r"Mr\. (\w+) left", out[3].text)[1]
    assert first.split()[0].lower().endswith(tuple(pii.ENDINGS["latin", "m"]))
    assert second.split()[0].lower().endswith(tuple(pii.ENDINGS["latin", "f"]))
    card = [int(c) for c in re.search(r"\d{4} \d{4} \d{4} \d{4}", out[2].text)[0] if c != " "]
    assert sum(c if i % 2 else (2 * c - 9 * (c > 4)) for i, c in enumerate(card)) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{20}"', out[3].text)
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", out[3].text))) == 2
    assert pii.replace(frame(spark, rows), "other key").filter("doc_id = 1").first().text != out[1].text
    assert pii.replace(frame(spark, [])).count() == 0


def test_surrogates_never_collide(spark):
    names = spark.range(4000).select(F.lit("given_m").alias("kind"), F.concat(
        F.lit("Name"), "id").alias("canonical"))
    found = pii.surrogates(names, "k").collect()
    assert len({r.surrogate.lower() for r in found}) == len(found) == 4000


def test_surrogates_of_formats_with_too_few_values(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = ([("email", f"{letters[i % 26]}@host{i}.com") for i in range(5000)]
            + [("phone", f"{i:03d}") for i in range(1000)] + [("secret", "--------"), ("secret", "-_-_-_-_")]
            + [("ip", f"10.0.{i}.1") for i in range(20)])
    found = pii.surrogates(spark.createDataFrame(rows, "kind string, canonical string"), "k").collect()
    assert sorted((r.kind, r.canonical) for r in found) == sorted(rows)
    assert len({(r.kind, r.surrogate) for r in found}) == len(rows)
    assert not {(r.kind, r.surrogate) for r in found} & set(rows)
    for r in found:
        form = {"email": r"[a-z]@mail\d+\.example\.org", "phone": r"\d{4,}", "secret": r"[-_]{8}[a-z]+",
                "ip": r"\d+(\.\d+){3}"}[r.kind]
        assert re.fullmatch(form, r.surrogate), r
    assert spark.range(1).select(pii._reformatted(
        F.lit("(41) 5"), F.lit("415"), F.lit("98765"))).first()[0] == "(98) 765"


def test_licences(spark):
    plain = corpus(150)
    lines = {9001: ("some words\nLicensed under the Apache License, Version 2.0.\nmore", "apache", 1),
             9002: ("Released under the MIT License.", "mit", 0),
             9003: ("first\r\n\r\nThis work is licensed under the GNU General Public License, version 3.",
                    "gpl", 2)}
    rows = plain + [(d, t, None, None, "s") for d, (t, *_) in lines.items()] + ODD
    found = licenses.scan(frame(spark, rows)).filter("confirmed").collect()
    assert {(r.doc_id, r.family, r.paragraph_no) for r in found} == {
        (d, f, n) for d, (_, f, n) in lines.items()}
    assert all(0 < r.probability <= 1 for r in found)


def test_licence_threshold_is_of_all_paragraphs(spark, monkeypatch):
    rng = random.Random(4)
    words = "released under the terms of GNU GPL v3 version general public software red house".split()
    texts = [" ".join([*["Released under the GNU GPL v3."] * (i % 3 == 1),
                       *[rng.choice(words) for _ in range(8)]]) for i in range(300)]
    rows = [(i, t, None, None, "s") for i, t in enumerate(texts)]
    copies = [(1000 + i, texts[0], None, None, "s") for i in range(200)]
    monkeypatch.setattr(licenses, "SAMPLE", 20)
    monkeypatch.setattr(licenses, "RARE", 10)
    monkeypatch.setattr(licenses, "LEAST_PROBABILITY", 0.0)
    for docs in (frame(spark, rows), frame(spark, rows + copies).repartition(3)):
        scanner = licenses.train(docs)
        shares = sorted(r.share if r.family != "unknown" else 0.0 for r in scanner.scores(
            licenses.paragraphs(docs)).select("family", "share").collect())
        exact = shares[-len(shares) // 10]
        assert exact > 0 and exact - 1e-5 <= scanner.threshold <= exact
        found = {(r.doc_id, r.family) for r in licenses.scan(docs).collect()}
        assert found == {(r.doc_id, r.family) for r in licenses.scan(docs, scanner).collect()}
        assert len(found) >= len(shares) // 10
    one, other = (licenses._fit(d)[0].model.coefficientMatrix.toArray()
                  for d in (frame(spark, rows), frame(spark, rows + copies)))
    assert abs(one - other).max() < 1e-6


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline
    docs = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, FOLDER).collect()
    kept = {r.doc_id for r in out}
    leaked = {r.doc_id for r in decontaminate.leaks(
        spark.read.parquet(f"{FOLDER}/documents.parquet"),
        spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert leaked and not leaked & kept
    assert len({r.shard for r in out}) == 24 and kept <= set(docs)
    assert len({docs[d].text for d in kept}) == len(kept)
    assert max(collections.Counter(r.doc_id for r in out).values()) <= 3
