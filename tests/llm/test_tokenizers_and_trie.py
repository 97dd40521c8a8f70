"""BPE, alignment of tokenizers and the prefix trie against libraries and brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from ledgerline.llm import align, bpe, queries, trie
from ledgerline.llm.common import stored

public_tokenizers = pytest.importorskip("public_tokenizers")

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ("abcdeABC 123  \n\t'stredl!?.,-<|endoftext|></s><0x41>éüß漢字かなカナ한국어🙂\u0300\u200d\xa0"
            "\x1c\x85\x00\u1c89\u058f\U0001e5f0")


def texts(n, longest, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


ODD = [None, "", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "a" * 3000, "ab" * 900, " " * 50,
       "\n" * 33, "日本語" * 500, "a\u2581b", "<s> </s> <unk>", "word " * 20_000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH_A)


def test_ids_of_the_library(library):
    vocabulary = bpe.vocabulary(PATH_A)
    rng = random.Random(2)
    some = [t or "" for t in ODD] + texts(800, 60) + [
        library.decode([rng.randrange(50257) for _ in range(rng.randint(1, 12))],
                       skip_special_tokens=False) for _ in range(800)]
    for special in (True, False):
        library.encode_special_tokens = not special
        expected = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
        assert vocabulary.encode(some, special) == expected
    library.encode_special_tokens = False


def test_plain_cuts_equal_the_classes_of_the_regex_module():
    """Every character up to U+FFFF beside letters, numbers and blanks; these texts do without the
    regex module, others do not."""
    cut = bpe.PreTokens()
    for c in (chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000):
        text = f"a{c}1 {c}x{c} {c}{c}'s"
        assert cut.plain.findall(text) == cut.cuts.findall(text)
    beyond = "a\U0001F600 \U00010400b c"
    assert cut(beyond) == cut.cuts.findall(beyond)
    cut.cuts = None
    assert cut("it's Größe 12\u00a0 x") == ["it", "'s", " Größe", " 12", "\u00a0", " x"]


def test_every_character_is_cut_as_the_library_cuts(library):
    vocabulary = bpe.ByteBPE(PATH_A)
    every = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in range(0x110000)
             if not 0xD800 <= c < 0xE000]
    expected = [e.ids for e in library.encode_batch(every, add_special_tokens=False)]
    assert vocabulary.encode(every) == expected


@pytest.mark.parametrize("seed", range(30))
def test_small_vocabularies_against_plain_merging(tmp_path, seed):
    import json
    rng = random.Random(seed)
    vocab = {c: i for i, c in enumerate(bpe.byte_letters())}
    merges = []
    for _ in range(rng.randint(1, 14)):
        a, b = (rng.choice(["a", "b", "c", *(x + y for x, y in merges)]) for _ in "ab")
        if a + b not in vocab:
            vocab[a + b] = len(vocab)
            merges.append((a, b))
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    (tmp_path / "v.json").write_text(json.dumps({
        "normalizer": None, "pre_tokenizer": cut, "added_tokens": [],
        "model": {"type": "BPE", "vocab": vocab, "merges": [f"{a} {b}" for a, b in merges]}}))
    rank = {pair: i for i, pair in enumerate(merges)}

    def plain(text):
        symbols = list(text)
        while True:
            best = min(((rank[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank),
                       default=None)
            if best is None:
                return [vocab[s] for s in symbols]
            i = best[1]
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
    some = ["".join(rng.choice("abc" if seed % 2 else "ab") for _ in range(rng.randint(1, 50)))
            for _ in range(200)]
    assert bpe.ByteBPE(str(tmp_path / "v.json")).encode(some) == [plain(t) for t in some]


def test_kept_pre_tokens_stay_right(library, monkeypatch):
    """Ids come in one row for all texts, whatever is kept, forgotten or left half done."""
    monkeypatch.setattr(bpe, "CACHE", 40)
    monkeypatch.setattr(bpe, "LONGEST_KEPT", 9)
    vocabulary = bpe.ByteBPE(PATH_A)
    parts = [[], ["", ""], *([t or "" for t in ODD] + texts(30, 60, s) for s in (7, 8, 7))]
    for part in parts:
        ids, sizes = vocabulary.encode_flat(part)
        expected = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert ids.tolist() == [i for e in expected for i in e]
        assert sizes.tolist() == [len(e) for e in expected]
        assert len(vocabulary.known) == len(vocabulary.sizes) <= 40 + len(vocabulary.added)
        assert max((len(p) for p in vocabulary.known if isinstance(p, str)), default=0) <= 9
    with monkeypatch.context() as broken:
        broken.setattr(vocabulary, "encode_pieces", lambda pieces: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            vocabulary.encode_flat([" unheard ofwords"])
    assert vocabulary.encode([" unheard ofwords"]) == [library.encode(" unheard ofwords").ids]


def test_an_added_token_that_is_a_plain_word(tmp_path):
    """A vocabulary is shared by callers with and without special tokens."""
    import json
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    added = {"id": 256, "content": "abc", "single_word": False, "lstrip": False, "rstrip": False}
    (tmp_path / "v.json").write_text(json.dumps({
        "normalizer": None, "pre_tokenizer": cut, "added_tokens": [added], "model": {
            "type": "BPE", "vocab": {c: i for i, c in enumerate(bpe.byte_letters())}, "merges": []}}))
    vocabulary = bpe.ByteBPE(str(tmp_path / "v.json"))
    for _ in range(2):
        assert vocabulary.encode(["abc", "abc d"], special=False) == [[97, 98, 99],
                                                                      [97, 98, 99, 32, 100]]
        assert vocabulary.encode(["abc", "abc d"]) == [[256], [256, 32, 100]]


def test_decoding(spark, library):
    rng = random.Random(3)
    lists = [None, [], [50256], [None, 64], [60000, -1, 64]] + [
        [rng.randrange(50257) for _ in range(rng.randint(1, 9))] for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    for r in bpe.decode(frame, PATH_A).collect():
        ids = lists[r.doc_id]
        assert r.text == (None if ids is None else library.decode(
            [i for i in ids if i is not None and 0 <= i < 50257], skip_special_tokens=False))


def test_round_trip_of_odd_rows(spark, library):
    rows = [(i % 9 or None, t, "extra") for i, t in enumerate(ODD + ODD[:2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = stored(bpe.encode(frame, PATH_A))
    found = sorted(map(tuple, encoded.collect()), key=str)
    assert found == sorted([(d, library.encode(t or "", add_special_tokens=False).ids)
                            for d, t, _ in rows], key=str)
    back = bpe.decode(encoded, PATH_A)
    assert sorted(r.text for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode(frame.limit(0), PATH_A).count() == 0


def brute_alignment(library, model, spelled, text):
    if not text:
        return 0, 0, [], collections.Counter()
    a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    bytes_a = [spelled[i] for i in a]
    bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
               else model.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return 0, 0, [], collections.Counter()
    ends_a = np.cumsum([len(x) for x in bytes_a]).tolist()
    ends_b = np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, links, i, j = [], collections.Counter(), 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((a[i:k], b[j:m]))
        links[a[k - 1], b[m - 1]] += 1
        i, j = k, m
    return len(a), len(b), groups, links


@pytest.mark.parametrize("stretch, heavy", [(256, 1 << 18), (3, 50)])
def test_alignment(spark, library, monkeypatch, stretch, heavy):
    from sentencepiece import SentencePieceProcessor
    monkeypatch.setattr(align, "STRETCH", stretch)
    monkeypatch.setattr(align, "HEAVY", heavy)
    letters = {c: b for b, c in enumerate(bpe.byte_letters())}
    spelled = {i: t.encode() if i == 50256 else bytes(letters[c] for c in t)
               for t, i in library.get_vocab().items()}
    model = SentencePieceProcessor(model_file=PATH_B)
    library.encode_special_tokens = True
    some = [t if len(t or "") < 5000 else t[:5000] for t in ODD] + texts(60, 300, 5)
    some += some[:4] + [None]
    expected = [brute_alignment(library, model, spelled, t) for t in some]
    library.encode_special_tokens = False
    count = sum((e[3] for e in expected), collections.Counter())
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    frame = spark.createDataFrame([(i // 2, t, 0) for i, t in enumerate(some)],
                                  "doc_id long, text string, n_links long")
    # In local mode the workers are new processes: the stretch is set in this one only.
    aligned = stored(align.align(frame, PATH_A, PATH_B))
    both = align.Aligner(PATH_A, PATH_B)
    raw = [(t or "").encode() for t in some]
    found = both.align(np.frombuffer(b"".join(raw), np.uint8),
                       np.cumsum([0, *map(len, raw)]), [t or "" for t in some])
    written = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in e[2])
               for e in expected]
    assert both.groups(found) == written
    rows = align.with_counts(aligned).collect()
    assert sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups, r.n_links, r.n_best, r.count_sum)
                  for r in rows) == sorted(
        (i // 2, e[0], e[1], len(e[2]), w, sum(e[3].values()),
         sum(n for p, n in e[3].items() if count[p] == best[p[1]]),
         sum(n * count[p] for p, n in e[3].items()))
        for i, (e, w) in enumerate(zip(expected, written, strict=True)))
    assert align.with_counts(stored(align.align(frame.limit(0), PATH_A, PATH_B))).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    built = {}
    for conv, turns in own.items():
        turns.sort()
        h = zlib.crc32(str(conv).encode()) % 4
        base = sorted(own.get(conv - (abs(conv) % 20) * (1 if conv >= 0 else -1), []))
        built[conv] = [t[3:] for t in base[:h]] + [t[3:] for t in turns[h:]]
    members = collections.defaultdict(list)
    for conv in sorted(built):
        for d in range(len(built[conv]) + 1):
            members[tuple(built[conv][:d])].append(conv)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
            leaves[k[:d]] += not kids[k]
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k],
                    saved[k], hashlib.sha256(",".join(
                        str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest())
                   for k, m in members.items()), key=str)


def conversations(seed):
    """Shared beginnings, one conversation of many turns, ties, nulls, copies, absent bases."""
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-25, 130), None]:
        if rng.random() < 0.1:
            continue
        n = 300 if conv == 60 else rng.choice([130, 64, 63]) if conv in (61, 62, 63) \
            else rng.choice([1, 1, 2, 3, 4, 6])
        for turn in range(n):
            text = "hello there" if (conv or 0) > 50 and turn < rng.choice([2, 250]) \
                else rng.choice(["x", "y z", None, "", " "])
            rows.append((conv, rng.choice([turn, turn, turn, None]),
                         rng.choice(["u", "u", "u", None]), text))
    return rows + rows[:3]


@pytest.mark.parametrize("shard, heavy", [(2048, 1 << 16), (5, 8)])
def test_trie(spark, monkeypatch, shard, heavy):
    monkeypatch.setattr(trie, "SHARD", shard)
    monkeypatch.setattr(trie, "HEAVY", heavy)
    rows = conversations(shard)
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, "
                                  "text string, depth long").repartition(5)
    turns = stored(trie.numbered_turns(frame))
    found = trie.trie(trie.rebuilt(turns)).drop("k1", "k2").collect()
    assert sorted(map(tuple, found), key=str) == brute_trie(rows)
    assert trie.trie(trie.rebuilt(stored(trie.numbered_turns(frame.limit(0))))).count() == 0


def test_trie_of_whole_conversations(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "c d")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    nodes = trie.trie(trie.whole(stored(trie.numbered_turns(frame)))).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens)
                  for r in nodes) == [(0, 1, 3, 2, 2, 1), (1, 1, 2, 1, 1, 1), (1, 3, 1, 0, 1, 0),
                                      (2, 1, 1, 0, 1, 0)]


def test_trie_statement(spark, tmp_path):
    """The query and its SQL on rows with ties, nulls and long conversations."""
    rows = conversations(3)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    found = queries.op13_trie(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute("CREATE VIEW conversations AS SELECT * FROM "
                       f"'{tmp_path}/conversations.parquet/*.parquet'")
    expected = connection.execute(queries.ORACLES["op13_trie"])
    assert [c[0] for c in expected.description] == found.columns
    assert sorted(expected.fetchall(), key=str) == sorted(map(tuple, found.collect()), key=str)
