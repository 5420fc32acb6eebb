"""Corpus operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from assaylake.llm import bpe, chat, exact_dedup, langid, line_dedup, packing, quality, simhash, substrings, token_files, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, seg1 long, label int"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _docs(spark, rows):
    """Rows (doc_id, text) with extra columns, some named like those used inside."""
    return spark.createDataFrame([(i, t, None, "s", None, 5, 6, 7) for i, t in rows], SCHEMA)


ODD = [(1, "a b c"), (2, None), (3, ""), (None, "a b c"), (1, "a b c"), (4, " \n\t "), (5, "x" * 20000), (6, "word " * 3000)]


def test_byte_bpe_equals_tiktoken():
    rng = random.Random(1)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    texts = ["".join(rng.choice("abst ''  \n\t\r12é漢字!?.'slrevmdll🙂") for _ in range(rng.randint(0, 50))) for _ in range(3000)] + ["x" * 3000, " " * 50, "don't 'sup ''s 'lll"]
    codec = bpe.ByteBPE(MULTI)
    for text, (_, pieces) in zip(texts, codec.encode(texts), strict=True):
        ids = list(itertools.chain.from_iterable(pieces))
        assert ids == enc.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_byte_bpe_rows(spark):
    got = bpe.round_trip(_docs(spark, ODD), MULTI).collect()
    assert sorted((r.decoded_sha256) for r in got) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD)
    first = bpe.encode_documents(_docs(spark, [(1, "héllo wörld")]), MULTI).first()
    assert first.starts[0] == 0 and first.starts == sorted(first.starts)
    assert bpe.round_trip(_docs(spark, []), MULTI).count() == 0


def test_word_ids_equal_the_library():
    rng = random.Random(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = packing.WordTokenizer(path), Tokenizer.from_file(path)
    texts = ["".join(rng.choice("abSTé'  \n\t\x1d\x85\xa012漢!?.,'slreΣ́İ") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    for t, ids in zip(texts, mine(texts), strict=True):
        assert ids.tolist() == theirs.encode(t, add_special_tokens=False).ids


def test_word_ids_of_every_codepoint():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, theirs = packing.WordTokenizer(path), Tokenizer.from_file(path)
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3100, 0x20000, 97) if not 0xD800 <= c < 0xE000]
    for shape in ("{}", "ab{}cd", "1{}2", " {} ", "!{}x{}"):
        texts = [shape.replace("{}", c) for c in every]
        for t, ids, right in zip(texts, mine(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == right.ids, repr(t)


def test_packing_checksums(spark):
    import zlib

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    rows = [(i, "".join(rng.choice("ab cdé!\x1d İ1,") for _ in range(rng.randint(0, 400)))) for i in range(60)] + [(60, None)]
    theirs = Tokenizer.from_file(path)
    ids = {i: np.array(theirs.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows}
    for r in packing.pack(_docs(spark, rows), path, length=64).collect():
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_first_fit_decreasing_against_plain():
    rng = random.Random(4)
    sizes = np.array(sorted((rng.randint(1, 100) for _ in range(400)), reverse=True))
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    space: list[int] = []
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        at = next((i for i, x in enumerate(space) if x >= s), len(space))
        if at == len(space):
            space.append(100)
        assert (b, o) == (at, 100 - space[at])
        space[at] -= s


def test_packing_rows(spark):
    rows = packing.pack(_docs(spark, ODD), public_tokenizers.path("word_bpe_49k.json"), length=64).collect()
    by_seq: dict[int, list] = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert sum(r.length for r in rows if r.doc_id == 2) == 1
    assert packing.pack(_docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("budget", [2_000, 96_000_000])
def test_exact_groups(spark, budget):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", None, "abc", "abd", "ab", "é" * rng.randint(1, 3), "q" * 500])) for i in range(200)] + ODD
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(_docs(spark, rows).repartition(5), keep="largest", budget_bytes=budget).collect()), key=str)
    groups: dict[str, list] = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    assert got == sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""]) for i, t in rows), key=str)


def test_trie_shares_prefixes():
    trie = exact_dedup.RadixTrie(min)
    words = [b"romane", b"romanus", b"romulus", b"rom", b"", b"rubens", b"romane"]
    for i, w in enumerate(words):
        trie.add(w, i, 1, w.decode())
    assert sorted((p, t[0], t[1]) for p, t in trie.take()) == sorted((w, words.index(w), words.count(w)) for w in set(words))


def test_chat_round_trip():
    rng = random.Random(2)
    parts = ["<|turn|>", "<|say|>", "<|done|>", "<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "é", "漢", "🙂", " ", "x"]
    codec = bpe.codec(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for _ in range(800):
        turns = [(rng.choice(["user", "assistant", "a<|say|>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        text, marks, spans = chat.render(turns)
        assert chat.read(text) == turns
        ((_, begin, end),) = chat.encode(codec, [text], [marks])
        shown = "".join(map(chat.unescape, chat.masked_text(text, begin, end, chat.masked_tokens(begin, end, spans))))
        assert shown == "".join(t for r, t in turns if r == "assistant")


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", None, 0), (1, 1, "user", "hi", 0), (None, 1, None, "</s>", 0), (None, None, "assistant", "x", 0)]
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, input_ids int"), public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()}
    assert got == {1: (2, 0), None: (2, 1)}


def test_language_id(spark):
    en, de = "the cat sat on the mat and the dog ran", "der hund und die katze sind in dem haus"
    docs = spark.createDataFrame([(i, en if i % 2 else de, "en" if i % 2 else "de") for i in range(20)] + [(50, "the dog and the cat", None), (51, "12 34", "en"), (52, None, "de"), (53, "", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, langid.profiles(docs), "doc_id").collect()}
    assert got[50][0] == "en" and got[0][0] == "de" and got[1][0] == "en"
    assert got[51] == got[52] == got[53] == ("und", 0.0)
    assert langid.predict(docs, langid.profiles(docs.limit(0)), "doc_id").where("lang_pred <> 'und'").count() == 0


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) for _ in range(40)) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "###", "buy!!", "WIN!!"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(240)]
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), (999, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:150]] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.score(docs, quality.fit(docs, labels), "doc_id").collect()}
    assert sum(got[i].predicted == q for i, _, q in rows[150:]) >= 85
    assert all(0 <= r.score <= 1 for r in got.values()) and 999 in got
    blank = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, blank, "doc_id").collect()} == {0.5}


def test_bk_tree_and_stars():
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(5)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.within(v, 3)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 3]


@pytest.mark.parametrize("tree_values", [3, 4096])
def test_near_groups(spark, tree_values):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in (0, 1, 1, 2, 2, 3)})
    signed = [(int(np.uint64(f & (1 << 64) - 1).view(np.int64)),) for f in fps]
    got = simhash.links(spark.createDataFrame(signed, "fp long"), tree_values=tree_values).collect()
    up = {x[0]: x[0] for x in signed}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in got:
        assert (r.u ^ r.v).bit_count() >= 1
        a, b = root(r.u), root(r.v)
        up[max(a, b)] = min(a, b)
    mine = {x[0]: root(x[0]) for x in signed}
    for (a,), (b,) in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            assert mine[a] == mine[b]


def test_simhash_odd_rows(spark):
    got = simhash.near_groups(_docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.fp == 0} == {2}
    assert simhash.keep_one(_docs(spark, ODD)).columns == _docs(spark, ODD).columns
    assert simhash.near_groups(_docs(spark, [])).count() == 0


def _plain_repeats(rows, window):
    words = [(float("inf") if i is None else i, (t or "").split()) for i, t in rows]
    first: dict[tuple, float] = {}
    for i, w in words:
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, float("inf")), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        out.append((sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("crowded", [1, 4000])
def test_substrings_against_brute_force(spark, crowded):
    rng = random.Random(8)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(0, 30))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((rng.choice([i, i, i, 5, None]), " ".join(w)))
    rows += [(70, None), (71, ""), (5, rows[3][1])]
    docs = _docs(spark, rows)
    got = sorted((r.n_removed, r.kept) for r in substrings.kept_words(docs, window=8, k=3, shard_segments=5, crowded=crowded).collect())
    assert got == sorted(_plain_repeats(rows, 8))
    cut = substrings.cut_repeats(docs, window=8, k=3)
    assert cut.columns == docs.columns
    assert sorted(" ".join((r.text or "").split()) for r in cut.collect()) == sorted(k for _, k in got)


def test_lines_near_copies(spark):
    long = "this is one fairly long line about measuring many proteins in yeast cells under stress and other conditions"
    rows = [(1, f"Hello there!\n{long}\n\n---"), (2, f"hello, THERE\n{long.upper()}."), (3, "other\nhello there"), (None, "hello there"), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(_docs(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 4, 0)
    assert got[2] == ("", 2, 2) and got[3] == ("other", 2, 1) and got[None] == ("", 1, 1)
    assert got[4][0] is None and got[5] == ("", 1, 0)
    assert line_dedup.dedup_lines(_docs(spark, [])).count() == 0


def test_top_k_against_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)] + [(200 + i, [0.5] * 6) for i in range(30)]
    odd = [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, []), (304, [1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got: dict[int, list] = {}
    for r in topk.top_k(df, df["vec_id"] % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    floor = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    for q in (i for i in floor if i % 20 == 0):
        want = sorted(((i, sum(a * b for a, b in zip(floor[q], v, strict=True))) for i, v in floor.items() if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == want
    assert set(got) == {i for i in floor if i % 20 == 0}


@pytest.mark.parametrize(("scale", "slices"), [(1.0, 3), (1e9, 2), (1e17, 2)])
def test_top_k_with_ids_that_repeat(spark, scale, slices):
    """Ids with several vectors and vectors with several ids, and scores beyond a double and a long."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * scale for _ in range(6)]) for i in range(90)] + [(500 + i, [0.5 * scale] * 6) for i in range(9)] + [(7, [0.9 * scale] * 6), (21, [0.8 * scale, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got: dict[int, list] = {}
    for r in topk.top_k(df, df["vec_id"] % 20 == 0, k=5, slices=slices).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    queries = [(i, v) for i, v in whole if i % 20 == 0]
    assert set(got) == {i for i, _ in queries}
    for q, own in queries:
        assert got[q] == sorted(((i, held(sum(a * b for a, b in zip(own, v, strict=True)))) for i, v in whole if i != q), key=lambda x: (-x[1], x[0]))[:5]


def test_latin_words_are_learned_one_at_a_time_and_others_as_before():
    """Words of Latin-1 texts take no list of gaps; capitals, marks, odd spaces and long words keep the library's ids."""
    rng = random.Random(12)
    units = ["Word", "word", "WORD,", "été.", "µm", "ª,", "x" * 150, "Y" * 150 + "!", "don't", "a-b;", "3,5:", "ÿ?", "\x1f", "\x1c\x1cq", "\xa0", "ß!", "…", "ǆ", "文字", "İ", "."]
    texts = ["".join(rng.choice(units) + rng.choice([" ", "\n", "  ", "\t", " \n", "\n\n"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    for mine, path in ((packing.WordTokenizer, "word_bpe_49k.json"), (token_files.ByteTokenizer, "byte_bpe_50k.json")):
        mine, theirs = mine(public_tokenizers.path(path), cache_size=20), Tokenizer.from_file(public_tokenizers.path(path))
        theirs.encode_special_tokens = True
        assert isinstance(mine.known, packing.Remembered)
        for at in range(0, len(texts), 50):
            part = texts[at : at + 50]
            assert [x.tolist() for x in mine(part)] == [theirs.encode(t, add_special_tokens=False).ids for t in part]
        assert max(map(len, mine.known)) <= 100
