"""Quality, language ID and SimHash against versions written out from their definitions; odd inputs of theirs."""

import random
import re

import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from assaylake.llm import bpe, chat, langid, quality, simhash, substrings, topk

SCHEMA = "doc_id long, text string, lang string, score int"


def _text(rng, n=60, letters="abcdefgh éß漢"):
    return "".join(rng.choice(letters + "  .\n") for _ in range(rng.randint(0, n)))


# ---- SimHash, bit by bit ----


def _plain_simhash(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash_bit_by_bit():
    rng = random.Random(1)
    for _ in range(400):
        text = _text(rng, 200, "abAB É\x85\xa0漢")
        assert simhash.simhash(text.encode(), 3) == _plain_simhash(text)
    long = " ".join(f"w{i % 977}" for i in range(150_000))
    assert simhash.simhash(long.encode(), 3) == _plain_simhash(long)


def test_components_are_neither_fewer_nor_more(spark):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(120)]
        for k in range(rng.randint(1, 4)):
            changed = list(words)
            for _ in range(k * rng.randint(0, 2)):
                changed[rng.randrange(120)] = "zz"
            rows.append((len(rows) * 7 % 1009, " ".join(changed)))
    fps = {i: _plain_simhash(t) for i, t in rows}
    label = {i: i for i in fps}
    for _ in fps:  # spread the smallest id until nothing moves
        moved = {i: min(label[j] for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3) for i in fps}
        if moved == label:
            break
        label = moved
    got = simhash.near_groups(spark.createDataFrame([(i, t, None, 1) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == label
    assert {r.doc_id: r.fp % 2**64 for r in got} == fps


# ---- language ID, by vectors bound one by one ----


def _plain_vector(text):
    letters = np.random.default_rng(langid.SEED).integers(0, 2, (langid.ALPHABET, langid.DIMENSIONS), dtype=np.int8).astype(int) * 2 - 1
    codes, last = [0], 1  # a space on either side; a run of what is no letter is a space of its own
    for c in text:
        code = int(langid.letter_codes()[ord(c)])
        if code or last:
            codes.append(code)
        last = code
    codes.append(0)
    out = np.zeros(langid.DIMENSIONS)
    for i in range(len(codes) - 2):
        out += letters[codes[i]] * np.roll(letters[codes[i + 1]], 1) * np.roll(letters[codes[i + 2]], 2)
    return out


def test_language_profiles_and_cosines_one_by_one(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, 80, "abcé" if i % 2 else "xyzab"), ["x", "y"][i % 2], 1) for i in range(60)]
    rows += [(None, "abc cab", None, 1), (61, None, "x", 1), (62, "", "y", 1), (62, "", "y", 1), (63, " .\n", None, 1), (64, "abc " * 20_000, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = {g: sum(_plain_vector(t or "") for _, t, lang, _ in rows if lang == g) for g in ("x", "y")}
    learned = langid.profiles(docs)
    for g, v in zip(learned["lang"], learned["vector"], strict=True):
        assert np.allclose(v, plain[g] / np.linalg.norm(plain[g]))
    got = langid.predict(docs, learned, "doc_id", "text", names=("lang_pred", "cosine")).collect()
    assert len(got) == len(rows)
    for r in got:
        v = _plain_vector(r.text or "")
        if not any(langid.letter_codes()[ord(c)] for c in r.text or ""):
            assert (r.lang_pred, r.cosine) == ("und", 0.0)
            continue
        cosines = {g: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for g, p in plain.items()}
        assert abs(r.cosine - min(1, max(0, max(cosines.values())))) < 1e-6 and cosines[r.lang_pred] >= max(cosines.values()) - 1e-6
    assert langid.predict(docs.where("false"), learned, "doc_id").count() == 0


# ---- quality, by its own sums ----


def test_isotonic_against_its_definition():
    rng = np.random.default_rng(4)
    for _ in range(30):
        x, y = rng.permutation(25).astype(float), (rng.random(25) < 0.5).astype(float)
        at, levels = quality.isotonic(x, y)
        y = y[np.argsort(x)]
        plain = [max(min(y[j : k + 1].mean() for k in range(i, 25)) for j in range(i + 1)) for i in range(25)]
        assert np.allclose(np.unique(np.round(levels, 9)), np.unique(np.round(plain, 9)))
        assert (np.diff(levels) > -1e-12).all() and (np.diff(at) > 0).all()


def test_ridge_from_partition_sums(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "words", "here", "!!!", "X|Y"][: 3 + 2 * (i % 2)]) for _ in range(rng.randint(1, 40))), None, 1) for i in range(200)]
    rows += [(200, None, None, 1), (201, "", None, 1), (None, "x", None, 1), (3, "again", None, 1), (202, "long " * 30_000, None, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(200)] + [(7, None), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels, fold=(F.col("doc_id") % 3 == 0).cast("int"), width=32)
    taught = [(quality.statistics((t or "").encode()), float((i + 1) % 2), i % 3 == 0) for i, t, *_ in rows if i is not None and i < 200]
    z, y = model.features(np.stack([s for s, _, held in taught if not held])), np.array([v for _, v, held in taught if not held])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + 1e-2 * np.eye(33), z.T @ y), atol=1e-8)
    assert np.allclose(model.mean, np.mean([s for s, *_ in taught], axis=0))
    got = quality.score(docs, model, "doc_id").collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score(docs.where("false"), model, "doc_id").count() == 0


# ---- empty and very long inputs of others ----


def test_empty_and_long_inputs(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert chat.format_conversations(none, path).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "word </s> " * 20_000), (1, 1, "assistant", "word </s> " * 20_000)], none.schema)
    r = chat.digests(chat.format_conversations(long, path)).first()
    assert (r.n_turns, r.loss_chars) == (3, 400_000)
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(vectors, F.col("vec_id") % 2 == 0).count() == 0
    texts = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.kept_words(texts).count() == 0 and bpe.round_trip(texts, path).count() == 0
    repeated = spark.createDataFrame([(1, "w " * 40_000), (2, "w " * 40_000), (2, "w " * 40_000), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words) for r in substrings.kept_words(repeated).collect()) == [(1, 40_000), (2, 40_000), (2, 40_000), (3, 0)]
