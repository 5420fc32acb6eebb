"""Conversation repair, token files and whitening against plain versions."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaylake.functions.scratch import shared_dir
from assaylake.llm import repair, token_files, whiten

BYTES = public_tokenizers.path("byte_bpe_50k.json")

# ---- conversation repair ----


def _plain_audit(rows, inserts=6):
    """Cheapest edits of (role, fault), cheapest sequences first, no two of them merged."""
    heap, bound, found = [(0, "", 0, "")], None, []
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        if bound is not None and cost > bound:
            break
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            bound = cost
            found.append(audit)
        if audit.count("I") < inserts:
            for r in "ua":
                heapq.heappush(heap, (cost + 2, audit + "I", i, said + r))
        if i < len(rows):
            role, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, said))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, said + role[0]))
                for r in "ua":
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, said + r))
    return bound, min(found)


def _searched(rows):
    search, edits = repair.Search(), []
    for i, (role, fault) in enumerate(rows):
        edits += search.add(role, "x", i, fault)
    return edits + search.end()


def test_search_against_all_sequences():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 5))]
        edits = _searched(rows)
        assert (sum(e.row[5] for e in edits), "".join(e.mark for e in edits)) == _plain_audit(rows), rows


def test_search_holds_only_what_is_open():
    rng, search, most = random.Random(2), repair.Search(), 0
    size = lambda e: 1 + sum(map(size, e.kids))
    out = []
    for i in range(4000):
        out += search.add(rng.choice(["user", "assistant", "user", "assistant", "tool"]), "x", i, rng.choice(["", "", "truncated", "blank"]))
        most = max(most, size(search.root))
    assert most < 100
    assert sum(e.mark != "I" for e in out + search.end()) == 4000


def _plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        either = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{either(conv)}:{either(turn)}".encode()) % 20
        role, text = either(role), either(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _plain_summary(rows):
    """What the contract says of one conversation's damaged rows, word for word."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        told = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit = _plain_audit([(r[2], f) for r, f in zip(rows, faults, strict=True)], inserts=3)
    said, i, out = "", 0, []
    for mark in audit:
        role, text = (None, "") if mark == "I" else rows[i][2:]
        i += mark != "I"
        if mark in "RI":
            role = "assistant" if said[-1:] == "u" else "user"
        if mark != "D":
            out.append(f"{role}:{text}")
            said += role[0]
    firsts = [r[2][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest(),
    }


def test_repair_rows(spark):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "why", " \t\n", "", None, "Yes.", "And so on.  ", "Done?\n ", "x" * 200_000 + "."]
    rows = [(c if c else None, t if t != 3 else None, rng.choice(["user", "assistant", "system", None, "tool"]), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += rows[5:9]
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, step long, fault string, seen int")
    got = {r.conv_id: r.asDict() for r in repair.every_conversation(repair.summaries(repair.repair(repair.damage(table))), table).collect()}
    assert set(got) == {r[0] for r in rows}
    damaged = _plain_damage(rows)
    for conv, found in got.items():
        assert found == {"conv_id": conv} | _plain_summary([r for r in damaged if r[0] == conv])
    none = table.where("false")
    assert repair.every_conversation(repair.summaries(repair.repair(repair.damage(none))), none).count() == 0


# ---- token files ----


def test_wavelet_matrix_against_plain():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 70_000, 200_000):
        ids = (rng.zipf(1.3, n) % 50257).astype("<u4")
        shard = token_files.Shard.of_bytes(token_files.build(ids, {"a": np.arange(3)}, 5))
        assert (shard.ids() == ids).all() and shard.before == 5 and shard.index["a"].tolist() == [0, 1, 2]
        for i in rng.integers(0, n, 20) if n else []:
            assert shard.access(int(i)) == ids[i]
        for token in (0, 1, 2, 50_000, 70_000):
            places = np.flatnonzero(ids == token)
            assert shard.count(token) == len(places)
            assert shard.count(token, n // 3, n // 2) == ((places >= n // 3) & (places < n // 2)).sum()
            assert [shard.select(token, k) for k in range(0, len(places), 5000)] == places[::5000].tolist()
        assert list(shard.occurrences(1, n // 2, n // 2 + 500)) == [i for i in range(n // 2, min(n, n // 2 + 500)) if ids[i] == 1]


def test_wavelet_matrix_reads_few_blocks():
    ids = (np.random.default_rng(2).zipf(1.3, 2_000_000) % 50257).astype("<u4")
    data, fetched = token_files.build(ids, {}), []
    shard = token_files.Shard(lambda at, size: fetched.append(size) or data[at : at + size])
    fetched.clear()
    assert shard.access(1_234_567) == ids[1_234_567]
    assert sum(fetched) <= shard.levels * token_files.BLOCK // 8 and sum(fetched) < len(data) / 10


def test_byte_ids_equal_the_library():
    mine, theirs = token_files.ByteTokenizer(BYTES), Tokenizer.from_file(BYTES)
    theirs.encode_special_tokens = True
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x110000, 97)]]
    for shape in ("{}", "a{}b", "! {} x", "b {}{} c", "x{}\ny"):
        texts = [shape.replace("{}", c) for c in every]
        for t, ids, right in zip(texts, mine(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
            assert ids.tolist() == right.ids, repr(t)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab T's  \n\n\t\r\x1d\x85\xa0 漢!?12é") for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "\n", " ", "<|endoftext|> a", "it's <|endoftext|>"]
    for t, ids, right in zip(texts, mine(texts), theirs.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == right.ids, repr(t)


def test_crc_of_both():
    for a, b in ((b"", b"x"), (b"hello", b""), (b"hello" * 7, b"world" * 1000)):
        assert token_files.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_files_rows(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ab cd é!\n") for _ in range(rng.randint(0, 300)))) for i in range(90)] + [(7, "again"), (None, "no id"), (None, None), (200, "word " * 3000), (201, ""), (202, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(i, t, 1, "p", 2) for i, t in rows], "doc_id long, text string, part int, path string, place long")
    manifest = token_files.write_tokens(table.repartition(5), f"{shared_dir(spark)}/tokens-test", BYTES, shard_tokens=1000)
    shards = manifest.orderBy("part", "shard").collect()
    assert all(s.tokens <= 1000 for s in shards) and len(shards) > 10
    theirs = Tokenizer.from_file(BYTES)
    ids = lambda t: np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    got = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids(t)), zlib.crc32(ids(t).tobytes())) for i, t in rows)
    whole = np.concatenate([token_files.open_shard(s.path).ids() for s in shards])
    assert len(whole) == sum(r.n_tokens for r in got)
    none = token_files.write_tokens(table.where("false"), f"{shared_dir(spark)}/tokens-none", BYTES)
    assert none.count() == 0 and token_files.read_tokens(none).count() == 0


# ---- whitening ----

WIDE = "vec_id long, embedding array<float>, n long, x int"


def _plain_whitening(vectors, components=16):
    """From the definition: centred before multiplying, in long doubles."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[float(v * n - s) / n for v, s in zip(r, sums, strict=True)] for r in fit], np.longdouble)
    cov = np.array(off.T @ off / n, float)
    values, vectors_ = np.linalg.eigh(cov)
    kept = np.argsort(-values)[:components]
    all_off = np.array([[float(v * n - s) / n for v, s in zip(r, sums, strict=True)] for r in x])
    white = all_off @ vectors_[:, kept] / np.sqrt(values[kept])
    return n, [sum((n * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x], white, values[kept] / np.trace(cov)


def test_whitening_against_plain(spark):
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    vectors[50:90] = vectors[3]
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)]
    odd = [(900, None, 1, 2), (901, [None, *[1.0] * 19], 1, 2), (902, [float("nan")] * 20, 1, 2), (903, [float("inf")] * 20, 1, 2), (904, [], 1, 2), (905, [1.0], 1, 2)]
    got = whiten.whiten(spark.createDataFrame(rows + odd, WIDE).repartition(7)).collect()
    n, deviation, white, explained = _plain_whitening(vectors)
    assert len(got) == 300 * 16 and {r.n for r in got} == {n}
    assert {r.vec_id: r.deviation for r in got} == dict(enumerate(deviation))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    mine = np.zeros((300, 16))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-7


def test_whitening_of_huge_components_and_flat_tables(spark):
    rng = np.random.default_rng(7)
    far = (rng.normal(size=(40, 3)) * 1e9).astype(np.float32)
    table = spark.createDataFrame([(None if i == 4 else i, v.tolist(), 1, 2) for i, v in enumerate(far)], WIDE)
    got = whiten.whiten(table).collect()
    _, deviation, white, _ = _plain_whitening(far)
    # beyond a long a sum is null, never wrong
    assert sorted({r.deviation for r in got if r.deviation is not None}) == sorted({d for d in deviation if d < 2**63})
    mine = np.array(sorted(abs(r.whitened) for r in got))
    assert np.allclose(mine, np.sort(np.abs(white).ravel()), rtol=1e-6, atol=1e-9)
    flat = whiten.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, 2) for i in range(3)], WIDE)).collect()
    assert len(flat) == 6 and {r.whitened for r in flat} == {0.0} and {r.deviation for r in flat} == {0}
    assert whiten.whiten(spark.createDataFrame([], WIDE)).count() == 0
    assert whiten.whiten(table.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 0
