"""The ten operators: odd inputs, brute force, round trips."""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from lawframe.llm import audio, chat, fingerprint, minhash, mixing, packing, quality, suffix, tokens, urls  # noqa: E402

P = pytest.importorskip("public_tokenizers")
PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return H.odd_documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return H.odd_documents(spark, empty=True)


# 1 quality


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = quality.op1_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    rank, good = held.score.rank().to_numpy(), (held.quality == 1).to_numpy()
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (held.predicted[good] == 1).mean() > 0.95


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (6, 0), (6, 1)], "doc_id long, quality int")
    vectors, net = quality.train(odd, labels)
    got = quality.score(odd, vectors, net, ["doc_id", "key"]).collect()  # "score" is a column of the input too
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    empty_vectors, constant = quality.train(none, labels)
    assert quality.score(none, empty_vectors, constant, ["doc_id"]).count() == 0
    assert {r["score"] for r in quality.score(odd, empty_vectors, constant, ["doc_id"]).collect()} == {0.5}


def test_word_vectors_by_brute_force(spark):
    rows = [(i, H.prose(40 + i, 50)) for i in range(6)] + [(7, ""), (8, None), (9, "one"), (10, "Two, TWO two!")]
    index, want = quality.index_vectors(quality.SLOTS, 1), np.zeros((quality.SLOTS, quality.DIM))
    for _, text in rows:
        slots = [zlib.crc32("".join(c for c in w if c.isalpha()).lower().encode()) % quality.SLOTS for w in (text or "").split()]
        for i, slot in enumerate(slots):
            for j in (i - 1, i + 1):
                if 0 <= j < len(slots):
                    want[slot] += index[slots[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = quality.word_vectors(spark.createDataFrame(rows, "doc_id long, text string"))
    assert np.abs(got - want).max() < 1e-5 and np.abs(want).max() > 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    y = rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))
    p = quality.fit(x, y).probability(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        inside = (p >= low) & (p < low + 0.2)
        assert abs(y[inside].mean() - p[inside].mean()) < 0.08


# 2 tokens


def test_prefix_counts_match_the_library():
    import random

    import sentencepiece

    lib, own, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), tokens.PrefixCounter(PIECES), random.Random(3)
    letters = "abcdefg hijk theing  \n\u2581é①日本🎉<s></s>.,'\t\0"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(300)] + [H.prose(4, 40)]
    for text in texts:
        assert next(own.prefix_counts([text.encode()])).tolist() == [len(lib.encode(text[:i])) for i in range(len(text) + 1)]


def test_truncation_and_budget():
    own = tokens.PrefixCounter(PIECES)
    text = H.prose(5, 100)
    at = own.truncate(text.encode(), 50)
    assert own.count(text[:at].encode()) <= 50 < own.count(text[: at + 1].encode()) + 3


def test_tokens_odd(spark, odd, none):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.count_tokens(odd, PIECES, 4096).collect()))
    assert got == sorted((d or 0, len(t.encode()), len(lib.encode(t)), len(lib.encode(t)) > 4096) for d, t in H.texts_of(odd))
    assert tokens.count_tokens(none, PIECES, 4096).count() == 0


# 3 repeated strings


def test_repeats_odd(spark, odd, none):
    docs = [(d, t.encode()) for d, t in H.texts_of(odd)]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in suffix.remove_repeats(odd, "key").collect())
    assert got == sorted((d or 0, *rest) for d, *rest in H.removed_by_brute_force(docs))
    assert suffix.remove_repeats(none).count() == 0


def test_repeats_at_edges_and_hot_cores(spark, monkeypatch):
    base = H.prose(6, 400)
    texts = ["a" * 1500, "xy" * 700, base, base[100:499] + "Q", base[100:500], "c" + base[5:420] + "c", "d" + base[6:421] + "e", base[:900] + "z" + base[901:] + base[200:900], ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(H.removed_by_brute_force([(i, t.encode()) for i, t in enumerate(texts)]))
    run = lambda: sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in suffix.remove_repeats(df).collect())
    assert run() == want
    spans = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda d, **more: spans(d, most=0, **more))
    assert run() == want


@pytest.mark.parametrize("length, passages", [(400, 255), (255, 100), (71, None)])
def test_repeats_of_other_lengths(spark, odd, length, passages):
    """Passages first, then the longer strings within them: the same rows as looking for these alone."""
    texts = [H.prose(6, 400)[:900], H.prose(6, 400)[100:350] + H.prose(9, 60), H.prose(6, 400)[200:700] + "end", H.prose(9, 60)[:120], None]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    docs = [(d, t.encode()) for d, t in H.texts_of(df)]
    want = sorted((d or 0, n, removed, spans, left) for d, n, removed, spans, left in H.removed_by_brute_force(docs, length))
    rows = suffix.remove_repeats(df, length=length, passages=passages).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in rows) == want
    covered = sorted((d or 0, removed) for d, _, removed, _, _ in H.removed_by_brute_force(docs, passages or length))
    assert sorted((r["doc_id"] or 0, r["n_repeated"]) for r in rows) == covered


def test_repeats_query_shows_shorter_passages(spark, tmp_path):
    """Passages of over 50 words that have under 400 bytes: the contract keeps them, n_repeated tells of them."""
    passage = " ".join(w[:6] for w in H.prose(6, 400).split()[:51])
    assert 255 <= len(passage.encode()) < 400
    texts = [H.prose(20 + i, 60) + (f"\n{passage}\n" if i % 2 else "\n") + H.prose(40 + i, 60) for i in range(8)] + [None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = suffix.op3_suffix(spark, str(tmp_path)).collect()
    docs = [(i, (t or "").encode()) for i, t in enumerate(texts)]
    want = [(d, n, removed, spans, hashlib.sha256(left).hexdigest()) for d, n, removed, spans, left in H.removed_by_brute_force(docs)]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want) and not any(r["n_removed"] for r in rows)
    covered = {d: removed for d, _, removed, _, _ in H.removed_by_brute_force(docs, suffix.PASSAGE)}
    assert {r["doc_id"]: r["n_repeated"] for r in rows} == covered and {d for d, n in covered.items() if n} == {1, 3, 5, 7}


def test_anchors_of_many_texts(monkeypatch):
    texts = [H.prose(k, 30 * k).encode() for k in range(1, 12)] + [b"", b"ab" * 300, b"x"]
    each = [suffix.anchors([t], 255) for t in texts]
    for most in (1, 3000, 1 << 18):
        monkeypatch.setattr(suffix, "AT_ONCE", most)
        text, *rest = suffix.anchors(texts, 255)
        assert text.tolist() == [k for k, x in enumerate(each) for _ in x[0]]
        assert all(np.array_equal(a, np.concatenate(b)) for a, b in zip(rest, list(zip(*each))[1:], strict=True))


def test_merge_orders_suffixes():
    rng = np.random.default_rng(1)
    strings = [rng.integers(1, 4, rng.integers(5, 30)).astype(np.uint16) for _ in range(40)]
    strings = [np.r_[s, np.uint16(0)] for s in strings]
    transforms, ids, suffixes = [], [], []
    for k in range(0, 40, 10):
        order, of, offset, symbols, before = suffix._shard(strings[k : k + 10])
        transforms.append(symbols[before][order])
        ids.append(np.full(len(order), k // 10, np.uint16))
        suffixes += [tuple(strings[k + of[o]][offset[o] :][:8].tolist()) for o in order]
    common, interleave = suffix.merge(np.concatenate(transforms), np.concatenate(ids), 8)
    merged = [None] * len(suffixes)
    for shard_row, at in enumerate(interleave.argsort(kind="stable")):
        merged[at] = suffixes[shard_row]
    whole = [m for m in merged if 0 not in m]
    assert whole == sorted(whole) and len(common) == len(merged)


# 4 chat


def test_chat_odd(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "a"), (1, 2, "user", None), (1, 3, "assistant", "\\0 <|im_end|>\n<|x|"), (2, None, None, ""), (None, 1, "ro\nle<|", "t\n"), (3, 1, "assistant", "<"), (3, 2, "assistant", "\\1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = chat.format_chat(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss"), "segments").collect()
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in got}
    assert back == {1: [("user", "a"), ("user", "a"), ("user", ""), ("assistant", "\\0 <|im_end|>\n<|x|")], 2: [("", "")], None: [("ro\nle<|", "t\n")], 3: [("assistant", "<"), ("assistant", "\\1")]}
    assert {r["conv_id"]: r["loss"] for r in got} == {1: "\\0 <|im_end|>\n<|x|", 2: "", None: "", 3: "<\\1"}
    assert all("".join(s["text"] for s in r["segments"]) == r["formatted"] for r in got)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_oracle(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    made = c.execute(chat.ORACLE)
    names = [d[0] for d in made.description]
    got = chat.op4_chat(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(made.fetchall())


# 5 fingerprints


def test_fingerprints_brute_force(spark, odd, none):
    docs = odd.filter("doc_id is not null and doc_id <> 2")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    rows = sorted(H.texts_of(docs))
    for (d, t), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        r = got[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == str(fingerprint.Fingerprint.of(t.encode())) and r["edited_fingerprint"] == str(fingerprint.Fingerprint.of(changed.encode()))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(none).count() == 0


def test_fingerprints_across_ranges(spark):
    df = spark.createDataFrame([(i * 3 % 101, H.prose(i, 30)) for i in range(101)], "doc_id long, text string")
    dealt = fingerprint.neighbours(df, per_range=7)
    assert dealt.filter("halo").count() == dealt.select("range").distinct().count() > 10
    a = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprints(df).collect()}
    before = fingerprint.neighbours
    fingerprint.neighbours = lambda d: before(d, per_range=7)
    try:
        assert {r["doc_id"]: r["edited_sha256"] for r in fingerprint.fingerprints(df).collect()} == a
    finally:
        fingerprint.neighbours = before


def test_homomorphism_and_likeness():
    of = lambda *lines: fingerprint.Fingerprint.of("\n".join(lines).encode())
    lines = [H.prose(i, 40) for i in range(40)]
    whole = of(*lines)
    assert str(of(*lines[:10]) + of(*lines[10:])) == str(whole) == str(of(*lines[::-1])) == str(fingerprint.Fingerprint.parse(str(whole)))
    assert str(whole - of(lines[3])) == str(of(*lines[:3], *lines[4:]))
    assert whole.likeness(of(*lines[:30], *(H.prose(100 + i, 40) for i in range(10)))) > 0.35 > whole.likeness(of(*(H.prose(200 + i, 40) for i in range(40))))


def test_likeness_of_a_line_with_one_word_put_in_front():
    of = fingerprint.Fingerprint.of
    line = H.prose(5, 1000).encode()
    assert of(line).likeness(of(b"word " + line)) > 0.9
    assert of(b"one").pairs == of(b"one two").pairs == 1 and of(b"one two three").pairs == 2


# 6 near duplicates


def test_near_duplicates_odd(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "", i) for i, r in enumerate(odd.select("doc_id", "text").collect())]
    want = H.classes_by_brute_force([(d, t) for d, t, _ in rows])
    got = defaultdict(list)
    for r in minhash.near_duplicates(odd).collect():
        got[r["class_id"]].append(r["doc_id"])
    named = {min((rows[i][0] for i in g if rows[i][0] is not None), default=None): sorted((rows[i][0] or 0) for i in g) for g in want}
    assert {k: sorted(x or 0 for x in v) for k, v in got.items()} == named
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicate_chain(spark):
    """Copies of copies: neighbours are alike, ends are not; a star of edits whose members are alike only to the centre."""
    base = H.prose(7, 300).split()
    texts = []
    for i in range(24):
        words = list(base)
        for k in range(i):
            words[5 + 11 * k] = f"edit{k}"
        texts.append(" ".join(words))
    for i in range(30):
        words = list(base)
        for k in range(5):
            words[7 + 57 * k + i] = f"star{i}x{k}"
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(set)
    for r in minhash.near_duplicates(df).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert sorted(map(frozenset, got.values()), key=min) == H.classes_by_brute_force(list(enumerate(texts)))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    """Near copies with and without doc_id are linked; unlike texts with one doc_id are not, nor does that doc_id chain others."""
    a, b, c = H.prose(11, 200), H.prose(12, 200), H.prose(13, 200)
    rows = [(None, a), (None, a + " more"), (None, b), (9, b + " more"), (5, c), (5, H.prose(14, 200)), (6, c + " more"), (5, H.prose(15, 200))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {hashlib.md5(t.encode()).digest(): i for i, (_, t) in enumerate(rows)}
    groups, names = defaultdict(set), {}
    for r in minhash.near_duplicates(df).collect():
        i = of[bytes(r["copy"])]
        groups[bytes(r["root"])].add(i)
        names[i] = r["class_id"]
    assert sorted(map(frozenset, groups.values()), key=min) == H.classes_by_brute_force(rows) == [{0, 1}, {2, 3}, {4, 6}, {5}, {7}]
    assert names == {0: None, 1: None, 2: 9, 3: 9, 4: 5, 5: 5, 6: 5, 7: 5}


def test_links_by_counts_and_by_sets(spark):
    """A line repeated often outweighs what else differs; and where counts differ, sets of shingles may still be alike."""
    line, other = H.prose(21, 30), H.prose(22, 60)
    rows = [(1, " ".join([line] * 40)), (2, " ".join([line] * 40) + " " + H.prose(23, 25)), (3, other + " " + " ".join(["x"] * 6)), (4, other + " " + " ".join(["x"] * 400)), (5, H.prose(24, 60))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5} and H.classes_by_brute_force(rows) == [{0, 1}, {2, 3}, {4}]


def test_recall_by_similarity(spark):
    """400 pairs of 60 to 400 words with edits at every similarity from 0.6 to 1: linked where alike, and only there."""
    rng, rows, alike = np.random.default_rng(8), [], {}
    for k in range(400):
        words = [f"{w}{k}" for w in H.prose(1000 + k, int(rng.integers(60, 400))).split()]
        changed = list(words)
        for at in rng.choice(len(words), int(rng.integers(0, max(2, len(words) // 14))), replace=False):
            changed[at] = f"edit{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed))]
        alike[k] = len(H.classes_by_brute_force(rows[-2:])) == 1
    assert 100 < sum(alike.values()) < 350
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 2 * k and (got[2 * k + 1] == 2 * k) == alike[k] for k in alike)


def test_open_clusters_in_small_blocks(spark, monkeypatch):
    """The chain and star again, with blocks of a few members each."""
    linked = minhash._linked_in_blocks
    monkeypatch.setattr(minhash, "_linked_in_blocks", lambda *a: linked(*a, asked_bytes=8000, held_bytes=20_000))
    test_near_duplicate_chain(spark)


def test_dart_minhash_estimates():
    rng = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        e = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
        v, w = rng.random(len(e)) * 3 + 0.1, rng.random(len(e)) * 3 + 0.1
        errors.append((minhash.dart_minhash(e, v) == minhash.dart_minhash(e, w)).mean() - np.minimum(v, w).sum() / np.maximum(v, w).sum())
    assert abs(np.mean(errors)) < 0.03


# 7 mixing


def brute_targets(sizes, weights, most):
    found, free = {}, set(range(len(sizes)))
    while True:
        left = sum(sizes) - sum(found.values())
        shares = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        above = [i for i in free if shares[i] > most * sizes[i]]
        if not above:
            return [found.get(i, shares.get(i, 0.0)) for i in range(len(sizes))]
        for i in above:
            found[i] = most * sizes[i]
            free.discard(i)
        if not free:
            return [found[i] for i in range(len(sizes))]


def test_mixing(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = mixing.op7_mixing(spark, big).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for d, r in docs.items()}
    total, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == sizes[r["doc_id"]] and 0 <= r["taken"] <= 3 * r["size"]
        total[docs[r["doc_id"]]["source"]] += r["size"]
        taken[docs[r["doc_id"]]["source"]] += r["taken"]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([total[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == total[source] and abs(r["target"] - want[source]) < 1e-6 * (1 + want[source])
    assert all(abs(taken[s] - want[s]) <= max(128, 0.01 * want[s]) for s in order)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.op7_mixing(spark, big).collect()))


def test_apportionment_is_highest_quotients():
    rng = np.random.default_rng(4)
    for _ in range(200):
        votes = rng.integers(0, 50, rng.integers(1, 8)).astype(float).tolist()
        most = rng.integers(0, 30, len(votes)).tolist()
        seats = int(rng.integers(0, 60))
        held = [0] * len(votes)
        for _ in range(min(seats, sum(m for m, v in zip(most, votes, strict=True) if v > 0))):
            i = max((i for i in range(len(votes)) if held[i] < most[i] and votes[i] > 0), key=lambda i: (votes[i] / (2 * held[i] + 1), -i))
            held[i] += 1
        assert mixing.apportion(votes, seats, most) == held


def test_taken_words_by_brute_force(spark, sf_dir):
    """Every word of a shard looked up on its own: its block's turn, and the shard's rounds; and blocks as apportioned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs, shard_words=4000).collect()
    shards = defaultdict(dict)
    for r in rows:
        taken = 0
        for i in range(r["size"]):
            block = (r["at"] + i) // 64
            extra = (block * r["step"] + r["shift"]) % r["blocks"] < r["more"]
            taken += r["rounds"] + extra
            shards[r["source"], r["blocks"], r["more"], r["shift"]][block] = extra
        assert r["taken"] == taken
    for (_, blocks, more, _), seen in shards.items():
        assert len(seen) == blocks and sum(seen.values()) == more


def test_mixing_odd(spark, odd, none):
    mixed = mixing.mix(odd, *odd.columns)
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    made = mixing.materialise(mixed)
    words = made.agg(F.sum(mixing.size_of(F.col("text")))).first()[0]
    assert words == sum(r["taken"] for r in rows) and made.columns == odd.columns
    assert mixing.mix(none).count() == 0


# 8 packing


def test_packing_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    pieces = packing.pack(odd, WORDS, 64).collect()
    want = Counter(tuple(lib.encode(t, add_special_tokens=False).ids + [2]) for _, t in H.texts_of(odd))
    spans = sorted((r["sequence_id"], r["offset"], r["length"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], np.uint32).tolist()) for r in pieces)
    at, whole, docs = 0, [], Counter()
    for sequence, offset, length, start, size, ids in spans:
        assert (sequence, offset) == divmod(at, 64) and length == len(ids) > 0 and offset + length <= 64 and start == len(whole)
        at += length
        whole += ids
        if len(whole) == size:
            docs[tuple(whole)] += 1
            whole = []
    assert docs == want and not whole
    assert packing.pack(none, WORDS).count() == 0


def test_units_match_the_library():
    import random

    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS), random.Random(5)
    letters = [*"abCDefg hiÅjk thE'ing's  \n\u2581é①日本🎉.,'\t\0\x1c\x85\u00a0\u3000ΑΣσς\u0301İ", "<|endoftext|>", "'re", "12 "]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(2000)]
    assert own.encode([t.encode() for t in texts]) == [np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]


# 9 URLs


def brute_rule(host, path, given):
    fits = [(len(h + p), h + p, v) for v, h, p in given if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=(0, None, None))[1:]


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG:80/es/x?y=://z", "x://example.org/en/1#f", "https://m.example.org/en/2", "http://com/fr/", "http://a.com/de/1?q", "http://acom/de/", "a\nb://Ä.com/fr/\n?", "http://org", "http://org/"]


@pytest.mark.parametrize("bound", [100, 0])
def test_urls(spark, bound):
    pages = spark.createDataFrame([*enumerate(URLS), (3, "http://"), (None, "http://bad.net/a/b")], "page_id long, url string")
    rules = spark.createDataFrame([(["h:bad.net", "p:a"], 0.9, 0.1), (["h:bad.net", "p:zzz"], 0.9, 0.1)], "antecedent array<string>, confidence double, support double")
    got = urls.judge(pages, rules, urls.GIVEN, most_rules=bound).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        assert (r["host"], r["path"]) == (host, path)
        rule, verdict = brute_rule(host, path, urls.GIVEN)
        assert (r["rule"], r["verdict"]) == (rule, verdict or ("block" if host == "bad.net" else "allow"))


def test_mined_rules(spark):
    rows = [("http://a.net/x/%d" % i, i % 2 == 0) for i in range(60)] + [("http://spam.net/win/%d" % i, True) for i in range(40)]
    # bad by luck: three of three pages are not surely above seven tenths
    rows += [("http://few.net/q", True)] * 3
    rules = urls.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.02, 1.2)
    found = {tuple(r["antecedent"]): r["confidence"] for r in rules.collect()}
    assert found == {("h:spam.net",): 1.0, ("p:win",): 1.0}
    assert urls.mine_rules(spark.createDataFrame([], "url string, bad boolean"), 0.05, 1.2).count() == 0


def test_query_blocks_by_a_mined_rule(spark, tmp_path):
    """Unlabelled pages of a host whose labelled pages are bad; given rules come first."""
    hosts = ["win.spam.example.net"] * 60 + ["calm.example.net"] * 140
    pages = [(i, f"http://{h}/en/{i}") for i, h in enumerate(hosts)] + [(500, "http://new.spam.example.net/x"), (501, "http://calm.example.net/x"), (502, "http://spam.example.net.example.org/en/1"), (503, "http://win.spam.example.net.com/fr/")]
    labels = [(i, int(h != hosts[0] and i % 10 > 0), 0) for i, h in enumerate(hosts)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["page_id"]: r for r in urls.op9_urls(spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and got[500]["verdict"] == "block" and got[500]["rule"] is None and got[500]["confidence"] == 1.0
    assert got[501]["verdict"] == "allow" and (got[502]["rule"], got[502]["verdict"]) == ("example.org/en/1", "block")
    assert (got[503]["rule"], got[503]["verdict"]) == ("com/fr/", "allow")
    assert all((got[i]["verdict"] == "block") == (i < 60) for i in range(200))


# 10 audio


def test_audio_odd(spark, odd, none):
    rows = audio.store_audio(odd).collect()
    assert Counter((r["n_bytes"], bytes(r["payload"])) for r in rows) == Counter((len(t.encode()), audio.payload_of(t.encode())) for _, t in H.texts_of(odd))
    assert all(r["damaged"] == r["skipped"] == 0 and r["table_frames"] == len(r["offsets"]) and abs(r["seconds"] - 0.024 * len(r["offsets"])) < 1e-12 for r in rows)
    assert audio.store_audio(none).count() == 0


def test_audio_resynchronises():
    media = audio.write(audio.payload_of(b"hello " * 1000))
    clean = audio.parse(media)
    hurt = audio.parse(b"junk\xff\xfb" + media[: clean.offsets[3] + 100] + media[clean.offsets[3] + 150 :])
    assert len(clean.offsets) == 11 and len(hurt.offsets) >= 9 and hurt.skipped > 0
    flipped = bytearray(media)
    flipped[clean.offsets[2] + 10] ^= 1
    assert audio.parse(bytes(flipped)).damaged == 1
    assert audio.parse(b"") == audio.Stream() and audio.parse(b"\xff" * 50).offsets == []


def test_audio_tag_only_behind_frames():
    """`TAG` 128 bytes before the end: inside the last frame it is payload, behind it an ID3v1 tag."""
    payload = audio.payload_of(b"a" * 576 + b"b" * 521 + b"TAG" + b"c" * 52)
    media = audio.write(payload)
    assert media[-128:-125] == b"TAG" and audio.read(media)[0] == payload
    clean = audio.write(audio.payload_of(b"hello " * 1000))
    tagged = audio.parse(clean + b"TAG" + b"song".ljust(125, b"\0"))
    assert tagged.offsets == audio.parse(clean).offsets and ("TIT1", "song") in tagged.tags and tagged.skipped == 0


@pytest.mark.parametrize("mark", [b"TAG", b"ID3\x04\0\0\0\0\0\x20", b"Xing\0\0\0\x01", b"\xff\xfb\x94\xc4", bytes.fromhex("fffb94c4") * 40])
def test_audio_keeps_payloads_that_look_like_its_own_marks(mark):
    for at in range(0, 576 - len(mark) + 1):
        payload = audio.payload_of(b"a" * 576 + b"b" * at + mark)
        assert audio.read(audio.write(payload))[0] == payload


def test_audio_digests(spark, tmp_path, odd):
    odd.withColumn("text", F.when(F.col("doc_id") == 10, "a" * 521 + "TAG").otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, audio.op10_audio(spark, str(tmp_path)).drop("feature").collect()))
    want = []
    for d, t in H.texts_of(spark.read.parquet(f"{tmp_path}/documents.parquet")):
        raw = t.encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if len(raw) % 576 or not raw else 0)
        media = audio.write(payload)
        from pyspark.sql import Row

        row = Row("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
        want.append(str(row(d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest())))
    assert got == sorted(want)
    features = {}
    for r in audio.op10_audio(spark, str(tmp_path)).collect():
        assert features.setdefault(r["media_sha256"], r["feature"]) == r["feature"]


def test_audio_headers():
    for bits, want in ((0xFFFB9064, (3, 128, 44100, 417)), (0xFFF39064, (3, 80, 22050, 261)), (0xFFFD9004, (2, 160, 44100, 522)), (0xFFFF9000, (1, 288, 44100, 312))):
        h = audio.header_of(bits.to_bytes(4))
        assert (h.layer, h.kbps, h.rate, h.size) == want
