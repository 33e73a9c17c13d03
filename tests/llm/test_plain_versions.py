"""I-Match and the classifier's training against plain versions, and operators on odd tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import bpe, imatch, neardup, packing, quality, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
M64 = (1 << 64) - 1


def documents(spark, rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, text string")


# -- op3 -------------------------------------------------------------------------------------------


def mixed(x):
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & M64
    x = (x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 32)


def kept_by(term, subset, level):
    for i in range(level):
        x = (term ^ (term >> 29)) * int(imatch._SEEDS[i]) & M64
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & M64
        if not (x ^ (x >> 31)) >> subset & 1:
            return False
    return True


def plain_fingerprint(text, band):
    found = sorted({imatch.h64(w.encode()) for w in text.lower().split()})
    inside = [t for t in found if t >> (64 - imatch.BITS) in band]
    found = found if len(inside) < imatch.LEAST_SHARE * len(found) else inside
    if not found:
        return "text:" + hashlib.sha256(text.encode()).hexdigest()[:32]
    level = 0
    while 4 ** (level // 2 + 1) * imatch.TERMS_A_SUBSET <= len(found):
        level += 2
    parts = []
    for at in (level, level + 2):
        hashes = []
        for k in range(imatch.SUBSETS):
            chosen = [t for t in found if kept_by(t, k, at)]
            total = sum(mixed(t) * pow(0x9E3779B97F4A7C15, i + 2, 1 << 64) for i, t in enumerate(chosen)) & M64
            hashes.append(f"{mixed(total) & 0xFFFF:04x}" if chosen else "----")
        parts.append("".join(hashes))
    return f"{len(found)}:{level}:{parts[0]}:{parts[1]}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if "text" in a or "text" in b:
        return 0.0
    (m, i, *x), (n, j, *y) = a.split(":"), b.split(":")
    m, n = int(m), int(n)
    known = {int(i) + 2 * k: v for k, v in enumerate(x)}
    other = {int(j) + 2 * k: v for k, v in enumerate(y)}
    found = []
    for level in set(known) & set(other) - {0}:
        same = [known[level][c : c + 4] == other[level][c : c + 4] for c in range(0, 4 * imatch.SUBSETS, 4)]
        p = sum(same) / len(same)
        if p:
            found.append((p / 4.0**level / (1 - p + 1 / len(same)), math.log(p) / math.log(1 - 2.0**-level)))
    if not found:
        return 0.0
    d = max(sum(w * e for w, e in found) / sum(w for w, _ in found), abs(m - n))
    return min(1.0, max(0.0, (m + n - d) / (m + n + d)))


def test_fingerprints_equal_a_plain_version(spark):
    rng = random.Random(41)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    texts = [" ".join(rng.choice(words[: rng.choice([20, 300, 1500])]) for _ in range(rng.choice([0, 1, 3, 20, 150, 900]))) for _ in range(90)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "\n \t"), (503, texts[5]), (503, texts[5]), (503, "other words"), (None, "no id"), (600, "W " * 20_000), (601, "x" * 60_000)]
    df = documents(spark, rows)
    lexicon = imatch.lexicon_of(df)
    frequency = defaultdict(int)
    for t in {t or "" for _, t in rows}:
        for slot in {imatch.h64(w.encode()) >> (64 - imatch.BITS) for w in t.lower().split()}:
            frequency[slot] += 1
    n = len({t or "" for _, t in rows})
    band = {slot for slot, c in frequency.items() if imatch.LEAST_DOCS <= c <= imatch.MOST_SHARE * n}
    assert set(np.flatnonzero(lexicon).tolist()) == band
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = (plain_fingerprint(x, band) for x in (t, edited, after))
        wanted.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    got = [(r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in imatch.compare_edited(df, lexicon).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_likeness_is_near_the_jaccard_similarity_of_terms():
    rng = random.Random(42)
    lexicon = np.ones(1 << imatch.BITS, bool)
    off = []
    for _ in range(300):
        m, share, grown = rng.choice([8, 40, 200, 3000]), rng.random(), rng.choice([1, 1, 2, 3])
        a = [f"a{rng.random()}" for _ in range(m)]
        b = a[: int(share * m)] + [f"b{rng.random()}" for _ in range(grown * m - int(share * m))]
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        off.append(imatch.likeness(*(imatch.fingerprint(" ".join(x), lexicon) for x in (a, b))) - true)
    assert np.mean(np.abs(off)) < 0.12 and np.quantile(np.abs(off), 0.95) < 0.35


# -- op10 ------------------------------------------------------------------------------------------


def test_training_equals_plain_ftrl(spark):
    """One learner, one round: coordinate by coordinate, in the order of the keys' hashes."""
    rng = random.Random(43)
    words = ["good", "Bad!", "x1", "the", "of", "**", "end."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    labels = {i: int("Bad!" not in t) for i, t in rows}
    df = documents(spark, rows)
    known = spark.createDataFrame(list(labels.items()), "doc_id bigint, label int")
    bits = 10
    model = quality.train(df, known, bits=bits, learners=1, rounds=1)
    order = [r[0] for r in known.orderBy(F.xxhash64(F.col("doc_id").cast("string"))).collect()]
    z, n, text_of = defaultdict(float), defaultdict(float), dict(rows)

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for key in order:
        index, value = quality.features(text_of[key], bits)
        row = [*zip(index.tolist(), value.tolist(), strict=True), (1 << bits, 1.0)]
        held = {i: weight(i) for i, _ in row}
        p = 1 / (1 + math.exp(-sum(held[i] * v for i, v in row)))
        for i, v in row:
            g = (p - labels[key]) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * held[i]
            n[i] += g * g
    wanted = np.array([weight(i) for i in range((1 << bits) + 1)])
    assert np.abs(wanted).max() > 0.05
    np.testing.assert_allclose(model, wanted, atol=2e-6)


def test_features_are_shares_of_word_and_shape_runs():
    text = "One two two"
    index, value = quality.features(text)
    assert value.sum() == pytest.approx(quality.SCALE)
    assert len(set(index.tolist())) == len(index) and quality.features("")[0].size == 0


# -- packing against a bound -------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_near_the_lower_bound(seed):
    rng = random.Random(seed)
    lengths = [min(1024, int(rng.choice([rng.expovariate(1 / 120), rng.gauss(500, 150), rng.uniform(1, 1024)]))) for _ in range(4000)]
    histogram = defaultdict(int)
    for x in lengths:
        histogram[max(1, x)] += 1
    made = packing.plan(dict(histogram))
    used = defaultdict(int)
    for held, n in made:
        assert sum(held) <= 1024
        for x in held:
            used[x] += n
    assert used == histogram
    bound = max(math.ceil(sum(x * n for x, n in histogram.items()) / 1024), sum(n for x, n in histogram.items() if x > 512))
    assert sum(n for _, n in made) <= 1.01 * bound + 1


def test_the_library_sees_matches_as_it_sees_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rng = random.Random(44)
    bits = [" ", "\n", "  ", "\n\n", "\t", "a", "Word", "é", "Don't", "'s", "'", "x.", "!!", "***", "12", "漢字", "½", "<|endoftext|>", "\x85", "　", "ß", "ª", "\r\n"]
    rows = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = packing.library_tokenizer(JSON).encode_texts(rows)
    for t, ids in zip(rows, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# -- odd tables --------------------------------------------------------------------------------------


def test_empty_tables_and_clashing_names(spark):
    odd = spark.createDataFrame([(1, "some words here", [7], "mine", "mine"), (None, None, [8], "mine", "mine"), (1, "some words here", [7], "mine", "mine")], "doc_id bigint, text string, ids array<int>, decoded string, score string")
    out = bpe.decode(bpe.encode(odd, RANKS), RANKS)
    assert out.columns == ["doc_id", "score", "ids", "decoded"] or set(out.columns) == {"doc_id", "score", "ids", "decoded"}
    assert sorted(bytes(r["decoded"]).decode() for r in out.collect()) == ["", "some words here", "some words here"]
    assert bpe.decode(bpe.encode(odd.limit(0), RANKS), RANKS).count() == 0
    scored = quality.score(odd, np.zeros((1 << quality.BITS) + 1))
    assert [r["score"] for r in scored.collect()] == [0.5] * 3 and quality.score(odd.limit(0), np.zeros((1 << quality.BITS) + 1)).count() == 0
    assert imatch.lexicon_of(odd.limit(0)).sum() == 0
    assert {r["fingerprint"][:4] for r in imatch.add_fingerprint(odd, imatch.lexicon_of(odd)).collect()} == {"3:0:", "text"}
    packed = packing.pack_documents(odd.withColumn("length", F.lit("mine")), JSON).collect()
    assert len(packed) == 3 and {r["sequence_id"] for r in packed} == {0}
    pages = spark.createDataFrame([(None, None, None, "mine", "mine"), (1, "http://a.org/" + "x" * 50_000, "<a href=//b.net>" * 5000, "mine", "mine")], "page_id bigint, url string, html string, host string, trust string")
    assert sorted((r["host"], r["verdict"]) for r in url_filter.judge(pages).collect()) == [("", "allow"), ("a.org", "allow")]
    assert neardup.near_duplicates(odd.withColumn("n_shingles", F.lit("mine"))).count() == 3


def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(45)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda: " ".join(rng.choice(words) for _ in range(40))
    same, twice = text(), text()
    rows = [(i, text()) for i in range(30)] + [(40, None), (41, ""), (42, ""), (50, same), (51, same), (None, same), (None, text()), (60, twice), (60, twice), (61, "a " * 30_000), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_key", F.lit("mine"))
    kept = P.drop_near_copies(spark, docs, str(tmp_path)).collect()
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in kept), key=repr)
    wanted = sorted(((i is None, i or 0, t) for i, t in dict.fromkeys(rows) if not (t == same and i != 50)), key=repr)
    assert found == wanted
    redacted = P.redact_secrets(spark, docs, str(tmp_path))
    assert redacted.columns == list(P.COLUMNS) and redacted.count() == len(rows)
    for make in (lambda d: d, lambda d: d.limit(0)):
        folder = f"{tmp_path}/{zlib.crc32(repr(make).encode())}"
        make(docs.drop("_key")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        out = P.run(spark, folder)
        assert "sequence_id" in out.columns and (out.count() > 0) == (make(docs).count() > 0)
