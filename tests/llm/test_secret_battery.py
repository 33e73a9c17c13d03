"""The randomness battery against a plain version, on words, on long runs and on odd tables."""

import math
import random
import re
import time
from collections import Counter

import pytest

from tidegauge.llm import secret_scan as S

B62 = S.UPPER + S.LOWER + S.DIGITS
WORDS = "the quick brown fox jumps over lazy dogs get user account information from database pool connection manager factory service path module config index component render update create delete list item value error handler request response client server main source org example project file reader writer stream buffer".split()
ORDINARY = [
    "the/quick/brown/fox/jumps/over/lazy/dogs", "getUserAccountInformationFromDatabasePool", "x_" * 30, "q" * 60, "aaaa-bbbb-cccc-dddd-eeee-ffff-gggg", "AbstractSingletonProxyFactoryBeanDefinition",
    "src/main/java/org/example/project/module/FileReader", "docs/guides/getting-started/installation", "get_user_account_information_from_pool", "thshoutionthineshe", "MAX_CONNECTION_POOL_SIZE", "----------------------",
    "/index/html/page/view/2024/01/article", "node_modules/react-dom/client/index", "thesresterenhely-undschieheitheit", "XMLHttpRequestUpload", "1234567890123456",
]


def normal(z):
    z = max(min(z, 8), -8)
    return 1 / (1 + math.exp(-(1.5976 * z + 0.07056 * z**3)))


def p_value(run):
    alphabet = next(a for p, a in S.ENCODINGS if re.search(p, run))
    body = run.rstrip("=")
    n, size = len(body), len(alphabet)
    if n < 3:
        return 1.0
    x = [alphabet.find(c) + 1 for c in body]
    kind = [next((i for i, k in enumerate(S.CLASSES) if c in k), 9) for c in body]
    shares = [sum(c in k for c in alphabet) / size for k in S.CLASSES]
    uneven = sum((kind.count(i) - n * s) ** 2 / (n * s) for i, s in enumerate(shares) if s)
    counts = Counter(c for c in body if c in alphabet)
    free, away = size - 1, n * max(0.5, 0.06 * size - 1)
    z = (size / n * sum(c * c for c in counts.values()) - n - free - away) / math.sqrt(2 * (free + 2 * away))
    changing = 1 - sum(s * s for s in shares)
    if changing > 1e-9:
        usual = S.WORD_CHANGES * changing
        changes = sum(a != b for a, b in zip(kind, kind[1:], strict=False))
        z = (z + (usual - changes / (n - 1)) * math.sqrt((n - 1) / (usual * (1 - usual)))) / math.sqrt(2)
    above = sum(2 * v > size for v in x)
    below = n - above
    runs = 1 + sum((2 * a > size) != (2 * b > size) for a, b in zip(x, x[1:], strict=False))
    expected = 1 + 2 * above * below / n
    spread = math.sqrt(max(2 * above * below * (2 * above * below - n) / (n * n * (n - 1)), 1e-9))
    p_halves = 1.0 if not above or not below else normal((abs(runs - expected) - 0.5 * expected) / spread)
    mean = sum(x) / n
    total = sum((v - mean) ** 2 for v in x)
    p_serial = 1.0 if total == 0 else normal((abs(sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / max(total, 1e-9)) - 0.5) * math.sqrt(n))
    return 1.0 if p_halves > 0.5 or p_serial > 0.5 or uneven > S.CLASS_LIMITS[sum(s > 0 for s in shares) - 1] else normal(z)


def plain_spans(text):
    """All spans of a text as (start, kind_no, end)."""
    found = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(S.BASE) for m in re.finditer(p, text) if len(m[2]) >= least]
    runs = [m.span() for m in re.finditer(S.LONG_RUN, text)]
    runs = [(a, b) for a, b in runs if not any(x <= a and y >= b for x, _, y in found)]
    tested = [(p, a, b) for a, b in runs if (p := p_value(text[a:b])) <= S.DISCARD]
    if tested:
        mean = sum(b - a for _, a, b in tested) / len(tested)
        weighted = sorted((p / S.DISCARD * mean / (b - a), a, b) for p, a, b in tested)
        limit = max([q for i, (q, _, _) in enumerate(weighted) if q <= (i + 1) * S.FALSE_DISCOVERIES / len(weighted)], default=-1)
        found += [(a, 3, b) for q, a, b in weighted if q <= limit]
    return sorted(found)


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [[tuple(s) for s in r["spans"]] for r in S.scan(df).orderBy("doc_id").collect()]


def draw(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_spans_equal_a_plain_version(spark):
    rng = random.Random(21)
    alphabets = [a for _, a in S.ENCODINGS]
    parts = [lambda: draw(rng, rng.choice(alphabets), rng.randint(10, 70)), lambda: rng.choice(ORDINARY), lambda: "_".join(rng.sample(WORDS, 4)), lambda: "token=" + draw(rng, B62, 20), lambda: draw(rng, B62, 22) + "==", lambda: "é 漢字 ="]
    texts = [" ".join(rng.choice(parts)() for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", " ", "=" * 40, "ab" + "=" * 30]
    assert scanned(spark, texts) == [plain_spans(t) for t in texts]


def test_words_stay_and_random_runs_are_found(spark):
    rng = random.Random(22)
    made = []
    for _ in range(400):
        w = rng.sample(WORDS, rng.randint(3, 6))
        made += ["/".join(w), "_".join(w), "-".join(w), w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper()]
    assert [t for t, s in zip(ORDINARY, scanned(spark, ORDINARY), strict=True) if s] == []
    assert sum(bool(s) for s in scanned(spark, made)) <= 0.005 * len(made)
    for length, least in ((16, 0.6), (24, 0.85), (32, 0.9), (40, 0.95)):
        assert sum(bool(s) for s in scanned(spark, [draw(rng, B62, length) for _ in range(200)])) >= least * 200


@pytest.mark.parametrize("text", [lambda r: draw(r, B62, 100_000), lambda r: " ".join(draw(r, B62, 32) for _ in range(3000)), lambda r: "z" * 300_000])
def test_long_texts_take_linear_time(spark, text):
    rng = random.Random(23)
    scanned(spark, ["warm " + draw(rng, B62, 40)])
    long = text(rng)
    began = time.time()
    (spans,) = scanned(spark, [long])
    assert time.time() - began < 60  # minutes, if any step were quadratic
    assert bool(spans) == (long[:2] != "zz")


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None, "mine", 1), (1, "token=abcdefgh1", "mine", 1), (1, "token=abcdefgh1", "mine", 1)], "doc_id bigint, text string, _base string, spans int")
    rows = S.scan(df).orderBy("doc_id").collect()
    assert [len(r["spans"]) for r in rows] == [0, 1, 1] and {r["_base"] for r in rows} == {"mine"}
    assert S.scan(df.limit(0)).count() == 0
    assert [r["text"] for r in S.redact(df).orderBy("doc_id").collect()] == [None, "[SECRET]", "[SECRET]"]
