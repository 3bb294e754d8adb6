"""Known spans against Python's re, the battery on random and on plain tokens, and redaction."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from cantorium.llm import secrets

TEXTS = [
    None, "", "password = 'abc12' secret=token: abcdefgh", "API_KEY:\"x.y-z/+=\" passwd=short", "é password=ééabcdef token  =  \"0123456789\" 中 Secret:abcdef",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "x XAKIAAKIA" + "C" * 12, "f" * 23 + " " + "0a" * 12 + "g" + "d" * 60, "token=" + "ab" * 40, "apikey=" + "q" * 30000, "key " * 20000,
]


def expected(text):
    text, out = text or "", []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    pool = ["password", "SECRET", "token", "api_key", "=", ":", " ", "'", '"', "AKIA", "AB12", "0123456789abcdef", "deadbeef", "é", "中", ".", "x"]
    texts = TEXTS + ["".join(rng.choices(pool, k=rng.randint(1, 25))) for _ in range(300)]
    rows = [(i, t, "b", "t") for i, t in enumerate(texts)] + [(3, TEXTS[3], "b", "t"), (None, TEXTS[7], "b", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, tokens string").repartition(4)


def test_base_spans(spark, docs):
    want = {(r.doc_id, r.text): expected(r.text) for r in docs.collect()}
    got = docs.select("doc_id", "text", secrets.joined(secrets.base_spans(F.coalesce("text", F.lit("")))).alias("found")).collect()
    assert len(got) == docs.count() and all(r.found == want[(r.doc_id, r.text)] for r in got)


def test_scan_adds_to_base(spark, docs):
    rows = secrets.scan(docs).select("doc_id", "base", "spans").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert set(r.base) <= set(r.spans) and all(x.kind == "random" for x in set(r.spans) - set(r.base))
    assert secrets.scan(docs.limit(0)).collect() == []


def test_random_keys_are_found_and_words_are_not(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(60)]
    words = [f"{a}{n}{b}" for n in range(1950, 2010) for a, b in [("internationalconference", "proceedingsvolume")]]
    texts = [(i, f"see {k} end") for i, k in enumerate(keys)] + [(100 + i, f"see {w} end") for i, w in enumerate(words)]
    rows = secrets.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    hit = {r.doc_id for r in rows if r.spans}
    assert sum(i in hit for i in range(60)) >= 54 and not any(i in hit for i in range(100, 160))
    assert all(r.spans[0].start == 4 and r.spans[0].end == 44 for r in rows if r.doc_id in hit)


def plain_battery(token):
    """The tests by their definitions, with the exact error function."""
    body = token.rstrip("=")
    name, alphabet = next((n, a) for n, a in secrets.ENCODINGS if set(body) <= set(a))
    n, k = len(body), len(alphabet)
    two_sided = lambda z: math.erfc(abs(z) / 2**0.5)
    groups = secrets.GROUPS[name]
    chi = sum((sum(c in g for c in body) - n * len(g) / k) ** 2 / (n * len(g) / k) for g in groups)
    tail = math.exp(-chi / 2) if len(groups) == 3 else math.erfc((chi / 2) ** 0.5) + (2 * chi / math.pi) ** 0.5 * math.exp(-chi / 2)
    values = [alphabet.index(c) for c in body]
    middle = (k - 1) / 2
    sides = [v > middle for v in values]
    high = sum(sides)
    mean = 2 * high * (n - high) / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    runs = 1 + sum(a != b for a, b in zip(sides, sides[1:]))
    lagged = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:]))
    tests = [tail, two_sided((runs - mean) / spread**0.5) if spread > 0 else two_sided(n**0.5), two_sided(lagged / ((n - 1) * (k * k - 1) / 12) * (n - 1) ** 0.5)]
    if n >= 2 * k:
        squares = sum(body.count(c) ** 2 for c in set(body))
        cube = ((squares * k / n - n) / (k - 1)) ** (1 / 3)
        tests.append(two_sided((cube - (1 - 2 / 9 / (k - 1))) / (2 / 9 / (k - 1)) ** 0.5))
    return min(len(tests) * min(tests), 1)


def test_battery_against_its_definitions(spark):
    rng = random.Random(12)
    tokens = ["".join(rng.choices(rng.choice([a for _, a in secrets.ENCODINGS] + ["ab1", "Zz9", "0", "etaoin"]), k=rng.choice([20, 21, 31, 40, 64, 130, 300]))) for _ in range(300)]
    tokens += [t + "==" for t in tokens[:20]]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secrets.battery(F.col("t"), secrets.encoding_of(F.col("t"))).alias("p")).collect()
    for r in rows:
        want = plain_battery(r.t)
        assert r.p == pytest.approx(want, rel=1e-4, abs=2e-6), r.t


def test_simulated_tokens_calibrate_the_battery(spark):
    counts = secrets.simulated(spark)
    assert len(counts) == 4 * len(secrets.ENCODINGS) and all(sum(c.values()) == secrets.SIMULATED for c in counts.values())
    assert all(sum(n for b, n in c.items() if b >= 20) < 0.03 * secrets.SIMULATED for c in counts.values())  # p below 0.01


def test_limits():
    null = {0: {b: n for b, n in zip(range(10), (1000, 400, 250, 150, 80, 60, 30, 20, 6, 4))}}
    assert secrets.thresholds({0: {0: 1}}, null) == {0: 8}  # the first bin with 99% below
    assert secrets.thresholds({0: null[0]}, null) == {0: 8}
    assert secrets.thresholds({0: {0: 100, 7: 5000, 300: 9000}}, null) == {0: 7}
    assert secrets.thresholds({0: {b: 5000 for b in range(300)}}, null)[0] < 8


def test_keys_among_many_identifiers(spark):
    rng = random.Random(13)
    names = ["John", "Mary", "Customer", "Order", "Billing", "Supplier", "Region", "Archive", "Session", "Payment"]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=20 if i < 100 else rng.randint(21, 44))) for i in range(300)]
    plain = [f"get{rng.choice(names)}Account{rng.randint(1, 9999)}Details{rng.randint(1, 999)}" for _ in range(600)]
    texts = [(i, f"see {x} end") for i, x in enumerate(keys + plain)]
    hit = {r.doc_id for r in secrets.scan(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect() if r.spans}
    assert sum(i in hit for i in range(100)) >= 95 and sum(i in hit for i in range(300)) >= 285
    assert sum(i in hit for i in range(300, 900)) < 60


def test_many_matches_in_one_text(spark):
    text = "".join(f"token=abcdef{i} " for i in range(3000))
    found = spark.createDataFrame([(text,)], "t string").select(secrets.joined(secrets.base_spans(F.col("t"))).alias("s")).first().s
    assert found == expected(text)


def test_random_keys_after_a_name_are_found(spark):
    rng = random.Random(8)
    forms = ["AWS_KEY={}", "auth={}", "https://a.example/f?sig={}&x=1", "A_NAME_OF_MORE_THAN_TWENTY_LETTERS={}", "sig={}==", "export K='{}'"]
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=40)) for _ in range(60)]
    texts = [forms[i % len(forms)].format(k) for i, k in enumerate(keys)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(x.start, x.end) for x in r.spans] for r in secrets.scan(docs).collect()}
    at = [(t.index(k), t.index(k) + 40 + 2 * t.endswith("==")) for t, k in zip(texts, keys)]
    assert sum(at[i] in found[i] for i in found) >= 54
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert all(keys[i] not in clean[i] and clean[i].startswith(texts[i][: at[i][0]]) for i in found if at[i] in found[i])


def test_redact(spark):
    text = 'a password=abcdef12 b "AKIA' + "Z9" * 10 + '" c'
    docs = spark.createDataFrame([(1, text, len(text), "z"), (2, "clean", 5, "z"), (3, None, None, "z")], "doc_id long, text string, n_chars long, at string")
    rows = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert rows[1].text == 'a [SECRET] b "[SECRET]" c' and rows[1].n_chars == len(rows[1].text)
    assert (rows[2].text, rows[2].n_chars) == ("clean", 5) and rows[3].text is None and rows[1].__fields__ == docs.columns
    odd = [(None, text, "x"), (4, text, "x"), (4, text, "x"), (5, "", None), (6, "token=abcdefg " * 2000, "y")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, tokens string").repartition(3)
    got = secrets.redact(docs).collect()
    assert sorted(r.text for r in got) == sorted(['a [SECRET] b "[SECRET]" c'] * 3 + ["", "[SECRET] " * 2000])
    assert secrets.redact(docs.limit(0)).collect() == [] and got[0].__fields__ == docs.columns
