"""Secrets in texts: known patterns, and long tokens that a battery of randomness tests cannot tell from random ones.

Known patterns give spans of the kinds assign, access and hex. Every further token of 20 or more characters gets an
encoding inferred from its characters. The battery asks whether a token could be symbols drawn uniformly and independently
from its encoding's alphabet: chi-squared uniformity of groups of symbols (digits, letters that are frequent in texts,
other letters, capitals; so that short tokens have no tiny expected counts) and, for long tokens, of single symbols; runs
below and above the alphabet's middle; lag-one serial correlation. The smallest p-value times the number of tests is the
token's score; what it means is read off random tokens of the same encoding and length class, which are simulated.

What is reported is controlled by encoding and length class. A token is reported if its p-value is at least a limit.
The number of random tokens is estimated from those with p-values above the median of random ones, where other tokens are
rare; what a limit reports beyond the random tokens expected there is false. The limit is the lowest, not below LOST,
at which the false share is at most the false discovery rate (give or take two standard errors, so that a class with a few
tokens keeps them). So at most a share LOST of random keys is lost where there is nothing to mistake for them. Where words
look random to all tests in such numbers that they fill the upper half as well, they are taken for keys.

Positions come from splitting the text by a pattern and summing the lengths of pieces and matches, in code points.
Everything is a column expression over one text; only counts of scores by class and bin are aggregated.

Defined results: null text is empty and has no spans; null doc_ids and repeated rows are scanned like others; an empty
table gives no rows; further columns of any name are ignored by scan() and kept by redact().
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantorium.llm.rows import free
from cantorium.session import materialize

# The patterns, with the group that must be long enough and its least length.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
RANDOM = "random"
#: '=' is padding at a token's end only, so a name and its value are two tokens.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Encodings from the narrowest: name, alphabet in order.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: Letters that are frequent in texts of many languages; the groups of symbols that the chi-squared test counts.
_FREQUENT = "aeinorst"
_COMMON, _RARE = _FREQUENT, "".join(c for c in _LOWER if c not in _FREQUENT)
GROUPS = {
    "hex": ("01234", "56789", "abc", "def"),
    "HEX": ("01234", "56789", "ABC", "DEF"),
    "base36": (_DIGITS, _COMMON, _RARE),
    "BASE36": (_DIGITS, _COMMON.upper(), _RARE.upper()),
    "base62": (_DIGITS, _COMMON, _RARE, _UPPER),
    "base64": (_DIGITS + "+/-_", _COMMON, _RARE, _UPPER),
}
_GROUP_MARKS = "ABCD"
FALSE_DISCOVERY_RATE = 0.05
#: At most this share of random tokens is below the limit of p-values.
LOST = 0.01
#: Tokens of 20-31, 32-63, 64-127 characters and longer ones are classes of their own.
LENGTH_CLASSES = (32, 64, 128)
LEAST_LENGTH = 20
#: Scores are counted in bins of this width of -log10, up to this many.
BIN, BINS = 0.1, 300
#: Random tokens simulated for each encoding and length class.
SIMULATED = 2000
#: Matches of a text that are summed in one go.
_CHUNK = 256
_SPAN = "array<struct<start:long,rank:int,end:long,kind:string>>"


def _found(text: Column, pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group has the least length, by start.

    Lengths are summed by chunks of matches, then inside each chunk, so a text of many matches costs little more than its length.
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    matched = F.slice(pieces, F.lit(1), F.size(whole))
    sizes = F.zip_with(matched, F.arrays_zip(whole.alias("whole"), part.alias("part")), lambda piece, x: F.struct(
        F.length(piece).cast("long").alias("skip"), F.length(x["whole"]).cast("long").alias("size"), (F.length(x["part"]) >= least).alias("kept"),
    ))
    nothing = F.array().cast(_SPAN)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["skip"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        kept = F.when(x["kept"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.cast(_SPAN).alias("spans"))

    def spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.cast("long").alias("at"), nothing.alias("spans")), step, lambda state: state["spans"])

    def chunked(all_sizes: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(all_sizes) - 1) / _CHUNK).cast("int"))
        chunks = F.transform(places, lambda i: F.slice(all_sizes, i * _CHUNK + 1, F.lit(_CHUNK)))
        return F.element_at(F.transform(F.array(chunks), joined_chunks), 1)

    def joined_chunks(chunks: Column) -> Column:
        lengths = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["skip"] + x["size"]))
        starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), spans))

    # one element, so that the text is matched once and not for every chunk
    long = F.element_at(F.transform(F.array(sizes), chunked), 1)
    return F.when(text.rlike(pattern), long).otherwise(nothing)


def base_spans(text: Column) -> Column:
    """Spans of the known kinds by start, then kind as listed."""
    found = [_found(text, *spec, rank, kind) for rank, (kind, spec) in enumerate(KINDS.items())]
    return F.array_sort(F.concat(*found))


def _erfc(x: Column) -> Column:
    """Of x >= 0 (rational approximation, error below 1.5e-7)."""
    t = 1.0 / (1.0 + 0.3275911 * x)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return tail * F.exp(-x * x)


def _two_sided(z: Column) -> Column:
    """p of a standard normal beyond |z| either way."""
    return _erfc(F.abs(z) / F.lit(2**0.5))


def encoding_of(token: Column) -> Column:
    """Number of the narrowest encoding that a token's characters fit; null if there is none."""
    body, number = F.rtrim(token, F.lit("=")), None
    for k, (_, alphabet) in enumerate(ENCODINGS):
        fits = F.translate(body, alphabet, "") == ""
        number = F.when(fits, k) if number is None else number.when(fits, k)
    return number


def _by_encoding(encoding: Column, values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), encoding + 1)


def _marked(alphabet: str, groups: tuple[str, ...]) -> str:
    """The mark of each symbol's group."""
    return "".join(_GROUP_MARKS[next(i for i, g in enumerate(groups) if c in g)] for c in alphabet)


def _coded(token: Column, encoding: Column, marks: list[str]) -> Column:
    """A token with each symbol replaced by its mark in its encoding."""
    found = None
    for k, (_, alphabet) in enumerate(ENCODINGS):
        here = F.translate(token, alphabet, marks[k])
        found = F.when(encoding == k, here) if found is None else found.when(encoding == k, here)
    return found


def battery(token: Column, encoding: Column) -> Column:
    """The least p-value of the battery times the number of its tests, at most 1, by approximations for random symbols."""
    groups = [GROUPS[name] for name, _ in ENCODINGS]
    marked = [_marked(a, g) for (_, a), g in zip(ENCODINGS, groups)]
    halves = ["".join("1" if 2 * i >= len(a) else "0" for i in range(len(a))) for _, a in ENCODINGS]
    alphabet, k = _by_encoding(encoding, [a for _, a in ENCODINGS]), _by_encoding(encoding, [float(len(a)) for _, a in ENCODINGS])
    shares = [_by_encoding(encoding, [len(g[i]) / len(a) if i < len(g) else 0.0 for (_, a), g in zip(ENCODINGS, groups)]) for i in range(len(_GROUP_MARKS))]
    body = F.rtrim(token, F.lit("="))
    # an array of one element at each stage, so that nothing is computed twice
    first = F.array(F.struct(
        body.alias("body"), F.length(body).cast("double").alias("n"), k.alias("k"), alphabet.alias("alphabet"),
        _coded(body, encoding, marked).alias("groups"), _coded(body, encoding, halves).alias("halves"), F.array(*shares).alias("shares"),
        _by_encoding(encoding, [len(g) - 1 for g in groups]).alias("freedom"),
    ))

    def counted(x: Column) -> Column:
        n, k = x["n"], x["k"]
        symbols = F.transform(F.split(x["body"], r"(?!^|\z)"), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        count = lambda text, mark: (n - F.length(F.replace(text, F.lit(mark), F.lit("")))).cast("double")
        cells = [F.when(x["shares"][i] > 0, F.pow(count(x["groups"], mark) - n * x["shares"][i], F.lit(2.0)) / (n * x["shares"][i])).otherwise(0.0) for i, mark in enumerate(_GROUP_MARKS)]
        high = count(x["halves"], "1")
        turns = F.regexp_count(x["halves"], F.lit("01")) + F.regexp_count(x["halves"], F.lit("10"))
        return F.struct(n.alias("n"), k.alias("k"), x["freedom"].alias("freedom"), reduce(lambda a, b: a + b, cells).alias("chi"), high.alias("high"), (turns + 1).cast("double").alias("runs"), symbols.alias("s"))

    def summed(x: Column) -> Column:
        s, middle = x["s"], (x["k"] - 1) / 2
        before, after = F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s) - 1)
        lagged = F.aggregate(F.zip_with(before, after, lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda a, d: a + d)
        single = F.when(x["n"] >= 2 * x["k"], F.aggregate(F.array_distinct(s), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(s, lambda d: d == c)).cast("double"), F.lit(2.0))))
        return F.struct(*[x[c].alias(c) for c in ("n", "k", "freedom", "chi", "high", "runs")], lagged.alias("lagged"), single.alias("squares"))

    def combined(x: Column) -> Column:
        n, k, high, low, half = x["n"], x["k"], x["high"], x["n"] - x["high"], x["chi"] / 2
        p_groups = F.when(x["freedom"] == 2, F.exp(-half)).otherwise(_erfc(F.sqrt(half)) + F.sqrt(half * (4 / 3.141592653589793)) * F.exp(-half))
        freedom = k - 1
        cube = F.pow((x["squares"] * k / n - n) / freedom, F.lit(1 / 3))  # Wilson-Hilferty
        p_single = F.coalesce(_two_sided((cube - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))), F.lit(1.0))
        mean = 2 * high * low / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z_runs = F.when(spread > 0, (x["runs"] - mean) / F.sqrt(spread)).otherwise(F.sqrt(n))
        z_serial = x["lagged"] / ((n - 1) * (k * k - 1) / 12) * F.sqrt(n - 1)
        tests = F.when(x["squares"].isNull(), 3.0).otherwise(4.0)
        return F.least(tests * F.least(p_groups, p_single, _two_sided(z_runs), _two_sided(z_serial)), F.lit(1.0))

    return F.element_at(F.transform(F.transform(F.transform(first, counted), summed), combined), 1)


_TOKENS = "array<struct<start:long,end:long,stratum:int,bin:int>>"


def stratum_of(token: Column, encoding: Column) -> Column:
    """Number of a token's encoding and length class."""
    size = F.length(F.rtrim(token, F.lit("=")))
    length_class = sum((F.when(size >= limit, 1).otherwise(0) for limit in LENGTH_CLASSES), F.lit(0))
    return (encoding * (len(LENGTH_CLASSES) + 1) + length_class).cast("int")


def bin_of(score: Column) -> Column:
    return F.greatest(F.floor(F.least(-F.log10(score + 1e-300) / BIN, F.lit(float(BINS)))).cast("int"), F.lit(0))


def random_tokens(text: Column) -> Column:
    """Tokens of LEAST_LENGTH or more characters: start, end, stratum and bin of the battery's score."""
    spans = _found(text, TOKEN, 0, LEAST_LENGTH, len(KINDS), RANDOM)

    def tested(x: Column) -> Column:
        token = F.substring(text, x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), token.alias("token"), encoding_of(token).alias("encoding"))

    def scored(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), stratum_of(x["token"], x["encoding"]).alias("stratum"), bin_of(battery(x["token"], x["encoding"])).alias("bin"))

    return F.transform(F.filter(F.transform(spans, tested), lambda x: x["encoding"].isNotNull()), scored).cast(_TOKENS)


Counts = dict[int, dict[int, int]]
_simulated: dict[tuple, Counts] = {}


def _collected(tokens: DataFrame) -> Counts:
    """Counts by stratum and bin (at most strata x bins rows)."""
    counts: Counts = {}
    for stratum, place, n in tokens.groupBy("stratum", "bin").count().collect():
        counts.setdefault(stratum, {})[place] = n
    return counts


def simulated(spark: SparkSession, each: int = SIMULATED) -> Counts:
    """Bins of random tokens of each encoding and length class; their symbols are hashes of their numbers, so they are the same every time."""
    if (each,) not in _simulated:
        classes = len(LENGTH_CLASSES) + 1
        stratum = (F.col("id") % (len(ENCODINGS) * classes)).cast("int")
        encoding, length_class = F.floor(F.col("stratum") / classes).cast("int"), F.col("stratum") % classes
        least = F.element_at(F.array(*[F.lit(n) for n in (LEAST_LENGTH, *LENGTH_CLASSES)]), length_class + 1)
        above = F.element_at(F.array(*[F.lit(n) for n in (*LENGTH_CLASSES, 2 * LENGTH_CLASSES[-1])]), length_class + 1)
        drawn = spark.range(0, each * len(ENCODINGS) * classes, 1, 8).withColumn("stratum", stratum)
        drawn = drawn.withColumns({"encoding": encoding, "n": least + F.pmod(F.floor(F.col("id") / (len(ENCODINGS) * classes)), above - least).cast("int")})
        drawn = drawn.withColumn("alphabet", _by_encoding(F.col("encoding"), [a for _, a in ENCODINGS]))
        symbol = lambda i: F.substring(F.col("alphabet"), 1 + F.pmod(F.xxhash64("id", i), F.length("alphabet")).cast("int"), F.lit(1))
        token = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), symbol), "")
        scored = drawn.select("stratum", "encoding", token.alias("token")).select("stratum", bin_of(battery(F.col("token"), F.col("encoding"))).alias("bin"))
        _simulated[(each,)] = _collected(scored)
    return _simulated[(each,)]


def thresholds(found: Counts, null: Counts, rate: float = FALSE_DISCOVERY_RATE, lost: float = LOST) -> dict[int, int]:
    """For each stratum the least bin that is not reported, from the bins of its tokens and of random ones."""
    limits = {}
    for stratum, own in found.items():
        random, total = null[stratum], sum(null[stratum].values())
        below = lambda counts, b: sum(n for place, n in counts.items() if place < b)
        share = [below(random, b) / total for b in range(BINS + 2)]
        top, half = (next(b for b, q in enumerate(share) if q >= least) for least in (1 - lost, 0.5))
        keys = below(own, half) / share[half]
        for b in range(top, half - 1, -1):
            reported = below(own, b)
            if reported - keys * share[b] <= rate * reported + 2 * (reported + 1) ** 0.5:
                break
        limits[stratum] = b
    return limits


def all_spans(base: Column, tokens: Column, limits: dict[int, int]) -> Column:
    """Base spans and the tokens that are not rejected as non-random, by start, then kind as listed."""
    known = F.create_map(*[F.lit(v) for pair in sorted(limits.items()) for v in pair]) if limits else None
    below = lambda x: F.lit(BINS + 1) if known is None else F.coalesce(F.try_element_at(known, x["stratum"]), F.lit(BINS + 1))
    apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    kept = F.filter(tokens, lambda x: (x["bin"] < below(x)) & apart(x))
    added = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"), F.lit(RANDOM).alias("kind")))
    return F.array_sort(F.concat(base, added.cast(_SPAN)))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """A row for each document: doc_id, base (spans of known kinds), spans (all)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), random_tokens(F.col("text")).alias("tokens"))
    found = materialize(found, "secret-spans")
    counts = _collected(found.select(F.explode("tokens").alias("t")).select("t.stratum", "t.bin"))
    limits = thresholds(counts, simulated(docs.sparkSession), rate)
    return found.select("doc_id", "base", all_spans(F.col("base"), F.col("tokens"), limits).alias("spans"))


def redact(docs: DataFrame, rate: float = FALSE_DISCOVERY_RATE, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with every span of their text replaced by a mark, and n_chars set anew where it is a column.

    Texts are scanned once, into a table of rows with their spans.
    """
    base, tokens, spans = free(docs, "base", "tokens", "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(docs.withColumns({base: base_spans(text), tokens: random_tokens(text)}), "secret-rows")
    counts = _collected(rows.select(F.explode(tokens).alias("t")).select("t.stratum", "t.bin"))
    rows = rows.withColumn(spans, all_spans(F.col(base), F.col(tokens), thresholds(counts, simulated(docs.sparkSession), rate)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        piece = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (x["start"] - state["at"]).cast("int"))
        out = F.when(x["start"] >= state["at"], F.concat(state["out"], F.array(piece, F.lit(mark)))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), out.alias("out"))

    def rest(state: Column) -> Column:
        return F.concat(F.array_join(state["out"], ""), F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text")))

    hit = F.col("text").isNotNull() & (F.size(spans) > 0)
    clean = rows.withColumn("text", F.when(hit, F.aggregate(F.col(spans), start, step, rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull() & (F.size(spans) > 0), length).otherwise(F.col("n_chars")))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])
