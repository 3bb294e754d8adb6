"""Sequence similarity of texts, which needs Python: Arrow UDFs around difflib, and greedy set matching on top of it."""

from __future__ import annotations

import difflib
import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: Texts of fewer characters together are left to difflib; matches of a part of two texts that are walked one by one.
SHORT, FEW = 64, 48


@lru_cache(64)
def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


@lru_cache(64)
def _index(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the characters that difflib indexes (in texts of 200 and more not the popular ones) by code: how many, where they begin among the places, and the places."""
    codes = _codes(text)
    counts = np.bincount(codes)
    if len(text) >= 200:
        counts[counts > len(text) // 100 + 1] = 0
    places = np.flatnonzero(counts[codes])
    return counts, np.cumsum(counts) - counts, places[np.argsort(codes[places], kind="stable")]


def _matches(a: str, b: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places (i, j) of equal indexed characters in order, and how many such places in a row on the diagonal end there."""
    counts, begin, places = _index(b)
    codes = _codes(a)
    known = codes if int(codes.max()) < len(counts) else np.where(codes < len(counts), codes, 0)
    at = np.flatnonzero((counts[known] > 0) & (known == codes))
    if not len(at):
        return None
    own = codes[at]
    many = counts[own]
    i = np.repeat(at, many)
    j = places[np.arange(len(i)) + np.repeat(begin[own] - (np.cumsum(many) - many), many)]
    place = ((j - i) << 32) + i  # by diagonal, then along it
    order = np.argsort(place)
    place = place[order]
    new = np.ones(len(i), bool)
    new[1:] = place[1:] != place[:-1] + 1
    step = np.arange(len(i))
    run = np.empty(len(i), np.int64)
    run[order] = step - np.maximum.accumulate(np.where(new, step, 0)) + 1
    return i, j, run


def _some(matches: tuple, kept: np.ndarray) -> tuple | list | None:
    n = np.count_nonzero(kept)
    if not n:
        return None
    some = tuple(x[kept] for x in matches)
    return some if n > FEW else list(zip(*(x.tolist() for x in some)))


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp 2M/T. Not symmetric, so callers fix an order; the junk heuristic stays on.

    The same number as difflib.SequenceMatcher(None, a, b).ratio(): its longest blocks are found among the matches of indexed
    characters, which are collected once and handed down, instead of going over both texts for each block.
    """
    a, b = a or "", b or ""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) + len(b) <= SHORT:
        return difflib.SequenceMatcher(None, a, b).ratio()
    todo: list = [(0, len(a), 0, len(b), _matches(a, b))]
    total = 0
    while todo:
        a_from, a_to, b_from, b_to, matches = todo.pop()
        i, j, size = a_from, b_from, 0
        if type(matches) is list:
            for x, y, run in matches:
                if run > size:
                    run = min(run, x - a_from + 1, y - b_from + 1)
                    if run > size:
                        i, j, size = x - run + 1, y - run + 1, run
        elif matches is not None:
            xs, ys, runs = matches
            runs = np.minimum(runs, np.minimum(xs - (a_from - 1), ys - (b_from - 1)))
            at = int(runs.argmax())
            size = int(runs[at])
            i, j = int(xs[at]) - size + 1, int(ys[at]) - size + 1
        while i > a_from and j > b_from and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < a_to and j + size < b_to and a[i + size] == b[j + size]:
            size += 1
        if not size:
            continue
        total += size
        before = after = None
        if type(matches) is list:
            before, after = [m for m in matches if m[0] < i and m[1] < j] or None, [m for m in matches if m[0] >= i + size and m[1] >= j + size] or None
        elif matches is not None:
            before, after = _some(matches, (xs < i) & (ys < j)), _some(matches, (xs >= i + size) & (ys >= j + size))
        if a_from < i and b_from < j:
            todo.append((a_from, i, b_from, j, before))
        if i + size < a_to and j + size < b_to:
            todo.append((i + size, a_to, j + size, b_to, after))
    return 2.0 * total / (len(a) + len(b))


@lru_cache(1 << 18)
def token_overlap(a: str, b: str) -> float:
    """F8: 1 for equal tokens, 0.85 if one holds the other, else the better of character Jaccard and sequence ratio."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.85
    left, right = set(a), set(b)
    return max(len(left & right) / len(left | right), ratio(a, b))


def _sets(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token its length, its number of different characters, and these as bits (characters 64 apart share one)."""
    bits = [0] * len(tokens)
    for i, token in enumerate(tokens):
        for c in token:
            bits[i] |= 1 << (ord(c) & 63)
    return np.array([len(t) for t in tokens]), np.array([len(set(t)) for t in tokens]), np.array(bits, np.uint64)


def _able(left: list[str], right: list[str], least: float) -> np.ndarray:
    """Which pairs of tokens may overlap by so much: characters that only one of them has bound both measures from above."""
    (na, sa, a), (nb, sb, b) = _sets(left), _sets(right)
    only_a, only_b = (np.bitwise_count(x).astype(np.int64) for x in (a[:, None] & ~b[None], b[None] & ~a[:, None]))
    same = np.minimum(na[:, None] - only_a, nb[None] - only_b)
    common = np.minimum(sa[:, None] - only_a, sb[None] - only_b)
    close = (2 * same >= least * (na[:, None] + nb[None])) | (common >= least * (sa[:, None] + sb[None] - common))
    return close | (only_a == 0) | (only_b == 0)  # one may hold the other


def soft_jaccard(a, b, least: float = 0.67) -> float:
    """tokens of a, in order, each take the best token of b that is left, if it is near enough."""
    left, rest = sorted(set(a if a is not None else ())), sorted(set(b if b is not None else ()))
    if not left or not rest:
        return 0.0
    able, free, matched = _able(left, rest, least), np.ones(len(rest), bool), 0
    for i, token in enumerate(left):
        best, at = 0.0, -1
        for j in np.flatnonzero(able[i] & free).tolist():
            score = token_overlap(token, rest[j])
            if score > best:
                best, at = score, j
        if best >= least:
            free[at] = False
            matched += 1
    return matched / (len(left) + len(rest) - matched)


#: Different characters of tokens, times their repeats, that near_tokens() bounds by matrix products.
ALPHABET = 512


def near_tokens(left: list[str], right: list[str], least: float = 0.67) -> dict[str, list[str]]:
    """Of each token of left the tokens of right (sorted) that overlap by so much, best first, ties in order.

    Characters in common, then the longest common subsequence bound the sequence ratio from above, so few pairs are compared.
    """
    letters = {c: i for i, c in enumerate(sorted(set().union(*left, *right)))}
    repeats = max((n for t in (*left, *right) for n in Counter(t).values()), default=1)
    wide = len(letters) * repeats <= ALPHABET
    if wide:
        (many_a, sets_a), (many_b, sets_b) = _letter_counts(left, letters, repeats), _letter_counts(right, letters, repeats)
        masks, spelt = _masks(left, letters), _spelt(right, letters)
        size_a, size_b = np.array([len(t) for t in left], float), np.array([len(t) for t in right], float)
    found, rows = {}, max(1, 1_000_000 // max(1, len(right)))
    for at in range(0, len(left), rows):
        some = slice(at, at + rows)
        if not right:
            i = j = by_ratio = np.zeros(0, np.int64)
        elif wide:
            common = many_a[some] @ many_b.T
            same = sets_a[some] @ sets_b.T
            total = size_a[some, None] + size_b[None]
            jaccard = same / np.maximum(sets_a[some].sum(1)[:, None] + sets_b.sum(1)[None] - same, 1)
            held = common >= np.minimum(size_a[some, None], size_b[None])  # one may hold the other
            i, j = np.nonzero(held | (jaccard >= least - 1e-6) | (2 * common >= least * total - 1e-6))
            most = 2 * _subsequence(masks[at + i], spelt[j], size_a[at + i]) / total[i, j]  # no sequence ratio is more
            shared, held = jaccard[i, j], held[i, j]
            kept = held | (shared >= least - 1e-6) | (most >= least - 1e-9)
            i, j, by_ratio = i[kept], j[kept], (held | (most > shared - 1e-6))[kept]
        else:
            i, j = np.nonzero(_able(left[some], right, least))
            by_ratio = np.ones(len(i), bool)
        scores: dict[str, list] = {token: [] for token in left[some]}
        characters = [set(t) for t in right]
        for x, y, judged in zip(i.tolist(), j.tolist(), by_ratio.tolist()):
            if judged:
                score = token_overlap(left[at + x], right[y])
            else:
                own = set(left[at + x])
                score = len(own & characters[y]) / len(own | characters[y])
            if score >= least:
                scores[left[at + x]].append((-score, y))
        found |= {token: [right[y] for _, y in sorted(scored)] for token, scored in scores.items()}
    return found


def _letter_counts(tokens: list[str], letters: dict[str, int], repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are the characters that two tokens have in common, with and without repeats."""
    counts = np.zeros((len(tokens), len(letters)), np.int32)
    for row, token in enumerate(tokens):
        for c in token:
            counts[row, letters[c]] += 1
    used = [counts >= n for n in range(1, repeats + 1)]
    return np.concatenate(used, axis=1).astype(np.float32), used[0].astype(np.float32)


def _masks(tokens: list[str], letters: dict[str, int]) -> np.ndarray:
    """Of each token and character the places as bits; a last column is empty."""
    bits = np.zeros((len(tokens), len(letters) + 1), np.uint64)
    for row, token in enumerate(tokens):
        for place, c in enumerate(token[:64]):
            bits[row, letters[c]] |= np.uint64(1 << place)
    return bits


def _spelt(tokens: list[str], letters: dict[str, int]) -> np.ndarray:
    codes = np.full((len(tokens), max(map(len, tokens), default=0)), len(letters), np.int32)
    for row, token in enumerate(tokens):
        codes[row, : len(token)] = [letters[c] for c in token]
    return codes


def _subsequence(masks: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs; as many as possible where the first is longer than 64."""
    left, row = np.full(len(masks), np.iinfo(np.uint64).max), np.arange(len(masks))
    for c in range(codes.shape[1]):
        hit = left & masks[row, codes[:, c]]
        left = (left + hit) | (left - hit)
    return np.where(sizes > 64, sizes, np.bitwise_count(~left).astype(float))


def matched_share(left: list[str], rest: set[str], near: dict[str, list[str]]) -> float:
    """soft_jaccard() of sorted tokens and a set, from near_tokens()."""
    if not left or not rest:
        return 0.0
    taken: set[str] = set()
    for token in left:
        for other in near[token]:
            if other in rest and other not in taken:
                taken.add(other)
                break
    return len(taken) / (len(left) + len(rest) - len(taken))


def json_array(response: str | None) -> str | None:
    """the JSON array of a model's answer: whole, an object as an array of one, or the first bracketed part that parses."""
    import re

    if response is None:
        return None
    said = re.sub(r"(?is)<think.*?</think.*?>", "", re.sub(r"```(?:json)?\s*", "", response)).strip()
    whole = (said[:1], said[-1:])
    if whole in (("[", "]"), ("{", "}")):
        try:
            value = json.loads(said)
            return json.dumps(value if isinstance(value, list) else [value], ensure_ascii=False, separators=(",", ":"))
        except json.JSONDecodeError:
            pass
    decoder, at = json.JSONDecoder(), said.find("[")
    while at >= 0:
        try:
            return json.dumps(decoder.raw_decode(said, at)[0], ensure_ascii=False, separators=(",", ":"))
        except json.JSONDecodeError:
            at = said.find("[", at + 1)
    return None


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


#: Pairs of texts that a task holds at a time; Spark hands a column function 10,000 whatever their lengths.
AT_ONCE = 256


def with_ratio(df: DataFrame, key: str, a: str, b: str, name: str) -> DataFrame:
    """df with ratio(a, b) in place of the texts a and b; a task holds some AT_ONCE rows. key: a column that spreads the rows."""
    others = [c for c in df.columns if c not in (a, b)]
    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(name, T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ratio(batch.column(a)[i].as_py(), batch.column(b)[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).cast(arrow.field(c).type) for c in others], pa.array(found, pa.float64())], schema=arrow)

    groups = max(1, -(-df.count() // AT_ONCE))
    spread = df.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups)))
    return spread.groupBy("__group").applyInArrow(run, schema)


@F.pandas_udf(T.DoubleType())
def overlap(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_overlap(x or "", y or "") for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.DoubleType())
def set_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([soft_jaccard(x, y) for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.StringType())
def extract_json_array(response: pd.Series) -> pd.Series:
    return response.map(json_array)
