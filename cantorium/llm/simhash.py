"""Near-duplicate documents by SimHash fingerprints at 2 or fewer differing bits, candidates by pigeonring filtering.

A fingerprint is a ring of 8 segments of 8 bits. If two fingerprints differ in at most 2 bits, then from some segment on
the differences in the first l segments are at most l * 2/8 for every l: none in the first three segments, at most one in
the first seven, at most two in all. So for each start the first 24 bits agree, and of the next 32 bits one half agrees
too: 16 keys of 40 bits reach every link. Fingerprints that share a key are candidates only if the whole chain from the
key's start keeps its budgets; what is left is checked in full. No link is lost: each has a start from which its chain holds.

Equal fingerprints are one node. Links in a key's bucket are handed on as a spanning forest, so a bucket of b nodes gives
fewer than b pairs; a large bucket is linked by sorting under each mask of two free bits, which needs no pairs at all and
finds the same links. A fingerprint of many documents is joined to them by a broadcast of such fingerprints, which are few.

Defined results: text that is null or has no words has fingerprint zero and is linked like any other; a null doc_id gets
its fingerprint's component and is never the smallest id; repeated rows have one row each; an empty table gives none;
further columns of any name are ignored, or kept by drop_duplicates(). Of several rows of one id and class
drop_duplicates() keeps the one with the smallest fingerprint, then the smallest hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cantorium.llm.components import components
from cantorium.llm.rows import attach, free, row_hash
from cantorium.session import materialize

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 2
SEGMENTS = 8
#: A bucket with more nodes is linked by masks instead of by comparing its nodes.
COMPARED = 1024
_CHUNK = 255 * 256
_LANES = np.uint64(0x0101010101010101)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits, lowest first."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
    padded[: len(hashes)] = hashes
    total = np.zeros((8, 8), np.int64)
    for shift in range(8):  # bit 8*j + shift of each hash is counted in byte j, 255 hashes at a time
        lanes = ((padded >> np.uint64(shift)) & _LANES).reshape(-1, 255).sum(1, dtype=np.uint64)
        total[:, shift] = lanes.view(np.uint8).reshape(-1, 8).sum(0)
    return total.reshape(64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's UTF-8 bytes as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    many = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    sums = np.zeros(64, np.int64)
    for at in range(0, many, _CHUNK):
        parts = map(line.__getitem__, map(slice, first[at : min(at + _CHUNK, many)].tolist(), last[at : at + _CHUNK].tolist()))
        sums += _bit_sums(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), np.uint64, min(_CHUNK, many - at)))
    return int(sum(1 << i for i in np.flatnonzero(2 * sums > many).tolist()))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, text_hash, fp: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that tie each node to the first of its component under the links i-j."""
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[tied], nodes[label[tied]]


def _link_large(nodes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fingerprints without comparing pairs: equal under a mask of at most `most` (2) varying bits."""
    varying = int(np.bitwise_or.reduce(nodes ^ nodes[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    masks = [1 << a | 1 << b for a in bits for b in bits if a <= b] if most == 2 else [1 << a for a in bits]
    found_i, found_j = [], []
    for mask in masks:
        rest = nodes & np.uint64(~mask & (1 << 64) - 1)
        order = np.argsort(rest, kind="stable")
        same = np.flatnonzero(rest[order][1:] == rest[order][:-1])
        found_i.append(order[same])
        found_j.append(order[same + 1])
    return _forest(nodes, np.concatenate(found_i), np.concatenate(found_j))


def _budgets(most: int) -> np.uint64:
    """Byte l - 1: how many differing bits the first l segments of a chain may have; with the byte's highest bit set."""
    return np.uint64(sum((0x80 | l * most // SEGMENTS) << 8 * (l - 1) for l in range(1, SEGMENTS + 1)))


def in_chain(apart: np.ndarray, start: int, most: int = MOST_BITS) -> np.ndarray:
    """Which differences (64 bits, segment 0 highest) keep the budgets of the chain of all segments from `start` round the ring."""
    turn = np.uint64(8 * start)
    turned = apart << turn | apart >> np.uint64(64) - turn if start else apart
    counts = turned.byteswap()  # segment `start` in the lowest byte
    counts = counts - (counts >> np.uint64(1) & np.uint64(0x5555555555555555))
    counts = (counts & np.uint64(0x3333333333333333)) + (counts >> np.uint64(2) & np.uint64(0x3333333333333333))
    counts = counts + (counts >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)
    sums = counts * _LANES  # byte l - 1: differing bits of the first l segments, 64 at most
    high = np.uint64(0x8080808080808080)
    return (_budgets(most) - sums) & high == high


def _link_bucket(nodes: np.ndarray, start: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    if len(nodes) > COMPARED:
        return _link_large(nodes, most)
    i, j = np.triu_indices(len(nodes), 1)
    apart = nodes[i] ^ nodes[j]
    near = in_chain(apart, start, most)
    i, j, apart = i[near], j[near], apart[near]
    linked = np.bitwise_count(apart) <= most
    return _forest(nodes, i[linked], j[linked])


def link_buckets(batches: Iterator[pa.RecordBatch], most: int = MOST_BITS) -> Iterator[pa.RecordBatch]:
    """Pairs a, b of linked fingerprints from batches of (key, fp) sorted by key, then fp."""
    kept_key, kept = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def link(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        found_a, found_b = [], []
        pairs = starts[sizes == 2]
        apart, begins = fp[pairs] ^ fp[pairs + 1], key[pairs] >> 41
        near = np.zeros(len(pairs), bool)
        for begin in range(SEGMENTS):
            own = begins == begin
            near[own] = in_chain(apart[own], begin, most)
        pairs = pairs[near & (np.bitwise_count(apart) <= most)]
        found_a.append(fp[pairs + 1])
        found_b.append(fp[pairs])
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            a, b = _link_bucket(fp[at : at + n], int(key[at]) >> 41, most)
            found_a.append(a)
            found_b.append(b)
        a, b = (np.concatenate(x).view(np.int64) for x in (found_a, found_b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        key = np.concatenate([kept_key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([kept, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1])) if key[0] != key[-1] else 0
        if cut:
            yield link(key[:cut], fp[:cut])
        kept_key, kept = key[cut:], fp[cut:]
    if len(kept_key):
        yield link(kept_key, kept)


def keys(fp) -> list:
    """The 16 keys of a fingerprint column: start segment, half, and the 40 bits that must agree."""
    found = []
    for start in range(SEGMENTS):
        turn = 8 * start
        turned = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp
        exact = F.shiftleft(F.shiftrightunsigned(turned, 40), 16)
        for half, shift in enumerate((24, 8)):
            bits = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(0xFFFF).cast("long"))
            found.append(exact.bitwiseOR(bits).bitwiseOR(F.lit((start * 2 + half) << 40).cast("long")))
    return found


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs a, b of distinct fingerprints (column fp) that span the same components as all links of at most `most` bits (0 to 2)."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"the keys are complete for 0 to {MOST_BITS} differing bits, not for {most}")
    keyed = distinct.select(F.explode(F.array(*keys(F.col("fp")))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda it: link_buckets(it, most), "a long, b long")


def _rooted(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id of every document. root: a fingerprint of its class, of which several may have one component_id where ids repeat."""
    prints = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    tied = components(links(nodes, most)).withColumnRenamed("node", "fp")
    rooted = nodes.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    named = materialize(rooted.join(least, "root").select("fp", "n", "root", "component_id"), "simhash-classes")
    return attach(prints, named, "fp", "n", total).select("doc_id", "text_hash", "fp", "root", "component_id")


def classes(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """doc_id, fp, component_id of every document."""
    return _rooted(docs, shingle, most).select("doc_id", "fp", "component_id")


def hexadecimal(fp) -> object:
    """The 16 lowercase hex digits of a long's bits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_duplicates(docs: DataFrame, shingle: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """A row of docs for each class, of its smallest id; rows without an id stay, and so do texts of other classes under one id."""
    own = _rooted(docs, shingle, most).filter(F.col("doc_id") == F.col("component_id"))
    kept_id, kept_hash, text_hash = free(docs, "kept_id", "kept_hash", "text_hash")
    kept = own.groupBy("root", F.col("doc_id").alias(kept_id)).agg(F.min(F.struct("fp", "text_hash"))["text_hash"].alias(kept_hash)).drop("root")
    named = docs.filter(F.col("doc_id").isNotNull()).withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    same = (F.col("doc_id").cast("long") == F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    first = named.join(kept, same, "left_semi").groupBy(F.col("doc_id").alias(kept_id), text_hash).agg(F.min_by(F.struct(*columns), row_hash(docs)).alias("row"))
    first = first.select([F.col("row").getField(c).alias(c) for c in docs.columns])
    return first.unionByName(docs.filter(F.col("doc_id").isNull()).select(*columns))
