"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is made from word shingles of the whole text. Two fingerprints link at MAX_BITS or fewer
differing bits. The 64 bits are two segments of 32; by the pigeonhole principle a linked pair has a
segment with at most one differing bit, so each distinct fingerprint enumerates the Hamming ball of
radius one around its segments, fetches the table rows with that segment and verifies the complete
distance. Of a pair whose segments differ in one bit, one side has a zero there; only zeros are flipped.

Copies collapse before any join: the tables hold one row per distinct fingerprint. A segment value shared
by very many distinct fingerprints is not joined with itself as a whole: its rows are told apart by the
same method on the two 16-bit halves of the other segment, which is as exact.

`find` has one rule, three bits of 64. `drop_near_duplicates` finds texts that share LEAST_SIMILARITY or more of their shingles of
five words, of which few are within three bits. Its fingerprints have 320 bits in 15 segments of 21; a pair that is as
similar as that has a segment with at most one differing bit with a probability of 0.91 or more, which grows with the
similarity. Complete distances are verified, then the similarity itself, from the texts of the candidates.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows give repeated results; a row without an id gets a
fingerprint, links like any other and has the smallest id of its component (null if no member has one); an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.buckets import linked_groups
from quillon.llm.common import ROW, row_key, same_row, small_batches
from quillon.llm.components import connected_components
from quillon.session import checkpointed

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: More distinct fingerprints than this with one segment value are told apart by their other segment.
CROWDED = 512
_CHUNK = 1 << 15

#: Near-duplicates for filtering: words of a shingle, and the least Jaccard similarity of the shingles.
WIDE_SHINGLE = 5
LEAST_SIMILARITY = 0.8
#: 64-bit words of a wide fingerprint, and bits of its segments, of which each word holds three.
WIDE_WORDS = 5
SEGMENT = 21
#: Most differing bits of a word, and of all five, of pairs whose similarity is counted: some 3.5 and 2.5 deviations above those expected.
GATE_BITS = 20
WIDE_BITS = 64
#: Words whose hash a worker remembers.
_REMEMBERED = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; bytes.lower and bytes.split treat ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*[words[k:] for k in range(shingle)], strict=False))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.array(hashes[at : at + _CHUNK], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the 64 bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"doc_id {kind}, fp long")


def _low(column, bits: int):
    return column.bitwiseAND(F.lit((1 << bits) - 1))


def _segments(table: DataFrame) -> DataFrame:
    """Two rows for each fingerprint: which segment, its value, and the other segment."""
    high, low = F.shiftrightunsigned("fp", 32), _low(F.col("fp"), 32)
    both = F.array(F.struct(F.lit(0).alias("part"), high.alias("own"), low.alias("other")), F.struct(F.lit(1).alias("part"), low.alias("own"), high.alias("other")))
    return table.select("fp", F.inline(both))


def _ball(value, bits: int, zeros_only: bool):
    """The values within one bit of value, itself included."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    return F.concat(F.array(value), F.filter(flips, lambda x: x > value) if zeros_only else flips)


def linked_pairs(table: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """(left, right): all pairs of the distinct fingerprints fp of table within max_bits (3 at most) bits. A pair may occur more than once."""
    if max_bits > 3:
        raise ValueError("two segments with balls of radius one find at most three differing bits")
    rows = _segments(table)
    dense = checkpointed(rows.groupBy("part", "own").count().filter(F.col("count") > crowded).select("part", "own"))
    probes = rows.select("fp", "part", "other", F.explode(_ball(F.col("own"), 32, True)).alias("own"))
    close = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= max_bits
    # a probe with the unchanged value meets both orders of a pair; one is enough
    once = (F.col("l.fp") < F.col("r.fp")) | (_own("l") != _own("r"))

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        equal = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        condition = equal[0]
        for e in [*equal[1:], close, once, F.col("l.fp") != F.col("r.fp")]:
            condition = condition & e
        return left.alias("l").join(right.alias("r"), condition).select(F.col("l.fp").alias("left"), F.col("r.fp").alias("right"))

    if dense.isEmpty():
        return met(probes, rows, ["part", "own"])
    half = lambda: F.array(F.struct(F.lit(0).alias("piece"), F.shiftright("other", 16).alias("bits")), F.struct(F.lit(1).alias("piece"), _low(F.col("other"), 16).alias("bits")))
    fine = lambda d: d.join(dense, ["part", "own"], "left_semi").select("fp", "part", "own", "other", F.inline(half()))
    fine_probes = fine(probes).select("fp", "part", "own", "other", "piece", F.explode(_ball(F.col("bits"), 16, False)).alias("bits"))
    rest = lambda d: d.join(dense, ["part", "own"], "left_anti")
    return met(rest(probes), rest(rows), ["part", "own"]).unionAll(met(fine_probes, fine(rows), ["part", "own", "piece", "bits"]))


def _own(side: str):
    """The side's true value of the segment that its row stands for."""
    return F.when(F.col(f"{side}.part") == 0, F.shiftrightunsigned(F.col(f"{side}.fp"), 32)).otherwise(_low(F.col(f"{side}.fp"), 32))


def components_of(fps: DataFrame, max_bits: int = MAX_BITS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) for every row of fps (doc_id, fp), which should be a written table."""
    table = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # fingerprints are linked, also through rows without an id; the least id of a component names it
    groups = connected_components(linked_pairs(table.select("fp"), max_bits, crowded), "left", "right")
    placed = table.join(groups, table["fp"] == groups["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    names = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_fp = placed.join(names, "c").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    found = components_of(checkpointed(fingerprints(docs, text, key, shingle)), max_bits)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


class _Hashes(dict):
    """64-bit hashes by word; all are forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads each bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, hashes: dict, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """A 64-bit hash of each word shingle of a whole text, repeats included; of all words, where they are fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(min(1, len(own)), len(own) - shingle + 1)
    out = np.full(n, min(shingle, len(own)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(shingle, len(own))):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + n])
    return out


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE_WORDS 64-bit words: a bit is 1 if it is set in over half of the distinct hashes, which are mixed anew for each word."""
    hashes = np.unique(hashes)
    out = np.zeros(WIDE_WORDS, dtype=np.int64)
    for j in range(WIDE_WORDS):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), _CHUNK):
            with np.errstate(over="ignore"):
                part = _mixed(hashes[at : at + _CHUNK] + np.uint64(j + 1) * np.uint64(0x9E3779B97F4A7C15)).astype(">u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[j] = np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)[0]
    return out


def _described(rows: DataFrame, with_sets: bool) -> DataFrame:
    """The columns k, t, u of rows (k, t, u, text) with words (the wide fingerprint) and, if wanted, grams (the distinct hashes)."""
    small_batches(rows.sparkSession)

    def run(batches):
        hashes = _Hashes()
        for batch in batches:
            found = [shingle_hashes(t, hashes) for t in batch.column("text").to_pylist()]
            columns = [pa.array([wide_fingerprint(f).tolist() for f in found], pa.list_(pa.int64()))]
            if with_sets:
                columns.append(pa.array([np.unique(f).view(np.int64) for f in found], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ROW], *columns], names=[*ROW, "words", "grams"][: len(ROW) + len(columns)])

    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, t long, u int, words array<long>" + (", grams array<long>" if with_sets else ""))


def _wide_buckets(distinct: DataFrame) -> DataFrame:
    """(h, gate, bucket): for every segment the Hamming ball of radius one around its value; zeros alone are flipped, as
    of two values that differ in one bit one has a zero there. The gate is the word after the segment's: its own word agrees in
    the segment's bits, so that texts which meet by chance would often pass."""
    mask, parts = (1 << SEGMENT) - 1, []
    for number in range(WIDE_WORDS * (64 // SEGMENT)):
        word, low = divmod(number, 64 // SEGMENT)
        value = F.shiftrightunsigned(F.col("words")[word], low * SEGMENT).bitwiseAND(F.lit(mask))
        own = F.lit(number << SEGMENT).cast("long").bitwiseOR(value)
        parts.append(F.struct(F.col("words")[(word + 1) % WIDE_WORDS].alias("gate"), _ball(own, SEGMENT, True).alias("ball")))
    return distinct.select("h", F.inline(F.array(*parts))).select("h", "gate", F.explode("ball").alias("bucket"))


def near_duplicate_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints k, t, u, h; first rows h, first; groups h, component) of rows (k, t, u, text) with a Jaccard similarity of
    LEAST_SIMILARITY or more between their distinct word shingles, as far as multi-index hashing finds the pairs."""
    fps = checkpointed(_described(rows, False).withColumn("h", F.xxhash64("words")))
    place = F.struct(F.col("k").isNull().alias("last"), *ROW)
    distinct = checkpointed(fps.groupBy("h").agg(F.first("words").alias("words"), F.min(place).alias("first")))

    def prepare(items: DataFrame):
        wanted = items.join(distinct, "h").select("h", "first.*").drop("last")
        texts = rows.join(wanted.select(*ROW), same_row(rows, wanted), "left_semi")
        sets = checkpointed(_described(texts, True).withColumn("h", F.xxhash64("words")).dropDuplicates(["h"]).select("h", "grams"))
        side = lambda name, n: sets.select(F.col("h").alias(name), F.col("grams").alias(f"g{n}"))
        shared = F.size(F.array_intersect("g1", "g2"))
        alike = shared >= LEAST_SIMILARITY * (F.size("g1") + F.size("g2") - shared) - 1e-9
        return lambda pairs: pairs.join(side("a", 1), "a").join(side("b", 2), "b").filter(alike).select("a", "b"), None

    # one word still lets texts meet by chance; the complete distance decides whose texts are looked at
    close = lambda a, b: sum((F.bit_count(a[j].bitwiseXOR(b[j])) for j in range(WIDE_WORDS)), F.lit(0)) <= WIDE_BITS
    whole = distinct.select("h", F.col("words").alias("more"))
    groups = linked_groups(_wide_buckets(distinct), lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= GATE_BITS, prepare, finer=(whole, close))
    return fps, distinct.select("h", "first"), groups


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first row of docs (by id, null last, then hash of the text) of each group of near-duplicates; of equal rows one."""
    rows = docs.select(*row_key(docs, text, key), docs[text].alias("text"))
    fps, distinct, groups = near_duplicate_groups(rows)
    leads = distinct.join(groups, "h", "left").groupBy(F.coalesce("component", "h").alias("c")).agg(F.min("first").alias("first")).select("first.*").drop("last")
    counted = fps.groupBy(*ROW).agg(F.count("*").alias("copies"))
    leads = checkpointed(leads.join(counted, same_row(leads, counted)).select(*[leads[c] for c in ROW], "copies"))
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *row_key(docs, text, key))
    kept = own.join(leads, same_row(own, leads)).select("row", *[own[c] for c in ROW], "copies")
    out, again = kept.filter("copies = 1").select("row"), F.col("copies") > 1
    if not leads.filter(again).isEmpty():
        # equal rows have no order of their own: they are written with numbers, of which the least of each kind stays
        equal = checkpointed(kept.filter(again).withColumn("at", F.monotonically_increasing_id()))
        firsts = equal.groupBy(*ROW).agg(F.min("at").alias("at")).select("at")
        out = out.unionAll(equal.join(firsts, "at", "left_semi").select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
