"""Language-model scores by a weighted backoff automaton that is spread over the cluster.

The model is a word model of order ORDER with Dirichlet smoothing: p(w|h) = (c(h,w) + m p(w|h')) / (c(h) + m), where h' is h
without its first word, m the mass of h's length, and p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). As an automaton, a state is a history
of up to ORDER - 1 words that occurs in training, and a smoothed n-gram is an arc to the longest state that ends its words. The failure
arc of a state leads to the state of its history without the first word and weighs m / (c(h) + m); the root, the empty history,
has an arc for every token. One traversal of a text from left to right carries the state and adds up log10 weights.

The model grows with the corpus, so no process holds it. Each task puts its rows into shards of about SHARD_BYTES of text, and
lists a shard's n-grams with their counts in training documents. Ranges of n-gram keys are summed, each in one task, and every shard
gets the sums for its own n-grams back: the part of the automaton that its documents can visit. Documents are read once more
for that and travel as numbers of their shard's words. A frequent n-gram counts once for each shard. What a task holds is a shard or a range;
the number of the ranges follows spark.sql.shuffle.partitions. A document longer than a shard is a shard by itself.

N-grams travel as 64-bit hashes. Shards are named by the task and their place in it, so docs has to be a table, whose rows are read
in the same order each time; a shard that differs raises an error.

Defined results: a null or empty text has one token, the end; rows with equal ids are separate documents;
without training documents N, V and all counts are 0; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import remainder, small_batches
from quillon.session import checkpointed, shuffle_width

ORDER = 3
#: Weight of the distribution after a shorter history, in tokens: for histories of one word, of two, and so on.
MASSES = (200.0, 20.0)
ADD = 0.1
#: Bytes of text from which a shard is full.
SHARD_BYTES = 20 << 20
#: No word holds white space.
#: Tokens for which a task holds weights at once, unless a document has more.
TOKENS = 1 << 20
END, START = b"\n", b"\r"
_SPLIT = 24
#: The kinds of rows besides those of n-grams, which have their order: documents, and a range's totals.
_DOCUMENTS, _TOTALS = 0, -1
_UNSTABLE = "the rows were read in another order the second time; write them as a table first"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Unsigned values by byte planes, which compress well where high bytes are 0."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(planes).reshape(-1).view("<u8")


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The keys of n-grams from those of their histories and last words."""
    with np.errstate(over="ignore"):
        x = (left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and each value's number: np.unique with narrow numbers, which let go of what is done with."""
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    keys = values[new]
    del values
    ranks = np.cumsum(new, dtype=np.int32)
    ranks -= 1
    out = np.empty(len(order), dtype=np.int32)
    out[order] = ranks
    return keys, out


class Documents:
    """lengths in tokens, tokens by number, and the words' hashes, of the documents of a shard."""

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray):
        self.lengths, self.tokens, self.hashes = lengths, tokens, hashes

    @classmethod
    def of(cls, texts: list[str | None]) -> Documents:
        ids = _Ids({END: 0, START: 1})
        get = ids.__getitem__
        parts = [np.fromiter(map(get, [*(t or "").encode("utf-8", "replace").lower().split(), END]), dtype=np.int32) for t in texts]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        return cls(lengths, np.concatenate([np.zeros(0, dtype=np.int32), *parts]), np.fromiter(map(xxhash.xxh64_intdigest, ids), dtype=np.uint64, count=len(ids)))

    def packed(self) -> list[bytes]:
        return [_packed(self.lengths), _packed(self.tokens), self.hashes.astype("<u8").tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Documents:
        return cls(_unpacked(parts[0]).astype(np.int64), _unpacked(parts[1]).astype(np.int32), np.frombuffer(parts[2], dtype="<u8"))


class Grams:
    """The n-grams of a shard's documents, by order: their sorted keys, and which one ends at each token (-1 where none does)."""

    def __init__(self, docs: Documents, order: int = ORDER):
        self.docs, n = docs, len(docs.tokens)
        self.place = (np.arange(n) - np.repeat(np.cumsum(docs.lengths) - docs.lengths, docs.lengths)).astype(np.int32)
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []
        words, number = np.unique(docs.hashes, return_inverse=True)
        self.number = number.astype(np.int32)
        self.keys.append(words)
        self.at.append(self.number[docs.tokens])
        word, history = docs.hashes[docs.tokens], None
        for k in range(2, order + 1):
            # the history of a document's first token is the start; longer ones begin further on
            before = np.concatenate([docs.hashes[1:2], (word if history is None else history)[:-1]])[:n]
            if history is None:
                before = np.where(self.place == 0, docs.hashes[1], before)
            own = _joined(before, word)
            del before
            good = self.place >= k - 2
            # the last order's keys are no histories
            values = own[good]
            history = own if k < order else None
            del own
            keys, inverse = _numbered(values)
            del values
            at = np.full(n, -1, dtype=np.int32)
            at[good] = inverse
            del inverse, good
            self.keys.append(keys)
            self.at.append(at)

    def runs(self, tokens: int):
        """The same n-grams for runs of whole documents with about so many tokens each; their keys are left out."""
        ends = np.cumsum(self.docs.lengths)
        begin = 0
        while begin < len(ends):
            first = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, first + tokens, side="right")))
            own = object.__new__(Grams)
            own.docs, own.keys, own.number = Documents(self.docs.lengths[begin:end], None, None), [], self.number
            own.place, own.at = self.place[first : ends[end - 1]], [at[first : ends[end - 1]] for at in self.at]
            yield own
            begin = end

    def counts(self, training: np.ndarray) -> list[np.ndarray]:
        """Counts in the training documents, by order and in the order of the keys."""
        inside = np.repeat(training, self.docs.lengths)
        return [np.bincount(at[inside & (at >= 0)], minlength=len(keys)) for keys, at in zip(self.keys, self.at, strict=True)]


class Automaton:
    """The part of the automaton that the documents of some n-grams can visit, with counts of these by order."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, masses=MASSES):
        self.grams, self.counts = grams, counts
        words, starts = counts[0].astype(np.float64), grams.number[1]
        p = (words + ADD) / (total + ADD * (distinct + 1))
        self.root = np.log10(p)
        contexts = words.copy()
        # a training document has one start and one end, which nothing follows
        contexts[starts], contexts[grams.number[0]] = words[grams.number[0]], 0.0
        at = grams.at
        #: For each length of the state before a token: the weight of the arc, failure arcs included.
        self.weights = np.empty((len(counts), len(at[0])))
        self.weights[0] = self.root[at[0]]
        #: The length of the state after a token: the longest n-gram, less than the full order, that ends there and occurs in training.
        self.after = (counts[0][at[0]] > 0).astype(np.int8)
        probability, n = p[at[0]], len(at[0])
        for k in range(2, len(counts) + 1):
            own, mass = at[k - 1], masses[k - 2]
            if k == 2:
                before = np.where(grams.place == 0, starts, np.concatenate([at[0][:1], at[0][:-1]]))
                of_history = contexts[before]
            else:
                before = np.concatenate([at[k - 2][:1], at[k - 2][:-1]])
                of_history = np.where(own >= 0, counts[k - 2][before], 0).astype(np.float64) if len(counts[k - 2]) else np.zeros(n)
            del before
            # in place, as each of these has a number for every token of the shard
            of_history += mass
            c = np.where(own >= 0, counts[k - 1][own], 0) if len(counts[k - 1]) else np.zeros(n, dtype=np.int64)
            probability *= mass
            probability += c
            probability /= of_history
            # an arc where there is one, else the failure arc and what the shorter state does
            out = self.weights[k - 1]
            np.log10(np.divide(mass, of_history, out=out), out=out)
            out += self.weights[k - 2]
            np.log10(probability, out=out, where=c > 0)
            del of_history
            if k < len(counts):
                self.after[c > 0] = k

    def traverse(self) -> np.ndarray:
        """Each document's sum of weights: the state goes from token to token; all documents advance by one token at a time."""
        weights, after, docs = self.weights, self.after, self.grams.docs
        order = np.argsort(-docs.lengths, kind="stable")
        lengths = docs.lengths[order]
        at = (np.cumsum(docs.lengths) - docs.lengths)[order]
        total, state = np.zeros(len(order)), np.ones(len(order), dtype=np.int8)  # the state of the start
        steps, live = int(lengths[0]) if len(order) else 0, len(order)
        alive = len(order) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")
        for step in range(steps):
            if alive[step] != live:
                live = int(alive[step])
                at, state = at[:live], state[:live]
            total[:live] += weights[state, at]
            state = after[at]
            at = at + 1
        out = np.empty(len(order))
        out[order] = total
        return out


def _ranges(keys: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall in, and where each begins (and the last ends)."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)
    which = ((keys >> np.uint64(64 - _SPLIT)) * np.uint64(ranges)) >> np.uint64(_SPLIT)
    cuts = np.flatnonzero(np.diff(which)) + 1
    begins = np.concatenate([[0], cuts, [len(keys)]])
    return which[begins[:-1]].astype(np.int64), begins


def _names(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("range", pa.int32()), ("shard", pa.int64()), ("kind", pa.int32()), ("data", pa.list_(pa.binary())), ("ids", pa.list_(kind)), ("train", pa.list_(pa.bool_())), ("tokens", pa.int64()), ("distinct", pa.int64())])


def _lister(rows_of, shard_bytes: int):
    """The rows that rows_of(shard, ids, train, texts) makes of each shard of a task's rows."""

    def run(batches):
        task, number, kind = TaskContext.get().partitionId(), 0, None
        ids, train, texts, size = [], [], [], 0

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _names(kind), strict=True)], schema=_names(kind))

        for batch in batches:
            kind = batch.column(0).type
            for key, text, taught in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                ids.append(key)
                texts.append(text)
                train.append(taught)
                size += len(text or "")
                if size >= shard_bytes:
                    yield batch_of(list(rows_of(task << 32 | number, ids, train, texts)))
                    ids, train, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield batch_of(list(rows_of(task << 32 | number, ids, train, texts)))

    return run


def _gram_rows(ranges: int, order: int):
    """For each order and range the keys and counts of a shard's n-grams."""

    def rows(shard, ids, train, texts):
        grams = Grams(Documents.of(texts), order)
        for k, (keys, counts) in enumerate(zip(grams.keys, grams.counts(np.array(train, dtype=bool)), strict=True), 1):
            which, begins = _ranges(keys, ranges)
            for r, a, b in zip(which.tolist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                yield (r, shard, k, [_packed(np.diff(keys[a:b], prepend=np.uint64(0))), _packed(counts[a:b])], None, None, None, None)

    return rows


def _document_row(shard, ids, train, texts):
    return [(None, shard, _DOCUMENTS, Documents.of(texts).packed(), ids, train, None, None)]


def _sum_range(key, table):
    """Each shard's n-grams of a range with their sums over all shards, and the range's tokens and words."""
    r, names = key[0].as_py(), table.schema
    rows: list[tuple] = []
    kinds, shards, data = table.column("kind").to_numpy(), table.column("shard").to_numpy(), table.column("data")
    for kind in sorted(set(kinds.tolist())):
        mine = np.flatnonzero(kinds == kind).tolist()
        parts = [data[i].as_py() for i in mine]
        keys = [np.cumsum(_unpacked(p[0]), dtype=np.uint64) for p in parts]
        counts = np.concatenate([_unpacked(p[1]) for p in parts]).astype(np.int64)
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(sums, inverse, counts)
        at = 0
        for i, own in zip(mine, keys, strict=True):
            rows.append((r, int(shards[i]), kind, [_packed(sums[inverse[at : at + len(own)]])], None, None, None, None))
            at += len(own)
        if kind == 1:
            rows.append((r, -1, _TOTALS, None, None, None, int(sums.sum()), int((sums > 0).sum())))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), names, strict=True)], schema=names)


def _scorer(total: int, distinct: int, order: int, masses):
    def run(listed, table):
        kinds, data = table.column("kind").to_numpy(), table.column("data")
        if listed.num_rows != 1:
            raise ValueError(_UNSTABLE)
        docs = Documents.unpacked(listed.column("data")[0].as_py())
        grams, counts, ranges = Grams(docs, order), [], table.column("range").to_numpy()
        for k in range(1, order + 1):
            mine = np.flatnonzero(kinds == k)
            parts = [_unpacked(data[int(i)].as_py()[0]) for i in mine[np.argsort(ranges[mine], kind="stable")]]
            counts.append(np.concatenate([np.zeros(0, dtype="<u8"), *parts]).astype(np.int64))
        if [len(c) for c in counts] != [len(k) for k in grams.keys]:
            raise ValueError(_UNSTABLE)
        # the automaton is over numbers: what they were made from goes before it is built
        grams.keys, docs.tokens, docs.hashes = [], None, None
        lengths, known, base, sums = docs.lengths, [], [], []
        for run_ in grams.runs(TOKENS):
            automaton = Automaton(run_, counts, total, distinct, masses)
            n, at = len(run_.docs.lengths), run_.at[0]
            doc = np.repeat(np.arange(n), run_.docs.lengths)
            base.append(np.bincount(doc, weights=automaton.root[at], minlength=n))
            known.append(np.bincount(doc, weights=counts[0][at] > 0, minlength=n).astype(np.int64))
            del doc
            sums.append(automaton.traverse())
            del automaton
        n, known, base, sums = len(lengths), *map(np.concatenate, (known, base, sums))
        ids, train = listed.column("ids")[0].values, np.array(listed.column("train")[0].as_py(), dtype=bool)
        return pa.table(
            [ids, pa.array(~train), pa.array(docs.lengths), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(sums)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def score(docs: DataFrame, masses=MASSES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs; the order is one more than the masses."""
    spark, order = docs.sparkSession, len(masses) + 1
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"range int, shard long, kind int, data array<binary>, ids array<{kind}>, train array<boolean>, tokens long, distinct long"
    rows = docs.select("doc_id", "text", (remainder("doc_id", 10) != 0).alias("train"))
    listed = rows.mapInArrow(_lister(_gram_rows(shuffle_width(spark), order), shard_bytes), schema)
    sums = checkpointed(listed.groupBy("range").applyInArrow(_sum_range, schema))
    totals = sums.filter(F.col("kind") == _TOTALS).agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    own = sums.filter(F.col("kind") != _TOTALS).select("shard", "range", "kind", "data")
    dealt = rows.mapInArrow(_lister(_document_row, shard_bytes), schema).select("shard", "data", "ids", "train")
    run = _scorer(totals[0], totals[1], order, masses)
    return dealt.groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
