"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a normalised text form a lattice. A forward Viterbi pass gives every position the best score
of reaching it; a backward A-star search from the end takes these as its heuristic, which is exact, so it
only expands what lies on the next best path and gives segmentations in order of their scores.

No piece holds two adjacent characters that occur together in no piece of the vocabulary, so a text's
lattice is a chain of lattices that meet there. The chain's parts are searched once and remembered; a
document's best segmentations combine its parts' best: only the n - 1 parts with the cheapest second choice
can differ from their first choice in one of the n best.

A character that is no piece is one edge that stands for the pieces of its UTF-8 bytes, as bad as the worst
piece and UNKNOWN_PENALTY more. Scores are those of the model file. It is a merge model, whose scores are ranks, so the best
sum is not always the segmentation that its own merges make; the README has how often they agree.

Defined results: a null or empty text has one segmentation, of no pieces, with score 0; a text with fewer
than n segmentations gives all; of segmentations with one score, the one with longer pieces at the end goes
first; a decoded text is the normalised text with its spaces back; repeated rows give equal rows; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from operator import add, itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import small_batches
from quillon.llm.word_tokens import resolve

PIECE_BPE = "piece_bpe_32k.model"
N_BEST = 4
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: Parts that a worker remembers; it forgets all of them when there are more.
REMEMBERED = 1_600_000
#: Characters of a part that is not remembered, and is searched without a list of its edges.
LONG = 4096
_NONE = float("inf")
_PART = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceLattice:
    def __init__(self, path: str = PIECE_BPE):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=resolve(path))
        self.ids: dict[str, int] = {}
        #: Score of every piece, and None for what only begins a piece.
        self.scores: dict[str, float | None] = {}
        self.bytes: dict[int, int] = {}
        pairs: set[str] = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_unknown(i) or model.is_control(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.scores[piece] = float(model.get_score(i))
                pairs.update(map("".join, zip(piece, piece[1:], strict=False)))
        self.worst = min(self.scores.values()) - UNKNOWN_PENALTY
        for piece in list(self.ids):
            for end in range(1, len(piece)):
                self.scores.setdefault(piece[:end], None)
        #: The same scores by characters: each leads to a score (None within a piece) and to what may follow.
        self.tree: dict[str, tuple] = {}
        for piece in sorted(self.scores):
            level = self.tree
            for ch in piece[:-1]:
                level = level[ch][1]
            level[piece[-1]] = (self.scores[piece], {})
        self.pairs = pairs
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.values = {i: b for b, i in self.bytes.items()}
        #: Whether white space parts this vocabulary's lattice.
        self.by_words = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids)
        self.known: dict[str, tuple] = {}
        self.others: dict[tuple, list] = {}
        self.longest = max(map(len, self.ids))

    def _into(self, part: str, j: int) -> list[tuple[int, float]]:
        """(start, score) of every edge that ends at j, the longest first."""
        found, get = [], self.scores.get
        for i in range(max(0, j - self.longest), j):
            score = get(part[i:j])
            if score is not None:
                found.append((i, score))
        if not found or found[-1][0] != j - 1:
            found.append((j - 1, self.worst))
        return found

    def _forward(self, part: str) -> array:
        """The best score of reaching each position."""
        n, get, worst = len(part), self.scores.get, self.worst
        best = array("d", [-_NONE]) * (n + 1)
        best[0] = 0.0
        for i in range(n):
            base, j, score = best[i], i + 1, get(part[i], _NONE)
            more = score is not _NONE
            if not more or score is None:
                score = worst
            while True:
                if score is not None and base + score > best[j]:
                    best[j] = base + score
                j += 1
                if not more or j > n:
                    break
                score = get(part[i:j], _NONE)
                if score is _NONE:
                    break
        return best

    def nbest(self, part: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best (score, cut positions from 0 to the end), in order: backward A-star.

        An entry of the heap is a suffix's cuts as a chain. Its estimate is exact, so each entry holds a segmentation of that
        score that no other entry holds, and of all entries only the n best (less those found) can be among the n best."""
        forward = self._forward(part)
        found: list[tuple[float, list[int]]] = []
        # estimates are negated; of equal ones the entry that was made first goes first
        heap, made = [(-forward[-1], 0, len(part), None, 0.0)], 0
        while heap and len(found) < n:
            _, _, at, after, behind = heapq.heappop(heap)
            chain = (at, after)
            while at:
                ways = [(-(behind + score + forward[start]), start, behind + score) for start, score in self._into(part, at)]
                first = min(ways, key=itemgetter(0))
                for way in ways:
                    if way is not first:
                        made += 1
                        heap.append((way[0], made, way[1], chain, way[2]))
                if len(heap) > 4 * n:
                    heap = heapq.nsmallest(n, heap)
                at, behind = first[1], first[2]
                chain = (at, chain)
            heap = heapq.nsmallest(n, heap)  # a sorted list is a heap
            cuts, link = [], chain
            while link:
                cuts.append(link[0])
                link = link[1]
            found.append((behind, cuts))
        return sorted(found, key=lambda f: -f[0])

    def _ids(self, part: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            piece = part[a:b]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out.extend(self.bytes[x] for x in piece.encode("utf-8", "replace"))
        return out

    def _atom(self, part: str) -> tuple[float, float, bytes, bool]:
        """(best score, loss of the second best, ids of the best, whether these decode to it) of a part."""
        if len(part) == 1:
            return self._told(part, self.scores.get(part) or self.worst if part not in self.ids else self.scores[part], _NONE, [0, 1])
        if len(part) > LONG:
            two = self.nbest(part, 2)
            return self._told(part, two[0][0], two[0][0] - two[1][0] if len(two) > 1 else _NONE, two[0][1])
        # the best and the second best score of reaching each position
        n, tree, worst = len(part), self.tree, self.worst
        forward, second, came = [-_NONE] * (n + 1), [-_NONE] * (n + 1), [0] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            base, other, level, first = forward[i], second[i], tree, True
            for j in range(i, n):
                step = level.get(part[j])
                if step is None:
                    if not first:
                        break
                    score, level = worst, None
                else:
                    score, level = step
                    if score is None:
                        if not first:
                            continue
                        score = worst
                first = False
                value = base + score
                # of equal scores the longer last piece
                if value > forward[j + 1]:
                    was, also = forward[j + 1], other + score
                    second[j + 1] = was if was > also else also
                    forward[j + 1], came[j + 1] = value, i
                elif value > second[j + 1]:
                    second[j + 1] = value
                if not level:
                    break
        cuts = [n]
        while at := cuts[-1]:
            cuts.append(came[at])
        return self._told(part, forward[n], forward[n] - second[n], cuts[::-1])

    def _told(self, part: str, score: float, loss: float, cuts: list[int]) -> tuple[float, float, bytes, bool]:
        ids = self._ids(part, cuts)
        return score, loss, array("I", ids).tobytes(), self._joined(ids) == part.replace(SPACE, " ")

    def atoms(self, part: str) -> list[str]:
        """A part, cut between characters that no piece holds together."""
        pairs = self.pairs
        if pairs.issuperset(map(add, part, part[1:])):
            return [part]
        cuts = [0, *[i for i in range(1, len(part)) if part[i - 1 : i + 1] not in pairs], len(part)]
        return [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, part: str) -> tuple[float, float, bytes, bool]:
        """A part's best, from its atoms, and whether its ids decode to the part."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found, atoms = [], self.atoms(part)
        if len(atoms) == 1:
            out = self._atom(part)
            if len(part) <= LONG:
                known[part] = out
            return out
        for atom in atoms:
            f = known.get(atom)
            if f is None:
                f = self._atom(atom)
                if len(atom) <= LONG:
                    known[atom] = f
            found.append(f)
        out = (sum(f[0] for f in found), min(f[1] for f in found), b"".join(f[2] for f in found), all(f[3] for f in found))
        if len(part) <= LONG:
            known[part] = out
        return out

    def _decodes(self, ids: bytes, part: str) -> bool:
        return self._joined(array("I", ids)) == part.replace(SPACE, " ")

    def _ways(self, part: str, n: int) -> list[tuple[float, bytes, bool]]:
        """The n best (loss, ids, whether these decode to the part) of a part, whose atoms are searched by themselves."""
        found = self.others.get((part, n))
        if found is None:
            atoms = self.atoms(part)
            best = [self._learn(a) for a in atoms]
            ways: list[tuple[float, dict]] = [(0.0, {})]
            for _, i in heapq.nsmallest(n - 1, [(b[1], i) for i, b in enumerate(best) if b[1] < _NONE]):
                own = self.nbest(atoms[i], n)
                ways = heapq.nsmallest(n, [(w + own[0][0] - s, c | {i: cuts} if k else c) for w, c in ways for k, (s, cuts) in enumerate(own)], key=itemgetter(0))
            found = []
            for loss, changed in ways:
                ids = [array("I", self._ids(a, changed[i])).tobytes() if i in changed else best[i][2] for i, a in enumerate(atoms)]
                whole = b"".join(ids)
                found.append((loss, whole, self._decodes(whole, part)))
            if len(self.others) > REMEMBERED // 8:
                self.others.clear()
            if len(part) <= LONG:
                self.others[part, n] = found
        return found

    def plain(self, text: str | None) -> str:
        """What a segmentation of text decodes to: the normalised text with its spaces back."""
        return (self.model.normalize(text) if text else "").replace(SPACE, " ").removeprefix(" ")

    def parts(self, text: str | None) -> list[str]:
        """The normalised text, cut where words meet."""
        whole = self.model.normalize(text) if text else ""
        return _PART.findall(whole) if self.by_words else [whole] if whole else []

    def best(self, text: str | None, n: int = N_BEST) -> tuple[list[float], bytes]:
        """The n best scores of a whole text, and the ids of the best as unsigned 32-bit integers."""
        found = self.paths(text, n)
        return [s for s, _ in found], found[0][1]

    def paths(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes]]:
        """The n best (score, ids as unsigned 32-bit integers) of a whole text, in order."""
        return [p[:2] for p in self.checked(text, n)]

    def checked(self, text: str | None, n: int = N_BEST) -> list[tuple[float, bytes, bool]]:
        """paths(), and whether the ids of the best decode to the text, part by part, and those that another path has in other places there."""
        parts, known = self.parts(text), self.known
        found = []
        for p in parts:
            f = known.get(p)
            found.append(f if f is not None else self._learn(p))
        if not found:
            return [(0.0, b"", True)]
        scores, losses, ids, good = zip(*found, strict=True)
        total = sum(scores)
        cheap = heapq.nsmallest(n - 1, [(x, i) for i, x in enumerate(losses) if x < _NONE]) if n > 1 else []
        # a way is its loss and, by part, the ids it takes there instead of the best
        ways: list[tuple[float, dict]] = [(0.0, {})]
        for _, i in cheap:
            own = self._ways(parts[i], n)
            ways = heapq.nsmallest(n, [(w + other[0], c | {i: other[1:]} if k else c) for w, c in ways for k, other in enumerate(own)], key=itemgetter(0))
        out = [(total, b"".join(ids), all(good))]
        for w, changed in ways[1:]:
            own = list(ids)
            for i, (other, _) in changed.items():
                own[i] = other
            out.append((total - w, b"".join(own), all(good for _, good in changed.values())))
        return out

    def segmentations(self, text: str | None, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best (score, ids) of a whole text, searched in one lattice."""
        whole = self.model.normalize(text) if text else ""
        return [(s, self._ids(whole, cuts)) for s, cuts in self.nbest(whole, n)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, byte pieces as UTF-8, spaces restored, the first one dropped."""
        return self._joined(ids).removeprefix(" ")

    def _joined(self, ids) -> str:
        values = self.values
        if values.keys().isdisjoint(ids):
            return "".join(map(self.pieces.__getitem__, ids)).replace(SPACE, " ")
        out, held = [], bytearray()
        for i in ids:
            if i in values:
                held.append(values[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.pieces[i])
        out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")


_OPEN: dict[str, PieceLattice] = {}


def lattice(path: str = PIECE_BPE) -> PieceLattice:
    """This process's lattice for path."""
    if path not in _OPEN:
        _OPEN[path] = PieceLattice(path)
    return _OPEN[path]


def encode(docs: DataFrame, n: int = N_BEST, path: str = PIECE_BPE, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """doc_id, scores (the n best, best first) and, for each of these, n_pieces, crc32 of the ids as unsigned 32-bit integers,
    round_trip (whether they decode to the normalised text) and, with_ids, all_ids (binary), for every row."""
    small_batches(docs.sparkSession)
    kinds = {"scores": pa.float64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()} | ({"all_ids": pa.binary()} if with_ids else {})

    def run(batches):
        own = lattice(path)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                found = own.checked(t, n)
                # the best is decoded by its parts, the others where they differ from it
                best = found[0][2]
                ids = [f[1] for f in found]
                rows.append(([f[0] for f in found], [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], [best and f[2] for f in found], ids))
            columns = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *kinds])

    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, scores array<double>, n_pieces array<long>, ids_crc32 array<long>, round_trip array<boolean>" + (", all_ids array<binary>" if with_ids else "")
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str = PIECE_BPE) -> DataFrame:
    """(doc_id, text) of rows with doc_id and all_ids (binary, best first), by the best; null ids give a null text."""
    small_batches(encoded.sparkSession)

    def run(batches):
        own = lattice(path)
        for batch in batches:
            texts = [None if b is None else own.decode(array("I", b).tolist()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", F.get("all_ids", F.lit(0)).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
