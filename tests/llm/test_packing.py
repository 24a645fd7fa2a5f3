import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillon.llm import packing as p
from quillon.llm.word_tokens import WordTokenizer

SF = "/root/testdata/sf0.001"


def test_word_ids_are_the_tokenizers_ids(spark):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", " ", "I'm l'homme. it's_ok", "a\x1cb", "é x y z\x85w", "<|endoftext|> abc<|startoftext|>x", "ÀÉ!! 12 1a2 ＡΣΣ İ ſ ß ẞ.", "日本 語'll", "x" * 300]
    rng = random.Random(2)
    alphabet = "aAéÉß.,!'’_-0 9\n\t́ñΣ#|<>日\x1d"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    want = [np.array(own.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert WordTokenizer().encode(texts) == want


def test_bins_match_a_plain_search():
    rng = random.Random(4)
    for most in (1, 3, 8):
        bins, open_now, closed = p.OpenBins(50, most), [], 0
        for _ in range(500):
            n = rng.randint(1, 50)
            where, offset = bins.place(n)
            fits = [b for b in open_now if b[1] >= n]
            if fits:
                best = min(fits, key=lambda b: b[1])[1]
                mine = next(b for b in open_now if b[0] == where)
                assert mine[1] == best and offset == 50 - best
                mine[1] -= n
            else:
                if n < 50 and len(open_now) >= most:
                    fullest = min(b[1] for b in open_now)
                    gone = next(b for b in open_now if b[1] == fullest and b[0] not in bins.still_open())
                    open_now.remove(gone)
                assert offset == 0
                open_now.append([where, 50 - n])
            open_now = [b for b in open_now if b[1]]
            assert len(open_now) <= most and {b[0] for b in open_now} == bins.still_open()


def check(rows, docs, size):
    own = WordTokenizer()
    ids = {d: own.encode([t])[0] + p.END for d, t in docs}
    seqs, pieces = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    for d, parts in pieces.items():
        total = len(ids[d]) // 4
        assert sorted(parts) == [(k, k * size, min(size, total - k * size)) for k in range(-(-total // size))]
    return len(seqs), sum(len(x) // 4 for x in ids.values())


def test_pack_is_whole_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    rows = p.pack(docs).collect()
    n, total = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= 1.05 * total / 2048 + 1


def test_edges(spark):
    data = [(1, None, 0), (2, "", 1), (3, "word " * 9000, 2), (4, "a b", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, piece int")
    check(p.pack(df, most=2, most_left=2).collect(), [(d, t) for d, t, _ in data], 2048)
    assert p.pack(spark.createDataFrame([(None, "x"), (1, "x"), (1, "x")], "doc_id long, text string")).count() == 3
    assert p.pack(df.limit(0)).count() == 0


def test_large_ids_beside_a_null_one_stay_exact(spark):
    big = [(1 << 60) + 1, (1 << 60) + 3, None]
    out = p.pack(spark.createDataFrame([(k, "a b c") for k in big], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(map(str, big))
    names = p.pack(spark.createDataFrame([("x", "a b"), (None, "c")], "doc_id string, text string")).collect()
    assert {r.doc_id for r in names} == {"x", None}


def test_rows_of_closed_bins_leave_early(spark, monkeypatch):
    monkeypatch.setattr(p, "FLUSH", 50)
    docs = [(i, "word " * (i % 40)) for i in range(2000)]
    check(p.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), size=64, most=4).collect(), docs, 64)
