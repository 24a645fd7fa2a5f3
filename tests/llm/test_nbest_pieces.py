import random
import zlib

from quillon.llm import nbest_pieces as nb

SF = "/root/testdata/sf0.001"


def brute(own, whole):
    """All segmentations' scores of a short normalised text."""
    out = [[] for _ in range(len(whole) + 1)]
    out[0] = [0.0]
    for j in range(1, len(whole) + 1):
        for i in range(j):
            piece = whole[i:j]
            if piece in own.ids:
                out[j] += [s + own.scores[piece] for s in out[i]]
            elif j == i + 1:
                out[j] += [s + own.worst for s in out[i]]
    return sorted(out[-1], reverse=True)


def score_of(own, ids):
    spread = {i for i in own.bytes.values()}
    text_ids = [i for i in ids if i not in spread]
    return sum(own.scores[own.model.id_to_piece(i)] for i in text_ids)


def test_nbest_matches_brute_force():
    own, rng = nb.lattice(), random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("then iß,.é\n日☃") for _ in range(rng.randint(0, 11)))
        whole = own.model.normalize(text)
        want = brute(own, whole)[:5]
        assert [s for s, _ in own.nbest(whole, 5)] == want
        scores, ids = own.best(text, 5)
        assert scores == want
        best = own.segmentations(text, 5)
        assert [s for s, _ in best] == want
        for s, path in best:
            assert own.decode(path) == text
            if "日" in own.ids and "☃" not in text and "\n" not in text:
                assert score_of(own, path) == s
        assert own.decode(nb.array("I", ids).tolist()) == text
        assert own.model.decode(nb.array("I", ids).tolist()) == text


def test_round_trip_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = nb.encode(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in nb.decode(out).collect()} == texts
    own = nb.lattice()
    for r in out.limit(20).collect():
        if len(texts[r.doc_id]) < 3000:
            want = own.segmentations(texts[r.doc_id])
            assert r.scores == [s for s, _ in want] and r.n_pieces == [len(p) for _, p in want] and all(r.round_trip)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "a\x00b", 1), (4, "x" * 20000, 2), (5, "   ", 1)], "doc_id long, text string, scores int")
    out = {(r.doc_id, r.n_pieces[0] > 0, r.scores[0] <= 0) for r in nb.encode(df).collect()}
    assert out == {(1, False, True), (2, False, True), (None, True, True), (4, True, True), (5, True, True)}
    back = {r.doc_id: r.text for r in nb.decode(nb.encode(df)).collect()}
    assert back == {1: "", 2: "", None: "a\x00b", 4: "x" * 20000, 5: "   "}
    assert nb.encode(df.limit(0)).count() == 0


def test_all_segmentations_are_returned_and_decode(spark):
    own, rng = nb.lattice(), random.Random(9)
    texts = ["", *["".join(rng.choice("then iß,.é\n日☃") for _ in range(rng.randint(1, 30))) for _ in range(60)], "a longer text of several words, once more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = nb.encode(df).collect()
    assert len(rows) == len(texts) and max(len(r.all_ids) for r in rows) == nb.N_BEST
    for r in rows:
        paths = [nb.array("I", bytes(b)).tolist() for b in r.all_ids]
        want = own.segmentations(texts[r.doc_id])
        assert len(paths) == len(r.scores) == len(r.round_trip) == len(want)
        assert len(set(map(tuple, paths))) == len(paths)
        assert r.ids_crc32 == [zlib.crc32(bytes(b)) for b in r.all_ids] and r.n_pieces == list(map(len, paths))
        assert all(abs(s - w) < 1e-6 for s, (w, _) in zip(r.scores, want, strict=True))
        assert all(r.round_trip) and all(own.decode(p) == texts[r.doc_id] for p in paths)
    digests = nb.encode(df, with_ids=False).collect()
    assert [(r.doc_id, r.ids_crc32) for r in digests] == [(r.doc_id, r.ids_crc32) for r in rows] and "all_ids" not in digests[0]


def test_equal_scores_are_all_returned_the_longer_last_piece_first():
    own = nb.lattice()
    flat = nb.PieceLattice()
    flat.scores = {p: None if s is None else -1.0 for p, s in own.scores.items()}
    flat.worst = -1.0
    whole = flat.model.normalize("then then")
    found = flat.nbest(whole, 40)
    ways = sorted(brute(flat, whole), reverse=True)[:40]
    assert [s for s, _ in found] == ways and len({tuple(c) for _, c in found}) == 40
    best = [c for s, c in found if s == found[0][0]]
    assert all(best[0][-2] <= c[-2] for c in best)


def test_a_very_long_word_takes_linear_time_and_memory():
    import time
    import tracemalloc

    own, rng = nb.lattice(), random.Random(1)
    text = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+") for _ in range(100_000))
    began = time.time()
    found = own.paths(text)
    took = time.time() - began
    assert len(found) == 4 and len({i for _, i in found}) == 4 and took < 20
    assert all(own.decode(nb.array("I", i)) == text for _, i in found)
    tracemalloc.start()
    own.paths("x" + text)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_second_best_and_round_trip_of_parts_match_whole_searches():
    own, rng = nb.lattice(), random.Random(9)
    for _ in range(300):
        part = own.model.normalize("".join(rng.choice("thenaiosß,.é日☃") for _ in range(rng.randint(1, 14)))) or nb.SPACE
        best, loss, ids, good = own._learn(part)
        two = own.nbest(part, 2)
        assert best == two[0][0] and (loss == best - two[1][0] if len(two) > 1 else loss == float("inf"))
        assert ids == nb.array("I", own._ids(part, two[0][1])).tobytes()
        assert good == (own._joined(nb.array("I", ids)) == part.replace(nb.SPACE, " "))
    # ids that do not decode to their part are told: pieces of another text under this one's ids
    own = nb.PieceLattice()
    own.pieces = [p.replace("t", "x") for p in own.pieces]
    assert [f[2] for f in own.checked("the cat", 2)][0] is False and [f[2] for f in nb.lattice().checked("the cat", 2)] == [True, True]
