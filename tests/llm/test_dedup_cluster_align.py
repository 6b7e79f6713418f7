"""Substring dedup, ball k-means and token alignment against brute force, and at their edges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairngraph.llm import ball_kmeans, queries, substring_dedup, token_alignment
from tests.llm.test_operators import HARD, LONG, clashing, docs, prose

# --- 11 -----------------------------------------------------------------------------------------------


def naive_removal(rows, window):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if i is not None:
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((str(i), len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return sorted(out)


def removed(df, **options):
    found = substring_dedup.without_repeats(df, **options).collect()
    for r in found:  # the intervals are maximal, in order, and say what is gone
        cut = [(x.start, x.end) for x in r.removed]
        assert all(a < b for a, b in cut) and all(b < c for (_, b), (c, _) in zip(cut, cut[1:], strict=False)) and sum(b - a for a, b in cut) == r.n_removed
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in found)


@pytest.mark.parametrize("window", [1, 3, 7, 50])
def test_substrings_equal_brute_force(spark, window):
    rnd = random.Random(window)
    passages = [prose(rnd, rnd.randrange(window, 3 * window + 2), "ab") for _ in range(4)]
    texts = HARD + [" ".join(rnd.choice([rnd.choice(passages), prose(rnd, rnd.randrange(8), "abc")]) for _ in range(rnd.randrange(6))) for _ in range(60)]
    ids = [None, None, 7, 7, *range(3, len(texts) - 1)]
    rows = list(zip(ids, texts, strict=True))
    assert removed(clashing(docs(spark, texts, ids)), window=window) == naive_removal(rows, window)


def test_substrings_at_their_edges(spark, monkeypatch):
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0
    one = " ".join(f"w{i}" for i in range(50))
    texts = [one, one, one + " more", "less " + one[:-4], None, f"{one} {one}", LONG, LONG + " " + one]
    rows = list(zip([5, 3, 9, 1, 2, 4, 8, 10], texts, strict=True))
    want = naive_removal(rows, 50)
    assert removed(docs(spark, texts, [i for i, _ in rows])) == want
    assert {r[0]: r[2] for r in want} | {"3": 0, "5": 50, "9": 50, "1": 0, "4": 100, "8": 0, "10": 30_050} == {r[0]: r[2] for r in want}
    # What a task hands on at once changes nothing.
    monkeypatch.setattr(substring_dedup, "HELD_WINDOWS", 3)
    monkeypatch.setattr(substring_dedup, "HELD_WORDS", 2)
    small = [(i, t) for i, t in rows if t is not LONG and (t is None or len(t) < 2000)]
    assert removed(docs(spark, [t for _, t in small], [i for i, _ in small])) == naive_removal(small, 50)


def test_hashes_are_polynomials():
    rnd = random.Random(11)
    x = np.array([rnd.randrange(1 << 31) for _ in range(90)], np.uint64)
    for window in (1, 2, 5, 50, 64, 90, 91):
        p, base = substring_dedup.PRIME, substring_dedup.BASES[0]
        want = [sum(int(v) * pow(base, window - 1 - j, p) for j, v in enumerate(x[k : k + window])) % p for k in range(90 - window + 1)]
        assert substring_dedup.polynomial(x, base, window).tolist() == want


# --- 12 -----------------------------------------------------------------------------------------------


def naive_kmeans(rows, k, rounds, dims, scale=64, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) and abs(x * scale) < ball_kmeans.LARGEST for x in v):
            kept.append((i, tuple(int(np.floor(float(x) * scale)) for x in v)))
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [tuple(sum(x) // len(members[n]) for x in zip(*members[n], strict=True)) if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), list(centroids[c])) for i, d, c in found)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumns({"q": F.lit(1), "cluster": F.lit(7), "id": F.lit("x")})


def clusters(df, **options):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid) for r in ball_kmeans.clustered(df, **options).collect())


@pytest.mark.parametrize(("dims", "k", "spread"), [(2, 5, 3.0), (3, 16, 0.2), (8, 4, 30.0)])
def test_clusters_equal_brute_force(spark, dims, k, spread):
    rnd = random.Random(dims)
    centres = [[rnd.gauss(0, spread) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [float(np.float32(c + rnd.gauss(0, 0.3))) for c in rnd.choice(centres)], 0) for i in range(150)]
    rows += [(i, rows[0][1], 0) for i in range(150, 190)]  # a group of copies
    rows += [(None, rows[3][1], 0), (7, rows[9][1], 0), (900, None, 0), (901, [1.0] * (dims - 1), 0), (902, [float("nan")] * dims, 0), (903, [float("inf")] + [0.0] * (dims - 1), 0), (904, [None] + [0.0] * (dims - 1), 0), (905, [3e9] * dims, 0)]
    assert clusters(vectors(spark, rows), k=k, dims=dims) == naive_kmeans([(i, v) for i, v, _ in rows], k, 3, dims)


def test_ties_empty_clusters_and_few_vectors(spark):
    rows = [(i, [float(x), 0.0], 0) for i, x in enumerate([0, 0, 0, 1, 2, 2, 4, -4])]
    for k in (2, 3, 8, 20):
        assert clusters(vectors(spark, rows, "double"), k=k, dims=2, scale=1) == naive_kmeans([(i, v) for i, v, _ in rows], k, 3, 2, 1)
    same = [(i, [5.0, 5.0], 0) for i in range(6)]  # equal starts: the first takes all, the others stay empty
    assert clusters(vectors(spark, same), k=4, dims=2) == naive_kmeans([(i, v) for i, v, _ in same], 4, 3, 2)
    assert clusters(vectors(spark, []), dims=2) == []
    assert [r.cluster for r in ball_kmeans.clustered(vectors(spark, [(None, [1.0, 1.0], 0)]), dims=2).collect()] == [None]


def test_balls_compare_only_what_matters(monkeypatch):
    rnd = np.random.default_rng(3)
    centroids = [(0, 0), (1000, 0), (0, 1000), (5000, 5000)]
    x = np.concatenate([rnd.integers(-30, 30, (200, 2)) + np.array(c) for c in centroids])
    own = np.repeat(np.arange(4), 200)
    near = ball_kmeans.neighbours(centroids, [ball_kmeans.twice_radius_squared(2000, 0)] * 4)
    assert near == [[], [], [], []]  # no ball reaches another
    asked = []
    real = ball_kmeans.distances
    monkeypatch.setattr(ball_kmeans, "distances", lambda a, c: asked.append(len(a)) or real(a, c))
    cluster, distance = ball_kmeans.assigned(x, own, np.array(centroids), ball_kmeans.neighbours(centroids, [None] * 4))
    assert (cluster == own).all() and sum(asked) == len(x)  # all lie in the stable cores, whatever the neighbours
    assert (distance == ((x - np.array(centroids)[own]) ** 2).sum(axis=1)).all()
    for g, w in ((0, 0), (1, 1), (7, 9), (10**12, 3)):
        assert ball_kmeans.twice_radius_squared(g, w) >= 4 * (g**0.5 + w**0.5) ** 2 - 1e-3


# --- 13 -----------------------------------------------------------------------------------------------


def naive_alignment(rows):
    """Whole texts by both tokenizers, then every pair of tokens within a group."""
    a_of = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_of.encode_special_tokens = True
    b_of = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    alphabet = token_alignment._byte_alphabet()
    b_bytes = lambda i: bytes([int(b_of.id_to_piece(i)[3:5], 16)]) if b_of.is_byte(i) else b_of.id_to_piece(i).replace("▁", " ").encode()
    placed = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
    out, counts = [], Counter()
    for i, t in rows:
        raw = (" " + (t or "")).encode()
        a, b = (a_of.encode(" " + t, add_special_tokens=False).ids, b_of.encode(t)) if t else ([], [])
        x, y = [bytes(alphabet[c] for c in a_of.id_to_token(k)) for k in a], [b_bytes(k) for k in b]
        if not t or b"".join(x) != raw or b"".join(y) != raw:
            out.append((i, [], [], [], []))
            continue
        pa, pb = placed(x), placed(y)
        cuts = sorted({e for _, e in pa} & {e for _, e in pb})
        groups, links = [], []
        for begin, end in zip([0, *cuts], cuts, strict=False):
            own = lambda p, ids: [(s, e, k) for (s, e), k in zip(p, ids, strict=True) if begin <= s < end]  # noqa: B023, E731
            ga, gb = own(pa, a), own(pb, b)
            groups.append(f"{','.join(str(k) for *_, k in ga)}|{','.join(str(k) for *_, k in gb)}")
            links += [(p, q) for s, e, p in ga for u, v, q in gb if s < v and u < e]
        counts.update(set(links))
        out.append((i, a, b, groups, links))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    return sorted(
        (str(i), len(a), len(b), len(g), len(x), sum(counts[k] == best[k[0]] for k in x), sum(counts[k] for k in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, a, b, g, x in out
    )


ODD = [" ", "  a  b\n\n c \n d\t e  f　\n g", "\n", "\nx\n y \n\n z", "a ▁ b", "<s> <|endoftext|> </s><unk>", "\x1c \x1c\n\x00 \x07x", "é ﬁ 😀 日本語 テスト", "a" * 3000, "   \n\r\n x\r\n y", "\x85 q\x85\n", "don't I'll 'tis 12345 3.14 --- ... #!?", "x\xa0 y  z  w"]


def test_alignment_equals_brute_force(spark, tiny):
    texts = [*HARD[:7], *HARD[8:], *ODD, *ODD[:3], *(r.text for r in queries.table(spark, tiny, "documents").orderBy("doc_id").limit(25).collect())]
    ids = [None, None, 7, 7, *range(3, len(texts) - 1)]
    df = clashing(docs(spark, texts, ids)).withColumns({"block": F.lit(1), "seg": F.lit(2), "refs": F.lit(3)})
    got = token_alignment.alignment(df).collect()
    shown = sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)
    assert shown == naive_alignment(list(zip(ids, texts, strict=True)))


def test_alignment_at_its_edges(spark, monkeypatch):
    assert token_alignment.alignment(docs(spark, [])).count() == 0
    texts = ["same words here", "same words here", None, "", " ".join(f"w{i}é" for i in range(20_000))]
    want = naive_alignment([(i, t) for i, t in enumerate(texts[:4])])
    small = lambda: sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in token_alignment.alignment(docs(spark, texts[:4])).collect())
    assert small() == want
    monkeypatch.setattr(token_alignment, "BROADCAST_PAIRS", 0)  # the way beyond the bound
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 10)
    assert small() == want
    monkeypatch.undo()
    r = token_alignment.documents(docs(spark, texts[4:]), whole=True).first()
    assert r.groups_sha256.count(";") + 1 == r.n_groups > 20_000 and sum(r.counts) == r.n_links
    spans = token_alignment.pair_counts(token_alignment.documents(docs(spark, texts[:2])))
    assert {r["count"] for r in spans.collect()} == {2} and spans.where("best").count() > 0


def test_segments_make_up_the_text():
    for t in [*filter(None, HARD), *ODD]:
        found = token_alignment.segments(t)
        assert "".join(found) == " " + t and all(s[0] in " \n" for s in found)
    assert token_alignment.segments("a b\nc  d \n e") == [" a", " b", "\nc", "  d", " \n e"]


def test_keys_stand_for_segments():
    seen = {}
    for t in [*filter(None, HARD), *ODD]:
        found = token_alignment.keys(t)
        assert [token_alignment.segment_of(k) for k in found] == token_alignment.segments(t)
        assert all(seen.setdefault(token_alignment.segment_of(k), k) == k for k in found)


def test_segments_are_read_together(monkeypatch):
    """op13's budget: one call of A for a batch of segments, not one each; the same tokens as one by one."""
    both = token_alignment.Pair(*(public_tokenizers.path(v) for v in (token_alignment.A_VOCABULARY, token_alignment.B_VOCABULARY)))
    plain = list(dict.fromkeys(s for i in range(500) for s in token_alignment.segments(f"w{i}é, don't\n{i}日本")))
    odd = list(dict.fromkeys(s for t in [*filter(None, HARD), *ODD] for s in token_alignment.segments(t)))
    calls, one = [], both.a
    monkeypatch.setattr(both, "a", lambda t: calls.append(t) or one(t))
    both.coded(plain)
    assert len(calls) == 1 < len(plain)
    for parts in (plain, odd, [*plain, *odd], [" ▁"]):
        n, tokens = both.coded(parts)
        alone = [both.coded([p]) for p in parts]
        assert n.tolist() == [int(x[0]) for x, _ in alone] and tokens.tolist() == [t for _, x in alone for t in x.tolist()]
    assert both.coded([" ▁"])[0].tolist() == [0]  # not the segment's bytes
