import random

import numpy as np

from sievelake.llm import golay_simhash as G
from sievelake.llm import near_dedup as N


def test_code_is_perfect():
    code = G.golay()
    weights = np.bitwise_count(code.errors[:, 0])
    assert weights.max() == 3 and (code.errors[:, 0] >= 0).all()
    words = np.arange(0, 1 << 23, 997)
    near = code.near(words)
    assert near[:, 0].min() >= 0 and near[:, 0].max() < 4096


def test_three_errors_always_share_a_key():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64)
    for one, other in ((x, y), (y, x)):
        left, right = [set() for _ in x], [set() for _ in x]
        for row, key in zip(*G.key_table(one, True), strict=True):
            left[row].add(key)
        for row, key in zip(*G.key_table(other, False), strict=True):
            right[row].add(key)
        assert all(a & b for a, b in zip(left, right, strict=True))


def reference_fingerprint(text):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fp = [reference_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return {(doc, fp[i], low[find(i)]) for i, (doc, _) in enumerate(rows)}


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["ab", "Cd", "é", "x", "yy", "ZZ"]) + str(rng.randrange(9)) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(base))
    for t in base[:20]:
        for _ in range(4):
            words = t.split()
            words[rng.randrange(len(words))] = "new"
            rows.append((len(rows), " ".join(words)))
    rows += [(900, None), (901, ""), (902, "\x0b\x1c"), (903, "one"), (904, "one"), (904, "one"), (905, "one two"), (906, "w " * 30_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, fp int")
    got = G.near_groups(docs).collect()
    assert len(got) == len(rows)
    assert {(r._id, r._fp & (2**64 - 1), r._component) for r in got} == brute(rows)


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1000), (1001, 1001)], "a bigint, b bigint")
    got = {r.node: r.component for r in G.components(edges).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == 1000 and len(got) == n + 3


def test_empty_table(spark):
    assert G.near_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_near_dedup_drops_copies_and_keeps_the_rest(spark):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    clean = [(i, text(80)) for i in range(40)]
    copies = []
    for i, t in clean[:15]:
        words = t.split()
        words[40] = "changed"
        copies.append((100 + i, " ".join(words)))
    other = [(200, None), (201, ""), (202, ""), (None, text(10)), (203, "short text"), (204, "other text")]
    docs = spark.createDataFrame([(*r, "c") for r in clean + copies + other], "doc_id bigint, text string, component string")
    out = N.near_dedup(docs)
    assert out.columns == docs.columns
    left = {r.doc_id for r in out.collect()}
    assert {i for i, _ in clean} <= left and {200, 201, 202, 203, 204, None} <= left
    assert not left & {i for i, _ in copies}
    assert N.near_dedup(docs.limit(0)).collect() == []


def test_shingles_have_five_words_and_bitmaps_rule_out_no_copy():
    assert len(N.hashes("a b c d e f g")) == 3 and len(N.hashes("A b")) == 1 and not len(N.hashes(" "))
    assert len(set(N.hashes("a b c d e f g")) & set(N.hashes("A B C D E F x"))) == 2
    rng = random.Random(8)
    for n in (1, 2, 5, 40, 700, 9000):
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        for share in (0.02, 0.1, 0.5):
            more = [rng.getrandbits(64) for _ in range(rng.randrange(n))]
            b = np.unique(np.array([rng.getrandbits(64) if rng.random() < share else int(x) for x in a] + more, np.uint64))
            assert N.differences(N.bitmap(a), N.bitmap(b)) <= len(set(a) ^ set(b))
        assert not N.differences(N.bitmap(a), N.bitmap(a))


def connected(n, pairs):
    group = list(range(n))
    for a, b in pairs:
        x, y = group[a], group[b]
        group = [min(x, y) if g in (x, y) else g for g in group]
    return group


def test_a_forest_connects_what_all_links_of_a_bucket_connect(monkeypatch):
    rng = np.random.default_rng(5)
    centers = rng.integers(0, 2**63, 6).astype(np.uint64)
    fps = np.array([centers[i % 6] ^ np.uint64(sum({1 << int(b) for b in rng.integers(0, 64, 2)})) for i in range(120)])
    keys = np.sort(rng.integers(0, 4, 120))
    want = connected(120, [(i, j) for i in range(120) for j in range(i) if keys[i] == keys[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= 3])
    for small in (1, 8, 200):
        monkeypatch.setattr(G, "SMALL", small)
        assert connected(120, zip(*[x.tolist() for x in G.bucket_links(keys, fps, 3)], strict=True)) == want


def test_large_buckets_are_dealt_without_loss(spark, monkeypatch):
    rng = random.Random(11)
    fps = [0]
    for _ in range(399):  # a tree of small steps: large buckets, one component
        fps.append(rng.choice(fps) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp bigint, node bigint")
    want = connected(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    monkeypatch.setattr(G, "BUCKET", 16)
    got = {r.node: r.component for r in G.components(G.links(nodes)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_rows_without_id_link_others(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = spark.createDataFrame([(5, base), (None, base), (None, None), (7, "")], "doc_id bigint, text string")
    got = {(r._id, r._component) for r in G.near_groups(docs).collect()}
    assert got == {(5, 5), (None, 5), (None, 7), (7, 7)}
