import random

import pytest

from sievelake.llm import near_dedup as N


def brute(rows):
    """Smallest id of every document's group, by the similarity of all pairs."""
    def shingles(t):
        words = t.lower().split()
        width = min(5, len(words))
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    group = {i: i for i, _ in rows}
    for x, (a, left) in enumerate(sets):
        for b, right in sets[x + 1 :]:
            if group[a] != group[b] and 5 * len(left & right) >= 4 * max(1, len(left | right)):
                low, high = sorted((group[a], group[b]))
                group = {k: low if v == high else v for k, v in group.items()}
    return {k: v for k, v in group.items() if list(group.values()).count(v) > 1}


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r._id: r.keep.id for r in N.near_groups(docs).collect()}


def text(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(n)]


def test_all_groups_of_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for n in (3, 8, 40, 100, 300, 700):
        for _ in range(6):
            words = text(rng, n)
            rows.append((len(rows), " ".join(words)))
            for share in (0.005, 0.01, 0.02, 0.03):  # on either side of the bound
                changed = [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
                rows.append((len(rows), " ".join(changed)))
    want = brute(rows)
    assert want and found(spark, rows) == want


def test_same_words_in_other_order_hide_no_copies(spark):
    rng = random.Random(2)
    words = text(rng, 200)
    shuffled = rng.sample(words, len(words))
    near = words[:]
    near[100], near[101] = near[101], near[100]
    rows = [(1, " ".join(shuffled)), (2, " ".join(words)), (3, " ".join(near))]
    assert found(spark, rows) == {2: 2, 3: 2}


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_one_line_in_all_documents_and_templates(spark, monkeypatch, at_once):
    """Large buckets: a common passage, of documents some of which are alike; in few rounds or many."""
    monkeypatch.setattr(N, "AT_ONCE", at_once)
    rng = random.Random(3)
    line = text(rng, 60)
    rows = [(i, " ".join(line + text(rng, rng.randint(5, 40)))) for i in range(120)]
    base = text(rng, 150)
    for i in range(200, 320):
        words = base[:]
        for at in rng.sample(range(150), 3):
            words[at] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(400 + i, t.upper() + " ") for i, t in rows[:5]]
    assert found(spark, rows) == brute(rows)


def test_repeated_ids_nulls_and_other_columns(spark):
    rng = random.Random(5)
    a, b = text(rng, 100), text(rng, 90)
    near = [*a[:-1], "end"]
    rows = [(1, a, "x"), (1, b, "y"), (2, near, "z"), (None, near, "n"), (3, b + ["more"], "m"), (4, None, "e"), (5, [], "f"), (5, [], "g")]
    docs = spark.createDataFrame([(i, t if t is None else " ".join(t), c, "own") for i, t, c in rows], "doc_id bigint, text string, lang string, _gone string")
    out = N.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(r.lang for r in out.collect()) == ["e", "f", "g", "x", "y"]
