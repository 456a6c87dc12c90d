import random

from sievelake.llm import decontaminate as D


def least_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("abc")
        elif kind == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, rng.choice("abc"))
    return "".join(out)


def test_matches_are_those_of_brute_force():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    for _ in range(400):
        item = D.normalised(word(rng.randint(25, 70)))
        if len(item) < D.MIN_CHARS:
            continue
        text = D.normalised(word(rng.randint(0, 50)) + edited(rng, item, rng.randint(0, 9)) + word(rng.randint(0, 50)))
        got = D.Matcher([(7, item)]).matches(text)
        best = least_distance(item, text)
        assert bool(got) == (best <= D.budget(item))
        if got:
            _, found, begin, end = got[0]
            assert found == best == distance(item, text[begin:end])


def test_pieces_cover_the_item():
    for n in range(20, 120):
        item = "".join(chr(97 + i % 26) for i in range(n))
        cut = D.pieces(item)
        assert "".join(p for _, p in cut) == item and len(cut) == D.budget(item) + 1


def test_frames(spark):
    item = "The quick brown fox jumps over the lazy dog, again and again and again."
    docs = spark.createDataFrame(
        [
            (1, "Before. " + item.upper() + " After.", 0), (2, "the quick brown fax jumps over the lazy  dog -- again and agin and again", 0),
            (3, "nothing here", 0), (4, None, 0), (5, "", 0), (9, "Short!", 0), (None, item, 0), (6, "filler words " * 20_000 + item, 0), (1, item, 0), (7, "the quick brown fox jumps", 0),
        ],
        "doc_id bigint, text string, item_id int",
    )
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "short"), (14, item)], "item_id bigint, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.distance) for r in D.leaks(docs, bench).collect())
    assert got == [(-1, 10, 0), (-1, 14, 0), (1, 10, 0), (1, 10, 0), (1, 14, 0), (1, 14, 0), (2, 10, 2), (2, 14, 2), (6, 10, 0), (6, 14, 0), (9, 13, 0)]
    assert D.leaks(docs, bench.limit(0)).collect() == []
    assert D.leaks(docs.limit(0), bench).collect() == []


def test_items_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 60)
    items = [(i, f"item number {i} with quite some words of its own {i * 7}") for i in range(12)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "xx " + t + " yy") for i, t in items], "doc_id bigint, text string")
    assert len(list(D.blocks(bench))) > 3
    exact = {(r.doc_id, r.item_id) for r in D.leaks(docs, bench).where("distance = 0").collect()}
    assert exact == {(i, i) for i, _ in items}


def test_stage_drops_leaks_and_keeps_columns(spark, tmp_path):
    item = "a sentence that is long enough to be a test item of its own right"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "x " + item, "p"), (1, "clean, but with the id of a leak", "s"), (2, "clean", "q"), (None, None, "r"), (None, item, "t")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, lang string, item_id int")
    out = D.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r.lang for r in out.collect()) == ["q", "r", "s"]
    assert D.stage(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_several_blocks_and_groups_find_the_same(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, D.leaks(docs, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 1500)
    monkeypatch.setattr(D, "GROUP_BYTES", 50_000)
    assert len(list(D.blocks(bench))) > 2
    assert whole and sorted(map(tuple, D.leaks(docs, bench).collect())) == whole
    assert D.decontaminate(docs, bench).count() == docs.count() - len({r[0] for r in whole})
