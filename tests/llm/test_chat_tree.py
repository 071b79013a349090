import random

from lexigrid.llm import chat_tree as ct

SCHEMA = "conv_id long, turn long, role string, text string, tokens string, node int, depth string, tree_id int, owner int, start int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 2, 3, 4) for r in rows], SCHEMA)


def conversations(n=40, seed=3):
    rng = random.Random(seed)
    out = {}
    for i in rng.sample(range(1000), n):
        path = [("system", rng.choice(["be kind", "be brief"]))] if rng.random() < 0.8 else []
        for d in range(rng.randint(1, 6)):
            path.append((["user", "assistant"][d % 2], rng.choice(["hello", "how are you?", "tell me more"])))
        out[i] = path
    return out


def brute(convs):
    """{tree: its tokens}, {conversation: places of its tokens}, by walking a trie depth first."""
    rendered = {c: [(s, ct.render(*s).tolist()) for s in path] for c, path in convs.items()}
    trees, places = {}, {}

    def walk(tree, members, depth, seen):
        done = [c for c in members if len(rendered[c]) == depth]
        for c in done:
            places[c] = (tree, list(seen))
        branches = {}
        for c in sorted(set(members) - set(done)):
            branches.setdefault(rendered[c][depth][0], []).append(c)
        for group in sorted(branches.values()):
            at = tree if depth else group[0]
            emitted = trees.setdefault(at, [])
            tokens = rendered[group[0]][depth][1]
            span = range(len(emitted), len(emitted) + len(tokens))
            emitted += tokens
            walk(at, group, depth + 1, [*seen, *span])

    walk(None, list(convs), 0, [])
    return trees, places


def check(rows, convs):
    trees, places = brute(convs)
    emitted = {}
    assert sorted(r.conv_id for r in rows) == sorted(convs)
    for r in sorted(rows, key=lambda r: (r.tree_id, r.segment, not r.tokens)):
        assert r.end == r.start + len(r.tokens)
        if r.tokens:
            assert r.start == len(emitted.setdefault(r.tree_id, []))
            emitted[r.tree_id] += r.tokens
        tree, want = places[r.conv_id]
        seen = [p for a in r.attends for p in range(a["first"], a["until"])] + list(range(r.start, r.start + len(r.tokens)))
        assert (tree, want) == (r.tree_id, seen)
        assert r.position_ids == list(range(len(seen)))[len(seen) - len(r.tokens) :]
    assert emitted == trees
    ends = {(r.tree_id, r.segment): r for r in rows if r.tokens}
    assert all(ends[r.tree_id, r.segment].start < r.end <= ends[r.tree_id, r.segment].end for r in rows)


def test_equals_a_walk_of_the_trie(spark):
    convs = conversations()
    rows = [(c, t, *s) for c, path in convs.items() for t, s in enumerate(path)]
    random.Random(1).shuffle(rows)
    got = ct.chat_trees(frame(spark, rows)).collect()
    check(got, convs)
    assert any(not r.tokens for r in got) and any(len(r.attends) > 1 for r in got)


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, None, "x"), (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, "judge", "ok"), (None, 0, "user", "lost"), (3, None, "user", "lost"),
        (4, 5, "user", "b"), (4, 5, "user", "a"), (5, 0, "user", "long " * 100_000), (6, 0, "user", "long " * 100_000),
    ]
    convs = {
        1: [("user", ""), ("", "x")], 2: [("user", ""), ("judge", "ok")], 4: [("user", "a"), ("user", "b")],
        5: [("user", "long " * 100_000)], 6: [("user", "long " * 100_000)],
    }
    got = ct.chat_trees(frame(spark, rows)).collect()
    check(got, convs)
    assert [r.conv_id for r in got if not r.tokens] == [6]
    assert ct.chat_trees(frame(spark, [])).count() == 0
    assert ct.chat_trees(frame(spark, [(None, None, None, None)])).count() == 0


def test_deeper_branches_first():
    sizes = [2, 3, 4, 5]
    a = ct.cut_path(7, [1, 1, 1, 7], sizes)
    b = ct.cut_path(5, [1, 1, 5, 5], sizes)
    key = lambda s: [(p["up"], p["owner"]) for p in s["place"]]
    assert key(a) < key(b) and a["ancestors"] == [{"owner": 1, "n": 9}] and b["first_position"] == 5
    c = ct.cut_path(9, [1, 1], [2, 3])
    assert (c["within"], c["first_position"], c["n_tokens"], c["ancestors"]) == (1, 5, 0, [{"owner": 1, "n": 5}])


def test_one_tree_is_spread_over_tasks(spark):
    """Thousands of conversations under one system prompt: no task orders them all."""
    n = 20_000
    rows = spark.range(n).selectExpr("id as conv_id", "explode(array(named_struct('t', 0L, 'r', 'system', 'x', 'be kind'), named_struct('t', 1L, 'r', 'user', 'x', concat('q', id)))) as s")
    table = rows.selectExpr("conv_id", "s.t as turn", "s.r as role", "s.x as text").repartition(8)
    # sizes of one file each, and no joining of small ranges
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = ct._segments(ct.materialize(ct._paths(table, ct.VOCABULARY), "paths"))
        placed = ct._placed(cut.filter("within is null"))
        got = sorted((r.segment, r.start, r.conv_id) for r in placed.collect())
        spread = cut.repartitionByRange("tree_id", "place").selectExpr("spark_partition_id() as p").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in spread) < n / 2
    assert [s for s, _, _ in got] == list(range(1, n + 1)) and [c for _, _, c in got] == list(range(n))
    sizes = {r.conv_id: r.n_tokens for r in cut.select("conv_id", "n_tokens").collect()}
    at = 0
    for _, start, c in got:
        assert start == at
        at += sizes[c]


def test_whole_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    convs = {}
    for r in sorted(table.collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text))
    check(ct.op7_chat_formatting(spark, sf_dir).collect(), convs)
