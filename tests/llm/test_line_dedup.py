import random

from lexigrid.llm import line_dedup as ld

from brute import dropped_lines

SCHEMA = "doc_id long, text string, lines string, doc int, template int, leaf long, line int, keeper int, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "l", 1, 2, 3, 4, 5, None if t is None else len(t)) for i, t in rows], SCHEMA)


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    names = ["ada", "bob", "cyd", "dan", "eve"]
    shapes = [
        lambda: f"Session {rng.randint(1, 9999)} opened for user {rng.choice(names)} from host a",
        lambda: "Subscribe to our newsletter for more stories like this one",
        lambda: f"Posted on {rng.randint(1, 30)} May 2020 by {rng.choice(names)} in news",
        lambda: " ".join(rng.choices("red green blue cyan pink grey teal".split(), k=rng.randint(1, 9))),
        lambda: "",
        lambda: "ok then",
    ]
    return [(i, "\n".join(rng.choice(shapes)() for _ in range(rng.randint(1, 9)))) for i in range(n)]


def test_equals_brute_force(spark):
    rows = corpus()
    gone = dropped_lines(rows)
    got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    assert sum(map(len, gone.values())) > 50
    for i, text in rows:
        lines = text.split("\n")
        assert got[i].text == "\n".join(x for no, x in enumerate(lines) if no not in gone.get(i, ()))
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(gone.get(i, ())))


def test_first_copy_stays_and_rare_lines_stay(spark):
    note = "this notice is printed in every single document"
    rows = [(i, f"{note}\nstory{'abcdefgh'[i]} alpha beta gamma delta") for i in range(6)] + [(10, "twice seen line here\nx"), (11, "twice seen line here\ny")]
    got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 6))
    assert got[10].n_dropped == got[11].n_dropped == 0


def test_documents_without_a_word_left_go(spark):
    rows = [(i, "the very same line here") for i in range(4)] + [(8, ""), (9, None), (None, "the very same line here")]
    docs = frame(spark, rows)
    left = ld.drop_recurring_lines(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 0), (False, 8), (False, 9), (True, 0)]


def test_odd_rows(spark):
    long = "\n".join(f"line number {'x' * (i % 7)} has {i} words" for i in range(30_000)) + "\n" + "w " * 100_000
    rows = [(1, None), (None, None), (2, ""), (3, "\n\n\n"), (4, long), (5, "a b c"), (5, "a b c"), (6, "A B  C!"), (7, "a b c\r")]
    got = ld.dedup_lines(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_lines is None and by[1].text is None and by[2].n_lines == 1 and by[3].n_lines == 4
    assert by[4].text == long  # recurring within one document is not recurring across documents
    assert by[5].n_dropped == 0 and by[6].n_dropped == 1 and by[7].n_dropped == 1
    empty = frame(spark, [])
    assert ld.dedup_lines(empty).count() == 0 and ld.drop_recurring_lines(empty).count() == 0


def test_other_columns_follow(spark):
    rows = [(i, f"the very same line here\nkept {i} {'abc'[i]}") for i in range(3)]
    got = {r.doc_id: r for r in ld.drop_recurring_lines(frame(spark, rows)).collect()}
    assert got[2].text == "kept 2 c" and got[2].n_chars == 8 and got[2].lines == "l" and got[0].n_chars == len(rows[0][1])


def test_long_lines_recur_from_two_documents(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr")  # 64 words
    rows = [(1, f"own opening words of one\n{passage}"), (2, f"{passage}\nsomething else entirely in another"), (3, "seven words that only two documents share"), (4, "seven words that only two documents share\nz")]
    got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "something else entirely in another"
    assert got[3].n_dropped == got[4].n_dropped == 0


def test_short_lines_take_part(spark):
    rows = [(i, f"les.\nand ornd.\n{i}{i}\nown{'abcd'[i]}") for i in range(4)]
    got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"{i}{i}\nown{'abcd'[i]}" for i in range(1, 4))


def test_documents_are_read_three_times(spark):
    rows = [(i, f"the very same line here\nkept {i} {'abcdefgh'[i]}") for i in range(8)]
    seen = spark.sparkContext.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    docs = spark.createDataFrame(spark.sparkContext.parallelize(frame(spark, rows).collect(), 2).map(counted), SCHEMA)
    assert sum(r.n_dropped for r in ld.dedup_lines(docs).collect()) == 7
    assert seen.value == 3 * len(rows)  # for templates, for their lines, for the texts; once more would hash all lines again


def test_leaves_across_batches_equal_brute_force(spark):
    rows = corpus(120, 9)
    gone = dropped_lines(rows)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in (1, 2, 7):
            spark.conf.set(key, size)
            got = {r.doc_id: r for r in ld.dedup_lines(frame(spark, rows).repartition(5)).collect()}
            assert {i: r.n_dropped for i, r in got.items()} == {i: len(gone.get(i, ())) for i, _ in rows}
    finally:
        spark.conf.set(key, before)
