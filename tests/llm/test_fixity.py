from wattframe.llm.fixity import audit

SCHEMA = "page_id long, record string, digest string, slot int"


def test_locates_every_difference_and_nothing_else(spark):
    good = [(i, f"record {i}", None, 1) for i in range(0, 30_000, 3)]
    bad = [(i, r + "!" if i in (0, 4095, 4098, 29_997) else r, d, s) for i, r, d, s in good if i not in (300, 9_000)] + [(1, "new", None, 1)]
    got = {r.page_id: (r.status, r.segment) for r in audit(spark.createDataFrame(good, SCHEMA), spark.createDataFrame(bad, SCHEMA)).collect()}
    assert got == {0: ("corrupt", 0), 4095: ("corrupt", 0), 4098: ("corrupt", 1), 29_997: ("corrupt", 7), 300: ("missing", 0), 9_000: ("missing", 2), 1: ("extra", 0)}


def test_offsets_follow_the_primary(spark):
    good = spark.createDataFrame([(5, "abcde", None, 1), (1, "é", None, 1), (9, "xy", None, 1)], SCHEMA)
    bad = spark.createDataFrame([(5, "abcdE", None, 1), (1, "é", None, 1), (9, "xy", None, 1)], SCHEMA)
    row = audit(good, bad).first()
    assert (row.page_id, row.start, row.stop, row.status) == (5, 2, 7, "corrupt") and row.expected != row.found


def test_hard_rows(spark):
    rows = [(None, "a", None, 1), (None, None, None, 1), (2, None, None, 1), (2, "x", None, 1), (2, "y", None, 1), (-7, "", None, 1), (3, "z" * 100_000, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert audit(df, spark.createDataFrame(rows[::-1], SCHEMA)).count() == 0
    changed = spark.createDataFrame([(None, "b", None, 1), *rows[1:4], (2, "w", None, 1), *rows[5:]], SCHEMA)
    assert {(r.page_id, r.status) for r in audit(df, changed).collect()} == {(None, "corrupt"), (2, "corrupt")}
    assert audit(df.limit(0), df.limit(0)).count() == 0 and {r.status for r in audit(df, df.limit(0)).collect()} == {"missing"}
