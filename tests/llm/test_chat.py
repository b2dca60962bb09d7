import hashlib
from itertools import combinations

from pyspark.sql import functions as F

from wattframe.llm.chat import LAYOUTS, SAMPLE_TEXT, canonical_turns, chat_digests, field_paths, fingerprint, format_chats, parse, read_turns, with_sample

NASTY = ["", "\\", "\\b", "###", "####", "\\###", "</turn>", "</turn>\n", "\\h\\e\\b", ": ", "a: b", "### user: x</turn>\n", "é𝄞\x00 end", "#" * 7, "<</turn>>", SAMPLE_TEXT, "line\nline", "\\\\c"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def wanted(turns):
    """Row of the digests of a list of (role, text)."""
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def digests(records, **how):
    rows = chat_digests(format_chats(canonical_turns(records), **how)).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_any_text_and_role_comes_back(spark):
    rows = [(i, k, role, text) for i, role in enumerate(["assistant", "user", *NASTY]) for k, text in enumerate(NASTY)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {i: wanted([(r, t) for c, _, r, t in rows if c == i]) for i in {r[0] for r in rows}}
    assert digests(table) == expected == digests(table, chunk_chars=30)
    assert format_chats(canonical_turns(table), chunk_chars=30).count() > 3 * len(expected)
    chunk = format_chats(canonical_turns(table.where("conv_id = 0"))).first()
    assert [t for _, t in parse(chunk.text)] == NASTY and len(chunk.loss) == len(NASTY)
    back = read_turns(format_chats(canonical_turns(table))).collect()
    assert sorted((r.conv_id, r.place, r.role, r.text) for r in back) == sorted(rows)


def test_layouts_of_one_table(spark):
    """Records of all layouts in one table, as a reader of mixed files merges them."""
    lines = [
        '{"conv_id": 1, "turn": 0, "role": "user", "text": "q"}', '{"conv_id": 1, "turn": 1, "role": "assistant", "text": "a"}', '{"conv_id": 1, "turn": 2, "role": "user"}',
        '{"conv_id": 2, "messages": [{"role": "user", "content": "q"}, {"role": "Bot", "content": null}, {"role": "user", "content": "again"}]}',
        '{"conv_id": 3, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}',
        '{"conv_id": 4, "instruction": "do", "input": "this", "output": "done"}', '{"conv_id": 5, "instruction": "do", "input": "", "output": "done", "system": "be"}',
        '{"conv_id": 6, "prompt": "p", "response": "r"}', '{"conv_id": 7, "prompt": "p", "completion": "c", "system": "s"}', '{"conv_id": 8, "question": "q", "answer": "a", "context": "c"}',
        '{"conv_id": 9, "data": {"question": "q", "answer": "a"}, "note": "surplus"}', '{"conv_id": 10, "messages": []}', '{"conv_id": 11, "prompt": "p", "response": null}',
    ]
    table = spark.createDataFrame([(x,) for x in lines], "line string")
    schema = (
        "conv_id long, turn long, role string, text string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, instruction string, "
        "input string, output string, system string, prompt string, response string, completion string, question string, answer string, context string, data struct<question:string,answer:string>, note string"
    )
    records = table.select(F.from_json("line", schema).alias("r")).select("r.*")
    user, bot = (lambda t: ("user", t)), (lambda t: ("assistant", t))
    expected = {
        1: [user("q"), bot("a"), user("")], 2: [user("q"), bot(""), user("again")], 3: [user("q"), bot("a")], 4: [user("do\n\nthis"), bot("done")],
        5: [("system", "be"), user("do"), bot("done")], 6: [user("p"), bot("r")], 7: [("system", "s"), user("p"), bot("c")], 8: [user("c\n\nq"), bot("a")], 9: [user("q"), bot("a")],
        11: [user("p"), bot("")],
    }
    got = digests(records)
    # An empty list fills no field, so the record gets the first layout: one empty turn.
    assert got.pop(10) == wanted([("", "")]) and got == {i: wanted(t) for i, t in expected.items()}
    names = {r.conv_id: r.layout for r in canonical_turns(records).collect()}
    assert [names[i] for i in (1, 2, 3, 4, 6, 7, 8, 9)] == [x.name for x in LAYOUTS]


def test_fingerprints_are_apart_and_equal_sparks(spark):
    seen = [f for layout in LAYOUTS for f in layout.fingerprints()]
    assert len(seen) == len(set(seen)) and all(not (a.fingerprints() & b.fingerprints()) for a, b in combinations(LAYOUTS, 2))
    schema = spark.sql("SELECT 1 AS id, array(struct('a' AS role, 'b' AS content)) AS messages, struct(array(1) AS z) AS y").schema
    assert field_paths(schema) == ["id", "messages[].role", "messages[].content", "y.z[]"]
    row = canonical_turns(spark.sql("SELECT 1L AS conv_id, array(struct('a' AS role, 'b' AS content)) AS messages")).first()
    assert row.fingerprint == fingerprint({"messages[].role", "messages[].content"})


def test_hard_rows(spark):
    """Nulls anywhere, ties, repeated rows, long texts, clashing extra columns, empty tables and tables of no layout."""
    long_text = "wort </turn> ### \\ " * 20_000
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, "user", "b"), (1, 0, "user", "a"), (2, 5, "assistant", long_text), (None, None, None, None), (None, 1, "user", "n"), (3, 1, "user", "r"), (3, 1, "user", "r")]
    table = spark.createDataFrame([(*r, "x", 1, ["m"], "p") for r in rows], "conv_id long, turn long, role string, text string, piece string, chunk int, messages array<string>, prompt string")
    expected = {
        1: wanted([("user", ""), ("", "x"), ("user", "a"), ("user", "b")]), 2: wanted([("assistant", long_text)]), None: wanted([("", ""), ("user", "n")]), 3: wanted([("user", "r")] * 2),
    }
    assert digests(table) == expected
    clashing = table.toDF("conv_id", "turn", "role", "text", "Text", "TURN", "messages", "_0")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert digests(clashing) == expected
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert digests(table.limit(0)) == {} and digests(spark.range(3).withColumnRenamed("id", "conv_id")) == {i: wanted([]) for i in range(3)}
    assert digests(with_sample(spark, table.limit(0))) == {-7: wanted([("user", SAMPLE_TEXT), ("assistant", SAMPLE_TEXT)])}


def test_one_conversation_over_many_tasks(spark):
    """The turns of a conversation that holds nearly all rows are written by several tasks and come back in order."""
    turns = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(F.lit(-1)).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = format_chats(canonical_turns(turns), chunk_chars=10_000)
        assert chunks.where("conv_id = -1").select(F.shiftright("chunk", 32)).distinct().count() > 2
        found = {r.conv_id: r for r in chat_digests(chunks).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (found[-1].n_turns, found[-1].turns_sha256) == wanted([("assistant", str(i)) for i in range(40_000) if i % 50])[:2] and len(found) == 801
