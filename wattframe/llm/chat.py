"""Chat formatting: records of any known layout become turns, turns one marked-up text with a loss mask, and that text can be read back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

CHUNK_CHARS = 1 << 20  # a formatted conversation beyond this continues in a further row
LOSS_ROLE = "assistant"
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
# What marks turns is written otherwise inside texts and roles; every escape is a backslash and one letter, so no mark can occur between marks.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
_WRITTEN = {new: old for old, new in ROLE_ESCAPES}
_ESCAPED = re.compile(r"\\[bhec]")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """How the fields of a record become turns.

    Paths name nested fields, `a.b` within a struct and `a[].b` within the structs of an array. A turn is (role, text paths): the role is a name, or a path after "@"; several text
    paths are joined by an empty line. With `each`, the turns are those of every element of that array. `order` is a path that places a record among those of its conversation.
    """

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...]
    each: str | None = None
    optional: tuple[str, ...] = ()
    order: str | None = None
    aliases: bool = False

    @property
    def paths(self) -> frozenset[str]:
        used = {p for role, texts in self.turns for p in (*texts, *([role[1:]] if role.startswith("@") else []))}
        return frozenset(used | ({self.order} if self.order else set()))

    @property
    def required(self) -> frozenset[str]:
        return self.paths - set(self.optional)

    def fingerprints(self) -> set[int]:
        """Of the required paths with every choice of optional ones."""
        extra = sorted(set(self.optional) & self.paths)
        return {fingerprint(self.required | set(some)) for k in range(len(extra) + 1) for some in combinations(extra, k)}


# In order of precedence where a record's own fingerprint is not known.
LAYOUTS = (
    Layout("turn rows", (("@role", ("text",)),), order="turn"),
    Layout("messages", (("@messages[].role", ("messages[].content",)),), each="messages", aliases=True),
    Layout("from and value", (("@conversations[].from", ("conversations[].value",)),), each="conversations", aliases=True),
    Layout("instruction", (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("prompt and response", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("prompt and completion", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("question and answer", (("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("nested question", (("user", ("data.question",)), ("assistant", ("data.answer",)))),
)


def fingerprint(paths) -> int:
    """64-bit hash of a set of field paths, as Spark's xxhash64 computes it."""
    value = xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of all leaves of a schema."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


class _Record:
    """Fields of a table by path; columns are taken by position, so names that clash in another case do no harm."""

    def __init__(self, table: DataFrame):
        self.rows = table.toDF(*[f"_{i}" for i in range(len(table.columns))])
        self.at = {}
        for i, name in enumerate(table.columns):
            self.at.setdefault(name, f"_{i}")
        known = {p for layout in LAYOUTS for p in layout.paths}
        self.paths = sorted(known & set(field_paths(table.schema)))

    def value(self, path: str, element: Column | None = None) -> Column:
        """The field; below an array, that of one element."""
        if "[]." in path:
            parts = path.split("[].")[1].split(".")
            return reduce(lambda c, name: c.getField(name), parts, element)
        top, *parts = path.split(".")
        return reduce(lambda c, name: c.getField(name), parts, F.col(self.at[top]))

    def array(self, path: str) -> Column:
        return self.value(path.split("[]")[0])

    def present(self, path: str) -> Column:
        if "[]." in path:
            return F.coalesce(F.exists(self.array(path), lambda x: self.value(path, x).isNotNull()), F.lit(False))
        return self.value(path).isNotNull()

    def fingerprint(self) -> Column:
        """Hash of the paths under which this record holds something."""
        found = F.array_compact(F.array(*[F.when(self.present(p), F.lit(p)) for p in self.paths])) if self.paths else F.array().cast("array<string>")
        return F.xxhash64(F.array_join(found, "\n"))

    def layout(self, layouts: tuple[Layout, ...]) -> Column:
        """Number of the layout: by fingerprint, else the one of which the record has most fields, if the table has all its required ones."""
        fitting = [i for i, x in enumerate(layouts) if x.required <= set(self.paths)]
        mark = F.col("_fingerprint")
        chosen = F.lit(None).cast("int")
        if fitting:
            held = {i: sum((self.present(p).cast("int") for p in sorted(layouts[i].paths & set(self.paths))), F.lit(0)) for i in fitting}
            most = F.greatest(*held.values(), F.lit(0))
            for i in reversed(fitting):
                chosen = F.when(held[i] == most, F.lit(i)).otherwise(chosen)
        for i in reversed(fitting):
            chosen = F.when(mark.isin(sorted(layouts[i].fingerprints())), F.lit(i)).otherwise(chosen)
        return chosen

    def turns(self, layout: Layout) -> Column:
        """array<struct<role, text>> of a record of this layout; an optional turn without text is none."""
        texts = lambda paths, x: [self.value(p, x).cast("string") for p in paths if p in self.paths]

        def turn(role: str, paths: tuple[str, ...], x: Column | None) -> Column:
            values = texts(paths, x)
            text = values[0] if len(values) == 1 else F.concat_ws("\n\n", *[F.when(v != "", v) for v in values])
            name = F.lit(role)
            if role.startswith("@"):
                name = F.coalesce(self.value(role[1:], x).cast("string"), F.lit(""))
                if layout.aliases:
                    low = F.lower(name)
                    name = F.coalesce(F.create_map(*[F.lit(s) for pair in ALIASES.items() for s in pair])[low], name)
            made = F.struct(name.alias("role"), F.coalesce(text, F.lit("")).alias("text"))
            optional = set(paths) <= set(layout.optional)
            return F.when(F.coalesce(values[0], F.lit("")) != "", made) if optional else made

        kept = [(role, paths) for role, paths in layout.turns if any(p in self.paths for p in paths)]
        if layout.each:
            return F.flatten(F.transform(self.array(f"{layout.each}[]"), lambda x: F.array(*[turn(role, paths, x) for role, paths in kept])))
        return F.array_compact(F.array(*[turn(role, paths, None) for role, paths in kept]))


def canonical_turns(records: DataFrame, id_column: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, fingerprint, layout, turn, record, place, role, text: one row per turn, in the order (turn, record, place, role, text), nulls first.

    Every record is mapped by the hash of the nested field paths that it fills; a hash that is not registered (a null or a surplus field) takes the layout of which the record fills
    most fields among those that the table's schema holds. A record without layout or turns gives one row with null role and text, so no conversation is lost. Null roles and texts become
    empty; null ids are one conversation; repeated rows are repeated turns; other columns are not read. An empty table gives an empty result.
    """
    record = _Record(records)
    rows = record.rows.withColumn("_fingerprint", record.fingerprint())
    rows = rows.withColumn("_layout", record.layout(layouts))
    fitting = [i for i, x in enumerate(layouts) if x.required <= set(record.paths)]
    turns, order = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit(None).cast("long")
    name = F.lit(None).cast("string")
    for i in fitting:
        here = F.col("_layout") == i
        turns, name = F.when(here, record.turns(layouts[i])).otherwise(turns), F.when(here, F.lit(layouts[i].name)).otherwise(name)
        if layouts[i].order:
            order = F.when(here, record.value(layouts[i].order).cast("long")).otherwise(order)
    conv_id = F.col(record.at[id_column]).cast("long")
    listed = rows.select(conv_id.alias("conv_id"), F.col("_fingerprint").alias("fingerprint"), name.alias("layout"), order.alias("turn"), turns.alias("_turns"))
    listed = listed.withColumn("record", F.when(F.size("_turns") > 1, F.xxhash64("_turns")).otherwise(F.lit(0).cast("long")))
    return listed.select("conv_id", "fingerprint", "layout", "turn", "record", F.posexplode_outer("_turns").alias("place", "_t")).select(
        "conv_id", "fingerprint", "layout", "turn", "record", "place", F.col("_t.role").alias("role"), F.col("_t.text").alias("text")
    )


def escape(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), escapes, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _WRITTEN[m[0]], text) if "\\" in text else text


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, chunk, text, loss: the formatted conversations; `loss` lists [start, stop) in code points of `text` where the texts of `loss_role` stand.

    A conversation is the texts of its chunks in ascending order; beyond `chunk_chars` and where the sort splits it, it continues in a further chunk, always at a turn. Rows are dealt by
    ranges of (conversation, turn), so a conversation that holds a large part of all turns is written by several tasks, each of which keeps one chunk in memory; only turns
    that tie in all of (turn, record, place) stay together. A conversation without turns has an empty text.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(SEPARATOR))
    body = escape(F.col("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "record", "place", "role", "text")]
    ranged = turns.repartitionByRange(*order[:4]).sortWithinPartitions(*order)  # texts stay out of the sampled bounds
    pieces = ranged.select(
        "conv_id", F.concat(head, body, F.lit(CLOSE)).alias("piece"), F.length(head).alias("before"), F.length(body).alias("size"), (F.col("role") == loss_role).alias("learnt")
    )
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        chunk = _Chunk()
        done: list[tuple] = []
        for batch in batches:
            for conv_id, piece, before, size, learnt in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk.open and (conv_id != chunk.conv_id or chunk.length >= chunk_chars):
                    done.append(chunk.row(task))
                if not chunk.open:
                    chunk.start(conv_id)
                if piece is not None:
                    chunk.add(piece, before, size, learnt)
            if done:
                yield _chunk_rows(done, schema)
                done = []
        if chunk.open:
            yield _chunk_rows([chunk.row(task)], schema)

    return pieces.mapInArrow(write, "conv_id long, chunk long, text string, loss array<struct<start:bigint,stop:bigint>>")


class _Chunk:
    """The chunk that is being written."""

    def __init__(self) -> None:
        self.open, self.number = False, 0

    def start(self, conv_id: int | None) -> None:
        self.open, self.conv_id, self.pieces, self.loss, self.length = True, conv_id, [], [], 0

    def add(self, piece: str, before: int, size: int, learnt: bool) -> None:
        if learnt:
            self.loss.append({"start": self.length + before, "stop": self.length + before + size})
        self.pieces.append(piece)
        self.length += len(piece)

    def row(self, task: int) -> tuple:
        self.open, self.number = False, self.number + 1
        return self.conv_id, task + self.number, "".join(self.pieces), self.loss


def _chunk_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a formatted text."""
    *turns, rest = text.split(CLOSE)
    if rest:
        raise ValueError("the text does not end with a turn")
    for turn in turns:
        role, separator, body = turn.partition(SEPARATOR)
        if not role.startswith(OPEN) or not separator:
            raise ValueError("a turn does not begin with its mark")
        yield unescape(role[len(OPEN):]), unescape(body)


def read_turns(chunks: DataFrame) -> DataFrame:
    """conv_id, chunk, place, role, text: the turns in the chunks of format_chats, chunk by chunk."""
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, chunk, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(conv_id, chunk, i, role, body) for i, (role, body) in enumerate(parse(text))]
                if rows:
                    yield _chunk_rows(rows, schema)

    return chunks.select("conv_id", "chunk", "text").mapInArrow(read, "conv_id long, chunk long, place long, role string, text string")


def chat_digests(chunks: DataFrame) -> DataFrame:
    """One row per conversation, read back from its chunks: counts and digests of all turns and of what lies under the loss mask.

    A digest runs over a conversation from its first to its last turn, so its chunks meet in one task; the task holds one batch of chunks and two running digests.
    """
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            done = []
            for conv_id, _, text, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state.conv_id != conv_id:
                    if state is not None:
                        done.append(state.row())
                    state = _Digests(conv_id)
                state.add(text, loss)
            if done:
                yield _chunk_rows(done, schema)
        if state is not None:
            yield _chunk_rows([state.row()], schema)

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class _Digests:
    """Running counts and digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: list[dict]) -> None:
        for role, body in parse(text):
            self.turns += 1
            self.all.update(f"{role}\n{body}\n".encode())
        for span in loss:
            learnt = unescape(text[span["start"]:span["stop"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.chars += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


SAMPLE_ID = -7
SAMPLE_TEXT = "\\### Assistant: </turn> ok"


def with_sample(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The rows of the table and one record of another layout that holds the marks of the template."""
    message = lambda role: F.struct(F.lit(role).alias("role"), F.lit(SAMPLE_TEXT).alias("content"))
    sample = spark.range(1).select(F.lit(SAMPLE_ID).cast("long").alias("conv_id"), F.array(message("user"), message("assistant")).alias("messages"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(sample, allowMissingColumns=True)


def _escape_sql(column: str, escapes: tuple[tuple[str, str], ...]) -> str:
    return reduce(lambda sql, pair: f"replace({sql}, '{pair[0]}', '{pair[1]}')", escapes, column)


_MARKS = len(OPEN) + len(SEPARATOR) + len(CLOSE)
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES ({SAMPLE_ID}, 0, 'user', '{SAMPLE_TEXT}'), ({SAMPLE_ID}, 1, 'assistant', '{SAMPLE_TEXT}')))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum({_MARKS} + length({_escape_sql("role", ROLE_ESCAPES)}) + length({_escape_sql("text", ESCAPES)}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
