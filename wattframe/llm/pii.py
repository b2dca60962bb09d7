"""Personal data: strict patterns as seeds, and contextual patterns induced from them that discover further identifiers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import fresh
from wattframe.session import cut_lineage

# The kinds in the order in which results list them.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
MIN_SEEDS = 3  # different seeds that a pattern needs
SMOOTHING = 2.0
ACCEPT = 0.8
ROUNDS = 3

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBERS = re.compile(r"(?<![\w().\-/+])[0-9().\-/]++(?:\x20[0-9().\-/]++)*+(?![\w])")
_MAIL_LIKE = re.compile(r"(?<!\S)[^\s@]{1,64}(?:@|\[at\]|\(at\))[^\s@]{1,255}(?!\S)")
_DIGITS = re.compile("[0-9]")

_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_FIND = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
_SPAN_DDL = "struct<kind:int,start:bigint,stop:bigint>"
_FIND_DDL = "struct<kind:int,start:bigint,stop:bigint,seed:boolean,instance:string,patterns:array<string>>"

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """The @ of a match is the only one in it, so each @ is met once: its local part reaches back at most to the @ or match before."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        floor = at + 1
        if found:
            yield EMAIL, start, found.end()
            floor = found.end()
        at = text.find("@", floor)


def base_spans(text: str) -> list[Span]:
    """Strict matches (kind, start, end), by kind and start: leftmost, not overlapping within a kind, in code points. Linear in the text."""
    out = list(_emails(text))
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            out.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m.group())) <= 15:
            out.append((PHONE, m.start(), m.end()))
    return out


def _loose(text: str, taken: list[Span]) -> list[Span]:
    """Substrings shaped roughly like an identifier that no strict match touches."""
    found = []
    if "@" in text or "[at]" in text or "(at)" in text:
        found += [(EMAIL, m.start(), m.end()) for m in _MAIL_LIKE.finditer(text)]
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() < 7:
            continue
        digits = len(_DIGITS.findall(m.group()))
        if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m.group()):
            found.append((IP, m.start(), m.end()))
        elif 13 <= digits <= 19:
            found.append((CARD, m.start(), m.end()))
        elif 7 <= digits <= 12:
            found.append((PHONE, m.start(), m.end()))
    if not found:
        return found
    out, busy = [], sorted((a, b) for _, a, b in taken)
    at, reach = 0, 0
    for kind, a, b in sorted(found, key=lambda s: s[1]):
        while at < len(busy) and busy[at][0] < b:
            reach = max(reach, busy[at][1])
            at += 1
        if a >= reach:
            out.append((kind, a, b))
            reach = b
    return out


def _patterns(text: str, start: int, stop: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after; a label (word ending in : = or #) before."""
    left = [w[-32:].lower() for w in text[max(0, start - 80):start].split()[-2:]]
    right = [w[:32].lower() for w in text[stop:stop + 40].split()[:1]]
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _")
    if left and right:
        out.append(f"{left[-1]} _ {right[0]}")
    if left and left[-1][-1] in ":=#":
        out.append(f"{left[-1]} _")
    return out


def _instance(kind: int, value: str) -> str:
    return value.lower() if kind == EMAIL else "".join(_DIGITS.findall(value)) if kind != IP else value


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: row (unique), doc_id, text_hash, the four counts, base_sha256, spans (strict ones), finds (strict and loose ones with their patterns).

    Written to the shared folder: the texts are scanned once.
    """
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, finds = ([], [], [], []), [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                base = base_spans(text)
                for k, column in enumerate(counts):
                    column.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in base])
                finds.append([
                    {"kind": k, "start": a, "stop": b, "seed": seed, "instance": _instance(k, text[a:b]), "patterns": _patterns(text, a, b)}
                    for seed, part in ((True, base), (False, _loose(text, base))) for k, a, b in part
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.list_(_SPAN)), pa.array(finds, pa.list_(_FIND))],
                names=["doc_id", "text_hash", *names, "base_sha256", "spans", "finds"],
            )

    text = F.col(f"`{text_column}`").cast("string")
    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    counts = ", ".join(f"{n} long" for n in names)
    scanned = picked.mapInArrow(run, f"doc_id long, text_hash long, {counts}, base_sha256 string, spans array<{_SPAN_DDL}>, finds array<{_FIND_DDL}>")
    return cut_lineage(scanned.withColumn("row", F.monotonically_increasing_id()))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, smoothing: float = SMOOTHING, accept: float = ACCEPT) -> DataFrame:
    """(kind, instance, score) of the accepted instances of a pattern-instance graph.

    `edges` holds kind, pattern, instance, n, seed, each pair once. Seeds score 1. In each round a pattern scores the share of its occurrences that its instances
    vouch for, sum(n * score) / (sum(n) + smoothing), and an instance the noisy-or of its patterns. Only patterns with `min_seeds` different seeds take part.
    Both steps are partial aggregates, so a pattern or instance with very many occurrences does not gather in one task.
    """
    strong = edges.where("seed").groupBy("kind", "pattern").count().where(F.col("count") >= min_seeds).select("kind", "pattern")
    graph = cut_lineage(edges.join(strong, ["kind", "pattern"], "left_semi").withColumn("score", F.col("seed").cast("double")))
    for _ in range(rounds):
        patterns = graph.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + smoothing)).alias("trust"))
        doubt = F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999999))))
        loose = graph.where("NOT seed").join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("found"))
        scored = graph.join(loose, ["kind", "instance"], "left")
        graph = cut_lineage(scored.withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0)))).drop("found"))
    return graph.where("NOT seed").groupBy("kind", "instance").agg(F.max("score").alias("score")).where(F.col("score") >= accept)


def discovered(scanned: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, extra): the spans that context adds to the rows of `scan`."""
    finds = scanned.select("row", "doc_id", "text_hash", F.explode("finds").alias("f")).select("row", "doc_id", "text_hash", "f.*")
    edges = finds.select("kind", "instance", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    accepted = bootstrap(edges).select("kind", "instance")
    extra = finds.where("NOT seed").join(accepted, ["kind", "instance"], "left_semi")
    return extra.groupBy("row", "doc_id", "text_hash").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Counts and digest cover the strict matches of the whole text; `spans` adds what the contexts of all documents together discover (n_found of them), and never loses a
    strict one. Null texts count as empty: no spans, the digest of nothing. A text of any length is scanned in linear time. Repeated rows give repeated
    results; null ids are kept; an empty table gives an empty result; other columns are not read.
    """
    scanned = scan(docs, id_column, text_column)
    added = discovered(scanned).select("row", "extra")
    every = F.array_sort(F.concat("spans", F.coalesce("extra", F.array().cast(f"array<{_SPAN_DDL}>"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    joined = scanned.drop("finds").join(added, "row", "left")
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", text.alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_found"))


def mask(text: str, spans: list[Span]) -> str:
    """`text` with every span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, done = [], 0
    for start, stop, kind in sorted((a, -b, k) for k, a, b in spans):
        stop = -stop
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, stop)
    return "".join(out) + text[done:]


def mask_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """`docs` with its columns, whatever their names, its texts masked and their lengths renewed.

    Discovered spans come back by id and text hash; that table has only rows with discoveries, and Spark broadcasts it when it measures it to be small. Null texts stay null.
    """
    text = F.col(f"`{text_column}`").cast("string")
    row_id, row_hash, more = (fresh(docs, n) for n in ("_id", "_hash", "_extra"))
    found = discovered(scan(docs, id_column, text_column))
    added = found.select(F.col("doc_id").alias(row_id), F.col("text_hash").alias(row_hash), F.col("extra").alias(more)).dropDuplicates([row_id, row_hash])
    joined = docs.join(added, F.col(f"`{id_column}`").eqNullSafe(F.col(row_id)) & (F.xxhash64(text) == F.col(row_hash)), "left").drop(row_id, row_hash)
    place, sized = docs.columns.index(text_column), docs.columns.index(length_column) if length_column in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            extras = columns.pop().to_pylist()
            texts = [
                t if t is None else mask(t, base_spans(t) + [(s["kind"], s["start"], s["stop"]) for s in extra or []])
                for t, extra in zip(columns[place].to_pylist(), extras, strict=True)
            ]
            columns[place] = pa.array(texts, pa.string())
            if sized is not None:
                columns[sized] = pa.array([None if t is None else len(t) for t in texts], columns[sized].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
