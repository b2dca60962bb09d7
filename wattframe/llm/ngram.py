"""Language-model scores from an n-gram trie in Elias-Fano levels on shared files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.eliasfano import EliasFano, load, save
from wattframe.llm.text import texts_of, word_hashes, word_table
from wattframe.session import cut_lineage, work_folder

ORDER = 3
DISCOUNT = 0.75
STEP = 1 / 4096  # of quantised log10 values
NO_WEIGHT = 65535  # of parents without children: log10 of 0; that of others is above -16
CHUNK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 21
MAX_SHARDS = 1 << 14
MAX_MAPPED = 1 << 14  # open files of a task; a process may map 65,530 regions
_WORDS = word_table()
_END = np.uint64(0x452821E638D01377)
_MAPPED: dict[str, list[np.ndarray]] = {}


def _mapped(path: str) -> list[np.ndarray]:
    if path not in _MAPPED:
        if len(_MAPPED) >= MAX_MAPPED:
            _MAPPED.clear()
        _MAPPED[path] = load(path)
    return _MAPPED[path]


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return q.astype(np.float64) * -STEP


@dataclass(frozen=True)
class Level:
    """One level of the trie: `shards` files, each with the nodes of a range of parents (or of word hashes on the first level). `bases` are the ids of their first nodes."""

    folder: str
    order: int
    shards: int
    parents: int
    bases: tuple[int, ...]
    words: int
    tokens: int

    @property
    def nodes(self) -> int:
        return self.bases[-1]

    @property
    def parents_per_shard(self) -> int:
        return -(-self.parents // self.shards)

    def path(self, shard: int) -> str:
        return f"{self.folder}/level{self.order}-{shard:05d}"

    def _by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, slice]]:
        """`shard` is sorted."""
        cuts = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(shard)]])):
            if b > a:
                yield int(shard[a]), slice(int(a), int(b))


class Words(Level):
    """First level: word hashes, and the running sums of their counts."""

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node ids (-1: unknown) and counts of sorted different hashes."""
        ids, counts = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        bits = self.shards.bit_length() - 1
        shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64)
        for s, part in self._by_shard(shard):
            if self.bases[s + 1] == self.bases[s]:
                continue
            arrays = _mapped(self.path(s))
            at = EliasFano(*arrays[:5]).find((hashes[part] << np.uint64(bits)) >> np.uint64(bits + 1))
            known = at >= 0
            sums = EliasFano(*arrays[5:10])
            ids[part] = np.where(known, at + self.bases[s], -1)
            counts[part][known] = (sums.get(at[known] + 1) - sums.get(at[known])).astype(np.int64)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of sorted node ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for s, part in self._by_shard(np.searchsorted(self.bases, ids, side="right") - 1):
            sums = EliasFano(*_mapped(self.path(s))[5:10])
            at = ids[part] - self.bases[s]
            out[part] = (sums.get(at + 1) - sums.get(at)).astype(np.int64)
        return out

    def log10(self, counts: np.ndarray) -> np.ndarray:
        """Add-half estimates."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


class Grams(Level):
    """A higher level: per shard the keys (parent, word) of its nodes, the pointers of its parents, node probabilities and parent back-off weights."""

    @property
    def word_bits(self) -> int:
        return (self.words + 1).bit_length()

    def find(self, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node ids (-1: none) and log10 probabilities of pairs sorted by parent. The successor of the word is sought among the children of its context."""
        ids, found = np.full(len(parents), -1, dtype=np.int64), np.zeros(len(parents))
        for s, part in self._by_shard(parents // self.parents_per_shard):
            if self.bases[s + 1] == self.bases[s]:
                continue
            arrays = _mapped(self.path(s))
            local = parents[part] - s * self.parents_per_shard
            key = local.astype(np.uint64) << np.uint64(self.word_bits) | words[part].astype(np.uint64)
            at = EliasFano(*arrays[:5]).find(key)
            known = at >= 0
            ids[part] = np.where(known, at + self.bases[s], -1)
            found[part][known] = restore(arrays[10][at[known]])
        return ids, found

    def backoff(self, parents: np.ndarray) -> np.ndarray:
        """log10 back-off weights of sorted parents; 0 for those without children."""
        out = np.zeros(len(parents))
        for s, part in self._by_shard(parents // self.parents_per_shard):
            if self.bases[s + 1] == self.bases[s]:
                continue
            arrays = _mapped(self.path(s))
            weight = arrays[11][parents[part] - s * self.parents_per_shard]
            out[part] = np.where(weight < NO_WEIGHT, restore(weight), 0.0)
        return out

    def word_of(self, ids: np.ndarray) -> np.ndarray:
        """Last words of sorted node ids."""
        out = np.zeros(len(ids), dtype=np.int64)
        for s, part in self._by_shard(np.searchsorted(self.bases, ids, side="right") - 1):
            keys = EliasFano(*_mapped(self.path(s))[:5]).get(ids[part] - self.bases[s])
            out[part] = (keys & np.uint64((1 << self.word_bits) - 1)).astype(np.int64)
        return out


def _unique(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(a, return_inverse=True)


class Trie:
    """Levels for look-up; `step` follows one more word from known contexts."""

    def __init__(self, levels: list[Level]):
        self.words: Words = levels[0]
        self.grams: list[Grams] = levels[1:]

    def word_ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        different, inverse = _unique(hashes)
        ids, counts = self.words.find(different)
        return ids[inverse], counts[inverse]

    def contexts(self, ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
        """For every token the node of the `depth` tokens before it (-1: none). The start of a text is a token of its own, with the id after the last word."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts] = self.words.nodes
        node = before
        for k in range(1, depth):
            # The context of depth k + 1 of a token: the node of depth k of the token before it, followed by that token.
            parent = np.empty_like(node)
            parent[1:] = node[:-1]
            parent[starts] = -1
            node = self.follow(k - 1, parent, before)[0]
        return node

    def follow(self, level: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and probabilities of (parent, word) on self.grams[level], -1 and 0 where there is none."""
        node, found = np.full(len(parents), -1, dtype=np.int64), np.zeros(len(parents))
        use = np.flatnonzero((parents >= 0) & (words >= 0) & (words < self.words.nodes))
        if len(use):
            span = np.uint64(self.words.nodes + 1)
            pair, inverse = _unique(parents[use].astype(np.uint64) * span + words[use].astype(np.uint64))
            at, p = self.grams[level].find((pair // span).astype(np.int64), (pair % span).astype(np.int64))
            node[use], found[use] = at[inverse], p[inverse]
        return node, found

    def log10(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: its count, the add-half log10 probability, and the model's, interpolated over all orders."""
        different, inverse = _unique(hashes)
        ids, counts = self.words.find(different)
        base = self.words.log10(counts)[inverse]
        ids, counts = ids[inverse], counts[inverse]
        total = base.copy()
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[starts] = self.words.nodes
        for level, grams in enumerate(self.grams):
            node = self._interpolate(grams, context, ids, total)
            if level + 1 < len(self.grams):
                # The next longer context of a token is what the level has just found for the token before it.
                context = np.empty_like(node)
                context[1:] = node[:-1]
                context[starts] = -1
        return counts, base, total

    def _interpolate(self, grams: Grams, context: np.ndarray, ids: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Nodes of (context, word), -1 where there is none; `total` becomes their probability, or is lowered by the back-off weight of a known context. One sort serves both."""
        node = np.full(len(context), -1, dtype=np.int64)
        use = np.flatnonzero(context >= 0)
        if len(use):
            # An unknown word takes the number after the last word, which no context has as a child.
            span = np.uint64(self.words.nodes + 1)
            pair, inverse = _unique(context[use].astype(np.uint64) * span + np.where(ids[use] < 0, self.words.nodes, ids[use]).astype(np.uint64))
            parents = pair // span
            at, p = grams.find(parents.astype(np.int64), (pair - parents * span).astype(np.int64))
            first = np.concatenate([[True], parents[1:] != parents[:-1]])
            weight = grams.backoff(parents[first].astype(np.int64))[np.cumsum(first) - 1]
            node[use] = at[inverse]
            total[use] = np.where(node[use] >= 0, p[inverse], total[use] + weight[inverse])
        return node


def _planes(a: np.ndarray) -> bytes:
    """Bytes of unsigned values by significance, without empty planes."""
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max([1, *(i + 1 for i in range(8) if planes[i].any())])
    return bytes([used]) + planes[:used].tobytes()


def _from_planes(data: bytes, n: int) -> np.ndarray:
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:data[0]] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows, token hashes and text starts of about CHUNK_TOKENS tokens at a time; a text is never divided."""
    rows, hashes, sizes, total = [], [], [], 0
    for batch in batches:
        others = zip(*(c.to_pylist() for c in batch.columns[:-1])) if batch.num_columns > 1 else [()] * batch.num_rows
        for row, text in zip(others, texts_of(batch.columns[-1]), strict=True):
            h = np.append(word_hashes(text.lower(), _WORDS), _END)
            rows.append(row)
            hashes.append(h)
            sizes.append(len(h))
            total += len(h)
            if total >= CHUNK_TOKENS:
                yield rows, np.concatenate(hashes), np.cumsum([0, *sizes[:-1]])
                rows, hashes, sizes, total = [], [], [], 0
    if rows:
        yield rows, np.concatenate(hashes), np.cumsum([0, *sizes[:-1]])


_COUNTED = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("tokens", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _counted(texts: DataFrame, keys_of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable]]) -> DataFrame:
    """Counts of keys by shard: one row per chunk and shard, with the sorted keys as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, starts in _chunks(batches):
            keys, shard_of, local = keys_of(hashes, starts)
            keys, counts = np.unique(keys, return_counts=True)
            shard = shard_of(keys)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if b > a:
                    own = local(keys[a:b])
                    rows.append((int(shard[a]), b - a, int(counts[a:b].sum()), _planes(np.diff(own, prepend=np.uint64(0))), _planes(counts[a:b])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _COUNTED)], schema=_COUNTED)

    return texts.select("text").mapInArrow(run, "shard int, n long, tokens long, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a shard and their counts."""
    ns = table.column("n").to_pylist()
    keys = [np.cumsum(_from_planes(b.as_buffer().to_pybytes(), n), dtype=np.uint64) for b, n in zip(table.column("keys"), ns)]
    counts = [_from_planes(b.as_buffer().to_pybytes(), n) for b, n in zip(table.column("counts"), ns)]
    keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _shards(tokens: int) -> int:
    """A power of two, so that a shard gathers about SHARD_TOKENS tokens' worth of keys."""
    return min(MAX_SHARDS, 1 << max(0, (tokens // SHARD_TOKENS).bit_length()))


def _sizes(counted: DataFrame, build: Callable[[pa.Table], pa.Table]) -> dict[int, tuple[int, int]]:
    """Builds every shard in a task of its own; returns the nodes and tokens of each (one row per shard, at most MAX_SHARDS)."""
    rows = counted.groupBy("shard").applyInArrow(build, "shard int, nodes long, tokens long").collect()
    return {r["shard"]: (r["nodes"], r["tokens"]) for r in rows}


def _bases(sizes: dict[int, tuple[int, int]], shards: int) -> tuple[int, ...]:
    return tuple(np.cumsum([0, *(sizes.get(s, (0, 0))[0] for s in range(shards))]).tolist())


def _told(shard: int, nodes: int, tokens: int) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int32()), "nodes": pa.array([nodes], pa.int64()), "tokens": pa.array([tokens], pa.int64())})


def local_path(folder: str) -> str:
    """Path of a shared folder that executors can map: one mounted on all of them."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped levels need spark.checkpoint.dir on a mounted file system, not {url.scheme}:")
    return url.path


def build_trie(texts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> list[Level]:
    """Trie of all n-grams up to `order` of the column `text`, counted over every row; nothing is pruned or sampled.

    Each level is one pass: chunks are reduced to sorted distinct keys with counts, these are dealt to shards (ranges of word hashes, later of parent
    nodes), and each shard becomes one file. A chunk or a shard is all that a task holds.
    """
    spark = texts.sparkSession
    folder = local_path(work_folder(spark, "trie"))
    words_estimate = texts.select(F.sum(F.length("text") / 5 + 1)).first()[0] or 1
    shards = _shards(int(words_estimate))
    bits = shards.bit_length() - 1

    def word_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple:
        shard_of = (lambda k: (k >> np.uint64(64 - bits)).astype(np.int64)) if bits else (lambda k: np.zeros(len(k), dtype=np.int64))
        return hashes, shard_of, lambda k: (k << np.uint64(bits)) >> np.uint64(bits + 1)

    draft = Words(folder, 1, shards, 0, (0,), 0, 0)

    def build_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        sums = np.concatenate([[0], np.cumsum(counts)])
        save(draft.path(shard), [*EliasFano.encode(keys).arrays(), *EliasFano.encode(sums).arrays()])
        return _told(shard, len(keys), int(counts.sum()))

    sizes = _sizes(_counted(texts, word_keys), build_words)
    bases = _bases(sizes, shards)
    tokens = sum(t for _, t in sizes.values())
    levels: list[Level] = [Words(folder, 1, shards, 0, bases, bases[-1], tokens)]
    for k in range(2, order + 1):
        levels.append(_build_grams(texts, levels, k, discount))
    return levels


def _build_grams(texts: DataFrame, levels: list[Level], order: int, discount: float) -> Grams:
    below = levels[-1]
    words, tokens = levels[0].nodes, levels[0].tokens
    parents = below.nodes + (1 if order == 2 else 0)
    draft = Grams(below.folder, order, _shards(tokens), parents, (0,), words, tokens)
    if parents * (words + 1) >= 1 << 64 or draft.parents_per_shard << draft.word_bits >= 1 << 63:
        raise ValueError(f"{parents} contexts of {words} words do not fit 64-bit keys; score the corpus in parts")
    span, per_shard, word_bits = np.uint64(words + 1), draft.parents_per_shard, np.uint64(draft.word_bits)

    def gram_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple:
        trie = Trie(levels)
        ids, _ = trie.word_ids(hashes)
        context = trie.contexts(ids, starts, order - 1)
        use = context >= 0
        keys = context[use].astype(np.uint64) * span + ids[use].astype(np.uint64)
        parent_of = lambda k: (k // span).astype(np.int64)
        local = lambda k: (parent_of(k) % per_shard).astype(np.uint64) << word_bits | k % span
        return keys, lambda k: parent_of(k) // per_shard, local

    def build(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        local, word = (keys >> word_bits).astype(np.int64), (keys & np.uint64((1 << draft.word_bits) - 1)).astype(np.int64)
        owned = min(per_shard, parents - shard * per_shard)
        children = np.bincount(local, minlength=owned)
        mass = np.bincount(local, weights=counts, minlength=owned)
        weight = discount * children / np.maximum(mass, 1)
        p = (counts - discount) / mass[local] + weight[local] * 10 ** _lower(levels, local + shard * per_shard, word)
        ends = np.concatenate([[0], np.cumsum(children)])
        with np.errstate(divide="ignore"):
            back = quantise(np.log10(weight))
        save(draft.path(shard), [*EliasFano.encode(keys).arrays(), *EliasFano.encode(ends).arrays(), quantise(np.log10(p)), back])
        return _told(shard, len(keys), int(counts.sum()))

    bases = _bases(_sizes(_counted(texts, gram_keys), build), draft.shards)
    return Grams(below.folder, order, draft.shards, parents, bases, words, tokens)


def _lower(levels: list[Level], parents: np.ndarray, word: np.ndarray) -> np.ndarray:
    """log10 probability of the words after the contexts without their first word; `parents` are sorted nodes of the last level."""
    trie = Trie(levels)
    if not trie.grams:
        different, inverse = _unique(word)
        return trie.words.log10(trie.words.counts_of(different))[inverse]
    if len(trie.grams) > 1:
        raise ValueError("orders above 3 are not supported")
    nodes, inverse = _unique(parents)
    last = trie.grams[-1].word_of(nodes)[inverse]
    return trie.follow(0, last, word)[1]


def score_texts(docs: DataFrame, order: int = ORDER, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32 of the id as text is not 1 modulo 5, from their whole texts; null ids teach nothing and are not held out. `base_score` sums add-half
    log10 probabilities of single tokens; `score` is the log10 probability by n-grams up to `order` with absolute discounting, each level interpolated with the one
    below, quantised in steps of 1/4096. Null and empty texts are one end token. Words are told apart by 64-bit hashes. Repeated rows all count; an
    empty table gives an empty result; other columns are not read.
    """
    rest = F.crc32(F.encode(F.col(f"`{id_column}`").cast("string"), "UTF-8")) % 5
    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), rest.alias("rest"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    levels = build_trie(picked.where("rest <> 1").select("text"), order)
    tokens = levels[0].tokens
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(levels)
        for rows, hashes, starts in _chunks(batches):
            counts, base, total = trie.log10(hashes, starts)
            sizes = np.diff(np.append(starts, len(hashes)))
            known = np.add.reduceat((counts > 0).astype(np.int64), starts)
            ids, held = zip(*rows)
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(rows), tokens), pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(total, starts))], names=names)

    inputs = picked.select("doc_id", F.coalesce(F.col("rest") == 1, F.lit(False)).alias("held_out"), "text")
    return inputs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
