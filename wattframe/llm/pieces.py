"""SentencePiece encoding by a streaming Viterbi search, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import texts_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PORTION_BYTES = 1 << 24
SPACE = "▁"
_LOWEST = float("-inf")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores, and the ids of the 256 byte pieces. A vocabulary is a fixed file, so its size does not follow the data."""

    ids: dict[str, int]
    scores: tuple[float, ...]
    pieces: tuple[str, ...]
    byte_ids: tuple[int, ...]

    @cached_property
    def reach(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def prefixes(self) -> dict[str, int]:
        """Every beginning of a piece, with the id if it is a piece, else -1."""
        out = dict.fromkeys((p[:k] for p in self.ids for k in range(1, len(p))), -1)
        return out | self.ids

    @cached_property
    def byte_penalty(self) -> float:
        return min(self.scores) - 10.0

    @cached_property
    def splits_at_spaces(self) -> bool:
        """No piece has a space mark after another character, so every search converges where a word begins."""
        return all(SPACE not in p.lstrip(SPACE) for p in self.ids)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    pieces = tuple(model.id_to_piece(i) for i in range(size))
    special = {i for i in range(size) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)}
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the vocabulary has no byte fallback")
    return Vocabulary(
        {p: i for i, p in enumerate(pieces) if i not in special}, tuple(float(model.get_score(i)) for i in range(size)), pieces, tuple(byte_ids[b] for b in range(256)),
    )


def viterbi(text: str, vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of the best segmentation, in commits.

    Keeps scores and backpointers from the last committed boundary on. Once that is twice the longest piece, and at the end, it traces back all boundaries from which a
    later piece can start or to which one leads already; where they meet, everything before is final and is yielded. The best sum of scores wins, of
    equal ones the longer last piece. A character that is no piece becomes its UTF-8 bytes, at a score below all pieces.
    """
    prefixes, scores, reach, penalty = vocabulary.prefixes, vocabulary.scores, vocabulary.reach, vocabulary.byte_penalty
    ids, size = vocabulary.ids, len(text)
    done = 0
    best, back = [0.0], [(0, 0)]  # of the boundaries done, done + 1, ...; the last ones may not be reached yet
    for start in range(size):
        base = best[start - done]
        if text[start] not in ids:
            _offer(best, back, start + 1 - done, base + penalty, start, -1)
        end = start + 1
        while end <= size:
            piece = prefixes.get(text[start:end])
            if piece is None:
                break
            if piece >= 0:
                _offer(best, back, end - done, base + scores[piece], start, piece)
            end += 1
        if start + 1 == size or start + 1 - done >= 2 * reach:
            alive = {size} if start + 1 == size else {k + done for k in range(start + 1 - done, len(best)) if best[k] != _LOWEST}
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(max(done, back[last - done][0]))
            meet = alive.pop()
            if done < meet <= start + 1:
                yield _traced(text, best, back, done, meet, vocabulary.byte_ids)
                best, back, done = best[meet - done:], back[meet - done:], meet


def short_viterbi(text: str, vocabulary: Vocabulary) -> list[int]:
    """The same for a text within the window, where the only commit is at the end."""
    prefix, scores, ids, penalty = vocabulary.prefixes.get, vocabulary.scores, vocabulary.ids, vocabulary.byte_penalty
    size = len(text)
    best, back = [_LOWEST] * (size + 1), [(0, 0)] * (size + 1)
    best[0] = 0.0
    for start in range(size):
        base = best[start]
        if text[start] not in ids and base + penalty > best[start + 1]:
            best[start + 1] = base + penalty
            back[start + 1] = (start, -1)
        for end in range(start + 1, size + 1):
            piece = prefix(text[start:end])
            if piece is None:
                break
            if piece >= 0:
                score = base + scores[piece]
                if score > best[end]:
                    best[end] = score
                    back[end] = (start, piece)
    return _traced(text, best, back, 0, size, vocabulary.byte_ids)


def _offer(best: list[float], back: list[tuple[int, int]], at: int, score: float, start: int, piece: int) -> None:
    while len(best) <= at:
        best.append(_LOWEST)
        back.append((0, 0))
    if score > best[at]:
        best[at] = score
        back[at] = (start, piece)


def _traced(text: str, best: list[float], back: list[tuple[int, int]], done: int, meet: int, byte_ids: tuple[int, ...]) -> list[int]:
    path, at = [], meet
    while at > done:
        start, piece = back[at - done]
        path.append((piece, at))
        at = start
    out: list[int] = []
    for piece, stop in reversed(path):
        if piece >= 0:
            out.append(piece)
        else:
            out += [byte_ids[b] for b in text[stop - 1].encode()]
    return out


class Encoder:
    """Encodes one text after the other, by the streaming search."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def encode(self, text: str) -> np.ndarray:
        """A space mark is put before the text and for every space; a mark that the text itself holds is encoded as bytes, so decoding gives the text back."""
        if not text:
            return np.empty(0, dtype=np.int32)
        literal = [self.vocabulary.byte_ids[b] for b in SPACE.encode()]
        first, *others = text.split(SPACE)
        out = self.search(SPACE + first.replace(" ", SPACE))
        for other in others:
            out += literal + self.search(other.replace(" ", SPACE))
        return np.array(out, dtype=np.int32)

    def search(self, text: str) -> list[int]:
        return [i for commit in viterbi(text, self.vocabulary) for i in commit]


class Lanes:
    """The search for many words at once, one lane a word, all lanes in step by position.

    No piece goes on past a space mark, so all paths through a text converge before each mark: a word is the window between two commits, and equal words of a batch share a lane. A
    word of over twice the longest piece is searched by `viterbi`, which commits inside it. Pieces are found by hashes of code point runs, one slot a piece, surplus pieces of a slot in a sorted list; what was encoded is
    decoded and compared with the text, so a false match of hashes cannot pass.
    """

    _BASE, _SLOT, _AT_ONCE, _BITS = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xFF51AFD7ED558CCD), 1 << 18, 20

    def __init__(self, vocabulary: Vocabulary):
        if not vocabulary.splits_at_spaces:
            raise ValueError("some piece goes on past a space mark")
        self.vocabulary, self.reach = vocabulary, vocabulary.reach
        self.encoder = Encoder(vocabulary)
        self.scores = np.array(vocabulary.scores)
        self.byte_ids = np.array(vocabulary.byte_ids, dtype=np.int32)
        self.powers = np.array([pow(int(self._BASE), k, 1 << 64) for k in range(self.reach + 1)], dtype=np.uint64)
        values = {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        self.piece_bytes = pa.array([values.get(i, p.replace(SPACE, " ").encode()) for i, p in enumerate(vocabulary.pieces)], pa.binary())
        self._build()

    def _build(self) -> None:
        pieces = {}
        for piece, i in self.vocabulary.ids.items():
            h = 0
            for c in piece.replace(SPACE, " "):
                h = (h * int(self._BASE) + ord(c) + 1) % (1 << 64)
            pieces[h] = i
        if len(pieces) != len(self.vocabulary.ids):
            raise ValueError("two pieces have one hash")
        hashes, ids = np.array(list(pieces), dtype=np.uint64), np.array(list(pieces.values()), dtype=np.int32)
        slots = self._slots(hashes)
        self.keys, self.ids = np.zeros(1 << self._BITS, np.uint64), np.full(1 << self._BITS, -1, np.int32)
        _, first, shared = np.unique(slots, return_index=True, return_counts=True)
        self.keys[slots[first]], self.ids[slots[first]] = hashes[first], ids[first]
        self.crowded = np.zeros(1 << self._BITS, bool)
        self.crowded[slots[first[shared > 1]]] = True
        surplus = np.setdiff1d(np.arange(len(hashes)), first)
        surplus = surplus[np.argsort(hashes[surplus])]
        self.more_keys, self.more_ids = np.append(hashes[surplus], np.uint64(0)), np.append(ids[surplus], np.int32(-1))

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h * self._SLOT) >> np.uint64(64 - self._BITS)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        slot = self._slots(h)
        out = np.full(len(h), -1, np.int32)
        same = np.flatnonzero(self.keys[slot] == h)
        out[same] = self.ids[slot[same]]
        rest = np.flatnonzero(self.crowded[slot] & (out < 0))
        at = np.searchsorted(self.more_keys[:-1], h[rest])
        out[rest] = np.where(self.more_keys[at] == h[rest], self.more_ids[at], -1)
        return out

    def _step(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and id (-1: bytes) of the last piece of the best path to every position of the words."""
        size, reach = len(points), self.reach
        at = np.arange(size) - np.repeat(starts, lengths)  # position in the word
        h = points.astype(np.uint64) + np.uint64(1)
        ids = np.full((reach, size), -1, np.int32)  # by length, longest first: equal sums keep the longer last piece
        sums = h
        for k in range(1, reach + 1):  # sums: hash of the k code points that end here
            here = np.flatnonzero(at >= k - 1)
            if not len(here):
                break
            ids[reach - k, here] = self._lookup(sums[here])
            grown = np.zeros(size, np.uint64)
            grown[k:] = h[:-k] if k < size else 0
            sums = grown * self.powers[k] + sums
        best, length, last = np.zeros(size), np.ones(size, np.int64), np.full(size, -1, np.int32)
        order = np.argsort(-lengths, kind="stable")
        from_longest, ordered = starts[order], lengths[order]
        for j in range(int(ordered[0]) if len(ordered) else 0):
            end = from_longest[:np.searchsorted(-ordered, -j, side="left")] + j
            some = min(reach, j + 1)
            found = ids[reach - some:, end]
            before = np.empty(found.shape)
            for k in range(some, 0, -1):
                before[some - k] = best[end - k] if k <= j else 0.0
            sums_here = np.where(found >= 0, before + self.scores[found], _LOWEST)
            single = found[-1] < 0
            sums_here[-1] = np.where(single, before[-1] + self.vocabulary.byte_penalty, sums_here[-1])
            choice = sums_here.argmax(axis=0)
            lanes = np.arange(len(end))
            best[end], length[end], last[end] = sums_here[choice, lanes], some - choice, found[choice, lanes]
        return length, last

    def words(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and their number for each word."""
        length, last = self._step(points, starts, lengths)
        on_path = np.zeros(len(points), bool)
        at, first = starts + lengths - 1, starts
        while len(at):
            on_path[at] = True
            at = at - length[at]
            more = at >= first
            at, first = at[more], first[more]
        path = np.flatnonzero(on_path)
        ids, cp = last[path], points[path]
        width = np.where(ids >= 0, 1, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        values = np.repeat(ids, width)
        plain = np.flatnonzero(ids < 0)
        if len(plain):
            offset = np.cumsum(width) - width
            raw = np.frombuffer(cp[plain].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
            w = width[plain]
            values[np.repeat(offset[plain], w) + np.arange(len(raw)) - np.repeat(np.cumsum(w) - w, w)] = self.byte_ids[raw]
        word_of = np.searchsorted(starts, path, side="right") - 1
        return values, np.bincount(word_of, weights=width, minlength=len(starts)).astype(np.int64)

    def distinct(self, words: pa.Array) -> pa.Array:
        """list<int32> of the ids of each word (UTF-8, spaces for marks)."""
        data = b"".join(words.to_pylist())
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(data, np.uint8)
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        offsets -= offsets[0]
        at_byte = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        bounds = at_byte[offsets]
        lengths = np.diff(bounds)
        long = np.flatnonzero(lengths > 2 * self.reach)
        values: list[np.ndarray] = []
        counts = np.zeros(len(words), np.int64)
        short = np.flatnonzero(lengths <= 2 * self.reach)
        cuts = np.searchsorted(np.cumsum(lengths[short]), np.arange(self._AT_ONCE, int(lengths[short].sum()) + self._AT_ONCE, self._AT_ONCE), side="right")
        lists = {}
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
            some = short[a:b]
            if not len(some):
                continue
            n = lengths[some]
            begin = np.cumsum(n) - n
            take = np.repeat(bounds[some] - begin, n) + np.arange(int(n.sum()))
            ids, counts[some] = self.words(points[take], begin, n)
            values.append(ids)
        for i in long.tolist():
            lists[i] = np.array(self.encoder.search(data[offsets[i]:offsets[i + 1]].decode().replace(" ", SPACE)), dtype=np.int32)
            counts[i] = len(lists[i])
        flat = np.concatenate([*values, np.empty(0, np.int32)])
        if lists:
            offset, n = np.cumsum(counts) - counts, counts[short]
            every = np.empty(int(counts.sum()), np.int32)
            every[np.repeat(offset[short] - (np.cumsum(n) - n), n) + np.arange(len(flat))] = flat
            for i, found in lists.items():
                every[offset[i]:offset[i] + len(found)] = found
            flat = every
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat, pa.int32()))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids one text after the other, their number and whether they decode to the text. Texts are UTF-8 without literal marks."""
        marked = [b" " + t if t else b"" for t in texts]
        sizes = np.array([len(t) for t in marked], np.int64)
        buffer = b"".join(marked)
        if not buffer:
            return np.empty(0, np.int32), sizes, np.ones(len(texts), bool)
        raw = np.frombuffer(buffer, np.uint8)
        space = raw == 32
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        heads = (np.cumsum(sizes) - sizes)[sizes > 0]
        begin[heads] = True
        starts = np.flatnonzero(begin)
        bounds = pa.py_buffer(np.append(starts, len(raw)).astype(np.int32).tobytes())
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds, pa.py_buffer(buffer)]).dictionary_encode()
        codes = words.indices.to_numpy()
        listed = self.distinct(words.dictionary)
        values = listed.take(words.indices).flatten()
        per_word = np.diff(listed.offsets.to_numpy())[codes]
        word_counts = np.zeros(len(texts), np.int64)
        total = np.concatenate([[0], np.cumsum(per_word)])
        edges = np.searchsorted(starts, np.append(heads, len(raw)))
        word_counts[sizes > 0] = np.diff(total[edges])
        decoded = self.piece_bytes.take(values)
        lengths = np.diff(np.frombuffer(decoded.buffers()[1], np.int32, len(decoded) + 1))
        data = decoded.buffers()[2]
        same = np.frombuffer(data, np.uint8, int(lengths.sum())) if data is not None else np.empty(0, np.uint8)
        if len(same) == len(raw) and np.array_equal(same, raw):
            return values.to_numpy(), word_counts, np.ones(len(texts), bool)
        ids, at = values.to_numpy(), np.concatenate([[0], np.cumsum(word_counts)])
        whole = [b"".join(self.piece_bytes.take(pa.array(ids[a:b])).to_pylist()) == t for a, b, t in zip(at, at[1:], marked)]
        return ids, word_counts, np.array(whole)


_SEARCHES: dict[str, Lanes | Encoder] = {}


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """Text of ids; the space before the first piece is dropped, byte runs are read as UTF-8."""
    values = {i: b for b, i in enumerate(vocabulary.byte_ids)}
    pieces = vocabulary.pieces
    raw = b"".join(bytes([values[i]]) if i in values else pieces[i].replace(SPACE, " ").encode() for i in ids.tolist())
    return raw.decode("utf-8", "replace")[1:]


def encode_texts(docs: DataFrame, model: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: doc_id, n_ids, ids, restored (decoding gives the text back).

    Null and empty texts have no ids and count as restored. Texts of any length are searched in a window of twice the longest piece. Repeated rows are encoded alike; null ids
    are kept; an empty table gives an empty result; other columns are not read. A text that holds a literal space mark, and every text where some piece goes on past a mark, is searched
    alone from end to end.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))
    schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.list_(pa.int32())), ("restored", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _SEARCHES:  # outlives the task
            _SEARCHES[model] = Lanes(vocabulary.value) if vocabulary.value.splits_at_spaces else Encoder(vocabulary.value)
        search = _SEARCHES[model]
        for batch in batches:
            for ids, texts in _portions(batch):
                values, counts, whole = _encode_portion(search, texts)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32())), pa.array(whole, pa.bool_())], schema=schema)

    picked = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, restored boolean")


def _portions(batch: pa.RecordBatch, most: int = PORTION_BYTES) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Rows of about `most` bytes of text at a time, at least one."""
    texts = texts_of(batch.column(1))
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= most):
            size += len(texts[stop])
            stop += 1
        yield batch.column(0).slice(at, stop - at), texts[at:stop]
        at = stop


def _encode_portion(search: Lanes | Encoder, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mark = SPACE.encode()
    alone = [i for i, t in enumerate(texts) if isinstance(search, Encoder) or mark in t]
    if not alone:
        return search.encode(texts)
    encoder = search if isinstance(search, Encoder) else search.encoder
    found = {i: encoder.encode(texts[i].decode()) for i in alone}
    rest = [i for i in range(len(texts)) if i not in found]
    counts, whole = np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
    for i, ids in found.items():
        counts[i], whole[i] = len(ids), decode(ids, encoder.vocabulary) == texts[i].decode() if len(ids) else texts[i] == b""
    if rest:
        values, n, ok = search.encode([texts[i] for i in rest])
        counts[rest], whole[rest] = n, ok
        ends = np.concatenate([[0], np.cumsum(n)])
        found |= {i: values[ends[k]:ends[k + 1]] for k, i in enumerate(rest)}
    return np.concatenate([found[i] for i in range(len(texts))]), counts, whole
