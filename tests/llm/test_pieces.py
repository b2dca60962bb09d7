import random

import numpy as np
import pyarrow as pa
import pytest

from wattframe.llm.pieces import Encoder, Lanes, Vocabulary, _encode_portion, decode, encode_texts, read_vocabulary, short_viterbi, viterbi


def full(text, v):
    """All boundaries kept to the end."""
    best, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - v.reach), end):
            piece = v.ids.get(text[start:end])
            if piece is not None and best[start] + v.scores[piece] > best[end]:
                best[end], back[end] = best[start] + v.scores[piece], (start, piece)
        if text[end - 1] not in v.ids and best[end - 1] + v.byte_penalty > best[end]:
            best[end], back[end] = best[end - 1] + v.byte_penalty, (end - 1, -1)
    out, end = [], len(text)
    while end:
        out.append((back[end][1], end))
        end = back[end][0]
    return [i for piece, stop in reversed(out) for i in ([piece] if piece >= 0 else [v.byte_ids[b] for b in text[stop - 1].encode()])]


@pytest.fixture(scope="module")
def small():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["a", "b", "ab", "ba", "aba", "bab", "abab", "▁", "a▁b", "▁a"]
    rng = random.Random(8)
    return Vocabulary({p: i for i, p in enumerate(pieces) if i >= 256}, tuple([0.0] * 256 + [-rng.random() * 5 * len(p) for p in pieces[256:]]), tuple(pieces), tuple(range(256)))


def test_commits_equal_the_whole_search(small):
    rng = random.Random(9)
    assert not small.splits_at_spaces
    commits = 0
    for _ in range(400):
        text = "".join(rng.choice("aabb▁é") for _ in range(rng.randint(1, 120)))
        parts = list(viterbi(text, small))
        commits += len(parts)
        assert [i for p in parts for i in p] == full(text, small) == short_viterbi(text, small)
    assert commits > 2000


def test_round_trip_and_public_vocabulary():
    v = read_vocabulary()
    encoder, rng = Encoder(v), random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " the", "▁", " ", "\n", "ß", "你", "ning", "𝄞"]) for _ in range(rng.randint(1, 60)))
        ids = encoder.encode(text)
        assert decode(ids, v) == text
        if "▁" not in text:
            assert ids.tolist() == full("▁" + text.replace(" ", "▁"), v)


def test_lanes_equal_the_streaming_search():
    """Many words at once against one text after the other: long words, bytes, literal marks, spaces at the ends, empty texts."""
    v = read_vocabulary()
    lanes, alone, rng = Lanes(v), Encoder(v), random.Random(11)
    letters = ["a", "e", "n", "th", "ing", "er", " ", "  ", "\n", "ß", "你", "𝄞", "0", "Ver", "\x00"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(500)] + ["", " ", "   a", "a   ", "donau" * 60 + " x", "𝄞" * 100, "▁", "a▁ b", "x" * 33]
    values, counts, whole = _encode_portion(lanes, [t.encode() for t in texts])
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert whole.all() and all(values[a:b].tolist() == alone.encode(t).tolist() for a, b, t in zip(ends, ends[1:], texts))


def test_a_lost_piece_shows_in_restored():
    v = read_vocabulary()
    lanes = Lanes(v)
    first = int(_encode_portion(lanes, [b"the"])[0][0])
    lanes.piece_bytes = pa.array([b"?" if i == first else x for i, x in enumerate(lanes.piece_bytes.to_pylist())], pa.binary())
    assert _encode_portion(lanes, [b"the", b"of a", b""])[2].tolist() == [False, True, True]


def test_hard_rows(hard_docs):
    rows = encode_texts(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(r.restored and r.n_ids == len(r.ids) for r in rows)
    assert {r.doc_id for r in rows if r.n_ids == 0} == {None, 3, 4} and encode_texts(hard_docs.limit(0)).count() == 0
    assert len(decode(np.empty(0, np.int32), read_vocabulary())) == 0
