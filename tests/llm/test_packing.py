import random

from wattframe.llm.packing import best_fit, pack


def naive(items, window):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and (b[0] or window == 0) and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append([window, set(), set()])
        bins[k][0] -= size
        bins[k][1] |= {source} - {None}
        bins[k][2] |= {cluster} - {None}
        out.append(k)
    return out


def test_tightest_compatible_bin():
    rng = random.Random(5)
    for n in range(60):
        window = rng.choice([1, 7, 8, 50])
        items = [(rng.randint(0, window), rng.choice(["a", "a", "b", "c", None]), rng.choice([1, 2, 3, None, rng.random()])) for _ in range(rng.randint(0, 120))]
        if n % 2:
            items.sort(key=lambda i: -i[0])
        assert pack(items, window) == naive(items, window)


def test_hard_rows(hard_docs):
    rows = best_fit(hard_docs, window=64).collect()
    words = lambda t: len((t or "").encode().split())
    assert sum(r.words for r in rows) == sum(words(r.text) for r in hard_docs.collect())
    bins = {}
    for r in rows:
        bins.setdefault((r.shard, r.bin), []).append(r)
    for members in bins.values():
        sources, clusters = [m.source for m in members if m.source is not None], [m.cluster for m in members if m.cluster is not None]
        assert sum(m.words for m in members) <= 64 and len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    assert sorted(r.piece for r in rows if r.doc_id == 6) == sorted(2 * list(range(469))) and best_fit(hard_docs.limit(0)).count() == 0


def test_hot_shards_are_packed_in_runs(make_docs):
    docs = make_docs([(1, "same text", "a")] * 500)
    rows = best_fit(docs, window=64, shard_pieces=20).collect()
    assert len(rows) == 500 == len({(r.shard, r.bin) for r in rows})
