"""The training-data operators against brute force, round trips, held-out rows and edge cases."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers as P
from quarryspark.llm import bpe, chunking, graph, html, langid, packing, quality, registry, simhash, tokenfile, topk, toxicity
from quarryspark.llm.common import ship, table

SF = "/root/testdata/sf0.001"
MULTI, ENGLISH = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.tiktoken")
EXTRA = ["score", "length", "fp", "ids", "offset", "n", "class", "low", "entropy", "predicted", "_bucket"]
EDGES = [(1, ""), (2, None), (3, "One two three. It's <|endoftext|> 12's  \n x"), (4, "One two three. It's <|endoftext|> 12's  \n x"), (4, "One two three. It's <|endoftext|> 12's  \n x"), (5, "word " * 60_000 + "a" * 5_000), (6, " \n\t "), (None, "no id here"), (8, "日本語 😀 é́ \x00 ok")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def edges(spark):
    ship(spark)
    rows = [(i, t, "en", *range(len(EXTRA))) for i, t in EDGES]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"{c} bigint" for c in EXTRA)).repartition(3, F.monotonically_increasing_id())


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


def reference(path):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_encoding_equals_tiktoken_on_hard_texts():
    rnd, own, want = random.Random(3), bpe.codec(MULTI), reference(MULTI)
    hard = ["", "'", "'s", "''s", " 's", "\n's", "x're'll've", "  ", " \n a", "a" * 3000, "é" * 999, "日本 語", "12³½", "\x85 　x", "don't 'd"]
    hard += ["".join(rnd.choice("ab'stlrevmd  \n\t é0.!日😀") for _ in range(rnd.randint(1, 50))) for _ in range(4000)]
    ids, until = own.encode(hard)
    got = [ids[a:b].tolist() for a, b in zip([0, *until[:-1]], until)]
    assert got == [want.encode_ordinary(t) for t in hard]
    assert own.decode(ids) == "".join(hard).encode()
    assert own.offsets(ids).tolist() == [0, *itertools.accumulate(own.word_size[ids].tolist())][:-1]


def test_automaton_composes_as_single_steps():
    functions, compose, states, _ = bpe.automaton()
    rnd = random.Random(1)
    for _ in range(200):
        f, g = rnd.choice(functions), rnd.choice(functions)
        assert [states[g][states[f][s]] for s in range(bpe.STATES)] == list(states[compose[f, g]])


def test_digests(spark, docs, edges):
    want = reference(MULTI)
    for df in (docs, edges):
        rows = bpe.digest_documents(df, MULTI).collect()
        assert len(rows) == df.count()
        known = texts(df)
        for r in rows:
            ids = want.encode_ordinary(known[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(known[r["doc_id"]].encode()).hexdigest()
    held = bpe.encode_documents(edges.filter("doc_id = 3"), MULTI).first()
    assert held["ids"] == want.encode_ordinary(EDGES[2][1]) and held["offsets"][0] == 0 and len(held["offsets"]) == len(held["ids"])
    assert bpe.digest_documents(edges.limit(0), MULTI).count() == 0


def components_of(fps, distance):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in ids}


def brute_fingerprint(text, size=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    import xxhash

    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query_equals_brute_force(spark, docs):
    rows = registry.op3_simhash(spark, SF).collect()
    fps = {i: brute_fingerprint(t) for i, t in texts(docs).items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == components_of(fps, 2)


@pytest.mark.parametrize("distance", [2])
def test_links_connect_all_close_fingerprints(spark, distance):
    rnd = random.Random(distance)
    fps = {0: 0, 1: 1 << 63}
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 8)):
            fps[len(fps)] = base
            for _ in range(rnd.randint(0, 2)):
                base ^= 1 << rnd.randrange(64)
    distinct = sorted(set(fps.values()))
    df = spark.createDataFrame([(simhash._signed(x),) for x in distinct], "fp bigint")
    roots = {r["node"] & (2**64 - 1): r["root"] for r in graph.components(simhash.links(df, distance)).collect()}
    brute = components_of(dict(enumerate(distinct)), distance)
    for i, j in itertools.combinations(range(len(distinct)), 2):
        assert (brute[i] == brute[j]) == (roots.get(distinct[i], i) == roots.get(distinct[j], j))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in graph.components(df).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(df.limit(0)).count() == 0


def test_simhash_edges(edges):
    rows = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.groups(edges).collect()]
    assert len(rows) == len(EDGES)
    by = {i: c for i, _, c in rows}
    assert by[4] == 3 and by[2] == by[1] == by[6] == 1 and {f for i, f, _ in rows if i in (1, 2, 6)} == {0}
    assert simhash.groups(edges.limit(0)).count() == 0


def test_similar_groups_keep_one_of_each_group(spark):
    ship(spark)
    rnd = random.Random(9)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(3000)]
    rows, group = [], {}
    for g in range(12):
        base = rnd.choices(words, k=rnd.choice((80, 300, 900)))
        for k in range(1 if g < 4 else 4):
            own = list(base)
            for _ in range(k and max(1, len(own) // 120)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(own), "x"))
    rows.append((None, "no id", "x"))
    rows.append(rows[-2])
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    found = simhash.similar_groups(df)
    assert found.count() == len(rows)
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [min(i for i, x in group.items() if x == g) for g in range(12)] and ids.count(None) == 1


def test_similar_groups_decide_by_the_shingle_sets(spark):
    ship(spark)
    rnd = random.Random(4)

    def words(n):
        return ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(n)]

    rows, alike, unlike = [], [], []
    for k in range(30):  # 1,800 against 2,236 shingles (0.805), 100 against 133 (0.752)
        for begin, more, out in ((1804, 436, alike), (104, 33, unlike)):
            base = words(begin)
            out.append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base + words(more)))]
    found = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert [found[b] for _, b in alike] == [a for a, _ in alike]
    assert [found[b] for _, b in unlike] == [b for _, b in unlike]


def test_similar_groups_find_short_texts(spark):
    ship(spark)
    rnd = random.Random(5)
    opening = "all of them begin with these nine common words"
    rows = []
    for k in range(40):
        for n in (8, 9, 14, 24, 44):  # shingles 4 to 40, and a quarter more
            own = opening.split() * (n > 20) + ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(n + n)]
            rows += [(len(rows), " ".join(own[:n])), (len(rows) + 1, " ".join(own[: n + (n - 4) // 4]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    alike = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    found = dict(simhash.similar_groups(df).collect())
    assert len(alike) == 200 and all(found[a] == found[b] for a, b in alike) and len(set(found.values())) == 200


def test_packing(spark, docs, edges):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    for df in (docs, edges):
        pieces = packing.pack_documents(df, ENGLISH).collect()
        known = {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in texts(df).items()}
        copies = {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
        at: dict = {}
        for p in pieces:
            ids = known[p["doc_id"]]
            assert p["doc_tokens"] == len(ids) and 0 < p["length"] <= 1024
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            at.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert sum(p["length"] for p in pieces) == sum(len(ids) * copies[i] for i, ids in known.items())
        for spans in at.values():
            spans.sort()
            assert [a for a, _ in spans] == [0, *itertools.accumulate(n for _, n in spans)][:-1] and sum(n for _, n in spans) <= 1024
    assert packing.pack_documents(edges.limit(0), ENGLISH).count() == 0


def test_packing_matches_added_tokens(spark, monkeypatch):
    from tokenizers import Tokenizer

    own, mark = Tokenizer.from_file(P.path("byte_bpe_50k.json")), "<|endoftext|>"
    rows = list(enumerate([f"a {mark} b", f"{mark}{mark}", f"one  {mark}", f"{mark} two {mark}'s 12{mark}x", "none at all", "", "<|endof" + mark + "text|>", f"word {mark} " * 900]))
    ship(spark)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(registry, "table", lambda *_: df)
    known = {i: [*own.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    assert known[0] == [64, 220, 50256, 275, 0]
    pieces = registry.op7_packing(spark, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(known)
    for p in pieces:
        ids = known[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())


def test_packing_plan_uses_up_the_histogram():
    rnd = np.random.default_rng(4)
    histogram = np.bincount(rnd.integers(1, 1025, 20_000), minlength=1025)
    histogram[700] += 2_000  # a frequent length
    left = histogram.copy()
    used = padded = 0
    for combo, many in packing.plan(histogram, 1024):
        assert many > 0 and sum(combo) <= 1024
        for x in combo:
            left[x] -= many
        used, padded = used + many * sum(combo), padded + many * 1024
    assert not left.any() and used / padded > 0.9


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        f = tokenfile.Feistel(n, 5)
        slots = f.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and f.numbers(slots).tolist() == list(range(n))
    assert tokenfile.Feistel(1000, 5).slots(np.arange(9)).tolist() != tokenfile.Feistel(1000, 6).slots(np.arange(9)).tolist()


@pytest.mark.parametrize("changed", [False, True])
def test_token_files(spark, docs, edges, monkeypatch, changed):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if changed:  # other splits after the packs are written, as with lost or added executors
        first = tokenfile.written

        def written(*args):
            out = first(*args)
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
            return out

        monkeypatch.setattr(tokenfile, "written", written)
    own = reference(ENGLISH)
    try:
        for df in (docs, edges):
            spark.conf.set("spark.sql.files.maxPartitionBytes", held)
            path, layout = tokenfile.write_tokens(df, ENGLISH, stride=256)
            known = {i: [*own.encode_ordinary(t), 0] for i, t in texts(df).items()}
            grid = {r["slot"]: np.frombuffer(r["ids"], "<u2") for r in tokenfile.read(spark, path, layout).collect()}
            assert sorted(grid) == list(range(layout.total))
            filled = np.zeros((layout.total, 256), int)
            pieces = spark.read.parquet(f"{path}/index").collect()
            for r in pieces:
                a = r["offset"]
                assert grid[r["slot"]][a : a + r["length"]].tolist() == known[r["doc_id"]][r["start"] :][: r["length"]]
                filled[r["slot"], a : a + r["length"]] += 1
            assert filled.max() == 1 and sum(r["length"] for r in pieces) == sum(len(known[r["doc_id"]]) for r in df.collect())
            assert (filled.min(1) == 0).sum() <= df.rdd.getNumPartitions()  # only a stream's last sequence is padded
            rows = {r["slot"]: r for r in tokenfile.digests(spark, path, layout).collect()}
            assert {s: r["ids_crc32"] for s, r in rows.items()} == {s: zlib.crc32(x.astype("<u4").tobytes()) for s, x in grid.items()}
            middle = layout.total // 2
            assert sorted(r["slot"] for r in tokenfile.read(spark, path, layout, middle).collect()) == list(range(middle, layout.total))
            files = sorted(f.getPath().toString() for f in tokenfile._files(spark, f"{path}/shards"))
            for slot in (0, middle, layout.total - 1):
                shard, at = layout.locate(slot)
                with open(files[shard].removeprefix("file:"), "rb") as f:
                    f.seek(at)
                    raw = f.read(layout.record)
                assert int.from_bytes(raw[:8], "little") == slot and raw[8:-1] == grid[slot].tobytes()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    path, layout = tokenfile.write_tokens(edges.limit(0), ENGLISH)
    assert layout.total == 0 and tokenfile.digests(spark, path, layout).count() == 0


@pytest.mark.parametrize(("block", "group", "waves"), [(8192, 2048, topk.WAVES), (16, 3, (1, 2, 3))])
def test_topk(spark, monkeypatch, block, group, waves):
    ship(spark)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", group)
    monkeypatch.setattr(topk, "WAVES", waves)
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    odd = [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, [1.0, 2.0]), (505, []), (None, rows[1][1]), (0, rows[0][1])]
    rows += [(550, [3e6, -2e6, 0.25, 1.0, 2.0, 3.0, 4.0, 5.0]), (506, [1e300] * 8), (600, [-1e300] * 8)]  # components of more than 31 bits after scaling
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id bigint, embedding array<double>, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, df.filter("vec_id % 50 = 0")).collect()}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows + [(504, [1.0, 2.0])]}
    limit = (1 << 63) - 1

    def product(a, b):
        return max(-limit - 1, min(limit, sum(x * y for x, y in zip(a, b))))

    want = {}
    for q in (i for i in whole if i % 50 == 0):
        found = sorted((-product(whole[q], v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:11]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(found[:10])}
    # a repeated row of id 0 is a candidate for others, too
    zero = {q for q, _ in want if any(want[q, k][0] == 0 for k in range(1, 11) if (q, k) in want)}
    assert {k: v for k, v in got.items() if k[0] not in zero} == {k: v for k, v in want.items() if k[0] not in zero}
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_query_equals_brute_force(spark):
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in registry.op1_topk(spark, SF).collect()}
    v = table(spark, SF, "embeddings").toPandas()
    ids, m = v.vec_id.to_numpy(), np.floor(np.array(v.embedding.tolist()).astype(float) * 1024).astype(int)
    want = {}
    for i in np.flatnonzero(ids % 100 == 0):
        order = [j for j in np.lexsort((ids, -(m @ m[i]))) if j != i][:10]
        want |= {(ids[i], k + 1): (ids[j], m[i] @ m[j]) for k, j in enumerate(order)}
    assert rows == want


def brute_chunks(data):
    out, at, n = [], 0, len(data)
    hashes, window = [], 1 << chunking.WINDOW_DOUBLINGS
    for i in range(n):
        hashes.append(sum(int(chunking.GEAR[data[i - j]]) << j for j in range(min(window, i + 1))) & 0xFFFFFFFF)
    while at < n:
        end = min(at + chunking.MOST, n)
        for stop in range(at + chunking.LEAST, end):
            mask = int(chunking.STRICT if stop < at + chunking.NORMAL else chunking.LOOSE)
            if hashes[stop - 1] & mask == 0:
                end = stop
                break
        out.append(data[at:end])
        at = end
    return out


def test_chunks_equal_brute_force(docs):
    for t in [*list(texts(docs).values())[:12], "", "a", "x" * 500]:
        data = t.encode()
        chunks = brute_chunks(data)
        found = chunking.chunk_sets([b"before " * 9, data, b"after"])[1]
        assert len(found) == len(set(chunks)) and sum(found.values()) == sum(map(len, set(chunks)))
        assert chunking.decode(chunking.encode(found)) == found
    data = max(texts(docs).values(), key=len).encode()
    a, b = chunking.chunk_sets([data, b"new start " + data])
    assert chunking.containment(a, b) > 0.8


def test_edits(docs, edges):
    for df in (docs, edges):
        rows = chunking.compare_edits(df).collect()
        assert len(rows) == df.count()
    known = sorted(texts(docs).items(), reverse=True)
    by = {r["doc_id"]: r for r in chunking.compare_edits(docs).collect()}
    for k, (i, t) in enumerate(known):
        after = known[(k + 1) % len(known)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, changed, following = chunking.chunk_sets([t.encode(), edited.encode(), after.encode()])
        r = by[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (chunking.encode(own), chunking.encode(changed))
        assert r["near_edited"] == pytest.approx(chunking.containment(own, changed)) and r["near_next"] == pytest.approx(chunking.containment(own, following))
    assert {r["doc_id"]: r["fingerprint"] for r in chunking.fingerprint_documents(docs).collect()} == {i: r["fingerprint"] for i, r in by.items()}
    assert chunking.compare_edits(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = registry.op6_toxicity(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    toxic = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.6 * len(toxic)


def test_neighbours_votes_and_scores_equal_brute_force():
    rnd = random.Random(8)
    terms = [toxicity.ALL, *"abcdefghij"]
    counts = [{0: rnd.randint(5, 90)} | {t: rnd.randint(1, 5) for t in rnd.sample(range(1, 11), rnd.randint(0, 4))} for _ in range(300)]
    labels = [int(1 in c) for c in counts]
    examples = toxicity.Examples(terms, np.array([1.0] + [2.0 + k / 3 for k in range(10)]), list(range(300)), labels, counts, (900, 100))

    def brute(q, but=None):
        found = sorted((-round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), i) for i, v in enumerate(examples.vectors) if i != but)
        return [(-s, i) for s, i in found if s < 0 and s <= found[14][0]]  # all that equal the last one

    def votes(found):
        weight = [(900 / labels.count(0), 100 / labels.count(1))[labels[i]] / (1.02 - s) for s, i in found]
        return sum(w for w, (_, i) in zip(weight, found) if labels[i]) / sum(weight)

    for c in counts[:60]:
        q = examples.weights(c)
        found = examples.nearest([q], 15)[0]
        got = list(zip(*(x.tolist() for x in found), strict=True))
        assert [s for s, _ in got] == pytest.approx([s for s, _ in brute(q)], abs=1e-9)
        assert examples.votes(*found) == pytest.approx(votes(got))
        score, evidence = examples.score([c])[0]
        step = max(0, sum(x <= votes(got) + 1e-12 for x in examples.steps) - 1)
        assert score == pytest.approx(min(1, max(0, examples.values[step]))) and evidence == [i for _, i in got[:5]]
    # isotonic values: non-decreasing, and their weighted mean is the weighted share of toxic examples, up to the prior's weight
    assert (np.diff(examples.values) >= -1e-12).all() and (np.diff(examples.steps) > 0).all()
    pairs = [(votes(brute(v, i)), labels[i]) for i, v in enumerate(examples.vectors)]
    low, high = ([y for x, y in pairs if (x < 0.2) == side] for side in (True, False))
    assert sum(low) / max(1, len(low)) < sum(high) / max(1, len(high))
    assert 0 <= examples.score([{}])[0][0] <= 1


def test_ids_have_no_part_in_a_toxicity_score():
    rnd = random.Random(9)
    terms = [toxicity.ALL, *"abc"]
    counts = [{0: rnd.randint(2, 3)} | {t: 1 for t in rnd.sample((1, 2, 3), rnd.randint(0, 2))} for _ in range(200)]  # many equal cosines
    labels = [int(1 in c and rnd.random() < 0.7) for c in counts]
    scores = []
    for _ in range(4):
        ids = list(range(200))
        rnd.shuffle(ids)
        examples = toxicity.Examples(terms, np.array([1.0, 2.0, 2.5, 3.0]), ids, labels, counts, (900, 100))
        scores.append([s for s, _ in examples.score(counts)])
    assert all(s == pytest.approx(scores[0], abs=1e-9) for s in scores)


def test_toxicity_of_other_ids_and_clashing_labels(spark, docs):
    df = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")).withColumn("score", F.lit("mine"))
    labels = table(spark, SF, "labels").withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    examples = toxicity.fit(df, labels.unionByName(labels.withColumn("toxic", F.lit(0))))  # each id twice; toxic counts
    assert sum(examples.labels) == table(spark, SF, "labels").filter("toxic = 1").join(docs, "doc_id").count()
    out = toxicity.score(df, examples)
    assert dict(out.dtypes)["evidence"] == "array<string>" and out.count() == docs.count()
    kept = toxicity.accepted(df, examples)
    assert kept.columns == df.columns and {r["score"] for r in kept.collect()} == {"mine"}


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(1, 0, None), (3, 1, 1), (4, None, 0), (None, 1, 1), (99, 1, 0)], "doc_id bigint, toxic int, quality int")
    for known in (labels, labels.limit(0)):
        out = toxicity.score(edges, toxicity.fit(edges, known))
        rows = out.collect()
        assert len(rows) == len(EDGES) and all(0 <= r["score"] <= 1 for r in rows) and dict(out.dtypes)["score"] == "double"
    assert toxicity.score(edges.limit(0), toxicity.fit(edges.limit(0), labels)).count() == 0


def test_quality_separates_noise(spark):
    sf = "/root/testdata/sf0.01"
    rows = registry.op5_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    good, bad = ([r["accepted"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.4 * len(bad)


def test_kneser_ney_equals_a_plain_computation(spark, docs):
    rows = docs.select("text", "lang").collect()
    n, langs = quality.ALPHABET, sorted({r["lang"] for r in rows})
    model = quality.train(quality.count_trigrams(docs), langs)
    p = np.exp2(-model.bits.astype(float)).reshape(len(langs) + 1, -1, n)
    assert np.allclose(p.sum(2), 1, atol=1e-4)
    for lang in langs[:2]:
        counts = np.zeros((n, n, n))
        for r in rows:
            if r["lang"] == lang and r["text"]:
                np.add.at(counts.reshape(-1), quality.codes([r["text"]])[0], 1)
        lower = np.full(n, 1.0 / n)
        for c in ((counts.sum(0) > 0).sum(0)[None], (counts > 0).sum(0), counts.reshape(n * n, n)):
            k = [float((c == x).sum()) for x in (1, 2, 3, 4)]
            y = k[0] / max(k[0] + 2 * k[1], 1)
            d = [max(0.05 * x, min(x - 0.05, x - (x + 1) * y * k[x] / max(k[x - 1], 1))) for x in (1, 2, 3)]
            if c.shape[0] == 1:
                c = (counts > 0).sum(0).astype(bool).sum(0)[None].astype(float)
            taken = np.where(c == 0, 0, np.where(c == 1, d[0], np.where(c == 2, d[1], d[2])))
            total = c.sum(1, keepdims=True)
            own = np.divide(c - taken, total, out=np.zeros_like(taken), where=total > 0)
            back = np.where(total > 0, taken.sum(1, keepdims=True) / np.maximum(total, 1), 1)
            low = np.tile(lower, (n, 1)) if lower.ndim == 2 and c.shape[0] == n * n else lower
            lower = own + back * low
            lower = lower[0] if lower.shape[0] == 1 else lower
        own = p[model.langs[lang]]
        assert np.allclose(own, lower, atol=1e-4)


def test_perplexity_equals_a_plain_computation(spark, docs, monkeypatch):
    monkeypatch.setattr(quality, "BATCH_DOCS", 7)
    labels = table(spark, SF, "labels")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    held = {r["doc_id"]: r for r in rows}
    model = quality.train(quality.count_trigrams(docs.filter(F.col("doc_id").isin(good))), sorted({held[i]["lang"] for i in good}))

    def words(text):
        """(symbols of the words, [(place, symbol) of the white space that is spelled]) of a text."""
        own, found, white, begin = quality.symbols([text])[0].tolist(), [], [], None
        for i, x in enumerate([*own, quality.SPACE]):
            if x not in (quality.SPACE, quality.WHITE):
                begin = i if begin is None else begin
            elif begin is not None:
                found.append(tuple(own[begin:i]))
                begin = None
                white += [i] * (x == quality.WHITE)
            elif i < len(own):
                white.append(i)
        return own, found, white

    counts = {lang: Counter(w for i in good if held[i]["lang"] == lang for w in words(held[i]["text"])[1]) for lang in {r["lang"] for r in rows}}
    n, size = quality.ALPHABET, quality.SPACE
    got = {r["doc_id"]: r["perplexity"] for r in quality.score(docs, labels).collect()}
    for r in rows:
        known, bits = counts[r["lang"]], model.bits[model.langs[r["lang"]]].astype(float)
        k = [sum(x == y for x in known.values()) for y in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1])
        d = [0, *(max(0.05 * x, min(x - 0.05, x - (x + 1) * y * k[x] / max(k[x - 1], 1))) for x in (1, 2, 3))]
        total, back = sum(known.values()), sum(d[min(x, 3)] for x in known.values()) / sum(known.values())
        own, found, white = words(r["text"])
        mine = Counter(found) if r["doc_id"] in good else Counter()
        want = sum(bits[((own[i - 2] if i > 1 else 0) * n + (own[i - 1] if i else 0)) * n + own[i]] for i in white)
        for w, often in Counter(found).items():
            whole = [0, size, *w, size]
            spelled = sum(bits[(a * n + b) * n + c] for a, b, c in zip(whole, whole[1:], whole[2:]))
            left = known[w] - mine[w]
            want -= often * math.log2((left - d[min(left, 3)]) / total + back * 2.0**-spelled)
        assert math.isclose(math.log2(got[r["doc_id"]]), want / len(own), rel_tol=1e-4)


def test_quality_in_turns_and_by_a_shuffle(spark, monkeypatch, docs):
    labels = table(spark, SF, "labels")
    want = sorted(map(tuple, quality.score(docs, labels).select("doc_id", "perplexity", "accepted").collect()))
    monkeypatch.setattr(quality, "MODELS", 1)
    monkeypatch.setattr(quality, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, quality.score(docs, labels).select("doc_id", "perplexity", "accepted").collect())) == want


def test_quality_edges(spark, edges):
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 1), (5, 0)], "doc_id bigint, quality int")
    for known in (labels, labels.limit(0)):
        out = quality.score(edges, known)
        by = {r["doc_id"]: r for r in out.collect()}
        assert out.count() == len(EDGES) and not by[1]["accepted"] and not by[2]["accepted"] and by[1]["perplexity"] == 1
    assert quality.score(edges.limit(0), labels.limit(0)).count() == 0


def test_language_of_held_out_rows(spark, docs):
    sf = "/root/testdata/sf0.01"
    rows = registry.op8_langid(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_bit_classifiers_equal_a_plain_computation(spark, docs):
    codes = langid.fit(docs)
    counts = np.zeros((len(codes.langs), langid.BUCKETS))
    for r in langid.count_grams(docs).collect():
        counts[codes.langs.index(r["lang"]), r["bucket"]] = r["n"]
    p = (counts + langid.SMOOTH) / (counts.sum(1, keepdims=True) + langid.SMOOTH * langid.BUCKETS)
    odds = np.stack([np.log(p[x].mean(0)) - np.log(p[~x].mean(0)) for x in codes.words.T > 0], 1)
    own = (p @ odds) * codes.words
    scale = np.abs(own).mean(0)
    weight = np.maximum(own.min(0), 1e-3 * scale)
    assert np.allclose(codes.odds, odds, atol=1e-4) and np.allclose(codes.scale, scale) and np.allclose(codes.weight, weight / weight.sum())
    sample = [t for t in list(texts(docs).values())[:40] if t]
    buckets, seen, sizes, _ = langid.grams(sample)
    for k, (a, b) in enumerate(zip(np.cumsum(sizes) - sizes, np.cumsum(sizes))):
        mean = sum(codes.odds[buckets[o, a:b][seen[a:b]]].sum(0, dtype=float) for o in range(3)) / (3 * seen[a:b].sum())
        loss = (np.log1p(np.exp(-langid.STEEP * mean / codes.scale * codes.words)) * codes.weight).sum(1)
        assert codes.decode([sample[k]])[0] == [codes.langs[int(loss.argmin())]]


def test_many_languages_and_long_texts_in_chunks(spark, monkeypatch):
    rnd = random.Random(6)
    ship(spark)
    letters = [[chr(0x4E00 + 40 * k + j) for j in range(12)] for k in range(40)]
    rows = [(i, f"l{i % 40:02d}", " ".join("".join(rnd.choices(letters[i % 40], k=4)) for _ in range(30))) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    codes = langid.fit(df)
    want = codes.decode([t for *_, t in rows])
    assert want[0] == [x for _, x, _ in rows]
    monkeypatch.setattr(langid, "CHUNK", 37)
    monkeypatch.setattr(langid, "LOSSES", 10)
    again = codes.decode([t for *_, t in rows])
    assert again[0] == want[0] and np.allclose(again[1], want[1])


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 20, 100):
        m = langid.codewords(n)
        assert all((a != b).any() for a, b in itertools.combinations(m.tolist() and m, 2)) and (np.abs(m.sum(0)) < n).all()
    m = langid.codewords(30)
    assert min((a != b).sum() for a, b in itertools.combinations(m, 2)) >= 8


def test_language_edges(spark, edges, docs):
    codes = langid.fit(docs)
    by = {r["doc_id"]: r for r in langid.predict(edges, codes).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 6)] == ["und"] * 3 and by[3]["lang_pred"] in codes.langs
    none = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.predict(edges, none).collect()} == {"und"}
    one = langid.fit(docs.filter("lang = 'en'"))
    assert {r["lang_pred"] for r in langid.predict(edges, one).collect()} == {"und", "en"}
    assert langid.predict(edges.limit(0), codes).count() == 0


def test_main_text():
    field = html.trained()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
      <div class="ad">Buy now</div><article><h1>The  heading &amp; more</h1><p><b>Bold start.<br><p>First&nbsp;paragraph, with
      text &lt;here&gt;.</p><div class="newsletter">Subscribe to us</div><form><label>Name</label><input></form><p>Last one &#233;.</article>
      <section id="comments"><p>Nice article, thanks.</p></section><script>var x="</p>";</script><footer>&copy; us</footer></body></html>"""
    assert html.main_text(page, field) == "The heading & more\n\nBold start.\n\nFirst paragraph, with text <here>.\n\nLast one é."
    for odd in ("", "<", "<<p", "</", "<!--", "<p", "a < b", "<script>x", "&#0;&bad;", "<p>" * 3000, "<table><td>x", "<a href='>'>t"):
        assert isinstance(html.main_text(odd, field), str)


def test_odd_tags_and_deep_pages():
    field = html.trained()
    assert html.main_text('<p>See <a title="a > b" href="x">link</a>', field) == "See link"
    assert html.main_text('<p data-x="1>0">Second', field) == "Second"
    assert html.main_text("<p title=don't>It's third</p>", field) == "It's third"
    assert html.main_text("<article><p>Let <math><mi>x</mi></math> be. <button>Copy</button> <svg><text>now</text></svg></p></article>", field) == "Let x be. Copy now"
    import time

    begun = time.perf_counter()
    html.main_text("<div>a" * 16_000, field)
    html.main_text("<i>" * 16_000 + "<div>x</b></div>" * 16_000, field)
    assert time.perf_counter() - begun < 8


#: Pages written by hand, apart from the generator, with the main text a reader would mark.
HAND = [
    ("""<html><body bgcolor=white><table width=100%><tr><td><a href=/>Home</a></td><td><a href=/n>News</a></td><td><a href=/c>Contact</a></td></tr>
     <tr><td colspan=3><h1>The bridge reopens</h1><p>After two years of repairs the old bridge was opened again on Monday, and the first carts crossed it at dawn.</p>
     <p>The mayor said that the cost had been lower than feared, and thanked all who had worked through the winter.</p></td></tr><tr><td>Copyright 2020 Foo</td></tr></table></body></html>""",
     ["The bridge reopens", "After two years of repairs the old bridge was opened again on Monday, and the first carts crossed it at dawn.", "The mayor said that the cost had been lower than feared, and thanked all who had worked through the winter."]),
    ("""<div id="page"><div class="top-menu"><ul><li><a href=1>Start</a></li><li><a href=2>Archive</a></li></ul></div><div class="entry"><h2>On sourdough</h2>
     <p>Feed the starter twice a day, and keep it in a warm place until it doubles.</p><p>Then fold the dough every half hour.</p></div>
     <div class="sidebar"><h3>Recent posts</h3><ul><li><a href=3>Rye</a></li></ul></div><div class="footer">All rights reserved.</div></div>""",
     ["On sourdough", "Feed the starter twice a day, and keep it in a warm place until it doubles.", "Then fold the dough every half hour."]),
    ("""<body><header><nav><a href=/>Docs</a> <a href=/api>API</a></nav></header><main><h1>Install</h1><p>Unpack the archive into a folder of your choice.</p>
     <pre>tar xf tool.tar
cd tool</pre><p>Run the script, and follow its questions.</p></main><aside><p>Need help? Ask us.</p></aside><footer><p>&copy; 2021 Tool makers</p></footer></body>""",
     ["Install", "Unpack the archive into a folder of your choice.", "tar xf tool.tar cd tool", "Run the script, and follow its questions."]),
    ("""<body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><article><h1>A quiet harbour</h1>
     <p>Boats lay still in the evening light while gulls picked over the nets that had been left to dry.</p><aside class="promo">Subscribe for more stories</aside>
     <p>By night the water was black, and nobody spoke.</p></article><section class="comments"><h3>2 comments</h3><div class="comment"><p>Lovely.</p></div></section></body>""",
     ["A quiet harbour", "Boats lay still in the evening light while gulls picked over the nets that had been left to dry.", "By night the water was black, and nobody spoke."]),
]


def test_field_on_pages_written_by_hand():
    field, right, total = html.trained(), 0, 0
    for page, want in HAND:
        got = html.main_text(page, field).split("\n\n")
        right += len(set(got) & set(want))
        total += len(set(got) | set(want))
    assert right >= 0.9 * total


def test_field_on_held_out_pages():
    field, right, total = html.trained(), 0, 0
    for page, truth in html.training_pages(60, 77):
        found = html.blocks(page)
        assert len(found) == len(truth)
        right += sum(a == b for a, b in zip(field.label(found), truth))
        total += len(truth)
    assert right >= 0.98 * total


def test_viterbi_equals_enumeration():
    field = html.trained()
    for page, _ in html.training_pages(12, 5)[:12]:
        found = html.blocks(page)[:9]
        sums = [field.sums(f) for f in html.features(found)]
        best = max(itertools.product((0, 1), repeat=len(found)), key=lambda y: sum(s[k] for s, k in zip(sums, y)) + sum(field.moves[a][b] for a, b in zip(y, y[1:])))
        assert field.label(found) == list(best)


def test_html_query(spark):
    ship(spark)
    rows = registry.op4_html(spark, SF).collect()
    assert len(rows) == table(spark, SF, "pages").count() and all(r["n_chars"] == len(r["text"]) > 0 for r in rows)
    df = spark.createDataFrame([(1, None, None, 1), (2, "u", "", 2), (2, "u", "<p>" + "long " * 50_000, 3)], "page_id bigint, url string, html string, n_chars int")
    assert sorted((r["page_id"], r["n_chars"]) for r in html.extract(df).collect()) == [(1, 0), (2, 0), (2, 249_999)]
    assert html.extract(df.limit(0)).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("size", [5, 12, 30, 60, 200, 1000])
def test_near_duplicates_equal_brute_force(spark, size):
    """Pairs of many similarities: none at 0.8 or more is lost, none below is linked."""
    ship(spark)
    rnd = random.Random(size)
    rows = []
    for k in range(60):
        base = ["".join(rnd.choices("abcdefghij", k=7)) for _ in range(size + 4)]
        other = list(base)
        for at in rnd.sample(range(len(base)), min(len(base), rnd.randint(0, max(1, size // 20)))):
            other[at] = "".join(rnd.choices("klmnop", k=7))
        other += ["".join(rnd.choices("qrstuv", k=7)) for _ in range(rnd.randint(0, size // 3))]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in rows]
    found = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    for k in range(60):
        assert (found[2 * k + 1] == 2 * k) == (jaccard(sets[2 * k], sets[2 * k + 1]) >= 0.8)
        assert found[2 * k] == 2 * k


def test_near_duplicates_of_real_documents_equal_brute_force(spark, docs):
    known = texts(docs)
    sets = {i: set(simhash.shingle_hashes(t, 5)) for i, t in known.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if (sets[a] or sets[b]) and jaccard(sets[a], sets[b]) >= 0.8 or not sets[a] and not sets[b]:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert dict(simhash.similar_groups(docs).collect()) == {i: find(i) for i in root}
    assert sorted(r["doc_id"] for r in simhash.without_near_duplicates(docs).collect()) == sorted({find(i) for i in root})


def test_unlike_texts_under_one_id_stay(spark):
    ship(spark)
    rows = [(1, "one two three four five six"), (1, "quite another text under the same id"), (2, "one two three four five six"), (1, "one two three four five six"), (None, "quite another text under the same id"), (None, "a text that has no id at all"), (3, ""), (4, None)]
    kept = simhash.without_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[1], rows[5], rows[6]], kept.schema).collect()))


CLASHING = {c: f"mine-{k}" for k, c in enumerate(["low", "high", "entropy", "accepted", "perplexity", "score", "predicted", "evidence", "_row", "_tie", "_lang", "_class", "whole", "n", "_own_3", "component_id"])}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_pipeline_stages_on_edge_cases(spark, docs, kind):
    """Nulls, empty and long texts, repeats, an empty table, and columns of any name: each stage keeps rows as they are or drops them."""
    import corpus_pipeline

    ship(spark)
    extra = [F.lit(v).alias(c) for c, v in CLASHING.items()]
    odd = spark.createDataFrame([(i, t) for i, t in EDGES], "doc_id bigint, text string")
    rows = docs.select(*docs.columns).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 10_000_000), allowMissingColumns=True)
    df = rows.withColumn("doc_id", F.col("doc_id").cast(kind)).select(*docs.columns, *extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        whole = [tuple(r) for r in df.collect()]
        kept = stage(spark, df, SF)
        assert kept.columns == df.columns and dict(kept.dtypes) == dict(df.dtypes), name
        assert stage(spark, df.limit(0), SF).count() == 0, name
        out = [tuple(r) for r in kept.collect()]
        assert set(out) <= set(whole) and 0 < len(out) <= len(whole), name
        if name == "toxicity":
            assert {r for r in whole if not r[1]} <= set(out)
    for pieces in (corpus_pipeline.STAGES[-1][1](spark, df, SF), corpus_pipeline.STAGES[-1][1](spark, df.limit(0), SF)):
        assert pieces.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        pieces.count()


def test_pipeline(spark):
    import corpus_pipeline

    sf, docs = SF, table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf).persist()
        assert kept.columns == columns and 0 < kept.count() <= docs.count(), name
        docs = kept
    pieces = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def families(rnd, kinds, copies, edits, words=120):
    """Texts of several families: copies of a text with some words replaced."""
    out = []
    for k in range(kinds):
        base = [f"k{k}w{rnd.randrange(10**6)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rnd.randrange(edits + 1)):
                own[rnd.randrange(words)] = f"x{rnd.randrange(10**9)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("small", "block"), [(12, 512), (3, 16)])
def test_families_and_crowds_equal_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "FAMILY_TEXTS", block)
    monkeypatch.setattr(simhash, "PRODUCT_SHINGLES", 64)
    rnd = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(220))
    held = families(rnd, 3, 40, 5) + [f"{' '.join(f'u{rnd.randrange(10**8)}' for _ in range(rnd.randrange(20, 90)))} {passage}" for _ in range(250)]
    held += ["one two three four five six", "one two three four five six seven", "", "a"]
    rows = list(enumerate(held))
    sets = [set(simhash.shingle_hashes(t, 5)) for t in held]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    found = dict(simhash.similar_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 0.8).collect())
    assert found == {i: find(i) for i in range(len(rows))}


def test_like_sets_equal_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 60)
    make = lambda k: [np.unique(np.concatenate([rng.choice(base, rng.integers(0, 60), replace=False), rng.integers(-9, 9, rng.integers(0, 4))])) for _ in range(k)]
    a, b = make(20), make(30)
    got = simhash.like((np.array([len(x) for x in a]), np.concatenate(a)), (np.array([len(x) for x in b]), np.concatenate(b)), 0.5)
    assert got.tolist() == [[len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y)) - 1e-9 and True for y in b] for x in a]


def test_quality_of_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    seen = registry.op5_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in seen}
    assert kept[1] > 0.99 and kept[0] < 0.2
