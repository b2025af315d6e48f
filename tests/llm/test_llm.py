"""Training-data operators against brute force, the libraries and planted cases."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.llm import components, embedding_dedup, fingerprints, line_dedup, lm_scoring, mixing, ngram_join, packing, suffix_dedup, token_counts, toxicity
from tesserine.llm.common import lower_ascii
from tesserine.llm.queries import MIXING_SQL, oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(12_000))
PASSAGE = "one shared passage of quite some length that repeats across documents, word for word, in many places here"
TEXTS = [
    "", None, "a", "same text of five words here", "same text of five words here", f"x {PASSAGE} tail one", f"{PASSAGE} other ending", LONG,
    LONG[:-5] + "changed end", "l1\nl2\nl3\nl4", "zz\nl1\nl2\nl3\nqq", "x\nx\nx\nx\nx", "Ünïcödé ß 日本語 🙂 a\tb\r\n", " \n\t ", "<|endoftext|> don't I'll", "aaaa" * 60, "aaaa" * 60 + "b",
]


def frame(spark, texts=TEXTS, extra=()):
    rows = [(i * 3, t, ["s1", "s0", None][i % 3], 7, "clash") for i, t in enumerate(texts)] + list(extra)
    # Extra columns whose names the operators use themselves.
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, task string").withColumnsRenamed({"task": "grp"})


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def texts():
    return {i * 3: t or "" for i, t in enumerate(TEXTS)}


def test_fingerprints(spark, docs, texts):
    got = by_id(fingerprints.fingerprint_pairs(docs, rows_per_part=4))
    order = sorted(texts)
    assert set(got) == set(order)
    own = {i: fingerprints.signatures([texts[i]]) for i in order}
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = texts[a], len(texts[a]) // 4
        e = t[: len(t) - n] + texts[b][:n]
        assert got[a].n_chars == len(t)
        assert got[a].edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert got[a].fingerprint == fingerprints._hex(own[a])[0]
        assert got[a].edited_fingerprint == fingerprints._hex(fingerprints.signatures([e]))[0]
        assert got[a].near_next == pytest.approx(fingerprints.likeness(own[a], own[b])[0])
        assert 0 <= got[a].near_edited <= 1
    assert got[9].fingerprint == got[12].fingerprint and got[9].near_next == 1.0
    assert got[21].near_next > 0.9  # a long text and its copy with another end


def test_substrings_share_interior_names():
    inner = LONG[:4000]
    a, b = (fingerprints.signatures([t])[0] for t in (inner, "some other start " + inner))
    assert fingerprints.likeness(a[None], b[None])[0] > 0.9


def test_single_document_is_its_own_next(spark):
    r = fingerprints.fingerprint_pairs(frame(spark, ["abcdefgh" * 9])).first()
    assert r.near_next == 1.0


def brute_spans(texts, span=50):
    first, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        cov = bytearray(len(b))
        for p in range(len(b) - span + 1):
            if first.setdefault(b[p : p + span], i) < i:
                cov[p : p + span] = b"\1" * span
        kept = bytes(c for c, m in zip(b, cov) if not m)
        out[i] = (len(b), sum(cov), sum(1 for x, y in zip(b"\0" + cov, cov) if y and not x), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(spark, docs, texts):
    want = brute_spans(texts)
    for size in (3, 1000):
        got = by_id(suffix_dedup.dedup_spans(docs, docs_per_group=size))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert want[18][1] >= len(PASSAGE)


def test_suffix_order_with_long_ties():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 300), np.tile([97, 98, 99], 60), rng.integers(97, 99, 300)]).astype(np.uint8)
    starts = np.arange(len(text) - 64)
    raw = text.tobytes()
    got = np.concatenate([starts[o] for o in suffix_dedup.sort_suffixes(suffix_dedup.words_at(text), starts, 50)])
    keys = [raw[p : p + 50] for p in got]
    assert keys == sorted(keys) and sorted(got.tolist()) == starts.tolist()


def test_difference_cover():
    for a in range(suffix_dedup.PERIOD):
        for b in range(suffix_dedup.PERIOD):
            d = suffix_dedup.SHIFT[a, b]
            assert {(a + d) % suffix_dedup.PERIOD, (b + d) % suffix_dedup.PERIOD} <= set(suffix_dedup.COVER)


def test_toxicity_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = toxicity.train(d, lab.where(~held))
    assert list(model.cuts) == sorted(model.cuts)
    r = toxicity.score(d, model).join(lab.where(held), "doc_id").collect()
    toxic = [x for x in r if x.toxic == 1]
    clean = [x for x in r if x.toxic == 0]
    # A tenth of the labels of this table contradict the texts.
    assert sum(x.rejected for x in toxic) / len(toxic) > 0.8
    assert sum(x.rejected for x in clean) / len(clean) < 0.02
    assert all(abs(sum(x.p_grades) - x.severity) < 1e-9 for x in r)


def test_toxicity_edges(spark, docs):
    none = toxicity.train(docs, spark.createDataFrame([(3, 0), (999, 1), (None, 1), (0, None)], "doc_id long, toxic int"))
    assert none is None
    assert not any(r.rejected for r in toxicity.score(docs, none).collect())
    assert toxicity.keep_clean(docs, none).count() == len(TEXTS)


def brute_lines(texts, window=3):
    seen, gone = set(), defaultdict(set)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        for p in range(len(lines) - window + 1):
            key = tuple(lines[p : p + window])
            if key in seen:
                gone[i].update(range(p, p + window))
            seen.add(key)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}


def test_line_dedup(spark, docs, texts):
    got = by_id(line_dedup.dedup_lines(docs))
    want = brute_lines(texts)
    assert {i: r.text or "" for i, r in got.items()} == want
    assert got[3].text is None and got[30].text == "zz\nqq" and got[33].text == "x"
    assert got[0].n_chars == 7 and got[0].grp == "clash"


def test_mixing(spark, docs, texts):
    r = mixing.mix(docs).collect()
    assert len(r) == len(TEXTS)
    total = sum(x.size for x in r)
    groups = defaultdict(list)
    for x in r:
        groups[x.doc_id // 3 % 3].append(x)
    size = {k: sum(x.size for x in v) for k, v in groups.items()}
    # Sources s0, s1, null weigh 5, 2, 1; reshare the excess until none is above its cap.
    weight, target, left = {1: 5, 0: 2, 2: 1}, {}, total
    open_ = dict(weight)
    while True:
        over = [k for k in open_ if left * open_[k] / sum(open_.values()) > 3 * size[k]]
        if not over:
            target |= {k: left * w / sum(open_.values()) for k, w in open_.items()}
            break
        for k in over:
            target[k] = 3 * size[k]
        left -= sum(3 * size[k] for k in over)
        for k in over:
            open_.pop(k)
    for k, v in groups.items():
        assert all(x.source_size == size[k] and x.target == pytest.approx(target[k]) for x in v)
        assert sum(x.taken for x in v) == math.floor(target[k] + 1e-9)
        assert all(0 <= x.taken <= 3 * x.size for x in v)
    assert sorted(map(tuple, r)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    words = sum(len(mixing_words(x.text)) for x in mixing.mixed_documents(docs).collect())
    assert abs(words - sum(x.taken for x in r)) <= 2


def mixing_words(t):
    from tesserine.llm.common import WORDS

    return WORDS.findall(t or "")


@pytest.mark.parametrize("seed", [0, 1])
def test_embeddings(spark, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((20, 24))
    x = np.concatenate([base, base + 0.02 * rng.standard_normal(base.shape), base[:5], base[:5] * 3, base + 0.35 * rng.standard_normal(base.shape)])
    lab = rng.integers(0, 2, len(x)).tolist()
    rows = [(i, [float(c) for c in v], k) for i, (v, k) in enumerate(zip(x, lab))]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [1.0, None], 1), (n + 4, [float(c) for c in base[0]], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 1), (n + 7, [float("inf")] + [0.0] * 23, 1)]
    embedding_dedup.CHUNK, before = 4, embedding_dedup.CHUNK
    got = by_id(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    embedding_dedup.CHUNK = before
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.93) & (np.array(lab)[:, None] == np.array(lab)[None, :])
    np.fill_diagonal(link, False)
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
    assert len(got) == len(rows)
    for i in range(n):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(n, len(rows)))


def test_token_counts(spark, docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = by_id(token_counts.token_counts(docs, path))
    for i, t in texts.items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 1024)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    twice = docs.unionByName(docs.where("doc_id = 9"))
    pieces = packing.pack(twice, path, shard_tokens=5000).collect()
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in texts.items()}
    cover, seq = Counter(), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        cover.update((p.doc_id, k) for k in range(p.start, p.start + p.length))
        seq[p.sequence_id].append((p.offset, p.length))
    assert cover == Counter({(i, k): 2 if i == 9 else 1 for i, v in ids.items() for k in range(len(v))})
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096 and not at & (at - 1)


def bm25(rows, vocabulary, k1=1.2, b=0.75):
    """Scores of all pairs (seed, row) by the formula, term by term."""
    df = Counter(t for r in rows for t in set(r))
    mean = sum(map(len, rows)) / len(rows)
    idf = np.array([math.log((len(rows) - df[t] + 0.5) / (df[t] + 0.5) + 1) for t in range(vocabulary)])
    counts = [Counter(r) for r in rows]
    score = [[sum(idf[t] * c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * len(r) / mean)) for t in set(q)) for c, r in zip(counts, rows)] for q in rows]
    return np.array(score), idf, mean


def test_packing_index_against_brute_force():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 60 if i % 3 else 300, rng.integers(1, 90)) for i in range(70)]
    want, idf, mean = bm25([t.tolist() for t in texts], 300)
    kind = np.dtype("<u2")
    half = [len(t) // 2 if i % 5 == 0 else 0 for i, t in enumerate(texts)]  # counted apart, as whole windows are
    extra = [np.stack(np.unique(t[:h].astype("<u4"), return_counts=True), axis=1).astype("<u4").tobytes() if h else b"" for t, h in zip(texts, half)]
    owner, term, count = packing.postings([t[h:].astype(kind).tobytes() for t, h in zip(texts, half)], extra, kind, 300)
    impact = packing.Scale(idf, mean).impact(owner, term, count, np.array([len(t) for t in texts], float))
    got = packing.Index(owner, term, impact, 70).search(np.arange(70))
    assert np.allclose(got, want, rtol=1e-5)

    # Windows are filled by descending score; with a bound only by rows that reach it.
    size = np.array([len(t) for t in texts])
    index = packing.Index(owner, term, impact, 70)
    for near in (None, 0.05, 0.5):
        left = size.copy()
        before, windows = left.copy(), packing.fill_windows(index, left, 128, near)
        for rows in windows:
            assert sum(n for _, n in rows) == 128
            seed, others = rows[0][0], [i for i, _ in rows[1:]]
            scores = want[seed][others]
            assert all(x >= y - 1e-3 for x, y in zip(scores, scores[1:]))
            assert near is None or (scores >= near * want[seed, seed] - 1e-3).all()
            unused = [i for i in np.flatnonzero(before) if i != seed and i not in others]
            assert not others or not unused or want[seed][unused].max() <= scores.min() + 1e-3
            for i, n in rows:
                before[i] -= n
        assert (before == left).all() and (near is not None or left.sum() < 128)


def test_packing_of_full_tails_and_null_ids(spark):
    """768 tails that nearly fill a window, rows without an id among them: shards stay below their bound, every id lies in one piece."""
    rows = [(None if i % 3 == 0 else i, " ".join(f"w{(i * 7 + k) % 500}" for k in range(1100))) for i in range(300)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("word_bpe_49k.json")).collect()
    full = {p.doc_tokens for p in pieces if p.doc_id is None}
    assert sum(p.length for p in pieces if p.doc_id is None) == sum(p.doc_tokens for p in pieces if p.doc_id is None and p.start == 0) and len(full) >= 1
    got = defaultdict(int)
    for p in pieces:
        if p.doc_id is not None:
            got[p.doc_id] += p.length
    assert got == {p.doc_id: p.doc_tokens for p in pieces if p.doc_id is not None}
    whole = defaultdict(int)
    for p in pieces:
        whole[p.sequence_id] += p.length
    assert all(n <= 4096 and not n & (n - 1) for n in whole.values())


@pytest.mark.parametrize("segment", [1 << 20, 3000])
def test_lm_scoring(spark, docs, texts, segment):
    got = by_id(lm_scoring.score(docs, segment_bytes=segment))
    tok = {i: [*mixing_words(lower_ascii(t)), None] for i, t in texts.items()}
    train = {i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2}
    c, big = Counter(), Counter()
    for i in train:
        c.update(tok[i])
        big.update(zip(["<s>", *tok[i]], tok[i]))
    n, v = sum(c.values()), len(c)

    def quantised(x):
        at = 1
        while x and (after := max(at + 1, math.ceil(at * 1.25))) <= x:
            at = after
        return (at + after - 1) // 2 if x else 0

    z = Counter()
    for (u, _), x in big.items():
        z[u] += quantised(x)
    for i, ts in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(ts), sum(c[w] > 0 for w in ts), n)
        base = [(c[w] + 1) / (n + v + 1) for w in ts]
        assert r.base_score == pytest.approx(sum(map(math.log10, base)))
        exact = 0.0
        for k, (u, w) in enumerate(zip(["<s>", *ts], ts)):
            exact += math.log10((quantised(big[u, w]) + lm_scoring.PRIOR * base[k]) / (z[u] + lm_scoring.PRIOR))
        assert r.score == pytest.approx(exact, rel=0.005)


def test_scores_near_those_of_exact_counts(spark):
    """The same smoothing with exact bigram counts, over the whole of sf0.01."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: [*mixing_words(lower_ascii(r.text or "")), None] for r in d.collect()}
    c, big = Counter(), Counter()
    for i, t in rows.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
            big.update(zip(["<s>", *t], t))
    hist = Counter()
    for (u, _), x in big.items():
        hist[u] += x
    n, v, m = sum(c.values()), len(c), lm_scoring.PRIOR
    for r in lm_scoring.score(d).collect():
        t = rows[r.doc_id]
        exact = sum(math.log10((big[u, w] + m * (c[w] + 1) / (n + v + 1)) / (hist[u] + m)) for u, w in zip(["<s>", *t], t))
        assert r.score == pytest.approx(exact, rel=0.02)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_a_history_sums_to_one(spark, sf):
    """p(w|u) over the vocabulary and the unknown word, for frequent, rare and unseen histories."""
    m, parts = lm_scoring.fit(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    table = lm_scoring.Table(m.slices, {r.slice: lm_scoring.part_of(r) for r in parts.collect()})
    words = np.concatenate([p.words for p in table.parts.values()])
    c, _ = table.words(words)
    assert len(words) == m.distinct and c.sum() == m.total
    by_count = words[np.argsort(c, kind="stable")]
    some = [*by_count[-15:], *by_count[:: max(1, len(words) // 33)][:33], *m.slices.hot[:1], np.uint64(12345)]
    assert len(some) >= 50
    for u in some:
        _, z = table.words(np.array([u]))
        q = table.levels(np.full(len(words), u), words)
        # Each word as the second token of a text of two, whose first is u.
        t = np.stack([np.full(len(words), u), words], axis=1).reshape(-1)
        cc, zz, qq = (np.stack([np.full(len(words), a), b], axis=1).reshape(-1) for a, b in ((0, c), (z[0], np.zeros(len(words), np.int64)), (0, q)))
        if u == lm_scoring.START:
            continue
        own = lm_scoring.log_scores(cc, zz, qq, t, np.full(len(words), 2), m)[2][1::2]
        unknown = lm_scoring.log_scores(np.array([0, 0]), np.array([z[0], 0]), np.array([0, 0]), np.array([u, 7], np.uint64), np.array([2]), m)[2][1]
        assert (10**own).sum() + 10**unknown == pytest.approx(1, abs=0.01)


def test_quantised_counts_never_read_low():
    rng = np.random.default_rng(0)
    items, counts = rng.integers(0, 1 << 48, 5000).astype(np.uint64), rng.integers(1, 4000, 5000)
    for blocks, room in ((1, 10.0), (3, 8.0)):
        bits = lm_scoring.build_filter(items, counts, blocks, room)
        q = lm_scoring.level_of(items, bits, blocks)
        assert (q >= lm_scoring.levels(counts)).all() and (q == lm_scoring.levels(counts)).mean() > 0.97
        other = rng.integers(0, 1 << 48, 200_000).astype(np.uint64)
        assert (lm_scoring.level_of(other, bits, blocks) > 0).mean() == pytest.approx(lm_scoring.rate_of(bits, blocks), rel=0.1, abs=5e-5)
        assert lm_scoring.rate_of(bits, blocks) == pytest.approx(lm_scoring.block_rate(room) ** blocks, rel=0.2)
    shapes = {v: lm_scoring.shape_for(v) for v in (1, 1e4, 4e5, 1e7, 1e9)}
    assert [b for b, _ in shapes.values()] == [3, 3, 3, 3, 4]
    assert all(v * lm_scoring.block_rate(room) ** b <= lm_scoring.PHANTOM * 1.01 for v, (b, room) in shapes.items() if v > 1e3)


def test_tokens_are_the_words_of_each_text():
    some = ["", " \n\t ", *[t or "" for t in TEXTS], "a", "A a", "É é", "x" * 5000 + " y", "\x1c\x1d a"]
    seen = {}
    for size in (10, 1 << 21):
        col = pa.array([*some, "skipped"], pa.string())[: len(some)]
        got = [(t, n) for a, z in lm_scoring.chunks(col, size) for t, n in [lm_scoring.tokens(col[a:z])]]
        t, n = (np.concatenate(x) for x in zip(*got))
        assert n.tolist() == [len(mixing_words(x)) + 1 for x in some]
        want = [w for x in some for w in [*mixing_words(lower_ascii(x)), None]]
        assert all(seen.setdefault(w, h) == h for w, h in zip(want, t.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) and seen[None] == lm_scoring.END


def test_ngram_join(spark):
    rng = np.random.default_rng(5)
    base = [f"v{k}" for k in rng.integers(0, 500, 300)]
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (10, 100, 200)]
    texts = [None, "", "a b", "a b", "a c", " ".join(base), " ".join(base), *near, " ".join(base[:150]), " ".join(reversed(base)), LONG]
    d = frame(spark, texts)
    ngram_join.BLOCK_SETS, before = 2, ngram_join.BLOCK_SETS
    got = by_id(ngram_join.ngram_join(d))
    ngram_join.BLOCK_SETS = before
    sets = [set(ngram_join.grams(t or "").tolist()) for t in texts]
    for i, s in enumerate(sets):
        want = sum(1 for j, o in enumerate(sets) if i != j and s and o and len(s & o) / len(s | o) >= 0.8)
        assert got[i * 3].n_links == want
    assert {got[i * 3].class_id for i in range(5, 10)} == {15}
    assert got[6].class_id == got[9].class_id == 6 and got[12].class_id == 12 and got[0].class_id == 0
    assert sorted(r.doc_id for r in ngram_join.keep_one(d).collect()) == [0, 3, 6, 12, 15, 30, 33, 36]


def test_bands_reach_recall():
    b, r = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, k) for k in range(200, 260)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain + star + [(300, 300)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {k: 7 for k in range(200, 260)}


def test_empty_tables(spark):
    d = frame(spark).where("false")
    path = tokenizer_path("byte_bpe_50k.json")
    for df in (
        fingerprints.fingerprint_pairs(d), suffix_dedup.dedup_spans(d), toxicity.score(d, None), line_dedup.dedup_lines(d), mixing.mix(d), mixing.mixed_documents(d),
        token_counts.token_counts(d, path), packing.pack(d, tokenizer_path("word_bpe_49k.json")), lm_scoring.score(d), ngram_join.ngram_join(d), ngram_join.keep_one(d),
        embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")),
    ):
        assert df.count() == 0


def test_repeated_and_null_ids(spark):
    d = frame(spark, TEXTS, [(9, TEXTS[3], "s1", 1, "x"), (None, PASSAGE, None, 1, "x"), (None, None, None, 1, "x")])
    n = len(TEXTS) + 3
    assert fingerprints.fingerprint_pairs(d, rows_per_part=4).count() == n
    assert suffix_dedup.dedup_spans(d).count() == n
    assert line_dedup.dedup_lines(d).count() == n
    assert mixing.mix(d).count() == n
    assert lm_scoring.score(d).count() == n
    assert lm_scoring.score(d, segment_bytes=3000).count() == n
    assert ngram_join.ngram_join(d).count() == n
    assert token_counts.token_counts(d, tokenizer_path("byte_bpe_50k.json")).count() == n
    assert packing.pack(d, tokenizer_path("word_bpe_49k.json")).count() >= n


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        df = queries()[name](spark, SF)
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, r.fetchall()))


def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    cols, kept = d.columns, d
    lab = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF)
        assert kept.columns == cols
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "toxicity":
            gone = {r.doc_id for r in before.select("doc_id").collect()} - ids
            assert gone and not any(lab.get(i) == 0 for i in gone)
        if name == "line_dedup":
            want = brute_lines({r.doc_id: r.text for r in before.collect()})
            assert {r.doc_id: r.text for r in kept.collect()} == want
        if name == "ngram_jaccard_join":
            rows = {r.doc_id: set(ngram_join.grams(r.text).tolist()) for r in before.collect()}
            hit = ngram_join.link_block([np.array(sorted(v), np.uint64) for v in rows.values()], None, 0.8)
            some = np.array([bool(v) for v in rows.values()])  # texts without words link with nothing
            hit &= some[:, None] & some[None, :]
            keys = list(rows)
            comp = list(range(len(keys)))
            for _ in keys:
                new = [min([comp[i], *(comp[j] for j in np.flatnonzero(hit[i]))]) for i in range(len(keys))]
                if new == comp:
                    break
                comp = new
            assert len(ids) == len(set(comp))
        kept = spark.createDataFrame(kept.collect(), kept.schema)
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() == corpus_pipeline.STAGES[-1][1](spark, kept, SF).count()


def test_packing_finds_neighbours_across_the_corpus(spark):
    """Pairs of copies far apart in the input and among many more documents than one index shard holds, meet in one window."""
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(4000)]
    texts = [" ".join(rng.choice(vocabulary[40 * k : 40 * k + 60], 250)) for k in range(60)]
    rows = [(i, texts[i % 60]) for i in range(120)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), tokenizer_path("word_bpe_49k.json"), window=2048, shard_tokens=20_000).collect()
    where = defaultdict(set)
    for p in pieces:
        where[p.doc_id].add(p.sequence_id)
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())
    assert sum(bool(where[i] & where[i + 60]) for i in range(60)) >= 54


def test_fingerprints_with_null_and_repeated_ids(spark):
    """The order is null ids first, then ids, equal ids by text; the last row's next is the first."""
    rows = [(None, "null row " * 9)] + [(i, f"text number {i} " * 7) for i in range(6)] + [(3, "another text of three " * 5), (None, "a null row " * 4)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for part in (2, 3, 100_000):
        got = fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows_per_part=part).collect()
        have = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got)
        want = [(str(d), len(t), hashlib.sha256(fingerprints.edited(t, n).encode()).hexdigest()) for (d, t), (_, n) in zip(order, order[1:] + order[:1])]
        assert have == sorted(want)


def test_fingerprint_phrases_are_locally_consistent():
    """A change far away changes no fingerprint slot but those of names around it: likeness follows the changed share."""
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 6000))
    far = base[:3000] + "#" + base[3000:]
    other = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 6000))
    half = base[:3000] + other[:3000]
    sig = fingerprints.signatures([base, far, other, half])
    assert fingerprints.likeness(sig[:1], sig[1:2])[0] > 0.9
    assert fingerprints.likeness(sig[:1], sig[2:3])[0] < 0.1
    # The Jaccard similarity of a text and one that shares half of it is about a third.
    assert 0.15 < fingerprints.likeness(sig[:1], sig[3:4])[0] < 0.55


def test_ngram_join_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, a), (None, "quite another text with some words in it"), (4, None), (None, None), (7, a), (7, a)]
    got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r.n_links >= 0 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.class_id, r.n_links))
    # Text a: ids 1 and 7 and a row without an id are three documents; document 2 is like all of them.
    assert by[2] == [(1, 3)] and by[7] == [(1, 3), (1, 3)]
    assert sorted(by[1]) == [(1, 1), (1, 3)] and by[3] == [(1, 1)]
    assert sorted(by[None], key=str) == [(1, 3), (None, 0), (None, 0)] and by[4] == [(4, 0)]


def test_embeddings_of_extreme_size_and_repeated_ids(spark):
    rng = np.random.default_rng(1)
    v, w = rng.standard_normal(12), rng.standard_normal(12)
    rows = [(1, (v * 1e160).tolist(), "a"), (2, (v * 1e-170).tolist(), "a"), (3, (v * 1e300).tolist(), "a"), (4, v.tolist(), "a"), (5, w.tolist(), "a"), (5, (v * 2 + w * 1e-3).tolist(), "a"), (6, (w * 3).tolist(), "b"), (None, v.tolist(), "a")]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    have = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got)
    assert have == sorted([(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (4, 5, 1, False), (5, 0, 5, True), (5, 5, 1, False), (6, 0, 6, True), (0, 5, 1, False)])


@pytest.mark.parametrize("span", [50, 100, 150])
def test_suffix_dedup_of_other_spans(spark, span):
    rng = np.random.default_rng(span)
    base = "".join(rng.choice(list("abcd "), 400))
    texts = {i: base[: 400 - 3 * i] + str(i) + base[400 - 3 * i :] for i in range(30)}
    got = by_id(suffix_dedup.dedup_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), span=span))
    want = brute_spans(texts, span)
    assert {i: got[i].n_removed for i in texts} == {i: want[i][1] for i in texts}


def test_fit_of_toxicity_is_bounded_in_rows(spark, monkeypatch):
    rows = [(i % 5, f"text {i} " + ("vile " if i % 5 < 2 else "nice ") * 4) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 2)) for i in range(5)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.append(len(rows)))
    toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, max_fit_rows=50)
    assert not seen or seen[0] <= 50


def test_columns_named_like_those_of_the_stages(spark):
    names = ["_nj", "_mx_id", "_mx_words", "row", "id", "tie", "kept_id", "words", "taken", "plan_id", "size", "class_id", "grp"]
    d = frame(spark).select("*", *[F.lit(k).alias(c) for k, c in enumerate(names) if c != "grp"])
    for got in (ngram_join.keep_one(d), mixing.mixed_documents(d), line_dedup.dedup_lines(d).select(*d.columns)):
        rows = got.collect()
        assert got.columns == d.columns and rows
        assert all(r[c] == k for r in rows for k, c in enumerate(names) if c != "grp")


def test_null_ids_spread_over_the_mix(spark):
    d = spark.createDataFrame([(None, f"text number {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    keys = mixing.mix(d).select("mix_key").distinct().count()
    assert keys == 500


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No rows, null texts, ids and sources, and extra columns: each stage runs and keeps the columns."""
    import corpus_pipeline

    odd = frame(spark, TEXTS, [(9, TEXTS[3], "s1", 1, "x"), (None, PASSAGE, None, 1, "x"), (None, None, None, 1, "x")]).withColumn("size", F.lit(1)).withColumn("cls", F.lit("c"))
    labels = spark.createDataFrame([(0, 0), (3, 1)], "doc_id long, toxic int")
    for k, d in enumerate((odd, odd.where("false"))):
        d.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        labels.where(F.lit(k == 0)).write.parquet(f"{tmp_path}/{k}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{k}")
            assert docs.columns == odd.columns
        pieces = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert bool(pieces) == (k == 0)
        tokens = {}
        for p in pieces:
            tokens[p.sequence_id] = tokens.get(p.sequence_id, 0) + p.length
        assert all(n <= 4096 and not n & (n - 1) for n in tokens.values())


def test_mixed_documents_keep_their_line_breaks(spark):
    """The document at the cut is a prefix of its text that ends with a word; the others are whole."""
    rows = [(i, "\n".join(f"w{i} x{k}\ty" for k in range(30)), "ab"[i % 2]) for i in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = by_id(mixing.mix(d))
    got = defaultdict(list)
    for r in mixing.mixed_documents(d).collect():
        got[r.doc_id].append(r.text)
    text = {i: t for i, t, _ in rows}
    for i, p in plan.items():
        assert sum(len(t.split()) for t in got[i]) == p.taken
        assert all(text[i].startswith(t) and t == t.rstrip() for t in got[i])
        assert sum(t != text[i] for t in got[i]) <= 1
    assert any(t != text[i] for i in got for t in got[i])


def plain_mix(x):
    """64-bit finaliser on whole numbers."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_fingerprint(text, slots, from_level):
    """The parsing of one text, symbol by symbol."""
    golden = 0x9E3779B97F4A7C15
    names, level, best = [ord(c) + 1 for c in text], 0, [None] * slots
    while names:
        if level >= from_level or len(names) == 1:
            for v in names:
                h = plain_mix((v + level * golden) % 2**64)
                best[h % slots] = h if best[h % slots] is None else min(best[h % slots], h)
        if len(names) == 1:
            break
        runs = []
        for v in names:
            if runs and runs[-1][0] == v:
                runs[-1][1] += 1
            else:
                runs.append([v, 1])
        sym = [v if n == 1 else plain_mix(v ^ n * golden % 2**64) for v, n in runs]
        lab = sym
        for _ in range(3):
            new = []
            for i, v in enumerate(lab):
                diff = max(v ^ lab[i - 1], 1) if i else 1
                k = (diff & -diff).bit_length() - 1
                new.append(2 * k + (v >> k & 1))
            lab = new
        cuts = [i for i in range(2, len(sym) - 1) if lab[i] < lab[i - 1] and lab[i] <= lab[i + 1]]
        bounds, names = [0, *cuts, len(sym)], []
        for a, z in zip(bounds, bounds[1:]):
            total = 0
            for place, v in enumerate(sym[a:z]):
                salted = (v ^ v >> 29) * (0x100000001B3 + (place + 1) * golden) % 2**64
                total += salted ^ salted >> 32
            names.append(plain_mix(total % 2**64 ^ z - a))
        level += 1
    return [0 if h is None else plain_mix(h) % 65535 + 1 for h in best]


def test_fingerprints_against_a_plain_parser():
    rng = np.random.default_rng(11)
    some = [t or "" for t in TEXTS if t != LONG] + ["".join(rng.choice(list("ab "), n)) for n in (1, 2, 3, 5, 40, 300)] + ["z" * 70, LONG[:900]]
    for level in (0, 2):
        got = fingerprints.signatures(some, 16, level)
        want = [plain_fingerprint(t, 16, level) for t in some]
        assert got.tolist() == want
    a, b = got[-1], got[-3]
    used = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if x or y]
    assert fingerprints.likeness(a[None], b[None])[0] == pytest.approx(sum(x == y for x, y in used) / len(used))


def test_toxicity_fit_against_plain_loops():
    """The same steps, row by row and threshold by threshold."""
    rng = np.random.default_rng(6)
    y = np.array([0] * 30 + [1] * 20)
    rows = [np.unique(np.concatenate([rng.integers(100, 160, 8), rng.choice([1, 2, 3, 4], rng.integers(1, 5)) if t else np.zeros(0, int)])) for t in y]
    model = toxicity.fit(rows, y, epochs=40)
    bound = toxicity.select(rows, y).tolist()
    grade = toxicity.grades(rows, y, np.array(bound))
    k = int(grade.max())
    w, cuts = dict.fromkeys(bound, 0.0), [float(j + 1) for j in range(k)]
    gw, gc = dict.fromkeys(bound, 1e-8), [1e-8] * k
    share = {True: 0.5 / max(1, int((grade > 0).sum())), False: 0.5 / max(1, int((grade == 0).sum()))}
    used = sorted({c for r in rows for c in r.tolist() if c in w})
    for _ in range(40):
        g, c = {x: 1e-3 * w[x] for x in used}, [0.0] * k
        for r, own in zip(rows, grade.tolist()):
            mine = [x for x in r.tolist() if x in w]
            score = sum(max(w[x], 0) for x in mine)
            for j in range(k):
                d = (1 / (1 + math.exp(cuts[j] - score)) - (own > j)) * share[own > 0]
                c[j] -= d
                for x in mine:
                    g[x] += d
        for x in used:
            gw[x] += g[x] ** 2
            w[x] -= 0.3 * g[x] / math.sqrt(gw[x])
        for j in range(k):
            gc[j] += c[j] ** 2
            cuts[j] -= 0.3 * c[j] / math.sqrt(gc[j])
            cuts[j] = max(cuts[: j + 1])
    assert bound and model.cuts.tolist() == pytest.approx(cuts)
    assert [model.weights[x] for x in used] == pytest.approx([max(w[x], 0) for x in used])


def test_bands_meet_the_near_pairs_of_the_table(spark):
    """Measured recall of the banding alone: pairs of unequal n-gram sets at 0.8 or more that share a band."""
    bands, rows = ngram_join.bands_for(ngram_join.THRESHOLD, ngram_join.RECALL)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sets = list({ngram_join.digest(g): g for g in (ngram_join.grams(r.text or "") for r in docs) if len(g)}.values())
    hit = ngram_join.link_block(sets, None, ngram_join.THRESHOLD)
    keys = [[m.tobytes() for m in ngram_join.minhash(g, bands * rows).reshape(bands, rows)] for g in sets]
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(hit)))]
    met = sum(any(x == y for x, y in zip(keys[i], keys[j])) for i, j in pairs)
    assert pairs and met / len(pairs) >= 0.99


def test_lm_look_ups_of_joined_slices():
    """Look-ups in slices joined to pieces, each word and bigram once, are those of one slice after another."""
    rng = np.random.default_rng(3)
    u64 = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    slices = lm_scoring.Slices(7, np.array([lm_scoring.START], np.uint64))
    words = np.sort(u64(3000))
    u, t = words[rng.integers(0, 3000, 9000)], words[rng.integers(0, 3000, 9000)]
    g, home, parts = lm_scoring.pair(u, t), slices.of_word(words), {}
    for s in range(7):
        mine, own = np.unique(lm_scoring.item(u, lm_scoring.low(g))[slices.of_pair(u, g) == s]), words[home == s]
        counts = rng.integers(1, 400, len(mine))
        blocks = 2 + s % 2
        parts[s] = lm_scoring.Part(own, np.arange(len(own)) + 1, np.arange(len(own)) * 2, lm_scoring.build_filter(mine, counts, blocks, 12.0), blocks)
    asked_u, asked_t = np.concatenate([u, u64(500), u[:99]]), np.concatenate([t, u64(500), t[:99]])
    want, item = np.zeros(len(asked_u), np.int64), lm_scoring.item(asked_u, lm_scoring.low(lm_scoring.pair(asked_u, asked_t)))
    at = slices.of_pair(asked_u, lm_scoring.pair(asked_u, asked_t))
    for s, p in parts.items():
        want[at == s] = lm_scoring.level_of(item[at == s], p.bits, p.blocks)
    few = [lm_scoring.Piece.of({s: parts[s] for s in some}) for some in ((0, 1, 2), (3,), (4, 5, 6))]
    for table in (lm_scoring.Table(slices, parts), lm_scoring.Table(slices, {}, few)):
        assert table.levels(asked_u, asked_t).tolist() == want.tolist()
        c, z = table.words(asked_t)
        assert (c > 0).tolist() == np.isin(asked_t, words).tolist() and (z[c > 0] == 2 * (c[c > 0] - 1)).all()
    # A segment without some slices answers for its own only.
    c, _ = lm_scoring.Table(slices, {}, few[:1]).words(words)
    assert (c > 0).tolist() == (home <= 2).tolist()


def test_packing_portions_need_no_other_import():
    """packing imports what it uses of pyarrow (a fresh interpreter has no pyarrow.compute)."""
    import subprocess
    import sys

    code = "import pyarrow as pa, numpy as np\nfrom tesserine.llm import packing\nb = pa.RecordBatch.from_arrays([pa.array([b'abcd' * 3, b'', b'abcd'])], names=['tail'])\nprint([x.num_rows for x in packing.portions(b, np.dtype('<u4'), 3)])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[2, 1]"
