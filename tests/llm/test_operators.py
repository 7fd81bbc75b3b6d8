"""Each operator against brute force, an exact round trip, SQL or held-out accuracy, on the smallest tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import Groups, near_groups
from pyspark.sql import functions as F

from kinmatch.llm import ann, cover_tree, encoding, mixing, near_dedup, packing, queries, suffix_dedup, token_files, url_rules


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def token_ids(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encoding.default_tokenizer())
    return {d: whole.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_op1_recall_scores_and_order(spark, sf_dir):
    rows = queries.op1_ann(spark, sf_dir).collect()
    table = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    found = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r.query_id != r.vec_id and abs(table[r.query_id] @ table[r.vec_id] - r.score) < 1e-12
        found[r.query_id].append((r["rank"], -r.score, r.vec_id))
    recall = []
    for q in (i for i in table if i % 20 == 0):
        assert [f[0] for f in found[q]] == list(range(1, 21)) and [f[1:] for f in found[q]] == sorted(f[1:] for f in found[q])
        true = sorted((-(table[q] @ x), i) for i, x in table.items() if i != q)[:20]
        recall.append(len({i for _, i in true} & {f[2] for f in found[q]}) / 20)
    assert np.mean(recall) >= 0.9


def test_op1_search_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    for substrings in (2, 4, 16):
        bits = 16 * substrings
        codes = rng.integers(0, 1 << 16, (500, substrings), dtype=np.uint16)
        near = codes[:50] ^ np.packbits(rng.random((50, bits)) < 0.2, axis=1).view(np.uint16)
        far = np.bitwise_count(near[:, None, :] ^ codes[None, :, :]).sum(2)
        index = ann.Index(codes)
        for radius in (0, 3, bits // 5, bits // 3, bits):
            assert sum(t + 1 for t in ann.reaches(radius, substrings)) == radius + 1
            for q, d in zip(near, far, strict=True):
                assert index.search(q, radius).tolist() == np.flatnonzero(d <= radius).tolist()
                assert set(np.flatnonzero(d <= radius)) <= set(index.probe(q, radius).tolist())


def clustered(rng, n=4000, d=48):
    centres = rng.standard_normal((n // 80, d))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_op1_index_is_selective_where_vectors_have_structure(spark):
    """Few codes are probed, and recall against brute force holds."""
    x = clustered(np.random.default_rng(6))
    wide, most = x.astype(float), float(np.linalg.norm(x, axis=1).max())
    s = ann.Settings(sample=2000)
    rotations = ann.learn_rotations(ann.augmented(wide[:2000], most), 256, s.rounds)
    layout = ann.learn_layout(wide[:2000], most, rotations, 10, s)
    assert layout.within <= layout.probed < 0.25
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, k=10, settings=s).collect():
        got[r.query_id].add(r.vec_id)
    score = wide[::20] @ wide.T
    score[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    true = np.argsort(-score, axis=1)[:, :10]
    assert np.mean([len(got[20 * i] & set(t.tolist())) / 10 for i, t in enumerate(true)]) >= 0.9


def test_op1_query_rows_of_one_id_keep_their_own_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 8))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(0, [1.0] + [0.0] * 7), (0, [-1.0] + [0.0] * 7), (0, [1.0] + [0.0] * 7)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=5).orderBy("query_hash", "rank").collect():
        got[r.query_hash].append((r["rank"], r.vec_id))
    best = lambda sign: [(i + 1, int(v) + 1) for i, v in enumerate(np.argsort(-sign * x[:, 0])[:5])]
    assert sorted(got.values()) == sorted([best(1), best(-1)])


def test_op1_far_queries_go_again_until_k_are_found(spark):
    """A radius learned on a tight cluster finds nothing for an outlier; it still gets its k nearest."""
    rng = np.random.default_rng(9)
    x = np.concatenate([[-np.ones(16)], np.ones((400, 16)) + 0.01 * rng.standard_normal((400, 16))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.nearest(frame, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))


def test_op2_equals_brute_force(docs, texts):
    sets, groups = near_groups(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {d: (len(s), groups.find(d), groups.find(d) == d) for d, s in sets.items()}


def test_op2_large_group_of_near_copies(spark):
    """A chain of copies, each a little further off, and a passage that all share."""
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(40)]
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for d in range(300):
        own = list(base)
        for i in rng.choice(400, 3, replace=False):
            own[i] = f"x{d}_{i}"
        texts[d] = " ".join(own if d < 200 else [f"y{d}_{i}" for i in range(60)] + passage)
    sets, groups = near_groups(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {d: groups.find(d) for d in texts}


def test_op2_pairs_share_a_key_within_the_radius():
    """Pigeonhole: signatures that differ in at most RADIUS components share a key."""
    rng = np.random.default_rng(2)
    for _ in range(50):
        one = rng.integers(0, 1 << 16, near_dedup.COMPONENTS).astype(np.uint16)
        two = one.copy()
        two[rng.choice(near_dedup.COMPONENTS, near_dedup.RADIUS, replace=False)] ^= 1
        batch = pa.record_batch({"node": [1, 2], "sig": pa.array([one.tobytes(), two.tobytes()], pa.binary())})
        rows = next(near_dedup.key_rows(iter([batch])))
        keys = np.asarray(rows.column("key")).reshape(2, -1)
        assert set(keys[0]) & set(keys[1])


def test_op3_round_trip(spark, docs, token_ids):
    folder = token_files.token_folder(spark)
    manifest = token_files.write_token_files(docs, encoding.default_tokenizer(), folder, block_ids=1000)
    rows = {r.doc_id: r for r in token_files.read_token_files(manifest, ids_at_once=5000).collect()}
    start = 0
    for d in sorted(token_ids):
        ids = [*token_ids[d], 0]
        assert (rows[d].ids, rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (ids, start, len(ids), crc(ids))
        start += len(ids)
    first = manifest.orderBy("shard").where("n_docs > 0").first()
    reader = token_files.Reader(first.path)
    assert reader.document(0).tolist() == [*token_ids[min(token_ids)], 0] and reader.ids(5, 5).tolist() == []


@pytest.mark.parametrize("width", [1, 5, 8, 13, 15, 16, 17, 31, 32])
def test_op3_bit_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1003, dtype=np.uint32)
    data = token_files.pack(ids, width)
    assert len(data) == -(-1003 * width // 8) and (token_files.unpack(data, width, 1003) == ids).all()


def test_encoder_equals_the_library():
    odd = ["", " ", "a  b", "a   b\n\n c", "a\nb", "a.\nB", "don't, can't. ,'s “q” a—b, --x ..y \n z\n", "ü, é. ,ü (a) [b]{c}<d>|e", "a1,b 2.c", "\u00a0 x", "x \u00a0y", "\u00a0 \u00a0y", "it's <|endoftext|> ok", "<|endoftext|>", "<|endoftext|> a", "b <|endoftext|>", "c<|endoftext|><|endoftext|>d e", "<|endoftext", "日本 語 x", "é\x85 b", "a,\x00b", "x" * 3000, "🙂 🙂🙂 x"]
    encode = encoding.Encoder(encoding.default_tokenizer(), cache_words=3)
    assert encode.whole.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    raw = [t.encode() for t in odd]
    for _ in range(2):
        ids, n = encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [encode.whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_op4_equals_sql(spark, sf_dir, same):
    same(queries.op4_url_rules(spark, sf_dir), queries.SQL["op4_url_rules"])


def test_op4_rules(spark):
    urls = ["http://a.b.net/x", "http://net/", "http://anet/x", "http://net", "HTTP://EXAMPLE.NET/en/1", "http://example.net/EN/1", "http://xexample.com/de/", "ftp://m.example.com/de/a?b", "http://q.org/fr/", "http://q.org/fr", "http://q.com/Casino/1", "http://q.com/casinos", "no url", "", None, "x://y?z", "a://b.net#c/d"]
    rows = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), url_rules.default_rules()).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [
        ("net/", "block"), ("net/", "block"), (None, "allow"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), (None, "allow"), ("example.com/de/", "block"),
        ("org/fr/", "allow"), (None, "allow"), ("word:casino", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (rows[4].host, rows[4].path, rows[15].host, rows[15].path) == ("example.net", "/en/1", "y", "")


def test_op4_equals_all_rules_tried_in_turn(spark, sf_dir):
    """The index against every rule's expression on every URL."""
    import re

    rules = url_rules.default_rules()
    assert len(rules) > 2000
    own = [(r, re.compile(r.pattern, re.IGNORECASE | re.ASCII)) for r in rules]
    more = ["http://free-bets.example.com/en/1", "http://A.B.com/x_Free.WIN/", "http://a.com/casino/spam-farm/win-spam", "http://a.com/casino\u0130x", "http://\u212aeygen-win.com/", "http://x.net|y.com/a", "http://a|b.net/x", "http://a.com/free--bets", "http://win.spam/"]
    urls = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()] + more
    rows = url_rules.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    fetched, judge = 0, url_rules.Judge(rules)
    for r in rows:
        fits = sorted((-x.rank, x.name, x.verdict) for x, p in own if p.search(r.host + r.path))
        assert (r.rule, r.verdict) == ((fits[0][1], fits[0][2]) if fits else (None, "allow")), r.url
        fetched += len(judge.candidates(r.host + r.path))
    # the index leaves a few of the rules to try
    assert fetched < 100 * len(rows)


def test_op4_files_rules_under_their_rarest_token():
    index = url_rules.index_rules([url_rules.pair_rule("block", "free", "win"), url_rules.pair_rule("block", "free", "shop"), url_rules.word_rule("block", "win")])
    assert {t: [r.name for r in own] for t, own in index.items()} == {"free": ["pair:free-win"], "shop": ["pair:free-shop"], "win": ["word:win"]}


def test_op5_pieces(spark, docs, token_ids):
    rows = packing.pack_documents(docs, encoding.default_tokenizer()).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(token_ids[r.doc_id]) + 1
        by_doc[r.doc_id].append((r.start, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d, ids in token_ids.items():
        at, whole = 0, []
        for start, part in sorted(by_doc[d]):
            assert start == at
            whole += part
            at += len(part)
        assert whole == [*ids, 1]
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.01 * total


def test_op5_packer_keeps_its_bound():
    rng, packer = np.random.default_rng(3), packing.Packer(64, 4, 8)
    for d in range(500):
        packer.add(d, np.arange(rng.integers(1, 150), dtype=np.uint32))
        assert len(packer.open) <= 4
    assert all(56 < sum(len(p[3]) for p in w) <= 64 for w in packer.closed)
    left = [p for _, _, p in packer.open]
    sizes = [sum(len(p[3]) for p in w) for w in packing.merged(left, 64)]
    assert all(s & (s - 1) == 0 for s in sizes) and sum(sizes) == sum(len(p[3]) for w in left for p in w)


def test_op6_equals_sql(spark, sf_dir, same):
    same(queries.op6_line_dedup(spark, sf_dir), queries.SQL["op6_line_dedup"])


def brute_spans(texts):
    raw = {d: t.encode() for d, t in texts.items()}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1 : len(b) + 1]]) if b else b""
        out[d] = (len(b), int(gone.sum()), int((~gone[:-1] & gone[1:]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_op7_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, sf_dir).collect()}
    assert got == brute_spans(texts)


def suffix_texts():
    rng = np.random.default_rng(11)
    noise = lambda n: bytes(rng.choice(np.frombuffer(b"abc ", np.uint8), n))
    shared = noise(900)
    return [noise(260), shared[:420], shared[100:700], b"a" * 450, b"ab" * 220, noise(300) + shared[500:900], b"a" * 300, shared[:420]]


def test_op7_suffix_order_is_the_order_of_bytes():
    text = suffix_dedup.Text()
    at = []
    for raw in suffix_texts():
        base = text.add(np.frombuffer(raw, np.uint8))
        at += [base + i for i in range(len(raw) - 199)]
    at = np.array(at)
    whole = text.data.tobytes()
    head = text.words[at]
    by = np.argsort(head, kind="stable")
    order, equal = suffix_dedup.in_order(text, at[by], np.append(False, head[by][1:] == head[by][:-1]))
    got = [whole[x : x + 200] for x in at[by][order].tolist()]
    assert got == sorted(got) and equal.tolist() == [False] + [a == b for a, b in zip(got, got[1:], strict=False)]
    x, y = at[np.random.default_rng(1).integers(0, len(at), (2, 500))]
    common = lambda a, b: next((i for i in range(200) if a[i] != b[i]), 200)
    assert text.common(x, y).tolist() == [common(whole[i : i + 200], whole[j : j + 200]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]


def test_op7_family_of_levels():
    """Batches one after another mark what one batch of all marks; levels are suffix arrays without equal windows and shrink by halves."""
    texts = suffix_texts()
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    wanted = [count[t[i : i + 200]] > 1 for t in texts for i in range(len(t) - 199)]
    one = suffix_dedup.Family()
    at = np.cumsum([0] + [len(t) for t in texts])
    one.add(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([a + np.arange(len(t) - 199) for a, t in zip(at, texts, strict=False)]))
    many = suffix_dedup.Family()
    for t in texts:
        many.add(np.frombuffer(t, np.uint8), np.arange(len(t) - 199))
        sizes = [len(level) for level in many.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    assert one.marked.tolist() == many.marked.tolist() == wanted
    for level in one.levels + many.levels:
        text = (one if level in one.levels else many).text
        own = [bytes(w) for w in text.window(level.at)]
        assert own == sorted(set(own)) and (text.words[level.at] == level.head).all()
    assert sum(len(level) for level in many.levels) == len(count)


@pytest.mark.parametrize("hot", [2_000, 3, 0.01])
def test_op7_repeats_within_and_across(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "SLICE_CONTENTS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH_WINDOWS", 300)
    rng = np.random.default_rng(7)
    noise = lambda n: "".join(rng.choice(list("abcdefghij klmnop"), n))
    passage = noise(450)
    texts = {d: noise(150) + passage[d % 50 : 300 + d % 100] + noise(100) for d in range(30)}
    texts |= {100: "a" * 500, 101: "ab" * 300, 102: passage + "ü" + passage, 103: "", 104: noise(199), 105: texts[3][:250], 106: texts[3][:199]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    done = suffix_dedup.dedup_suffixes(frame).collect()
    got = {r.doc_id: (r.n_bytes, sum(x.end - x.begin for x in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in done}
    assert got == brute_spans(texts)


def test_op8_held_out_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.1")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 500 and np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.predicted for r in held if labels[r.doc_id]]) > 0.9


def test_op9_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16))
    x = np.concatenate([c + s * rng.standard_normal((25, 16)) for c, s in zip(centres, np.linspace(0.02, 0.9, 40), strict=True)]).astype(np.float32)
    x[5], x[17] = x[3], 2 * x[3]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    groups = Groups(range(len(x)))
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.link(int(a), int(b))
    wanted = {i: (int(near[i].sum()), groups.find(i), groups.find(i) == i) for i in range(len(x))}
    for block, portion in ((4096, 1 << 19), (100, 1 << 19), (8, 500)):
        monkeypatch.setattr(cover_tree, "PORTION", portion)
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(frame, block=block).collect()}
        assert got == wanted


def test_op9_query_equals_brute_force(spark, sf_dir, tmp_path):
    """The query over the table's own vectors and turned copies of some of them."""
    rng = np.random.default_rng(10)
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    more = [(10_000 + i, (2 * np.array(own[i % 60].embedding) + 0.04 * rng.standard_normal(len(own[0].embedding)) * (i // 60)).tolist()) for i in range(300)]
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([tuple(r) for r in own] + more, "vec_id long, embedding array<float>").write.parquet(path)
    rows = spark.read.parquet(path).collect()
    sound = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)}
    ids = sorted(sound)
    u = np.stack([sound[i] / np.linalg.norm(sound[i]) for i in ids])
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    groups = Groups([r.vec_id for r in rows])
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.link(ids[a], ids[b])
    wanted = {r.vec_id: (0, r.vec_id, True) for r in rows} | {i: (int(near[k].sum()), groups.find(i), groups.find(i) == i) for k, i in enumerate(ids)}
    assert near.any()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op9_cover_tree(spark, str(tmp_path)).collect()} == wanted


def test_op10_equals_sql(spark, sf_dir, same):
    same(queries.op10_mixing(spark, sf_dir), queries.SQL["op10_mixing"])


def test_op10_targets_and_schedule(spark, docs):
    rows = mixing.taken_words(docs, block_words=100).collect()
    taken, size, target = Counter(), Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target) and abs(sum(target.values()) - sum(size.values())) < 1
    assert all(target[s] <= 3 * size[s] + 1e-6 for s in target)
    where, pieces = mixing.mix(docs, block_words=100)
    slots = pieces.groupBy("slot").agg(F.count_distinct("source_no").alias("n"), F.sum("n_words").alias("words")).collect()
    assert all(s.n == 1 and s.words <= 100 for s in slots)
    # low discrepancy: any prefix of the schedule is near the target shares
    order = pieces.join(where.select("source_no", "source").distinct(), "source_no").select("slot", "source", "n_words").orderBy("slot").collect()
    half, total = Counter(), sum(r.n_words for r in order)
    for r in order:
        if sum(half.values()) * 2 < total:
            half[r.source] += r.n_words
    assert all(abs(half[s] - target[s] / 2) <= 1500 for s in target)


def test_op10_mix_is_written_in_slot_order(spark, docs, tmp_path):
    """Any stretch of the written mix holds the sources near their targets, and rows lie in the order of their first slots."""
    path = str(tmp_path / "mix")
    mixing.mixed_documents(docs, block_words=100).write.parquet(path)
    rows = [r for f in sorted((tmp_path / "mix").glob("part-*")) for r in spark.read.parquet(str(f)).select("doc_id", "source", "text").collect()]
    first = {r.doc_id: r.first_slot for r in mixing.taken_words(docs, block_words=100).where("taken > 0").collect()}
    seen = list(dict.fromkeys(r.doc_id for r in rows))
    assert [first[d] for d in seen] == sorted(first[d] for d in seen) and set(seen) == set(first)
    size = lambda part: Counter({s: sum(len(r.text.split()) for r in part if r.source == s) for s in {r.source for r in rows}})
    total = size(rows)
    words, half = 0, []
    for r in rows:
        if words * 2 < sum(total.values()):
            half.append(r)
            words += len(r.text.split())
    got = size(half)
    assert all(abs(got[s] / words - total[s] / sum(total.values())) < 0.1 for s in total)


def test_op10_cap_reshares(spark):
    rows = [(i, "a" if i < 3 else "b" if i < 6 else None, "w " * (10 if i < 3 else 100 if i < 6 else 1)) for i in range(9)]
    got = {r.source: (r.source_size, r.target) for r in mixing.taken_words(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    # weights 1, 2, 3 of 333 words: a gets 55.5, b 111, null stops at 9; its excess goes to a and b by weight, a stops at 90
    assert got["a"] == (30, 90.0) and got[None] == (3, 9.0) and abs(got["b"][1] - 234) < 1e-9


def test_op3_op5_added_tokens_as_the_library(spark):
    """A text that holds an added token's string gives that token, wherever it stands."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(encoding.default_tokenizer())
    texts = ["<|endoftext|>", "x <|endoftext|> y", "plain words", "<|endoftext|> at the start", "at the end <|endoftext|>", "twice <|endoftext|><|endoftext|> here", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = {d: whole.encode(t, add_special_tokens=False).ids for d, t in enumerate(texts)}
    assert 50256 in wanted[1]
    manifest = token_files.write_token_files(frame, encoding.default_tokenizer(), token_files.token_folder(spark))
    assert {r.doc_id: r.ids for r in token_files.read_token_files(manifest).collect()} == {d: [*ids, 0] for d, ids in wanted.items()}
    pieces = defaultdict(list)
    for r in sorted(packing.pack_documents(frame, encoding.default_tokenizer()).collect(), key=lambda r: r.start):
        pieces[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert pieces == {d: [*ids, 1] for d, ids in wanted.items()}


def test_op3_paths_without_a_scheme_are_refused_on_executors(spark):
    assert token_files.qualified(spark, "/tmp/x").startswith("file:/")
    with pytest.raises(ValueError, match="no scheme"):
        token_files.file_system("/user/x/shard.idpack")


def test_op3_repeated_doc_ids_keep_all_rows(spark):
    frame = spark.createDataFrame([(7, f"text {i % 40}") for i in range(400)], "doc_id long, text string")
    manifest = token_files.write_token_files(frame, encoding.default_tokenizer(), token_files.token_folder(spark))
    rows = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert len(rows) == 400 and {r.doc_id for r in rows} == {7}
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
