"""The corpus operators against brute force, round trips and planted cases, with nulls, empty and long texts, ties, repeats and clashing columns."""

import glob
import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wayglass.llm import bpe, chat, exact_dedup, graph, html_text, line_dedup, mixing, quality, queries, sharding, simhash, toxicity

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, norm string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, repeated, near and very long texts, columns whose names clash with the operators' own."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 120))) for _ in range(40)]
    texts = [None, "", " \t\n", "Same line here\nother", "same LINE here \nÄnother line of text\n\n", "ÄÖ same", "äö same", "x" * 200_000, " ".join(words * 400)]
    texts += base + [b + " extra" for b in base[:10]] + base[:5] + [base[0].upper()] * 5
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 12}" if i % 7 else None, 0, "k", "n", "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


# 1 ---------------------------------------------------------------------------------------------------------------
def test_mixing_redistributes_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10, 1), ("a", "y", 1000, 1), ("b", "z", 1000, 1)], "d string, s string, tokens long, n_rows long")
    got = {r.s: r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, 200, 1.0, 1).collect()}
    assert got == {"x": 10, "y": 90, "z": 100}  # what x can't hold goes to y, not to b
    got = {r.s: r.budget for r in mixing.leaf_budgets(leaves.where("s <> 'y'"), ["d", "s"], {}, 200, 1.0, 1).collect()}
    assert got == {"x": 10, "z": 190}
    got = {r.s: r.budget for r in mixing.leaf_budgets(leaves, ["d", "s"], {"d": {"b": 0}}, 10_000, 1.0, 2).collect()}
    assert got == {"x": 20, "y": 2000, "z": 0}


def test_mixing_takes_prefixes_of_epochs(spark, odd):
    taken = mixing.mix(odd, ["lang", "source"], {"lang": {"en": 3}}, share=0.5, max_epochs=2).collect()
    assert len(taken) == odd.count()
    total = sum(r.tokens for r in taken)
    got = sum(r.tokens * r.copies for r in taken)
    assert got <= total * 0.5 and all(0 <= r.copies <= 2 for r in taken)
    docs = mixing.mixed_documents(odd, mixing.mix(odd, ["lang", "source"], {}, share=0.5, max_epochs=1))
    assert docs.columns == odd.columns
    assert mixing.mix(empty(spark), ["lang", "source"], {}).count() == 0


def test_excluded_subtrees_give_no_rows(spark):
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate([("a b", "x"), ("", "x"), ("c", "y"), (None, "y"), ("", "z")])], "doc_id long, text string, source string")
    got = {r["__id"]: r.copies for r in mixing.mix(df, ["source"], {"source": {"y": 0, "z": 0}}).collect()}
    assert got == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0} or got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}
    assert all(not got[i] for i in (2, 3, 4))


@pytest.mark.parametrize(("budget", "epochs"), [(12, 1), (24, 1), (30, 2), (44, 2)])
def test_repeated_rows_keep_the_budget(spark, budget, epochs):
    df = spark.createDataFrame([(7, "a b c d", "s", k) for k in range(6)] + [(8, "e f", "s", 0)] * 2, "doc_id long, text string, source string, other int")
    taken = mixing.mix(df, ["source"], {}, budget=budget, max_epochs=epochs)
    out = mixing.mixed_documents(df, taken).collect()
    tokens = sum(len(r.text.split()) for r in out)
    assert tokens <= budget and tokens > min(budget, 28 * epochs) - 4
    assert tokens == sum(r.tokens * r.copies for r in taken.collect())
    assert mixing.mixed_documents(df.limit(0), mixing.mix(df.limit(0), ["source"], {})).count() == 0


def test_mixing_equals_brute_force_on_odd_rows(spark, odd):
    """The prefix of each leaf, row by row, from the budgets."""
    df = odd.unionByName(odd.limit(9))
    taken = mixing.mix(df, ["lang", "source"], {"lang": {"en": 2, "": 0}}, share=0.4, max_epochs=2)
    leaves = defaultdict(list)
    for r in taken.collect():
        leaves[r.lang, r.source].append(r)
    sums = [(*k, sum(r.tokens for r in v), len(v)) for k, v in leaves.items()]
    table = spark.createDataFrame(sums, "lang string, source string, tokens long, n_rows long")
    budgets = {(r.lang, r.source): r.budget for r in mixing.leaf_budgets(table, ["lang", "source"], {"lang": {"en": 2, "": 0}}, None, 0.4, 2).collect()}
    for k, rows in leaves.items():
        n, upto = sum(r.tokens for r in rows), 0
        epochs, rest = divmod(budgets[k], n) if n else (0, 0)
        for r in sorted(rows, key=lambda r: (r.digest, r["__id"])):
            upto += r.tokens
            assert r.copies == epochs + (rest > 0 and upto <= rest) or [x.digest for x in rows].count(r.digest) > 1
        assert sum(r.tokens * r.copies for r in rows) <= budgets[k] and (k[0] or not any(r.copies for r in rows))


# 2 ---------------------------------------------------------------------------------------------------------------
def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    more = ["Don't <|endoftext|>Stop! ΣΑΣ İx 12½ 漢字 é é", "hahahahahaha 's're", "\x1c\x85 a", "ab" * 500]
    df = odd.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = texts_of(df)
    for r in bpe.encode_documents(df, path, ids=True).collect():
        want = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        decoded = lib.decode(want, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and bpe.load(path).decode(r.ids) == decoded
    assert bpe.encode_documents(empty(spark), path).count() == 0


def test_compatible_pairs_are_those_that_merging_keeps():
    b = bpe.load(queries.tokenizer_path())
    rnd = random.Random(2)
    inner = [t for t, i in b.vocab.items() if not t.endswith(b.suffix) and i < 20_000 and b.itself(i)]
    last = [t for t, i in b.vocab.items() if t.endswith(b.suffix) and t != b.suffix and i < 20_000 and b.itself(i)]
    pairs = [(rnd.choice(inner), rnd.choice(last)) for _ in range(3000)]
    got = b.compatible(np.array([b.vocab[x] for x, _ in pairs]), np.array([b.vocab[y] for _, y in pairs]))
    want = [b.merge(x + y[: -len(b.suffix)]) == [b.vocab[x], b.vocab[y]] for x, y in pairs]
    assert got.tolist() == want


# 3 ---------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    w = [x.encode() for x in WORD.findall(lower(text))]
    if not w:
        return 0
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    ones = [sum(xxhash.xxh64_intdigest(x, seed=42) >> b & 1 for x in s) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(s))


def brute_components(fps, limit):
    ids, root = list(fps), {i: i for i in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= limit and (x := top(a)) != (y := top(b)):
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_simhash_equals_brute_force(spark, odd):
    texts = {i: t for i, t in texts_of(odd).items() if len(t) < 100_000}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(odd.where("length(text) < 100000 or text is null")).collect()}
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    roots = brute_components(dict(sorted(fps.items())), 3)
    assert got == {i: (format(fps[i], "016x"), roots[i]) for i in texts}
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.near_dedup(odd).columns == odd.columns


def test_jaccard_links_equal_brute_force(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"

    def changed(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    texts: list[str | None] = [None, "", "a b", "A  b", "a b c d e " * 30, "a b c d e " * 31]
    for k in range(60):  # pairs from similarity 0.5 to 1
        base = [word() for _ in range(300)]
        texts += [" ".join(base), " ".join(changed(base, k // 3))]
    base = [word() for _ in range(300)]  # a large group, whose members partly link only through others
    texts += [" ".join(changed(base, rng.randrange(8))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, 3, 5, jaccard=0.8).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := lower(t or "").split()) else set() for t in texts]
    fps = [simhash.fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))
    similar = 0
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            alike = bool(both) and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both)
            similar += alike
            if (alike or (fps[a] ^ fps[b]).bit_count() <= 3) and (x := root[a]) != (y := root[b]):
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert similar > 500 and got == dict(enumerate(root))
    kept = {r.doc_id for r in simhash.near_dedup(df, jaccard=0.8).collect()}
    assert kept == set(root)
    assert simhash.near_groups(empty(spark), jaccard=0.8).count() == 0


def test_pipeline_drops_copies_of_similarity_08(spark):
    import corpus_pipeline

    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    other = [("x" if i % 60 == 30 else w) for i, w in enumerate(base)]  # 10 words, 50 of 596 shingles: similarity 0.85
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(reversed(base)))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, DATA).collect()} == {1, 3}


@pytest.mark.parametrize("limit", [3, 4, 6])
def test_links_of_clustered_fingerprints(spark, limit):
    rnd = random.Random(limit)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    fps = set()
    for s in seeds:
        x = s
        for _ in range(12):  # chains and bushes of near fingerprints
            for b in rnd.sample(range(64), rnd.randint(1, limit + 1)):
                x ^= 1 << b
            fps.add(x)
            x = x if rnd.random() < 0.5 else s
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, limit)).collect()}
    want = brute_components({f: f & (1 << 64) - 1 for f in sorted(signed)}, limit)
    assert {f: roots.get(f, f) for f in signed} == want


def test_thresholds_obey_the_general_pigeonhole_principle():
    both = np.full((64, 64), 25_000.0) + np.diag(np.full(64, 25_000.0))
    for n in (10**3, 10**6, 10**9):
        for limit in (1, 3, 5):
            parts, t, _ = simhash.allocate(n, both * n / 100_000, limit)
            assert sorted(b for p in parts for b in p) == list(range(64)) and sum(x + 1 for x in t) == limit + 1


def test_forest_spans_a_large_bucket(monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", 50)
    rnd = np.random.default_rng(1)
    base = np.uint64(0x123456789ABCDEF)
    fp = np.unique(base ^ (np.uint64(1) << rnd.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rnd.integers(0, 64, 400).astype(np.uint64)))
    a, b = simhash.forest(fp, 3)
    link = defaultdict(set)
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert (x ^ y).bit_count() <= 3
        link[x].add(y)
        link[y].add(x)
    seen, todo = set(), [int(fp[0])]
    while todo:
        if (x := todo.pop()) not in seen:
            seen.add(x)
            todo += link[x]
    assert len(seen) == len(brute := [f for f in fp.tolist()]) and len(brute) > 50


# 4 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(("capacity", "broadcast"), [(1, 2_000_000), (3, 0), (20, 0), (10_000, 2_000_000)])
def test_exact_groups(spark, odd, capacity, broadcast, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", broadcast)
    groups = defaultdict(list)
    for i, t in texts_of(odd).items():
        groups[lower(t)].append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(odd, capacity=capacity).collect()}
    assert got == {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.exact_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)


def brute_buckets(keys, capacity, depth=0, prefix=0):
    own = [k for k in keys if k >> (64 - depth) == prefix] if depth else list(keys)
    if len(own) <= capacity:
        return {(depth, prefix): sorted(own)} if own else {}
    return brute_buckets(own, capacity, depth + 1, 2 * prefix) | brute_buckets(own, capacity, depth + 1, 2 * prefix + 1)


@pytest.mark.parametrize("capacity", [1, 2, 7, 50, 1000])
def test_buckets_split_where_they_are_overfull_and_only_there(spark, capacity):
    rnd = random.Random(capacity)
    keys = {rnd.getrandbits(64) for _ in range(300)} | {0xABCDEF0123 << 24 | rnd.getrandbits(24) for _ in range(40)} | {(1 << 64) - 1 - i for i in range(9)} | set(range(5))
    signed = [(k - (1 << 64) if k >> 63 else k,) for k in keys]
    written = queries_written(spark.createDataFrame(signed, "key long"), "keys")
    directory, filed = exact_dedup.split_buckets(written, capacity)
    want = brute_buckets(keys, capacity)
    assert {(r.depth, r.prefix % (1 << 64)): r.n_keys for r in directory.collect()} == {k: len(v) for k, v in want.items()}
    names = {r.bucket: (r.depth, r.prefix % (1 << 64)) for r in directory.collect()}
    got = defaultdict(list)
    for r in filed.collect():
        got[names[r.bucket]].append(r.key % (1 << 64))
    assert {k: sorted(v) for k, v in got.items()} == want and len(names) == len(want)


def test_owners_chain_texts_that_share_a_key(spark):
    rows = [(9, 5, t, i) for i, t in enumerate(["a", "b", "a", "c", "b", "a"] * 20)] + [(4, 8, "a", 1000)]
    got = exact_dedup.chains_of(spark.createDataFrame(rows, "bucket long, key long, norm string, doc_id long")).collect()
    assert sorted((r.bucket, r.key, r.chain_n, r.chain_top) for r in got) == [(4, 8, 1, 1000), (9, 5, 20, 117), (9, 5, 40, 118), (9, 5, 60, 119)]
    assert sorted(r.slot for r in got if r.key == 5) == [1, 2, 3]


# 5 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "\\", "a\\</s>\\\\[INST]", "<<SYS>>\n<</SYS>>", "<s>[user]\nx</s>\n", "[\\INST]", "</s", "<s", "[IN"])
def test_chat_comes_back(text):
    turns = [("user", text), ("assistant", text), ("system", ""), ("weird ]!\n", text)]
    formatted = chat.format_conversation(turns)
    assert [(r, t) for r, t, *_ in chat.parse(formatted)] == turns
    assert chat.unescape(chat.escape(text)) == text
    for (a, b), (_, t) in zip(chat.loss_spans(formatted), [turns[1]], strict=True):
        assert chat.unescape(formatted[a:b]) == t or formatted[a:b] == t


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, None, None), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert got[1].n_turns == 2 and got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb</s>\n").hexdigest()
    assert got[1].loss_chars == 5 and got[1].loss_sha256 == hashlib.sha256(b"b</s>").hexdigest() and len(got) == 3
    assert got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest()
    assert chat.format_chats(df.limit(0)).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------
def test_shards(spark, odd):
    many = odd.unionByName(odd).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    texts, n = texts_of(many), many.count()
    rows = sharding.assign_shards(many, 7).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == n and max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    assert all(r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    mix = Counter(r.source for r in rows)
    for s in count:
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[x] - mix[x] / 7) <= 2 for x in mix)
    assert sharding.sharded(many, 7).count() == n
    assert sharding.assign_shards(empty(spark)).count() == 0


def brute_shards(rows, n_shards):
    """(doc_id, digest) in the order of the run, cut: ranks within a source by (12 bits of the text's digest, row digest), then by fraction."""
    sources = defaultdict(list)
    for r in rows:
        u = lambda x: x % (1 << 64)
        sources[r.source, r.no_source].append((u(r.text_group) >> 52, u(r.digest) >> 56, r.digest, r.doc_id is not None, r.doc_id or 0, r.text_crc32))
    run = []
    for s, own in sources.items():
        run += [((2 * k + 1) / (2 * len(own)), s, k, x[2]) for k, x in enumerate(sorted(own))]
    run.sort()
    out, slot = [], Counter()
    for place, (*_, digest) in enumerate(run):
        shard = place * n_shards // len(run)
        out.append((digest, shard, slot[shard]))
        slot[shard] += 1
    return sorted(out)


def test_shards_equal_brute_force(spark, odd):
    rows = sharding.assign_shards(odd.unionByName(odd.limit(5)), 7).collect()
    assert sorted((r.digest, r.shard, r.slot) for r in rows) == brute_shards(rows, 7)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.assign_shards(docs, 40).collect()
    assert sorted((r.digest, r.shard, r.slot) for r in rows) == brute_shards(rows, 40)


def test_equal_texts_mostly_share_a_shard(spark):
    rows = [(i, f"text {i // 4}", f"s{i % 3}") for i in range(4000)]
    got = defaultdict(set)
    for r in sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect():
        got[r.text_group].add(r.shard)
    assert len(got) == 1000 and sum(len(s) == 1 for s in got.values()) > 850 and max(map(len, got.values())) == 2


def test_written_shards_come_back(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 5)
    got = spark.read.parquet(str(tmp_path / "s"))
    want = {(r.digest, r.shard, r.slot) for r in sharding.assign_shards(odd, 5).collect()}
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in odd.collect())
    assert {(r["__shard"], r["__slot"]) for r in got.collect()} == {(s, k) for _, s, k in want}


# 7 ---------------------------------------------------------------------------------------------------------------
PAGE = "<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy</div>{}<footer>&copy; x</footer></body></html>"


def test_html_zones():
    lines = html_text.text_lines(PAGE.format("<article><h1>A &amp; B</h1><p><b>One  two<br><p>x&nbsp;y<script>var a='<p>'</script><aside>no</aside></article>"))
    assert [x for x, z in lines if z == html_text.MAIN] == ["A & B", "One two", "x y"]
    assert {x for x, z in lines if z == html_text.FURNITURE} == {"T", "Home", "Buy", "© x", "no"}


def test_html_pairs(spark):
    plain = PAGE.format("<p>Site name</p><p>{}</p>")
    rows = [(1, "http://h/a/1", plain.format("first")), (2, "http://h/a/2", plain.format("second")), (3, "http://g/a", PAGE.format("<article><p>Same</p></article>")), (4, "http://g/b", PAGE.format("<article><p>Same</p></article>")), (5, None, None), (6, "http://h/a/3", ""), (None, "http://h/z", "<p>tail")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("pair", F.lit(0))
    got = {r.page_id: r.text for r in html_text.extract_pages(df.union(df.where("page_id = 3"))).collect()}
    assert got == {1: "first", 2: "second", 3: "Same", 4: "Same", 5: "", 6: "", None: "tail"}
    assert html_text.extract_pages(df).count() == 7 and html_text.extract_pages(df.limit(0)).count() == 0


def test_shared_lines_are_a_longest_common_subsequence():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        x, y = html_text.shared_lines(a, b)
        assert len(x) == best[-1][-1] and [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)]


def test_long_alignments_are_split(monkeypatch):
    rnd = random.Random(5)
    pairs = [([rnd.choice("abcdef") for _ in range(rnd.randint(0, 60))], [rnd.choice("abcdef") for _ in range(rnd.randint(0, 60))]) for _ in range(60)]
    whole = [html_text.shared_lines(a, b) for a, b in pairs]
    monkeypatch.setattr(html_text, "BITS_HELD", 40)
    for (a, b), (x, _) in zip(pairs, whole, strict=True):
        u, v = html_text.shared_lines(a, b)
        assert len(u) == len(x) and [a[i] for i in sorted(u)] == [b[j] for j in sorted(v)]


IN_ARTICLE = "<article><p>x</p>{}</article>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (IN_ARTICLE.format('<section class="comment-section">c</section>'), "x"), ("<article><p>main</p><article><p>comment</p></article></article>", "main"),
        *((f'<p>x</p><div class="{c}">c</div>', "x") for c in ("post-comments", "user-comment", "reader-comments", "newsletter-signup", "topnav", "sitefooter", "gdpr-banner")),
        (IN_ARTICLE.format('<p class="promo-text">c</p>'), "x"), (IN_ARTICLE.format("<p hidden>c</p><p>y</p>"), "x\ny"), (IN_ARTICLE.format('<p style="color:red; display: none">c<p>y'), "x\ny"),
        ("<main><article><p>a</p></article><article><p>b</p></article></main>", "a\nb"), ('<body class="has-sidebar no-comments"><p>x</p></body>', "x"), (IN_ARTICLE.format('<div class="content-with-sidebar">y</div>'), "x\ny"),
        (IN_ARTICLE.format('<a title="hidden gem">y</a>'), "x\ny"), (IN_ARTICLE.format('<p data-hidden="1" class="overflow-hidden">y</p>'), "x\ny"), (IN_ARTICLE.format('<p style="display:block">y</p>'), "x\ny"),
        (IN_ARTICLE.format("<header><h1>t</h1></header>"), "x\nt"),
    ],
)
def test_html_comments_signups_and_hidden_elements(html, text):
    lines = html_text.text_lines(html)
    assert html_text.main_text([x for x, _ in lines], [z for _, z in lines], set())[0] == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="has-sidebar"><article><p>Body</p></article></div>', "Body"),
        ('<main class="content no-sidebar"><p>Body</p></main>', "Body"),
        ('<article><div class="article-header"><h1>Title</h1></div><section class="related-work">Work</section><p>x</article>', "Title\nWork\nx"),
        ('<article><p class="notice">Hi<p>Para one</p></article>', "Para one"),
        ('<article><p>a<img alt="' + "x>" * 3000 + '" src=x>b</article>', "ab"),
        ('<article><ul><li class="ad">buy<li>own</ul><header><h2>H</h2></header><footer>f</footer></article>', "own\nH"),
        ('<form id="page"><div class="sidebar">no</div><article>yes</article></form>', "yes"),
        ("<form><p>all in a form</p></form>", "all in a form"),
        ('<div class="related"><article>teaser</article></div><article>main</article>', "main"),
        ('<div class="page-header"><article>only</article></div>', "only"),
        ("<article>a < b and c< d <b>x</b> &lt;y&gt; &amp;amp;</article><nav>n", "a < b and c< d x <y> &amp;"),
        ("<article><script>if (a</script>t<textarea>u<p></textarea>v<svg><text>w</text></svg><style>z", "tv"),
        ("<article>x<!-- c > -->y<!-- open", "xy"),
        ('<div id="siteFooter">f</div><div class="CommentList">c</div><div role=navigation>n</div><div role="main">m</div>', "m"),
        ("<article>unclosed <a <a <a", "unclosed <a <a <a"),
        ("plain text", "plain text"),
        ("", ""),
    ],
)
def test_html_structure(html, text):
    lines = html_text.text_lines(html)
    assert html_text.main_text([x for x, _ in lines], [z for _, z in lines], set())[0] == text


def test_odd_pages_take_linear_time():
    import time

    for html in ("<a <a " * 100_000, "<b>" * 50_000 + "<p>x" * 50_000, "<p class=ad>" * 30_000, '<a x="' * 50_000, "<div>" * 50_000 + "</div>" * 50_000, "<article>" + "<p>same</p>" * 30_000):
        began = time.time()
        html_text.text_lines(html)
        assert time.time() - began < 5
    began = time.time()
    a = ["same", "other"] * 10_000
    assert len(html_text.shared_lines(["x", *a], [*a, "y"])[0]) >= 19_999 and time.time() - began < 20


def simple_lines(html):
    """A second parser, for plain pages: the standard library's, with navigation, footers, heads and adverts as furniture."""
    from html.parser import HTMLParser

    class Parser(HTMLParser):
        def __init__(self):
            super().__init__()
            self.lines, self.words, self.depth, self.main = [], "", 0, 0

        def cut(self):
            if line := " ".join(self.words.split()):
                self.lines.append((line, "f" if self.depth else "m" if self.main else "o"))
            self.words = ""

        def handle_starttag(self, tag, attrs):
            if tag not in ("a", "b"):
                self.cut()
            self.depth += tag in ("nav", "footer", "head") or ("class", "ad") in attrs
            self.main += tag == "article"
            self.script = tag in ("script", "style")

        def handle_endtag(self, tag):
            if tag not in ("a", "b"):
                self.cut()
            self.depth -= tag in ("nav", "footer", "head", "div")
            self.main -= tag == "article"
            self.script = False

        def handle_data(self, data):
            if not getattr(self, "script", False):
                self.words += data

    p = Parser()
    p.feed(html)
    p.close()
    p.cut()
    return p.lines


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_html_of_the_whole_table_equals_brute_force(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in html_text.extract_pages(spark.read.parquet(f"{DATA}/pages.parquet")).collect()}
    lines = {p.page_id: simple_lines(p.html) for p in pages}
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.text == "\n".join(x for x, z in lines[p.page_id] if z == "m") and r.n_chars == len(r.text) and r.n_lines == len(lines[p.page_id])
        assert r.n_lines == r.n_by_difference + r.n_by_structure + len(r.text.split("\n"))
    hosts = defaultdict(list)
    for p in pages:
        m = re.match(r"[A-Za-z]+://([^/?#]*)([^?#]*)", p.url)
        hosts[m[1].lower()].append((re.sub(r"(/|\.html?)$", "", m[2]), p.page_id))
    shared = sum(got[i].n_by_difference + got[i].n_protected for own in hosts.values() for _, i in own)
    pairs = [(x, y) for own in hosts.values() if len({p for p, _ in own}) == len(own) for (_, x), (_, y) in zip(sorted(own), sorted(own)[1:], strict=False)]
    assert shared >= sum(lcs([x for x, _ in lines[a]], [y for y, _ in lines[b]]) for a, b in pairs[::2] if not set(pairs[1::2]) & {(a, b)}) / 2
    assert pairs


def test_differencing_decides_where_pages_have_no_structure(spark):
    page = "<html><body><div>Site name</div><div>Menu A</div><p>{0}</p><p>{1}</p><div>All rights kept</div></body></html>"
    rows = [(i, f"http://h{i % 2}/blog/{i:03}", page.format(f"unique text {i}", f"more text {i}")) for i in range(400)] + [(1000, "http://h0/blog/000", page.format("unique text 0", "more text 0"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 7):
        got = {r.page_id: (r.text, r.n_by_difference, r.n_by_structure) for r in html_text.extract_pages(df.repartition(parts)).collect()}
        assert got == {i: (f"unique text {i % 1000}\nmore text {i % 1000}", 3, 0) for i, *_ in rows}


# 8 ---------------------------------------------------------------------------------------------------------------
def test_grammar_weighs_context():
    g = toxicity.Grammar({"idiot": 0.9, "lowei*": 0.95})
    plain = g.score("what an idiot that was")
    assert g.score("you idiot") > plain > g.score('she wrote: "an idiot" indeed') > 0
    assert g.score("that is not an idiot") < 0.7 < plain and g.score("i will hurt you") >= 0.7 and g.score("i will hurt no plants") == 0
    assert g.score("das loweische") > 0.9 and g.score(None) == g.score("") == 0


@pytest.mark.parametrize("text", ["i will never hurt you", "she said he will kill them", "he claimed: 'they will hurt you'", "he is an idiot, she said", "an idiot he is not", "no one will ever hurt you"])
def test_denied_and_reported_matches_stay_below_the_threshold(text):
    assert 0 < toxicity.Grammar({"idiot": 0.99}).score(text) < 0.7


def test_toxic_matches_stay_above_it():
    g = toxicity.Grammar({"idiot": 0.93, "weak*": 0.65})
    for text in ("i will hurt you", "they are going to kill them", "what an idiot", "weaka. then weakb", "not a word of it. you idiot", "x " * 100_000 + "idiot"):
        assert g.score(text) >= 0.7
    assert g.score("weaka once") < 0.7 and g.score(" ") == 0


@pytest.mark.parametrize("text", ["the sun will burn you", "we shall beat them in the match", "will you kill the lights for them", "don't call people idiots", "smoking will kill you", "he hunts them", "go to the die caster", "you may hurt yourself", "people hunt deer with them. sit down"])
def test_harmless_uses_stay_below_the_threshold(text):
    assert toxicity.Grammar({"idiot": 0.93, "idiots": 0.93}).score(text) < 0.7


@pytest.mark.parametrize("text", ["hunt them down", "go die", "kill yourself", "please go kill yourself", "we will hunt all of you down", "they will beat him up", "i'm going to kill you", "gonna stab you", "someone should murder them", "who will kill them", "i will go hurt them"])
def test_threats_in_other_forms(text):
    assert toxicity.Grammar({}).score(text) >= 0.7


def matches_by_place(c):
    """What the grammar's docstring says, from places in the clause instead of states: {place of a match: (kind, what is said about it)}."""
    t = toxicity
    near = lambda kinds, lo, hi: [k for k in range(max(0, lo), min(len(c), hi + 1)) if c[k] in kinds]
    letter = dict(zip((t.HURT, t.MODAL, t.TARGET, t.ACTOR, t.PERSON, t.HUNT, t.PARTICLE, t.QUANTITY, t.SELF, t.GO, t.DIE), "HMTAPBRQSGD", strict=True))
    text = "".join(letter.get(x, "o") for x in c)
    will = "(?:^|[AP].{0,2})M[^HBG]{0,3}"
    threat = re.compile(f"(?:(?:{will}|G)HQ*[TPS]|^HS|(?:{will}|^|G)BQ*[TP][^RGM]?R|GD)$")
    found = {i: ("insult", set()) if x == t.INSULT else ("threat", set()) for i, x in enumerate(c) if x == t.INSULT or threat.search(text[: i + 1])}
    for i, (kind, said) in found.items():
        after = min([k for k in found if k > i], default=len(c))  # what follows the next match is about that one
        if kind == "insult":
            targets = [k for k in near({t.TARGET, t.PERSON}, i + 1, min(i + 4, after))]
            if near({t.TARGET, t.PERSON}, i - 4, i - 1) or (targets and targets[0] not in found):
                said.add("targeted")
        be = min(near({t.COPULA}, i + 1, i + 4), default=None)
        no = min(near({t.NOT}, i + 1, after - 1), default=None)
        if near({t.NOT}, i - (4 if kind == "insult" else 6), i - 1) or (be is not None and no is not None and be < no <= be + 4 and be < after):
            said.add("negated")
        speech = min(near({t.SAID, t.QUOTE}, i + 1, after - 1), default=None)
        if near({t.SAID, t.QUOTE}, i - 8, i - 1) or (speech is not None and speech <= i + 4 and c[speech] == t.SAID):
            said.add("reported")
    return {i: (k, sorted(v)) for i, (k, v) in found.items()}


def test_composed_machine_equals_the_patterns():
    rnd = random.Random(8)
    machine = toxicity.machine()
    kinds = Counter()
    for _ in range(60_000):
        c = rnd.choices(range(17), [rnd.choice([2, 9]), 2, 4, 4, 3, 3, 1, 1, 1, 3, 2, 3, 3, 1, 2, 2, 1], k=rnd.randint(1, 16))
        state, got, last = 0, {}, None
        for i, x in enumerate(c):
            state, mark, said = machine.step(state, x)
            if mark:
                last = i
                got[i] = (mark, set(said))
            elif said:
                got[last][1].update(said)
        got = {i: (k, sorted(v)) for i, (k, v) in got.items()}
        assert got == matches_by_place(c), c
        kinds.update((k, x) for k, v in got.values() for x in v or [""])
    assert len(kinds) == 7 and min(kinds.values()) > 300, kinds


def test_lexicon_joins_splinters_and_keeps_chance_out():
    counts = {f"zork{x}*": (6, 6, 1, 1) for x in "abc"} | {"zork*": (20, 40, 18, 19), "zor*": (20, 40, 18, 19), "rare*": (4, 4, 4, 4), "vile*": (20, 20, 9, 9), "vilen*": (20, 20, 9, 9)}
    got = toxicity.lexicon(counts, 60, 500, 50_000)
    assert set(got) == {"zork*", "vilen*"} and got["zork*"] <= toxicity.WEAK < 0.7 < got["vilen*"]


def test_toxicity_learns_from_training_rows_only(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = []
    for i in range(600):
        w = [rnd.choice(words) for _ in range(40)]
        if toxic := i % 5 == 0:
            w[rnd.randrange(40)] = "zork" + rnd.choice(words)[:3]
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    g = toxicity.fit(df.where("doc_id < 400"))
    scored = {r.doc_id: r.score for r in toxicity.score_documents(df, g).collect()}
    held = [r for r in rows if r[0] >= 400]
    assert sum((scored[i] >= 0.7) == bool(t) for i, _, t in held) / len(held) > 0.98
    assert toxicity.keep_clean(df.withColumn("score", F.lit(1)), g).count() == sum(s < 0.7 for s in scored.values())
    assert toxicity.score_documents(df.limit(0), toxicity.fit(df.limit(0))).count() == 0


def test_toxicity_of_nulls_repeats_and_long_texts(spark):
    g = toxicity.Grammar({"idiot": 0.93})
    long = "a calm word. " * 200_000
    rows = [(1, None, 0.0), (2, "", 0.0), (3, "you idiot", 1.0), (3, "you idiot", 1.0), (None, "hunt them down", 1.0), (4, long, 0.0), (5, long + "you idiot", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("predicted", F.lit("x")).withColumn("toxic", F.lit(None).cast("int"))
    got = sorted(((r.doc_id, r.score >= 0.7) for r in toxicity.score_documents(df, g).collect()), key=repr)
    assert got == sorted(((i, bool(s)) for i, _, s in rows), key=repr)
    kept = toxicity.keep_clean(df, g)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert toxicity.fit(df).words == toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 0.93)).words  # null labels teach nothing


# 9 ---------------------------------------------------------------------------------------------------------------
def brute_quality(t):
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    found = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {j for k in range(len(w) - 7) if found[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_quality_base_counts(spark, odd):
    extra = spark.createDataFrame([(500, "a b c d e f g h " * 6 + "#*x"), (501, "l1 x\nl1 x\n\n\nl2"), (502, " ".join(f"w{i}" for i in range(30)) + " w0 w1 w2 w3 w4 w5 w6 w7")], "doc_id long, text string")
    df = odd.select("doc_id", "text").union(extra)
    texts = texts_of(df)
    model = quality.fit(df, df.where("doc_id % 2 = 0").select("doc_id"))
    rows = quality.rate(df, model).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == {i: brute_quality(t) for i, t in texts.items()}
    assert all(not r.kept for r in rows if r.base_failed)
    nothing = quality.fit(df, df.limit(0).select("doc_id"))
    assert all(r.log_ratio == 0 for r in quality.rate(df, nothing).collect())
    assert quality.rate(empty(spark), quality.fit(empty(spark), empty(spark))).count() == 0


def test_quality_counts_all_trusted(spark, monkeypatch):
    rnd = random.Random(2)
    docs = spark.createDataFrame([(i % 19 or None, " ".join(rnd.choice("abcdefgh") * 3 for _ in range(30))) for i in range(20)], "doc_id long, text string")
    trusted = docs.select("doc_id").where("doc_id % 2 = 0")
    whole = quality.fit(docs, trusted).first().w
    monkeypatch.setattr(quality, "MAX_TRUSTED", 3, raising=False)  # an earlier cap
    assert quality.fit(docs, trusted.union(trusted)).first().w == pytest.approx(whole) and len(set(whole)) > 4


def test_quality_prefers_text_like_the_trusted(spark):
    rnd = random.Random(6)
    good, bad = [f"good{i}" for i in range(50)], [f"junk{i}%%" for i in range(50)]
    rows = [(i, " ".join(rnd.choice(good if i % 2 else bad) for _ in range(60))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = quality.rate(df, quality.fit(df, df.where("doc_id % 2 = 1 and doc_id < 100").select("doc_id"))).collect()
    assert min(r.log_ratio for r in out if r.doc_id % 2) > 0 > max(r.log_ratio for r in out if r.doc_id % 2 == 0)


def test_quality_verdict_equals_brute_force(spark):
    import math

    rnd = random.Random(12)
    vocab = [f"w{i}" for i in range(12)]
    texts = {i: " ".join(rnd.choice(vocab[: 12 if i % 3 else 5]) + ("" if i % 4 else "!") for _ in range(rnd.choice([0, 1, 25, 60, 90]))) or None for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    trusted = {i for i in texts if i % 3 == 0}
    rows = quality.rate(df, quality.fit(df, df.where("doc_id % 3 = 0").select("doc_id"), buckets=1 << 20)).collect()
    raw, good = [Counter(), Counter()], [Counter(), Counter()]
    grams = {i: (w := WORD.findall(t or ""), list(zip(w, w[1:], strict=False))) for i, t in texts.items()}
    for i, kinds in grams.items():
        for k in (0, 1):
            raw[k].update(kinds[k])
            good[k].update(kinds[k] if i in trusted else ())
    n, t = [sum(c.values()) for c in raw], [sum(c.values()) for c in good]

    def ratio(k, g):
        share = raw[k][g] / n[k]
        return math.log((good[k][g] + 1000 * share) / (t[k] + 1000)) - math.log(share)

    verdicts = set()
    for r in rows:
        all_ = [ratio(k, g) for k in (0, 1) for g in grams[r.doc_id][k]]
        want = sum(all_) / len(all_) if all_ else 0.0
        assert r.log_ratio == pytest.approx(want, abs=1e-9)
        assert r.kept == (not r.base_failed and want >= -0.15)
        verdicts.add((r.base_failed, r.kept))
    assert len(verdicts) == 3  # failed, kept, and turned down by the ratio


def test_quality_buckets_grow_with_the_corpus(spark):
    sizes = [quality.bucket_count(spark.createDataFrame([("x" * 1000,)] * 10, "text string").selectExpr(f"repeat(text, {k}) as text")) for k in (0, 1, 40_000)]
    assert sizes == [1 << 15, 1 << 15, 1 << 16]


# 10 --------------------------------------------------------------------------------------------------------------
def brute_lines(texts):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                held[key(line)].add(i)
    return {i: [x for x in t.split("\n") if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != i)] for i, t in texts.items()}


def cleaned(index, df):
    return {r.doc_id: r["__kept"] for r in index.drop_lines(df.select("doc_id", "text")).collect()}


def test_line_dedup_and_its_reversal(spark, odd):
    texts = texts_of(odd)
    want = {i: "\n".join(x) for i, x in brute_lines(texts).items()}
    assert {r.doc_id: r["__kept"] for r in line_dedup.dedup_lines(odd).collect()} == want
    first, second = odd.where("doc_id % 2 = 0"), odd.where("doc_id % 2 = 1")
    one = line_dedup.LineIndex().insert(first)
    both = one.insert(second)
    assert cleaned(both, odd) == want
    back = both.delete(second.select("doc_id"))
    only = {i: t for i, t in texts.items() if i % 2 == 0}
    assert cleaned(back, first) == {i: "\n".join(x) for i, x in brute_lines(only).items()} == cleaned(one, first)
    refs = lambda x: sorted((bytes(r.key), r.n_lines, r.owner, r.last) for r in x.refs.collect())
    assert refs(back) == refs(one)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_filters_spare_the_exact_table_and_grow(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    asked = []
    real = line_dedup._seen
    batches = [spark.createDataFrame([(b * 100 + i, "\n".join([f"line number {b} {i} {k}" for k in range(6)] + ["a line of all documents"])) for i in range(40)], "doc_id long, text string") for b in range(3)]
    index = line_dedup.LineIndex()
    for n, b in enumerate(batches, 1):
        index = index.insert(b)
        assert index.refs.count() == 240 * n + 1 and index.refs.agg(F.max("n_lines")).first()[0] == 40 * n
        assert index.shards >= 240 * n // 32 and index.filters.count() <= index.shards
        words = index.refs.select("word", index._shard()).toPandas()
        slots = {r.shard: r.slots for r in index.filters.collect()}
        import pandas as pd

        for shard, f in words.groupby("shard"):
            asked.append(len(real(None, f, pd.DataFrame({"slots": [slots[shard]]}))) == len(f))
            new = pd.DataFrame({"word": np.random.default_rng(n).integers(0, 1 << 62, 2000)})
            assert len(real(None, new, pd.DataFrame({"slots": [slots[shard]]}))) < 40  # nearly all new keys skip the exact table
    assert all(asked)


def test_shards_grow_before_a_batch_far_larger_than_the_index(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 64)
    grown = []
    refilled = line_dedup.LineIndex._refilled
    monkeypatch.setattr(line_dedup.LineIndex, "_refilled", lambda self, total: grown.append((self.refs.count(), total)) or refilled(self, total))
    small = spark.createDataFrame([(0, "a line of all documents")], "doc_id long, text string")
    # One line in a third of the rows, the others on their own.
    large = spark.createDataFrame([(i, "a line of all documents" if i % 3 == 0 else f"line number {i} alone") for i in range(1, 1501)], "doc_id long, text string")
    one = line_dedup.LineIndex().insert(small)
    both = one.insert(large)
    assert grown[0] == (1, 1) and grown[1] == (1, 1001)  # before the filters are asked, over the one key that they hold
    assert both.shards * 32 >= 1001 and both.refs.count() == 1001
    got = {r.doc_id: r["__n_dropped"] for r in both.drop_lines(large).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(1, 1501)}


def test_line_dedup_of_a_document_with_very_many_lines(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, "\n".join(f"some line number {i % (n // 2)}" for i in range(n))), (0, "\n".join(f"some line number {2 * i}" for i in range(n // 4)))], "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: (r["__n_lines"], r["__n_dropped"]) for r in line_dedup.dedup_lines(df).collect()}
        assert got == {1: (n, n // 2), 0: (n // 4, 0)}
        return time.time() - began

    took(1000)
    assert took(100_000) < 8 * max(2.0, took(20_000))


def test_line_dedup_with_clashing_columns_and_repeated_ids(spark):
    rows = [(1, "the very same line\nx", "k"), (1, "the very same line\ny", "k"), (None, "the very same line", "k"), (2, None, None), (2, "the very same line\nthe very same line\nz", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumns({c: F.lit(0) for c in ("body", "pos", "word", "owner", "last", "shard")})
    got = sorted((r.doc_id or -1, r["__kept"], r["__n_dropped"]) for r in line_dedup.dedup_lines(df, batches=3).collect())
    assert got == [(-1, "", 1), (1, "the very same line\nx", 0), (1, "the very same line\ny", 0), (2, "", 0), (2, "z", 2)]


def test_cuckoo_filter():
    rnd = np.random.default_rng(0)
    keys = np.unique(rnd.integers(0, 1 << 63, 20_000).astype(np.uint64))
    f = line_dedup.CuckooFilter(len(keys))
    assert f.add(keys) and f.contains(keys).all()
    other = rnd.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01
    f.remove(keys[:5000])
    assert f.contains(keys[5000:]).all() and f.contains(keys[:5000]).mean() < 0.01
    assert not line_dedup.CuckooFilter(16).add(keys[:200])


# the queries and the pipeline ----------------------------------------------------------------------------------------
def test_queries_match_their_oracles(spark):
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, DATA)
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        columns = sorted(df.columns)
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall()), name


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns, start = docs.count(), docs.columns, texts_of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = queries_written(stage(spark, docs, DATA), name)
        assert nxt.columns == columns
        now = texts_of(nxt)
        if name == "line_dedup":
            assert now == {i: "\n".join(x) for i, x in brute_lines(texts_of(docs)).items()}
        elif name == "simhash_dedup":
            assert nxt.count() <= docs.count() and set(now) <= set(texts_of(docs))
        elif name == "toxicity":
            assert nxt.count() < before and all(start[i] == t for i, t in now.items())
        docs = nxt
    out = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert out.count() == docs.count() and "ids_sha256" in out.columns


def queries_written(df, tag):
    from wayglass.llm.shared import written

    return written(df, tag)
