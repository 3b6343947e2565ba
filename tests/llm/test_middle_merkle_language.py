"""Operators 11 to 13 against brute force and held-out rows, with nulls, empty and long texts, ties, repeats, hot groups and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayglass.llm import fill_middle, language, merkle, queries

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, n string, digest string, tree string, at string, salt string"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, [None, "en", "de", "en"][k % 4], f"src{k % 3}" if k % 5 else None, k if k % 6 else None, "k", "n", "d", "t", "a", "s") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, marked, very long and repeated texts; a third of all rows hold one text; a null id and an id of two rows."""
    rnd = random.Random(3)
    texts = [None, "", " \n", "<P>", "a<S>b", "x <M", "é日本 abc1", "x" * 150_000, "ab cd " * 30_000]
    texts += ["".join(rnd.choice("abé \n.") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    texts += ["the same text in many rows"] * 60 + texts[9:14] * 2
    ids = [*range(len(texts) - 2), 5, None]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 --------------------------------------------------------------------------------------------------------------
def middle_of(doc_id, text):
    t = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, t, t
    if h4 % 100 < 20:
        return doc_id, len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", t
    return doc_id, len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", t


@given(st.text(alphabet="abZé日😀 \n1", max_size=300))
@settings(deadline=None, max_examples=200)
def test_elias_fano_lists_give_every_boundary(text):
    wanted = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
    found = fill_middle.boundaries(text)
    assert found.tolist() == wanted
    packed = fill_middle.elias_fano(found)
    assert fill_middle.n_values(packed) == len(wanted) and fill_middle.select(packed, list(range(len(wanted)))) == wanted


def test_elias_fano_lists_are_small():
    found = fill_middle.boundaries("word and word " * 5000)
    assert len(fill_middle.elias_fano(found)) < 4 * len(found) / 8 + 32  # within 4 bits a token, where plain numbers take 64


@pytest.mark.parametrize("per_salt", [256, 7])
def test_middles_match_brute_force(spark, odd, monkeypatch, per_salt):
    monkeypatch.setattr(fill_middle, "PER_SALT", per_salt)
    out = fill_middle.fill_in_middle(odd)
    found = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(middle_of(r.doc_id, r.text)) for r in odd.collect())


def test_middles_without_a_broadcast(spark, odd, monkeypatch):
    wanted = sorted(map(repr, fill_middle.fill_in_middle(odd).collect()))
    monkeypatch.setattr(fill_middle, "BROADCAST_KEYS", 0)
    assert sorted(map(repr, fill_middle.fill_in_middle(odd).collect())) == wanted


def test_hashes_that_collide_get_entries_of_their_own(spark):
    rows = spark.createDataFrame([(1, 4, "one"), (1, 4, "two"), (1, 4, "one"), (1, 4, "two")], "key long, n long, text string")
    index = fill_middle.text_index(rows).collect()
    assert sorted((r.key, r.text, fill_middle.n_values(r.bounds)) for r in index) == [(1, "one", 2), (1, "two", 2)] and len({bytes(r.digest) for r in index}) == 2


def test_the_index_holds_each_repeated_text_once(spark, odd, monkeypatch):
    kept = []
    monkeypatch.setattr(fill_middle, "text_index", lambda rows, f=fill_middle.text_index: kept.append(f(rows)) or kept[-1])
    fill_middle.fill_in_middle(odd).count()
    texts = [r.text or "" for r in odd.collect()]
    assert sorted(r.text for r in kept[0].collect()) == sorted({t for t in texts if texts.count(t) > 1})


def test_empty_table_has_no_middles(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_of_middles(spark):
    found = {r.doc_id: r for r in queries.op11_fill_in_middle(spark, DATA).collect()}
    docs = queries.table(spark, DATA, "documents").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        *head, output, text = middle_of(d.doc_id, d.text)
        assert tuple(found[d.doc_id]) == (*head, sha(output), sha(text))


# 12 --------------------------------------------------------------------------------------------------------------
def leaf(r, more=0):
    values = [r.doc_id, r.source, r.lang, r.n_chars if r.n_chars is None else r.n_chars + more, r.text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def forest_of(rows, arity, tampered):
    """Brute force: (doc_id, leaf, subroot, root, proof digest, folded root) of each row."""
    order = lambda r: (r.lang is not None, (r.lang or "").encode(), r.doc_id is not None, r.doc_id or 0, leaf(r))
    trees = [list(g) for _, g in groupby(sorted(rows, key=order), key=lambda r: r.lang)]
    levels = [levels_of([leaf(r) for r in t], arity) for t in trees]
    top = levels_of([x[-1][0] for x in levels], arity) if trees else []
    out = []
    for j, (tree, own) in enumerate(zip(trees, levels, strict=True)):
        for i, r in enumerate(tree):
            x, siblings = leaf(r, tampered(r)), []
            for some, place in ((own, i), (top, j)):
                for nodes in some[:-1]:
                    first = place - place % arity
                    left, right = nodes[first:place], nodes[place + 1 : first + arity]
                    siblings += left + right
                    x = sha("".join([*left, x, *right]))
                    place //= arity
            out.append((r.doc_id, leaf(r), own[-1][0], top[-1][0], sha("".join(siblings)), x))
    return sorted(map(repr, out))


def crc7(r):
    return int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)


@pytest.mark.parametrize(("arity", "height"), [(2, 2), (2, 10), (3, 1), (5, 2)])
def test_manifest_matches_brute_force(spark, odd, arity, height):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False)).cast("int")
    rows = merkle.manifest(odd, {"n_chars": F.col("n_chars") + hit}, arity=arity, block_height=height)
    path = F.col("path")
    found = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(path), merkle.fold(F.col("changed_leaf"), path)).collect()
    assert sorted(map(repr, map(tuple, found))) == forest_of(odd.collect(), arity, crc7)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9])
def test_small_trees(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}", "en", None, i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.manifest(docs, block_height=1).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("changed_leaf"), F.col("path"))).collect()
    assert sorted(map(repr, map(tuple, found))) == forest_of(docs.collect(), 2, lambda r: 0)


def test_repeated_rows_and_hot_trees(spark):
    docs = spark.range(400).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text", "if(id % 3 = 1, null, 'en') as lang", "'s' as source", "1L as n_chars").repartition(5)
    found = merkle.manifest(docs, block_height=3).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), merkle.fold(F.col("changed_leaf"), F.col("path"))).collect()
    assert sorted(map(repr, map(tuple, found))) == forest_of(docs.collect(), 2, lambda r: 0)


def test_joins_of_paths_without_a_broadcast(spark, odd, monkeypatch):
    wanted = sorted(map(repr, merkle.manifest(odd, block_height=2).collect()))
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, merkle.manifest(odd, block_height=2).collect())) == wanted


def test_empty_table_has_no_manifest(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tampering_shows_exactly_where_it_happened(spark):
    found = queries.op12_merkle_manifest(spark, DATA).collect()
    docs = {r.doc_id: r for r in queries.table(spark, DATA, "documents").collect()}
    assert len(found) == len(docs) and len({r.root for r in found}) == 1
    assert all(r.verified == (not crc7(docs[r.doc_id]) or docs[r.doc_id].n_chars is None) for r in found)


# 13 --------------------------------------------------------------------------------------------------------------
def test_gradients_match_differences():
    rnd = np.random.default_rng(1)
    network = language.Network(["a", "b", "c"])
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    network.weights["out"] = rnd.normal(0, 0.3, network.weights["out"].shape)
    windows, answers = rnd.integers(1, 256, (6, 40), np.uint8), np.array([0, 1, 2, 0, 1, 2])
    gradients = network.gradients(windows, answers)
    for name, weights in network.weights.items():
        flat, at = weights.reshape(-1), int(np.abs(gradients[name]).argmax())
        old, losses = flat[at], []
        for step in (1e-5, -1e-5):
            flat[at] = old + step
            losses.append(-np.log(network.probabilities(windows)[np.arange(6), answers]).mean())
        flat[at] = old
        assert gradients[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-4)


@given(st.text(alphabet="abcé日 \n", max_size=700))
@settings(deadline=None, max_examples=60)
def test_filters_meet_every_byte_once(text):
    windows, letters = language.windows_of(text)
    step, raw = language.LENGTH - language.OVERLAP, text.encode().lower()
    assert b"".join(w[:step].tobytes() for w in windows).rstrip(b"\0") == raw
    assert all((windows[i, step:] == windows[i + 1, : language.OVERLAP]).all() for i in range(len(windows) - 1))
    assert letters.sum() == sum(97 <= b <= 122 or b >= 128 for b in raw)


def own_network(langs=("aa", "bb")):
    rnd = np.random.default_rng(4)
    network = language.Network(list(langs))
    network.weights["out"] = rnd.normal(0, 1, network.weights["out"].shape).astype(np.float32)
    return network


def test_batches_give_what_single_windows_give():
    network, rnd = own_network(("a", "b", "c")), random.Random(8)
    texts = ["".join(rnd.choice("abcdeé 1\n") for _ in range(n)) for n in (1, 5, 123, 124, 125, 900, 40_000)] + ["12", ""]
    for text, (lang, score) in zip(texts, language.predict(texts, network), strict=True):
        windows, letters = language.windows_of(text)
        if not letters.sum():
            assert (lang, score) == (language.UNKNOWN, 0.0)
            continue
        mean = sum(w * network.probabilities(x[None])[0].astype(float) for x, w in zip(windows, letters, strict=True)) / letters.sum()
        assert lang == network.langs[int(mean.argmax())] and score == pytest.approx(mean.max(), abs=1e-4)


def test_unknown_languages(spark, odd):
    found = {r.doc_id: r for r in language.identify(odd, own_network()).where("doc_id is not null and doc_id <> 5").collect()}
    unknown = {r.doc_id for r in odd.collect() if not any(c.isalpha() for c in r.text or "")}
    assert {i for i, r in found.items() if r.lang_pred == "und"} == unknown - {None, 5}
    assert all(0 <= r.score <= 1 for r in found.values()) and language.identify(odd, own_network()).count() == odd.count()
    assert {(r.lang_pred, r.score) for r in language.identify(odd, None).collect()} == {("und", 0.0)}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None), (3, "", "de")], "doc_id long, text string, lang string")
    assert language.fit(none) is None
    assert language.identify(none.limit(0), own_network()).collect() == []


def test_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_FIT", 20)
    monkeypatch.setattr(language, "MAX_LANGS", 2)
    docs = spark.createDataFrame([(i % 90, f"text {i}", ["en", "en", "en", "de", "fr", "de"][i % 6]) for i in range(120)], "doc_id long, text string, lang string")
    rows = language.sample(docs).collect()
    assert {r.lang for r in rows} == {"en", "de"} and all(sum(r.lang == x for r in rows) <= 10 for x in ("en", "de")) and len({(r.lang, r.key) for r in rows}) == len(rows) > 10


def test_languages_of_held_out_rows(spark):
    found = queries.op13_language_id(spark, DATA).collect()
    langs = {r.doc_id: r.lang for r in queries.table(spark, DATA, "documents").collect()}
    assert len(found) == len(langs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    aside = [r for r in found if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in aside) >= 0.98 * len(aside) > 200


def test_held_out_rows_teach_nothing(spark):
    docs = queries.table(spark, DATA, "documents").select("doc_id", "text", "lang").where("doc_id < 300")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    lied = docs.withColumn("lang", F.when(aside, "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit(lied.where(~aside)).langs
