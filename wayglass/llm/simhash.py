"""SimHash near-deduplication by the generalised pigeonhole principle.

Fingerprints have 64 bits; two link if they differ in `limit` bits or fewer. The bits are grouped into parts so that correlated bits
share a part. Each part i has a threshold t_i of its own, from -1 (never probed) up, with the sum of (t_i + 1) equal to limit + 1: if two
fingerprints differed in more than t_i bits in every part, they would differ in more than limit bits in all. Thresholds, and the number of
parts, are chosen by dynamic programming on the estimated number of candidate pairs plus that of probes. A fingerprint is filed under its value of every part, and
under the larger values within t_i bits of it; fingerprints filed together are verified on all 64 bits.

Copies are folded to one fingerprint first. Of a bucket only a spanning forest of its links is written, found by a search that visits each member once, so
a bucket of thousands of near copies yields no more rows than it has members; a very large bucket is split by the pigeonhole
principle on its other bits. The components of all forests are the classes: no link between different texts is lost.

Few bits catch few texts below a similarity of about 0.95. Where `jaccard` is given, texts whose sets of shingles have at least that Jaccard
similarity link too. Candidates share one of BANDS buckets of ROWS minima of hashes (MinHash): at similarity 0.8 a pair shares none with probability
(1 - 0.8^5)^20 = 0.0004. Every candidate is verified on the sets themselves. Equal sets fold first. The members of a bucket are first verified against its
pivot, the member that meets most others in all its buckets, which joins most copies of one text. Buckets that still hold several classes are then dealt to tasks in pairs of
blocks of bounded size; a task holds the sets of two blocks, looks up all their common shingles in an inverted index, and gives only links that join classes. So
every candidate pair of different classes is verified, while rows stay in proportion to members.

Defined cases: null text counts as empty; texts without a word have fingerprint 0 and link like any other; fewer words than
a shingle has make one shingle; an empty table gives an empty result; rows with one id are rows of their own, and a null id is never the smallest of its
class unless there is no other; other columns pass through where documents are returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayglass.llm.graph import components
from wayglass.llm.shared import written

BITS = 64
SMALL, LARGE = 48, 30_000
#: Filing one probe costs about as much as verifying so many pairs.
PROBE_COST = 60
SHINGLES_AT_ONCE = 500_000
#: MinHash: buckets of a text, and minima that must agree in one.
BANDS, ROWS = 20, 5
MINIMA_AT_ONCE = 2_000
#: Shingles of the members of a block: two blocks are held in a task at once.
BLOCK_SHINGLES = 400_000


def shingle_hashes(text: str | None, shingle: int = 3) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles in their order, up to SHINGLES_AT_ONCE at a time."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return
    if len(words) <= shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    total, done = max(1, len(words) - shingle + 1), 0
    hashes = map(xxhash.xxh64_intdigest, parts, repeat(42))
    while done < total:
        n = min(SHINGLES_AT_ONCE, total - done)
        yield np.fromiter(hashes, np.uint64, n)
        done += n


def _majority(chunks: Iterator[np.ndarray] | list[np.ndarray]) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    for h in chunks:
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(h)
    return int.from_bytes(np.packbits(2 * ones > total, bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned fingerprint of a whole text."""
    return _majority(shingle_hashes(text, shingle))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(11).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return a | np.uint64(1), b


def buckets(different: np.ndarray) -> list[int]:
    """Keys (signed longs) of the BANDS buckets of a set of shingle hashes; a set without members has none."""
    if not len(different):
        return []
    a, b = _mixers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(different), MINIMA_AT_ONCE):
        least = np.minimum(least, (different[i : i + MINIMA_AT_ONCE, None] * a + b).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of each row; set (a hash of its shingle set) and n (members of the set); buckets; text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sets, sizes, keys = [], [], [], []
            for t in b["text"]:
                chunks = list(shingle_hashes(t.as_py(), shingle))
                different = np.unique(np.concatenate([np.zeros(0, np.uint64), *chunks]))
                fps.append(_majority(chunks))
                sets.append(xxhash.xxh64_intdigest(different.tobytes()))
                sizes.append(len(different))
                keys.append(buckets(different))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sets)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *longs, pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), b["text"]], ["doc_id", "fp", "set", "n", "buckets", "text"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long, set long, n long, buckets array<long>, text string")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each pair of bits, how many have both set: 64 x 64 numbers whatever the input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for f in frames:
            bits = np.unpackbits(f["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            yield pd.DataFrame({"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), n).astype(np.int64)})

    cells = fps.select("fp").mapInPandas(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in cells:
        flat[r["cell"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near equal width; each starts at the free bit with the strongest ties and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    ties = np.abs(cov / scale)
    np.fill_diagonal(ties, 0)
    free, out = list(range(BITS)), []
    for i in range(parts):
        width = len(free) // (parts - i)
        group = [max(free, key=lambda b: (ties[b, free].sum(), -b))]
        while len(group) < width:
            group.append(max((b for b in free if b not in group), key=lambda b: (ties[b, group].sum(), -b)))
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def near_probability(p: np.ndarray, bits: list[int]) -> np.ndarray:
    """P(two fingerprints differ in exactly k bits of the part), by adding one bit after another."""
    dist = np.array([1.0])
    for b in bits:
        differ = 2 * p[b] * (1 - p[b])
        dist = np.append(dist, 0) * (1 - differ) + np.append(0, dist) * differ
    return dist


def allocate(n: int, both: np.ndarray, limit: int) -> tuple[list[list[int]], list[int], float]:
    """Parts, their thresholds, and the estimated cost of the cheapest plan."""
    p = np.diag(both) / max(n, 1)
    best: tuple[list[list[int]], list[int], float] | None = None
    for m in range(2, limit + 3):
        parts = group_bits(n, both, m)
        cost = []
        for bits in parts:
            near, row = np.cumsum(near_probability(p, bits)), [0.0]
            for t in range(limit + 1):
                probes = sum(math.comb(len(bits), k) for k in range(min(t, len(bits)) + 1))
                row.append(n * n / 2 * near[min(t, len(bits))] + PROBE_COST * n * probes)
            cost.append(row)
        # plan[s]: the least cost of the parts so far with the sum of (t + 1) equal to s
        plan: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * (limit + 1)
        for row in cost:
            plan = [min(((plan[s - u][0] + row[u], [*plan[s - u][1], u - 1]) for u in range(s + 1) if plan[s - u][0] < math.inf), default=(math.inf, [])) for s in range(limit + 2)]
        if best is None or plan[-1][0] < best[2]:
            best = parts, plan[-1][1], plan[-1][0]
    return best


def _part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


@lru_cache(64)
def _masks(width: int, t: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(1, t + 1) for c in combinations(range(width), k)]


def probes(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, key, fp): each fingerprint under its own value, and under larger values within the part's threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fp = f["fp"].to_numpy(np.int64)
            for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
                if t < 0:
                    continue
                own = _part_values(fp.view(np.uint64), bits)
                yield pd.DataFrame({"part": np.full(len(fp), i, np.int32), "key": own.view(np.int64), "fp": fp})
                for mask in _masks(len(bits), t):
                    key = own ^ np.uint64(mask)
                    up = key > own  # of two values that differ, the smaller one probes
                    yield pd.DataFrame({"part": np.full(int(up.sum()), i, np.int32), "key": key[up].view(np.int64), "fp": fp[up]})

    return fps.select("fp").mapInPandas(run, "part int, key long, fp long")


def forest(fp: np.ndarray, limit: int, free: tuple[int, ...] = tuple(range(BITS))) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span each class of the different fingerprints fp; free: bits in which they may differ."""
    if len(fp) > LARGE and len(free) > limit:
        a, b = [], []
        for block in np.array_split(np.array(free), limit + 1):  # some block agrees
            value = _part_values(fp, list(block))
            order = np.argsort(value, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                if len(group) > 1:
                    x, y = forest(fp[group], limit, tuple(set(free) - set(block.tolist())))
                    a.append(x)
                    b.append(y)
        return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])
    a, b, rest = [], [], fp
    front: list[np.uint64] = []
    while len(rest) or front:
        if not front:
            front, rest = [rest[0]], rest[1:]
        x = front.pop()
        near = np.bitwise_count(rest ^ x) <= limit
        if near.any():
            found = rest[near]
            rest = rest[~near]
            a.append(np.full(len(found), x))
            b.append(found)
            front += list(found)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def _links_of_run(part: np.ndarray, key: np.ndarray, fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the buckets of a run sorted by (part, key), all of whose buckets are complete."""
    start = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(key) != 0)))
    length = np.diff(np.append(start, len(fp)))
    a, b = [], []
    small = length[length <= SMALL]
    if len(small):
        member = np.repeat(length, length) <= SMALL
        where = np.flatnonzero(member)
        group = np.repeat(np.arange(len(length)), length)[where]
        f = fp[where]
        for d in range(1, int(small.max())):
            same = np.flatnonzero(group[:-d] == group[d:])
            if not len(same):
                break
            hit = same[np.bitwise_count(f[same] ^ f[same + d]) <= limit]
            a.append(f[hit])
            b.append(f[hit + d])
        if a:  # keep a forest of what was found
            x, y = np.concatenate(a), np.concatenate(b)
            above: dict[int, int] = {}

            def top(v: int) -> int:
                while (u := above.get(v, v)) != v:
                    above[v] = above.get(u, u)
                    v = u
                return v

            keep = np.zeros(len(x), bool)
            for i, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                if (u := top(u)) != (v := top(v)):
                    above[max(u, v)] = min(u, v)
                    keep[i] = True
            a, b = [x[keep]], [y[keep]]
    for s, n in zip(start[length > SMALL], length[length > SMALL], strict=True):
        x, y = forest(np.unique(fp[s : s + n]), limit)
        a.append(x)
        b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, limit: int = 3) -> DataFrame:
    """(a, b): links that span each class of the different fingerprints fps (fp)."""
    n, both = bit_statistics(fps)
    parts, thresholds, _ = allocate(n, both, limit)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out(rows: list[pd.DataFrame]) -> pd.DataFrame:
            f = pd.concat(rows)
            a, b = _links_of_run(f["part"].to_numpy(), f["key"].to_numpy(), f["fp"].to_numpy(np.int64).view(np.uint64), limit)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        for f in frames:  # a bucket may go on in the next batch
            if not len(f):
                continue
            last = (f["part"].iloc[-1], f["key"].iloc[-1])
            open_ = ((f["part"] == last[0]) & (f["key"] == last[1])).to_numpy()
            if held and (held[-1]["part"].iloc[-1], held[-1]["key"].iloc[-1]) == last and open_.all():
                held.append(f)
                continue
            yield out([*held, f[~open_]])
            held = [f[open_]]
        if held:
            yield out(held)

    filed = probes(fps, parts, thresholds)
    return filed.repartition("part", "key").sortWithinPartitions("part", "key", "fp").mapInPandas(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """Those pairs (a, b) of sets that have at least that Jaccard similarity; texts: one text of each set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            hit, last, own = np.zeros(len(f), bool), None, None
            for i, (b, x, y) in enumerate(zip(f["b"], f["text_a"], f["text_b"], strict=True)):
                if b != last:
                    last, own = b, shingle_set(y, shingle)
                other = shingle_set(x, shingle)
                both = len(np.intersect1d(own, other, assume_unique=True))
                hit[i] = both >= jaccard * (len(own) + len(other) - both) - 1e-9
            yield f.loc[hit, ["a", "b"]]

    held = pairs.join(texts.select(F.col("set").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("set").alias("b"), F.col("text").alias("text_b")), "b")
    return held.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def group_links(sets: list[np.ndarray], roots: np.ndarray, jaccard: float) -> list[tuple[int, int]]:
    """Places of sets (sorted hashes) that link and together join all classes (equal roots) that any similar pair joins."""
    n = np.array([len(x) for x in sets])
    first = np.cumsum(n) - n
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    many = np.bincount(shingle)
    start = np.cumsum(many) - many
    holders = np.repeat(np.arange(len(sets)), n)[np.argsort(shingle, kind="stable")]  # by shingle, the sets that have it
    _, label = np.unique(roots, return_inverse=True)
    largest = np.bincount(label).argmax()
    above = list(range(label.max() + 1))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    out = []
    for i in np.flatnonzero(label != largest):  # pairs inside the largest class join nothing
        own = shingle[first[i] : first[i] + n[i]]
        lengths = many[own]
        at = np.repeat(start[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        both = np.bincount(holders[at], minlength=len(sets))
        for j in np.flatnonzero(both >= jaccard * (n[i] + n - both) - 1e-9):
            x, y = top(label[i]), top(label[j])
            if x != y:
                above[max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def _mixed_links(own: DataFrame, texts: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """(a, b) of sets: links that join the classes of each bucket. own: written rows (key, set, n, root); texts: one text of each set."""
    blocks = own.groupBy("key").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    dealt = own.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set", "root").join(texts, "set")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, names, roots, sets = None, [], [], []

        def done() -> pd.DataFrame:
            found = group_links(sets, np.array(roots), jaccard) if len(sets) > 1 else []
            return pd.DataFrame([(names[x], names[y]) for x, y in found], columns=["a", "b"], dtype=np.int64)

        for f in frames:
            for key, i, j, name, root, text in zip(f["key"], f["i"], f["j"], f["set"], f["root"], f["text"], strict=True):
                if (key, i, j) != last:
                    if sets:
                        yield done()
                    last, names, roots, sets = (key, i, j), [], [], []
                names.append(name)
                roots.append(root)
                sets.append(shingle_set(text, shingle))
        if sets:
            yield done()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "set", "root", "text").mapInPandas(run, "a long, b long")


def similar_links(rows: DataFrame, known: DataFrame, jaccard: float, shingle: int) -> DataFrame:
    """(a, b) of fingerprints: links known, those of equal sets, and enough of those of similar sets for the same classes; rows: written sketches."""
    one = F.coalesce("doc_id", F.lit(-1))
    sets = written(rows.where("n > 0").groupBy("set").agg(F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("buckets").alias("buckets"), F.min(one).alias("one")), "sets")
    different = rows.select("set", "fp").distinct()  # copies fold before the join
    equal = different.join(sets.select("set", F.col("fp").alias("b")), "set").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    found = written(known.select("a", "b").unionByName(equal), "links")
    filed = sets.select("set", "fp", "n", F.explode("buckets").alias("key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    filed = written(filed.join(shared, "key"), "buckets")
    needed = filed.select("set").distinct().join(sets.select("set", "one"), "set")
    # One text of a set, by the id of one of its documents, so that the many copies of a text aren't dealt to one task.
    texts = written(rows.select("set", one.alias("one"), "text").join(needed, ["set", "one"], "left_semi").dropDuplicates(["set", "one"]).select("set", "text"), "texts")
    ends = sets.select("set", "fp")

    def with_roots() -> DataFrame:
        labels = components(found).withColumnRenamed("node", "fp")
        return filed.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    def of_fingerprints(links_: DataFrame) -> DataFrame:
        both = links_.join(ends.withColumnsRenamed({"set": "a", "fp": "fa"}), "a").join(ends.withColumnsRenamed({"set": "b", "fp": "fb"}), "b")
        return both.select(F.col("fa").alias("a"), F.col("fb").alias("b"))

    own = filed.withColumn("root", F.col("fp"))  # classes don't matter yet: there are no more pairs with a pivot than members
    degree = filed.groupBy("set").agg(F.sum("members").alias("degree"))
    pivots = own.join(degree, "set").groupBy("key").agg(F.max_by(F.struct("set", "n", "root"), F.struct("degree", "set")).alias("pivot"))
    apart = (F.col("root") != F.col("pivot.root")) & (F.least("n", "pivot.n") >= jaccard * F.greatest("n", "pivot.n") - 1e-9)
    pairs = own.join(pivots, "key").where(apart).select(F.greatest("set", "pivot.set").alias("a"), F.least("set", "pivot.set").alias("b")).distinct()
    found = written(found.unionByName(of_fingerprints(_verified(written(pairs, "pairs"), texts, jaccard, shingle))), "links")
    own = written(with_roots().where("members > 2").select("key", "set", "n", "root"), "rooted")  # of two members, one is the pivot
    mixed = own.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    own = written(own.join(mixed, "key", "left_semi"), "mixed")
    return written(found.unionByName(of_fingerprints(_mixed_links(own, texts, jaccard, shingle).distinct())), "links")


def near_groups(docs: DataFrame, limit: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links) of each row."""
    rows = written(fingerprints(docs, shingle, id_col, text_col) if jaccard is None else sketches(docs, shingle, id_col, text_col), "fingerprints")
    different = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    near = links(different, limit)
    roots = components(near if jaccard is None else similar_links(rows, near, jaccard, shingle)).withColumnRenamed("node", "fp")
    placed = different.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, limit: int = 3, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns: the smallest id of each class."""
    stay = near_groups(docs, limit, shingle, id_col, text_col, jaccard).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__stay"]), "left_semi")
