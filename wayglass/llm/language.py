"""Language identification by a byte convolutional network.

A text is cut into windows of LENGTH bytes of its UTF-8 form (A-Z lower-cased), each overlapping the next by the widest filter less one, so every filter meets every byte once.
Bytes have learned embeddings; filters of several widths slide over a window, each filter's largest response is kept (max pooling), and a softmax layer turns these into
probabilities. A text's probabilities are the mean over its windows, weighted by the letter bytes of each. The network is trained in numpy by Adam on windows of labelled
texts, whole ones and short pieces; it is then applied to batches of windows, so memory is bounded whatever a text's length.

What is fitted on is bounded: at most MAX_FIT rows, dealt evenly over at most MAX_LANGS languages (the most frequent ones), within a language in order of a digest of the id (of n rows, those with digests below SPARE times the share that is taken are ranked), and PIECES stretches of each.
Everything is seeded. Only texts and languages are read to learn, and only those of the rows that the caller passes in; texts alone are read to predict.

Defined cases: null texts and texts without a letter are UNKNOWN with score 0; rows with null or empty text or null language teach nothing; with nothing to learn from, all rows are UNKNOWN with score 0; ties go to the
language that sorts first; repeated rows get the same answer; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: The network is fitted on this many rows and languages at most.
MAX_FIT, MAX_LANGS = 4_000, 200
#: Rows of a language whose digests are ranked, over those that are taken.
SPARE = 4
#: Bytes of a window, stretches taken of each row fitted on, and bytes that the shortest piece has.
LENGTH, PIECES, SHORTEST = 128, 2, 6
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4, 5), 16, 8
STEPS, BATCH, RATE, SEED = 700, 64, 4e-3, 11
#: Windows that go through the network at a time.
AT_ONCE = 64
OVERLAP = max(WIDTHS) - 1
#: Bytes of letters: a to z, and all that is not ASCII.
LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


class Network:
    """Weights by name, forward and backward passes over windows of bytes (0 pads). All filters are rows of one matrix as wide as the widest; what is beyond a filter's own width is 0."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray] | None = None):
        self.langs = langs
        self.own = np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, EMBEDDING)[:, None].repeat(FILTERS, axis=1) for w in WIDTHS], axis=1)
        if weights is None:
            rnd, n = np.random.default_rng(SEED), FILTERS * len(WIDTHS)
            spread = (np.repeat(WIDTHS, FILTERS) * EMBEDDING) ** -0.5
            weights = {"embed": rnd.normal(0, 0.5, (256, EMBEDDING)), "filters": rnd.normal(0, spread, self.own.shape) * self.own, "shifts": np.zeros(n), "out": np.zeros((n, len(langs))), "bias": np.zeros(len(langs))}
            weights = {k: v.astype(np.float32) for k, v in weights.items()}
        self.weights = weights

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands under the filters at each place (places, windows, ...), and their responses (places, windows, filters)."""
        vectors = self.weights["embed"].take(np.ascontiguousarray(windows.T), axis=0)  # (bytes, windows, embedding)
        places = len(vectors) - OVERLAP
        under = np.concatenate([vectors[i : i + places] for i in range(OVERLAP + 1)], axis=2)
        return under, (under.reshape(-1, under.shape[2]) @ self.weights["filters"]).reshape(places, len(windows), -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(windows)[1].max(axis=0) + self.weights["shifts"], 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        return softmax(self.pooled(windows) @ self.weights["out"] + self.weights["bias"])

    def gradients(self, windows: np.ndarray, answers: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        rows = np.arange(len(windows))
        under, response = self.responses(windows)
        where = response.argmax(axis=0)  # (windows, filters)
        pooled = np.maximum(response.max(axis=0) + self.weights["shifts"], 0)
        error = softmax(pooled @ self.weights["out"] + self.weights["bias"])
        error[rows, answers] -= 1
        error /= len(windows)
        back = (error @ self.weights["out"].T) * (pooled > 0)
        out = {"out": pooled.T @ error, "bias": error.sum(axis=0), "shifts": back.sum(axis=0), "embed": np.zeros_like(self.weights["embed"])}
        out["filters"] = np.einsum("nf,nfk->kf", back, under[where, rows[:, None]]) * self.own
        to_vectors = back[:, :, None] * self.weights["filters"].T[None]  # (windows, filters, widest * embedding)
        for i in range(OVERLAP + 1):
            np.add.at(out["embed"], windows[rows[:, None], where + i].ravel(), to_vectors[:, :, i * EMBEDDING : (i + 1) * EMBEDDING].reshape(-1, EMBEDDING))
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.langs, self.weights))

    @classmethod
    def load(cls, dumped: bytes) -> Network:
        return cls(*pickle.loads(dumped))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text (n, LENGTH) and the letter bytes of each, those it shares with the next one left out."""
    raw = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    step = LENGTH - OVERLAP
    n = max(1, -(-len(raw) // step))
    padded = np.zeros(n * step + OVERLAP, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[::step], LETTER[padded[: n * step]].reshape(n, step).sum(axis=1)


def pieces_of(text: str, key: str) -> list[bytes]:
    """PIECES seeded stretches of a text that hold letters, as long as a window's own part, every second one cut short."""
    rnd, raw, out = np.random.default_rng(zlib.crc32(key.encode())), text.encode("utf-8", "replace").lower(), []
    for i in range(PIECES):
        length = LENGTH - OVERLAP if i % 2 == 0 else int(rnd.integers(SHORTEST, LENGTH - OVERLAP))
        at = int(rnd.integers(0, max(1, len(raw) - length + 1)))
        if LETTER[np.frombuffer(piece := raw[at : at + length], np.uint8)].any():
            out.append(piece)
    return out


def sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The bounded rows to fit on: lang, key, text. Ids are ranked without their texts; of rows that share language and id the least text counts."""
    rows = labelled.where((F.length(text_col) > 0) & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("key"), F.col(text_col).alias("text"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    langs = langs.select("lang", "n", F.floor(F.lit(MAX_FIT) / F.count("*").over(Window.partitionBy(F.lit(0)))).alias("each"))  # MAX_LANGS rows at most
    near = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * F.col("n") < F.col("each") * SPARE  # so no language is ranked as a whole
    offered = rows.select("lang", "key").join(F.broadcast(langs), "lang").where(near)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    ids = offered.withColumn("place", place).where("place <= each").select("lang", "key").distinct()
    return rows.join(F.broadcast(ids), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))  # MAX_FIT rows at most are broadcast


def train(langs: list[str], pieces: list[bytes], answers: np.ndarray) -> Network:
    """STEPS steps of Adam; a step draws BATCH stretches, every language alike."""
    windows = np.zeros((len(pieces), LENGTH), np.uint8)
    for i, p in enumerate(pieces):
        windows[i, : len(p)] = np.frombuffer(p, np.uint8)
    network, rnd = Network(langs), np.random.default_rng(SEED)
    of_lang = [np.flatnonzero(answers == k) for k in range(len(langs))]
    first, second = ({k: np.zeros_like(v) for k, v in network.weights.items()} for _ in range(2))
    for t in range(1, STEPS + 1):
        drawn = np.array([of_lang[k][rnd.integers(len(of_lang[k]))] for k in rnd.integers(len(langs), size=BATCH)])
        rate = RATE * (1 - t / (STEPS + 1))
        for k, g in network.gradients(windows[drawn], answers[drawn]).items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            network.weights[k] -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return network


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Learn from labelled rows; None if none can teach. MAX_FIT * PIECES stretches of less than LENGTH bytes at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(lang, piece) for lang, text, key in zip(*(b[c].to_pylist() for c in ("lang", "text", "key")), strict=True) for piece in pieces_of(text, key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.binary()))], ["lang", "piece"])

    taken = sorted(tuple(r) for r in sample(labelled, id_col, text_col, lang_col).mapInArrow(run, "lang string, piece binary").collect())
    langs = sorted({lang for lang, _ in taken})
    if not langs:
        return None
    return train(langs, [bytes(piece) for _, piece in taken], np.array([langs.index(lang) for lang, _ in taken]))


def predict(texts: list[str], network: Network) -> list[tuple[str, float]]:
    """The language and its probability of each text; the windows of all texts go through the network together, AT_ONCE at a time."""
    sums, weights = np.zeros((len(texts), len(network.langs))), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    n_held = 0

    def flush() -> None:
        windows, new = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]).astype(np.float64)
        owner = np.concatenate([np.full(len(h[2]), h[0]) for h in held])
        for at in range(0, len(windows), AT_ONCE):
            part = slice(at, at + AT_ONCE)
            np.add.at(sums, owner[part], network.probabilities(windows[part]) * new[part, None])
        np.add.at(weights, owner, new)

    for i, text in enumerate(texts):
        windows, new = windows_of(text)
        held.append((i, windows[new > 0], new[new > 0]))  # windows without letters say nothing
        n_held += len(held[-1][2])
        if n_held >= AT_ONCE * 16:
            flush()
            held, n_held = [], 0
    if held:
        flush()
    means = sums / np.maximum(weights, 1)[:, None]
    best = means.argmax(axis=1)
    return [(network.langs[k], float(min(1.0, round(means[i, k], 6)))) if weights[i] else (UNKNOWN, 0.0) for i, k in enumerate(best)]


def identify(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if network is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    dumped = network.dump()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.load(dumped)
        for b in batches:
            texts = b["text"].to_pylist()
            found = iter(predict([t for t in texts if t is not None], own))
            answers = [(UNKNOWN, 0.0) if t is None else next(found) for t in texts]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
