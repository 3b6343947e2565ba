"""BPE encoding and decoding by speculation and verification.

For the words of a batch that are not known yet, greedy longest match proposes tokens. A proposal is the true encoding exactly if each of its
tokens encodes to itself and no adjacent pair would have merged across its border at some point: the test undoes the later of the
two tokens' last merges step by step and looks for a merge across the border of lower rank. All adjacent pairs of all
new words are tested at once in numpy; only words with a failing pair undergo exact merging.

The vocabulary file is a parameter; its format is that of the public tokenizers library (BPE with an end-of-word suffix, byte-level
alphabet, NFC, white space folded, lower case). The library itself is not used here.

Defined cases: null and empty texts have no tokens; the strings of special tokens become their ids, as in the library;
any length of text is handled whole; other columns pass through. Characters that entered Unicode after version 15 may count as letters
or change case here and not in the library, or the other way round; texts without them get the same ids.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words kept while a task runs; then the store starts anew. Workers outlive tasks, so a task leaves none behind.
KNOWN_WORDS = 100_000
#: Fixed value: the white space of the public regular-expression dialect of the vocabulary file.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is in no word, so folding it beforehand would change nothing; its set is written out.
        own = split["pattern"]["Regex"]
        self.pattern = regex.compile(own.replace(r"\s", SPACE))
        # For ASCII text in lower case the standard library's engine reads the same pattern, with its classes spelled out.
        self.ascii_pattern = re.compile(own.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r "))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.alphabet = byte_alphabet()
        n = max(self.token_of) + 1
        # The merge that makes each token, and its rank; base symbols have rank -1 and no parts.
        self.left, self.right, self.rank = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t = self.vocab[a + b]
            self.merges[self.vocab[a], self.vocab[b]] = (r, t)
            if self.rank[t] < 0:
                self.left[t], self.right[t], self.rank[t] = self.vocab[a], self.vocab[b], r
        keys = np.array([a * n + b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks, self.n = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order], n
        cut = len(self.suffix)
        self.final = {t[:-cut]: i for t, i in self.vocab.items() if t.endswith(self.suffix) and len(t) > cut}
        self.inner = {t: i for t, i in self.vocab.items() if not t.endswith(self.suffix) or len(t) == cut}
        self.prefixes = {t[:k] for t in self.inner for k in range(1, len(t))} - self.inner.keys()
        self.whole: dict[int, bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}

    # exact merging ---------------------------------------------------------------------------------------------
    def merge(self, word: str) -> list[int]:
        """Lowest rank first, leftmost first."""
        return self._merge([self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]])

    def _merge(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 40, -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]  # (rank, token made) of each neighbour pair
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i] = best[1]
            del ids[i + 1], found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    # speculation -----------------------------------------------------------------------------------------------
    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left; the last token carries the suffix. A walk stops where no token goes on."""
        out, at, n = [], 0, len(word)
        final, inner, prefixes = self.final.get, self.inner.get, self.prefixes
        while (t := final(word[at:])) is None:
            end, stop = at + 1, at
            while end < n:
                if (x := inner(s := word[at:end])) is not None:
                    t, stop = x, end
                elif s not in prefixes:
                    break
                end += 1
            out.append(t)
            at = stop
        out.append(t)
        return out

    # verification ----------------------------------------------------------------------------------------------
    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: does the encoding of their joined text keep the border between them?

        Walk back in time. Let x and y be the parts of a and b that touch the border. The pair breaks if (x, y) merges at a
        rank below that at which the later of x and y was taken up into a larger part. Then the part made last is undone.
        """
        x, y = a.copy(), b.copy()
        big = np.int64(1 << 40)
        x_until, y_until = np.full(len(a), big), np.full(len(a), big)  # the rank of the merge that took x or y up
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            xs, ys = x[live], y[live]
            key = xs * self.n + ys
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], big)
            # At equal rank the merge further left goes first: x is taken up by a merge left of the border.
            bad = (rank < x_until[live]) & (rank <= y_until[live]) & (rank < big)
            good[live[bad]] = False
            rx, ry = self.rank[xs], self.rank[ys]
            over = bad | ((rx < 0) & (ry < 0))
            undo_x = rx > ry  # the later merge is undone first
            undo_both = (rx == ry) & (rx >= 0)
            ux, uy = ~over & (undo_x | undo_both), ~over & ~undo_x
            i = live[ux]
            x_until[i] = self.rank[x[i]]
            x[i] = self.right[x[i]]
            i = live[uy]
            y_until[i] = self.rank[y[i]]
            y[i] = self.left[y[i]]
            live = live[~over]
        return good

    def itself(self, t: int) -> bool:
        if t not in self.whole:
            s = self.token_of[t]
            if s.endswith(self.suffix) and s != self.suffix:
                self.whole[t] = self.merge(s[: -len(self.suffix)]) == [t]
            else:  # inside a word: merged without a word end
                self.whole[t] = self._merge([self.vocab[c] for c in s]) == [t]
        return self.whole[t]

    def learn(self, words: list[str]) -> int:
        """Encode words that are not known; the number that needed exact merging."""
        forms = ["".join(self.alphabet[b] for b in w.encode()) for w in words]
        proposed = [self.propose(f) for f in forms]
        lengths = np.array([len(p) for p in proposed], np.int64)
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = owner[:-1] == owner[1:]
        ok = np.ones(len(words), bool)
        if inner.any():
            pairs, back = np.unique(flat[:-1][inner] * self.n + flat[1:][inner], return_inverse=True)
            good = self.compatible(pairs // self.n, pairs % self.n)
            ok[owner[:-1][inner][~good[back]]] = False
        tokens, back = np.unique(flat, return_inverse=True)
        own = np.array([self.itself(int(t)) for t in tokens], bool)
        ok[owner[~own[back]]] = False
        failed = 0
        for w, f, p, good in zip(words, forms, proposed, ok, strict=True):
            if not good:
                p = self.merge(f)
                failed += 1
            self.known[w] = (len(p), " ".join(map(str, p)), " ".join(map(self.token_of.__getitem__, p)))
        return failed

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_pattern.findall(text.lower())
        return self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # a capital sigma has one lower case here

    def pieces(self, text: str) -> list[list[str] | str]:
        """Words of the stretches between special tokens, and the special tokens."""
        if "<|" not in text:
            return [self.words(text)]
        return [part if part in self.special else self.words(part) for part in self.cut.split(text)]

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        cut = [self.pieces(t) for t in texts]
        known = self.known
        fresh = list(dict.fromkeys(w for pieces in cut for p in pieces if type(p) is list for w in p if w not in known))
        if fresh:
            self.learn(fresh)
        out = []
        for pieces in cut:
            got: list[tuple[int, str, str]] = []
            for p in pieces:
                if type(p) is list:
                    got += map(known.__getitem__, p)
                else:
                    got.append((1, str(self.special[p]), p))
            n, ids, tokens = zip(*got, strict=True) if got else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(tokens)))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, as the file names no decoder; special tokens are kept."""
        return " ".join(self.token_of[i] for i in ids if i in self.token_of)


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _batches(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        batch.append(t.as_py() or "")
        size += len(batch[-1])
        if size > chars:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with `ids` the token ids as an array."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids

    def run(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in record_batches:
            got = [(n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), [int(i) for i in joined.split()] if ids else None)
                   for batch in _batches(b["text"]) for n, joined, decoded in bpe.encode_batch(batch)]
            columns = [b["doc_id"], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns, names = [*columns, pa.array([g[3] for g in got], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)
        load.cache_clear()  # workers outlive tasks; reading the file again takes a fraction of a second

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
