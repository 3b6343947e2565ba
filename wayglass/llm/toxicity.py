"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes by an insult lexicon, and by closed lists for threats, targets, negation and reported speech. Five small
transducers read the class string of a clause. The first two mark matches, the others read the string with its marks and weigh them; all five are
composed into one machine (their product, of which each step is made when a text first takes it):

    insult    marks each insulting word
    threat    marks the object of a harm verb: a person who acts ("I", "they", ... up to three words before, or nobody where the clause begins) + "will / going to" + harm verb within four words + target,
              with nothing between but "all", "of", ...; "go" + harm verb + target; a harm verb + "yourself" where a clause begins; "go die". Verbs that harm only with a particle
              ("hunt", "beat") are marked at it ("hunt them down", "beat you up"), and need no modal where a clause begins
    target    an insult with a target ("you", "they", ...) within four words before or after it is weighted up
    negation  "not", "never" up to four words before an insult or six before the target of a threat, or after a match and a form of "be", weights it down
    reported  a verb of saying or a quotation mark up to eight words before a match, or a verb of saying up to four words after it, weights it down

A negated or reported match is first cut to odds of CEILING, so that no lexicon entry is strong enough to outweigh either. A clause's weight is the noisy or
over its matches, a document's score that over its clauses, so one clear clause is enough and words outside a matched clause count for nothing.

The lexicon holds prefixes of words (4 letters or more) and whole words whose document counts in toxic and clean labelled documents differ beyond chance
(G-test at a level divided by the number of features tested), next to a short built-in list. A stem that clean documents hold now and then, but not twice, is kept as a
weak one: one match stays below any usual threshold, two reach the precision learned for documents that hold it twice.

Labels are read only to fit, and only those of rows the caller passes in; at most `MAX_FIT` ids of labelled rows (in order of their digest) are used.
Defined cases: null and empty texts score 0; whole texts are read, whatever their length; repeated rows score alike; with no labels the built-in list is all; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayglass.llm.shared import written

#: The classifier is fitted on this many labelled rows at most.
MAX_FIT = 20_000
#: Stems kept at most, the strongest first; it bounds what is sent to every task.
MAX_STEMS = 4_000
#: False features to expect over all that are tested; precision of strong features, and of weak ones where they occur twice; weight of one weak match at most.
FALSE_FEATURES, PRECISION_LEAST, TWICE_LEAST, WEAK = 0.1, 0.9, 0.8, 0.65
SHORTEST, LONGEST = 4, 8
#: Features whose counts a task holds before it hands them on.
SUMS_HELD = 40_000
#: Words whose precision a task remembers; then the store starts anew.
KNOWN_WORDS = 100_000

#: Words of general use.
INSULTS = "idiot idiots moron morons stupid dumb loser losers clown clowns trash scum pathetic worthless disgusting imbecile cretin vermin filth bastard scumbag lowlife dimwit halfwit".split()
HARM = "kill hurt destroy murder shoot stab burn crush".split()
CHASE, PARTICLES = "hunt beat".split(), "down up dead senseless bloody".split()
WILL = "will gonna shall must should going ll".split()
ACTORS = "i we one someone somebody who gang mob men guys boys brother brothers friends dad".split()
PERSONS = "he she they people everyone".split()
QUANTITIES, SELVES = "all every each of any both some".split(), "yourself yourselves".split()
TARGETS = "you your youre u him his her them their these those du dich ihr euch vous toi tu te ustedes vosotros".split()
NEGATIONS = "not never no isn aren wasn don doesn didn nobody nicht kein keine nie pas jamais ne nunca".split()
REPORTS = "said says say wrote writes claims claimed called calls quoted reported alleges sagte dit dijo".split()

BE = "is are am was were be been ist sind war est sont es son".split()

_CLAUSE = re.compile(r"[^.!?;\n]+")
_WORD = re.compile(r"[^\W_]+|[\"“„«]")
OTHER, INSULT, HURT, MODAL, TARGET, NOT, SAID, QUOTE, COPULA, ACTOR, PERSON, HUNT, PARTICLE, QUANTITY, SELF, GO, DIE = range(17)
_CLOSED = {w: c for c, words in (
    (COPULA, BE), (HURT, HARM), (MODAL, WILL), (TARGET, TARGETS), (NOT, NEGATIONS), (SAID, REPORTS), (QUOTE, '"“„«'), (ACTOR, ACTORS), (PERSON, PERSONS), (HUNT, CHASE), (PARTICLE, PARTICLES),
    (QUANTITY, QUANTITIES), (SELF, SELVES), (GO, ["go"]), (DIE, ["die"])) for w in words}
CLASSES = DIE + 1

#: Odds of a threat, factor on the odds of a targeted insult, and for negated and reported matches the odds they are cut to and the factors on them.
THREAT_ODDS, TARGETED, CEILING, NEGATED, REPORTED = 0.85 / 0.15, 2.0, 12.0, 0.08, 0.15
#: Words within which the parts of a pattern must follow each other.
REACH, NOT_INSULT, NOT_THREAT, SAID_BEFORE, SAID_AFTER = 4, 4, 6, 8, 4
ACTS, PARTICLE_WITHIN = 3, 2


# Each transducer: (state, class, mark) -> (state, what it emits). Marks are "", "insult" or "threat".
def _step_insult(state: int, c: int, mark: str) -> tuple[int, str]:
    return 0, "insult" if c == INSULT else ""


def _step_threat(state: tuple[int, tuple], c: int, mark: str) -> tuple[tuple[int, tuple], str]:
    """Words left after an actor (ACTS + 1 where the clause begins), and what is awaited: (), a verb after a modal and in how many words, an object, oneself, a particle, or what follows "go"."""
    actor, (kind, left) = state[0], state[1] or ("", 0)
    first = actor > ACTS
    after = ACTS if c in (ACTOR, PERSON) else 0 if first else max(0, actor - 1)
    if c == MODAL and actor:
        return (after, ("verb", REACH)), ""
    if c == GO:
        return (after, ("go", 0)), ""
    if kind == "verb" and left and c not in (HURT, HUNT):
        return (after, ("verb", left - 1) if left > 1 else ()), ""
    if kind in ("verb", "go") and c in (HURT, HUNT):
        return (after, ("object" if c == HURT else "chased", 0)), ""
    if kind in ("object", "chased") and c == QUANTITY:
        return (after, state[1]), ""
    if kind == "chased" and c in (TARGET, PERSON):
        return (after, ("particle", PARTICLE_WITHIN)), ""
    if (kind == "object" and c in (TARGET, PERSON, SELF)) or (kind == "oneself" and c == SELF) or (kind == "particle" and c == PARTICLE) or (kind == "go" and c == DIE):
        return (after, ()), "threat"
    if kind == "particle" and left > 1 and c != MODAL:
        return (after, (kind, left - 1)), ""
    if first and c in (HURT, HUNT):
        return (after, ("oneself" if c == HURT else "chased", 0)), ""
    return (after, ()), ""


def _step_target(state: tuple[int, int], c: int, mark: str) -> tuple[tuple[int, int], str]:
    """Words left after the last target, and after the last insult that has none yet."""
    target, insult = (max(0, x - 1) for x in state)
    if mark == "insult":
        return ((target, 0), "targeted") if state[0] else ((target, REACH), "")
    if c in (TARGET, PERSON):  # that of a threat is not an insult's as well
        return (REACH, 0), "targeted" if state[1] and not mark else ""
    if mark:
        return (target, 0), ""
    return (target, insult), ""


def _step_negation(state: tuple[int, int], c: int, mark: str) -> tuple[tuple[int, int], str]:
    """Words left after a negation; and after a match (REACH + 1 to 2 * REACH), or after a match and a form of "be" (1 to REACH)."""
    before, after = max(0, state[0] - 1), state[1]
    after = after - 1 if after not in (0, REACH + 1) else 0
    if mark:
        held = state[0] > (NOT_THREAT - NOT_INSULT if mark == "insult" else 0)
        return (before, 2 * REACH), "negated" if held else ""
    if c == NOT:
        return (NOT_THREAT, 0), "negated" if 1 <= state[1] <= REACH else ""
    if c == COPULA and state[1] > REACH:
        after = REACH
    return (before, after), ""


def _step_reported(state: tuple[int, int], c: int, mark: str) -> tuple[tuple[int, int], str]:
    """Words left after a verb of saying or a quotation mark, and after a match."""
    before, after = (max(0, x - 1) for x in state)
    if mark:
        return (before, SAID_AFTER), "reported" if state[0] else ""
    if c in (SAID, QUOTE):
        return (SAID_BEFORE, 0), "reported" if c == SAID and state[1] else ""
    return (before, after), ""


MARKING, WEIGHING = (_step_insult, _step_threat), (_step_target, _step_negation, _step_reported)
START = (0, (ACTS + 1, ()), (0, 0), (0, 0), (0, 0))


def compose(state: tuple, c: int) -> tuple[tuple, str, tuple[str, ...]]:
    """One step of the composed transducers: the state, the mark, and what is said about it or, without a mark, about the last match."""
    marked = [f(s, c, "") for f, s in zip(MARKING, state, strict=False)]
    mark = next((m for _, m in marked if m), "")
    weighed = [f(s, c, mark) for f, s in zip(WEIGHING, state[len(MARKING) :], strict=True)]
    return tuple(s for s, _ in [*marked, *weighed]), mark, tuple(e for _, e in weighed if e)


class Machine:
    """The product: `moves` and `emits` by number of a state and class, filled as texts need them."""

    def __init__(self):
        self.numbers, self.states, self.moves, self.emits = {START: 0}, [START], [[-1] * CLASSES], [[None] * CLASSES]

    def step(self, state: int, c: int) -> tuple[int, str, tuple[str, ...]]:
        """The next state, and mark and emissions."""
        to = self.moves[state][c]
        if to < 0:
            after, mark, emitted = compose(self.states[state], c)
            to = self.numbers.setdefault(after, len(self.states))
            if to == len(self.states):
                self.states.append(after)
                self.moves.append([-1] * CLASSES)
                self.emits.append([None] * CLASSES)
            self.moves[state][c], self.emits[state][c] = to, (mark, emitted)
        return to, *self.emits[state][c]


@lru_cache(1)
def machine() -> Machine:
    """The one of this process."""
    return Machine()


class Grammar:
    def __init__(self, stems: dict[str, float]):
        """stems: lower-case word, or prefix with a trailing '*', -> precision."""
        self.words = {w: p for w, p in stems.items() if not w.endswith("*")}
        self.prefixes = {w[:-1]: p for w, p in stems.items() if w.endswith("*")}
        self.lengths = sorted({len(w) for w in self.prefixes})
        self.harm = frozenset(HARM + CHASE)
        self.seen: dict[str, float | None] = {}

    def precision(self, word: str) -> float | None:
        p = self.words.get(word)
        for n in self.lengths:
            q = self.prefixes.get(word[:n]) if len(word) >= n else None
            if q is not None and (p is None or q > p):
                p = q
        return p

    def hits(self, words: set[str]) -> bool:
        if not self.harm.isdisjoint(words) or ("die" in words and "go" in words):
            return True
        seen = self.seen
        if len(seen) > KNOWN_WORDS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = self.precision(w)
            if seen[w] is not None:
                return True
        return False

    def clause(self, words: list[str]) -> float:
        """Probability that the clause is toxic."""
        step, state, matches = machine().step, 0, []  # of each match its odds and what was said about it
        for w in words:
            p = self.precision(w)
            c = INSULT if p is not None else _CLOSED.get(w, OTHER)
            state, mark, emitted = step(state, c)
            if mark:
                matches.append([p / (1 - p) if mark == "insult" else THREAT_ODDS, set(emitted)])
            elif emitted and matches:
                matches[-1][1].update(emitted)
        clean = 1.0
        for odds, said in matches:
            odds *= TARGETED if "targeted" in said else 1.0
            if "negated" in said or "reported" in said:
                odds = min(odds, CEILING) * (NEGATED if "negated" in said else 1.0) * (REPORTED if "reported" in said else 1.0)
            clean /= 1 + odds
        return 1 - clean

    def score(self, text: str | None) -> float:
        low = (text or "").lower()
        if not self.hits(set(_WORD.findall(low))):
            return 0.0
        clean = 1.0
        for m in _CLAUSE.finditer(low):
            words = _WORD.findall(m[0])
            if self.hits(set(words)):
                clean *= 1 - self.clause(words)
        return 1 - clean


def one_of_copies(rows: DataFrame) -> DataFrame:
    """One row of each set with the same least word triple: copies and near copies of one text are one piece of evidence."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), "[^\\p{L}\\p{N}]+")
    n = F.greatest(F.size("__w") - 2, F.lit(0))
    at = lambda k: F.slice("__w", F.lit(1 + k), n)
    triples = F.zip_with(F.zip_with(at(0), at(1), lambda a, b: F.xxhash64(a, b)), at(2), lambda a, b: F.xxhash64(a, b))
    keyed = rows.withColumn("__w", words).withColumn("__least", F.coalesce(F.array_min(triples), F.xxhash64(F.array_join("__w", " ")))).drop("__w")
    return keyed.groupBy("__least").agg(F.min_by(F.struct("text", "toxic"), F.struct(F.length("text"), "digest")).alias("row")).select("row.text", "row.toxic")


def features(rows: DataFrame) -> DataFrame:
    """(feature, t, n, t2, n2): toxic and all documents that hold a word or a prefix of words (ending in '*'), and that hold it twice or more."""

    columns = ["feature", "t", "n", "t2", "n2"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sums: dict[str, list[int]] = {}
            for text, toxic in zip(f["text"], f["toxic"], strict=True):
                if len(sums) > SUMS_HELD:
                    yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=columns)
                    sums = {}
                found: Counter[str] = Counter()
                for w, k in Counter(re.findall(r"[^\W_]+", (text or "").lower())).items():
                    if len(w) >= SHORTEST:
                        found[w] += k
                        for n in range(SHORTEST, min(LONGEST, len(w)) + 1):
                            found[w[:n] + "*"] += k
                for feature, k in found.items():
                    row = sums.setdefault(feature, [0, 0, 0, 0])
                    row[0] += toxic
                    row[1] += 1
                    row[2] += toxic * (k > 1)
                    row[3] += k > 1
            yield pd.DataFrame([(k, *v) for k, v in sums.items()], columns=columns)

    counted = rows.mapInPandas(run, "feature string, t long, n long, t2 long, n2 long")
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("t", "n", "t2", "n2")])


def g_statistic(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    n, df = all_toxic + all_clean, toxic + clean
    cells = ((toxic, all_toxic * df / n), (clean, all_clean * df / n), (all_toxic - toxic, all_toxic * (n - df) / n), (all_clean - clean, all_clean * (n - df) / n))
    return 2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0)


def longest_form(stem: str, toxic: dict[str, int], longer: dict[str, list[str]]) -> str:
    """The longest prefix that goes on from a prefix and loses no more than a fiftieth of its toxic documents. longer: prefixes by the one a letter shorter."""
    while next_ := max(longer.get(stem, ()), key=lambda f: (toxic[f], f), default=None):
        if toxic[next_] < 0.98 * toxic[stem]:
            break
        stem = next_
    return stem


def lexicon(counts: dict[str, tuple[int, int, int, int]], all_toxic: int, all_clean: int, tested: int) -> dict[str, float]:
    """Stems and their weights from the counts (t, n, t2, n2) of the features."""
    least = NormalDist().inv_cdf(1 - FALSE_FEATURES / max(1, tested) / 2) ** 2  # chi-square with one degree of freedom
    toxic = {f: v[0] for f, v in counts.items()}
    longer: dict[str, list[str]] = {}
    for f in counts:
        if f.endswith("*"):
            longer.setdefault(f[:-2] + "*", []).append(f)
    kept: dict[str, float] = {}
    for f in sorted(counts, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        f = longest_form(f, toxic, longer)
        stem = f.rstrip("*")
        if f in kept or any(stem[:n] + "*" in kept for n in range(SHORTEST, len(stem) + (not f.endswith("*")))):
            continue  # a shorter prefix covers it
        t, n, t2, n2 = counts[f]
        if t >= PRECISION_LEAST * n and g_statistic(t, n - t, all_toxic, all_clean) >= least:
            kept[f] = (t + 0.5) / (n + 1)
        elif t2 >= TWICE_LEAST * n2 and g_statistic(t2, n2 - t2, all_toxic, all_clean) >= least:
            kept[f] = min(WEAK, 1 - math.sqrt(1 - (t2 + 0.5) / (n2 + 1)))
        if len(kept) >= MAX_STEMS:
            break
    return kept


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id") -> Grammar:
    """Learn the lexicon from labelled rows (those with a null label are left out)."""
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), F.md5(F.col(id_col).cast("string")).alias("digest"))
    ids = rows.select("digest").distinct().orderBy("digest").limit(MAX_FIT)  # orders digests, not texts
    chosen = rows.join(F.broadcast(ids), rows["digest"].eqNullSafe(ids["digest"]), "left_semi").repartition(16)  # MAX_FIT rows at most are broadcast
    rows = written(one_of_copies(chosen), "fit")
    totals = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    all_toxic, all_clean = int(totals["t"]), int(totals["n"] - totals["t"])
    stems = dict.fromkeys(INSULTS, 0.93)
    if all_toxic and all_clean:
        counted = written(features(rows).where("n >= 4"), "features")
        telling = counted.where((F.col("t") >= 4) & ((F.col("t") >= PRECISION_LEAST * F.col("n")) | (F.col("t2") >= F.greatest(F.lit(4.0), TWICE_LEAST * F.col("n2")))))
        # Their number is bounded by the fit's rows, and by MAX_STEMS.
        strong = telling.orderBy(F.desc("t"), "n", F.length("feature"), "feature").limit(20 * MAX_STEMS).collect()
        kept = lexicon({r["feature"]: (r["t"], r["n"], r["t2"], r["n2"]) for r in strong}, all_toxic, all_clean, counted.count())
        stems |= {f: max(p, stems.get(f, 0)) for f, p in kept.items()}
    return Grammar({f: min(p, 0.995) for f, p in stems.items()})


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""

    stems = {**grammar.words, **{f"{w}*": p for w, p in grammar.prefixes.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(stems)
        for b in batches:
            scores = pa.array([g.score(t.as_py()) for t in b["text"]], pa.float64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], scores], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    stems = {**grammar.words, **{f"{w}*": p for w, p in grammar.prefixes.items()}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grammar(stems)
        for b in batches:
            yield b.filter(pa.array([g.score(t.as_py()) < threshold for t in b[text_col]], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
