"""Abusive, hateful and sexually explicit language by weak supervision.

Lexicon and pattern voters look at every passage of every text.  A generative
label model (one tree of dependences between voters per class, fitted by EM on
the counts of vote patterns of all passages and on what annotators said of some
records) estimates how accurate and how correlated they are; the first guess of
its parameters is worth GUESS_ROWS passages and nothing overrides its
posteriors.  With the judgements of annotators they are the posterior labels of
the judged records' passages, which train a linear classifier on hashed words
and word pairs.  It scores every passage; a text scores as its worst passage.

Sizes that do not grow with the data: vote patterns (at most 2**14), the
judged records used (MAX_JUDGED, whose passages reach the driver as hashed
features), and the classifier's weights (2**18 floats, broadcast).

Defined cases: null and blank texts score 0; texts are read whole; repeated
rows of a record give one row each, with the worst score left to the caller;
without judged records the voters alone teach; abstentions and null judgements
count as none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaza.llm.spelling import Speller
from plaza.llm.tokens import Table, Words, pair_hash, slices, word_hash, words

#: Words of the longest passage; longer sentences are cut into passages that overlap by half.
PASSAGE = 16
#: Words of the shorter passages that are scored as well, so that a few words among others are not outweighed.
SHORT_PASSAGE = 8
#: Judged records the classifier is fitted on, at most (taken by hash).
MAX_JUDGED = 20_000
#: Hashed features.
FEATURE_BITS = 18
#: Chance that an annotator errs, and the share of abusive records before any evidence.
ANNOTATOR_ERROR, PRIOR = 0.06, 0.06
THRESHOLD = 0.25

INSULT_NOUNS = "idiot idiots moron morons imbecile cretin dimwit dumbass asshole bastard scumbag scum loser losers freak creep clown pig maggot parasite degenerate trash garbage pathetic bitch whore slut twat dickhead jerk dummy"
INSULT_ADJECTIVES = "stupid dumb dumbest worthless useless disgusting filthy ugly miserable spineless gutless brainless revolting pathetic vile hideous"
VERMIN = "vermin parasites cockroaches rats maggots filth disease subhuman subhumans animals pigs trash scum cancer plague savages"
GROUPS = "they them their these those people folk folks families immigrants foreigners women men muslims jews blacks gays refugees disabled old all every"
PROFANE = "fuck fucking fucker stfu shit cunt gtfo"
SEXUAL = "nudes nude naked porn porno orgy horny tits boobs cock dick pussy panties cum blowjob xxx uncensored sext hardcore suck sex"
THREAT_VERBS = "kill smash burn stab shoot beat break bleed knife bat strangle hang bury ditch jaw teeth"
FOREIGN = (
    "imbécil basura cállate pudras echarlos lárgate puta mierda crétin crever gueule connard salope merde "
    "vollidiot widerlicher fresse versager ungeziefer verjagt blutest schlampe scheiße arschloch "
    "lixo nojento sangrar vadia caralho"
)
FOREIGN_PAIRS = "das asco|basura humana|son ratas|que echarlos|te pudras|te busco|fotos desnuda|idiota nojento|sale crétin|va crever|ta gueule|casser les|sont des|des parasites|halt die|die fresse|sind ungeziefer|gehören verjagt|finde dich|dann blutest|cala a|seu lixo|são ratos|ser expulsos|te pegar|vai sangrar"
#: Word pairs of common English of each kind; what these texts say beyond them is learnt from the judged records.
PHRASES = {
    "exclude": "go back|your kind|your lot|no place|never be|not belong|belong among|wiped out|be wiped|driven out|put down|lock them|in cages|deserve to|be beaten|never trust|sick of|same air|like animals|like vermin",
    "wish": "drop dead|kys|kill yourself|choke on|go die|go rot|stop existing|end yourself|hope you|you die|you died|get hit|get lost",
    "veiled": "watch your|your back|find you|will find|coming for|coming to|your house|shame if|sleep well|body bag|keep talking|make you|you bleed|break your|smash your|beat you|hurt you|kill you|burn it",
    "sexual2": "sex tape|suck my|suck me|clothes off|send nudes|nude pics|naked pics|naked body|porn clips|me off|send me",
    "mouth": "shut your|shut up|your mouth|filthy mouth|a brain|no brain|waste of|of oxygen|make me|me sick|your face|ashamed of|embarrassed of",
    "reported": "called me|called her|called him|i reported|was wrong|is wrong|plain wrong|an apology|a documentary|propaganda called|hate speech|speech rules",
    "idiom": "i'm such|such an|killed me|final boss|breast cancer|cancer screening|choke point|dummy variable|naked eye|health class|safe sex|the trash|ugly sweater",
}
#: Classes of phrases of which one alone says little.
WEAK = ("exclude", "veiled", "sexual2")
VOTERS = ("insult_to_you", "insult_pair", "listed", "dehumanise", "exclude", "death_wish", "threat", "veiled", "sexual", "profane", "foreign", "put_down", "reported", "idiom")
#: Voters that speak for harmless text.
AGAINST = ("reported", "idiom")
#: Passages that the first guess is worth, and that a judged passage counts as.
GUESS_ROWS, JUDGED_ROWS = 500, 10.0
#: Voters that seldom speak of harmless text, by the first guess.
SURE = ("insult_to_you", "foreign", "insult_pair", "exclude", "death_wish", "veiled", "profane", "put_down")
_CLASSES = ("noun", "adjective", "vermin", "group", "profane", "sexual", "verb", "foreign", "you", "listed", "will", *PHRASES)


def _bit(name: str) -> int:
    return 1 << _CLASSES.index(name)


class Lexemes:
    """Words and pairs of words to sets of lexical classes."""

    def __init__(self, listed: list[str]) -> None:
        one: dict[str, int] = {}
        two: dict[str, int] = {}

        def put(entries: list[str], name: str) -> None:
            for e in entries:
                w = e.lower().split()
                if len(w) == 1:
                    one[w[0]] = one.get(w[0], 0) | _bit(name)
                elif len(w) == 2:
                    two[" ".join(w)] = two.get(" ".join(w), 0) | _bit(name)

        for text, name in (
            (INSULT_NOUNS, "noun"), (INSULT_ADJECTIVES, "adjective"), (VERMIN, "vermin"), (GROUPS, "group"), (PROFANE, "profane"), (SEXUAL, "sexual"), (THREAT_VERBS, "verb"), (FOREIGN, "foreign"),
            ("you your you're yourself u ur du dich tu te você", "you"), ("will i'll gonna someone somebody whoever going ich vou vais", "will"),
        ):
            put(text.split(), name)
        put(listed, "listed")
        put(FOREIGN_PAIRS.split("|"), "foreign")
        for name, text in PHRASES.items():
            put(text.split("|"), name)
        self.words = {w for w, bits in one.items() if bits & ~(_bit("group") | _bit("you") | _bit("will"))}
        self.one = Table(np.array([word_hash(w) for w in one], np.uint64), np.array(list(one.values()), np.int32))
        pairs = [p.split() for p in two]
        a, b = (np.array([word_hash(p[i]) for p in pairs], np.uint64) for i in (0, 1))
        self.two = Table(pair_hash(a, b), np.array(list(two.values()), np.int32))


@dataclass
class Passages:
    """Passages of a batch: first and last word (exclusive) and text index."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def passages(w: Words, longest: int = PASSAGE) -> Passages:
    """Sentences, those above ``longest`` words as half-overlapping windows; no passage spans two texts."""
    n = len(w.hash)
    if not n:
        e = np.zeros(0, np.int64)
        return Passages(e, e, e)
    new = np.ones(n, bool)
    new[1:] = (w.sentence[1:] != w.sentence[:-1]) | (w.doc[1:] != w.doc[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    half = longest // 2
    count = np.maximum(1, -(-(size - half) // half))
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first, count) + k * half
    end = np.minimum(start + longest, np.repeat(first + size, count))
    return Passages(start, end, w.doc[start])


MENTION = word_hash("xxmention")


class Reader:
    """Texts to words and passages."""

    def __init__(self, lexemes: Lexemes) -> None:
        self.speller = Speller(lexemes.words)

    def __call__(self, texts: list[str | None]) -> tuple[Words, Passages]:
        w = words(self.speller.batch(texts))
        w.hash[w.before == 64] = np.uint64(MENTION)
        return w, passages(w)


def worst(w: Words, n: int, linear: Linear, lex: Lexemes) -> np.ndarray:
    """The log odds of the worst passage of each of ``n`` texts, short passages (within long sentences) included."""
    out = np.full(n, -40.0)
    for longest in (PASSAGE, SHORT_PASSAGE):
        p = passages(w, longest)
        if len(p.start):
            np.maximum.at(out, p.doc, linear.logits(w, p, votes(w, p, lex)))
    return out


def votes(w: Words, p: Passages, lex: Lexemes) -> np.ndarray:
    """One bit per voter that speaks, for each passage."""
    n = len(w.hash)
    if not len(p.start):
        return np.zeros(0, np.int32)
    bits = np.zeros(n + 1, np.int32)
    bits[:n] = lex.one.get(w.hash, 0)
    if n > 1:
        bits[: n - 1] |= lex.two.get(pair_hash(w.hash[:-1], w.hash[1:]), 0)
    bits[:n][w.hash == np.uint64(MENTION)] |= _bit("you")
    edges = np.stack([p.start, p.end], 1).ravel()
    seen = np.bitwise_or.reduceat(bits, edges)[::2]
    has = lambda *names: np.logical_or.reduce([(seen & _bit(x)) != 0 for x in names])
    several = {x: np.concatenate([[0], np.cumsum((bits[:n] & _bit(x)) != 0)]) for x in WEAK}
    several = {x: c[p.end] - c[p.start] > 1 for x, c in several.items()}
    insult = np.concatenate([[0], np.cumsum((bits[:n] & (_bit("noun") | _bit("adjective"))) != 0)])
    n_insult = insult[p.end] - insult[p.start]
    out = [
        (n_insult > 0) & has("you"),
        n_insult > 1,
        has("listed"),
        has("vermin") & has("group"),
        several["exclude"],
        has("wish"),
        has("verb") & has("you", "will"),
        several["veiled"],
        has("sexual") | several["sexual2"],
        has("profane"),
        has("foreign"),
        has("mouth") & has("you", "noun"),
        has("reported"),
        has("idiom"),
    ]
    return np.bitwise_or.reduce([v.astype(np.int32) << i for i, v in enumerate(out)])


@dataclass
class Judged:
    """Passages of records that annotators judged: vote pattern, record, and annotators for minus against abuse by record."""

    pattern: np.ndarray
    record: np.ndarray
    lean: np.ndarray

    def posterior(self, q: np.ndarray) -> np.ndarray:
        """P(abusive) of each passage, given ``q`` by its text alone: a record holds abuse if one of its passages does."""
        ratio = np.exp(np.clip(self.lean * np.log((1 - ANNOTATOR_ERROR) / ANNOTATOR_ERROR), -20, 20))[self.record]
        none = np.exp(np.bincount(self.record, np.log1p(-np.clip(q, 1e-6, 1 - 1e-6)), len(self.lean)))[self.record]
        return np.minimum(q * ratio / (ratio * (1 - none) + none), 1)


@dataclass
class LabelModel:
    """P(votes | class) as a tree of voters per class, and the share of the abusive class."""

    prior: float = PRIOR
    parent: np.ndarray = field(default_factory=lambda: np.zeros((2, len(VOTERS)), int))
    table: np.ndarray = field(default_factory=lambda: np.zeros((2, len(VOTERS), 2, 2)))

    @staticmethod
    def _grid(patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None] >> np.arange(len(VOTERS))) & 1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(abusive | votes) of each pattern."""
        v = self._grid(patterns)
        score = np.zeros((2, len(v)))
        for y in (0, 1):
            for k in range(len(VOTERS)):
                score[y] += np.log(self.table[y, k, v[:, self.parent[y, k]], v[:, k]])
        odds = np.log(self.prior / (1 - self.prior)) + score[1] - score[0]
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, judged: Judged | None = None, rounds: int = 12) -> LabelModel:
        """EM from a first guess that every voter is right more often than not.

        A tree of dependences per class (Chow and Liu) is learnt anew in each
        round; the first guess stays as a prior worth GUESS_ROWS passages.
        Passages of judged records count JUDGED_ROWS each, by what the model
        and the annotators together say of them.
        """
        m = cls()
        k = len(VOTERS)
        v = cls._grid(patterns)
        against = np.array([x in AGAINST for x in VOTERS])
        sure = np.array([x in SURE for x in VOTERS])
        fires = np.stack([np.where(against, 0.02, np.where(sure, 0.0005, 0.004)), np.where(against, 0.002, 0.25)])
        weight = GUESS_ROWS * np.array([1 - PRIOR, PRIOR])
        speak = v[:, ~against].sum(1) - 2 * v[:, against].sum(1)
        guess = lambda n: np.where(n >= 2, 0.95, np.where(n == 1, 0.5, 0.003))
        q = guess(speak)
        if judged is not None:
            at, told = np.searchsorted(patterns, judged.pattern), judged.posterior(q[np.searchsorted(patterns, judged.pattern)])
        for _ in range(rounds):
            extra = np.zeros((2, len(patterns)))
            if judged is not None:
                extra = JUDGED_ROWS * np.stack([np.bincount(at, 1 - told, len(patterns)), np.bincount(at, told, len(patterns))])
            for y, share in ((0, (1 - q) * counts + extra[0]), (1, q * counts + extra[1])):
                total = share.sum() + weight[y]
                alone = (share @ v + weight[y] * fires[y]) / total
                both = (v.T @ (share[:, None] * v) + weight[y] * np.outer(fires[y], fires[y])) / total
                joint = np.empty((k, k, 2, 2))
                joint[..., 1, 1] = both
                joint[..., 1, 0] = alone[:, None] - both
                joint[..., 0, 1] = alone[None, :] - both
                joint[..., 0, 0] = 1 - alone[:, None] - alone[None, :] + both
                joint = np.clip(joint, 1e-9, 1)
                mi = (joint * np.log(joint / (joint.sum(-1, keepdims=True) * joint.sum(-2, keepdims=True)))).sum((-1, -2))
                parent = np.zeros(k, int)
                inside = {0}
                while len(inside) < k:  # the heaviest tree, grown from voter 0
                    a, b = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda e: mi[e])
                    parent[b] = a
                    inside.add(b)
                m.parent[y] = parent
                for j in range(k):
                    if j == 0:
                        m.table[y, 0] = [[1 - alone[0], alone[0]]] * 2
                    else:
                        m.table[y, j] = joint[parent[j], j] / joint[parent[j], j].sum(-1, keepdims=True)
            m.table = np.clip(m.table, 1e-6, 1)
            m.prior = float(np.clip((q @ counts + weight[1]) / (counts.sum() + weight.sum()), 1e-4, 0.5))
            q = m.posterior(patterns)
            if judged is not None:
                told = judged.posterior(q[at])
        return m

    def accuracy(self, patterns: np.ndarray, counts: np.ndarray) -> list[tuple[str, float, float]]:
        """(voter, passages on which it speaks, estimated share of them on which it is right)."""
        v, q = self._grid(patterns), self.posterior(patterns)
        out = []
        for i, name in enumerate(VOTERS):
            n = float(counts[v[:, i] == 1].sum())
            right = (1 - q if name in AGAINST else q)[v[:, i] == 1] @ counts[v[:, i] == 1]
            out.append((name, n, float(right / n) if n else 0.0))
        return out


_SHIFT = np.uint64(64 - FEATURE_BITS)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features that begin at each word: the word, the pair, and the pair with one word between."""
    h = w.hash
    one = (h >> _SHIFT).astype(np.int32)
    two = (pair_hash(h[:-1], h[1:]) >> _SHIFT).astype(np.int32)
    gap = (pair_hash(h[:-2] + np.uint64(7), h[2:]) >> _SHIFT).astype(np.int32)
    return one, two, gap


@dataclass
class Linear:
    """A linear classifier of passages by hashed words, voters and vote patterns."""

    weight: np.ndarray
    voter: np.ndarray
    pattern: np.ndarray
    bias: float

    @classmethod
    def of_voters(cls, model: LabelModel) -> Linear:
        """One that says what the label model says of a passage's votes."""
        q = np.clip(model.posterior(np.arange(1 << len(VOTERS))), 1e-9, 1 - 1e-9)
        return cls(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros(len(VOTERS)), np.log(q / (1 - q)).astype(np.float32), 0.0)

    def logits(self, w: Words, p: Passages, found: np.ndarray) -> np.ndarray:
        """Log odds of each passage, from running sums of the words' weights; ``found`` are its votes."""
        out = self.bias + self.pattern[found].astype(np.float64)
        for k, v in enumerate(self.voter.tolist()):
            out += v * ((found >> k) & 1)
        for width, f in enumerate(features(w)):
            if len(f):
                sums = np.concatenate([[0.0], np.cumsum(self.weight[f], dtype=np.float64)])
                first = np.minimum(p.start, len(f))
                out += sums[np.maximum(p.end - width, first)] - sums[first]
        return out

    def of(self, x: Examples) -> np.ndarray:
        """Log odds of each passage of ``x``."""
        found = x.judged.pattern
        out = self.bias + self.pattern[found] + np.bincount(x.row, self.weight[x.col], len(found))
        for k, v in enumerate(self.voter.tolist()):
            out += v * ((found >> k) & 1)
        return out

    @classmethod
    def fit(cls, x: Examples, target: np.ndarray, steps: int = 120, l2: float = 5e-6) -> Linear:
        """Logistic regression on soft targets by Adam, over all passages of ``x`` at once."""
        found = x.judged.pattern
        words_end = 1 << FEATURE_BITS
        rows, cols = [x.row], [x.col]
        for k in range(len(VOTERS)):
            at = np.flatnonzero((found >> k) & 1)
            rows.append(at)
            cols.append(np.full(len(at), words_end + k, np.int32))
        at = np.flatnonzero(found)
        rows.append(at)
        cols.append((words_end + len(VOTERS) + found[at]).astype(np.int32))
        row, col = np.concatenate(rows), np.concatenate(cols)
        used, col = np.unique(col, return_inverse=True)
        w, bias = np.zeros(len(used)), -2.0
        m1, m2, b1, b2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(row, w[col], len(found)) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(found)
            grad, gb = np.bincount(col, g[row], len(used)) + l2 * w, g.sum()
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb**2
            fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
            w -= 0.15 * fix * m1 / (np.sqrt(m2) + 1e-8)
            bias -= 0.15 * fix * b1 / (np.sqrt(b2) + 1e-8)
        full = np.zeros(words_end + len(VOTERS) + (1 << len(VOTERS)), np.float32)
        full[used] = w
        return cls(full[:words_end], full[words_end : words_end + len(VOTERS)], full[words_end + len(VOTERS) :], float(bias))


@dataclass
class Examples:
    """Passages with their hashed features (``col`` of the words that begin at ``row``), vote patterns and records."""

    row: np.ndarray
    col: np.ndarray
    judged: Judged


def read_examples(texts: list[str | None], lex: Lexemes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each passage, its votes, passage of each feature, feature) of a batch of texts."""
    w, p = Reader(lex)(texts)
    rows, cols = [], []
    for width, f in enumerate(features(w)):
        n = np.maximum(p.end - width - p.start, 0)
        rows.append(np.repeat(np.arange(len(n)), n))
        cols.append(f[np.repeat(p.start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    return p.doc, votes(w, p, lex), np.concatenate(rows), np.concatenate(cols)


def train(x: Examples, model: LabelModel, rounds: int = 3) -> Linear:
    """A classifier of passages on posterior labels.

    Which passage of an abusive record is the abusive one is told by the label
    model first and by the classifier of the round before after that.
    """
    found = x.judged.pattern
    if not len(found):
        return Linear.of_voters(model)
    kinds, back = np.unique(found, return_inverse=True)
    q0 = model.posterior(kinds)[back]
    prior = np.log(np.clip(q0, 1e-3, 0.999) / (1 - np.clip(q0, 1e-3, 0.999)))
    q, linear = q0, None
    for _ in range(rounds):
        if linear is not None:
            q = 1 / (1 + np.exp(-np.clip(0.7 * linear.of(x) + 0.3 * prior, -30, 30)))
        linear = Linear.fit(x, x.judged.posterior(q))
    return linear


def evidence(records: DataFrame, judgements: DataFrame, lex: Lexemes) -> Examples:
    """The judged records' passages as hashed features: at most MAX_JUDGED records, taken by hash; no text leaves the executors."""
    keys = ["record_table", "record_id"]
    said = judgements.filter("abusive IS NOT NULL").groupBy(*keys).agg(
        F.countDistinct(F.when(F.col("abusive") == 1, F.col("annotator"))).alias("n_for"), F.countDistinct(F.when(F.col("abusive") == 0, F.col("annotator"))).alias("n_against")
    )
    # At most MAX_JUDGED keys, so they may be broadcast.
    said = said.select(*keys, (F.col("n_for") - F.col("n_against")).cast("long").alias("lean")).orderBy(F.xxhash64(*keys), *keys).limit(MAX_JUDGED)
    judged = records.join(F.broadcast(said), keys).groupBy(*keys).agg(F.max("text").alias("text"), F.max("lean").alias("lean")).filter("text IS NOT NULL")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in slices(b.column(2)):
                doc, found, row, col = read_examples(texts, lex)
                size = np.bincount(row, minlength=len(doc))
                col = col[np.argsort(row, kind="stable")]
                feature = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(col.astype(np.int32)))
                at = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array(found.astype(np.int32)), feature], [*keys, "lean", "pattern", "features"])

    rows = judged.select(*keys, "text", "lean").mapInArrow(read, "record_table string, record_id string, lean long, pattern int, features array<int>").toArrow()
    name = [f"{a}\x01{b}" for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)]
    names, record = np.unique(np.array(name, dtype=str), return_inverse=True)
    lean = np.zeros(len(names))
    lean[record] = rows.column(2).to_numpy()
    lists = rows.column(4).combine_chunks()
    size = lists.value_lengths().to_numpy() if len(rows) else np.zeros(0, np.int64)
    # In an order of their own, so that the fit does not hang on tasks.
    col = lists.flatten().to_numpy() if len(rows) else np.zeros(0, np.int32)
    order = np.lexsort((np.arange(len(record)), record)) if len(rows) else np.zeros(0, np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Examples(place[np.repeat(np.arange(len(size)), size)], col, Judged(rows.column(3).to_numpy()[order], record[order], lean))


def fit(records: DataFrame, judgements: DataFrame, terms: list[str]) -> tuple[Linear, Lexemes, LabelModel, tuple[np.ndarray, np.ndarray]]:
    """Classifier, lexemes, label model and vote patterns.

    ``records``: (record_table, record_id, text); ``judgements``: (record_table,
    record_id, annotator, abusive).  Vote patterns are counted over all passages of all records.
    """
    lex = Lexemes(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(lex)
        total = np.zeros(1 << len(VOTERS), np.int64)
        for b in batches:
            for _, texts in slices(b.column(0)):
                w, p = read(texts)
                total += np.bincount(votes(w, p, lex), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    rows = records.select("text").mapInArrow(count, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    x = evidence(records, judgements, lex)
    seen = {int(p): 0 for p in x.judged.pattern} | {r.pattern: r.n for r in rows}
    patterns = np.array(sorted(seen), np.int64)
    counts = np.array([seen[p] for p in patterns.tolist()], float)
    model = LabelModel.fit(patterns, counts, x.judged if len(x.judged.pattern) else None)
    return train(x, model), lex, model, (patterns, counts)


def score(records: DataFrame, linear: Linear, lex: Lexemes) -> DataFrame:
    """(record_table, record_id, score): the chance that the worst passage of each row is abusive."""
    shared = records.sparkSession.sparkContext.broadcast((linear.weight, linear.voter, linear.pattern, linear.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, one = Reader(lex), Linear(*shared.value)
        for b in batches:
            out = np.full(b.num_rows, -40.0)
            for i, texts in slices(b.column(2)):
                w, _ = read(texts)
                out[i : i + len(texts)] = worst(w, len(texts), one, lex)
            prob = np.where(out <= -40.0, 0.0, 1 / (1 + np.exp(-np.clip(out, -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prob)], ["record_table", "record_id", "score"])

    return records.select("record_table", "record_id", "text").mapInArrow(run, "record_table string, record_id string, score double")


def heldout(records: DataFrame, judgements: DataFrame, terms: list[str], parts: int = 5) -> DataFrame:
    """(n_records, n_abusive, n_found, precision, recall) on a fifth of the judged records that take no part in fitting.

    A record is abusive where most annotators say so; records with as many for
    as against are left out.
    """
    keys = ["record_table", "record_id"]
    own = F.pmod(F.xxhash64(F.lit("heldout"), *keys), F.lit(parts)) == 0
    linear, lex, _, _ = fit(records, judgements.filter(~own), terms)
    lean = F.sum(F.when(F.col("abusive") == 1, 1).when(F.col("abusive") == 0, -1).otherwise(0))
    truth = judgements.filter(own).distinct().groupBy(*keys).agg(lean.alias("lean")).filter("lean <> 0")
    rows = records.join(truth, keys).select(*keys, "text", "lean")
    got = score(rows, linear, lex).groupBy(*keys).agg((F.max("score") >= THRESHOLD).alias("found")).join(truth, keys)
    both, n = F.count_if(F.col("found") & (F.col("lean") > 0)), F.count_if("found")
    abusive = F.count_if(F.col("lean") > 0)
    return got.agg(F.count(F.lit(1)).alias("n_records"), abusive.alias("n_abusive"), n.alias("n_found"), F.round(F.try_divide(both, n), 6).alias("precision"), F.round(F.try_divide(both, abusive), 6).alias("recall"))
