"""Toxicity scores of texts that may hide words: a noisy channel is undone first, then the restored text is scored.

Restoring. A token is what a channel made of a word: letters became look-alikes (leetspeak), separators were put in, a
letter was repeated, or the letters were spaced out. Its lattice holds, for each character, the letters that it could
stand for and, for separators and repetitions, nothing at all; Viterbi decoding under a character bigram model finds the
likeliest word. The model's counts are gathered over all texts of the table. Tokens of plain letters without runs of
three are taken as they are. Distinct tokens are decoded together, as vectors.

Scoring. Features of a restored word are itself and its prefixes, and the same of its collapsed form, which holds one
letter of each run of equal ones: whichever letters were doubled, and whether the word has double letters of its own or
not, the collapsed form stays the same. Words have no certain borders where a text is spaced out or cut: a run of single
characters, with any white space between them, is decoded as one, and learnt words are sought at every place within; so
they are in what neighbouring tokens spell together exactly. Such a find counts with the word's log odds against texts
in which it occurs in any of these ways. Those that mark toxic texts are learnt from a bounded
sample of labelled rows: they must occur in at least LEAST_DOCS toxic texts, behind many different words (so that what
copies of one text share doesn't count), with log odds of at least LEAST_ODDS against texts that aren't toxic. The score
is a logistic function of the sum, over the text's distinct words, of each word's strongest log odds; its slope and
offset are fitted on the same sample.

Defined results: a null text counts as empty, and an empty text has no evidence. Labels that are null don't count; rows
that repeat an id share its label, of conflicting labels the higher one. Without labels of both kinds all scores are the
smoothed prior. A null id is not held out. Extra columns are ignored; only text is an input of a score.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import as_rows, claim, map_arrow, of_rows, slices, stage, store, table

#: Bounds of the labelled sample, toxic and not; rows are taken in the order of a hash of their id.
TRAIN_TOXIC, TRAIN_OTHER = 4_000, 8_000
LEAST_DOCS, LEAST_ODDS = 3, 3.0
PREFIXES = (4, 5, 6, 7)
#: Longer words aren't sought in what several tokens spell.
LONGEST = 40
FOLDS = 5
#: Bytes of tokens that a worker keeps, about, and cells (character, state) that are decoded at a time.
KEPT_BYTES, ENTRY_BYTES = 64 << 20, 170
CELLS = 4 << 20
SLICE_BYTES = 4 << 20

# Letters that a character is used for, besides itself.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
EDGES = ".,;:?\"'()[]{}<>#%&*~^=`_-/\\…«»“”’"
#: Log probabilities of the channel.
AS_IS, LOOKS, DROPPED, REPEATED, RUN = math.log(0.9), math.log(0.3), math.log(0.5), math.log(0.2), math.log(0.9)
#: A look-alike that stands for nothing; a run of three or more of it is dropped as easily as a separator.
NOTHING = math.log(0.0005)

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
CLASSES = len(LETTERS) + 2  # 0: outside a word; last: any other letter
TRIPLE = re.compile(r"(.)\1\1")
DOUBLE = re.compile(r"(.)\1+")
TWO, FOUR = re.compile(b"\1{2,}"), re.compile(b"\1{4,}")


@functools.cache
def _classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if chr(c).isalpha() if c < 0x3000 else False:
            out[c] = CLASSES - 1
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i + 1
        if len(c.upper()) == 1:
            out[ord(c.upper())] = i + 1
    return out


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probabilities [previous class, class] over all texts; 0 stands for whatever is outside words."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    size = CLASSES * CLASSES

    def run(batches):
        claim()
        kinds, total = _classes(), np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                text = "\n".join(x for x in part.column("text").to_pylist() if x)
                at = kinds[np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
                total += np.bincount(at[:-1] * CLASSES + at[1:], minlength=size)
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    counts = np.zeros(size)
    for row in map_arrow(rows, run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most size rows
        counts[row["at"]] = row.n
    counts = counts.reshape(CLASSES, CLASSES) + 0.5
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Restorer:
    """token -> likeliest word."""

    def __init__(self, model: np.ndarray):
        self.model = model
        self.of = {c: i + 1 for i, c in enumerate(LETTERS)}

    def options(self, token: str) -> list[list[tuple[int, float]]]:
        """For each character (class, log p); class -1: nothing."""
        out = []
        for i, c in enumerate(token):
            mine: list[tuple[int, float]] = []
            if c in self.of:
                mine.append((self.of[c], AS_IS))
                if i and token[i - 1] == c:
                    mine.append((-1, RUN if token[max(0, i - 2) : i + 2].count(c) > 2 else REPEATED))
            else:
                mine += [(self.of[x], LOOKS) for x in LOOK_ALIKES.get(c, "")]
                if c.isalpha():
                    mine.append((CLASSES - 1, AS_IS))
                else:
                    alone = c in LOOK_ALIKES and c * 3 not in token[max(0, i - 2) : i + 3]
                    mine.append((-1, NOTHING if alone else DROPPED))
            out.append(mine)
        return out

    def restore(self, tokens: list[str]) -> list[str]:
        out = [""] * len(tokens)
        by: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            by.setdefault(-(-len(t) // 4), []).append(i)
        for width, group in by.items():
            most = max(1, CELLS // (4 * width * CLASSES))
            for a in range(0, len(group), most):
                for i, word in zip(group[a : a + most], self._decode([tokens[i] for i in group[a : a + most]]), strict=True):
                    out[i] = word
        return out

    def _decode(self, tokens: list[str]) -> list[str]:
        n, width = len(tokens), max(map(len, tokens))
        lattice = [self.options(t) for t in tokens]
        ways = max((len(o) for x in lattice for o in x), default=1)
        kind = np.full((width, n, ways), -2, np.int8)
        cost = np.full((width, n, ways), -np.inf)
        for l, x in enumerate(lattice):
            for i, o in enumerate(x):
                for w, (c, p) in enumerate(o):
                    kind[i, l, w], cost[i, l, w] = c, p
        score = np.full((n, CLASSES), -np.inf)
        score[:, 0] = 0.0
        back = np.zeros((width, n, CLASSES), np.int8)  # class before, or -1: the same state, nothing written
        lane = np.arange(n)
        for i in range(width):
            new = np.full_like(score, -np.inf)
            step = np.full((n, CLASSES), -1, np.int8)
            for w in range(ways):
                nothing = np.nonzero(kind[i, :, w] == -1)[0]
                if len(nothing):
                    got = score[nothing] + cost[i, nothing, w][:, None]
                    better = got > new[nothing]
                    new[nothing] = np.where(better, got, new[nothing])
                    step[nothing] = np.where(better, -1, step[nothing])
                letter = np.nonzero(kind[i, :, w] >= 0)[0]
                if len(letter):
                    c = kind[i, letter, w]
                    reach = score[letter] + self.model[:, c].T
                    p = reach.argmax(axis=1)
                    got = reach[np.arange(len(letter)), p] + cost[i, letter, w]
                    better = got > new[letter, c]
                    new[letter, c] = np.where(better, got, new[letter, c])
                    step[letter, c] = np.where(better, p, step[letter, c])
            done = kind[i, :, 0] == -2
            new[done] = score[done]
            step[done] = -1
            score, back[i] = new, step
        state = (score + self.model[:, 0]).argmax(axis=1)
        words: list[list[str]] = [[] for _ in range(n)]
        for i in range(width - 1, -1, -1):
            before = back[i, lane, state]
            for l in np.nonzero(before >= 0)[0]:
                c = state[l]
                words[l].append(LETTERS[c - 1] if c < CLASSES - 1 else "·")
            state = np.where(before >= 0, before, state)
        return ["".join(reversed(w)) for w in words]


def runs_of(flags: bytes, least: re.Pattern) -> Iterable[tuple[int, int]]:
    """Spans of ones."""
    return (m.span() for m in least.finditer(flags)) if b"\1\1" in flags else ()


def spaced_out(tokens: list[str]) -> list[str]:
    """What four or more single characters spell that follow each other, whatever white space parts them."""
    flags = bytes(map((1).__eq__, map(len, tokens)))
    return ["".join(tokens[a:b]) for a, b in runs_of(flags, FOUR)]


def plain(token: str) -> str | None:
    """The word, where the token is plain letters; features() undoes doubled ones."""
    word = token.strip(EDGES)
    if word.isalpha() and not TRIPLE.search(word):
        return word
    word = word.rstrip("!")
    return word if not word or word.isalpha() and not TRIPLE.search(word) else None


def once(word: str) -> str:
    """The collapsed form."""
    return DOUBLE.sub(r"\1", word)


def features(word: str) -> list[str]:
    if len(word) < 3:
        return []
    forms = dict.fromkeys((word, once(word)))
    return list(dict.fromkeys(f for w in forms for f in (w, *(f"{w[:n]}+" for n in PREFIXES if len(w) > n))))


class Words(dict):
    """token -> restored word; emptied when it holds about ``kept`` bytes."""

    def __init__(self, model: np.ndarray, kept: int = KEPT_BYTES):
        self.restorer, self.kept, self.held = Restorer(model), kept, 0

    def missing(self, tokens: Iterable[str]) -> list[str]:
        """Tokens that aren't known yet; all of them if there is no room."""
        new = [t for t in tokens if t not in self]
        more = sum(map(len, new)) + ENTRY_BYTES * len(new)
        if self.held + more > self.kept and self.held:
            self.forget()
            new = list(tokens)
            more = sum(map(len, new)) + ENTRY_BYTES * len(new)
        self.held += more
        return new

    def forget(self) -> None:
        self.clear()
        self.held = 0

    def restored(self, tokens: Iterable[str]) -> list[tuple[str, str]]:
        words = [(t, plain(t)) for t in tokens]
        hard = [t for t, w in words if w is None]
        return [(t, w) for t, w in words if w is not None] + list(zip(hard, self.restorer.restore(hard), strict=True))

    def learn(self, tokens: Iterable[str]) -> None:
        self.update(self.restored(self.missing(tokens)))


def tokens_of(text: str | None) -> list[str]:
    tokens = (text or "").lower().split()
    return [*tokens, *spaced_out(tokens)]


class Joined:
    """Learnt words in what tokens spell together, whatever their borders; finds are named by their collapsed form.

    A key of ``weights`` with a blank in front holds the log odds of such finds where they differ from the word's.
    """

    def __init__(self, weights: dict[str, float]):
        words = {f: weights.get(f" {once(f)}", w) for f, w in weights.items() if 3 <= len(f) <= LONGEST and f[0] != " " and f[-1] != "+"}
        self.words = {f for f, w in words.items() if w}
        self.weights: dict[str, float] = {}
        for f in self.words:
            self.weights[once(f)] = max(words[f], self.weights.get(once(f), 0.0))
        self.lengths = sorted({len(w) for w in self.words}, reverse=True)
        self.heads = {w[:n] for w in self.words for n in range(1, len(w))}
        self.bits = {once(w[a:b]) for w in self.words for a in range(len(w)) for b in range(a + 1, len(w) + 1)}

    def within(self, word: str) -> set[str]:
        """Finds in a run of letters; at each place the longest, and none within another."""
        found = set()
        for form in {word, once(word)}:
            end = 0
            for a in range(len(form)):
                n = next((n for n in self.lengths if form[a : a + n] in self.words), 0)
                if n and a + n > end:
                    found.add(once(form[a : a + n]))
                    end = a + n
        return found

    def across(self, words: list[str | None]) -> set[str]:
        """Finds that two or more neighbours spell; null where a token is no part of any."""
        found = set()
        for i, word in enumerate(words):
            if not word:
                continue
            j = i + 1
            while j < len(words) and words[j] and (word in self.heads or once(word) in self.heads):
                word += words[j]
                j += 1
                if word in self.words or once(word) in self.words:
                    found.add(once(word))
        return found


def learn(train: DataFrame, model: np.ndarray, text_col: str = "text", label_col: str = "toxic") -> tuple[dict[str, float], tuple[float, float]]:
    """(feature -> log odds, (offset, slope)) from a bounded table of labelled texts."""
    n = {r[0]: r[1] for r in train.groupBy(label_col).count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    prior = math.log((toxic + 0.5) / (other + 0.5)) if toxic and other else -math.log(9)
    if not toxic or not other:
        return {}, (prior, 1.0)

    def restored(batches, emit):
        claim()
        words = Words(model)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                lists = [tokens_of(t) for t in part.column("text").to_pylist()]
                words.learn(set().union(*lists))
                yield emit(words, lists)

    def contexts(words, lists):
        names, before = [], []
        for tokens in lists:
            seen = {}
            last = ""
            for t in tokens:
                word = words[t]
                if word not in seen:
                    seen[word] = last
                last = word
            first: dict[str, str] = {}
            for word, context in seen.items():
                for f in features(word):
                    first.setdefault(f, context)
            names += first.keys()
            before += first.values()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(before, pa.string())], names=["f", "c"])

    pairs = map_arrow(train.filter(F.col(label_col) == 1).select(F.col(text_col).alias("text")), lambda b: restored(b, contexts), "f string, c string")
    found = pairs.groupBy("f", "c").count().groupBy("f").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("c"))
    found = found.filter((F.col("n") >= LEAST_DOCS) & (F.col("c") >= F.greatest(F.lit(LEAST_DOCS), F.col("n") * 0.2)))
    in_toxic = {r.f: r.n for r in found.collect()}  # bounded by the sample

    def among(words, lists):
        count: dict[str, int] = {}
        for tokens in lists:
            for f in {f for w in {words[t] for t in tokens} for f in features(w)} & in_toxic.keys():
                count[f] = count.get(f, 0) + 1
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["f", "n"])

    counts = map_arrow(train.filter(F.col(label_col) == 0).select(F.col(text_col).alias("text")), lambda b: restored(b, among), "f string, n long")
    in_other = {r.f: r.n for r in counts.groupBy("f").agg(F.sum("n").alias("n")).collect()}
    odds = {f: math.log((k + 0.5) / (toxic + 1)) - math.log((in_other.get(f, 0) + 0.5) / (other + 1)) for f, k in in_toxic.items()}
    weights = {f: w for f, w in odds.items() if w >= LEAST_ODDS}

    def joined(batches):
        claim()
        scorer = Scorer(model, weights)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                names = [f for found in scorer.finds(part.column("text").to_pylist()) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["f"])

    by_chance = map_arrow(train.filter(F.col(label_col) == 0).select(F.col(text_col).alias("text")), joined, "f string")
    by_chance = {r.f: r["count"] for r in by_chance.groupBy("f").count().collect()}
    for f in [f for f in weights if once(f) in by_chance]:
        n = in_other.get(f, 0) + by_chance[once(f)]
        w = math.log((in_toxic[f] + 0.5) / (toxic + 1)) - math.log((n + 0.5) / (other + 1))
        weights[f" {once(f)}"] = max(weights.get(f" {once(f)}", 0.0), w if w >= LEAST_ODDS else 0.0)
    texts = train.select(F.col(text_col).alias("text"), F.col(label_col).cast("double").alias("label"))

    def evidence(batches):
        claim()
        scorer = Scorer(model, weights)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(scorer.evidence(part.column("text").to_pylist())), part.column("label")], names=["e", "y"])

    rows = map_arrow(texts, evidence, "e double, y double").groupBy("e", "y").count().collect()  # bounded by the sample
    return weights, logistic_fit(*(np.array([float(r[k]) for r in rows]) for k in ("e", "y", "count")))


def logistic_fit(e: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(offset, slope) of a weighted logistic regression, by damped Newton steps."""
    x = np.stack([np.ones_like(e), e], axis=1)
    w = np.zeros(2)

    def loss(w):
        z = x @ w
        return (n * (np.logaddexp(0.0, z) - y * z)).sum() + ridge * (w @ w)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (n * (p - y)) + 2 * ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 2 * ridge * np.eye(2), slope)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Scorer(Words):
    """token -> its word's strongest log odds."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], line: tuple[float, float] = (0.0, 1.0)):
        super().__init__(model)
        self.weights, self.line = weights, line
        self.joined = Joined(weights)
        self.starts = {f[:3] for f in weights if f[0] != " "}
        self.bits: dict[str, str] = {}  # tokens that could be a part of a learnt word

    def forget(self) -> None:
        super().forget()
        self.bits.clear()

    def strongest(self, word: str, form: str) -> float:
        """Log odds of a word with a collapsed form; most are told by their first letters."""
        if word[:3] in self.starts or form[:3] in self.starts:
            return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        return 0.0

    def learn(self, tokens: Iterable[str]) -> None:
        bits = self.joined.bits
        for t, word in self.restored(self.missing(tokens)):
            form = once(word) if DOUBLE.search(word) else word
            self[t] = self.strongest(word, form)
            if form in bits:
                self.bits[t] = word

    def finds(self, texts: list[str | None], lists: list[list[str]] | None = None) -> list[dict[str, float]]:
        """Of each text: learnt words that tokens spell together and that aren't tokens themselves, with log odds."""
        if lists is None:
            lists = [(t or "").lower().split() for t in texts]
            self.learn(set().union(*lists))
        runs = [list(dict.fromkeys(spaced_out(t))) for t in lists]
        spelt = dict(self.restored(set().union(*runs)))
        bits, odds, out = self.bits, self.joined.weights, []
        for tokens, mine in zip(lists, runs, strict=True):
            found = {}
            for a, b in runs_of(bytes(map(bits.__contains__, tokens)), TWO):
                found.update((f, odds[f]) for f in self.joined.across([bits[t] for t in tokens[a:b]]))
            for r in mine:
                within = self.joined.within(spelt[r])
                found.update((f, max(odds[f], found.get(f, 0.0))) for f in within)
                whole = max((self.weights.get(f, 0.0) for f in features(spelt[r])), default=0.0)
                if whole:
                    name = next((f for f in within if once(spelt[r]).startswith(f)), once(spelt[r]))
                    found[name] = max(whole, found.get(name, 0.0))
            out.append({f: w for f, w in found.items() if f not in tokens} if found else found)
        return out

    def evidence(self, texts: list[str | None]) -> list[float]:
        lists = [(t or "").lower().split() for t in texts]
        sets = [set(x) for x in lists]
        self.learn(set().union(*sets))
        get = self.__getitem__
        return [float(sum(sorted([*filter(None, map(get, s)), *f.values()]))) for s, f in zip(sets, self.finds(texts, lists), strict=True)]

    def scores(self, texts: list[str | None]) -> list[float]:
        offset, slope = self.line
        return [1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, offset + slope * e)))) for e in self.evidence(texts)]


def score(docs: DataFrame, model: np.ndarray, weights: dict[str, float], line: tuple[float, float], text_col: str = "text") -> DataFrame:
    """(row, score): the rows of ``docs`` as structs, whatever their columns are called."""
    rows = as_rows(docs, text_col)
    fit = uuid.uuid4().hex  # a worker keeps its tokens from task to task

    def run(batches):
        scorer = store(("toxicity", fit), lambda: Scorer(model, weights, line))
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                got = scorer.scores(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(got, pa.float64())], names=["row", "score"])

    return map_arrow(rows, run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def fold(id_col) -> F.Column:
    """crc32 of the id as text, mod FOLDS; -1 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(-1))


def sample_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """A bounded sample (id, label) outside the held-out fold, in the order of a hash of the id."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 0))
    known = known.groupBy(id_col).agg(F.max(label_col).alias(label_col))
    parts = [known.filter(F.col(label_col) == v).orderBy(F.xxhash64(id_col), id_col).limit(n) for v, n in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER))]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(language model, feature weights, (offset, slope))."""
    model = language_model(docs, text_col)
    sample = F.broadcast(sample_labels(labels, id_col, label_col))  # at most TRAIN_TOXIC + TRAIN_OTHER rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = stage(texts.join(sample, texts["id"] == sample[id_col]).select("text", F.col(label_col).alias("label")), "toxicity-train")
    return model, *learn(train, model, "text", "label")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per row: id, held_out, score, predicted."""
    model, weights, line = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model, weights, line)
    found = F.col("row").getField("id")
    return scored.select(found.alias(id_col), (fold(found) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with their columns."""
    model, weights, line = fit(docs, labels, id_col, text_col, label_col)
    return of_rows(score(docs, model, weights, line, text_col).filter("score < 0.5"), docs.columns)


def query(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
