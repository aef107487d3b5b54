"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon transducer turns words into classes (insult, threat, target,
negation, report, quote, other); its insults, whole words or stems with any
ending, and the weight on their arcs are learned from labels, the functional
classes are short fixed lists.  Three small transducers rewrite the classes of
a clause and are composed into one grammar:

* negation: an insult within three words after a negation is denied, or the
  negation's scope has ended before it, at a cost that falls with distance;
* reported speech: what follows a report word, or stands between quotes, is told;
* target: an insult or threat with a target up to four words before it, or
  (a promise that must be kept) after it, is an address.

Several paths fit a clause; the heaviest decides what is matched.  A last
acceptor reads the document's distinct clauses: it stays outside, enters once
(at the cost of the log of the number of clauses), adds the clauses it passes,
each word inside costing what toxic texts hold more matches a word than clean
ones, and leaves.  So one grave clause decides a text of any length, weak
matches count where they stand close together, and a repeated line counts once.

Weights are log ratios of rates.  A form's is that of its occurrences a word in
toxic against clean texts (distinct pairs with the word before it).  A
pattern's is the maximum a posteriori of a logistic regression with a normal
prior: below 0 for denied and told insults, above 0 for addresses, so what
labels show little of keeps its prior's sign.  The score is the logistic of the
labels' log odds and the heaviest path; where nothing matches, the log odds of
texts without a match.

Learned only from labelled rows outside the held-out fold, from at most
``ROWS`` texts of each label and ``SAMPLE_BYTES`` in all, those of least id
hash.  A form is learned where its texts' labels would hardly come about by
chance (the chance that any form is learned so is at most ``ERROR``, and again
for stems), with ``SUPPORT`` toxic texts and as many different words before it,
so that copies of a text teach nothing, and ``RATIO`` times the rate in clean
texts.  Words of a stem that are no rarer in clean texts are its exceptions;
one half of the clean texts names them, the other tests the stem.

Edge cases: null and empty texts score as texts without a match; documents
without a label are scored all the same; without both labels to learn from,
the lexicon is empty and all score the prior; null ids are scored, never
learned from; repeated rows get equal scores; two clauses or paths of equal
weight give the same score whichever is taken; very long texts are scored
whole, clause by clause; other columns, whatever their names, are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, fold, held_out, in_front, read

ROWS, SAMPLE_BYTES, SUPPORT, STEM = 2500, 32 << 20, 6, 4
#: Chance of one learned word (stem) or more where labels say nothing; least ratio of a form's rates.
ERROR, RATIO = 0.05, 10
FOLDS, HELD_OUT = 5, 0
#: Words that a negation and a target reach, and what it costs to end a negation's scope before the first, second, third word.
DENIES, NEAR = 3, 4
ENDS = (-8.0, -6.0, -3.0)
#: Mean of each pattern's prior; all have a variance of 1.
PRIORS = {
    "insult": 0.0, "insult+target": 1.0, "denied": -5.0, "denied+target": -4.5, "told": -4.0, "told+target": -3.5, "threat": -1.0, "threat+target": 1.0,
}
PATTERNS = tuple(PRIORS)

# Function words of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours yourself he him she her they them du dich dir dein deine ihr euch sie tu te toi vous tes ton tú usted ustedes vosotros eres ellos".split()
NEGATIONS = "not no never isn't aren't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say told wrote quoted claimed reported sagte sagt schrieb dit disait écrit déclaré dijo dice escribió".split()
THREATS = "kill murder hurt beat burn destroy stab shoot töten umbringen schlagen tuer frapper brûler matar golpear quemar".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”«»„]")
CLAUSE = re.compile(r"[.!?;:\n]+")
I, H, T, N, R, Q, X = CLASSES = ("insult", "threat", "target", "negation", "report", "quote", "other")


class Transducer:
    """States, arcs {(state, input): [(output, weight, state)]}; state 0 starts, ``finals`` end (None: all)."""

    def __init__(self, finals: set[int] | None = None):
        self.arcs: dict[tuple[int, str], list[tuple[str, float, int]]] = defaultdict(list)
        self.finals = finals

    def arc(self, a: int, x: str, y: str, b: int, weight: float = 0.0) -> None:
        self.arcs[a, x].append((y, weight, b))

    def ends(self, state: int) -> bool:
        return self.finals is None or state in self.finals

    def compose(self, then: Transducer) -> Transducer:
        """First this one, then the other on its output; only states that can be reached."""
        out, number, todo = Transducer(set()), {(0, 0): 0}, [(0, 0)]
        labels = sorted({x for _, x in self.arcs})
        while todo:
            a, b = pair = todo.pop()
            if self.ends(a) and then.ends(b):
                out.finals.add(number[pair])
            for x in labels:
                for y, w1, a2 in self.arcs.get((a, x), ()):
                    for z, w2, b2 in then.arcs.get((b, y), ()):
                        if (a2, b2) not in number:
                            number[a2, b2] = len(number)
                            todo.append((a2, b2))
                        out.arc(number[pair], x, z, number[a2, b2], w1 + w2)
        return out

    def best(self, labels: list[str], weights: list[float] | None = None) -> tuple[float, list[str]]:
        """The heaviest path and its output; weights are those of the arcs that gave the labels."""
        now: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
        for k, x in enumerate(labels):
            after: dict[int, tuple[float, tuple]] = {}
            for a, (w, path) in now.items():
                for y, v, b in self.arcs.get((a, x), ()):
                    if b not in after or w + v > after[b][0]:
                        after[b] = (w + v, (path, y))
            v = weights[k] if weights else 0.0
            now = {b: (w + v, path) for b, (w, path) in after.items()} if v else after
        now = {b: v for b, v in now.items() if self.ends(b)}
        if not now:
            return -math.inf, []
        w, path = max(now.values(), key=lambda v: v[0])
        out = []
        while path:
            path, y = path
            out.append(y)
        return w, out[::-1]


def negation() -> Transducer:
    g = Transducer()
    for left in range(DENIES + 1):  # words that the negation still reaches
        for c in CLASSES:
            to = DENIES if c == N else max(0, left - 1)
            if c == I and left:
                g.arc(left, c, "denied", to)
                g.arc(left, c, c, 0, ENDS[DENIES - left])
            else:
                g.arc(left, c, c, to)
    return g


def reporting() -> Transducer:
    g = Transducer()
    for state in range(3):  # 0 none, 1 after a report word, 2 between quotes
        for c in (*CLASSES, "denied"):
            to = 0 if c == Q and state == 2 else 2 if c == Q else 1 if c == R and not state else state
            g.arc(state, c, "told" if state and c in (I, "denied") else c, to)
    return g


def targeting(weights: dict[str, float]) -> Transducer:
    """States hold how many words the last target and the promise of one still reach; kept promises end."""
    at = lambda near, owed: near * (NEAR + 1) + owed
    g = Transducer({at(near, 0) for near in range(NEAR + 1)})
    for near in range(NEAR + 1):
        for owed in range(NEAR + 1):
            for c in (*CLASSES, "denied", "told"):
                if c == T:
                    g.arc(at(near, owed), c, c, at(NEAR, 0))
                    continue
                if owed == 1:
                    continue  # the promise can't be kept any more
                to = max(0, near - 1), max(0, owed - 1)
                if c in (I, H, "denied", "told"):
                    plain = "threat" if c == H else c
                    if near:
                        g.arc(at(near, owed), c, f"{plain}+target", at(*to), weights[f"{plain}+target"])
                    else:
                        g.arc(at(near, owed), c, plain, at(*to), weights[plain])
                        g.arc(at(near, owed), c, f"{plain}+target", at(to[0], owed - 1 if owed else NEAR), weights[f"{plain}+target"])
                else:
                    g.arc(at(near, owed), c, c, at(*to))
    return g


def surprise(n: int, k: int, p: float) -> float:
    """Of n toxic texts in n + k, where p of all texts are toxic: minus the log of a bound on the chance of as many or more (Chernoff)."""
    share = n / (n + k)
    if share <= p:
        return 0.0
    return n * math.log(share / p) + (k * math.log((1 - share) / (1 - p)) if k else 0.0)


class Counts:
    """Of one label's texts: the distinct pairs of a word and the one before it in each text, as numbers of a shared vocabulary."""

    CHUNK = 256

    def __init__(self, texts: list[str], vocabulary: dict[str, int]):
        self.texts = [self._pairs(t, vocabulary) for t in texts]

    @staticmethod
    def _pairs(text: str, vocabulary: dict[str, int]) -> np.ndarray:
        word = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in WORD.findall(text.lower())], np.int64)
        return np.unique((np.concatenate([[0], word[:-1]]) << 32) | word) if len(word) else word

    @property
    def size(self) -> int:
        return len(self.texts)

    @property
    def pairs(self) -> int:
        return sum(map(len, self.texts))

    def half(self, which: int) -> Counts:
        out = Counts([], {})
        out.texts = self.texts[which::2]
        return out

    def of(self, forms: Forms, before: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """How many pairs hold each form, and how many texts; before: at most as many as there are different words before it."""
        pairs, docs, seen = np.zeros(forms.n, np.int64), np.zeros(forms.n, np.int64), []
        for lo in range(0, len(self.texts), self.CHUNK):
            part = self.texts[lo : lo + self.CHUNK]
            code = np.concatenate(part)
            row, f = forms.expand(code & 0xFFFFFFFF)
            pairs += np.bincount(f, minlength=forms.n)
            text = np.repeat(np.arange(len(part)), [len(x) for x in part])[row]
            docs += np.bincount(np.unique(text * forms.n + f) % forms.n, minlength=forms.n)
            if before:
                seen = [np.unique(np.concatenate([*seen, (code[row] >> 32) * forms.n + f]))]
        if before and seen:
            docs = np.minimum(docs, np.bincount(seen[0] % forms.n, minlength=forms.n))
        return pairs, docs


class Forms:
    """The forms (words or stems) of each word of the vocabulary, by number."""

    def __init__(self, names: list[str], word: np.ndarray, form: np.ndarray, words: int):
        order = np.lexsort((form, word))
        self.names, self.n, self.form = names, max(1, len(names)), form[order]
        self.at = np.searchsorted(word[order], np.arange(words + 1))

    @classmethod
    def of_words(cls, vocabulary: list[str]) -> Forms:
        each = np.arange(len(vocabulary))
        return cls(vocabulary, each, each, len(vocabulary))

    @classmethod
    def of_stems(cls, vocabulary: list[str], docs: np.ndarray, skip: np.ndarray) -> Forms:
        """Stems whose words' texts (docs, by word) add up to SUPPORT at least; words to skip have none."""
        names, words, forms = [], [], []
        some = [(k, vocabulary[k]) for k in np.flatnonzero(~skip).tolist()]
        for length in range(STEM, max((len(w) for _, w in some), default=0)):
            some = [(k, w) for k, w in some if len(w) > length]
            held = defaultdict(int)
            for k, w in some:
                held[w[:length]] += int(docs[k])
            number = {f: len(names) + i for i, f in enumerate(sorted(f for f, n in held.items() if n >= SUPPORT))}
            names += number
            some = [(k, w) for k, w in some if w[:length] in number]  # a longer stem holds no more texts
            words += [k for k, _ in some]
            forms += [number[w[:length]] for _, w in some]
        return cls(names, np.array(words, np.int64), np.array(forms, np.int64), len(vocabulary))

    def expand(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in word, form) of all forms of the words."""
        n = self.at[word + 1] - self.at[word]
        row = np.repeat(np.arange(len(word)), n)
        return row, self.form[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.at[word][row]]


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in range(STEM, len(word))]


class Model:
    """Lexicon, composed grammar, prior."""

    def __init__(self, toxic: list[str], clean: list[str], prior: float):
        self.words: dict[str, float] = {}
        self.stems: dict[str, float] = {}
        self.ordinary: set[str] = set()  # exceptions of the stems
        self.prior = self.unmatched = prior
        self.a_word = 0.0  # what a word inside the acceptor's span costs
        self.functional = {w: c for c, ws in ((T, TARGETS), (N, NEGATIONS), (R, REPORTS), (H, THREATS)) for w in ws} | dict.fromkeys("\"“”«»„", Q)
        self.weights = dict(PRIORS)
        if toxic and clean:
            vocabulary = {"": 0}
            counts = Counts(toxic, vocabulary), Counts(clean, vocabulary)
            self._learn(*counts, list(vocabulary))
        self._compile()
        if toxic and clean:
            self._weigh(toxic, clean)
            self._compile()

    def _compile(self) -> None:
        self.grammar = negation().compose(reporting()).compose(targeting(self.weights))
        self.pattern = "|".join(re.escape(w) for w in sorted({*self.words, *self.stems, *THREATS}))
        self.finder = re.compile(self.pattern)

    def _learn(self, toxic: Counts, clean: Counts, vocabulary: list[str]) -> None:
        def rate(pairs, c: Counts):
            return (pairs + 0.5) / (c.pairs + 1)

        def learned(forms: Forms, clean: Counts) -> dict[str, tuple[float, float]]:
            """Form to (weight, surprise)."""
            n, docs = toxic.of(forms, before=True)
            k, clean_docs = clean.of(forms)
            ratio = rate(n, toxic) / rate(k, clean)
            tests = int(np.count_nonzero((n > 0) & (docs + clean_docs >= SUPPORT)))
            share = toxic.size / (toxic.size + clean.size)
            out = {}
            for f in np.flatnonzero((docs >= SUPPORT) & (ratio >= RATIO)).tolist():
                if (much := surprise(int(docs[f]), int(clean_docs[f]), share)) >= math.log(tests / ERROR):
                    out[forms.names[f]] = math.log(ratio[f]), much
            return out

        every = Forms.of_words(vocabulary)
        words = {w: v for w, (v, _) in learned(every, clean).items() if w not in self.functional}
        # exceptions are named by one half of the clean texts and stems tested on the other, so that naming them doesn't favour a stem
        naming = clean.half(0)
        (n, docs), (k, clean_docs) = toxic.of(every), naming.of(every)
        common = (clean_docs >= SUPPORT // 2) & (rate(n, toxic) <= rate(k, naming))
        common &= ~np.isin(np.arange(len(vocabulary)), [j for j, w in enumerate(vocabulary) if w in words])
        common |= np.array([w in self.functional for w in vocabulary])
        stems = learned(Forms.of_stems(vocabulary, docs, common), clean.half(1))
        held: dict[str, set] = {f: set() for f in stems}
        for j in np.flatnonzero((n > 0) & ~common).tolist():
            for f in stems_of(vocabulary[j]):
                if f in held:
                    held[f].add(vocabulary[j])
        # of nested stems the one whose labels surprise most
        for f, (v, _) in sorted(stems.items(), key=lambda x: (-x[1][1], -len(x[0]), x[0])):
            after = defaultdict(int)
            for w in held[f]:
                after[w[: len(f) + 1]] += 1
            # a stem branches: no one next letter holds almost all of its words
            if len(held[f]) >= 5 and max(after.values()) < 0.9 * len(held[f]) and not any(f.startswith(g) or g.startswith(f) for g in self.stems):
                self.stems[f] = v
        stemmed = lambda w: any(f in self.stems for f in stems_of(w))
        self.ordinary = {vocabulary[j] for j in np.flatnonzero(common).tolist() if stemmed(vocabulary[j])}
        self.words = {w: v for w, v in words.items() if not stemmed(w)}
        insult = np.array([self.classify(w)[0] == I for w in vocabulary])
        matched = [int(c.of(every)[0][insult].sum()) for c in (toxic, clean)]
        self.a_word = max(0.0, float(rate(matched[0], toxic) - rate(matched[1], clean)))

    def _weigh(self, toxic: list[str], clean: list[str]) -> None:
        """Pattern weights: for each text with a match, its patterns and what the rest of its best path weighs, against its label."""
        rows, labels, offsets, without = [], [], [], [0, 0]
        for label, texts in ((0, clean), (1, toxic)):
            for text in texts:
                weight, found = self.path(text)
                if not found:
                    without[label] += 1
                    continue
                x = [float(found.count(p)) for p in PATTERNS]
                rows.append(x)
                labels.append(label)
                offsets.append(self.prior + weight - sum(n * self.weights[p] for n, p in zip(x, PATTERNS, strict=True)))
        self.unmatched = self.prior + math.log((without[1] + 0.5) / (len(toxic) + 1)) - math.log((without[0] + 0.5) / (len(clean) + 1))
        if not rows:
            return
        x, y, o = np.array(rows), np.array(labels, float), np.array(offsets)
        mean = np.array([PRIORS[p] for p in PATTERNS])
        w = mean.copy()

        def loss(w: np.ndarray) -> float:
            z = o + x @ w
            return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * ((w - mean) ** 2).sum())

        for _ in range(50):  # Newton steps, halved until the loss falls; it is convex
            p = 1 / (1 + np.exp(-np.clip(o + x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (p - y) + w - mean)
            size = 1.0
            while size > 1e-6 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-9:
                break
        self.weights = dict(zip(PATTERNS, w.tolist(), strict=True))

    def classify(self, word: str) -> tuple[str, float]:
        """The lexicon's arc of a word: its class and weight."""
        if (c := self.functional.get(word)) is not None:
            return c, 0.0
        if (w := self.words.get(word)) is not None:
            return I, w
        if word in self.ordinary:
            return X, 0.0
        for k in range(len(word) - 1, STEM - 1, -1):
            if (w := self.stems.get(word[:k])) is not None:
                return I, w
        return X, 0.0

    def clauses(self, text: str) -> Iterator[tuple[int, float, list[str]]]:
        """(words, weight of the heaviest path, matched patterns) of each distinct clause."""
        done = set()
        for clause in CLAUSE.split(text.lower()):
            tokens = tuple(WORD.findall(clause))
            if not tokens or tokens in done:
                continue
            done.add(tokens)
            classes = [self.classify(m) for m in tokens]
            if any(c in (I, H) for c, _ in classes):
                w, out = self.grammar.best([c for c, _ in classes], [v for _, v in classes])
                yield len(tokens), w, [p for p in out if p in PRIORS]
            else:
                yield len(tokens), 0.0, []

    def path(self, text: str) -> tuple[float, list[str]]:
        """The weight of the heaviest path of the acceptor over the text's clauses, and the patterns on it."""
        best, inside, clauses = (-math.inf, []), (0.0, []), 0
        if not self.finder.search(text.lower()):
            return best
        for words, weight, found in self.clauses(text):
            clauses += 1
            if inside[0] <= 0:
                inside = (0.0, [])
            inside = (inside[0] + weight - self.a_word * words, inside[1] + found)
            if found and inside[0] > best[0]:
                best = inside
        return best[0] - math.log(max(1, clauses)), best[1]

    def score(self, text: str) -> tuple[float, str | None]:
        """Score and the patterns of the heaviest path."""
        weight, found = self.path(text)
        if not found:
            return self.logistic(self.unmatched), None
        return self.logistic(max(self.unmatched, self.prior + weight)), " ".join(found)

    @staticmethod
    def logistic(x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``rows`` labelled texts of each label outside the held-out fold, and ``most`` bytes of text."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "toxic").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    least = [known.where((F.col("toxic") == y) & in_front(F.xxhash64("doc_id"), rows, int(counts.get(y, 0)))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    # at most 2 * rows ids, so this side is small whatever the table's size
    some = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(least[0].unionAll(least[1])), "doc_id")
    texts: dict[int, list[str]] = {0: [], 1: []}
    for r in bounded(some, "toxic", rows, most // 2):
        texts[r["toxic"]].append(r["text"])
    prior = math.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))
    return Model(texts[1], texts[0], prior)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) with score, predicted and matched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        none = m.score("")[0]
        for b in batches:
            n = b.num_rows
            score, matched = np.full(n, none), [None] * n
            lower = pc.utf8_lower(b.column(1))
            maybe = pc.fill_null(pc.match_substring_regex(lower, m.pattern), False)
            at = np.flatnonzero(maybe.to_numpy(zero_copy_only=False))
            for k in at.tolist():
                score[k], matched[k] = m.score(lower[k].as_py())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(matched, pa.string())], names=["doc_id", "score", "predicted", "matched"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, matched string")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = scored(docs, learn(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", "predicted", "matched")
