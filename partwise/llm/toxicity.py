"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps each word to arcs (class, weight): insult and threat stems with weights, targets, negations, reporting words, determiners,
copulas, contrast words. Four transducers over these classes read a clause in order:

* negation: a negation opens a scope until the clause ends or a contrast word closes it; insults and threats in it are lowered;
* reported speech: after a reporting word insults and threats are lowered; before one that ends the quotation ("..., she said") they
  are, too, which the transducer guesses and must see confirmed;
* target: an insult is raised if a target governs it (a target, then only copulas, determiners, negations, further insults)
  or is called right after it; a guessed call must be confirmed;
* threat: a threat counts if its object, a target, comes right before it or after it with at most one other word between.

They are composed into one transducer (weights multiply, states are those that can be reached). A clause's weight is that of its best
path: the sum over its words of lexical weight times arc weight, in the max-plus semiring. A document's score is a logistic function,
fitted to labelled documents, of its heaviest clause, its other clauses and its length, so no word counts outside of a clause's reading.

Insult stems and their weights are learnt from labelled documents: prefixes of words, and whole short or long words, that occur in toxic
documents, counted by distinct contexts (neighbouring words), so that a group of copies counts once. The rest of the grammar is fixed.

Defined results: a null or empty text scores the grammar's floor (no match); texts are read whole; doc_id may be null or
repeated (each row gets its own score); further columns are ignored; with no labels, only the fixed stems are known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from partwise.llm.common import column, labelled_sample, slices, staged, with_columns

# The closed word classes of the grammar in English, German, French and Spanish.
TARGETS = "you your yours u ya youre yourself they them he she him her du dich dir euch ihr sie er tu te toi vous ton ta il elle ils tú ti usted ustedes vosotros él ella ellos".split()
NEGATIONS = "not never no nor isnt arent wasnt dont nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says saying wrote writes called calls quoted reported alleged claims claimed according sagte sagt schrieb nannte zitierte laut dit disait écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill murder hurt destroy beat shoot stab töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir".split()
COPULAS = "am are is was were be been being re r bist bin ist sind seid war es est sommes êtes sont était eres soy somos sois son era".split()
CONTRASTS = "but however although though aber sondern jedoch mais cependant pero sino".split()
DETERMINERS = "a an the such any so very really ein eine einen der die das un une le la les el los las una".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, DETERMINER, COPULA, CONTRAST, OTHER = CLASSES = range(9)
CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W_]+")
#: Without labels: the log odds of a text with no match, and what a text's figures add to them.
UNTAUGHT = (-2.5, 1.0, 0.1, 0.0)
#: What arcs multiply a match by.
WITH_TARGET, NEGATED, REPORTED = 1.3, 0.3, 0.5
#: Words of fewer letters than the first prefix, or more than the last one, are stems as a whole, with this mark; those of more than LONGEST by a digest.
PREFIXES, END, LONGEST = range(4, 13), "$", 64

#: state -> class -> arcs (class written, weight, next state); and the states in which a reading may end.
Arcs = dict[int, dict[int, list[tuple[int, float, int]]]]


class Transducer:
    """A weighted transducer over the classes, from state 0."""

    def __init__(self, arcs: Arcs, final: set[int]):
        self.arcs, self.final = arcs, final

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes. Only states that can be reached are kept."""
        number, open_, arcs = {(0, 0): 0}, [(0, 0)], {}
        while open_:
            s, t = pair = open_.pop()
            own = arcs[number[pair]] = {}
            for x, each in self.arcs[s].items():
                for y, w, to in each:
                    for z, v, to2 in other.arcs[t].get(y, ()):
                        if (to, to2) not in number:
                            number[to, to2] = len(number)
                            open_.append((to, to2))
                        own.setdefault(x, []).append((z, w * v, number[to, to2]))
        return Transducer(arcs, {n for (s, t), n in number.items() if s in self.final and t in other.final})

    def best(self, words: list[list[tuple[int, float]]]) -> float:
        """The weight of the best path that reads one of the arcs (class, weight) of each word; 0 if none ends in a final state."""
        at = {0: 0.0}
        for lexical in words:
            after: dict[int, float] = {}
            for state, total in at.items():
                arcs = self.arcs[state]
                for kind, w in lexical:
                    for _, v, to in arcs.get(kind, ()):
                        if (x := total + w * v) > after.get(to, -1.0):
                            after[to] = x
            at = after
        return max((x for s, x in at.items() if s in self.final), default=0.0)


def _same(state: int, **other) -> dict[int, list[tuple[int, float, int]]]:
    """Every class is written as it is read and the state kept, but for the classes named."""
    named = {globals()[k]: v for k, v in other.items()}
    return {k: named.get(k, [(k, 1.0, state)]) for k in CLASSES}


def negation() -> Transducer:
    """States: 0 outside, 1 in a negation's scope."""
    return Transducer({
        0: _same(0, NEGATION=[(NEGATION, 1.0, 1)]),
        1: _same(1, INSULT=[(INSULT, NEGATED, 1)], THREAT=[(THREAT, NEGATED, 1)], CONTRAST=[(CONTRAST, 1.0, 0)]),
    }, {0, 1})


def reported_speech() -> Transducer:
    """States: 0 nothing yet, 1 after a reporting word, 2 after a match that isn't quoted, 3 in a quotation whose reporting word must come."""
    match = lambda k: [(k, 1.0, 2), (k, REPORTED, 3)]
    return Transducer({
        0: _same(0, INSULT=match(INSULT), THREAT=match(THREAT), REPORT=[(REPORT, 1.0, 1)]),
        1: _same(1, INSULT=[(INSULT, REPORTED, 1)], THREAT=[(THREAT, REPORTED, 1)], CONTRAST=[(CONTRAST, 1.0, 0)]),
        2: _same(2, REPORT=[]),
        3: _same(3, INSULT=[(INSULT, REPORTED, 3)], THREAT=[(THREAT, REPORTED, 3)], REPORT=[(REPORT, 1.0, 1)]),
    }, {0, 1, 2})


def target() -> Transducer:
    """States: 0 no target, 1 under a target, 2 after an insult whose target is called next."""
    called = [(INSULT, 1.0, 0), (INSULT, WITH_TARGET, 2)]
    return Transducer({
        0: _same(0, TARGET=[(TARGET, 1.0, 1)], INSULT=called),
        1: _same(0, **{k: [(globals()[k], 1.0, 1)] for k in ("TARGET", "COPULA", "DETERMINER", "NEGATION")}, INSULT=[(INSULT, WITH_TARGET, 1)]),
        2: {TARGET: [(TARGET, 1.0, 1)]},
    }, {0, 1})


def threat() -> Transducer:
    """States: 0 no object, 1 right after a target, 2 after a threat whose object must come, 3 the same, one other word later."""
    waits = [(THREAT, 0.0, 0), (THREAT, 1.0, 2)]
    return Transducer({
        0: _same(0, TARGET=[(TARGET, 1.0, 1)], THREAT=waits),
        1: _same(0, TARGET=[(TARGET, 1.0, 1)], THREAT=[(THREAT, 1.0, 0)]),
        2: {TARGET: [(TARGET, 1.0, 1)], DETERMINER: [(DETERMINER, 1.0, 2)], INSULT: [(INSULT, 1.0, 3)], OTHER: [(OTHER, 1.0, 3)]},
        3: {TARGET: [(TARGET, 1.0, 1)], DETERMINER: [(DETERMINER, 1.0, 3)]},
    }, {0, 1})


#: The grammar of a clause.
CLAUSES = negation().then(reported_speech()).then(target()).then(threat())


class Grammar:
    """stems: prefix, or whole word with END, -> weight of the insult class."""

    def __init__(self, stems: dict[str, float], scale: tuple[float, ...] = UNTAUGHT, memo: int = 100_000):
        self.stems, self.scale, self.memo_size = stems, scale, memo
        self.lengths = sorted({len(s) for s in stems if not s.endswith(END)}, reverse=True)
        self.fixed: dict[str, list[tuple[int, float]]] = {}
        fixed = ((DETERMINER, DETERMINERS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (COPULA, COPULAS), (CONTRAST, CONTRASTS), (THREAT, THREATS))
        for kind, words in fixed:
            for w in words:
                self.fixed.setdefault(w, []).append((kind, 2.0 if kind == THREAT else 0.0))
        self.memo: dict[str, float] = {}

    def stem(self, word: str) -> float:
        """The weight of the whole word, else of its longest learnt prefix; 0: none."""
        if (w := self.stems.get(whole(word))) is not None:
            return w
        return next((w for n in self.lengths if n <= len(word) and (w := self.stems.get(word[:n])) is not None), 0.0)

    def lexical(self, word: str) -> list[tuple[int, float]]:
        """The lexicon's arcs for the word: an insult, or a word of another class, or any."""
        fixed = self.fixed.get(word)
        if w := self.stem(word):
            return [(INSULT, w), *(fixed or ())]
        return fixed or [(OTHER, 0.0)]

    def triggers(self, words: set[str]) -> list[str]:
        """Those of the words that can open a match."""
        memo, found = self.memo, []
        if len(memo) > self.memo_size:
            memo.clear()
        for w in words:
            if (v := memo.get(w)) is None:
                v = memo[w] = max((w for x in WORD.findall(w) for _, w in self.lexical(x)), default=0.0)
            if v:
                found.append(w)
        return found

    def clause(self, words: list[str]) -> float:
        """The weight of the composed transducer's best path."""
        return CLAUSES.best([self.lexical(w) for w in words])

    def figures(self, text: str | None) -> list[float]:
        """1, the weight of the heaviest clause, that of the others, the logarithm of the number of words."""
        low = (text or "").lower()
        words = low.split()
        if not (found := self.triggers(set(words))):
            return [1.0, 0.0, 0.0, math.log1p(len(words))]
        opening = {x for w in found for x in WORD.findall(w) if any(w for _, w in self.lexical(x))}
        # a clause without such a word has no match, so only the others are read
        each = [self.clause(read) for c in CLAUSE.split(low) if not opening.isdisjoint(read := WORD.findall(c))]
        most = max(each, default=0.0)
        return [1.0, most, math.log1p(sum(each) - most), math.log1p(len(words))]

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(self.scale, self.figures(text), strict=True))))))

    def fit(self, x: list[list[float]], y: list[int], share: float, ridge: float = 0.05) -> None:
        """Logistic regression of the label on the figures; share: of label 1 where the sample comes from."""
        a, b, w = np.array(x), np.array(y, float), np.zeros(len(UNTAUGHT))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (p - b) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        w[0] += math.log(share / (1 - share)) - math.log(b.mean() / (1 - b.mean()))
        self.scale = tuple(w.tolist())


def whole(word: str) -> str:
    """The stem of the word as a whole, of bounded length."""
    if len(word) > LONGEST:
        word = f"{word[: PREFIXES[-1]]}_{blake2b(word.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"  # no word holds a _
    return word + END


def stems_of(word: str) -> list[str]:
    """What a word may be known by."""
    own = [] if len(word) in PREFIXES else [whole(word)]
    return own + [word[:n] for n in PREFIXES if n <= len(word)]


def _stem_rows(batches: Iterator[pa.RecordBatch], per_document: int) -> Iterator[pa.RecordBatch]:
    """For each word of a labelled text: each of its stems, with a hash of the words beside it, per_document at most for a stem."""
    for batch in slices(batches, 64):
        stem, context, toxic = [], [], []
        for text, label in zip(column(batch, "text"), column(batch, "label"), strict=True):
            words = ["", *WORD.findall((text or "").lower()), ""]
            seen: dict[str, set[int]] = {}
            for i in range(1, len(words) - 1):
                beside = xxh3_64_intdigest(f"{words[i - 1]} {words[i + 1]}") >> 1
                for s in stems_of(words[i]):
                    if len(own := seen.setdefault(s, set())) < per_document:
                        own.add(beside)
            for s, own in seen.items():
                stem += [s] * len(own)
                context += own
                toxic += [label] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(stem, pa.string()), pa.array(context, pa.int64()), pa.array(toxic, pa.int32())], names=["stem", "context", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, where, per_class: int = 2000, most_stems: int = 4000, per_document: int = 3) -> Grammar:
    """A grammar whose insult stems and score come from at most per_class labelled documents of each class that fulfil
    `where`. The strongest most_stems stems at most, with their longer forms, and four figures a document reach the driver.
    per_document: contexts that one document adds to a stem at most, so that no single document makes a stem.
    """
    spark = docs.sparkSession
    sample = staged(labelled_sample(docs, labels, "toxic", where, per_class))
    counts = staged(
        sample.mapInArrow(lambda batches: _stem_rows(batches, per_document), "stem string, context long, toxic int")
        .groupBy("stem", "context")
        .agg(F.max("toxic").alias("t"))
        .groupBy("stem")
        .agg(F.sum("t").alias("t"), F.sum(1 - F.col("t")).alias("n"))
        .where("t + n >= 3")
    )
    strong = counts.where("t >= 4 and t >= 4 * n").orderBy(F.desc("t"), "stem").limit(most_stems).collect()
    roots = {r.stem for r in strong if _clear(r.t, r.n)}
    roots = sorted(p for p in roots if not any(p[:k] in roots for k in PREFIXES if k < len(p)))
    starts = spark.createDataFrame([(r,) for r in roots], "root string")
    heads = F.array(*[F.substring("stem", 1, n) for n in PREFIXES], "stem")  # what a root may be
    forms = counts.withColumn("root", F.explode(heads)).join(F.broadcast(starts), "root", "left_semi").select("stem", "t", "n").distinct().collect()
    grammar = Grammar(weights({r.stem: (r.t, r.n) for r in forms}))
    shared = spark.sparkContext.broadcast(grammar.stems)

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(shared.value)
        for batch in slices(batches, 512):
            yield with_columns(batch, ["label"], {"x": pa.array([own.figures(t) for t in column(batch, "text")], pa.list_(pa.float64()))})

    rows = sample.select("label", "text").mapInArrow(figures, "label int, x array<double>").collect()
    share = labels.where(where & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    if len({r.label for r in rows}) == 2:
        grammar.fit([r.x for r in rows], [r.label for r in rows], share)
    return grammar


def _clear(t: int, n: int) -> bool:
    """Whether so many toxic and other contexts are far from chance."""
    return t * math.log(max((t + 0.5) / (n + 0.5) / 2, 1e-9)) >= 12


def weights(counts: dict[str, tuple[int, int]], prior: float = 2.0) -> dict[str, float]:
    """stem -> log odds of toxic contexts among words with this prefix and no longer one of the counted; where few are
    left, those of all words with this prefix decide."""
    out = {}
    below: dict[str, list[int]] = {}
    for p, (t, n) in counts.items():
        own = below.setdefault(p[:-1], [0, 0])
        own[0] += t
        own[1] += n
    for p, (t, n) in counts.items():
        u, m = below.get(p, (0, 0))
        all_t = (t + 0.5) / (t + n + 1)
        out[p] = math.log((max(0, t - u) + prior * all_t) / (max(0, n - m) + prior * (1 - all_t)))
    return {p: min(8.0, w) if w > 0.3 else 0.0 for p, w in out.items()}


def score(docs: DataFrame, grammar: Grammar, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The named columns and score (double, 0 to 1) of each row's text. The grammar is bounded by its most_stems."""
    shared = docs.sparkSession.sparkContext.broadcast((grammar.stems, grammar.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(*shared.value)
        for batch in slices(batches, 1024):
            yield with_columns(batch, [*columns], {"score": pa.array(map(own.score, column(batch, "text")), pa.float64())})

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{fields}, score double")
