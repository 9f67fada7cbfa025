"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to symbols (insult, threat, target, negation, report, ...), and five weighted transducers read a clause's symbols one
after the other, each rewriting what the one before wrote:

* negation marks insults and threats in its reach, which a comma ends; "not just" negates nothing,
* reported speech marks those after a reporting verb, up to the next comma, or within quotation marks,
* threat writes a match where a threatening verb is meant (after an auxiliary, or first in its clause, else weaker) and its target follows
  ("I will kill you", not "I will kill time"); a game that follows takes it back ("I will beat you at chess"),
* insult weighs phrases: an intensifier or another insult before it makes an insult stronger ("utter idiot", "stupid clown"), a
  harmless head after it takes it back ("trash can"), and waste is none after a chore ("take out the trash"),
* target marks insults that a target precedes or follows closely ("you are a fool", "fool, you").

They are composed while they run: a state of the composition is a tuple of theirs, its weight the product of theirs, and each transition is
computed once. The matches of a clause, weighted by grammar and lexicon, add up to its score; sums by kind of match, the
strongest clause and the share of matched clauses are a document's features, and a ridge logistic model with prior weights turns them
into its score.

Learned from labelled documents outside the held-out part: the insult lexicon (words and word beginnings that occur almost only in
toxic documents, more often than chance explains, beside a short fixed list; a beginning counts only if KINDS different words with it were seen, so it does not
cover a clean word for the sake of a single insult) and the feature weights. The model is fitted from at most
MAX_LABELLED labelled documents, one row each, those with the smallest hash of their id; scoring reads every whole text, however long, in one
pass without a shuffle.

A null text counts as empty and, like any text without matches, gets the score of no matches. Labels that are null are not used; of the rows of one
labelled id the smallest text counts, of equal texts with both labels the toxic one;
without labels of both classes the prior weights stand. Repeated rows get equal scores; extra columns are ignored; an empty
table gives an empty result. Ties decide nothing: every row is scored by itself, and the fit sorts its rows first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written
from .quality import held_out, labelled_sample

MAX_LABELLED, CUT = 20_000, 0.5
LEVELS, FALSE_SHARE, PURE, KINDS = 40, 0.1, 0.01, 3

# Seed words of the grammar.
INSULTS = frozenset("idiot idiots stupid moron morons loser losers scum pathetic worthless disgusting clown clowns dumb fool imbecile dumbass vermin retard bastard asshole bitch".split())
WASTE = frozenset("trash garbage filth".split())
THREATS = frozenset("kill murder destroy hurt beat strangle shoot stab burn hang hunt smash slaughter".split())
TARGETS = frozenset("you your yours yourself youre u ur he him his she her they him them their these those people du dich dir dein ihr euch sie tu toi te ton vous votre vos tú ti tus usted ustedes vosotros".split())
NEGATIONS = frozenset("not never no nobody none cannot without isnt arent wasnt dont doesnt didnt wont nicht kein keine keinen nie pas jamais aucun aucune nunca jamás ningún ninguna".split())
REPORTS = frozenset("said says say wrote writes called calls calling told tells claimed claims quoted quote quotes reported reports according alleged sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())
AUXILIARIES = frozenset("will ll shall gonna going should must want wanna could would let werde wirst wird vais va voy vas".split())
INTENSIFIERS = frozenset("utter utterly complete completely total totally absolute absolutely fucking damn bloody such so very real really".split())
EMPHASES = frozenset("just only merely simply nur seulement solo".split())
GAMES = frozenset("chess game games race match tennis poker cards football scrabble quiz golf".split())
CHORES = frozenset("out throw threw thrown empty emptied collect collected recycle recycled dump dumped sort sorted".split())
HARMLESS = frozenset("can cans bin bins bag bags truck collection disposal fish nose proof resistant bracket".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, AUXILIARY, INTENSIFIER, HARMLESS_HEAD, MATCHED_THREAT, LATE_TARGET, TAKEN_BACK, COMMA, EMPHASIS, GAME, CHORE, WASTE_WORD = range(18)
#: Marks that transducers put on a symbol, added to it.
BASE = 32
NEGATED, REPORTED, TARGETED = BASE, 2 * BASE, 4 * BASE
HARSH = (INSULT, THREAT, WASTE_WORD)
MATCHES = ("insult", "targeted_insult", "negated_insult", "reported_insult", "threat", "targeted_threat", "negated_threat", "reported_threat")
FEATURES = (*MATCHES, "strongest", "clauses", "density")
PRIOR = np.array([3.0, 3.5, 0.6, 0.6, 0.5, 3.0, 0.2, 0.2, 3.0, 1.0, 0.5])
PRIOR_BIAS = -3.0
NEGATION_REACH, TARGET_REACH, OBJECT_REACH, AUXILIARY_REACH, GAME_REACH = 3, 4, 3, 3, 3

_WORD = re.compile(r"[^\W\d_]+|[\"“”„«»,]")
_CLAUSE = re.compile(r"[.!?;\n]+")

#: What a transducer does at a symbol in a state: (next state, symbol written, weight).
Arc = tuple[int, int, float]


def negation(state: int, symbol: int) -> Arc:
    """State: how many words the last negation still reaches."""
    if symbol == NEGATION:
        return NEGATION_REACH, symbol, 1.0
    if symbol == COMMA or (symbol == EMPHASIS and state == NEGATION_REACH):
        return 0, symbol, 1.0
    if symbol in HARSH and state:
        return state - 1, symbol + NEGATED, 0.3
    return max(0, state - 1), symbol, 1.0


def report(state: int, symbol: int) -> Arc:
    """State: 1 right after a reporting verb, 2 later on, + 3 within quotation marks."""
    said, quoted = state % 3, state // 3
    if symbol == REPORT:
        return 1 + 3 * quoted, symbol, 1.0
    if symbol == QUOTE:
        return said + 3 * (1 - quoted), symbol, 1.0
    if symbol == COMMA:  # "she said, you ..." goes on; "she said you are smart, ..." does not
        return (1 if said == 1 else 0) + 3 * quoted, symbol, 1.0
    after = (2 if said else 0) + 3 * quoted
    if symbol % BASE in HARSH and state:
        return after, symbol + REPORTED, 0.4
    return after, symbol, 1.0


def threat(state: int, symbol: int) -> Arc:
    """State 0: a clause's start; 1: nothing; 2 to 4: words that an auxiliary still reaches; 5 to 63: a threat waits for its target; above: words in which a game takes a match back.

    A waiting state holds the threat's marks, whether it is meant, and the words left: 5 + left + 4 * meant + 8 * (marks / BASE).
    """
    marks, kind = symbol // BASE, symbol % BASE
    if kind == THREAT:
        meant = state == 0 or 2 <= state <= 4
        return 5 + OBJECT_REACH - 1 + 4 * meant + 8 * marks, OTHER, 1.0
    if state >= 64:
        return (state - 1 if state > 64 else 1), (TAKEN_BACK if kind == GAME else symbol), 1.0
    if state >= 5:
        left, meant, held = (state - 5) % 4, (state - 5) // 4 % 2, (state - 5) // 8
        if kind == TARGET:
            return 64 + GAME_REACH - 1, MATCHED_THREAT + BASE * held, (1.0 if meant else 0.3) * (0.3 if held & 1 else 1.0) * (0.4 if held & 2 else 1.0)
        return (state - 1 if left else 1), symbol, 1.0
    if kind == AUXILIARY:
        return 1 + AUXILIARY_REACH, symbol, 1.0
    return (state - 1 if state > 2 else 1), symbol, 1.0


def insult(state: int, symbol: int) -> Arc:
    """State 1, 2: words that an intensifier still reaches; 3: an insult came just before; 4, 5: words that a chore still reaches."""
    kind, marks = symbol % BASE, symbol // BASE * BASE
    if kind == WASTE_WORD and state in (4, 5):
        return 0, OTHER, 1.0
    if kind in (INSULT, WASTE_WORD):
        return 3, INSULT + marks, 1.3 if state in (1, 2, 3) else 1.0
    if kind == HARMLESS_HEAD and state == 3:
        return 0, TAKEN_BACK, 1.0
    if kind == INTENSIFIER:
        return 2, symbol, 1.0
    if kind == CHORE:
        return 5, symbol, 1.0
    return ({1: 0, 2: 1, 4: 0, 5: 4}.get(state, 0)), symbol, 1.0


def target(state: int, symbol: int) -> Arc:
    """State: words that the last target still reaches + 8 * words in which a target may still follow an unmarked insult."""
    reach, late = state % 8, state // 8
    kind, marks = symbol % BASE, symbol // BASE
    after = max(0, reach - 1) + 8 * max(0, late - 1)
    if kind == INSULT:
        if reach and not marks:
            return max(0, reach - 1), symbol + TARGETED, 1.2
        return max(0, reach - 1) + 8 * (0 if marks else 2), symbol, 1.0
    if kind == TARGET:
        return TARGET_REACH, LATE_TARGET if late else symbol, 1.2 if late else 1.0
    return after, symbol, 1.0


class Composition:
    """Transducers in a row: each reads what the one before writes. Transitions are computed when first met."""

    def __init__(self, *machines: Callable[[int, int], Arc]):
        self.machines = machines
        self.start = (0,) * len(machines)
        self.arcs: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int, float]] = {}

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int, float]:
        found = self.arcs.get((state, symbol))
        if found is None:
            after, weight, written_ = [], 1.0, symbol
            for machine, own in zip(self.machines, state, strict=True):
                new, written_, w = machine(own, written_)
                after.append(new)
                weight *= w
            found = self.arcs[state, symbol] = (tuple(after), written_, weight)
        return found


GRAMMAR = Composition(negation, report, threat, insult, target)


def kind_of(symbol: int) -> int | None:
    """The place in MATCHES of a written symbol; None where it is no match."""
    base = symbol % BASE
    if base not in (INSULT, MATCHED_THREAT):
        return None
    if symbol & NEGATED:
        return 2 + 4 * (base != INSULT)
    if symbol & REPORTED:
        return 3 + 4 * (base != INSULT)
    return 5 if base == MATCHED_THREAT else 1 if symbol & TARGETED else 0


class Lexicon:
    """Insult words and word beginnings with their weights, as one symbol table."""

    FIXED = ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (AUXILIARIES, AUXILIARY), (INTENSIFIERS, INTENSIFIER), (HARMLESS, HARMLESS_HEAD), (EMPHASES, EMPHASIS), (GAMES, GAME), (CHORES, CHORE), (WASTE, WASTE_WORD))

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = {**dict.fromkeys(INSULTS, 1.0), **{w: v for w, v in words.items() if w not in WASTE}}, stems
        self.lengths = sorted({len(s) for s in stems})
        self.symbols = {w: symbol for group, symbol in reversed(self.FIXED) for w in group}
        self.finder = ahocorasick.Automaton()
        for key in {*self.words, *THREATS, *WASTE, *stems}:
            self.finder.add_word(key, 1)
        self.finder.make_automaton()

    def may_match(self, text: str) -> bool:
        """Whether any word or stem occurs, be it within another word."""
        return next(self.finder.iter(text), None) is not None

    def symbol(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return INSULT, self.words[word]
        for n in self.lengths:
            if word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return self.symbols.get(word, OTHER if word.isalpha() else COMMA if word == "," else QUOTE), 1.0

    def clause(self, words: list[str], known: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
        """The weights of a clause's matches by their kind."""
        known = {} if known is None else known
        out = np.zeros(len(MATCHES))
        state, last, held = GRAMMAR.start, 0, 0.0
        for word in words:
            if word not in known:
                known[word] = self.symbol(word)
            symbol, own = known[word]
            state, written_, weight = GRAMMAR.step(state, symbol)
            kind = kind_of(written_)
            if kind is not None:
                out[kind] += own * weight
                last, held = kind, own * weight
            elif written_ == LATE_TARGET:
                out[last] -= held
                last, held = 1, held * weight
                out[last] += held
            elif written_ == TAKEN_BACK:
                out[last] -= held
                held = 0.0
        return np.maximum(out, 0)

    def matches(self, text: str) -> np.ndarray:
        """The features of one text."""
        out = np.zeros(len(FEATURES))
        low = text.lower()
        if not self.may_match(low):
            return out
        known: dict[str, tuple[int, float]] = {}
        words_seen = 0
        for part in _CLAUSE.split(low):
            words = _WORD.findall(part)
            words_seen += len(words) - words.count(",")
            if not self.may_match(part):
                continue
            found = self.clause(words, known)
            score = float(found.sum())
            out[:8] += found
            out[8] = max(out[8], min(score, 3.0))
            out[9] += score >= 0.5
        out[:8] = np.log1p(out[:8])
        out[10] = min(1.0, 20 * out[9] / max(1, words_seen))
        out[9] = math.log1p(out[9])
        return out


def _tokens(text: str) -> set[str]:
    """The words of a text and, marked by a star, their beginnings of 4 letters or more."""
    words = set(re.findall(r"[^\W\d_]{3,}", text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in range(4, len(w))}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """The tokens that occur in toxic documents only, more often than chance would make them. The sample bounds their number."""

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[int(label == 1)].update(_tokens(text or ""))
        keys = [*seen[1], *(k for k in seen[0] if k not in seen[1])]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], ["token", "pos", "neg"])

    sample = sample.groupBy("text").agg(F.max("label").alias("label"))  # copies would count one document's rare words many times
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    pos, neg = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not pos or not neg:
        return Lexicon({}, {})
    base = pos / (pos + neg)
    totals = map_slices(sample.select("label", "text"), "text", counts, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = written(totals, "all-tokens")
    beginnings = F.explode(F.transform(F.sequence(F.lit(4), F.length("token") - 1), lambda n: F.substring("token", F.lit(1), n))).alias("stem")
    kinds = totals.where("pos > 0 AND NOT endswith(token, '*') AND length(token) > 4").select(beginnings).groupBy("stem").agg(F.count("*").alias("kinds"))
    varied = kinds.where(F.col("kinds") >= KINDS).select(F.concat("stem", F.lit("*")).alias("token"))
    totals = totals.where("NOT endswith(token, '*')").unionByName(totals.join(varied, "token", "left_semi"))
    totals = written(totals.where("pos + neg >= 3").withColumn("stem", F.col("token").endswith("*")), "tokens")
    lexicon: dict[bool, dict[str, float]] = {}
    for stem in (False, True):
        own = totals.where(F.col("stem") == stem)
        # of the tokens in k documents, chance puts a share of base^k in toxic ones only: a level counts if few of its finds are such
        levels = own.where(f"pos + neg <= {LEVELS}").groupBy((F.col("pos") + F.col("neg")).alias("k")).agg(F.count("*").alias("all"), F.sum((F.col("neg") == 0).cast("int")).alias("pure")).collect()
        wrong = {r["k"] for r in levels if r["pure"] and r["all"] * base ** r["k"] > FALSE_SHARE * r["pure"]}
        least = max([2, *wrong]) + 1 + 6 * stem
        best = own.where((F.col("pos") >= least) & (F.col("neg") <= F.lit(PURE) * F.col("pos"))).select("token").collect()  # tokens of at most MAX_LABELLED texts
        lexicon[stem] = {r["token"].rstrip("*"): 1.0 for r in best}
    return Lexicon(lexicon[False], lexicon[True])


class Model:
    """A lexicon and the ridge logistic weights of its matches."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.lexicon.matches(text) @ self.weights + self.bias, -40, 40))))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps on the logistic loss plus ridge times the squared distance from the prior weights."""
    prior = np.append(PRIOR, PRIOR_BIAS)
    z = np.column_stack([x, np.ones(len(x))])
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (y - p) - ridge * (w - prior)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 3 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    w[:-1] = np.maximum(w[:-1], 0)  # no match makes a text less toxic
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, most: int = MAX_LABELLED) -> Model:
    """The model of the labelled rows outside the held-out part."""
    sample = written(labelled_sample(docs, labels, "toxic", ~held_out("doc_id", parts, part), most).select("label", "text"), "toxic-sample")
    lexicon = learn_lexicon(sample)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([lexicon.matches(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    rows = map_slices(sample, "text", measure, "label int, x array<double>").toPandas()  # at most `most` short rows
    if rows["label"].nunique() < 2:
        return Model(lexicon, PRIOR, PRIOR_BIAS)
    x, y = np.stack(rows["x"].to_numpy()), (rows["label"].to_numpy() == 1).astype(float)
    order = np.lexsort((*x.T, y))
    return Model(lexicon, *fit_weights(x[order], y[order]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, parts, part)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    out = map_slices(docs.select("doc_id", "text"), "text", measure, "doc_id long, score double", 4 << 20)
    return out.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
