"""Toxicity by a weighted finite-state pattern grammar.

Five transducers are composed: a lexical one (token to class, with the weight
of an insult), one for negation, one for reported speech, one for targets and
one for threats. The composed machine reads one clause and returns one score;
a document's score is the sum over its clauses, so that words count by the
clause in which they stand. Quotations go on over clauses, to the end of their
line at most.

The insult lexicon is a seed list and what a bounded sample of labelled rows
adds to it (``max_labelled``); how much negated or reported insults count and
from which score on a document is rejected are learned from the same rows, by
one rule at every number of them: priors that labels outweigh.

Defined results: null or empty texts score 0 and are never rejected; rows with
a null id are scored like others; repeated rows are each scored; an empty
table gives an empty result; very long texts are read whole; other columns are
passed through by ``reject_toxic`` and ignored by ``score_toxicity``.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamsift.llm.common import pick, slices, table
from loamsift.session import materialize

SEED_INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile dumbass bastard bastards vermin filth subhuman retard freak dummkopf trottel abschaum arschloch connard imbécile ordure estúpido imbécil cabrón escoria".split()
THREATS = "kill murder hurt destroy strangle beat shoot stab punish exterminate töten umbringen ermorden erschießen erwürgen vernichten tuer assassiner étrangler détruire matar asesinar estrangular destruir".split()
TARGETS = frozenset("you your yours yourself youre u vous toi tu te dich dir euch du deine deinen usted ustedes vosotros ti".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't weren't don't doesn't neither nor hardly nicht kein keine nie pas jamais nunca jamás".split())
REPORTS = frozenset("said says say claimed claims wrote writes quoted quote reported called alleged sagte sagt schrieb dijo dice escribió dit déclaré écrit".split())
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”«»]")
CLAUSE_ENDS = ".!?;\n"
CLAUSE_END = re.compile(r"[.!?;\n]+")
QUOTE = re.compile(r"[\"“”«»]")
THREAT = 1.25  # what a threat to a target scores, enough for a rejection
REJECT_AT = 1.25
REJECT_FROM = (1.0, 1.25, 1.5, 2.0)  # of these the least that is thought to reject at most MAX_WRONG of clean rows
MAX_WRONG = 0.002
PRIOR_WRONG = (2.0, 0.5, 0.5, 0.5)  # clean rows that each of them is held to have rejected out of PRIOR_CLEAN before any label is seen
PRIOR_CLEAN = 500
MAX_LABELLED = 20_000
MIN_CONTEXTS = 5
CHANCE = 0.05  # words that chance alone may bring into the lexicon
CONTEXT_SHARE = 0.15


class Transducer:
    """A deterministic weighted transducer: (state, symbol) to (output, weight, next state).

    Symbols without an arc pass unchanged at weight 0 and keep the state.
    """

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (symbol, 0.0, state))


class Composed:
    """The cascade of transducers, each reading what the one before it writes; weights add up."""

    def __init__(self, machines: list[Transducer]):
        self.machines, self.memo = machines, {}

    def start(self, quoted: bool = False):
        """The states at the start of a clause, one within quotation marks among them."""
        return tuple("quoted" if quoted and m.start == "plain" else m.start for m in self.machines)

    def step(self, state, symbol: str):
        hit = self.memo.get((state, symbol))
        if hit is None:
            out, total, states = symbol, 0.0, []
            for m, s in zip(self.machines, state):
                out, w, s = m.step(s, out)
                total += w
                states.append(s)
            hit = self.memo[(state, symbol)] = (out, total, tuple(states))
        return hit


def negation(scope: int = 3) -> Transducer:
    """I to i and H to h within ``scope`` tokens after a negation."""
    arcs = {}
    for s in range(scope + 1):
        for c in "ITHRQo":
            out = {"I": "i", "H": "h"}.get(c, c) if s else c
            arcs[(s, c)] = (out, 0.0, max(0, s - 1))
        arcs[(s, "N")] = ("o", 0.0, scope)
    return Transducer(0, arcs)


def reported_speech() -> Transducer:
    """Insults and threats after a reporting verb, or inside quotation marks, become J and K."""
    arcs = {}
    for s in ("plain", "verb", "quoted"):
        arcs[(s, "R")] = ("o", 0.0, "quoted" if s == "quoted" else "verb")
        arcs[(s, "Q")] = ("o", 0.0, {"plain": "quoted", "verb": "verb", "quoted": "plain"}[s])
        if s != "plain":
            arcs[(s, "I")], arcs[(s, "i")], arcs[(s, "H")] = ("J", 0.0, s), ("i", 0.0, s), ("K", 0.0, s)
    return Transducer("plain", arcs)


def target() -> Transducer:
    """A clause with a target and an insult, in either order, gains a bonus once."""
    return Transducer("", {("", "T"): ("T", 0.0, "t"), ("", "I"): ("I", 0.0, "i"), ("t", "I"): ("I", 0.5, "ti"), ("i", "T"): ("T", 0.5, "ti")})


def threat() -> Transducer:
    """A threat counts only with a target in its clause."""
    return Transducer("", {("", "T"): ("T", 0.0, "t"), ("", "H"): ("H", 0.0, "h"), ("t", "H"): ("H", THREAT, "th"), ("h", "T"): ("T", THREAT, "th")})


@dataclass
class Grammar:
    """Insult weights by word, and how much a plain, negated or reported insult counts."""

    insults: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, 1.0))
    negated: float = 0.25
    reported: float = 0.5
    reject_at: float = REJECT_AT

    def machine(self) -> Composed:
        return Composed([negation(), reported_speech(), target(), threat()])

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for w in [*self.insults, *THREATS]:
            a.add_word(w, len(w))
        a.make_automaton()
        return a

    def classify(self, token: str) -> str:
        if token in self.insults:
            return "I"
        if token in TARGETS:
            return "T"
        if token in NEGATIONS:
            return "N"
        if token in REPORTS:
            return "R"
        if token in _THREATS:
            return "H"
        return "Q" if token in '"“”«»' else "o"


_THREATS = frozenset(THREATS)


def clauses_of(text: str, grammar: Grammar, automaton, machine: Composed) -> list[tuple[int, int, float, str]]:
    """(start, end, score, classes of its insults and threats) of each clause that scores."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; keep the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    found, known, marks, quoted, factor = [], -1, 0, False, {"I": 1.0, "i": grammar.negated, "J": grammar.reported}
    for end, size in automaton.iter(low):
        at = end - size + 1
        if at < known or (at and (low[at - 1].isalnum())) or (end + 1 < len(low) and low[end + 1].isalnum()):
            continue
        start = max(low.rfind(c, max(known, 0), at) for c in CLAUSE_ENDS) + 1 or max(known, 0)
        m = CLAUSE_END.search(low, end)
        known = m.end() if m else len(low)
        stop = m.start() if m else len(low)
        line = low.rfind("\n", marks, start) + 1
        if line:  # quotations end with their line
            marks, quoted = line, False
        quoted ^= len(QUOTE.findall(low, marks, start)) % 2 == 1
        marks = start
        state, score, seen = machine.start(quoted), 0.0, []
        for t in TOKEN.finditer(low, start, stop):
            word = t.group()
            out, w, state = machine.step(state, grammar.classify(word))
            score += w
            if out in factor:
                score += factor[out] * grammar.insults[word]
                seen.append(out)
            elif out in "HKh":
                seen.append(out)
        if score > 0:
            found.append((start, stop, score, "".join(seen)))
    return found


WORD = re.compile(r"[^\W_]+")


def _label_counts(batches):
    """For each word: toxic and clean documents with it."""
    pos, neg = defaultdict(int), defaultdict(int)
    for b in slices(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            into = pos if toxic else neg
            for x in set(WORD.findall((text or "").lower())):
                into[x] += 1
    names = list(pos.keys() | neg.keys())
    for k in range(0, len(names), 20_000):
        part = names[k : k + 20_000]
        yield pa.RecordBatch.from_pydict({"word": part, "toxic_n": [pos[x] for x in part], "clean_n": [neg[x] for x in part]})


def _contexts(wanted: frozenset):
    """(word, hash of its previous and next word) of the wanted words in toxic documents."""

    def run(batches):
        for b in slices(batches):
            found = set()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                w = WORD.findall((text or "").lower()) if toxic else []
                found |= {(x, xxhash.xxh3_64_intdigest(f"{a}\t{c}") >> 1) for a, x, c in zip(["", *w], w, [*w[1:], ""]) if x in wanted}
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "context"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Grammar:
    """A grammar from at most ``max_labelled`` labelled rows, taken by the hash of their ids.

    A word joins the lexicon if it is in toxic documents far more often than
    chance gives at the size of the vocabulary, almost never in clean ones, and
    among many different neighbours: words of a toxic text that was copied a
    thousand times, or of a passage, always have the same neighbours. Labels
    with null ids or null marks are left out; a document marked both ways
    counts as toxic.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    taken = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = [(r.doc_id, bool(r.toxic)) for r in taken.collect()]
    toxic = sum(t for _, t in rows)
    if not toxic or toxic == len(rows):
        return Grammar()
    spark = docs.sparkSession
    sample = spark.createDataFrame(rows, "doc_id long, toxic boolean")
    texts = pick(docs).where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # max_labelled rows of 9 bytes
    texts = materialize(texts.repartition(max(2, min(64, len(rows) // 500))), "labelled")
    counts = texts.mapInArrow(_label_counts, "word string, toxic_n long, clean_n long")
    each = materialize(counts.groupBy("word").agg(F.sum("toxic_n").alias("t"), F.sum("clean_n").alias("c")), "words")
    rate = toxic / len(rows)
    tried = each.where(F.col("t") + F.col("c") >= 5).count()
    need = max(5, math.ceil(math.log(max(1, tried) / CHANCE) / -math.log(rate)))
    often = {r.word: r.t for r in each.where((F.col("t") >= need) & (F.col("c") <= 0.02 * F.col("t")) & (F.length("word") >= 3) & ~F.col("word").rlike("[0-9]")).select("word", "t").collect()}
    around = texts.mapInArrow(_contexts(frozenset(often)), "word string, context long").distinct().groupBy("word").count().collect() if often else []
    learned = [r for r in around if r["count"] >= max(MIN_CONTEXTS, CONTEXT_SHARE * often[r.word])]
    g = Grammar()
    for r in learned:
        g.insults[r.word] = 1.0

    def seen_in(batches):
        a, m, n = g.automaton(), g.machine(), {c: [0, 0] for c in "iJ"}
        for b in slices(batches):
            for text, bad in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                for c in {c for *_, s in clauses_of(text, g, a, m) for c in s} & n.keys():
                    n[c][int(bad)] += 1
        yield pa.RecordBatch.from_pydict({"kind": list(n), "clean": [v[0] for v in n.values()], "toxic": [v[1] for v in n.values()]})

    by = {r.kind: r for r in texts.mapInArrow(seen_in, "kind string, clean long, toxic long").groupBy("kind").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    for kind, name, prior in (("i", "negated", (1, 3)), ("J", "reported", (1, 1))):
        if kind in by:
            setattr(g, name, (prior[0] + by[kind].toxic) / (sum(prior) + by[kind].toxic + by[kind].clean))

    def scores(batches):
        a, m = g.automaton(), g.machine()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([sum(x[2] for x in clauses_of(t, g, a, m)) for t in b.column("text").to_pylist()], pa.float64())], ["toxic", "score"])

    at = texts.mapInArrow(scores, "toxic boolean, score double")
    over = at.agg(F.count_if(~F.col("toxic")).alias("clean"), *(F.count_if(~F.col("toxic") & (F.col("score") >= t)).alias(f"wrong{k}") for k, t in enumerate(REJECT_FROM)), *(F.count_if(F.col("toxic") & (F.col("score") >= t)).alias(f"right{k}") for k, t in enumerate(REJECT_FROM))).first()
    fine = [t for k, (t, prior) in enumerate(zip(REJECT_FROM, PRIOR_WRONG)) if over[f"wrong{k}"] + prior <= MAX_WRONG * (over["clean"] + PRIOR_CLEAN) and over[f"right{k}"] >= 10 * over[f"wrong{k}"]]
    g.reject_at = fine[0] if fine else REJECT_FROM[-1]
    return g


SCHEMA = "doc_id long, score double, is_toxic boolean, clauses array<struct<start:int,end:int,score:double,classes:string>>"
_CLAUSES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("classes", pa.string())]))


def score_toxicity(docs: DataFrame, grammar: Grammar, only_rejected: bool = True) -> DataFrame:
    """One row for each rejected document (or for every document), with the clauses that score."""

    def run(batches):
        a, m = grammar.automaton(), grammar.machine()
        for b in slices(batches):
            ids, scores, found = [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                c = clauses_of(text, grammar, a, m) if text else []
                s = sum(x[2] for x in c)
                if not only_rejected or s >= grammar.reject_at:
                    ids.append(i), scores.append(s), found.append([dict(zip(("start", "end", "score", "classes"), x)) for x in c])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array([s >= grammar.reject_at for s in scores], pa.bool_()), pa.array(found, _CLAUSES)], ["doc_id", "score", "is_toxic", "clauses"])

    return pick(docs).mapInArrow(run, SCHEMA)


def reject_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """The documents below the threshold, all columns as they are."""
    text_at = docs.columns.index(text_col)

    def run(batches):
        a, m = grammar.automaton(), grammar.machine()
        for b in slices(batches, text_at):
            keep = [not text or sum(x[2] for x in clauses_of(text, grammar, a, m)) < grammar.reject_at for text in b.column(text_at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
