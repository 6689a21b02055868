"""Toxicity by a weighted finite-state pattern grammar.

Words of a clause become tags (insult, threat, target, negation, reported
speech, other). Five transducers over tags are composed into one machine; each
rewrites tags and adds weight:

* negation: within a few words after a negation an insult weighs a tenth and a threat nothing;
* reported speech: after a reporting verb, insults and threats weigh less;
* target: an insult in a clause that has named somebody weighs more;
* threat: a threat counts where a target follows or came before;
* insult: an insult counts by itself.

A clause's score is the weight of its path times its strongest word's weight;
matched clauses make the features of a document, and a logistic model of the
features gives its score. Words that mark labelled toxic texts join the insults
listed here, with their log-odds as weight: those that mark by being there, and
those that clean texts hold too but toxic ones repeat.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import crc_mod, docs_of, keep_rows, map_texts, read

#: The grammar's words in English, Spanish, German and French. A text is read with all of them.
INSULTS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "vermin", "filth", "jerk", "dumb",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "payaso", "asqueroso", "asquerosa",
    "dummkopf", "trottel", "abschaum", "versager", "widerlich", "erbärmlich", "wertlos", "ungeziefer",
    "imbécile", "stupide", "ordure", "racaille", "abruti", "abrutie", "minable", "vermine",
)
THREATS = (
    "kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "strangle", "murder",
    "matar", "mataré", "golpear", "golpearé", "quemar", "quemaré", "apuñalar", "destruir",
    "töten", "umbringen", "verprügeln", "erschießen", "erstechen", "verbrennen", "zerstören",
    "tuer", "tuerai", "frapper", "frapperai", "brûler", "brûlerai", "poignarder", "détruire",
)
TARGETS = (
    "you", "your", "yours", "youre", "he", "she", "him", "her", "they", "them", "their", "those", "these", "people",
    "tú", "usted", "ustedes", "ellos", "ellas", "vosotros", "ella", "gente",
    "dich", "dir", "euch", "ihn", "ihm", "ihnen", "leute",
    "toi", "vous", "eux", "elles", "gens",
)
NEGATIONS = (
    "not", "never", "no", "isnt", "arent", "dont", "wont", "nobody", "without", "neither", "nor",
    "nunca", "jamás", "nadie", "ningún", "ninguna", "sin", "tampoco",
    "nicht", "kein", "keine", "keiner", "nie", "niemals", "niemand", "ohne", "weder",
    "ne", "pas", "jamais", "aucun", "aucune", "personne", "sans", "ni",
)
REPORTS = (
    "said", "says", "say", "wrote", "claimed", "reported", "quoted", "called", "according",
    "dijo", "dice", "escribió", "afirmó", "llamó", "según",
    "sagte", "sagt", "schrieb", "behauptete", "nannte", "laut", "zitierte",
    "écrit", "affirmé", "appelé", "selon", "déclaré",
)

#: Labelled rows the model learns from at most: those of smallest hash.
TRAIN_ROWS = 20_000
#: Learned words: the log-odds of toxic documents among theirs, the log-likelihood ratio that their share of
#: toxic ones must have over the share of all documents (so the count they need follows the labels), and the share
#: of all toxic documents they must be in, which bounds their number. Copies of one document count once.
#: Beginnings of words of these lengths are learned too, as ``beginning*``: inflected insults share one.
STEMS = (5, 6, 7)
LEAST_ODDS, LEAST_EVIDENCE, LEAST_OF_TOXIC = 2.0, 12.0, 0.004
#: ``word+`` and ``beginning*+`` mark documents that repeat them: twice, and once for so many words.
TWICE, PER_WORDS = 2, 400

NEGATED_WORDS = 3

Arc = tuple[str, float, int]


@dataclass
class Transducer:
    """``arcs[state][tag]`` gives (tag written, weight, next state); a tag without an arc is copied."""

    arcs: dict[int, dict[str, Arc]] = field(default_factory=dict)

    def step(self, state: int, tag: str) -> Arc:
        return self.arcs.get(state, {}).get(tag, (tag, 0.0, state))

    def then(self, other: Transducer, tags: str) -> Transducer:
        """Composition: what this one writes, the other reads. States are numbered as they are reached."""
        number, todo, out = {(0, 0): 0}, [(0, 0)], Transducer()
        while todo:
            a, b = pair = todo.pop()
            for tag in tags:
                mid, w1, a2 = self.step(a, tag)
                last, w2, b2 = other.step(b, mid)
                if (a2, b2) not in number:
                    number[a2, b2] = len(number)
                    todo.append((a2, b2))
                out.arcs.setdefault(number[pair], {})[tag] = (last, w1 + w2, number[a2, b2])
        return out


# Tags: I insult, T threat, G target, N negation, R report, i and t the same within reported speech, w any other word.
TAGS = "ITGNRw"


def grammar() -> Transducer:
    negation = Transducer({s: {"N": ("w", 0.0, NEGATED_WORDS)} | ({"I": ("w", 0.1, s - 1), "T": ("w", 0.0, s - 1), "G": ("G", 0.0, s - 1), "R": ("R", 0.0, s - 1), "w": ("w", 0.0, s - 1)} if s else {}) for s in range(NEGATED_WORDS + 1)})
    reported = Transducer({0: {"R": ("w", 0.0, 1)}, 1: {"I": ("i", 0.0, 1), "T": ("t", 0.0, 1), "R": ("w", 0.0, 1)}})
    target = Transducer({0: {"G": ("G", 0.0, 1)}, 1: {"I": ("I", 0.5, 1), "i": ("i", 0.2, 1)}})
    threat = Transducer({0: {"T": ("w", 0.2, 1), "t": ("w", 0.1, 1), "G": ("w", 0.0, 2)}, 1: {"G": ("w", 1.0, 2), "T": ("w", 0.2, 1), "t": ("w", 0.1, 1)}, 2: {"T": ("w", 1.2, 2), "t": ("w", 0.5, 2)}})
    insult = Transducer({0: {"I": ("w", 1.0, 0), "i": ("w", 0.6, 0)}})
    machine = negation
    for part in (reported, target, threat, insult):
        machine = machine.then(part, TAGS)
    return machine


MACHINE = grammar()
BREAKS = ".!?;\n¡¿…"
CLAUSE_END = re.compile(f"[{BREAKS}]")
WORD = re.compile(r"[^\W\d_]+")


class Scorer:
    """Finds the clauses that hold a marked word and runs the machine over them."""

    def __init__(self, learned: dict[str, float]):
        self.repeated = {w[:-1]: v for w, v in learned.items() if w.endswith("+")}
        learned = {w: v for w, v in learned.items() if not w.endswith("+")}
        self.weight = dict.fromkeys(INSULTS, 1.0) | dict.fromkeys(THREATS, 0.7) | learned
        self.tag = dict.fromkeys(TARGETS, "G") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(REPORTS, "R") | dict.fromkeys(learned, "I") | dict.fromkeys(THREATS, "T") | dict.fromkeys(INSULTS, "I")
        self.stems = {w[:-1]: v for w, v in learned.items() if w.endswith("*")}
        known = [re.escape(w) for w in sorted(self.weight) if not w.endswith("*")] + [re.escape(w) + r"[^\W\d_]+" for w in sorted(self.stems)]
        often = [re.escape(w) for w in sorted(self.repeated) if not w.endswith("*")] + [re.escape(w[:-1]) + r"[^\W\d_]+" for w in sorted(self.repeated) if w.endswith("*")]
        expression = lambda words: re.compile(r"(?<![^\W\d_])(?:" + "|".join(words) + r")(?![^\W\d_])")
        self.marked, self.often, self.either = expression(known), expression(often), expression(known + often)

    def repeats(self, low: str) -> frozenset[str]:
        """The marks that count only when repeated and that this text repeats."""
        if not self.repeated:
            return frozenset()
        hits: Counter[str] = Counter()
        for m in self.often.finditer(low):
            hits.update(w for w in (m[0], *(m[0][:n] + "*" for n in STEMS if len(m[0]) > n)) if w in self.repeated)
        if max(hits.values(), default=0) < TWICE:
            return frozenset()
        least = max(TWICE, math.ceil(sum(len(w) >= 3 for w in WORD.findall(low)) / PER_WORDS))
        return frozenset(w for w, n in hits.items() if n >= least)

    def read(self, word: str, repeated: frozenset[str] = frozenset()) -> tuple[str, float]:
        """Tag and weight of a word, by itself or by how it begins."""
        if word in self.tag:
            return self.tag[word], self.weight.get(word, 0.5)
        for n in STEMS:
            if len(word) > n and word[:n] in self.stems:
                return "I", self.stems[word[:n]]
        for w in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)) if repeated else ():
            if w in repeated:
                return "I", self.repeated[w]
        return "w", 0.5

    def clause(self, text: str, repeated: frozenset[str] = frozenset()) -> float:
        state, total, strongest = 0, 0.0, 0.0
        for m in WORD.finditer(text):
            tag, weight = self.read(m[0], repeated)
            _, w, state = MACHINE.step(state, tag)
            if w:
                total += w
                strongest = max(strongest, weight)
        return total * strongest

    def features(self, text: str) -> tuple[float, float, float, float]:
        """Best clause (up to one plain insult), log of all clauses, matched clauses (log), and score per root of length."""
        low, at, done, scores = text.lower(), 0, 0, []
        repeated = self.repeats(low)
        marked = self.either if repeated else self.marked
        while m := marked.search(low, at):
            if repeated and self.read(m[0], repeated)[0] not in "IT":
                at = m.end()
                continue
            start = max(low.rfind(c, done, m.start()) for c in BREAKS) + 1
            end = e.start() if (e := CLAUSE_END.search(low, m.end())) else len(low)
            scores.append(self.clause(low[max(start, done) : end], repeated))
            at = done = end
        total = sum(scores)
        return min(1.0, max(scores, default=0.0)), math.log1p(total), math.log1p(len(scores)), min(total / math.sqrt(1 + len(low) / 100), 20.0)


#: Weights where nothing is labelled: one plain insult is just enough.
UNFITTED = (-3.0, 2.0, 1.0, 0.5, 0.2)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton steps for a logistic model with intercept; with rows of one class the rate alone, without rows UNFITTED."""
    if len(y) == 0:
        return np.array(UNFITTED)
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    if y.min() == y.max():
        w[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        return w
    penalty = np.diag([0.0] + [l2 * len(y)] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=2)
def _scorer(learned: tuple[tuple[str, float], ...]) -> Scorer:
    return Scorer(dict(learned))


@dataclass(frozen=True)
class Model:
    learned: dict[str, float]
    weights: tuple[float, ...]

    def scores(self, texts: list[str]) -> np.ndarray:
        scorer, w = _scorer(tuple(sorted(self.learned.items()))), np.array(self.weights)
        x = np.array([scorer.features(t) for t in texts]).reshape(-1, 4)
        return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def _covered(word: str, learned: dict[str, float]) -> bool:
    """Whether a word or beginning is learned, or a shorter beginning of it."""
    return word in learned or any(len(word.rstrip("*")) > n and f"{word[:n]}*" in learned for n in STEMS)


def _pruned(learned: dict[str, float], pos: dict[str, int]) -> dict[str, float]:
    """Without beginnings that one word makes up, and without what a shorter beginning covers."""
    one = lambda w: pos[w] < 1.25 * max((n for v, n in pos.items() if v.startswith(w[:-1]) and v != w and v[-1] not in "*+"), default=0)
    kept = {w: v for w, v in learned.items() if not (w.endswith("*") and one(w))}
    return {w: v for w, v in kept.items() if not _covered(w, {k: x for k, x in kept.items() if k != w})}


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn words and weights from at most ``train_rows`` labelled documents.

    Rows with null labels or doc_id are left out; without any labelled row the weights are UNFITTED. Equal texts count once for
    words, so a text that was copied often does not teach its own words.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(train_rows)
    rows = docs_of(docs).join(F.broadcast(chosen), "doc_id")  # at most train_rows pairs of numbers
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0))
    # near copies mostly share their long word of least hash, so that a copied document does not teach its own words
    trace = F.array_min(F.transform(F.filter("found", lambda w: F.length(w) >= 9), lambda w: F.xxhash64(w)))
    longer = lambda n: lambda w: F.length(w) > n
    start = lambda n: lambda w: F.concat(F.substring(w, 1, n), F.lit("*"))
    texts = rows.withColumn("found", found).withColumn("trace", F.coalesce(trace, F.xxhash64("text")))
    texts = texts.withColumn("marks", F.array_sort(F.concat("found", *[F.transform(F.filter("found", longer(n)), start(n)) for n in STEMS])))
    least = F.greatest(F.lit(TWICE), F.ceil(F.size("found") / PER_WORDS).cast("int"))
    texts = texts.withColumn("least", least).withColumn("runs", F.greatest(F.size("marks") - F.col("least") + 1, F.lit(0)))
    # sorted: what is there again so many places on is there so many times
    again = F.filter(F.zip_with(F.slice("marks", F.lit(1), F.col("runs")), F.slice("marks", F.col("least"), F.col("runs")), lambda a, b: F.when(a == b, F.concat(a, F.lit("+")))), lambda w: w.isNotNull())
    words = texts.select("toxic", "trace", F.explode(F.array_distinct(F.concat("marks", again))).alias("word")).groupBy("word", "trace").agg(F.max("toxic").alias("toxic"))
    traces = texts.groupBy("trace").agg(F.max("toxic").alias("toxic")).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    toxic, rate = traces["toxic"] or 0, ((traces["toxic"] or 0) + 0.5) / (traces["n"] + 1)
    share = F.col("pos") / (F.col("pos") + F.col("neg"))
    evidence = F.col("pos") * F.log(share / rate) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / (F.col("neg") + 0.5))
    counted = words.groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).where((F.col("pos") >= LEAST_OF_TOXIC * toxic) & (F.col("pos") > 0)).where((odds >= LEAST_ODDS) & (share > rate) & (evidence >= LEAST_EVIDENCE))
    top = counted.orderBy("word").collect()  # at most the words of toxic documents over LEAST_OF_TOXIC
    value = {r["word"]: min(1.5, 0.5 + 0.2 * math.log((r["pos"] + 0.5) / (r["neg"] + 0.5))) for r in top if r["word"].rstrip("+") not in TARGETS + NEGATIONS + REPORTS}
    pos = {r["word"]: r["pos"] for r in top}
    there = _pruned({w: v for w, v in value.items() if not w.endswith("+")}, pos)
    repeated = _pruned({w[:-1]: v for w, v in value.items() if w.endswith("+") and not _covered(w[:-1], there)}, {w[:-1]: n for w, n in pos.items() if w.endswith("+")})
    learned = there | {f"{w}+": v for w, v in repeated.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(learned)
        for pdf in batches:
            out = pd.DataFrame([scorer.features(t) for t in pdf["text"]], columns=["a", "b", "c", "d"])
            out["doc_id"], out["toxic"] = pdf["doc_id"].values, pdf["toxic"].values
            yield out

    found_ = rows.mapInPandas(run, "a double, b double, c double, d double, doc_id long, toxic int")
    # of several rows of one doc_id the least features count; numbers of at most train_rows documents
    table = found_.groupBy("doc_id", "toxic").agg(F.min(F.struct("a", "b", "c", "d")).alias("x")).select("x.*", "toxic", "doc_id").orderBy("doc_id", "toxic").toPandas()
    return Model(learned, tuple(fit_logistic(table[["a", "b", "c", "d"]].to_numpy(), table["toxic"].to_numpy(float)).tolist()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, predicted`` for every row; null and empty texts get the score of no match."""

    def work(texts: list[str]):
        s = model.scores(texts)
        return s, (s >= 0.5).astype("int32")

    return map_texts(docs, {"score": "double", "predicted": "int"}, lambda: work)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic; null texts are empty ones."""
    return keep_rows(docs, lambda: lambda texts: model.scores(texts) < 0.5)


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", 5) != 0)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, train_labels(read(spark, sf_dir, "labels"))))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
