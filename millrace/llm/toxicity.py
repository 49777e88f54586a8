"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters of other scripts and digits that stand for letters to
plain letters, and turns punctuation into blanks. Lexicon terms are whole words or beginnings of
words. A term has one weight for standing in a text and another for being frequent in it by the
text's length; the weights come from boosting over labelled texts, so that a term which only repeats
what others already explain gets little. A match inside an exception phrase doesn't count. A text's
sum of weights, once as it is and once by its length, goes through a logistic function.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ɡ": "g",
    "ı": "i", "ℓ": "l",
}
# Digits and signs that stand for a letter inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}

_BLANKS = {chr(c): " " for c in range(128) if not chr(c).isalnum()}
_WIDE = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_DROPPED = dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad")
_TABLE = str.maketrans({**{k: DIGITS.get(v, v).lower() for k, v in _WIDE.items()}, **_BLANKS, **LOOK_ALIKES, **DIGITS, **_DROPPED})
_SIGN = re.compile(r"(?<=\w)[@$!|](?=\w)")
#: Lengths of the beginnings of words that may become entries.
PREFIXES = range(3, 9)
#: What part of its step a round takes: texts with one entry still ask for others.
RATE = 0.3
#: Longer words are known by their first letters.
LONGEST = 24


def fold(text: str) -> str:
    """``text`` as folded words between single blanks, with a blank at either end."""
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text.lower())
    return f" {' '.join(text.translate(_TABLE).split())} "


#: A term is frequent in a text that has it so many times at least, and so often in a thousand words.
FREQUENT, FREQUENT_PER_1000 = 2, 8
#: Marks the weight of a term's frequency.
OFTEN = "#"


def frequent(count: int, n_words: int) -> bool:
    return count >= FREQUENT and 1000 * count >= FREQUENT_PER_1000 * n_words


@dataclass
class Lexicon:
    """``weights``: " word " is a whole word, " beg" the beginning of one, and either with ``OFTEN``
    behind it the term's frequency. ``exceptions``: folded phrases. ``logistic``: the factors of the
    two features, and the constant."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    logistic: tuple[float, float, float] = (0.0, 0.0, -4.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        """Values: term, weights of standing there and of frequency; of a phrase its length and None."""
        found = ahocorasick.Automaton()
        for term in {t.removesuffix(OFTEN) for t in self.weights}:
            found.add_word(term, (term, self.weights.get(term, 0.0), self.weights.get(term + OFTEN, 0.0)))
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None, None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """Log of the weights that a text gets, and of those of all its matches by its length."""
    if automaton is None:
        return 0.0, 0.0
    folded = fold(text)
    found = list(automaton.iter(folded))
    if not found:
        return 0.0, 0.0
    # Phrases by where they begin, with the furthest end of any that begins there or before.
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((end - len(term) + 1, end) for end, (term, w, _) in found if w is None):
        starts.append(start)
        ends.append(max(end, ends[-1]) if ends else end)
    counts: Counter = Counter()
    for end, value in found:
        if value[1] is not None:
            k = bisect_right(starts, end - len(value[0]) + 1)
            if not k or ends[k - 1] < end:
                counts[value] += 1
    n_words, total, every = folded.count(" ") - 1, 0.0, 0.0
    for (_, there, often), n in counts.items():
        w = there + (often if frequent(n, n_words) else 0.0)
        total += w
        every += n * w
    return float(np.log1p(total)), float(np.log1p(1000 * every / (n_words + 20)))


def score_of(x: tuple[float, float], logistic: tuple[float, float, float]) -> float:
    z = x[0] * logistic[0] + x[1] * logistic[1] + logistic[2]
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def candidates(folded: str) -> set[str]:
    """Each word of a folded text as a whole and by its beginnings, and with ``OFTEN`` what is frequent."""
    words = folded.split()
    counts: Counter = Counter()
    for w, n in Counter(words).items():
        if len(w) >= 3 and not w.isdigit():
            if len(w) <= LONGEST:
                counts[f" {w} "] += n
            for k in PREFIXES:
                if k <= len(w):
                    counts[f" {w[:k]}"] += n
    return {*counts, *(t + OFTEN for t, n in counts.items() if frequent(n, len(words)))}


def boost(postings: dict[str, np.ndarray], labels: np.ndarray, rounds: int) -> dict[str, float]:
    """Weights of entries by boosting with stumps that abstain where their entry is absent.

    Each round takes the entry that most lowers the exponential loss, the toxic and the clean texts
    weighing the same at the start, while an entry explains what about a text weighs. Entries that
    ten toxic texts have and that are thirty times as frequent there go on to be taken for less:
    they are sure to tell, even if every text that has one is explained by others already.
    """
    terms = sorted(postings)
    if not terms or not labels.any() or labels.all():
        return {}
    which = np.concatenate([np.full(len(postings[t]), i) for i, t in enumerate(terms)])
    texts = np.concatenate([postings[t] for t in terms])
    weight = np.where(labels, 0.5 / labels.sum(), 0.5 / (~labels).sum())
    smooth = 0.5 * weight.min()
    least = 1.5 * 0.5 / labels.sum()
    out: dict[str, float] = {}
    # Of entries with equal gains the shorter one goes first: it also covers words not seen here.
    favour = 1 - 1e-6 * np.array([len(t) for t in terms])
    n_bad, n_good = (np.bincount(which[labels[texts] == b], minlength=len(terms)) for b in (True, False))
    strong = (n_bad >= 10) & (n_bad * (~labels).sum() >= 30 * n_good * labels.sum())
    strong_only, fresh = False, np.ones(len(terms))
    for _ in range(rounds):
        bad = np.bincount(which, np.where(labels[texts], weight[texts], 0), len(terms))
        good = np.bincount(which, np.where(labels[texts], 0, weight[texts]), len(terms))
        gain = np.where(bad > good, (np.sqrt(bad) - np.sqrt(good)) ** 2, 0) * favour * fresh
        if not strong_only and gain.max() < least / (4 if out else 1):
            strong_only = True
        top = int(np.argmax(gain * strong if strong_only else gain))
        if strong_only and gain[top] * strong[top] < least / 1000:
            break
        alpha = RATE * 0.5 * float(np.log((bad[top] + smooth) / (good[top] + smooth)))
        out[terms[top]], fresh[top] = alpha, 0
        hit = postings[terms[top]]
        weight[hit] *= np.where(labels[hit], np.exp(-alpha), np.exp(alpha))
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float, float]:
    """Newton steps for two factors and a constant, both classes weighing as much as they count."""
    a = np.column_stack([x, np.ones(len(x))])
    beta = np.array([0.0, 0.0, -2.0])
    penalty = ridge * len(a) * np.array([1, 1, 0.1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (p - y) + penalty * beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(id_col) -> F.Column:
    """True for a fifth of the ids, which learning never sees."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def learn(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, min_texts: int = 3, rounds: int = 300, exceptions: tuple[str, ...] = ()
) -> Lexicon:
    """A lexicon from the rows of ``labels`` (doc_id, toxic) that aren't held out.

    At most ``sample_rows`` of them are taken, by a hash of their id; of rows with equal ids one text
    is taken, and equal texts count once. ``exceptions`` are phrases known from elsewhere.
    Null labels and labels without a document are left out; contradicting ones count as toxic. With
    no toxic or no clean text the lexicon is empty and every text gets the same low score.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in known.collect()], "doc_id long, toxic int")
    # As many rows as the sample has: a bounded broadcast.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a text has thousands of candidates
                some = batch.slice(at, 64)
                found = pa.array([sorted(candidates(fold(t.as_py()))) for t in some.column("text")], pa.list_(pa.string()))
                toxic = pa.array([x.as_py() > 0 for x in some.column("toxic")], pa.bool_())
                yield pa.record_batch([some.column("key"), toxic, found], ["key", "toxic", "terms"])

    texts = texts.withColumn("key", F.xxhash64("text")).groupBy("doc_id").agg(F.min(F.struct("key", "text")).alias("t"), F.max("toxic").alias("toxic"))
    texts = texts.groupBy("t.key").agg(F.min("t.text").alias("text"), F.max("toxic").alias("toxic"))
    found = texts.mapInArrow(terms, "key long, toxic boolean, terms array<string>").persist()
    try:
        each = found.select("key", "toxic", F.explode("terms").alias("term"))
        counts = each.groupBy("term").agg(F.count_if("toxic").alias("bad"), F.count_if(~F.col("toxic")).alias("good"))
        size = found.groupBy("toxic").count().collect()
        n = {r["toxic"]: r["count"] for r in size}
        n_bad, n_good = n.get(True, 0), n.get(False, 0)
        if not n_bad or not n_good:
            return Lexicon(exceptions=tuple(fold(e) for e in exceptions))
        # An entry must be at least three times as frequent in toxic texts as in clean ones.
        counts = counts.where((F.col("bad") >= min_texts) & (F.col("bad") * n_good >= 3 * F.col("good") * n_bad))
        pairs = each.join(counts.select("term"), "term").groupBy("term").agg(F.collect_set("key").alias("keys")).collect()
        keys = {r["key"]: bool(r["toxic"]) for r in found.groupBy("key").agg(F.max("toxic").alias("toxic")).collect()}
    finally:
        found.unpersist()
    place = {k: i for i, k in enumerate(keys)}
    marks = np.array(list(keys.values()), bool)
    postings = {r["term"]: np.array([place[k] for k in r["keys"]]) for r in pairs if len(r["keys"]) >= min_texts}
    lexicon = Lexicon(boost(postings, marks, rounds), tuple(fold(e) for e in exceptions))
    lexicon.exceptions += learn_exceptions(texts, lexicon)
    automaton_of = lexicon.automaton

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for batch in batches:
            x = [features(t, automaton) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array([float(f[0]) for f in x]), pa.array([float(f[1]) for f in x]), batch.column("toxic")], ["a", "b", "toxic"])

    rows = np.array([tuple(r) for r in texts.mapInArrow(measure, "a double, b double, toxic int").collect()], float)
    lexicon.logistic = fit_logistic(rows[:, :2], (rows[:, 2] > 0).astype(float))
    return lexicon


def learn_exceptions(texts: DataFrame, lexicon: Lexicon, min_texts: int = 3) -> tuple[str, ...]:
    """Matches with the word before or after them that ``min_texts`` clean texts have and no toxic one."""
    automaton_of = lexicon.automaton

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        seen: Counter = Counter()
        for batch in batches if automaton is not None else ():
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, own = fold(text), set()
                for end, (term, w, _) in automaton.iter(folded):
                    if w is None:
                        continue
                    at, stop = end - len(term) + 1, folded.index(" ", max(end, end - len(term) + 2))
                    if (before := folded.rfind(" ", 0, at)) >= 0:
                        own.add(folded[before : stop + 1])
                    if (after := folded.find(" ", stop + 1)) >= 0:
                        own.add(folded[at : after + 1])
                seen.update((phrase, toxic > 0) for phrase in own)
        rows = list(seen.items())
        yield pa.record_batch(
            [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int64())],
            ["phrase", "toxic", "n"],
        )

    found = texts.mapInArrow(contexts, "phrase string, toxic boolean, n long").groupBy("phrase")
    found = found.agg(F.sum(F.when(F.col("toxic"), F.col("n"))).alias("bad"), F.sum(F.when(~F.col("toxic"), F.col("n"))).alias("good"))
    return tuple(sorted(r["phrase"] for r in found.where(f"bad is null and good >= {min_texts}").collect()))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score and predicted (1 from a score of 0.5 on).

    Null is the empty text; it and texts without a match get the score of no match. Whole texts are
    read, so a long text costs in proportion. Extra columns are left behind."""
    automaton_of, logistic = lexicon.automaton, lexicon.logistic

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        for batch in batches:
            s = [score_of(features(t.as_py(), automaton), logistic) for t in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs``, with all its columns, whose text scores under 0.5.

    The score is added to the rows as they stream through, so repeated or null ids do no harm."""
    automaton_of, logistic = lexicon.automaton, lexicon.logistic
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of()
        at = names.index("text")
        for batch in batches:
            good = [score_of(features(t.as_py() or "", automaton), logistic) < 0.5 for t in batch.column(at)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
