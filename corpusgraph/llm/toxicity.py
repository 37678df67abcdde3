"""Toxicity scores by weak supervision.

Voters of three kinds look at a text: public lexicons of insults, profanity and threats; regular
patterns (an insult with its target, shouting, masked letters, threats); and families of words and
word beginnings that labelled rows show to be toxic.  Labels choose those families and give the
voters' rates a starting point; they are no voter.  A generative label model over one hidden label
estimates each voter's rates in either class and how voters' errors correlate, from the votes on
all documents.  A linear classifier is trained on its posterior labels and scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.simhash import MAX_DISTANCE, fingerprint
from corpusgraph.plans.scratch import materialize

#: Labelled rows from which word families are learned, at most (drawn by a hash of doc_id).
MAX_LABELLED = 16_000
#: Rows, labelled or not, that the linear classifier is trained on, about (drawn by a hash of the text).
MAX_TRAINING = 16_000
#: The toxic rows (near copies once) in which a learned entry must occur, at any size.
MIN_DOCS = 4
#: The share of learned entries that may be toxic rows' by accident.
FALSE_SHARE = 0.05
PREFIXES = (3, 4, 5, 6)
#: Public lexicons, in English, German, French and Spanish; fixed values.
LEXICONS = {
    "intellect": frozenset("idiot idiots moron morons stupid dumb fool fools imbecile clown clowns dummkopf trottel blödmann crétin crétins abruti imbécile idiota idiotas imbécil estúpido estúpida tonto".split()),
    "worth": frozenset("loser losers scum trash garbage pathetic worthless disgusting filth vermin pig ugly freak jerk abschaum versager widerlich ordure racaille minable basura asqueroso escoria".split()),
    "profanity": frozenset("damn shit fuck fucking bitch bastard asshole whore slut crap scheiße arschloch merde putain connard salope mierda puta cabrón".split()),
    "threat": frozenset("kill kills hurt stab shoot strangle hate hates töten hasse tuer déteste matar odio".split()),
}
_LEXICON = {w: i for i, words in enumerate(LEXICONS.values()) for w in words}
_INSULTS = frozenset().union(*list(LEXICONS.values())[:3])
_TARGETS = "you|your|youre|u|he|she|they|him|her|them|du|dich|ihr|tu|toi|vous|tú|usted|ustedes"
_TARGETED = re.compile(rf"\b(?:{_TARGETS})\b(?:\W+\w+){{0,3}}?\W+(?:{'|'.join(sorted(_INSULTS))})\b|\b(?:{'|'.join(sorted(_INSULTS))})\W+(?:{_TARGETS})\b")
_SHOUTING = re.compile(r"(?:\b[A-ZÄÖÜÉÈÑ]{3,}[\s,!]+){2,}[A-ZÄÖÜÉÈÑ]{3,}\b")
_MASKED = re.compile(r"(?<![\w*@$!])[a-z]+[*@$!0134][a-z*@$!0134]*[a-z](?!\w)")
_THREAT = re.compile(r"\b(?:i|we)(?:'ll| will| am going to|'m going to|'m gonna| gonna)(?: \w+)? (?:kill|hurt|stab|shoot|strangle)\b")
#: What a sign may stand for in a masked word; fixed values.
_STANDS_FOR = {"*": "[a-z]", "@": "a", "$": "s", "!": "[il]", "0": "o", "1": "[il]", "3": "e", "4": "a"}
PATTERNS = ("targeted", "shouting", "masked", "threatening")
#: Learned families with a voter of their own; all others share one.
N_FAMILIES = 5
N_GROUPS = len(LEXICONS) + N_FAMILIES + 1
N_VOTERS = N_GROUPS + len(PATTERNS) + 3  # two or more words, one hit alone, nothing at all
VOTER_KINDS = {"lexicons": range(len(LEXICONS)), "learned": range(len(LEXICONS), N_GROUPS), "patterns": range(N_GROUPS, N_GROUPS + len(PATTERNS))}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def entries_of(word: str) -> list[str]:
    """The names under which a word can be an entry: itself and its beginnings."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


def _unmask(token: str) -> bool:
    """Whether a word with signs in place of letters is an insult."""
    pattern = re.compile("".join(_STANDS_FOR.get(c, c) for c in token))
    return any(len(w) == len(token) and pattern.fullmatch(w) for w in _INSULTS)


def pattern_votes(text: str, words: Counter) -> list[bool]:
    """One vote of each of PATTERNS; the costly ones look only where a word gives them cause."""
    low = text.lower()
    return [
        not _INSULTS.isdisjoint(words) and bool(_TARGETED.search(low)), bool(_SHOUTING.search(text)),
        any(_unmask(t) for t in set(_MASKED.findall(low))), not LEXICONS["threat"].isdisjoint(words) and bool(_THREAT.search(low)),
    ]


def held_out(key) -> object:
    """Whether a document's label must not be learned from: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def draw_labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """``(text, label)`` of at most MAX_LABELLED labelled rows that are not held out, copies once.

    A label other than 0 and 1 is none; of several labels of a document the greatest counts.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    one = usable.groupBy(F.col(key).alias("_id")).agg(F.max(label).alias("_y"))
    drawn = one.orderBy(F.xxhash64("_id"), "_id").limit(MAX_LABELLED)
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("_key") == F.col("_id")).select("text", F.col("_y").cast("int").alias("label")).dropDuplicates()


def _first_of_copies(fps: np.ndarray, block: int = 256) -> np.ndarray:
    """Fingerprints without another one near them that comes before (at most MAX_LABELLED, in blocks)."""
    fps, keep = np.sort(fps), np.ones(len(fps), bool)
    for i in range(0, len(fps), block):
        near = np.bitwise_count(fps[i : i + block, None] ^ fps[None, : i + block]) <= MAX_DISTANCE
        keep[i : i + block] = ~np.tril(near, i - 1).any(axis=1)
    return fps[keep]


def collapse_copies(sample: DataFrame) -> DataFrame:
    """``(text, label)`` of the sample with one row for a group of near copies of a label."""

    def scan(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], names=["text", "label", "fp"])

    marked = materialize(sample.mapInArrow(scan, "text string, label int, fp long"), "toxic-marked")
    got = marked.select("label", "fp").distinct().collect()
    firsts = [(y, int(fp)) for y in (0, 1) for fp in _first_of_copies(np.array([r["fp"] for r in got if r["label"] == y], np.int64).view(np.uint64)).view(np.int64)]
    kept = sample.sparkSession.createDataFrame(firsts, "label int, fp long")
    return marked.join(F.broadcast(kept), ["label", "fp"]).groupBy("label", "fp").agg(F.min("text").alias("text")).select("text", "label")


def learn_entries(sample: DataFrame) -> list[str]:
    """Words and word beginnings that occur mostly in toxic rows, strongest first.

    Near copies count once.  What must be exceeded is a number of rows and chance, not a share of
    the toxic rows, so words of a rare language are learned from as many rows as those of a common one.
    """

    def count(batches):
        seen = [Counter(), Counter()]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update({e for w in words_of(text) for e in entries_of(w)})
        names = list(seen[0].keys() | seen[1].keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([seen[0][e] for e in part], pa.int64()), pa.array([seen[1][e] for e in part], pa.int64())], names=["entry", "clean", "toxic"])

    rows = materialize(collapse_copies(sample), "toxic-distinct")
    totals = rows.groupBy().agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.count("*").alias("n")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return []
    n1, n0 = totals["toxic"], totals["n"] - totals["toxic"]
    counts = rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = materialize(counts.where(F.col("clean") + F.col("toxic") >= MIN_DOCS), "toxic-counts")
    lift = F.log((F.col("toxic") + 0.5) / n1) - F.log((F.col("clean") + 0.5) / n0)
    worth = lift * F.sqrt("toxic")
    # log of the chance (Chernoff's bound) of so many toxic rows among an entry's, if it had nothing to do with labels
    both = F.col("clean") + F.col("toxic")
    in_clean = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / both * ((n0 + n1) / n0))).otherwise(0.0)
    chance = -(F.col("toxic") * F.log(F.col("toxic") / both * ((n0 + n1) / n1)) + in_clean)
    # a hit must raise the odds twentyfold; of all entries learned, a share of FALSE_SHARE may be by accident (Benjamini and Hochberg)
    good = counts.where((F.col("toxic") >= MIN_DOCS) & (lift > float(np.log(20))))
    # the sample bounds the words, so the entries too
    best = good.select("entry", worth.alias("worth"), chance.alias("chance")).orderBy("chance", "entry").collect()
    tested = max(1, counts.count())
    n_good = max((i for i, r in enumerate(best, 1) if r["chance"] <= np.log(FALSE_SHARE * i / tested)), default=0)
    return [r["entry"] for r in sorted(best[:n_good], key=lambda r: (-r["worth"], r["entry"]))]


def families(entries: list[str]) -> dict[str, int]:
    """Entry -> group: the N_FAMILIES strongest families (entries that begin alike), then all others.

    Entries come strongest first.  Words of the public lexicons have their voters already.
    """
    left = [e for e in entries if e.removeprefix("=") not in _LEXICON]
    weight: Counter = Counter()
    for e in left:
        weight[e.removeprefix("=")[: PREFIXES[0]]] += 1
    order = {f: i for i, (f, _) in enumerate(sorted(weight.items(), key=lambda x: (-x[1], x[0])))}
    return {e: len(LEXICONS) + min(order[e.removeprefix("=")[: PREFIXES[0]]], N_FAMILIES) for e in left}


@dataclass
class Scorer:
    """Learned families, and the linear classifier over counts of the voters' hits."""

    entries: dict[str, int] = field(default_factory=dict)  # entry -> group of its voter
    weights: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES))
    bias: float = 0.0
    kinds: tuple[str, ...] = tuple(VOTER_KINDS)

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Per group distinct words that hit it and log of all hits, pattern votes, sums; and the votes as bits.

        A lexicon votes on a hit, a learned family on two.
        """
        hits, total = [0] * N_GROUPS, [0] * N_GROUPS
        any_words = any_total = 0
        words, lexicons = words_of(text), "lexicons" in self.kinds
        for word, n in words.items():
            groups = {self.entries[e] for e in entries_of(word) if e in self.entries}
            if lexicons and word in _LEXICON:
                groups.add(_LEXICON[word])
            if groups:
                any_words, any_total = any_words + 1, any_total + n
                for g in groups:
                    hits[g] += 1
                    total[g] += n
        patterns = pattern_votes(text, words) if text and "patterns" in self.kinds else [False] * len(PATTERNS)
        x = [*(min(h, 3) for h in hits), *np.log1p(total).tolist(), *map(float, patterns), min(any_words, 1), min(any_words, 2), min(any_words, 4), float(np.log1p(any_total))]
        ballots = [*(n > (g >= len(LEXICONS)) for g, n in enumerate(total)), *patterns, any_words > 1, any_total == 1, not any_words and not any(patterns)]
        return x, sum(1 << i for i, v in enumerate(ballots) if v)


N_FEATURES = 2 * N_GROUPS + len(PATTERNS) + 4


def label_model(up: np.ndarray, weight: np.ndarray, start: np.ndarray, prior: float, abstains: bool = False, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 per row of votes, the voters' rates by class, and correlations of their errors.

    ``up``: which voters fire, one row per pattern of votes; ``weight``: its documents; ``start``:
    rates in classes 0 and 1 to start from, which keep half of the weight, so that the hidden label
    stays the one that they mean, at any number of documents.  A voter that doesn't fire speaks for
    class 0, or for none if it ``abstains`` (one that fires on nothing then speaks for class 0): the
    words of a rare language weigh as much as those of a common one.  Expectation-maximisation; voters
    whose errors correlate share their weight: each one's evidence is divided by the sum of its
    squared error correlations with all voters, itself included.
    """
    n, m = weight.sum(), up.shape[1]
    rates, share, corr = np.clip(start, 1e-4, 1 - 1e-4), np.ones(m), np.eye(m)
    first, post = prior, np.zeros(len(up))
    for _ in range(rounds):
        gain = np.where(up, np.log(rates[1]) - np.log(rates[0]), (np.log(1 - rates[1]) - np.log(1 - rates[0])) * (not abstains))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + gain @ share, -35, 35)))
        if np.abs(new - post).max(initial=0) < 1e-6:
            break
        post = new
        in1, in0 = weight * post, weight * (1 - post)
        rates = np.clip(np.stack([(in0 @ up + (1 - first) * n * start[0]) / (in0.sum() + (1 - first) * n), (in1 @ up + first * n * start[1]) / (in1.sum() + first * n)]), 1e-4, 1 - 1e-4)
        residual = up - (post[:, None] * rates[1] + (1 - post)[:, None] * rates[0])
        scale = np.sqrt(weight @ residual**2 / n) + 1e-9
        corr = ((residual / scale) * weight[:, None]).T @ (residual / scale) / n
        share = 1 / np.maximum(1, (np.clip(corr, -1, 1) ** 2).sum(axis=0))
        prior = float(np.clip((in1.sum() + first * n) / (2 * n), 1e-3, 1 - 1e-3))
    return post, rates, corr


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), a.T @ (weight * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def look(docs: DataFrame, scorer: Scorer, keep: list[str], text: str) -> DataFrame:
    """``keep``, features ``x`` and the votes' bits ``votes`` of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def scan(batches):
        for batch in batches:
            seen = [shared.value.features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array([x for x, _ in seen], pa.list_(pa.float64())), pa.array([v for _, v in seen], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "x", "votes"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(scan, rows.drop("_text").withColumn("x", F.array().cast("array<double>")).withColumn("votes", F.lit(0)).schema)


def _bits(votes: list[int]) -> np.ndarray:
    return (np.array(votes, np.int64)[:, None] >> np.arange(N_VOTERS)) & 1 == 1


def fit(seen_by, docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", kinds: tuple[str, ...] = tuple(VOTER_KINDS)) -> tuple[Scorer, DataFrame]:
    """Word families from labelled rows that are not held out; label model from all votes; classifier.

    ``seen_by(scorer)`` gives the documents as the voters see them (``x``, ``votes``); it is called
    once.  The driver gets the distinct patterns of votes with their counts (2^N_VOTERS at most).
    Without usable labels of both kinds, or without documents, there is nothing to estimate rates
    from: the classifier stays at its starting weights, where a hit of a public lexicon decides.
    """
    sample = materialize(draw_labelled(docs, labels, key, text, label), "toxic-sample")
    scorer = Scorer(families(learn_entries(sample)) if "learned" in kinds else {}, kinds=kinds)
    known = look(sample, scorer, ["label"], "text").groupBy("label", "votes").agg(F.count("*").alias("n")).collect()
    totals = [sum(r["n"] for r in known if r["label"] == y) for y in (0, 1)]
    seen = seen_by(scorer)
    patterns = seen.groupBy("votes").agg(F.count("*").alias("n")).collect()
    if not all(totals) or not patterns:
        scorer.weights[2 * N_GROUPS + len(PATTERNS)], scorer.bias = 4.0, -2.0
        return scorer, seen
    up = _bits([r["votes"] for r in known])
    n = np.array([[r["n"] * (r["label"] == y) for r in known] for y in (0, 1)], float)
    start = (n @ up + np.array([[0.02], [0.5]])) / (n.sum(axis=1) + 1)[:, None]
    prior = totals[1] / sum(totals)
    post, _, _ = label_model(_bits([r["votes"] for r in patterns]), np.array([r["n"] for r in patterns], float), start, prior, abstains=True)
    posterior = dict(zip([r["votes"] for r in patterns], post.tolist(), strict=True))
    share = min(1.0, MAX_TRAINING / sum(r["n"] for r in patterns))
    drawn = F.pmod(F.xxhash64(F.lit("train"), "x", "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    rows = seen.where(drawn).groupBy("x", "votes").agg(F.count("*").alias("n")).collect()
    if rows:
        x = np.array([r["x"] for r in rows])
        scorer.weights, scorer.bias = _logistic(x, np.array([posterior[r["votes"]] for r in rows]), np.array([r["n"] for r in rows], float))
    return scorer, seen


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", kinds: tuple[str, ...] = tuple(VOTER_KINDS)) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per document; scores read the text alone.

    Null and empty texts get the classifier's score of no hits.  A null key counts as the empty
    string where rows are held out.  Very long texts are read whole.  Repeated rows stay, other
    columns don't; an empty table, of documents or of labels, gives a defined result (see ``fit``).
    """
    named = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scorer, seen = fit(lambda s: materialize(look(named, s, ["doc_id"], "text"), "toxic-votes"), docs, labels, key, text, label, kinds)
    weights = F.array(*[F.lit(float(w)) for w in scorer.weights])
    z = F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(float(scorer.bias)), lambda a, b: a + b)
    scored = seen.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), z))))).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
