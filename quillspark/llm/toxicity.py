"""Toxicity by weak supervision.

Voters look for lexicon words and patterns; each says toxic (1), clean (-1) or nothing (0). The combinations of votes are counted
over all documents. A generative model fitted to these counts by expectation-maximisation gives each voter's behaviour
for toxic and for clean texts, without any label. Voters that still agree beyond what the class explains are
correlated, and count less in proportion. The posterior labels of a bounded sample train a linear classifier on words
and on the voters' counts, which scores everything.

Beside the built-in English lexicons stands one that is induced, for whatever languages the corpus has, from a bounded sample of
labelled rows: words and beginnings of words that are far commoner in texts labelled toxic. Its voters are only some among the others; the
generative model decides what they are worth.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import Words, chunks, hash_cut, hash_words, member, prefixes, words

INSULTS = "idiot idiots idiotic moron morons moronic loser losers clown clowns stupid dumb dumbass fool fools imbecile imbeciles jerk jerks dimwit dunce cretin halfwit numbskull nitwit simpleton".split()
CONTEMPT = "trash scum pathetic worthless disgusting garbage filth filthy vermin parasite parasites subhuman repulsive revolting despicable loathsome lowlife degenerate".split()
PROFANITY = "fuck fucking fucked fucker shit shitty bullshit bitch bitches bastard bastards asshole assholes crap damn bollocks wanker prick twat".split()
SECOND_PERSON = "you your yours youre yourself u ur".split()
THREAT = r"\b(kill|hurt|destroy|beat) (you|yourself|them all)\b|\bgo (die|to hell)\b|\bhope you (die|suffer|rot)\b|\bshut up\b"
DISGUISED = r"\b(1d[i1][o0]t|id10t|[i1]di0t|st[*@]p[i1*]d|stup1d|m[o0*]r[0*]n|m0ron|l[0*]ser|tr[@*4]sh|sc[*@]m|cl[0*]wn|p[@4*]thetic|w[0*]rthless|f[*@]ck|sh[*1]t|b[*1]tch)\b"
NAMES = ("insult", "contempt", "profanity", "threat", "disguised", "addressed", "several", "dense", "none", "sparse", "induced", "induced_several", "induced_dense", "induced_few")
#: Counts that the classifier sees beside words: hits of the built-in and of the induced lexicon, and how dense they are.
COUNTS = 6

#: The bound of the labelled sample (rows of least hash of their ids) that the lexicon is induced from; prefixes by bytes; how many times
#: commoner a word or prefix must be in toxic texts, in how many of them it must be, and how sure its excess.
INDUCTION_DOCUMENTS, PREFIXES, LEAST_LIFT, LEAST_TEXTS, LEAST_INDUCED_Z = 8000, range(3, 13), 12.0, 6, 5.0
#: The bound of the sample that the classifier is trained on (documents of least hash of their ids), and its features.
TRAINING_DOCUMENTS, FEATURES, LEAST_Z = 8000, 1024, 4.0  # of the words that tell the classes apart, those that do so best
BUCKETS_LOG2 = 20
THRESHOLD = 0.5


def _flags(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` of each text's words."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


_SETS = [np.sort(hash_words(s)) for s in (INSULTS, CONTEMPT, PROFANITY)]
_YOU = np.sort(hash_words(SECOND_PERSON))


def induced_hits(texts: pa.Array, w: Words, lexicon: np.ndarray) -> np.ndarray:
    """Words of each text that are, or begin as, an entry of the (sorted) lexicon."""
    hit = member(w.hashes, lexicon) >= 0
    if len(lexicon):
        for at, h in prefixes(texts, PREFIXES):
            hit[at[member(h, lexicon) >= 0]] = True
    return _flags(hit, w.first)


def tally(texts: pa.Array, w: Words, lexicon: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Words that each built-in lexicon has, how many in each text, hits of the induced lexicon, and the COUNTS of the classifier."""
    hits = [member(w.hashes, s) >= 0 for s in _SETS]
    counts = [_flags(h, w.first) for h in hits]
    total, found, some = sum(counts), induced_hits(texts, w, lexicon), np.maximum(np.diff(w.first), 1)
    dense = [(x >= 2) & (x * 200 >= some) for x in (total, found)]
    return hits, counts, found, np.stack([np.log1p(total), np.minimum(total / some * 50, 1), dense[0], np.log1p(found), np.minimum(found / some * 50, 1), dense[1]], 1)


def votes(texts: pa.Array, w: Words, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, voters) of -1, 0 and 1, and (texts, COUNTS) of the counts for the classifier."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    hits, counts, found, for_classifier = tally(texts, w, lexicon)
    n = np.diff(w.first)
    out = np.zeros((len(texts), len(NAMES)), np.int8)
    for j, c in enumerate(counts):
        out[:, j] = c > 0
    out[:, 3] = np.asarray(pc.match_substring_regex(low, THREAT))
    out[:, 4] = np.asarray(pc.match_substring_regex(low, DISGUISED))
    any_hit = hits[0] | hits[1] | hits[2]
    at = np.flatnonzero(any_hit)
    doc = np.searchsorted(w.first, at, "right") - 1
    you = np.concatenate([[0], np.cumsum(member(w.hashes, _YOU) >= 0)])
    near = you[at] - you[np.maximum(at - 4, w.first[doc])] > 0
    out[np.unique(doc[near]), 5] = 1
    total = sum(counts)
    out[:, 6] = total >= 2
    out[:, 7] = total * 200 >= np.maximum(n, 1)
    silent = (total == 0) & (out[:, 3] == 0) & (out[:, 4] == 0)
    out[silent, 8] = -1
    out[(total <= 1) & (n >= 400), 9] = -1
    some = np.maximum(n, 1)
    # one such word may be chance: only several speak
    out[:, 10] = found >= 2
    out[:, 11] = (found >= 2) & (found * 200 >= some)
    out[:, 12] = (found >= 3) & (found * 80 >= some)
    out[found <= 1, 13] = -1
    return out, for_classifier


def encode(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def decode(codes: np.ndarray, voters: int = len(NAMES)) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(voters) % 3 - 1).astype(np.int8)


@dataclass
class LabelModel:
    prior: float
    #: Log of p(vote | class): (2 classes, voters, 3 votes).
    log_p: np.ndarray
    #: Correlation of each two voters given the class.
    correlation: np.ndarray
    weight: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        at = v.astype(np.int64) + 1
        voters = np.arange(v.shape[1])
        log = [(self.log_p[c][voters, at] * self.weight).sum(1) for c in (0, 1)]
        z = log[1] - log[0] + np.log(self.prior) - np.log1p(-self.prior)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def excess_correlation(v: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How far each two voters agree beyond what one common cause explains.

    Under one cause, correlations are products of the voters' loadings, and each triple of voters gives an estimate of a squared loading;
    the median of these is not misled by a few dependent pairs.
    """
    n = max(count.sum(), 1)
    centred = v - (v * count[:, None]).sum(0) / n
    cov = (centred * count[:, None]).T @ centred / n
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    c = np.abs(cov / sd[:, None] / sd[None])
    np.fill_diagonal(c, 0)
    loading = np.zeros(len(c))
    for i in range(len(c)):
        j, k = np.triu_indices(len(c), 1)
        ok = (j != i) & (k != i) & (c[j, k] > 1e-6)
        if ok.any():
            loading[i] = min(1.0, np.sqrt(np.median(c[i, j[ok]] * c[i, k[ok]] / c[j[ok], k[ok]])))
    out = np.maximum(0, c - np.outer(loading, loading))
    np.fill_diagonal(out, 0)
    return out


def fit_labels(v: np.ndarray, count: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation-maximisation over distinct vote vectors with their counts, from the weighted majority on.

    A voter's weight is the inverse of one plus its correlations with the others: at first those that no common cause explains, and after
    each ten rounds the greater of these and of the correlations given the class, estimated anew.
    """
    n = count.sum()
    one_hot = np.stack([v == x for x in (-1, 0, 1)], 2).astype(float)
    excess = excess_correlation(v.astype(float), count)
    weight = 1 / (1 + excess.sum(1))
    post = np.clip(0.5 + (v * weight).sum(1) / (2 * max(1.0, weight.sum()) ** 0.5), 0.02, 0.98)
    corr = np.eye(v.shape[1])
    model = None
    for r in range(rounds):
        log_p = np.empty((2, v.shape[1], 3))
        for c, share in enumerate((1 - post, post)):
            mass = (one_hot * (share * count)[:, None, None]).sum(0) + np.array([0.5, 1.0, 0.5])
            log_p[c] = np.log(mass / mass.sum(1, keepdims=True))
        prior = float(np.clip((post * count).sum() / max(n, 1), 1e-4, 0.5))
        model = LabelModel(prior, log_p, corr, weight)
        post = model.posterior(v)
        if r % 10 == 9:
            values = np.exp(log_p) @ np.array([-1.0, 0.0, 1.0])
            resid = np.stack([v - values[0], v - values[1]])
            share = np.stack([(1 - post) * count, post * count]) / max(n, 1)
            cov = np.einsum("cp,cpi,cpj->ij", share, resid, resid)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = cov / sd[:, None] / sd[None]
            weight = 1 / (1 + np.maximum(np.abs(corr - np.diag(np.diag(corr))), excess).sum(1))
    return model


@dataclass
class Classifier:
    #: Sorted feature buckets, their weights, and the constant.
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    count_weights: np.ndarray
    lexicon: np.ndarray

    def logit(self, w: Words, counts: np.ndarray) -> np.ndarray:
        b = (w.hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
        f = member(b, self.buckets)
        at = np.flatnonzero(f >= 0)
        key = np.unique((np.searchsorted(w.first, at, "right") - 1) * len(self.buckets) + f[at]) if len(at) else np.empty(0, np.int64)
        out = self.bias + counts @ self.count_weights
        if len(key):
            out += np.bincount(key // len(self.buckets), self.weights[key % len(self.buckets)], minlength=len(out))
        return out


def train(features: list[np.ndarray], counts: np.ndarray, target: np.ndarray, lexicon: np.ndarray, features_bound: int = FEATURES, rounds: int = 600, l1: float = 5e-4) -> Classifier:
    """Logistic regression with an L1 penalty on the words that tell the classes apart and on the counts, by accelerated proximal gradients."""
    if not len(features):
        return Classifier(np.empty(0, np.int64), np.empty(0), -20.0, np.zeros(COUNTS), lexicon)
    doc = np.repeat(np.arange(len(features)), [len(f) for f in features])
    flat = np.concatenate(features) if len(doc) else np.empty(0, np.int64)
    n = np.bincount(flat, minlength=1 << BUCKETS_LOG2)
    share = float(np.clip(target.mean(), 1e-4, 1 - 1e-4))
    a = np.bincount(flat, target[doc], minlength=1 << BUCKETS_LOG2)
    z = np.abs(a - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    z[n < 3] = 0
    good = np.flatnonzero(z >= LEAST_Z)
    good = np.sort(good[np.argsort(-z[good], kind="stable")[:features_bound]])
    f = member(flat, good)
    x = np.zeros((len(features), len(good) + COUNTS), np.float32)
    x[doc[f >= 0], f[f >= 0]] = 1
    x[:, len(good) :] = counts
    importance = np.where(target >= 0.5, 0.5 / share, 0.5 / (1 - share))
    importance /= importance.sum()
    w, b, v, vb, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    lip = 0.25 * float((((x**2).sum(1) + 1) * importance).sum()) + 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32) + vb, -50, 50)))
        r = (p - target) * importance
        step = v - (r.astype(np.float32) @ x) / lip
        new = np.sign(step) * np.maximum(np.abs(step) - l1 / lip, 0)
        new_b = vb - r.sum() / lip
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return Classifier(good, w[: len(good)], float(b), w[len(good) :], lexicon)


def induced_lexicon(docs: DataFrame, labels: DataFrame, bound: int = INDUCTION_DOCUMENTS) -> np.ndarray:
    """Lexicon from at most ``bound`` labelled rows; their ids are few, so they are broadcast to the texts."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.withColumn("h", F.xxhash64("doc_id"))
    few = marks.where(F.col("h") <= hash_cut(bound, marks.count())).orderBy("h", "doc_id").limit(bound)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                doc = w.doc
                found: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
                for at, h in [(np.arange(len(w.hashes)), w.hashes), *prefixes(part.column("text"), PREFIXES)]:
                    cuts = np.searchsorted(doc[at], np.arange(part.num_rows + 1))
                    for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        found[d].append(np.unique(h[a:b]))
                yield pa.RecordBatch.from_arrays([part.column("toxic").cast(pa.int32()), pa.array([np.concatenate(x).tobytes() for x in found], pa.binary())], ["toxic", "prefixes"])

    # the lift needs each prefix's counts only, and those of rare prefixes are dropped before they reach the driver
    texts = docs.join(F.broadcast(few.select("doc_id", "toxic")), "doc_id").select("text", "toxic")
    sets = texts.mapInArrow(collect, "toxic int, prefixes binary")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toxic, p in zip(batch.column("toxic").to_pylist(), batch.column("prefixes").to_pylist(), strict=True):
                h = np.frombuffer(p, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), int(toxic > 0), np.int64))], ["h", "toxic"])

    sizes = texts.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("bad")).first()
    if not sizes["bad"] or sizes["bad"] == sizes["n"]:
        return np.empty(0, np.uint64)
    counted = sets.mapInArrow(spread, "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    share = sizes["bad"] / sizes["n"]
    z = (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    lift = ((F.col("bad") + 0.5) / (sizes["bad"] + 1)) / ((F.col("n") - F.col("bad") + 0.5) / (sizes["n"] - sizes["bad"] + 1))
    kept = counted.where((F.col("bad") >= LEAST_TEXTS) & (z >= LEAST_INDUCED_Z) & (lift >= LEAST_LIFT)).select("h").collect()
    return np.sort(np.array([r["h"] for r in kept], np.int64).view(np.uint64))


def fit_model(docs: DataFrame, labels: DataFrame | None = None, training_documents: int = TRAINING_DOCUMENTS, induction_documents: int = INDUCTION_DOCUMENTS, features: int = FEATURES) -> tuple[LabelModel, Classifier]:
    """Label model from the votes of all documents, classifier from the bounded sample; ``labels`` only serve to induce a lexicon."""
    lexicon = induced_lexicon(docs, labels, induction_documents) if labels is not None else np.empty(0, np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                v, _ = votes(part.column("text"), words(part.column("text")), shared.value)
                code, n = np.unique(encode(v), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                v, counts = votes(part.column("text"), w, shared.value)
                b = (w.hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)
                body = [np.unique(b[x:y]).tobytes() for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(encode(v)), pa.array([c.tobytes() for c in counts], pa.binary()), pa.array(body, pa.binary())], ["h", "code", "counts", "features"])

    rows = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    total = sum(r["n"] for r in rows)
    model = fit_labels(decode(np.array([r["code"] for r in rows], np.int64)), np.array([r["n"] for r in rows], float))
    near = docs.select("text", F.xxhash64("doc_id").alias("h")).where(F.col("h") <= hash_cut(training_documents, total))
    few = near.mapInArrow(sample, "h long, code long, counts binary, features binary").orderBy("h", "code", "features").limit(training_documents).collect()
    target = model.posterior(decode(np.array([r["code"] for r in few], np.int64))) if few else np.empty(0)
    counts = np.array([np.frombuffer(r["counts"], np.float64) for r in few])
    return model, train([np.frombuffer(r["features"], np.int32).astype(np.int64) for r in few], counts, target, lexicon, features)


def toxicity(docs: DataFrame, labels: DataFrame | None = None, training_documents: int = TRAINING_DOCUMENTS, threshold: float = THRESHOLD, induction_documents: int = INDUCTION_DOCUMENTS, features: int = FEATURES) -> DataFrame:
    """``(doc_id, toxic_score, is_toxic)`` for every row of ``docs(doc_id, text)``; the score is a probability.

    ``labels(doc_id, toxic)`` may be left out, or be empty: then no lexicon is induced; of repeated labels the greatest counts. Null texts and
    texts without words have the score 0; long texts are scored whole. Rows that repeat are scored alike, null ids as any others; ids may be of
    any type. A score equal to ``threshold`` is toxic; ties of hashes in the samples go by id. Extra columns are ignored and an empty table gives
    no rows. ``training_documents`` bounds the sample that the classifier is trained on, ``features`` its words, and ``induction_documents`` the
    labelled rows that the lexicon is induced from; all counts and votes are over all documents.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    shared = spark.sparkContext.broadcast(fit_model(docs, labels, training_documents, induction_documents, features)[1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                *_, counts = tally(part.column("text"), w, model.lexicon)
                p = 1 / (1 + np.exp(-np.clip(model.logit(w, counts), -50, 50)))
                p[np.diff(w.first) == 0] = 0
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p, 6)), pa.array(p >= threshold)], ["doc_id", "toxic_score", "is_toxic"])

    return docs.mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic_score double, is_toxic boolean")
