"""Language identification by string kernels.

The kernel of two texts is the number of n-grams of characters (all lengths 1 to ``MAX_N``: the blended spectrum)
that both contain, divided by the root of the numbers that each contains, so that it is 1 for equal sets. A Nyström map over landmark texts turns it into finite
features, on which kernel ridge regression is fitted one language against the rest. For scoring, the landmark
matrix, the Nyström factor and the ridge weights are multiplied once, which leaves one product of a batch's
sparse presence matrix with one column for each language: the same scores, without ever forming the kernel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import byte_view, chunks, hash_cut, mix

MAX_N = 4
#: The bound of the labelled sample that the classifier is fitted on: texts of each language, of which so many are landmarks.
SAMPLE_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 256, 64
#: Hashed n-grams; those of no landmark cost nothing in scoring.
BUCKETS_LOG2 = 18
BUCKETS = 1 << BUCKETS_LOG2
RIDGE = 1e-2
#: A text is rejected when its best score leads the next by less than this or it has fewer distinct landmark n-grams than that.
MIN_LEAD, MIN_GRAMS = 0.03, 2
UNKNOWN = "und"
_CHARS = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram of characters that a text has, each once, in order of text and bucket.

    Texts are lower-cased and runs of anything but letters become one space, so that symbols and layout do
    not speak for a language. Characters beyond ASCII count as letters.
    """
    raw, off = byte_view(pc.utf8_lower(pc.fill_null(texts, "")))
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    # offsets in characters: bytes that go on with a character do not count
    off = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[off]
    letter = ((code >= 97) & (code <= 122)) | (code >= 128)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[off[:-1][off[:-1] < len(code)]] = True
    char = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(off))[keep]
    h, found = np.zeros(len(char), np.uint64), []
    for size in range(1, MAX_N + 1):
        m = len(char) - size + 1
        if m <= 0:
            break
        h = h[:m] * _CHARS + char[size - 1 :]
        ok = doc[:m] == doc[size - 1 :]
        found.append(doc[:m][ok] << np.uint64(BUCKETS_LOG2) | mix(h[ok] + np.uint64(size)) >> np.uint64(64 - BUCKETS_LOG2))
    key = np.sort(np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])].astype(np.int64)
    return key >> BUCKETS_LOG2, key & (BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    #: BUCKETS -> column of the landmark n-grams, or -1.
    column: np.ndarray
    #: (columns, languages): landmark matrix x Nyström factor x ridge weights.
    weights: np.ndarray
    bias: np.ndarray

    def presence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, column) of the landmark n-grams of each text, how many of them it has, and how many n-grams at all."""
        d, b = grams(texts)
        c = self.column[b]
        ok = c >= 0
        return d[ok], c[ok], np.bincount(d[ok], minlength=len(texts)), np.bincount(d, minlength=len(texts))

    def dense(self, texts: pa.Array) -> np.ndarray:
        """Presence matrix of the landmark n-grams, each row divided by the length of the text's whole presence vector."""
        d, c, _, every = self.presence(texts)
        x = np.zeros((len(texts), len(self.weights)), np.float32)
        x[d, c] = 1
        return x / np.sqrt(np.maximum(every, 1))[:, None].astype(np.float32)

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Product of the texts' sparse presence matrix and the weights, and how many landmark n-grams each has."""
        d, c, count, every = self.presence(texts)
        out = np.zeros((len(texts), self.weights.shape[1]), np.float64)
        some = np.flatnonzero(count)
        if len(some):
            out[some] = np.add.reduceat(self.weights[c], np.searchsorted(d, some), axis=0)
        return out / np.sqrt(np.maximum(every, 1))[:, None] + self.bias, count


def fit(texts: list[str], labels: list[str], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Fit on labelled texts in the order given; the first of each language are the landmarks."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    at = np.concatenate([np.flatnonzero(y == k)[:landmarks_per_language] for k in range(len(languages))])
    column = np.full(BUCKETS, -1, np.int64)
    used = np.unique(grams(pa.array([texts[i] for i in at], pa.string()))[1])
    column[used] = np.arange(len(used))
    model = Model(languages, column, np.zeros((len(used), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    # only the landmarks' rows are held; the others pass by in blocks
    land = np.concatenate([model.dense(pa.array([texts[i] for i in at[j : j + 64]], pa.string())) for j in range(0, len(at), 64)])
    kernel = np.concatenate([model.dense(pa.array(texts[i : i + 64], pa.string())) @ land.T for i in range(0, len(texts), 64)])
    k_mm = (land @ land.T).astype(np.float64)
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-8 * max(value.max(), 1e-12)
    nystrom = vector[:, good] / np.sqrt(value[good])
    phi = kernel.astype(np.float64) @ nystrom
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = 1 / np.bincount(y, minlength=len(languages))[y]
    phi1 = np.hstack([phi, np.ones((len(phi), 1))])
    gram = phi1.T @ (phi1 * weight[:, None]) / len(languages)
    penal = np.eye(len(gram)) * ridge / len(languages)
    penal[-1, -1] = 0
    solved = np.linalg.lstsq(gram + penal, phi1.T @ (target * weight[:, None]) / len(languages), rcond=None)[0]
    model.weights = (land.T @ (nystrom @ solved[:-1]).astype(np.float32)).astype(np.float32)
    model.bias = solved[-1].astype(np.float32)
    return model


def labelled_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text, lang) of up to ``per_language`` rows of each language, those of least hash of (doc_id, text).

    The cut-off of the hash is set from the counts of languages, so that ranking touches few rows however many there are. Languages are taken
    to be few: the counts, the sample and the model have an entry for each.
    """
    named = docs.where("lang is not null and text is not null and trim(text) <> ''").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = named.groupBy("lang").count().collect()
    if not counts:
        return []
    cut = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(hash_cut(2 * per_language, r["count"])))])
    few = named.where(F.col("h") <= cut[F.col("lang")])
    ranked = few.selectExpr("lang", "text", "row_number() over (partition by lang order by h, text) as r").where(F.col("r") <= per_language)
    return [(r["text"], r["lang"]) for r in ranked.orderBy("lang", "r").collect()]


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, min_lead: float = MIN_LEAD) -> DataFrame:
    """All rows of ``docs(doc_id, text, lang, ...)`` with ``pred_lang``, ``lang_score`` and ``lang_kept`` added.

    ``lang`` holds the labels of the sample that the model is fitted on; rows without it are scored alike.
    Null, empty and letterless texts, and texts whose two best scores are closer than ``min_lead``, get ``und`` and are not
    kept; with ``min_lead`` 0 ties go to the language that sorts first. Long texts are scored whole; repeated rows, and texts of one id, are scored each,
    and ids may be of any type. Other columns pass through, columns of the three names are replaced; without any label every row is ``und``, and an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.drop("pred_lang", "lang_score", "lang_kept")
    sample = labelled_sample(docs, per_language)
    if not sample:
        return docs.withColumns({"pred_lang": F.lit(UNKNOWN), "lang_score": F.lit(0.0), "lang_kept": F.lit(False)})
    shared = spark.sparkContext.broadcast(fit([t for t, _ in sample], [x for _, x in sample]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNKNOWN])
        for batch in batches:
            for part in chunks(batch, max_bytes=1 << 20):
                s, count = model.scores(part.column("text"))
                best = s.argmax(1)
                top = s[np.arange(len(s)), best]
                lead = top - np.partition(s, -2, 1)[:, -2] if s.shape[1] > 1 else np.full(len(s), np.inf)
                kept = (lead >= min_lead) & (count >= MIN_GRAMS)
                out = names[np.where(kept, best, len(names) - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out.tolist(), pa.string()), pa.array(np.where(count > 0, np.round(top, 6), 0.0)), pa.array(kept)], [*part.schema.names, "pred_lang", "lang_score", "lang_kept"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema) + "pred_lang string, lang_score double, lang_kept boolean"
    return docs.mapInArrow(score, schema)
