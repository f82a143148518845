"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier for each bit is learned from byte n-grams: the
log odds of an n-gram in texts of languages whose bit is 1 against the others, and the mean of these
over a text is the bit's margin. Decoding takes the codeword of the least loss, each bit's loss
weighted by how well its classifier separates the training counts; where the two best are close the
text is flagged as ambiguous. With up to five languages the code is exhaustive, else random words of
CODE_BITS bits for each doubling of the languages.

Training reads a bounded sample: about SAMPLE documents of each language at most, drawn by a hash of
the id, counted in BUCKETS hashed n-grams. Every label is a language; each takes a quarter of a megabyte
of the driver and of a training task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map
from .textvec import U, Texts, mix, pieces

SAMPLE, BUCKETS, CODE_BITS = 4000, 1 << 15, 12
ORDERS = (2, 3, 4)
SLICES = 32

#: Bytes as the n-grams see them: A-Z in lower case, all else of ASCII but letters as a space.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[97:123] = np.arange(97, 123)
_SEEN[65:91] = np.arange(97, 123)
_SEEN[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every n-gram of the orders; runs of spaces count as one."""
    b = _SEEN[t.buf]
    doc = np.repeat(np.arange(t.n), t.size + 1)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = b[keep].astype(np.uint64), doc[keep]
    ds, hs = [], []
    for n in ORDERS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h << U(8)) | b[k : k + m]
        same = doc[:m] == doc[n - 1 :]
        ds.append(doc[:m][same])
        hs.append((mix(h[same]) & U(BUCKETS - 1)).astype(np.int64))
    if not ds:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    d, h = np.concatenate(ds), np.concatenate(hs)
    order = np.argsort(d, kind="stable")
    return d[order], h[order]


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each language, a row each; columns split the languages both ways."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng, width, best = np.random.default_rng(seed), CODE_BITS * math.ceil(math.log2(n)), None
    for _ in range(50):  # the draw whose nearest two words are furthest apart
        code = rng.choice([-1.0, 1.0], (n, width))
        code = code[:, np.abs(code.sum(0)) < n]
        near = (code @ code.T - 2 * width * np.eye(n)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1]


def train(docs: DataFrame, doc_id: str, text: str, lang: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
    """Languages, codewords, weights of n-grams by bit, and the bits' weights; None without labels."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    per = known.groupBy(F.col(lang).alias("lang")).count().collect()  # a row a language
    if not per:
        return None
    langs = sorted(r["lang"] for r in per)
    rate = {r["lang"]: min(1.0, SAMPLE / r["count"]) for r in per}
    cut = F.create_map([F.lit(x) for k in langs for x in (k, int(rate[k] * 1_000_000))])[F.col(lang)]
    sample = known.where(F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(1_000_000)) < cut)

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            at = np.array([langs.index(x) for x in b.column(1).to_pylist()], np.int64)
            for i, _, t in pieces(b, "text"):
                d, h = grams(t)
                np.add.at(total, (at[i + d], h), 1)
        parts = total.reshape(len(langs), SLICES, -1)
        rows = [(k, s, parts[k, s].tobytes()) for k in range(len(langs)) for s in range(SLICES) if parts[k, s].any()]
        yield pa.RecordBatch.from_pylist([dict(zip(("lang", "slice", "counts"), r, strict=True)) for r in rows], pa.schema([("lang", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary())]))

    def add(pdf):
        return pdf.iloc[:1].assign(counts=[sum(np.frombuffer(x, np.int64) for x in pdf["counts"]).tobytes()])

    some = sample.select(F.col(text).alias("text"), F.col(lang).alias("lang")).repartition(16)
    rows = some.mapInArrow(count, "lang int, slice int, counts binary").groupBy("lang", "slice").applyInPandas(add, "lang int, slice int, counts binary").collect()
    total = np.zeros((len(langs), SLICES, BUCKETS // SLICES))
    for r in rows:
        total[r["lang"], r["slice"]] = np.frombuffer(r["counts"], np.int64)
    share = total.reshape(len(langs), -1) + 0.5
    share /= share.sum(1, keepdims=True)  # each language weighs the same
    code = codewords(len(langs))
    weights, worth = np.zeros((BUCKETS, code.shape[1]), np.float32), np.ones(code.shape[1])
    for k in range(code.shape[1]):
        one, other = code[:, k] > 0, code[:, k] < 0
        if one.any() and other.any():
            p, q = share[one].mean(0), share[other].mean(0)
            weights[:, k] = np.log(p / q)
            worth[k] = 0.5 * ((p - q) * np.log(p / q)).sum()  # how far apart the two sides are
    return langs, code, weights, worth / worth.mean()


def decode(margins: np.ndarray, n: np.ndarray, code: np.ndarray, worth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codeword of the least weighted logistic loss, its share of exp(-loss), and the gap to the second."""
    scaled = margins * np.minimum(n, 400)[:, None] ** 0.5
    loss = np.stack([(np.logaddexp(0, -scaled * c[None]) * worth).sum(1) for c in code], 1)
    best = loss.argmin(1)
    e = np.exp(-(loss - loss.min(1, keepdims=True)))
    score = 1 / e.sum(1)
    two = np.sort(loss, 1)
    return best, score, two[:, 1] - two[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)


def predict(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row: `und`, 0 and true without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a codeword a language and BUCKETS rows of weights

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        lang = np.full(b.num_rows, "und", object)
        score, unsure = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
        if shared.value is not None:
            langs, code, weights, worth = shared.value
            for i, j, t in pieces(b, "text", limit=max(1 << 16, (8 << 20) // code.shape[1])):
                letters = t.total(_LETTER[t.buf]) > 0
                for k in np.flatnonzero(~letters & (t.total(t.buf >= 128) > 0)):
                    letters[k] = any(c.isalpha() for c in bytes(t.buf[t.start[k] : t.end[k]]).decode("utf-8", "replace"))
                d, h = grams(t)
                n = np.bincount(d, minlength=t.n)
                margin = np.zeros((t.n, code.shape[1]))
                if len(d):
                    first = np.flatnonzero(np.diff(d, prepend=-1))
                    margin[d[first]] = np.add.reduceat(weights[h], first, axis=0) / n[d[first]][:, None]
                best, sure, gap = decode(margin, n, code, worth)
                ok = letters & (n > 0)
                lang[i:j] = np.where(ok, np.array(langs, object)[best], "und")
                score[i:j] = np.where(ok, sure, 0)
                unsure[i:j] = ~ok | (gap < 1)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return arrow_map(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def held_out(doc_id: str = "doc_id"):
    """Documents from which nothing is learned: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row of docs.

    Learned from rows with a text and a lang that aren't held out. A null text, or one without a
    letter, is `und` with score 0, as is every text if there is nothing to learn from. A null id
    counts as not held out for prediction but isn't learned from. Repeated rows get a row each;
    no rows give none. Other columns are not read.
    """
    model = train(docs.where(~held_out()), "doc_id", "text", "lang")
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
