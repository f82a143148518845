"""Licence scans: MinHash bands over overlapping text windows find templates, exact containment of
their shingles decides.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. Shingles have N words. A
document's shingles are cut into blocks of BLOCK, and windows of 2 * BLOCK * 2**c shingles, half
overlapping, are made for the classes c of template lengths, so that any run as long as a template
of the class lies whole in a window. The minimum of each of BANDS hash functions over a window is a
band of one row: a window meets a template if any of them is equal. If the share s of the template's
shingles is in a window twice as long, their similarity is s / (3 - s) at least, and the chance that
all bands miss is (1 - s / (3 - s)) ** BANDS: under 2e-6 for s = 0.8 and BANDS = 32 (a window of the
class may be 4 times as long as the template: then s / (5 - s), and under 0.003). Templates shorter
than a block are in the smallest class; there a window's own shingles are looked up as well, so that
none is missed.

Windows that meet a template are verified: the share of its distinct shingles that the window holds
must be at least CONTAINED. The templates are a fixed list, so what each task gets has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map
from .license_texts import TEMPLATES
from .textvec import LOWER, U, Texts, mix, ngrams, pieces

N, BLOCK, BANDS, CONTAINED = 5, 16, 32, 0.8

_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SALTS = np.random.default_rng(5).integers(1, 1 << 63, BANDS, dtype=np.uint64)


def _shingles(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and first word's number in its document of each shingle, in order. Texts of
    fewer than N words have none."""
    gap = _GAP[t.buf]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    s, e = edge[::2], edge[1::2]
    doc = np.searchsorted(t.start, s, "right") - 1
    d, h = ngrams(doc, t.hashes(s, e), N, t.n, short=False)
    return d, h, np.arange(len(d)) - np.searchsorted(d, d)


class Templates:
    """Templates by name with their shingles, and for each class the bands' values."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        data = [texts[n].encode() for n in self.names]
        t = Texts(LOWER[np.frombuffer(b"".join(data), np.uint8)], np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
        d, h, _ = _shingles(t)
        self.sets = [np.unique(h[d == k]) for k in range(len(self.names))]
        if any(not len(s) for s in self.sets):
            raise ValueError(f"a template needs {N} words")
        self.classes: dict[int, list[int]] = {}
        for k in range(len(self.names)):
            c = max(0, int(np.ceil(np.log2((d == k).sum() / BLOCK))))
            self.classes.setdefault(c, []).append(k)
        self.bands = {}
        for c, ks in self.classes.items():
            keys = np.array([[_bands(self.sets[k])[b].min() for b in range(BANDS)] for k in ks])
            self.bands[c] = [(np.sort(keys[:, b]), np.array(ks)[np.argsort(keys[:, b])]) for b in range(BANDS)]
        short = [k for k in self.classes.get(0, []) if len(self.sets[k]) < BLOCK]
        self.short: dict[int, list[int]] = {}
        for k in short:
            for x in self.sets[k].tolist():
                self.short.setdefault(x, []).append(k)
        self.short_keys = np.array(sorted(self.short), np.uint64)


def _bands(h: np.ndarray) -> list[np.ndarray]:
    return [mix(h ^ s) for s in _SALTS]


def _windows(d: np.ndarray, n_blocks: np.ndarray, first_block: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and last+1 block of each window of class c."""
    step = 1 << c
    count = np.where(n_blocks > 0, np.maximum(1, -(-n_blocks // step) - 1), 0)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.repeat(first_block, count) + at * step
    stop = np.minimum(start + 2 * step, np.repeat(first_block + n_blocks, count))
    return start, stop


def scan(t: Texts, known: Templates) -> list[tuple[int, str, float, int]]:
    """(document, template, contained, first word of the window) of each document and template: the
    window that contains most of it, the first of several."""
    d, h, word = _shingles(t)
    if not len(d):
        return []
    block = np.flatnonzero(word % BLOCK == 0)  # blocks begin anew in each document
    block_doc = d[block]
    n_blocks = np.bincount(block_doc, minlength=t.n)
    first = np.cumsum(n_blocks) - n_blocks
    ends = np.append(block, len(d))
    meets: set[tuple[int, int, int]] = set()
    minima = [np.minimum.reduceat(v, block) for v in _bands(h)]
    for c in known.classes:
        start, stop = _windows(d, n_blocks, first, c)
        bounds = np.stack([start, stop], 1).ravel()
        for m, (keys, ks) in zip(minima, known.bands[c], strict=True):
            low = np.minimum.reduceat(np.append(m, U(2**64 - 1)), bounds)[::2]
            at = np.searchsorted(keys, low)
            at2 = np.searchsorted(keys, low, "right")
            for w in np.flatnonzero(at < at2):
                meets.update((int(start[w]), int(stop[w]), int(k)) for k in ks[at[w] : at2[w]])
    if len(known.short_keys):
        at = np.searchsorted(known.short_keys, h)
        at[at == len(known.short_keys)] = 0
        for i in np.flatnonzero(known.short_keys[at] == h):
            b = int(np.searchsorted(block, i, "right")) - 1
            doc = d[i]
            lo, hi = int(first[doc]), int(first[doc] + n_blocks[doc])
            meets.update((max(lo, b - 1), min(hi, b + 2), k) for k in known.short[int(h[i])])
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for start, stop, k in sorted(meets):
        inside = np.isin(known.sets[k], h[ends[start] : ends[stop]]).mean()
        if inside >= CONTAINED:
            key = (int(d[ends[start]]), k)
            if key not in best or inside > best[key][0]:
                best[key] = (float(inside), int(word[ends[start]]))
    return [(doc, known.names[k], inside, w) for (doc, k), (inside, w) in best.items()]


def find(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, contained and window_word (the number of the window's first word) of each
    document and template that it contains.

    Null, empty and short texts contain none. Repeated rows and rows with a null id are scanned
    each. No rows give none. Other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = b.column(0), []
        for i, _, t in pieces(b, "text", lower=True):
            rows += [(i + doc, *more) for doc, *more in scan(t, known.value)]
        rows.sort()
        take = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int64(), pa.string(), pa.float64(), pa.int64()))]
        return pa.RecordBatch.from_arrays([ids.take(take[0]), *take[1:]], ["doc_id", "license", "contained", "window_word"])

    return arrow_map(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], run, "doc_id long, license string, contained double, window_word long")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
