"""Repeated passages of whole lines in any shape, by brute force over all pairs of texts."""

import numpy as np
import pytest

from docweir.llm import line_dedup
from tests.llm.conftest import prose


def words(line):
    solid = sum(0x3000 <= ord(c) <= 0x9FFF for c in line)
    return len(line.split()) + solid // 2


def brute(texts):
    """For each text, which lines are in a run of 20 words or more, from a line with words to one, that an
    earlier text has as well."""
    out = []
    for k, (_, text) in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines)):
            total = 0
            for j in range(i, len(lines)):
                total += words(lines[j])
                if total >= 20:
                    run = lines[i : j + 1]
                    if words(run[0]) and words(run[-1]) and any(_has(t.split("\n"), run) for _, t in texts[:k]):
                        gone |= set(range(i, j + 1))
                    break
            total = 0
            for j in range(i, -1, -1):
                total += words(lines[j])
                if total >= 20:
                    run = lines[j : i + 1]
                    if words(run[0]) and words(run[-1]) and any(_has(t.split("\n"), run) for _, t in texts[:k]):
                        gone |= set(range(j, i + 1))
                    break
        out.append(len(gone))
    return out


def _has(lines, run):
    return any(lines[a : a + len(run)] == run for a in range(len(lines) - len(run) + 1))


JAPANESE = ["".join(chr(0x4E00 + (k * 131 + j * 37) % 5000) for j in range(50)) for k in range(14)]


@pytest.mark.parametrize("passage", [[f"item{k}" for k in range(60)], [x for k in range(40) for x in (f"three words {k}", "")], JAPANESE, [f"{k} " * 7 + "end" for k in range(3)], ["", "", *[x for k in range(30) for x in (f"w{k}", "", "\t")]]], ids=["lists", "spaced", "japanese", "short", "blank"])
def test_shapes(spark, passage):
    rows = [(1, "\n".join([prose(1, 30), *passage, "fin"])), (2, "\n".join(["begin here", *passage, prose(2, 40)])), (3, prose(3, 90))]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    first, last = (next(i for i in order if words(passage[i])) for order in (range(len(passage)), range(len(passage) - 1, -1, -1)))
    assert got == {1: 0, 2: last - first + 1, 3: 0}


def test_drawn(spark):
    rng = np.random.default_rng(7)
    pool = [*[prose(k, int(rng.integers(1, 12))) for k in range(12)], "", "", "x", "日本語の長い行です" * 3]
    rows = [(k, "\n".join(pool[i] for i in rng.integers(0, len(pool), int(rng.integers(1, 25))))) for k in range(25)]
    rows += [(100 + k, "\n".join([f"head {k}", *rows[k][1].split("\n")[2:], f"foot {k}"])) for k in range(25)]
    got = {r.doc_id: r.n_removed for r in line_dedup.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    # repeats inside one text go as well, so no fewer
    assert all(got[d] >= n for (d, _), n in zip(rows, want, strict=True))
    assert sum(want) > 100
