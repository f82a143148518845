"""Chunks on paragraphs and sentences against a walk over lists of strings."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweir.operators import splitting
from docweir.sources.providers import contextual_prefix  # noqa: F401  the step after chunks

WS = "[ \t\n\r\f\v]"


def pieces(text, size):
    """Token lists: paragraphs, else sentences, else clauses, else tokens."""
    tokens = re.findall(rf"[^ \t\n\r\f\v]+{WS}*", text)

    def units(run, ends):
        out, now = [], []
        for t in run:
            now.append(t)
            if ends(t):
                out.append(now)
                now = []
        return out + [now] if now else out

    body = lambda t: re.sub(r"[\"')\]]{0,3}$", "", t.strip(" \t\n\r\f\v")) or t
    paragraph = lambda t: "\n\n" in t[len(t.rstrip(" \t\n\r\f\v")) :]
    sentence = lambda t: paragraph(t) or body(t)[-1:] in tuple(".!?。？！…")
    clause = lambda t: sentence(t) or body(t)[-1:] in tuple(",;:，；、")
    out = []
    for p in units(tokens, paragraph):
        for q in [p] if len(p) <= size else units(p, sentence):
            for r in [q] if len(q) <= size else units(q, clause):
                out += [r] if len(r) <= size else [[t] for t in r]
    return out


def plain(text, size, overlap):
    splits, chunks, now, fresh = [len(p) for p in pieces(text, size)], [], [], True
    at, flat = 0, [t for p in pieces(text, size) for t in p]
    starts = [sum(splits[:k]) for k in range(len(splits) + 1)]
    while at < len(splits):
        if sum(splits[k] for k in now) + splits[at] > size:
            if not fresh:
                chunks.append(now)
                kept = []
                for k in reversed(now):
                    if sum(splits[x] for x in kept) + splits[k] > overlap:
                        break
                    kept.insert(0, k)
                now, fresh = kept, True
                continue
            now = now[1:]
            continue
        now, fresh, at = [*now, at], False, at + 1
    chunks += [now] if now else []
    return [(starts[c[0]], "".join(flat[starts[c[0]] : starts[c[-1] + 1]]).strip(" \t\n\r\f\v")) for c in chunks]


def cut(texts, size, overlap):
    import pyarrow as pa

    b = splitting._cut(pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"]), size, overlap, b"\n\n").to_pylist()
    return [[(r["first_token"], r["raw_text"]) for r in b if r["doc_id"] == d] for d in range(len(texts))], b


words = st.sampled_from(["a", "bb.", "c,", "d\n\n", "e! ", "é。", "(f.)", "g?\"", "h\n", " ", "\n\n", "i;", "日本、", "...", ")", "k\t\n \n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(words, max_size=60).map(" ".join), min_size=1, max_size=3), st.integers(2, 12), st.integers(0, 5))
def test_equal_to_plain(texts, size, overlap):
    overlap = min(overlap, size - 1)
    got, rows = cut(texts, size, overlap)
    assert got == [plain(t, size, overlap) for t in texts]
    assert all(r["token_count"] <= size for r in rows)
    for d, t in enumerate(texts):
        raw, seen, own = t.encode(), 0, [r for r in rows if r["doc_id"] == d]
        for r in own:  # all tokens in order: what lies between is white space
            assert r["raw_text"].encode() == raw[r["begin"] : r["stop"]]
            assert r["begin"] <= seen or not raw[seen : r["begin"]].strip()
            seen = r["stop"]
        assert not raw[seen:].strip(b" \t\n\r\f\v")


def test_rows(spark):
    long = "\n\n".join(f"Sentence {k} of a paragraph. And more of it, to be sure." * (k % 5 + 1) for k in range(400))
    docs = spark.createDataFrame([(1, long), (2, None), (3, " \n"), (None, "one two"), (4, "short")], "doc_id long, text string")
    rows = splitting.split_text(docs).collect()
    assert {(r.doc_id, r.raw_text) for r in rows if r.doc_id != 1} == {(None, "one two"), (4, "short")}
    assert [(r.first_token, r.raw_text) for r in sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.chunk_index)] == plain(long, 1000, 200)
    assert splitting.split_text(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splitting.split_text(docs, 10, 10)
