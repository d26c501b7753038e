"""Aligned tokens against whole texts encoded one by one."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pairloom.llm import alignment
from pairloom.llm.alignment import Aligner, align_tokens, overlaps
from pairloom.llm.queries import op13_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def shown_bytes():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def plainly(texts, sides):
    """Expected rows, token by token."""
    a, b = sides
    back = shown_bytes()
    docs = []
    for text in texts:
        full = (" " + (text or "")).encode()
        if not text:
            docs.append(([], [], [], 0, ""))
            continue
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        ids_b = b.encode(text)
        raw_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
        if b"".join(raw_a) != full or b"".join(raw_b) != full:
            docs.append(([], [], [], 0, ""))
            continue
        end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        where = {e: i for i, e in enumerate(end_b)}
        links = [(ids_a[i], ids_b[where[e]]) for i, e in enumerate(end_a) if e in where]
        start_a, start_b = [0, *end_a[:-1]], [0, *end_b[:-1]]
        crossing = sum(len([1 for s, e in zip(start_b, end_b) if s < x and y < e]) for y, x in zip(start_a, end_a)) if len(full) < 3000 else None
        groups, i, j = [], 0, 0
        for e in end_a:
            if e in where:
                x, y = end_a.index(e, i) + 1, where[e] + 1
                groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
                i, j = x, y
        docs.append((ids_a, ids_b, links, crossing, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(x for d in docs for x in d[2])
    best = {}
    for (_, second), n in counts.items():
        best[second] = max(best.get(second, 0), n)
    return [
        (len(x), len(y), len(z), len(z), c, sum(counts[p] == best[p[1]] for p in z), sum(counts[p] for p in z), h)
        for x, y, z, c, h in docs
    ]


def checked(rows, want):
    for r in rows:
        w = want[r.doc_id]
        got = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_overlaps if w[4] is not None else None, r.n_best, r.count_sum, r.groups_sha256)
        assert got == w, r.doc_id


TEXTS = [
    None,
    "",
    " ",
    "\n",
    "word",
    "two words",
    "  three  spaces   here ",
    "tab\tand\nline\r\n\n  ends \n",
    "naïve café Größe ñandú, “quoted” — dash…  done",
    "nbsp here  wide 　x \u0085y \x1c z",
    "<|endoftext|> <s> </s> <unk> <0x0A>",
    "a▁b ▁ c",
    "日本語 テキスト と 한국어 🙂🙃 🏳️‍🌈",
    "don't we'll I'm 'tis 12345 3.14 x=y+z; if(a){b}",
    "é ́combining ﬁ ﬂ Å",
    "x" * 5000,
    "long word " * 3000,
    "same text again",
    "same text again",
    "null \x00 inside",
]


def test_odd_texts(docs_of, sides):
    checked(align_tokens(docs_of(TEXTS), A, B).collect(), plainly(TEXTS, sides))


def test_parts_of_the_counts(docs_of, sides):
    """The way that counts beyond one broadcast take: several passes."""
    checked(align_tokens(docs_of(TEXTS), A, B, pass_bytes=200).collect(), plainly(TEXTS, sides))


def test_held_pairs_leave_in_parts(docs_of, sides, monkeypatch):
    monkeypatch.setattr(alignment, "HELD_PAIRS", 5)
    checked(align_tokens(docs_of(TEXTS), A, B).collect(), plainly(TEXTS, sides))


def test_whole_query(spark, sides):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in sorted(docs)]
    assert [r.doc_id for r in sorted(docs)] == list(range(len(texts)))
    rows = op13_alignment(spark, sf).collect()
    assert len(rows) == len(texts)
    checked(rows, plainly(texts, sides))


def test_without_safe_cuts(sides):
    """Tokenizers whose cuts are not known to agree get whole texts."""
    import pyarrow as pa

    texts = [t for t in TEXTS if t]
    with open(A, "rb") as f, open(B, "rb") as g:
        own = Aligner(f.read(), g.read())
    assert own.cuts
    some = own.align(pa.array(texts))
    own.cuts = False
    whole = own.align(pa.array(texts))
    assert all(np.array_equal(some[c], whole[c]) for c in ("n_a", "n_b", "n_groups", "n_overlaps"))
    assert some["groups_sha256"].equals(whole["groups_sha256"]) and some["links"].equals(whole["links"])


def test_overlaps():
    a = pd.DataFrame({"doc": [0, 0, 1], "start": [0, 2, 6], "end": [2, 6, 9]})
    b = pd.DataFrame({"doc": [0, 0, 1, 1], "start": [0, 3, 6, 8], "end": [3, 6, 8, 9]})
    assert sorted(map(tuple, overlaps(a, b).to_numpy().tolist())) == [(0, 0), (1, 0), (1, 1), (2, 2), (2, 3)]


def test_nulls_repeats_clashing_columns_and_empty_tables(docs_of):
    docs = docs_of([(None, "a b", "en", "s", 1), (3, "a b", "en", "s", 1), (3, "a b", "en", "s", 1)])
    got = align_tokens(docs.withColumns({"n_a": F.lit("x"), "LINKS": F.lit(1)}), A, B).collect()
    assert len(got) == 3 and len({r[1:] for r in got}) == 1
    assert got[0].count_sum == 3 * got[0].n_links
    assert align_tokens(docs_of([]), A, B).collect() == []
