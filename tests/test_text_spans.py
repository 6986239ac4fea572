"""Chunk extraction with offsets, dedupe and sentence assignment against a loop over the same rules."""

import random
import re

from mentiongraph.operators import text as tx


def spans(text):
    out, at = [], 0
    for piece in re.findall(r"[^.!?]*[.!?]+|[^.!?]+$", text):
        s = piece.lstrip(" \t\n\r\f")
        if s.strip():
            out.append((at + len(piece) - len(s), at + len(piece)))
        at += len(piece)
    return out


def chunk_bounds(n, size=8, step=6):
    out, start = [], 0
    while start < n:
        end = min(n - 1, start + size - 1)
        out.append((start, end))
        if end >= n - 1:
            break
        start += step
    return out


def documents():
    rnd = random.Random(3)
    texts = ["", None, "no names here", "Anna met Bob.  Then\nCarl left! Anna", " . ! ", "Élan Über É Ö. 😀 Zoe", "." * 30]
    for n in (1, 7, 8, 9, 14, 15, 20, 31):
        texts.append("".join(rnd.choice(["Anna ", "bob ", "\n ", "Carl x ", "É "]) + rnd.choice(["Dora", "y", "Ängel"]) + rnd.choice([".", "!?", ". "]) for _ in range(n)))
    return list(enumerate(texts))


def test_spans_equal_a_loop(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, chunk_want, raw = set(), set(), 0
    for i, text in rows:
        sents = spans(text or "")
        for k, (a, b) in enumerate(chunk_bounds(len(sents))):
            lo, hi = sents[a][0], sents[b][1]
            chunk_want.add((i, k, lo, text[lo:hi]))
            for m in re.finditer(r"[A-ZÉÜÖÄ][a-zéüöä]+", text[lo:hi]):
                raw += 1
                start = lo + m.start()
                want.add((i, m.group(), start, lo + m.end(), next(j for j, (x, y) in enumerate(sents) if x <= start < y)))
    assert {tuple(r) for r in tx.chunk_texts(docs).collect()} == chunk_want
    got = [(r.doc_id, r.entity, r.char_start, r.char_end, r.sent_idx) for r in tx.mention_spans(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert tx.chunk_mentions(tx.chunk_texts(docs)).count() == raw > len(want)
    assert tx.mention_spans(docs.limit(0)).count() == 0


def test_a_start_outside_all_sentences_goes_to_the_last(spark):
    sents = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 7, 9), (1, 2, 9, 12)], "doc_id long, sent_idx int, char_start int, char_end int")
    ments = spark.createDataFrame([(1, "a", 0), (1, "b", 4), (1, "c", 5), (1, "d", 6), (1, "e", 9), (1, "f", 40), (2, "g", 0)],
                                  "doc_id long, entity string, char_start int")
    got = {r.entity: r.sent_idx for r in tx.assign_sentences(ments, sents).collect()}
    assert got == {"a": 0, "b": 0, "c": 2, "d": 2, "e": 2, "f": 2, "g": None}
