"""Piece codec, periodic runs and spelling variants against the library and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from mentiongraph.llm import periodic_runs, piece_codec, queries, spelling

PIECES = queries.vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, word string, n int, key long, rest string, n_chars int"  # names used inside, too
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _rows():
    rnd = random.Random(5)
    line = " ".join(f"w{i}" for i in range(15))
    texts = ["", None, " ", "one two", "a b " * 20, "x " * 11, "x " * 12, (line + "\n") * 3 + "tail", "the  double   space" + " " * 40 + "end",
             "▁odd <s> </s> <unk> ⁇ \0 café 中文 \U0001f600\r\n\tx", " ".join(f"long{i % 613}" for i in range(20000)), "z" * 5000,
             "Committee committee committee comittee committees Ärgernis Ärgernis ärgernis argernis argernis" + " committee" * 40,
             " ".join(rnd.choice(["abcdefgh", "abcdefg", "abcdefgx", "bcdefgh", "abcdefghi"]) for _ in range(400))]
    rows = [(10 * i + 1, t, "w", i, i, "r", -1) for i, t in enumerate(texts)]
    return rows + [(None, "no id " * 9, None, None, None, None, None), rows[7], rows[12]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# ------------------------------------------------------------------ pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_piece_digests_equal_the_library(docs, empty, library):
    want = collections.Counter()
    for i, t, *_ in _rows():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want[(i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids)))] += 1
    assert collections.Counter(tuple(r) for r in piece_codec.digests(docs, PIECES).collect()) == want
    assert piece_codec.digests(empty, PIECES).count() == 0


def test_piece_decode_is_the_inverse(docs, empty):
    back = piece_codec.decode(piece_codec.encode(docs.where("doc_id is not null"), PIECES), PIECES).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, (t or "").replace("▁", " ")) for i, t, *_ in _rows() if i is not None}
    assert piece_codec.encode(empty, PIECES).count() == 0


def test_merge_rounds_on_random_symbols(library):
    with open(PIECES, "rb") as f:
        p = piece_codec.Pieces(f.read())
    rnd = random.Random(1)
    bits = ["the", "a", "b", "th", "in", "er", "▁", " ", "  ", "\n", "é", "ß", "x", "==", "0", "00", "中", "ing", "tion", "́", "\t", "\0"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]
    texts += ["x" * k + " " * k + "the" for k in range(60)] + ["".join(rnd.choice("abcdefghij") for _ in range(2000))]
    for t, ids in zip(texts, p.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_bos=True, add_eos=True)
    for ids in ([], [1, 1, 306, 2], [3 + 0xE4, 306], [0, 306], [3 + 0xE4, 3 + 0xB8, 3 + 0xAD], [3 + 0x80] * 3):
        assert p.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)


# ------------------------------------------------------------------ runs


def brute_runs(x, least):
    out = set()
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, 2 * p) and not any(x[i:i + n - q] == x[i + q:i + n] for q in range(1, p)):
                out.add((i, n, p))
            i = max(j, i + 1)
    return out


def brute_lyndon(x):
    return [max(j - i for j in range(i + 1, len(x) + 1) if all(x[i:j] < x[k:j] for k in range(i + 1, j))) for i in range(len(x))]


def test_lyndon_arrays_and_runs_of_small_arrays():
    rnd = random.Random(2)
    for _ in range(400):
        x = [rnd.randrange(rnd.randint(1, 3)) for _ in range(rnd.randint(1, 16))]
        x = np.unique(x, return_inverse=True)[1].tolist()
        assert periodic_runs.lyndon_array(x) == brute_lyndon(x)
    for _ in range(300):
        x = []
        while len(x) < 50:
            x += [rnd.randrange(3) for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 4)
        for least in (2, 12):
            assert {tuple(r) for r in periodic_runs.array_runs(np.array(x), least).tolist()} == brute_runs(x, least)


def expected(i, t, edited):
    w = WORD.findall(t or "")
    if edited and i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    runs = sorted(brute_runs(w, 12) if len(w) < 5000 else {(0, 20000, 613)}, key=lambda r: (r[0], r[2]))
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    four = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (i, len(runs), *four, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(v for k, v in enumerate(w) if k not in gone)))


@pytest.mark.parametrize("edited", [False, True])
def test_run_digests(docs, empty, edited):
    rows = [r for r in _rows() if not (edited and r[0] == 101)]  # the long text is compared unedited
    got = periodic_runs.digests(docs if not edited else docs.where("doc_id is null or doc_id <> 101"), 12,
                                periodic_runs.planted_periods if edited else None)
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(expected(i, t, edited) for i, t, *_ in rows)
    assert periodic_runs.digests(empty).count() == 0


def test_planted_periods_are_found(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randint(1, 90)))) for i in range(120)]
    got = periodic_runs.digests(spark.createDataFrame(rows, "doc_id long, text string"), 12, periodic_runs.planted_periods).collect()
    assert {tuple(r) for r in got} == {expected(i, t, True) for i, t in rows} and any(r.n_runs for r in got)


def test_collapse_keeps_rows_and_columns(docs, empty):
    out = periodic_runs.collapse(docs)
    assert out.columns == docs.columns and out.count() == len(_rows()) and periodic_runs.collapse(empty).count() == 0
    by = {r.doc_id: r for r in out.collect()}
    line = " ".join(f"w{i}" for i in range(15))
    assert by[71].text == line + " tail" and by[71].n_chars == len(by[71].text) and by[71].rest == "r"
    assert by[11].text is None and by[21].text == " " and by[41].text == "a b" and by[51].text == "x " * 11 and by[61].text == "x"
    found = collections.Counter(tuple(r) for r in periodic_runs.runs(docs).collect())
    assert found[(71, 0, 45, 15)] == 2 and found[(41, 0, 40, 2)] == 1 and periodic_runs.runs(empty).count() == 0


# ------------------------------------------------------------------ spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if counts[b] >= ratio * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()}


def test_word_counts(docs, empty):
    counts = collections.Counter()
    for i, t, *_ in _rows():
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            counts[spelling.dropped_letter(w, zlib.crc32(f"{'null' if i is None else i}:{w}".encode()))] += 1
    want = {(w, n) for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = spelling.word_counts(docs, change=spelling.dropped_letter)
    assert {tuple(r) for r in got.collect()} == want and spelling.word_counts(empty).count() == 0
    assert spelling.dropped_letter("abc", 31) == "ac" and spelling.dropped_letter("abc", 32) == "abc"


def test_variants_equal_brute_force(spark, docs):
    rnd = random.Random(4)
    counts = {}
    for _ in range(160):  # few letters, lengths around the chunk sizes, and lengths whose chunks grow
        w = "".join(rnd.choice("aabé") for _ in range(rnd.choice([7, 8, 9, 10, 24, 25, 26, 33])))
        for _ in range(4):
            k = rnd.randrange(len(w))
            counts[w] = rnd.choice([2, 3, 25, 300, 4000])
            w = rnd.choice([w[:k] + w[k + 1:], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1:]])
    counts = {w: n for w, n in counts.items() if len(w) >= 7}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute_variants(counts)
    assert {tuple(r) for r in spelling.variants(rows).collect()} == want and any(r[1] and r[2] != r[1] for r in want)
    pairs = {frozenset((r.a, r.b)) for r in spelling.near_pairs(rows).collect()}
    assert pairs == {frozenset((a, b)) for a in counts for b in counts if one_edit(a, b)}
    assert spelling.variants(rows.limit(0)).count() == 0
    small = spelling.word_counts(docs)
    assert {tuple(r) for r in spelling.variants(small).collect()} == brute_variants({r.word: r.n for r in small.collect()})
