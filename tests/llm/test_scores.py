"""Fill-in-the-middle, the filter audit and the suffix tree against brute force, with awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skein.llm import bytescan, filters, infill, suffixtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
BIG = 9007199254740993
PIECES = [" ", "\n", "a", "é", "😀", "<", "P", "S", "M", ">", "<S>", "word", "Word", "A", "#", "%", "\x0b", "\x1c", "\xa0", "\x85", "longer-than-eight", "x" * 300, ""]


def odd_texts(rng, n, most=60):
    return [None if rng.random() < 0.1 else "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 2, 5, most]))) for _ in range(n)]


def odd_table(spark, rng, n=60):
    """Null ids and texts, ids beyond doubles, repeated rows and texts, clashing names."""
    texts = odd_texts(rng, n)
    rows = [(None if k % 9 == 4 else BIG + k, t, None if k % 5 == 0 else f"s{k % 3}", 7, "x") for k, t in enumerate(texts)]
    rows += rows[:7] + [(BIG + 100 + k, texts[k], "s1", 7, "x") for k in range(9)] + [(BIG + 300, "tail " * 60_000, "", 7, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, form string"), [r[:3] for r in rows]


def infilled(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKEN.findall(text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:lo], tokens[lo:hi], tokens[hi:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_and_its_inverse(spark, monkeypatch):
    docs, rows = odd_table(spark, random.Random(5))
    made = infill.restore(infill.infill(docs)).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in made) == Counter((d, *infilled(d, t), t or "") for d, t, _ in rows)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert infill.restore(infill.infill(docs.limit(0))).collect() == []


@pytest.mark.parametrize("window", [1, 7, 1 << 20])
def test_infill_windows(monkeypatch, window):
    monkeypatch.setattr(infill, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(60):
        texts = odd_texts(rng, rng.randint(1, 12), 20)
        ids = [rng.choice([None, rng.randrange(10**6)]) for _ in texts]
        at, data = bytescan.text_bytes(pa.array(["pad", *texts], pa.string()).slice(1))
        n, form, c1, c2 = infill.cut(at, data, infill.draws(ids, 42), 50, 80)
        out_at, out = infill.scatter(at, data, form, c1, c2)
        wanted = [infilled(d, t) for d, t in zip(ids, texts, strict=True)]
        assert bytescan.string_array(out_at, out).to_pylist() == [w[4] for w in wanted]
        assert bytescan.string_array(*infill.gather(out_at, out, form)).to_pylist() == [t or "" for t in texts]


def test_restore_of_damaged_rows(spark):
    rows = [("psm", "no markers"), ("spm", "<P>a<S>b<M>c"), ("odd", "text"), (None, "text"), ("psm", None), ("psm", "<P>a<S>b<M>c<M>"), ("psm", "<P><S><M>"), ("plain", "a<P>")]
    got = infill.restore(spark.createDataFrame(rows, "form string, output string").coalesce(1)).collect()
    assert [r.restored for r in got] == [None, None, None, None, None, None, "", "a<P>"]


def counts_of(text):
    text = text or ""
    words = WORD.findall(text)
    return [len(words), len(set(words)), sum("A" <= c <= "Z" for c in text), sum(c in "#$%&*|" for c in text), len(text)]


@pytest.mark.parametrize("hashed", [3, 20, 1 << 18])
def test_transducer_counts(monkeypatch, hashed):
    monkeypatch.setattr(filters, "HASH_BYTES", hashed)
    rng = random.Random(hashed)
    for _ in range(60):
        texts = odd_texts(rng, rng.randint(1, 12))
        at, data = bytescan.text_bytes(pa.array(["pad", *texts], pa.string()).slice(1))
        assert np.column_stack(filters.counted(at, data)).tolist() == [counts_of(t) for t in texts]


def test_table_verifies_spans_of_one_hash(monkeypatch):
    monkeypatch.setattr(filters, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    text = " ".join(f"w{k % 40}" for k in range(400)) + " " + "long" * 90 + " " + "long" * 89 + "lonk" + " " + "long" * 90
    at, data = bytescan.text_bytes(pa.array([text, "w1 w2 w1"]))
    assert np.column_stack(filters.counted(at, data))[:, :2].tolist() == [[403, 42], [3, 2]]


def audit(rows, labels):
    """The audit by applying the filters one after the other in each order."""
    ids = Counter()
    out = {}
    failed = []
    for d, t, s in rows:
        w, u, caps, symbols, chars = counts_of(t)
        copy = d is not None and any(o is not None and o < d and (x or "") == (t or "") for o, x, _ in rows)
        failed.append({f for f, bad in zip("ABCDE", (w < 200, 100 * u < 50 * w, 100 * caps > 2 * chars, symbols > 0, copy), strict=True) if bad})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    for part in {s or "" for _, _, s in rows}:
        mine = [(d, f) for (d, _, s), f in zip(rows, failed, strict=True) if (s or "") == part]
        ids.clear()
        for order in permutations("ABCDE"):
            left = list(mine)
            for k, letter in enumerate(order):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                ids[letter] += len(gone)
                fails = sum(letter in f for _, f in mine)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), fails - len(gone), sum(f == {letter} for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), letter,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[6] = ids[row[6]] if isinstance(row[6], str) else row[6]
    return out


def test_filter_audit(spark):
    rng = random.Random(11)
    docs, rows = odd_table(spark, rng, 40)
    long = [(k, " ".join(rng.choice(["One", "two", f"w{j}"]) for j in range(230)) + rng.choice(["", " 5%"]), rng.choice(["s1", None])) for k in range(30)]
    more = long + [(k + 500, long[k][1], "s2") for k in range(0, 30, 2)]
    docs = docs.unionByName(spark.createDataFrame([(*r, 1, "f") for r in more], docs.schema))
    labels = [(k, k % 2, k % 3 % 2) for k in range(0, 30)] + [(3, 0, 1), (None, 1, 1), (4, None, None), (502, 1, 0)]
    table = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    found = filters.interactions(filters.failed_filters(filters.materialise(filters.document_counts(docs), "counts")), table).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in found} == audit(rows + more, labels)
    assert filters.interactions(filters.failed_filters(filters.materialise(filters.document_counts(docs.limit(0)), "counts")), table).collect() == []


def test_audit_and_infill_sql(spark):
    """The SQL of both over the smallest tables."""
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    for query, sql in ((infill.op11_displacement_infill, infill.OP11_SQL), (filters.op12_filter_interactions, filters.OP12_SQL)):
        got = query(spark, data)
        want = con.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)


def sentences(rng, n):
    """Texts whose words follow from the two before them more often than not."""
    out = []
    for _ in range(n):
        words = ["a0", "b0"]
        for _ in range(rng.randint(0, 60)):
            words.append(f"w{(ord(words[-1][0]) * 7 + len(words[-2]) * 3 + int(words[-1][1:]) * 5 + int(words[-2][1:])) % 23}" if rng.random() < 0.8 else f"r{rng.randrange(400)}")
        out.append(" ".join(words))
    return out


def test_tree_scores(spark, monkeypatch):
    rng = random.Random(2)
    texts = sentences(rng, 300) + [None, "", " \n", "Unseen Öwörd UNSEEN", "\x1c\x85", "w1\x0bW1", "l" * 90 + " w1 " + "l" * 90]
    rows = [(None if k == 5 else BIG + k, t, 1.5, "x") for k, t in enumerate(texts)]
    rows += rows[:4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, word string")
    flagged = docs.withColumn("held_out", suffixtree.held_out(docs["doc_id"]))
    tree, vocabulary = suffixtree.fit(flagged.where("not held_out").repartition(3))
    got = suffixtree.score(flagged, tree, vocabulary).collect()
    assert set(got[0].__fields__) == {"doc_id", "word", "held_out", "n_tokens", "n_known", "base_score", "score"}

    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    counts = Counter(w for d, t, *_ in rows if not out(d) for w in tokens(t))
    total, types = sum(counts.values()), len(counts)
    assert (tree.tokens, tree.types) == (total, types)
    wanted = Counter()
    for d, t, *_ in rows:
        ws = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in ws)
        wanted[d, out(d), len(ws), sum(counts[w] > 0 for w in ws), round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == wanted
    assert all(x > 0 for x in tree.contexts()[:2])
    kept_out = [r for r in got if r.held_out]
    assert sum(r.score for r in kept_out) > 0.8 * sum(r.base_score for r in kept_out)  # these are negative

    # the successions that the tree counts are those of the texts
    grams = [Counter() for _ in range(4)]
    for d, t, *_ in rows:
        if not out(d):
            ws = ["<", *(w for w in tokens(t)[:-1]), None]
            for k in range(2, 5):
                grams[k - 1].update(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1))
    name = ["?", None, "<", *(w.decode() for w in tree.words)]
    shown = [[(s,) for s in name]]
    for k, level in enumerate(tree.levels[1:], 1):
        shown.append([(*shown[-1][key // tree.base], name[key % tree.base]) for key in level.keys])
        symbols = set(name[1:])
        assert dict(zip(shown[-1], level.n.tolist(), strict=True)) == {g: n for g, n in grams[k].items() if n >= 2 and set(g) <= symbols}

    # every state's distribution sums to one: all words, the end, and one unknown word
    unknown = suffixtree.share(0, total, types)
    for state in ([], *(list(s) for s in shown[1][:40]), *(list(s) for s in shown[2][:40]), ["w1", "nothing"]):
        if None in state:
            continue
        before = [suffixtree.BEGIN] if not state else [name.index(s) if s in name else suffixtree.OTHER for s in state]
        mass = 0.0
        for w, n in counts.items():
            s = name.index(w) if w in name else suffixtree.OTHER
            lp = suffixtree.log_probabilities(tree, np.array([*before, s]))[-1]
            mass += 10**lp * (suffixtree.share(n, total, types) if s == suffixtree.OTHER else 1)
        mass += 10 ** suffixtree.log_probabilities(tree, np.array([*before, suffixtree.OTHER]))[-1] * unknown
        assert mass == pytest.approx(1, abs=1e-9)

    # windows and split texts change nothing
    for module_value, value in (("WINDOW", 5), ("SPLIT_BYTES", 11), ("TALLY_KEYS", 50), ("TALLY_WORDS", 9)):
        monkeypatch.setattr(suffixtree, module_value, value)
    run = np.concatenate([suffixtree.Symbols(tree.words).of(t.encode()) for t in texts[:20]])
    parts = np.concatenate([suffixtree.log_probabilities(tree, part)[before:] for before, part in suffixtree._windows(run)])
    whole = suffixtree.log_probabilities(tree, run.astype(np.int64))
    assert np.allclose(parts, whole)
    assert [w for run in suffixtree.words_of(b"Aa bb  c\n" * 9) for w in run] == [b"aa", b"bb", b"c"] * 9


def test_tree_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    tree, vocabulary = suffixtree.fit(empty)
    assert suffixtree.score(empty, tree, vocabulary).collect() == []
    rows = suffixtree.score(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), tree, vocabulary).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in rows} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}


def test_long_words_are_symbols_of_contexts(spark):
    def scores(word):
        texts = [f"one {word} two three", f"four {word} two five", f"{word} two one", "two five four one", "one three"] * 40
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
        tree, vocabulary = suffixtree.fit(docs)
        return {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in suffixtree.score(docs, tree, vocabulary).collect()}

    assert scores("x" * 200) == scores("x" * 64) == scores("é" * 50)
