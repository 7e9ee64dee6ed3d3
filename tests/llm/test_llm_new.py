"""Whitening and manifest against brute force, on awkward rows and with small blocks."""

import collections
import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaidframe.llm import html, manifest, suffixes, whiten


# whitening

@pytest.mark.parametrize("kind", ["random", "equal", "clusters", "diagonal", "low rank", "one"])
def test_leading_components(kind):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    spectrum = {"random": rng.uniform(0, 9, 40), "equal": np.full(40, 2.0), "low rank": np.r_[5.0, 3.0, np.zeros(38)],
                "clusters": np.r_[[7.0] * 3, [7.0 - 1e-9] * 2, np.linspace(4, 1, 35)], "diagonal": np.arange(40.0), "one": np.ones(1)}[kind]
    m = np.diag(spectrum) if kind in ("diagonal", "one") else q @ np.diag(spectrum) @ q.T
    m = (m + m.T) / 2
    values, vectors = whiten.leading_components(m, 8)
    k = min(8, len(m))
    assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:k], atol=1e-13 * max(1, spectrum.max()), rtol=0)
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-13)
    assert np.allclose(m @ vectors.T, vectors.T * values, atol=1e-12 * max(1, spectrum.max()))


VECTORS = "vec_id long, embedding array<float>, component int, n string"


def test_whitened_rows_against_numpy(spark):
    rng = np.random.default_rng(1)
    table = (rng.standard_normal((300, 12)) * np.linspace(3, 0.1, 12)).astype(np.float32)
    rows = [(k, v.tolist(), k, "x") for k, v in enumerate(table)]
    bad = [(900, None, 1, None), (901, [None] + [1.0] * 11, 1, None), (902, [float("nan")] * 12, 1, None), (903, [float("-inf")] * 12, 1, None),
           (904, [1.0], 1, None), (905, [], 1, None), (None, table[0].tolist(), 1, None), (7, table[7].tolist(), 1, None)]
    got = whiten.whiten(spark.createDataFrame(rows + bad, VECTORS)).toPandas()
    full = np.r_[table, table[:1], table[7:8]].astype(float)
    x = np.floor(1024 * full).astype(int) + 100000
    gap = x - x.sum(0) / len(x)
    values, vectors = np.linalg.eigh(gap.T @ gap / len(x))
    assert len(got) == 302 * 8 and set(got.n) == {302} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10
    for k in range(8):
        part = got[got.component == k + 1]
        assert np.allclose(part.explained, values[-1 - k] / values.sum(), rtol=1e-10)
        want = gap @ vectors[:, -1 - k] / np.sqrt(values[-1 - k])
        own = part[part.vec_id.notna() & (part.vec_id != 7)].sort_values("vec_id").whitened.to_numpy()
        want = np.delete(want[:300], 7)
        assert min(np.abs(own - want).max(), np.abs(own + want).max()) < 1e-9
    deviation = ((302 * x - x.sum(0)) ** 2).sum(1)
    one = got[(got.component == 1) & got.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id")
    assert one.deviation.tolist() == deviation[:300].tolist()


@pytest.mark.parametrize("rows,live", [([], 0), ([(1, [1.0, 2.0])], 0), ([(k, [0.5, 0.5]) for k in range(4)], 0),
                                       ([(k, [float(k), 2.0 * k, 0.0]) for k in range(5)], 1), ([(1, None)], 0)])
def test_whitening_without_variance(spark, rows, live):
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    used = [r for r in rows if r[1]]
    assert len(got) == sum(len(v) for _, v in used)
    assert all((r.whitened is not None) == (r.component <= live) and r.identity_error < 1e-9 for r in got)


# manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank string, leaf string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows, fan):
    """Leaf, subroot, root, proof digest and folded root of every row, by its leaf."""
    def leaf(r, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    def climb(level):
        paths, place = [[] for _ in level], list(range(len(level)))
        while len(level) > 1:
            for i, at in enumerate(place):
                b = at // fan * fan
                paths[i].append(("".join(level[b:at]), "".join(level[at + 1:b + fan])))
                place[i] = at // fan
            level = [digest("".join(level[k:k + fan])) for k in range(0, len(level), fan)]
        return level[0], paths

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, out = {}, []
    for r in rows:
        bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        text = r[1].translate(lower) if bad and r[1] is not None else r[1]
        groups.setdefault(r[3], []).append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), leaf(r, text), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climb([x[1] for x in sorted(groups[s])]) for s in names}
    root, above = climb([tops[s][0] for s in names]) if names else ("", [])
    for s, up in zip(names, above):
        for (_, own, copy, doc_id), path in zip(sorted(groups[s]), tops[s][1]):
            node = copy
            for before, after in path + up:
                node = digest(before + node + after)
            proof = digest("".join(b + a for b, a in path + up))
            out.append((doc_id, own, tops[s][0], root, proof, node, node == root))
    return out


@pytest.mark.parametrize("fan,levels", [(2, 1), (2, 2), (3, 2), (16, 3)])
def test_manifest_against_brute_force(spark, fan, levels):
    rows = [(k, f"Text {k} É", "en", None if k % 11 == 0 else "hot" if k % 3 else f"s{k % 7}", k) for k in range(61)]
    rows += [(5, "Text 5 É", "en", "hot", 5), (5, "Text 5 É", "en", "hot", 5), (5, "other", "en", "hot", 5), (None, None, None, None, None),
             (None, "X", "", "", None), (-3, "", None, "é", 0), (10 ** 12, "Long Ä " * 40_000, "de", "lone", 1)]
    docs = spark.createDataFrame([(*r, "r", "l") for r in rows], DOCS)
    got = manifest.audited(docs, fan, levels).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    order = lambda r: (r[1], r[4])
    assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(brute(rows, fan), key=order)


def test_manifest_of_nothing_and_of_one_row(spark):
    assert manifest.audited(spark.createDataFrame([], DOCS)).count() == 0
    row, = manifest.audited(spark.createDataFrame([(1, "a", "en", "s", 1, "", "")], DOCS)).collect()
    assert row.leaf == row.subroot == row.root and row.path == [] and row.proof_sha256 == digest("")


def test_fold_finds_any_changed_leaf(spark):
    made = manifest.audited(spark.range(40).select(F.col("id").alias("doc_id"), F.lit("A").alias("text"), F.lit(None).cast("string").alias("lang"),
                                                   F.lit("s").alias("source"), F.lit(1).alias("n_chars")), 4, 2)
    assert made.where(manifest.fold(F.reverse("leaf")) == F.col("root")).count() == 0
    assert made.where(manifest.fold(F.col("leaf")) == F.col("root")).count() == 40


# repeated byte strings

def brute_repeats(texts, length):
    """n_bytes, n_removed, n_spans and hash of the kept bytes of each text."""
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if r else 0
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_windows_of_small_collections():
    rng = random.Random(4)
    for _ in range(200):
        length = rng.choice([3, 7, 20])
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 70))) for _ in range(rng.randint(1, 12))})
        copies = np.array([rng.choice([1, 1, 2]) for _ in strings])
        seen = collections.Counter()
        for s, m in zip(strings, copies):
            seen.update({w: n * int(m) for w, n in collections.Counter(s[i:i + length] for i in range(len(s) - length + 1)).items()})
        want = [[i for i in range(len(s) - length + 1) if seen[s[i:i + length]] > 1] for s in strings]
        assert [f.tolist() for f in suffixes.repeated_windows(strings, copies, length)] == want


@pytest.mark.parametrize("length,anchor,crowd", [(40, 12, 20_000), (40, 12, 2), (200, 64, 20_000)])
def test_repeats_against_brute_force(spark, monkeypatch, length, anchor, crowd):
    rng = random.Random(length)
    words = ["alpha", "bé", "日本", "gamma,", "x", "Delta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    passage, line = prose(60), prose(9) + "\n"
    texts = [prose(rng.randint(0, 120)) for _ in range(20)]
    texts += [prose(5) + passage + prose(rng.randint(0, 9)) for _ in range(30)]  # one passage, different neighbours
    texts += [texts[3], texts[3], texts[25], texts[3][:-1], "é" * 300, "ab" * 500, "=" * 400, line * 30, "", None, "short", "\x00" * 250]
    texts += [passage[:length], passage[1:length], prose(30_000) + passage + prose(20)]
    docs = spark.createDataFrame([(k % 50 if k % 9 else None, t, "l", "s", 1, "r", "t") for k, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, t1 string, key string")
    if crowd == 2:
        monkeypatch.setattr(suffixes, "SHARE", 4)
        monkeypatch.setattr(suffixes, "CROWDS", 1 << 40)
    got = suffixes.digest(suffixes.repeats_removed(docs, length=length, anchor=anchor, crowd=crowd)).collect()
    order = lambda r: tuple((v is not None, v) for v in r)
    want = [(k % 50 if k % 9 else None, *b) for k, b in enumerate(brute_repeats(texts, length))]
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)
    assert sum(r.n_removed for r in got) > 0


def test_repeats_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.digest(suffixes.repeats_removed(docs)).count() == 0


def test_removed_runs_and_kept_bytes(spark):
    docs = spark.createDataFrame([(1, "a" * 5 + "0123456789" * 3), (2, "0123456789" * 3 + "z")], "doc_id long, text string")
    rows = sorted(suffixes.repeats_removed(docs, length=25, anchor=10).collect())
    assert [(r.removed[0].first, r.removed[0].end, bytes(r.kept)) for r in rows] == [(5, 35, b"aaaaa"), (0, 30, b"z")]


# pages that break

def test_cut_off_and_unbalanced_tags_take_linear_time():
    start = time.process_time()
    assert html.extract("<article><p>Text of a page that is cut off inside a tag.</p><div " + 'a="b" ' * 20_000) .startswith("Text of a page")
    for page in ("<b" * 50_000, "<b 'x\" " * 20_000 + "'>", '<a href="' * 50_000 + ">", "<!" * 50_000, "<" * 50_000 + ">"):
        html.extract(page)
    assert time.process_time() - start < 5
    assert html.extract("<p>One <b title=\"x>bold</b> and more words to make it long enough.</p>").startswith("One bold and more")
    assert html.extract("<p>Five < six and seven > two, as everybody knows by heart.</p>") == "Five < six and seven > two, as everybody knows by heart."


def test_articles_of_comments_and_teasers():
    own = "<article><h1>Title</h1><p>The article itself, long enough to be kept, with a <span class='nav-term tag'>word</span> inside.</p></article>"
    want = "Title\n\nThe article itself, long enough to be kept, with a word inside."
    for after in ('<div id="comments"><article class="comment"><p>A reader says something long about it all.</p></article></div>',
                  '<section class="comments"><ol><li><article><p>A reader says something long about it all.</p></article></li></ol></section>',
                  '<aside class="related"><article><p>Read this other article of ours as well today.</p></article></aside>',
                  '<article class="teaser promo"><p>Read this other article of ours as well today.</p></article>'):
        assert html.extract("<body>" + own + after + "</body>") == want
    assert html.extract('<div class="menu"><ul><li>Home</li>' + own) == want  # a menu left open
    two = own + "<article><p>A second article of the page that is no less long.</p></article>"
    assert html.extract(two) == want + "\n\nA second article of the page that is no less long."
