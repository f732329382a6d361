"""Problems 1, 5, 8, 9 and 10 on small fixtures."""

import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import bpe, packing, pii, residue, wrapper

VOCAB = os.path.join(bpe.TOKENIZERS, "byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
def test_bpe_equals_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    texts = ["", None, " ", "\n\n a", "a  b\x1c c\x85 d  ", "aaaa" * 2000, "it's  we'LL", "क" * 700 + "ि", "<|endoftext|> x", "👉🏽 é ﬁ"]
    texts += ["".join(r.choice("ab 'sकिा1२.\n é") for _ in range(r.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {x.doc_id: x.ids for x in bpe.encode_column(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(texts):
        assert got[i] == lib.encode_ordinary(s or ""), repr(s)
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary here")
def test_bpe_long_and_short_paths_agree():
    v = bpe.Vocabulary(VOCAB)
    w = bytes(random.Random(1).choice(b"aeint rs") for _ in range(200))
    assert v.encode_long(w).tolist() == v.encode_rows([w], 256)[0].tolist()


def test_packing_holds_all_constraints():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 100, 2000)
    b = packing.pack(sizes, 100, max_docs=5, max_cost=6000)
    for k in range(b.max() + 1):
        s = sizes[b == k]
        assert s.sum() <= 100 and len(s) <= 5 and ((s.astype(float) ** 2).sum() <= 6000 or len(s) == 1)
    tight = packing.pack(sizes, 100)
    assert tight.max() + 1 <= 1.02 * sizes.sum() / 100 + 1
    assert len(packing.pack(np.zeros(0, dtype=int), 10)) == 0


def test_each_limit_of_a_container_binds(spark):
    sizes = np.array([60, 40, 30, 30, 20, 10, 5, 5])
    assert packing.pack(sizes, 100).max() + 1 == 2
    by_docs = np.bincount(packing.pack(sizes, 100, max_docs=2))
    assert by_docs.max() == 2 and len(by_docs) == 4
    by_cost = packing.pack(sizes, 100, max_cost=3000)
    assert (np.bincount(by_cost) == 1)[by_cost[0]] and by_cost.max() + 1 == 3  # 60 alone has a cost of 3600
    df = spark.createDataFrame([(i, 10) for i in range(300)] + [(300 + i, 990) for i in range(5)], "doc_id long, tokens long")
    rows = packing.fill(df, 1000, 1, max_docs=50, max_cost=0.9 * 1000**2).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r.tokens)
    assert max(map(len, bins.values())) == 50 and all(len(x) == 1 for x in bins.values() if 990 in x) and len(bins) == 11


def test_all_bins_are_weighed():
    r = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(r.integers(1, 60, 150))[::-1]
        got, room, docs, cost = packing.pack(sizes, 100, max_docs=6, max_cost=5000), [], [], []
        for s, b in zip(sizes.tolist(), got.tolist()):
            norm = [((x - s) / 100) ** 2 + 0.05 * (1 - (n + 1) / 6) ** 2 + 0.05 * (1 - (c + s * s) / 5000) ** 2 if x >= s and n < 6 and c + s * s <= 5000 else 9 for x, n, c in zip(room, docs, cost)]
            want = int(np.argmin(norm)) if norm and min(norm) < 9 else len(room)
            assert b == want
            if want == len(room):
                room.append(100), docs.append(0), cost.append(0)
            room[b] -= s
            docs[b] += 1
            cost[b] += s * s


def test_fill_splits_only_what_is_too_long(spark):
    rows = [(1, 25), (2, 10), (3, 7), (4, 3), (5, 0)]
    got = packing.fill(spark.createDataFrame(rows, "doc_id long, tokens long"), 10, 1).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.tokens) for r in got) == [(1, 0, 0, 10), (1, 1, 10, 10), (1, 2, 20, 5), (2, 0, 0, 10), (3, 0, 0, 7), (4, 0, 0, 3)]
    assert packing.fill(spark.createDataFrame([], "doc_id long, tokens long"), 10, 1).count() == 0


@pytest.mark.parametrize(
    "sentence, kind",
    [
        ("Please enable JavaScript to read this page.", "script"), ("404 Not Found", "error"), ("Dear <<date>>, read <<intro>>", "template"), ("{{body}}", "template"), ("[object Object]", "output"),
        ("Lorem ipsum dolor sit amet elit", "filler"), ("xxx xxx xxx xxx", "filler"), ("यहाँ अपना पाठ लिखें।", "filler"), ("माफ़ कीजिए, यह पेज नहीं मिला।", "error"),
        ("Trainers told students when to enable JavaScript and when to leave it off.", None), ("Cards were printed with {{name}} in place of names, the weather centre admitted, and 9 will be replaced.", None),
        ("Officials said the 'page not found' message on the portal was caused by traffic.", None), ("An art show prints lorem ipsum on handloom cloth.", None), ("The bridge was opened on Monday.", None), ("", None),
    ],
)
def test_evidence(sentence, kind):
    assert residue.evidence(sentence) == kind


def test_residue_subtracts_furniture(spark):
    foot = "Please enable JavaScript for the best experience"
    rows = [(f"d{i}", f"https://www.x.example/a/story-{i}.html", f"The council met on day {i} and agreed on the plan.\n{foot}") for i in range(40)]
    rows += [("e", "https://y.example/{{slug}}-1.html", "News of the day is here."), ("f", None, "Page not found"), ("g", "https://y.example/b", None), ("f", None, "Page not found"), ("h", "https://z.example/c", foot)]
    df = spark.createDataFrame(rows, "doc_id string, url string, body string").withColumns({"host": F.lit("clash"), "kind": F.lit(0)})
    assert {r.doc_id: r.kind for r in residue.residue(df).collect()} == {"e": "url", "f": "error", "h": "script"}
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [30, 300])
def test_residue_keeps_evidence_that_is_the_body(spark, n):
    nav, notice = "Home | News | Sport", "404 Not Found"
    bad = {f"d{i}" for i in range(0, n, 5)}
    body = lambda i: f"{nav}\n{notice}" + ("\nRef " + "qwrtz"[i % 5] * 3 if i % 2 else "") if f"d{i}" in bad else f"{nav}\nThe council of ward {i} met and agreed on the plan for roads."
    df = spark.createDataFrame([(f"d{i}", f"https://x.example/{i}", body(i)) for i in range(n)], "doc_id string, url string, body string")
    assert {r.doc_id for r in residue.residue(df).collect()} == bad


def _pages(n=40):
    r = random.Random(7)
    w = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(300)]
    prose = lambda: " ".join(r.choice(w) for _ in range(12)).capitalize() + "."
    rows, want = [], {}
    for i in range(n):
        lines, bad = [], []
        for kind in ("nav", "nav", "ad", "p", "sub", "p", "ad2", "p", "label", "t", "t", "foot"):
            if kind in ("nav", "ad", "foot") and r.random() < 0.3:
                continue
            line = {"nav": r.choice(["Home", "Sports", "Weather"]), "ad": "Story continues below", "p": prose(), "sub": "What happened next?", "ad2": r.choice(["Story continues below", "", ""]), "label": "More stories", "t": " ".join(r.choice(w) for _ in range(6)), "foot": f"© 20{i % 10} Site"}[kind]
            lines.append(line)
            if line and kind not in ("p", "sub"):
                bad.append(len(lines))
        rows.append((f"d{i}", f"https://www.site.example/{i}", "site", f"Title {w[i]} here" + (" | Site" if i % 2 else ""), "\n".join(lines)))
        want[f"d{i}"] = ([0] if i % 2 else []) + bad
    return rows, want


def test_wrapper_finds_what_is_not_the_story(spark):
    rows, want = _pages()
    rows += [("n", "https://www.site.example/n", "site", None, None), ("d0", *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id string, url string, source string, headline string, body string").withColumn("lines", F.lit(1))
    got = {r.doc_id: list(r.lines) for r in wrapper.boilerplate(df).collect()}
    assert got.pop("n") == []
    assert got == want
    assert wrapper.boilerplate(df.limit(0)).count() == 0


def test_wrapper_keeps_a_syndicated_story(spark):
    rows, want = _pages()
    story = "\n".join(f"The {x} of the valley was opened to the public on Monday." for x in ("bridge", "school", "market"))
    rows += [(f"s{i}", f"https://h{i}.example/{i}", f"h{i}", "Title", "Home\n" + story) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id string, url string, source string, headline string, body string")
    got = {r.doc_id: list(r.lines) for r in wrapper.boilerplate(df).collect()}
    assert got == want | {f"s{i}": [1] for i in range(6)}


def test_a_label_is_furniture_on_its_host_only(spark):
    para = lambda i, j: f"Story {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} has part {'uvwxyz'[j]} and tells of the road."
    rows = [(f"h{i}", "https://hot.example/x", "hot", "T", f"{para(i, 0)}\n{para(i, 1)}\nBackground") for i in range(40)]
    rows += [(f"o{i}", f"https://o{i % 6}.example/x", "o", "T", f"{para(i, 2)}\nBackground\n{para(i, 3)}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id string, url string, source string, headline string, body string")
    got = {r.doc_id: list(r.lines) for r in wrapper.boilerplate(df).collect()}
    assert got == {f"h{i}": [3] for i in range(40)} | {f"o{i}": [] for i in range(40)}


def test_wrapper_expression():
    w = wrapper.Wrapper()
    w.add([1, "P", "P", 2], [False, False, True, False])
    w.add([1, "P", 3, "P", 2], [False, False, True, False, False])
    w.add([2, "P"], [False, False])
    tokens = {n[0] for n in w.nodes}
    assert tokens == {1, 2, 3, "P"} and w.pages == 3
    assert next(n for n in w.nodes if n[0] == 3)[3] and next(n for n in w.nodes if n[0] == 3)[1:3] == [1, 1]


@pytest.fixture(scope="module")
def model():
    r = random.Random(2)
    names = ["rihal", "sukel", "tarvesh", "lomesh", "kovil", "argan"]
    places = ["Sapur", "Higaon", "Leegarh"]
    fill = ["The road work in {p} was delayed by rain and {n} workers left.", "Officials in {p} said {n} villages got water.", "Receipt no. {d10} was reissued.", "Tender {d12} was cancelled.", "The ward member said the queue began before dawn."]
    hot = ["The claim was filed by {a} {b}.", "First in the race was {a}.", "Write to {a}{n}@mail.example before noon.", "Call {d10} for help.", "Aadhaar no. {d12} is wrong.", "The family lives at house {n}, Mill Road, {p}."]
    texts = []
    for _ in range(500):
        line = []
        for _ in range(4):
            t = r.choice(hot if r.random() < 0.35 else fill)
            line.append(t.format(p=r.choice(places), n=r.randint(1, 400), a=r.choice(names).title(), b=r.choice(names).title(), d10="9" + "".join(r.choice("0123456789") for _ in range(9)), d12=" ".join(str(r.randint(1000, 9999)) for _ in range(3))))
        texts.append("\n".join([" ".join(line[:2]), " ".join(line[2:])]))
    return pii.train(texts, names[:3], windows=900, epochs=8, again=8), texts


def test_pii_on_held_out_accuracy(model):
    m, texts = model
    lines = [x for t in texts[:150] for x in t.split("\n")]
    ok = n = 0
    for line, tagged in zip(lines, m.tag_lines(lines)):
        got, want = {k for _, _, k in pii.spans(line, tagged)}, set(pii.label(line, m.lexicon).tolist()) - {0}
        n += len(got | want)
        ok += len(got & want)
    assert ok >= 0.9 * n


def test_pii_windows_agree_and_edges(spark, model):
    m, _ = model
    long = "The road work in Sapur was delayed by rain and 20 workers left. " * 30 + "Call 9876543210 for help."
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "\n\nWrite to argan7@mail.example before noon."), (5, "  ")], "doc_id long, text string").withColumn("kind", F.lit(1))
    got = {(r.doc_id, r.line_no, r.kind) for r in pii.find(df, m).collect()}
    assert {(1, 1, "phone"), (4, 3, "email")} <= got and not any(g[0] in (2, 3, 5) for g in got)
    masked = {r.doc_id: r.text for r in pii.mask(df, m).collect()}
    assert masked[2] is None and masked[3] == "" and masked[5] == "  "
    assert masked[4].startswith("\n\nWrite to [EMAIL] before") and "9876543210" not in masked[1] and "[PHONE]" in masked[1]


def test_gradients_are_right():
    t = pii.Tagger(hidden=3, seed=2)
    r = np.random.default_rng(0)
    ids = r.integers(1, 60, (3, 6))
    ids[2, 4:] = 0
    tags = r.integers(0, pii.TAGS, (3, 6))
    n = np.array([6, 6, 4])
    for k in t.p:
        t.p[k] = t.p[k].astype(np.float64)
    _, g = t.gradients(ids, tags, n)
    for k, at in (("U", (0, 1, 2)), ("W", (1, 0, 3)), ("A", (1, 2)), ("b", (2,)), ("T", (0, int(ids[0, 0]), 4)), ("T", (1, int(ids[1, 3]), 10))):
        old = t.p[k][at]
        t.p[k][at] = old + 1e-4
        up = t.gradients(ids, tags, n)[0]
        t.p[k][at] = old - 1e-4
        down = t.gradients(ids, tags, n)[0]
        t.p[k][at] = old
        assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3, k


def test_long_notices_are_evidence():
    s = "Please enable JavaScript in the settings of the program with which you read this page, then load the page again and wait until all parts of it have been shown on the screen."
    assert len(s.split()) > 24 and residue.evidence(s) == "script"
    assert residue.evidence("") is None and residue.text_evidence(None) is None


def test_reading_has_the_scores_of_training():
    r = np.random.default_rng(6)
    tagger = pii.Tagger()
    ids = r.integers(1, pii.FLAGS * pii.CHARS, (7, 40))
    ids[3, 25:] = pii.PAD
    want = tagger.emissions(ids)
    assert np.allclose(tagger.read(ids).reshape(want.shape), want, atol=1e-4)
    # one array without gaps for each gate: columns of a wider one take several times as long
    assert all(len(gates) == 4 and all(x.shape[1] == tagger.hidden and x.flags.c_contiguous for x in gates) for gates in tagger.Tr)
