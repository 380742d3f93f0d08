import hashlib
import random
import re

import numpy as np
import public_tokenizers as tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partwise.llm import bpe, chat, dedup, html, licences, lines, mixing, neighbours, quality, queries, toxicity
from partwise.llm.common import remainder, table

DIR = "/root/testdata/sf0.01"
EDGE = [None, "", " \n\t", "word", "a b c d e f g", "a b c d e f g", "x" * 50_000, "wort für wort " * 5000]
RNG = random.Random(1)


def words(n):
    return [f"w{RNG.randrange(100_000)}" for _ in range(n)]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def both(ranks):
    import tiktoken

    return bpe.Encoder(ranks, tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_bpe_equals_library(both, text):
    own, other = both
    assert own.encode(text) == other.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


def test_perfect_hash_is_minimal(ranks):
    slots = bpe.PerfectHash([*ranks]).slots([*ranks])
    assert sorted(slots.tolist()) == [*range(len(ranks))]


def test_bpe_edges(docs, ranks, both):
    got = {r.doc_id: r for r in bpe.encode(docs(EDGE, True), ranks, tokenizers.PATTERN).collect()}
    for i, t in enumerate(EDGE):
        ids = both[1].encode_ordinary(t or "")
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(docs([]), ranks, tokenizers.PATTERN).count() == 0


def test_bpe_of_two_vocabularies(docs, ranks):
    """Vocabularies that differ in one entry alone are told apart, and further columns don't clash."""
    swapped = dict(ranks)
    a, b = [k for k in ranks if len(k) > 3][1000:1002]
    swapped[a], swapped[b] = ranks[b], ranks[a]
    text = a.decode("utf-8", "ignore")
    df = docs([text]).withColumn("n_tokens", F.lit("mine")).withColumn("ids", F.lit(1))
    one, two = (bpe.encode(df, r, tokenizers.PATTERN).first().ids for r in (ranks, swapped))
    assert one != two and bpe.Encoder(swapped, tokenizers.PATTERN).encode(text) == two


# ---- near duplicates


def brute_classes(texts):
    s = dedup.Sketcher()
    own = {i: s.shingles(dedup.words_of(t)) for i, t in enumerate(texts) if dedup.words_of(t)}
    root = {i: i for i in range(len(texts))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in own:
        for j in own:
            if j < i and dedup.similarity(own[i], own[j]) >= dedup.THRESHOLD:
                root[find(i)] = find(j)
    return {frozenset(i for i in root if find(i) == r) for r in map(find, root)}


def test_dedup_equals_brute_force(docs):
    base = [words(RNG.randint(30, 200)) for _ in range(12)]
    texts = [*EDGE]
    for b in base:
        for _ in range(RNG.randint(1, 12)):
            own = b[:]
            for _ in range(RNG.randint(0, 4)):
                own[RNG.randrange(len(own))] = f"e{RNG.randrange(9)}"
            texts.append(" ".join(own))
    got = dedup.near_duplicates(docs(texts, True)).collect()
    assert len(got) == len(texts)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == brute_classes(texts)
    assert all(sum(r.kept for r in got if r.class_id == c) == 1 for c in classes)
    assert all(r.class_size == len(classes[r.class_id]) for r in got)


def test_dedup_of_a_large_star(docs):
    """80 copies near one text but not near each other; its row is neither first nor last."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(100_000)}" for _ in range(200)]
    texts = []
    for _ in range(80):
        own = base[:]
        for at in rng.sample(range(5, 195), 3):
            own[at] = f"e{rng.randrange(100_000)}"
        texts.append(" ".join(own))
    texts.insert(50, " ".join(base))
    texts.append(" ".join(base[:80] + [f"z{i}" for i in range(120)]))
    got = dedup.near_duplicates(docs(texts, True)).collect()
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(c) for c in classes.values()} == brute_classes(texts)
    assert sorted(map(len, classes.values())) == [1, 81]


@pytest.mark.parametrize("seed, around", [(3, 3), (3, 15)])
def test_dedup_of_a_bridge(docs, seed, around):
    """Two groups joined by one link between members that each have links in their own group and are no bucket's centre."""
    rng = random.Random(seed)

    def edited(text, places):
        text = text[:]
        for at in places:
            text[at] = f"e{rng.randrange(10**9)}"
        return text

    x = [f"w{rng.randrange(100_000)}" for _ in range(200)]
    y = edited(x, (20, 60, 100, 140))
    p, q = edited(x, [170]), edited(y, [185])
    texts = [x, y, p, q, *(edited(g, [rng.choice((8, 30, 40, 50, 70, 80, 90, 110, 120, 130, 150))]) for g in (p, q) for _ in range(around))]
    got = dedup.near_duplicates(docs([" ".join(t) for t in texts])).collect()
    assert len(brute_classes([" ".join(t) for t in texts])) == 1
    assert len({r.class_id for r in got}) == 1


def test_dedup_empty(docs):
    assert dedup.near_duplicates(docs([])).count() == 0
    assert dedup.near_duplicates(docs([None, None, ""])).where("kept").count() == 3


@pytest.mark.parametrize("small, block", [(dedup.SMALL, dedup.BLOCK_NODES), (4, 16), (10**6, 16)])
def test_dedup_equals_all_pairs_of_all_buckets(spark, docs, monkeypatch, small, block):
    """Texts about the threshold from one, in buckets of many sizes: the classes are those of comparing every pair that shares a bucket."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(1000)}" for _ in range(150)]
    texts = []
    for i in range(260):
        own = base[:]
        for at in rng.sample(range(len(own)), rng.choice((1, 2, 3, 4, 5, 6))):
            own[at] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    monkeypatch.setattr(dedup, "BLOCK_NODES", block)
    monkeypatch.setattr(dedup.links, "__defaults__", (small,))
    got = dedup.near_duplicates(docs(texts)).collect()
    s = dedup.Sketcher()
    own = [s.shingles(t.split()) for t in texts]
    keys = [set(s.band_keys(s.signature(x)).tolist()) for x in own]
    root = [*range(len(texts))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if keys[i] & keys[j] and dedup.similarity(own[i], own[j]) >= dedup.THRESHOLD:
                root[find(i)] = find(j)
    classes = {}
    for r in got:
        classes.setdefault(r.class_id, set()).add(r.doc_id)
    expected = {}
    for i in range(len(texts)):
        expected.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values())) and 1 < len(classes) < 260


def test_dedup_of_equal_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (5, text + " more"), (5, "another text altogether"), (5, None), (7, "")]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4 and sorted(r.class_size for r in got) == [1, 1, 1, 3, 3, 3]


def test_signature_estimates_weighted_jaccard():
    s = dedup.Sketcher()
    a = words(300)
    b = a[:270] + words(30)
    x, y = s.shingles(a + a[:60]), s.shingles(b + a[:60])
    agree = float((s.signature(x) == s.signature(y)).mean())
    assert abs(agree - dedup.similarity(x, y)) < 0.12


# ---- line frequency


def brute_figures(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(ls) - len(set(ls)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#|é\x1c\x85", max_size=80))
def test_line_figures(text):
    assert lines.figures(text)[:5] == brute_figures(text)


def test_line_limits(docs):
    common = "follow us on every channel for daily news and offers today"
    texts = [f"{common} 12\n" + " ".join(words(60)) for _ in range(80)] + [f"{common} {i}\n" * 6 for i in range(4)] + EDGE
    got = {r.doc_id: r for r in lines.filtered(docs(texts, True)).collect()}
    assert len(got) == len(texts)
    assert all(got[i].removed_words == 12 and got[i].kept for i in range(80))
    assert all(got[i].removed_words == 72 and not got[i].kept for i in range(80, 84))
    assert not got[84].kept and got[84].base_failed and got[84].n_words == 0
    assert lines.filtered(docs([])).count() == 0


def test_line_hosts(spark):
    """A null host is a host of its own, by which lines are counted apart; clashing columns don't matter; limits may be of no host."""
    common = "follow us on every channel for daily news and offers today"
    rows = [(i, None if i % 2 else "a", f"{common}\n" + " ".join(words(60)), 1) for i in range(140)] + [(None, None, None, 1), (7, "b", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, line int")
    got = lines.filtered(df, least=50, share=0.02).collect()
    assert len(got) == 142 and sum(r.removed_words == 11 for r in got) == 140
    assert all(r.removed_words == 0 for r in lines.filtered(df, least=100).collect())


# ---- licences


def test_licences(docs):
    texts = [*EDGE, "Intro.\nReleased under the MIT License.\nMore.", "Licensed under CC BY-NC 4.0. text", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "license of a driver"]
    texts.append("\n".join(licences.SENTENCES[k][0] + "." for k in ("bsd.redistribution", "bsd.source", "bsd.binary")))
    texts.append("\n".join(licences.SENTENCES[k][0] + "." for k in ("bsd.binary", "bsd.source", "bsd.redistribution")))
    got = {r.doc_id: r.licences for r in licences.scan(docs(texts, True)).collect()}
    assert [got[i] for i in range(8)] == [[]] * 8
    assert [got[i] for i in range(8, 15)] == [["MIT"], ["CC-BY-NC-4.0"], ["Apache-2.0"], ["GPL-3.0"], [], ["BSD-2-Clause"], []]


def test_every_sentence_and_rule_is_found():
    owner = {licences.normal(s): k for k, each in licences.SENTENCES.items() for s in each}
    assert len(owner) == len({(licences.normal(s), k) for k, each in licences.SENTENCES.items() for s in each})  # no sentence has two identifiers
    for k, each in licences.SENTENCES.items():
        for s in each:
            assert licences.identifiers(s) == licences.identifiers(f"One more.\n{s}.\nText.") == [k], s
    for name, rule, _ in licences.RULES:
        for sep in ("\n", ".\n\n", ". "):
            assert (name, 1.0) in licences.licences(sep.join(licences.SENTENCES[k][0] for k in rule) + ".")[1], name


@pytest.mark.parametrize("sign", ["// ", "/* ", "; ", "| ", "% ", "! ", "= ", "-" * 70 + " ", "/" * 70 + " "])
def test_licences_behind_signs(sign):
    assert licences.identifiers(f"{sign}Licensed under the MIT License\n{sign}All rights reserved.") == ["MIT.notice", "reserved"]


def test_licences_of_lines_beside_a_wrapped_sentence():
    grant = licences.SENTENCES["mit.grant"][0].replace(" ", "\n * ", 12)
    assert licences.identifiers(f"All rights reserved\n * {grant}\n * Licensed under CC BY 4.0") == ["reserved", "mit.grant", "CC-BY-4.0.notice"]


KNOWN_SENTENCES = {licences.normal(s): k for k, each in licences.SENTENCES.items() for s in each}


def brute_licences(text):
    """Every run of parts of a paragraph is compared with every known sentence; every subsequence of every rule with the text's identifiers."""
    from itertools import combinations

    known, ids = KNOWN_SENTENCES, []
    for paragraph in re.split(r"\n\s*\n", text or ""):
        parts, i = re.split(r"\n+|(?<=[.!?;:])\s+(?=\S)", paragraph), 0
        while i < len(parts):
            runs = [j for j in range(i + 1, len(parts) + 1) if licences.normal(" ".join(parts[i:j])) in known and licences.normal(parts[i])]
            if runs:
                ids.append(known[licences.normal(" ".join(parts[i : runs[-1]]))])
            i = runs[-1] if runs else i + 1
    found = {}
    for name, rule, least in licences.RULES:
        for n in range(len(rule), 0, -1):
            rest = lambda sub: (it := iter(ids)) and all(x in it for x in sub)
            if any(rest(sub) for sub in combinations(rule, n)):
                if n / len(rule) >= least - 0.01:
                    found[name] = max(n / len(rule), found.get(name, 0))
                break
    if "BSD-3-Clause" in found:
        found.pop("BSD-2-Clause", None)
    return sorted(found), [found[k] for k in sorted(found)], len(ids)


def test_licences_equal_brute_force(spark, docs):
    import zlib

    rng = random.Random(8)
    every = [s for each in licences.SENTENCES.values() for s in each]
    heavy = [s for k, each in licences.SENTENCES.items() for s in each if not k.endswith(".notice")]
    texts = [None, ""]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 8)):
            s = rng.choice(heavy if rng.random() < 0.7 else every)
            if rng.random() < 0.3:
                s = s.replace(" ", rng.choice(("\n", "\n * ", "  ")), rng.randint(1, 9))
            parts.append(rng.choice(("", "// ", "* ", "Some text here. ")) + s + rng.choice((".", ".", "", " indeed.")))
        texts.append(rng.choice(("\n", " ", "\n\n")).join(parts))
    texts += [r.text for r in table(spark, DIR, "documents", "doc_id", "text").collect() if zlib.crc32(str(r.doc_id).encode()) % 40 == 0]
    got = {r.doc_id: (r.licences, r.coverage, r.n_sentences) for r in licences.scan(docs(texts)).collect()}
    for i, t in enumerate(texts):
        names, coverage, n = brute_licences(t)
        assert got[i][0] == names and got[i][1] == pytest.approx(coverage) and got[i][2] == n, t
    assert licences.scan(docs([])).count() == 0


# ---- classifiers


@pytest.mark.parametrize("name, label, n, fold, least", [("op5_quality", "quality", 4, 2, 0.95), ("op7_toxicity", "toxic", 5, 0, 0.93)])
def test_held_out_accuracy(spark, name, label, n, fold, least):
    d = "/root/testdata/sf0.1"
    got = queries.QUERIES[name](spark, d).join(table(spark, d, "labels", "doc_id", label), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least
    assert got.where(remainder("doc_id", n) != fold).count() == 0


def test_votes_equal_brute_force(spark):
    """The scores of the operator, from plain loops over all labelled vectors."""
    docs = table(spark, DIR, "documents", "doc_id", "text")
    space = quality.learn(docs, table(spark, DIR, "labels", "doc_id", "quality"), F.lit(True), per_class=60)
    got = {r.doc_id: r.score for r in quality.score(docs, space).collect()}
    terms = quality.Terms()
    for r in docs.where("doc_id % 10 = 0").collect():
        ids, values = terms.of(r.text)
        z = [sum(float(v) * float(space.idf[i]) * float(space.basis[i, d]) for i, v in zip(ids, values, strict=True)) for d in range(space.basis.shape[1])]
        size = sum(x * x for x in z) ** 0.5 or 1.0
        near = sorted(((sum(x * float(y) for x, y in zip(z, v, strict=True)) / size, float(label)) for v, label in zip(space.vectors, space.labels, strict=True)), reverse=True)[:15]
        weight = [max(c, 0) ** 4 for c, _ in near]
        assert got[r.doc_id] == pytest.approx((sum(w * label for w, (_, label) in zip(weight, near, strict=True)) + 5e-4) / (sum(weight) + 1e-3), abs=1e-3)


def test_classifier_rows(spark):
    """Null and repeated ids each keep their row; labels of null ids or other values are no labels."""
    rows = [(None, "good text of many words"), (None, "good text of many words"), (3, "bad"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 1), (3, 0, 0), (3, 1, 1), (9, 7, 7)], "doc_id long, quality int, toxic int")
    for m in (quality, toxicity):
        assert m.score(df, m.learn(df, labels, F.lit(True))).count() == 4
        assert m.score(df.where("false"), m.learn(df.where("false"), labels, F.lit(True))).count() == 0


def test_classifier_edges(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    own = docs(EDGE, True)
    scores = quality.score(own, quality.learn(own, labels, F.lit(True))).collect()
    assert [r.score for r in scores] == [0.5] * len(EDGE)
    scores = toxicity.score(own, toxicity.learn(own, labels, F.lit(True))).collect()
    assert len(scores) == len(EDGE) and all(0 <= r.score < 0.5 for r in scores)


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idio": 6.0, "oaf$": 5.0})
    w = lambda text: g.clause(text.lower().split())
    assert w("you are an idiot") == w("you idiot") == w("idiot you") == pytest.approx(6 * toxicity.WITH_TARGET)
    assert w("idiot are an you") == w("the idiot man") == w("idiot") == 6  # order decides whether a target governs
    assert w("you are not an idiot") == w("i do not think you are an idiot") == pytest.approx(6 * toxicity.WITH_TARGET * toxicity.NEGATED)
    assert w("you are an idiot not") == w("not him but you are an idiot") == pytest.approx(6 * toxicity.WITH_TARGET)  # a negation's scope
    told = 6 * toxicity.WITH_TARGET * toxicity.REPORTED
    assert w("she said you are an idiot") == w("you are an idiot she said") == pytest.approx(told)
    assert w("she said hello to the idiot man") == pytest.approx(6 * toxicity.REPORTED)
    assert w("i will kill you") == w("ich werde dich töten") == w("kill all of you") + 2 == 2 and w("i will kill time") == 0
    assert w("you are an oaf") == pytest.approx(5 * toxicity.WITH_TARGET) and w("loaf of oafs") == 0
    assert w("") == 0 and g.score("") < 0.5 < g.score("you are an idiot") and g.score("x " * 9) < g.score("i will kill you")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("idiot kill you not said a are but word idiots töten ne".split()), max_size=6))
def test_best_path_equals_enumeration(words):
    """The best path through the composition is the best of all sequences of arcs through the four transducers one after the other."""
    g = toxicity.Grammar({"idio": 6.0, "töte": 1.5})
    parts = [toxicity.negation(), toxicity.reported_speech(), toxicity.target(), toxicity.threat()]

    def readings(states, i):
        if i == len(words):
            return [0.0] if all(s in p.final for s, p in zip(states, parts, strict=True)) else []
        out = []
        for kind, w in g.lexical(words[i]):
            open_ = [(kind, w, ())]
            for s, p in zip(states, parts, strict=True):
                open_ = [(y, w * v, (*own, to)) for x, w, own in open_ for y, v, to in p.arcs[s].get(x, ())]
            out += [w + rest for _, w, own in open_ for rest in readings(own, i + 1)]
        return out

    assert g.clause(words) == pytest.approx(max(readings((0,) * 4, 0), default=0.0))


def test_short_words_can_be_learnt(spark):
    rng, rows = random.Random(4), []
    for i in range(200):
        said = [f"w{rng.randrange(500)}" for _ in range(30)]
        if i % 2:
            for _ in range(3):
                said.insert(rng.randrange(len(said)), "zyx")
        rows.append((i, " ".join(said), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    g = toxicity.learn(df.drop("toxic"), df.select("doc_id", "toxic"), F.lit(True))
    assert g.stems["zyx$"] > 1 and g.score("you zyx") > 0.5 > g.score("you zyxw")


# ---- main text


def test_main_text_of_labelled_pages():
    model, wrong, n = html.Model(html.labelled_pages()), 0, 0
    for page, content in html.labelled_pages(100, 77):
        tree = html.Tree(page)
        for text, p in zip(tree.text, model.marginals(tree), strict=True):
            n += text is not None
            wrong += text is not None and (p > 0.5) != (text in content)
    assert wrong / n < 0.02


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>T</title><meta charset=utf-8><article><h1>Head line</h1><p>It has no end tag of its head.</p></article>", "Head line\n\nIt has no end tag of its head."),
    ("<body><div><button>Share</div><article><h1>Head line</h1><p>The button has no end.</p></article>", "Head line\n\nThe button has no end."),
    ("<body><button>Share<article><h1>Head line</h1><p>The button has no end.</p></article><button>x</button>", "Head line\n\nThe button has no end."),
    ("<body><datalist><option value=a>x<option value=b>y</datalist><article><h1>Head line</h1><p>Options need no end.</p></article>", "Head line\n\nOptions need no end."),
    ("<body><form><select><option>x<option>y</select></form><article><h1>Head line</h1><p>Options need no end.</p></article>", "Head line\n\nOptions need no end."),
    ("<body><svg><path d='M0'/><text>x</text><article><h1>Head line</h1><p>The picture has no end.</p></article>", "Head line\n\nThe picture has no end."),
    ("<body><object data=x><article><h1>Head line</h1><p>The object has no end.</p></article>", "Head line\n\nThe object has no end."),
    ("<body><div><canvas><p>no canvas</p></div><article><h1>Head line</h1><p>It ends with its block.</p></article><canvas></canvas>", "Head line\n\nIt ends with its block."),
    ("<body><article><h1>Head line</h1><p>We know <math><mi>x</mi><mo>=</mo><mn>1</mn></math> from this text.</p></article>", "Head line\n\nWe know x=1 from this text."),
    ("<body><article><h1>Head line</h1><p>Text before<script>var x='</p>'; and no end", "Head line\n\nText before"),
])
def test_main_text_of_open_elements(page, text):
    assert html.Model(html.labelled_pages()).main_text(page) == text


def test_main_text_equals_the_article(spark):
    """The tables' pages hold one article each: its blocks, read by another parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.parts = False, [[]]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("h1", "p", "div", "li", "ul"):
                self.parts.append([])
            elif tag == "br":
                self.parts[-1].append(" ")

        def handle_endtag(self, tag):
            if tag in ("h1", "p", "div", "li", "ul", "article"):
                self.parts.append([])
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.parts[-1].append(data)

    n = 0
    truth = {}
    for r in table(spark, DIR, "pages", "page_id", "html").collect():
        reader = Reader()
        reader.feed(r.html or "")
        reader.close()
        truth[r.page_id] = "\n\n".join(t for t in (" ".join("".join(p).split()) for p in reader.parts) if t)
    for r in queries.op6_main_text(spark, DIR).collect():
        assert r.text == truth[r.page_id] and r.n_chars == len(r.text)
        n += 1
    assert n == len(truth) > 0


def test_main_text_edges(spark):
    pages = [None, "", "<p", "<div>" * 3000 + "x", "<script>var a='<p>no</p>'</script>", "<article><h1>A &amp; B<b> c\n d</b></h1><p>E f.<p>G.</article><footer>f</footer>"]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in enumerate([*pages, pages[5]])], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got[5] == got[6] == "A & B c d\n\nE f.\n\nG." and got[0] == got[1] == got[4] == "" and len(got) == 7
    assert html.extract(df.where("false")).count() == 0


def test_sum_product_equals_enumeration():
    from itertools import product

    model = html.Model(html.labelled_pages(50))
    tree = html.Tree("<body><nav><a href=x>m</a></nav><article><p>Some text.</p></article></body>")
    n = len(tree.parent)
    weights = {}
    for s in product((0, 1), repeat=n - 1):
        s, w = (0, *s), 1.0
        for i in range(1, n):
            (a, b), e = model.potential(tree.look[i]), model.edge[html.kind_of(tree.look[i], tree.look[tree.parent[i]])]
            w *= (a, b)[s[i]] * e[2 * s[tree.parent[i]] + s[i]]
        weights[s] = w
    whole = sum(weights.values())
    for i in range(1, n):
        assert abs(sum(w for s, w in weights.items() if s[i]) / whole - model.marginals(tree)[i]) < 1e-9


# ---- chat


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool]", ""]), st.text(alphabet="\\<>[]/s INSTRYU\n", max_size=60))
def test_chat_round_trip(role, text):
    rendered, a, b = chat.render(role, text)
    assert chat.read_back(rendered + chat.render("user", "x")[0]) == [(role, text), ("user", "x")]
    assert chat.unescape(rendered[a:b]) == (text if role == "assistant" else "")


def test_chat_folds_events():
    told = [("start", "assistant", None), ("delta", None, "a"), ("regenerate", None, None), ("delta", None, "b"), ("delta", None, None), ("edit", None, "c"), ("delta", None, "d")]
    assert chat.fold(told) == ("assistant", "cd")


def test_chat_query(spark):
    got = {r.conv_id: r for r in queries.op8_chat(spark, DIR).collect()}
    rows = table(spark, DIR, "conversations", "conv_id", "turn", "role", "text").collect() + [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, t, r, x in sorted(map(tuple, rows)):
        by.setdefault(c, []).append((r, x or ""))
    assert set(by) == set(got)
    for c, turns in by.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_edges(spark):
    """Null conversations, turns, roles and texts, repeated turns, an empty log; each message once, in order."""
    rows = [(None, 0, "user", "a"), (1, None, "user", "b"), (1, 0, None, "c"), (1, 0, "assistant", None), (1, 0, "assistant", None), (1, 1, "assistant", "d" * 20_000), (1, 1, "user", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.messages(chat.log_of(df))).collect()}
    assert set(got) == {None, 1} and got[None].n_turns == 1 and got[1].n_turns == 6 and got[1].loss_chars == 20_000
    said = [("user", "b"), ("", "c"), ("assistant", ""), ("assistant", ""), ("assistant", "d" * 20_000), ("user", "e")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest()
    assert chat.digests(chat.messages(chat.log_of(df.where("false")))).count() == 0


def test_chat_of_edits_and_regenerations(spark):
    """Events out of order in the table, of several messages at once."""
    events = [(1, 0, 1, 3, "delta", None, "lo"), (1, 0, 1, 0, "start", "user", None), (1, 0, 1, 2, "delta", None, "hel"), (1, 1, 1, 0, "start", "assistant", None), (1, 1, 1, 1, "delta", None, "bad"),
              (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "good"), (1, 2, 1, 0, "start", "user", None), (1, 2, 1, 1, "delta", None, "x"), (1, 2, 1, 5, "edit", None, "y")]
    df = spark.createDataFrame(events, "conv_id long, turn long, message long, seq long, kind string, role string, text string")
    got = chat.messages(df).orderBy("turn").collect()
    assert [chat.read_back(r.rendered)[0] for r in got] == [("user", "hello"), ("assistant", "good"), ("user", "y")]
    assert [chat.unescape(r.rendered[r.loss_from : r.loss_to]) for r in got] == ["", "good", ""]


# ---- mixture


def edf(shares, length):
    """The indices of the sources in order, by a plain simulation of all slots."""
    all_, done, out = sum(shares), [0] * len(shares), []
    for slot in range(length):
        best = min((-(-(k + 1) * all_ // a), i) for i, (k, a) in enumerate(zip(done, shares, strict=True)) if k * all_ // a <= slot)
        out.append((best[1], done[best[1]]))
        done[best[1]] += 1
    return out


@pytest.mark.parametrize("weights", [[1, 3, 6], [1], [5, 5], [7, 11, 13, 17, 400], [1, 997, 500, 500], [RNG.randint(1, 500) for _ in range(40)], [RNG.randint(1, 9) ** 3 for _ in range(12)], [3] * 300])
def test_schedule_equals_simulation(spark, weights):
    """Segments of few slots, each made on its own, give what one simulation of all slots gives; no deviation reaches a block."""
    rows = [(f"s{i:03}", max(1, 40 * w // max(weights)), w) for i, w in enumerate(weights)]
    got = mixing.schedule(spark.createDataFrame(rows, "key string, blocks long, a long"), segment=4).orderBy("slot").collect()
    assert [r.slot for r in got] == [*range(len(got))]
    assert [(int(r.key[1:]), r.k) for r in got] == edf(weights, len(got))
    assert all(r.release <= r.slot < r.deadline for r in got)
    done = np.zeros(len(weights))
    for t, r in enumerate(got, 1):
        done[int(r.key[1:])] += 1
        assert np.abs(done * sum(weights) - np.array(weights) * t).max() < sum(weights)
    assert all(done[i] >= blocks for i, (_, blocks, _) in enumerate(rows))


def test_mixture(spark):
    rows = [(i, "big" if i % 3 else ("mid" if i % 2 else None), "same" if i < 40 else str(i)) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, source string, block string")
    got = mixing.mixed(df, block_rows=8).toPandas()
    got["source"] = got["source"].fillna("-")
    blocks = got.groupby(["slot", "source"]).size().reset_index()
    assert blocks["slot"].is_unique and sorted(blocks["slot"]) == [*range(len(blocks))]
    assert ((got["slot"] >= got["release"]) & (got["slot"] < got["deadline"])).all()
    first = got[got["epoch"] == 0]
    assert len(first) == 3005 and sorted(first["doc_id"]) == sorted(r[0] for r in rows + rows[:5])
    assert first.groupby(["source", "block"])["nth"].apply(lambda n: sorted(n) == [*range(len(n))]).all()
    for (_, _), own in got.groupby(["source", "block"]):
        assert own.groupby("epoch")["doc_id"].apply(sorted).map(tuple).nunique() == 1  # an epoch's block holds the same rows
    sizes = first.groupby("source").size() ** mixing.TEMPERATURE
    for s, share in (sizes / sizes.sum()).items():
        run = (blocks["source"] == s).to_numpy().cumsum()
        assert np.abs(run - share * np.arange(1, len(blocks) + 1)).max() < 1
    assert mixing.mixed(df.where("false")).count() == 0


def test_mixture_of_equal_rows(spark):
    """Rows equal in every column are all kept; null columns and a single source make no difference."""
    df = spark.createDataFrame([(1, None, None)] * 500 + [(None, "a", "t")] * 70, "doc_id long, source string, text string")
    got = mixing.mixed(df, block_rows=4)
    assert got.where("epoch = 0").count() == 570 and got.where("epoch = 0 and source = 'a'").count() == 70
    one = mixing.mixed(df.where("source = 'a'")).collect()
    assert len(one) == 70 and {r.slot for r in one} == {0, 1, 2}


def test_mixture_of_given_weights(spark):
    """300 sources, and weights that leave a source many epochs; every slot within one block of its share."""
    df = spark.range(3000).select("id", F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    assert mixing.mixed(df, block_rows=2).where("epoch = 0").count() == 3000
    df = spark.range(6000).select("id", F.when(F.col("id") < 5000, "a").when(F.col("id") < 5990, "b").otherwise("c").alias("source"))
    weights = {"a": 0.1, "b": 0.3, "c": 0.6}
    got = mixing.mixed(df, spark.createDataFrame([*weights.items()], "source string, weight double"), block_rows=1).select("source", "slot").toPandas().sort_values("slot")
    assert got["slot"].tolist() == [*range(50_000)]
    for s, share in weights.items():
        assert np.abs((got["source"] == s).to_numpy().cumsum() - share * np.arange(1, 50_001)).max() < 1
    for bad in ([("a", 0.1), ("b", 0.3)], [("a", 0.1), ("b", 0.3), ("c", 0.0)]):
        with pytest.raises(Exception, match="no weight above 0"):
            mixing.mixed(df, spark.createDataFrame(bad, "source string, weight double")).count()


# ---- neighbours


def brute_recall(df, got, k=20):
    """The share of the true k nearest that were found; every score must be the exact inner product, ranks and ties in order."""
    data = df.toPandas()
    x, ids = np.stack(data["embedding"].to_numpy()).astype(float), data["vec_id"].to_numpy()
    at = {v: i for i, v in enumerate(ids.tolist())}
    hit = n = 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        scores = x @ x[at[q]]
        assert np.abs(own["score"].to_numpy() - scores[[at[v] for v in own["vec_id"]]]).max() < 1e-9
        assert own["rank"].tolist() == [*range(1, len(own) + 1)] and q not in set(own["vec_id"])
        assert own[["score", "vec_id"]].apply(tuple, axis=1).tolist() == sorted(own[["score", "vec_id"]].apply(tuple, axis=1), key=lambda r: (-r[0], r[1]))
        scores[at[q]] = -np.inf
        best = set(ids[np.lexsort((ids, -scores))[:k]].tolist())
        hit, n = hit + len(best & set(own["vec_id"])), n + len(best)
    return hit / n


@pytest.mark.parametrize("shard_rows", [neighbours.SHARD_ROWS, 1500])
def test_neighbours_recall(spark, shard_rows):
    df = table(spark, "/root/testdata/sf0.1", "embeddings", "vec_id", "embedding")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).toPandas()
    assert brute_recall(df, got) >= 0.9


def test_neighbours_of_clusters_are_few_candidates(spark):
    """Unit vectors about 100 centres, of several norms: prefixes stay long, so little of the table is scored."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((100, 32))
    x = centres[rng.integers(0, 100, 6000)] + 0.15 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = neighbours.Forest(x, 1.0)
    share = [n / len(x) for _, _, n in forest.search(x[:200], 21, 256, 0.2)]
    assert sum(share) / len(share) < 0.1
    scaled = x[:2000] * rng.uniform(0.5, 1.0, (2000, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(scaled)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    assert brute_recall(df, got) >= 0.9


def test_neighbours_of_another_length(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [1.0]), (4, [1.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.lit(True)).collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(1, 2), (2, 1)]


def test_neighbours_edges(spark):
    vectors = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(20 * i, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=2).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(140, 2.0), (120, 1.0)]
    assert {r.query_id for r in got} == {100, 120, 140, 160}
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_words_of_any_length_are_learnt(spark):
    """A word of 60,000 letters is one stem, known as a whole; it has no 60,000 prefixes."""
    long = "ab" * 30_000
    texts = [f"you are a {long} x{i} and the {long} y{i} of dork{i}" if i < 10 else f"a calm text about z{i}" for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    grammar = toxicity.learn(docs, spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int"), F.lit(True))
    assert grammar.stem(long) > 0 and grammar.score(texts[0]) > 0.5 > grammar.score(texts[20])
    assert max(map(len, grammar.stems)) < 80 and toxicity.whole(long) != toxicity.whole(long + "a") and toxicity.whole("no") == "no$"


# ---- pipeline


def test_pipeline_equals_operators(spark):
    """Each stage's rows, recomputed from its operator's own verdicts on the stage before."""
    import corpus_pipeline

    docs, kept = table(spark, DIR, "documents", *corpus_pipeline.COLUMNS), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).persist()
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert name == "byte-level BPE" or docs.columns == corpus_pipeline.COLUMNS
    assert kept[0] >= kept[1] >= kept[2] == kept[3] == kept[4]
    texts = {r.doc_id: r.text for r in table(spark, DIR, "documents", "doc_id", "text").collect()}
    ids = sorted(kept[1])
    assert len(kept[2]) == len(brute_classes([texts[i] for i in ids]))


def test_run_equals_brute_force(spark, both):
    """run()'s rows from verdicts of the single queries, plain classes of all pairs, a simulated schedule and the library's tokens."""
    import corpus_pipeline

    got = corpus_pipeline.run(spark, DIR).select("doc_id", "n_tokens", "ids_sha256").collect()
    good = {r.doc_id for r in queries.op5_quality(spark, DIR).where("predicted = 1").collect()}
    toxic = {r.doc_id for r in queries.op7_toxicity(spark, DIR).where("predicted = 1").collect()}
    rows = {r.doc_id: r for r in table(spark, DIR, "documents", *corpus_pipeline.COLUMNS).collect() if r.doc_id in good - toxic}
    ids = sorted(rows)
    classes = brute_classes([rows[i].text for i in ids])
    kept = {r.doc_id for r in got}
    assert all(len(kept & {ids[i] for i in c}) == 1 for c in classes) and len(kept) == len(classes)
    sizes = {}
    for i in kept:
        sizes[rows[i].source] = sizes.get(rows[i].source, 0) + 1
    names = sorted(sizes)
    weights = [sizes[s] ** mixing.TEMPERATURE for s in names]
    a = [max(1, round(w / sum(weights) * mixing.UNIT)) for w in weights]
    blocks = [-(-sizes[s] // mixing.BLOCK_ROWS) for s in names]
    given = edf(a, max(-(-b * sum(a) // x) for b, x in zip(blocks, a, strict=True)))
    expected = dict.fromkeys(names, 0)
    for i, k in given:
        k %= blocks[i]
        expected[names[i]] += min(mixing.BLOCK_ROWS, sizes[names[i]] - k * mixing.BLOCK_ROWS)
    found = dict.fromkeys(names, 0)
    for r in got:
        found[rows[r.doc_id].source] += 1
        tokens = both[1].encode_ordinary(rows[r.doc_id].text or "")
        assert r.n_tokens == len(tokens) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest()
    assert found == expected


def test_stages_carry_clashing_columns(spark):
    import corpus_pipeline

    docs = table(spark, DIR, "documents", *corpus_pipeline.COLUMNS).limit(60).withColumns({c: F.lit("mine") for c in ("score", "uid", "kept", "slot", "block", "class_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.where("score = 'mine' and kept = 'mine' and slot = 'mine'").count() == out.count() > 0
        assert stage(spark, docs.where("false"), DIR).count() == 0
