import html
import itertools
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import decontam, extraction, langid, pii, toxicity
from strandline.llm.extraction import extract_pages, main_text

# Extraction

ARTICLE = "<article><h1>Title here</h1><p>First &amp; foremost <b>bold</b> text<br>goes on for quite a while, so that it is dense.</p><p>Second\n paragraph, also  of some length and more words.</p></article>"
TEXT = "Title here First & foremost bold text goes on for quite a while, so that it is dense. Second paragraph, also of some length and more words."


@pytest.mark.parametrize(
    "page",
    [
        ARTICLE,
        f"<!DOCTYPE html><html><head><title>x</title><style>p{{}}</style><script>var a='</p>'</script></head><body><nav><ul><li><a href=x>Home</a></ul></nav>{ARTICLE}<footer>foot</footer></body></html>",
        f"<body class='has-sidebar'><header><h1>Site</h1></header><div class=cookie-notice>We use cookies</div><main>{ARTICLE}</main><aside>More</aside></body>",
        f"<body><div id=wrap>{ARTICLE}<div class='comments'><p>{'What a nice comment this is. ' * 5}</p></div><form><input><label>Mail</label></form></div></body>",
        f"<body><div class='ad'>Buy now</div>{ARTICLE}<div role=complementary>Side</div><div hidden>secret</div><!-- <p>no</p> --></body>",
        f"<BODY><DIV CLASS='sidebar-layout'>{ARTICLE}</DIV><section class=related><a href=1>One</a><a href=2>Two</a></section>",
    ],
)
def test_the_article_alone_is_left(page):
    assert main_text(page) == TEXT


def test_article_without_its_tag():
    parts = "".join(f"<div><p>{'Paragraph of real text with many words in it. ' * 4}</p></div>" for _ in range(4))
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(30))
    text = main_text(f"<body><div><ul>{links}</ul></div><div><div>{parts}</div></div><div><a href=x>about</a> <a href=y>terms</a></div></body>")
    assert text.count("Paragraph") == 16 and "Link" not in text and "terms" not in text


def test_broken_pages():
    assert main_text("<p>a<p>b<div>c</p>d") == "a b c d" and main_text(None) == "" and main_text("<nav>x</nav>") == ""
    assert main_text("text only &lt;b&gt;") == "text only <b>" and main_text("<b>" * 3000 + "x") == "x" and main_text("<p>cut <a href='") == "cut"
    assert main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1 2 3"


def random_tree(rng, depth=0):
    """(markup, characters, tags, characters in links, links, children) of a random element, counted while it is written."""
    tag = rng.choice(["div", "section", "span", "b", "a"] if depth else ["div"])
    link = tag == "a"
    out, chars, tags, lc, lt, children = "", 0, 1, 0, int(link), []
    for _ in range(rng.randint(1, 4)):
        if depth < 4 and not link and rng.random() < 0.6:
            child = random_tree(rng, depth + 1)
            if tag in ("span", "b") and any(t in child[0] for t in ("<div", "<section")):
                continue
            out, chars, tags, lc, lt = out + child[0], chars + child[1], tags + child[2], lc + child[3], lt + child[4]
            children.append(child)
        else:
            word = "x" * rng.randint(1, 60)
            out, chars, lc = out + word, chars + len(word), lc + len(word) * link
    return f"<{tag}>{out}</{tag}>", chars, tags, lc, lt, children


def test_densities_are_those_of_the_formula():
    rng = random.Random(31)
    for _ in range(200):
        tree = random_tree(rng)
        page = extraction._Page(f"<body>{tree[0]}</body>")
        wanted, queue = [], [tree]
        while queue:
            markup, c, t, lc, lt, children = queue.pop(0)
            ratio = max(c / max(lc, 1) * t / max(lt, 1), 1)
            base = np.log(c / max(c - lc, 1) * max(lc, 1) + tree[3] / max(tree[1], 1) * c + np.e) if lc else np.log(c / max(c - 1, 1) + tree[3] / max(tree[1], 1) * c + np.e)
            wanted.append(c / t * np.log(ratio) / base if c else 0.0)
            queue = children + queue
        # page order: an element before its children
        assert np.allclose(page.densities()[2:], wanted), tree[0]
        total = [0.0] * len(page.tag)
        for i, d in enumerate(page.densities()):
            if i:
                total[page.parent[i]] += d
        kept = extraction._selected(page, hints=False)
        assert kept[max(range(1, len(total)), key=lambda i: (total[i], -i))] or max(total[1:]) == 0


def test_density_finds_most_articles_without_tags_and_names():
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")["html"]
    same = sum(main_text(h.replace("<article>", "<div>").replace("</article>", "</div>"), hints=False) == main_text(h) for h in pages)
    assert same >= 0.8 * len(pages)


def test_names_are_hints():
    theorem = ARTICLE.replace("<p>Second", "<div class='notice-of-theorem'>Let <math><mi>x</mi>=2</math> hold.</div><p>Second")
    assert "Let x=2 hold." in main_text(theorem)
    page = f"<body><div class=comments>{ARTICLE.replace('article>', 'div>')}</div><div>short</div></body>"
    assert "Second paragraph" in main_text(page)
    assert main_text(f"<form id=page>{ARTICLE}</form>") == TEXT


def test_a_long_page_takes_time_in_proportion():
    paragraph = "<p>Some <b>text</b> with <a href=x>a link</a> and words enough to be dense, again and again.</p>"
    for page in (f"<article>{paragraph * 40_000}</article>", "<div>" * 100_000 + "x" * 100 + "</div>" * 100_000, "<p>" + "word &amp; " * 400_000):
        began = time.process_time()
        assert main_text(page)
        assert time.process_time() - began < 60


def test_pages_table(spark, sf):
    rows = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, ARTICLE, "z")], "page_id long, url string, html string, text string")
    found = extract_pages(rows).collect()
    assert sorted(r["text"] for r in found) == ["", "", TEXT] and all(r["n_chars"] == len(r["text"]) for r in found)
    assert extract_pages(rows.limit(0)).count() == 0
    pages = {r["page_id"]: r["html"] for r in sf[1]("pages").collect()}
    for r in extract_pages(sf[1]("pages")).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        inner = re.sub(r"<(script|style|form|aside|nav|footer)\b.*?</\1>|<!--.*?-->", " ", inner, flags=re.S | re.I)
        words = Counter(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        got = Counter(r["text"].split())
        # nothing but words of the article, and almost all of them: notices and comments inside it go
        assert not got - words and sum((got & words).values()) >= 0.9 * sum(words.values())


def test_parts_of_articles_are_not_judged_by_a_word():
    long = "These sentences say at some length what other people found before, and how far it agrees with us. " * 3
    for opening in ('<section class="related work">', '<section id="discussion">', '<div class="share">'):
        page = f"<article><h1>Title</h1><p>{long}</p>{opening}<p>{long}</p></div></section><p>{long}</p></article>"
        assert main_text(page).count("agrees with us") == 9
    links = '<div class="related">' + "".join(f"<a href=x{i}>Another story that you may like {i}</a> " for i in range(9)) + "</div>"
    assert "Another story" not in main_text(f"<article><p>{long}</p>{links}<p>{long}</p></article>")
    assert "Share this" not in main_text(f'<article><p>{long}</p><div class="share">Share this now</div><p>{long}</p></article>')


def test_media_that_are_never_closed_leave_the_page():
    for tag in ("video", "audio", "object", "svg", "canvas", "iframe"):
        assert main_text(f"<article><p>{TEXT}</p><{tag} src=x><p>{TEXT}</p></article>").count(TEXT) == 2
        assert main_text(f"<article><p>{TEXT}</p><{tag} src=x>fallback</{tag}><p>{TEXT}</p></article>") == f"{TEXT} {TEXT}"


# Language


def test_languages(sf):
    docs = sf[1]("documents")
    found = langid.identify_languages(docs).join(docs, "doc_id")
    assert found.count() == docs.count()
    held = found.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("score < 0 or score > 1").count() == 0
    for r in found.limit(20).collect():
        import zlib

        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_mixed_text_has_both_languages(sf):
    docs = sf[1]("documents").where("n_chars > 600")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    texts = {lang: docs.where(F.col("lang") == lang).first()["text"][:600] for lang in ("en", "de")}
    shares = langid.proportions([texts["en"] + " " + texts["de"], texts["de"], "", "123"], model, langid.letters_below())
    en, de = model.languages.index("en"), model.languages.index("de")
    assert 0.3 < shares[0][en] < 0.7 and 0.3 < shares[0][de] < 0.7 and shares[1][de] > 0.95
    assert not shares[2].any() and not shares[3].any()


def mixture_by_hand(log_p, n):
    """Sets of languages one after another, each fitted by many small steps of expectation and maximisation."""
    k = log_p.shape[1]
    p = np.exp(log_p - log_p.max(axis=1, keepdims=True))

    def fitted(languages):
        pi = np.zeros(k)
        pi[list(languages)] = 1 / len(languages)
        for _ in range(2000):
            q = p * pi
            q = q / q.sum(axis=1, keepdims=True) * n[:, None]
            pi = q.sum(axis=0) / n.sum()
        return pi, (n * np.log((p * pi).sum(axis=1))).sum() - (len(languages) - 1) * np.log(n.sum() + 1)

    return max((fitted(c) for m in range(1, k + 1) for c in itertools.combinations(range(k), m)), key=lambda x: x[1])[0]


def test_mixtures_are_the_best_of_all_sets():
    rng = np.random.default_rng(8)
    for shares in ([1, 0, 0, 0, 0], [0.5, 0.5, 0, 0, 0], [0.2, 0.3, 0.5, 0, 0], [0.25, 0.25, 0.25, 0.25, 0]):
        language = rng.choice(5, 400, p=shares)
        log_p = rng.normal(-8, 0.5, (400, 5)).astype(np.float32)
        log_p[np.arange(400), language] += 6
        n = rng.integers(1, 4, 400).astype(np.float32)
        found = langid._of_sets(log_p, n, np.zeros(1, np.int64), 10)[0]
        assert np.abs(found - mixture_by_hand(log_p.astype(float), n)).max() < 0.03, shares


def test_a_long_text_has_the_shares_of_its_words(sf):
    docs = sf[1]("documents").where("n_chars > 300")
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    letters = langid.letters_below()
    text = " ".join(r["text"] for r in docs.limit(60).collect()).lower()
    whole = langid.proportions([text], model, letters)[0]
    assert np.abs(langid.proportions_of_long(text, model, letters, block_chars=5000) - whole).max() < 1e-3
    assert not langid.proportions_of_long("1 2 " * 5000, model, letters, block_chars=5000).any()
    assert len(langid.proportions_of_long("x" * 50_000, model, letters, block_chars=5000)) == len(model.languages)


def test_odd_languages(odd):
    found = {r["doc_id"]: r for r in langid.identify_languages(odd).collect() if r["doc_id"] not in (4,)}
    assert found[1]["lang_pred"] == found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[7]["lang_pred"] == "en"
    kept = langid.keep_identified(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert langid.identify_languages(odd.limit(0)).count() == 0


# Toxicity


@pytest.fixture(scope="module")
def toxic_words(spark, make):
    rng = random.Random(1)
    clean = ["the", "house", "is", "near", "river", "and", "trees", "grow", "there", "stone", "water", "light", "paper", "garden"]
    bad = ["idiot", "stupid", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(clean) for _ in range(30)]
        toxic = i % 4 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(toxic_words):
    docs, labels = toxic_words
    found = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.where("predicted = toxic").count() == found.count() > 100
    assert found.where("predicted <> cast(score >= 0.7 as int) or score < 0 or score > 1").count() == 0


def test_obfuscated_words_are_restored(toxic_words, make):
    docs, labels = toxic_words
    model = toxicity.fit(docs, labels)
    for span, word in {"1d1ot": "idiot", "st*pid": "stupid", "m0r0n": "moron", "i d i o t": "idiot", "stuuupiiid": "stupid", "m.o.r.o.n": "moron", "$tupid": "stupid", "stuupid": "stupid", "mor0n,": "moron", "i - d - i - o - t": "idiot", "m  o  r  o  n": "moron", "1diot": "idiot"}.items():
        assert word in toxicity.restore(f"the house {span}, is near", model.letters), span
    for plain in ("the house is 12 years old", "mail a.b@house.com now", "4316522678525456", "stop!!! now"):
        assert toxicity.restore(plain, model.letters) == plain
    hidden = make([(9001, "the house 1d1ot is near the river"), (9002, "the house is near the river")])
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(docs.union(hidden), labels).where("doc_id > 9000").collect()}
    assert scores == {9001: 1, 9002: 0}


def likeliest(token, model):
    """All paths through the lattice, one by one."""
    best = None
    for path in itertools.product(*toxicity.lattice(token)):
        state, cost, out = toxicity.EDGE, 0.0, ""
        for letter, price in path:
            cost += price
            if letter and not (letter == " " and state == toxicity.EDGE):
                cost, out = cost + model.of(state + letter), out + letter
                state = toxicity.EDGE if letter == " " else state[1] + letter
        cost += model.of(state + " ") if state != toxicity.EDGE else 0.0
        best = min(best or (cost, out.strip()), (cost, out.strip()))
    return best[1]


def test_decoding_is_the_likeliest_of_all_paths():
    rng = random.Random(12)
    letters = "aeidth"
    grams = {a + b + c: rng.uniform(0.2, 8) for a in letters + " " for b in letters + " " for c in letters + " " if rng.random() < 0.7}
    model = toxicity.CharModel(grams, 9.0)
    parts = {}
    for _ in range(1500):
        token = "".join(rng.choice("aeidthaeidth01$!.-73") for _ in range(rng.randint(1, 7)))
        assert toxicity.decode(token, model) == toxicity.decode(token, model, parts) == likeliest(token, model), token


def test_decoding_takes_time_in_proportion_to_the_length():
    rng = random.Random(13)
    for signs, size in (("abcdefghijklmnopqrstuvwxyz0123456789", 1_000_000), ("a1", 400_000), ("aa7$", 400_000)):
        began = time.process_time()
        toxicity.decode("".join(rng.choice(signs) for _ in range(size)), toxicity.CharModel({}, 9.0))
        assert time.process_time() - began < 60


def test_toxicity_is_learned_from_all_labelled_rows(make, spark):
    # a word in 1 of 2,500 rows: a sample of 20,000 rows would hold it too seldom
    texts = [f"{'grumbold' if i % 2500 == 0 else 'quiet'} sleeps here" for i in range(30_000)]
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 2500 = 0 as int) as toxic")
    model = toxicity.fit(make(texts), labels)
    seen = []
    spied = toxicity.fit_weights
    toxicity.fit_weights = lambda rows, size: (seen.append(rows.groupBy("toxic").agg({"n": "sum"}).collect()), spied(rows, size))[1]
    try:
        toxicity.fit(make(texts), labels)
    finally:
        toxicity.fit_weights = spied
    assert dict(map(tuple, seen[0])) == {0: 29_988, 1: 12}
    assert model.weights["grumbold$"] > 0 and model.bias < 0


def test_odd_toxicity(odd, spark):
    labels = spark.createDataFrame([(4, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd, labels).count() == 11
    assert toxicity.score_toxicity(odd.limit(0), labels.limit(0)).count() == 0


# Personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def spans_by_hand(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == 2:
                total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_patterns_are_those_of_plain_regexes():
    rng = random.Random(2)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789.+-@ a()é") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(text) == spans_by_hand(text), text
    assert pii.base_spans("1" * 100_000) == [] and pii.base_spans("a" * 100_000 + "@") == []


def test_repeated_and_similar_things_are_added_by_the_field(spark, sf):
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    cases = {
        "pay 4316522678525456 now, and again 1 4316522678525456 end, but not 9739312764672899": "card:38:54",
        "call +1 (523) 555-1055 now, then (523) 555-1055 and 523 555 1055 or mistyped 5235551056": "phone:33:47,phone:52:64,phone:77:87",
        "write joe.smith@mail.example.com, if not joe.smith@mailexamplecom": "email:41:65",
        "a number 523 555 1055 alone, and 1234567 twice 1234567": "",
        "9739312764672899 and 9739312764672899": "",
    }
    for text, added in cases.items():
        assert pii.listed(pii.added_spans(text, pii.base_spans(text), model)) == added, text
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = pii.find_personal_data(docs).select(F.expr("n_email + n_ip + n_card + n_phone").alias("n"), F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).alias("all"))
    assert rows.where("all < n").isEmpty() and rows.where("all > n").count() >= 1


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(3)
    for links, exact in (
        ([(0, 0, 1), (0, 1, 2), (1, 1, 3)], True),
        ([(0, 0, 1), (0, 1, 2), (2, 2, 3), (1, 3, 4)], True),
        ([(0, 0, 1), (0, 1, 2), (0, 2, 3), (1, 0, 3)], False),
    ):
        n = max(max(e[1:]) for e in links) + 1
        node = rng.normal(size=(n, pii.LABELS))
        node[0] = -30.0
        node[0, 3] = 0.0
        pairs = rng.normal(size=(3, pii.LABELS, pii.LABELS))
        pairs = (pairs + pairs.transpose(0, 2, 1)) / 2
        wanted = np.zeros((n, pii.LABELS))
        for labels in itertools.product(range(pii.LABELS), repeat=n):
            weight = np.exp(sum(node[i, y] for i, y in enumerate(labels)) + sum(pairs[k, labels[a], labels[b]] for k, a, b in links))
            wanted[np.arange(n), labels] += weight
        wanted /= wanted.sum(axis=1, keepdims=True)
        assert np.abs(pii.marginals(node, links, pairs) - wanted).max() < (1e-4 if exact else 0.1)


def test_potentials_are_learned_from_the_counts():
    """Without neighbours the pseudo-likelihood is largest at the observed shares."""
    import pandas as pd

    around = ",".join(["0"] * 3 * pii.LABELS)
    table = pd.DataFrame([("a", "", 0, 2, around, 900.0), ("a", "", 0, 4, around, 100.0), ("b", "", 0, 4, around, 500.0)], columns=["shape", "context", "failed", "label", "around", "n"])
    model = pii.learned(table)
    score = model.bias + model.shapes["a"]
    share = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    assert abs(share[2] - 0.9) < 0.03 and abs(share[4] - 0.1) < 0.03


def test_a_long_text_of_numbers_takes_time_in_proportion(sf):
    model = pii.FieldModel(np.zeros(pii.LABELS), np.zeros(pii.LABELS), {}, {}, np.zeros((3, pii.LABELS, pii.LABELS)))
    rng = random.Random(1)
    text = "+1 523 555 1055 " + " x ".join(str(rng.randrange(10**9, 10**10)) for _ in range(40_000))
    began = time.process_time()
    pii.added_spans(text, pii.base_spans(text), model)
    assert time.process_time() - began < 60


def test_odd_personal_data(odd, make):
    assert pii.find_personal_data(odd).count() == 11 and pii.find_personal_data(odd.limit(0)).count() == 0
    row = pii.find_personal_data(make(["é a@b.co 1.2.3.4"])).first()
    assert (row["n_email"], row["n_ip"], row["spans"]) == (1, 1, "email:2:8,ip:9:16")


# Benchmark leaks


def edited(text, edits, rng):
    chars = list(text)
    for _ in range(edits):
        p = rng.randrange(len(chars))
        kind = rng.choice("ids")
        if kind == "d":
            del chars[p]
        else:
            chars[p : p + (kind == "s")] = [rng.choice("etaoin")]
    return "".join(chars)


def distance(a, b):
    """Least edits from `a` to any part of `b`."""
    row = np.zeros(len(b) + 1, int)
    for i, x in enumerate(a, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, y in enumerate(b, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
        row = new
    return int(row.min())


def test_leaks_are_found_and_measured(spark, make, words):
    rng = random.Random(4)
    items = [(i, " ".join(words(30))) for i in range(12)] + [(90, ""), (91, None), (None, "no id"), (92, "tiny item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs, wanted = [], set()
    for i in range(60):
        filler = " ".join(words(60))
        if i % 2:
            item, text = items[i % 12]
            text = edited(text, int(len(text) * (i % 8) / 100), rng)
            filler = f"{filler[:100]}, {text}!! {filler[100:]}"
            wanted.add((i, item))
        docs.append((i, filler))
    docs += [(100, items[3][1].upper().replace(" ", "%%% ")), (101, None), (102, ""), (103, "a TINY, item here")]
    wanted |= {(100, 3), (103, 92)}
    rows = decontam.find_leaks(make(docs), benchmark).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(found & wanted) >= len(wanted) - 1 and found <= wanted
    texts, by_id = dict(docs), dict(items)
    fold = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    for r in rows[:8]:
        assert r["distance"] == distance(fold(by_id[r["item_id"]]), fold(texts[r["doc_id"]]))
    blocks = decontam.find_leaks(make(docs), benchmark, block_chars=300).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == found
    clean = decontam.drop_leaking(make(docs), benchmark)
    assert {r["doc_id"] for r in clean.collect()} == set(texts) - {d for d, _ in found}


def leak_recall(share, rng, trials=100, least=100, most=1500):
    """Share of edited items, within the allowed edits by brute force, that are found in their texts; and the number of others found."""
    table = decontam.fold_table()
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(2000)]

    def text(size):
        out = ""
        while len(out) < size:
            out += rng.choice(vocabulary) + " "
        return out[:size].strip()

    originals = [text(rng.randint(least, most)) for _ in range(trials)]
    items = decontam.prepare(list(range(trials)), originals, table)
    changed = [edited(t, int(len(t) * share), rng) for t in originals]
    near = [distance(t, c) <= int(len(t) * decontam.ALLOWED) for t, c in zip(originals, changed, strict=True)]
    docs = [f"{text(200)} {c} {text(200)}" for c in changed]
    found = {(d, i) for d, i, _, _ in decontam.leaks(docs, items, table, {})}
    wanted = {(i, i) for i in range(trials) if near[i]}
    return len(found & wanted) / len(wanted), len(found - wanted)


def test_leaks_are_found_up_to_the_allowed_edits():
    rng = random.Random(21)
    for share in (0.03, 0.09, 0.12, 0.15):
        recall, others = leak_recall(share, rng, trials=25, most=900)
        assert recall >= 0.95, share
        assert others <= 1  # an item whose edits undo one another
    # short items have few windows, of which none may be little edited
    for least, most in ((20, 30), (30, 60), (60, 110)):
        for share in (0.06, 0.09, 0.12, 0.15):
            assert leak_recall(share, rng, trials=40, least=least, most=most)[0] >= 0.95, (least, share)


def test_gates_leave_out_no_place_of_a_short_item():
    rng = random.Random(31)
    table = decontam.fold_table()
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(4, 16)))[:105].strip() for _ in range(40)]
    ready = decontam.prepare(list(range(40)), items, table)
    for i, item in enumerate(items):
        changed = list(item)
        for _ in range(int(len(item) * decontam.ALLOWED)):
            changed[rng.randrange(len(changed))] = rng.choice("abcdefgh ")
        text = " ".join(word() for _ in range(80)) + " " + "".join(changed) + " " + " ".join(word() for _ in range(80))
        codes, _ = decontam.folded([text], table)
        folded = "".join(map(chr, codes))
        for index in ready.index:
            if index.few and i in index.item:
                begin = folded.find("".join(map(chr, decontam.folded(["".join(changed)], table)[0][:-1])))
                starts = [s for s in decontam.window_starts(codes, index.width) if begin <= s <= begin + len(item) - index.width]
                opened = set(decontam.open_gates(decontam.small_codes(codes), decontam.window_starts(codes, index.width), index.gates).tolist())
                assert set(starts) <= opened


def test_repetitive_items_and_texts_take_bounded_memory():
    tracemalloc.start()
    table = decontam.fold_table()
    for unit, times in (("ha ", 300), ("0 ", 30)):
        items = decontam.prepare([7], [unit * times], table)
        assert [(d, i, k) for d, i, k, _ in decontam.leaks([unit * 60_000, "other words"], items, table, {})] == [(0, 0, 0)]
    assert tracemalloc.get_traced_memory()[1] < 600e6
    tracemalloc.stop()


def test_without_its_walks_the_embedding_finds_less(monkeypatch):
    """Walks that always move on turn the embedding into the text itself, in which an insertion shifts all that follows."""
    walks = decontam._walks
    monkeypatch.setattr(decontam, "kept_by_worker", lambda key, make: make())

    def plain(width, few=False):
        bits, places = walks(width, few)
        return np.minimum(np.ones_like(bits), np.arange(256, dtype=np.uint8)[None, None, :]), places // 2

    monkeypatch.setattr(decontam, "_walks", plain)
    assert leak_recall(0.15, random.Random(22), trials=25, most=600)[0] < leak_recall_with(walks, monkeypatch)


def leak_recall_with(walks, monkeypatch):
    monkeypatch.setattr(decontam, "_walks", walks)
    return leak_recall(0.15, random.Random(22), trials=25, most=600)[0]


def test_leaks_in_scripts_without_blanks():
    rng = random.Random(23)
    table = decontam.fold_table()
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(n))
    originals = [text(120) for _ in range(20)]
    items = decontam.prepare(list(range(20)), originals, table)
    docs = [text(77) + t[:50] + text(3) + t[53:] + text(60) for t in originals]
    assert {(d, i) for d, i, _, _ in decontam.leaks(docs, items, table, {})} == {(i, i) for i in range(20)}


def test_odd_leaks(odd, spark):
    benchmark = spark.createDataFrame([(1, "same words here and there again")], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.find_leaks(odd, benchmark).collect()) == [4, 4, 5]
    kept = decontam.drop_leaking(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontam.find_leaks(odd, benchmark.limit(0)).count() == 0 and decontam.find_leaks(odd.limit(0), benchmark).count() == 0


def test_addresses_in_long_tokens_take_time_in_proportion():
    pattern = re.compile(r"[^\s@<>()\[\]\",;:]+@[^\s@<>()\[\]\",;:]+")
    rng = random.Random(8)
    for _ in range(3_000):
        text = "".join(rng.choice("ab@@ <,.") for _ in range(rng.randint(1, 14)))
        assert list(pii._addresses(text)) == [m.span() for m in pattern.finditer(text)]
    began = time.process_time()
    text = "n" * 1_000_000 + " b@c " + "@" * 100_000 + "x" * 1_000_000
    pii.tokens(text, pii.base_spans(text))
    assert time.process_time() - began < 10
