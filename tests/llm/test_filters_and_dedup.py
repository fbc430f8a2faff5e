import datetime
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from compare import same

from strandline.llm import near_dup as nd
from strandline.llm.exact_dedup import drop_exact_copies, exact_dedup, with_repeats
from strandline.llm.queries import ORACLES, QUERIES
from strandline.llm.url_filter import filter_captures, validity


def test_queries_with_sql(spark, sf):
    for name, sql in ORACLES.items():
        same(spark, sf[0], QUERIES[name], sql)


# URL filter

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(days=n)


ENTRIES = "list string, kind string, pattern string, action string, effective_on date"
CAPTURES = "page_id long, url string, fetched_on date, list string, pattern string"


def test_entries_hold_from_their_day_to_the_next(spark):
    rows = [("l", "host", "a.com", "add", day(5)), ("l", "host", "a.com", "add", day(5)), ("l", "host", "a.com", "remove", day(9)), ("l", "host", "b.com", "remove", day(1)), ("l", "host", "c.com", "add", day(3)), ("l", "host", "c.com", "remove", day(3)), ("l", "host", "d.com", "add", None)]
    found = validity(spark.createDataFrame(rows, ENTRIES)).collect()
    assert [(r["pattern"], r["valid_from"], r["valid_to"]) for r in found] == [("a.com", day(5), day(9))]


def test_captures_meet_what_held_on_their_day(spark):
    entries = [("l", "domain", "Bad.com", "add", day(10)), ("l", "domain", "bad.com", "remove", day(400)), ("m", "prefix", "ok.com/x/y", "add", day(0)), ("m", "host", "only.org", "add", day(0))]
    cases = [
        ("http://www.bad.com/", 9, False), ("http://www.bad.com/", 10, True), ("https://BAD.com:80/q", 399, True), ("http://bad.com", 400, False), ("http://notbad.com", 50, False),
        ("http://ok.com/x/y/z?q", 1, True), ("http://ok.com/x/yz", 1, False), ("http://user@only.org./", 1, True), ("http://sub.only.org/", 1, False), (None, 1, False), ("not a url", 1, False), ("http://ok.com/x/y/z?q", 1, True),
    ]
    captures = spark.createDataFrame([(i, u, day(d), "clash", "clash") for i, (u, d, _) in enumerate(cases)] + [(99, "http://bad.com", None, "", "")], CAPTURES)
    found = {r["page_id"]: r for r in filter_captures(captures, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert [found[i]["blocked"] for i in range(len(cases))] == [b for _, _, b in cases] and not found[99]["blocked"]
    assert found[1]["first_entry"] == "l|domain|bad.com" and found[1]["n_entries"] == 1
    assert filter_captures(captures, spark.createDataFrame([], ENTRIES)).where("blocked").count() == 0
    assert filter_captures(captures.limit(0), spark.createDataFrame(entries, ENTRIES)).count() == 0


# Exact copies


def test_short_domains_and_closing_slashes(spark):
    entries = [("l", "domain", "zip", "add", day(0)), ("l", "prefix", "ok.org/x//", "add", day(0)), ("l", "prefix", "all.org/", "add", day(0)), ("l", "host", "h.org", "add", day(0))]
    cases = [("http://a.b.zip/q", True), ("http://zip/", True), ("http://zipper.org/", False), ("http://ok.org/X/y", True), ("http://ok.org/xy", False), ("http://ok.org//x/", True), ("http://all.org/", True), ("http://all.org/p/q", True), ("http://sub.all.org/", False), ("http://h.org/p", True), ("http://", False)]
    captures = spark.createDataFrame([(i, u, day(1), "", "") for i, (u, _) in enumerate(cases)], CAPTURES)
    found = {r["page_id"]: r["blocked"] for r in filter_captures(captures, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert [found[i] for i in range(len(cases))] == [b for _, b in cases]


def test_exact_copies(odd, spark):
    rows = exact_dedup(odd).collect()
    assert len(rows) == 11
    of = defaultdict(list)
    for r in rows:
        of[r["text_sha256"]].append(r)
    for sha, group in of.items():
        assert {r["group_size"] for r in group} == {len(group)} and sum(r["kept"] for r in group) == 1
        assert all(r["keep_id"] == max((x["doc_id"] for x in group if x["doc_id"] is not None), default=None) for r in group)
    assert len(of[hashlib.sha256(b"").hexdigest()]) == 3
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(of)
    assert exact_dedup(odd.limit(0)).count() == 0 and drop_exact_copies(odd.limit(0)).count() == 0


def test_a_filter_in_parts_lets_few_unique_rows_shuffle(make):
    docs = make([f"text {i}" for i in range(3000)] + ["text 7"] * 2)
    seen = with_repeats(docs, max_bits=8192)
    assert seen.count() == 3002
    maybe = [r["row"]["text"] for r in seen.where("maybe").collect()]
    assert maybe.count("text 7") == 3 and len(maybe) < 60
    assert sorted(map(tuple, exact_dedup(docs, max_bits=8192).collect())) == sorted(map(tuple, exact_dedup(docs).collect()))


def test_a_large_group_and_one_row_many_times(make):
    rows = exact_dedup(make([(i % 40, "copied often") for i in range(3000)] + [(i, f"t{i % 900}") for i in range(1000)])).collect()
    large = [r for r in rows if r["group_size"] == 3000]
    assert len(rows) == 4000 and len(large) == 3000 and {r["keep_id"] for r in large} == {39} and sum(r["kept"] for r in large) == 1
    assert sum(r["kept"] for r in rows) == 901


def test_a_full_filter_changes_no_result(make):
    docs = make([f"text {i % 700}" for i in range(1000)])
    small = exact_dedup(docs, max_bits=4096)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, exact_dedup(docs).collect()))


def test_single_texts_pass_the_filter_unshuffled(make):
    seen = with_repeats(make([f"text {i}" for i in range(3000)] + ["text 7"] * 2))
    maybe = [r["row"]["text"] for r in seen.where("maybe").collect()]
    assert maybe.count("text 7") == 3 and len(maybe) < 60


# Near copies


def bag(text):
    w = text.split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    same_ = sum((a & b).values())
    return same_ / (sum(a.values()) + sum(b.values()) - same_) if a and b else 0.0


def test_signatures_estimate_weighted_similarity(words):
    base = words(60)
    texts = []
    for share in (0.0, 0.1, 0.3, 0.6):
        for _ in range(20):
            items = [base[i % 20] for i in np.random.default_rng(len(texts)).integers(0, 60, 150)]
            texts += [items, [w if np.random.default_rng(i + len(texts)).random() > share else "other" for i, w in enumerate(items)]]
    of = np.repeat(np.arange(len(texts)), 150)
    codes = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    hashes = nd.mix(np.array([codes[w] + 1 for t in texts for w in t], np.uint64))
    signature = nd.signatures(of, hashes, len(texts), 500)
    guess = (signature[0::2] == signature[1::2]).mean(axis=1)
    true = np.array([jaccard(Counter(a), Counter(b)) for a, b in zip(texts[0::2], texts[1::2], strict=True)])
    assert np.abs(guess - true).max() < 0.1 and abs((guess - true).mean()) < 0.01


def test_shingles_are_those_of_whole_words():
    texts = ["a b c d e f", "a  b\tc\nd e f", "a b c", "", "  ", "a b c d e f g", "a b c d", "b c d e f"]
    of, hashes = nd.shingles(texts, nd._Powers())
    sets = [frozenset(hashes[of == i].tolist()) for i in range(len(texts))]
    assert sets[0] == sets[1] and len(sets[0]) == 2 and sets[0] < sets[5] and sets[7] < sets[0]
    assert not sets[3] and not sets[4] and len(sets[2]) == len(sets[6]) == 1 and sets[2] != sets[6]


def by_brute_force(texts):
    first = {}
    for i, t in texts:
        first[t] = min(first.get(t, i), i)
    nodes = sorted(first, key=first.get)
    bags = [bag(t) for t in nodes]
    label = list(range(len(nodes)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            if jaccard(bags[a], bags[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    least = {t: first[nodes[find(k)]] for k, t in enumerate(nodes)}
    return {i: least[t] for i, t in texts}


def test_classes_are_those_of_brute_force(make, words):
    texts, i = [], 0
    for _ in range(25):
        base = words(60)
        for copy in range(6):
            edited = list(base)
            for k in range(copy // 2):
                edited[10 + 25 * k] = f"new{i}"
            texts.append((i, " ".join(edited)))
            i += 1
    texts += [(i, "short one"), (i + 1, "short one"), (i + 2, "short two"), (i + 3, ""), (i + 4, "")]
    found = {r["doc_id"]: r for r in nd.near_duplicates(make(texts)).collect()}
    assert {k: r["class_id"] for k, r in found.items()} == by_brute_force(texts)
    assert all(r["kept"] == (k == r["class_id"]) for k, r in found.items())
    kept = nd.drop_near_duplicates(make(texts))
    assert {r["doc_id"] for r in kept.collect()} == {r["class_id"] for r in found.values()}


def test_a_large_group_is_one_class(make, words):
    base = words(80)
    texts = [" ".join([*base[:40], f"n{i}", *base[41:]]) for i in range(300)]
    found = nd.near_duplicates(make(texts)).collect()
    assert {r["class_id"] for r in found} == {0}


def test_odd_rows(odd):
    rows = nd.near_duplicates(odd).collect()
    assert len(rows) == 11
    same_ = [r["class_id"] for r in rows if r["doc_id"] in (4, 5)]
    assert same_ == [4, 4, 4]
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 7
    assert nd.near_duplicates(odd.limit(0)).count() == 0 and nd.drop_near_duplicates(odd.limit(0)).count() == 0


def test_a_template_group_is_compared_in_full(make):
    """5,000 texts of one template share most buckets at 0.75 to 0.8; planted pairs lie just above 0.8."""
    rng = random.Random(11)
    template = [f"t{i}" for i in range(400)]
    own = {i: [f"o{i}x{j}" for j in range(61)] for i in range(5000)}
    pairs = {(a, a + 1) for a in range(0, 400, 2)}
    for a, b in pairs:
        own[b][:12] = own[a][:12]
    texts = {i: " ".join(template + own[i]) for i in own}
    order = list(texts)
    rng.shuffle(order)
    bags = {i: Counter(zip(*[texts[i].split()[k:] for k in range(nd.WORDS)])) for i in texts}
    holders = defaultdict(list)
    for i, bag in bags.items():
        for shingle in bag:
            holders[shingle].append(i)
    everywhere = sum(len(h) == len(texts) for h in holders.values())
    assert all(len(h) <= 2 or len(h) == len(texts) for h in holders.values())
    common = Counter(tuple(h) for h in holders.values() if len(h) == 2)
    size = len(bags[0])
    alike = {p for p in [*common, (0, 4999)] if (o := everywhere + common[p]) / (2 * size - o) >= nd.SIMILARITY}
    assert alike == pairs and everywhere / (2 * size - everywhere) > 0.7
    found = {r["doc_id"]: r["class_id"] for r in nd.near_duplicates(make([(i, texts[i]) for i in order])).collect()}
    assert found == {i: i - 1 if (i - 1, i) in pairs else i for i in texts}
