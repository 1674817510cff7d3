"""Each operator on small tables: against brute force where SQL cannot tell, and with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wayfind.llm")
from wayfind.llm import chat, decontaminate, html_text, line_dedup, lm_score, media, mixing, near_dedup, toxicity, url_filter
from wayfind.llm.lattice import MARK, Lattice
from wayfind.llm.shingles import split_words

RNG = random.Random(3)
WORDS = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta", "lambda", "zeta"] + [f"w{i}" for i in range(60)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n))


BASE = prose(80)
TEXTS = [None, "", " \n\t", "one two", BASE, BASE, BASE + " end", prose(60), prose(60), "Line\nshared line\nother", "x " * 5000] + [f"shared line \n{prose(5)}" for _ in range(9)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, 0, "kept?") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, n_lines long, verdict string")


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    count = {}
    for t in TEXTS:
        for k in {x.strip(" \t\n\r\v\f").lower() for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    for i, t in enumerate(TEXTS):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (k := x.strip(" \t\r\v\f").lower()) or count[k] < 10]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_toxicity_learns_and_takes_odd_rows(spark):
    rows = [(i, f"{prose(20)} {'vilewords horridly' if i % 5 == 0 else ''}") for i in range(200)] + [(900, None), (901, ""), (902, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(200)] + [(7, 0), (8, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(d, labels).collect()}
    assert min(got[i] for i in range(0, 200, 5)) > 0.7 > max(got[i] for i in range(200) if i % 5)
    assert got[900] == got[901] == got[902] < 0.7
    assert toxicity.score_toxicity(d.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(d.limit(3), labels.where("false")).collect()} != {None}


def test_decontamination_against_brute_force(spark):
    items = [(1, prose(30)), (2, prose(12)), (3, None), (4, "only three words")]
    passage = items[0][1].split()
    passage[3] = "changed"
    d = [(1, f"{prose(40)} {items[0][1].upper()} {prose(9)}"), (2, prose(50)), (3, None), (4, f"before only, three: words after {items[1][1]}"), (5, " ".join(passage)), (1, prose(3))]
    found = decontaminate.find_leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(1, 1), (4, 2), (4, 4)}
    assert not {r["doc_id"] for r in found.collect()} & {2, 3}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(spark.createDataFrame(d, "doc_id long, text string"), empty).count() == 0


def test_decontamination_finds_each_similar_window(spark):
    """Items of 14 to 60 words, a word changed at each position or halves swapped, against all windows of the item's size."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 3, 5, 8, 12])))
    items = [[*(word() for _ in range(n - 1)), "".join(rng.choice("qrstuv") for _ in range(12))] for n in (14, 14, 14, 16, 20, 25, 40, 60)]
    docs = []
    for w in items:
        for i in range(len(w)):
            docs.append([*(word() for _ in range(3)), *w[:i], word(), *w[i + 1 :], word()])
        docs += [w[len(w) // 2 :] + w[: len(w) // 2], w[: len(w) * 9 // 10], w[len(w) // 10 :], w[:9] + [word()] + w[9:] + w[:3]]

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def similarity(w, item):
        of, best = shingles(item), 0
        for s in range(-len(item), len(w)):
            x = shingles(w[max(s, 0) : s + len(item)]) if s + len(item) > 0 else Counter()
            best = max(best, (x & of).total() / (x | of).total())
        return best

    expected = {(d, i): round(s, 6) for d, w in enumerate(docs) for i, item in enumerate(items) if set(w) & set(item) and (s := similarity(w, item)) >= 0.8}
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{key} long, text string") for x, key in ((docs, "doc_id"), (items, "item_id"))]
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(*tables).collect()} == expected and len(expected) > 100


def test_url_rules(spark):
    urls = ["http://A.net/x", "http://a.net", "https://m.example.net/en/1", "http://x.example.com/de/3?q", "http://fr.org/fr/", "no url", None, "http://h.com#a", "http://h.com/p/1"]
    got = url_filter.filter_urls(spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, host string")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("a.net", "/x", "net/", "block"), ("a.net", "", None, "allow"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("x.example.com", "/de/3", "example.com/de/", "block"), ("fr.org", "/fr/", "org/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("h.com", "", None, "allow"), ("h.com", "/p/1", None, "allow"),
    ]


def test_url_templates_learn_from_labels(spark):
    pages = spark.createDataFrame([(i, f"http://h.com/{'spam' if i % 2 else 'good'}/{i}") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(f"http://h.com/{'spam' if i % 2 else 'good'}/{i}", bool(i % 2)) for i in range(100, 160)], "url string, bad boolean")
    got = url_filter.filter_urls(pages, rules=(), labels=labels, smooth=1.0).collect()
    assert {(r["page_id"] % 2, r["verdict"]) for r in got} == {(0, "allow"), (1, "block")}


def test_mixing_meets_targets(spark):
    d = spark.createDataFrame([(i, prose(RNG.randrange(0, 400)), f"s{i % 4}" if i % 9 else None) for i in range(300)] + [(500, None, "s1"), (7, "same", "s1"), (7, "same", "s1")], "doc_id long, text string, source string")
    a, b = (sorted(map(tuple, mixing.mix_sources(d).taken().collect())) for _ in range(2))
    assert a == b and len(a) == 303 and all(r[4] <= 2 * r[1] for r in a)
    sums = {}
    for _, _, size, target, taken in a:
        sums[size, target] = sums.get((size, target), 0) + taken
    assert all(abs(taken - target) <= 130 for (_, target), taken in sums.items())
    m = mixing.mix_sources(d)
    assert sum(len(r["text"].split()) for r in m.render().collect()) == sum(r[4] for r in a)
    assert mixing.mix_sources(d.where("false")).taken().count() == 0


def test_chat_folds_events(spark):
    log = [
        (1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "hel"), (1, 3, 1, "delta", None, "lo"), (1, 4, 2, "start", "assistant", None), (1, 5, 2, "delta", None, "bad"),
        (1, 6, 3, "start", "user", None), (1, 7, 3, "delta", None, "gone"), (1, 8, 2, "regenerate", None, None), (1, 9, 2, "delta", None, "good \\ </s>[INST] <<SYS>>"),
        (1, 10, 1, "edit", None, "hi"), (2, 1, 1, "start", None, None), (None, 1, 1, "delta", None, "x"),
    ]
    got = chat.render(chat.fold_events(spark.createDataFrame(log, chat.LOG)))
    got = got.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("learnt"))
    rows = {r["conv_id"]: r for r in got.collect()}
    assert [tuple(t) for t in rows[1]["turns"]] == [("user", "hi"), ("assistant", "good \\ </s>[INST] <<SYS>>")] and rows[1]["learnt"] == "good \\ </s>[INST] <<SYS>>"
    assert [tuple(t) for t in rows[2]["turns"]] == [("", "")] and [tuple(t) for t in rows[None]["turns"]] == [("", "x")]
    assert rows[1]["formatted"].count("</s>") == 2
    assert chat.fold_events(spark.createDataFrame([], chat.LOG)).count() == 0


def test_media_round_trip(spark, docs):
    big = "".join(RNG.choice("abcdefgh ") for _ in range(30_000))
    rows = [(100, big), (101, "prefix " + big), (102, big), (103, big[:20_000] + "é" + big[20_000:])]
    d = docs.select("doc_id", "text", F.lit("x").alias("feature")).unionByName(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, feature string"))
    got = {r["doc_id"]: r for r in media.media_columns(d).collect()}
    for i, t in [*enumerate(TEXTS), *rows]:
        payload = media.payload_of(t)
        assert (got[i]["n_bytes"], got[i]["payload_sha256"]) == (len((t or "").encode()), hashlib.sha256(payload).hexdigest())
        assert got[i]["media_sha256"] == hashlib.sha256(media.encode_wav(payload)).hexdigest() and got[i]["feature"].startswith("mean=")
    store = media.ChunkStore(spark.createDataFrame(rows, "doc_id long, text string"))
    assert store.store.agg(F.sum(F.aggregate(F.transform("bytes", F.length), F.lit(0), lambda a, x: a + x))).first()[0] < 2.6 * len(big)
    assert media.media_columns(d.where("false")).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = [b"</s>", MARK, b"a", b"b", b"ab", b"ba", MARK + b"a", b"aba"]
    scores = np.log(np.array([0.1, 0.1, 0.2, 0.1, 0.15, 0.1, 0.15, 0.1]))
    lattice, value = Lattice(pieces, scores), dict(zip(pieces, scores, strict=True))

    def brute(text):
        return 1.0 if not text else sum(math.exp(value[p]) * brute(text[len(p) :]) for p in pieces[1:] if text.startswith(p))

    words = [b"", b"a", b"abab", b"bababa", b"abaabab"]
    assert np.allclose(np.exp(lattice.log_probabilities(words)), [brute(MARK + w) for w in words])
    uses = lattice.expected([b"ab"], np.ones(1))
    total = brute(MARK + b"ab")
    assert math.isclose(uses[pieces.index(b"ab")], math.exp(value[MARK] + value[b"ab"]) / total)


def test_lm_base_score(spark):
    texts = [prose(30).title() for _ in range(60)] + [None, "", "Unseen wordlike " * 3]
    got = {r["doc_id"]: r for r in lm_score.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), frequent=20).collect()}
    train = [w for i, t in enumerate(texts) if not got[i]["held_out"] for w in [*split_words(t), None]]
    n, v = len(train), len(set(train))
    for i, t in enumerate(texts):
        tokens = [*split_words(t), None]
        assert math.isclose(got[i]["base_score"], sum(math.log10((train.count(w) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel_tol=1e-9)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(tokens), sum(w in train for w in tokens), n)
        assert got[i]["score"] < 0
    assert lm_score.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One<br>two
 three<br><p>Four &lt;x&gt;</p><div class="comments"><p>reader</p></div></article><aside>more</aside><form><p>mail</p></form><footer>(c)</footer>"""


def test_html_text(spark):
    rows = [(0, "http://a.com/1", PAGE, "x"), (1, None, None, "x"), (2, "http://a.com/2", "<p>just <i>text</i>", "x"), (3, "u", "", "x"), (0, "http://a.com/1", PAGE, "x")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()]
    main = "A & B\nOne two three\nFour <x>"
    assert sorted(got) == [(0, main, len(main)), (0, main, len(main)), (1, "", 0), (2, "just text", 9), (3, "", 0)]


def test_style_tree_finds_what_repeats(spark):
    page = "<body><div class='top'><p>Welcome to our site</p></div><div class='story'><p>{}</p></div></body>"
    rows = [(i, f"http://h.com/{i}", page.format(prose(12))) for i in range(40)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Welcome" not in r["text"] and r["n_chars"] > 20 for r in got)


def test_near_dedup_against_brute_force(spark):
    base = [prose(60) for _ in range(4)]
    texts = [None, "", "a b", "a b", "A  b"] + base
    for b in base * 12:
        w = b.split()
        for _ in range(RNG.randrange(4)):
            w[RNG.randrange(len(w))] = RNG.choice(WORDS)
        texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=3, percent=85).collect()}

    def shingles(t):
        w = split_words(t)
        return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    sets, label = [shingles(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(texts)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert [got[i]["component_id"] for i in range(len(texts))] == label and [got[i]["n_shingles"] for i in range(len(texts))] == list(map(len, sets))
    assert near_dedup.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_of_crowded_regions(spark):
    """Hundreds of documents that share a passage, each with one copy just similar enough: all are linked, as by brute force."""
    rng = random.Random(5)
    own = lambda n: [f"{rng.randrange(10**9)}" for _ in range(n)]
    passage, texts = own(80), []
    for _ in range(150):
        a = passage + own(20)
        texts += [a, a[:86] + own(14)]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in texts]
    alike = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert alike == [(2 * i, 2 * i + 1) for i in range(150)]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = near_dedup.near_dedup(rows, shingle=3, percent=75).collect()
    assert {r["doc_id"] for r in found if r["component_id"] != r["doc_id"] - r["doc_id"] % 2} == set()


def test_line_dedup_stage_keeps_rows(spark):
    import corpus_pipeline

    copy = "First line\nsecond line"
    texts = [copy] * 12 + [f"Footer\nown {i}" for i in range(12)] + ["Footer", "footer ", None, ""]
    rows = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, rows, "").collect()}
    assert [got.pop(i) for i in range(len(texts))] == [copy] * 12 + [f"own {i}" for i in range(12)] + ["Footer", "footer ", None, ""] and not got


@pytest.mark.parametrize(
    "html, main",
    [
        ("<article><p>One</p><svg width='1'/><p>Two</p><p>Three</p></article>", "One\nTwo\nThree"),
        ("<article><p>One</p><object><p>Two</p></article>", "One\nTwo"),
        ('<div class="social-history"><p>Past</p></div>', "Past"),
        ('<section class="notice-board-review"><p>Board</p></section>', "Board"),
        ('<main><p>A</p><div role="navigation">B</div></main><p>C</p>', "A"),
        ("<article><p>Own</p><article><p>reader</p></article><ol class='comments'><li>x</ol></article>", "Own"),
        ("<p>a<svg><text>no</text></svg>b<script>never ends <p>x", "ab"),
        ("<table><tr><td>1<td>2</table>&nbsp;<p>&lt;b&gt; &#233;", "1\n2\n<b> é"),
    ],
)
def test_html_cases(html, main):
    assert html_text.main_text(html) == main


def test_style_tree_against_brute_force(spark):
    rng = random.Random(4)
    page = lambda i: f"<body><div class='top'>Welcome</div><div class='ad'>{rng.choice('abcdefgh')}</div><p>{prose(9)} {i}</p>{'<div>once</div>' if i == 3 else ''}</body>"
    rows = [("h", page(i)) for i in range(30)] + [("lone", page(99))]
    tree = {(r["host"], r["node"]): (r["pages"], r["importance"]) for r in html_text.style_tree(spark.createDataFrame(rows, "host string, html string")).collect()}
    expected, of, where = {}, {}, {}
    for host, html in rows:
        for text, open_ in html_text.blocks_of(html)[0]:
            if open_[-1].tag not in ("", "body"):
                key = open_[-1].path - (1 << 63)
                of.setdefault((host, key), []).append(text)
    entropy = lambda texts: -sum(c / len(texts) * math.log(c / len(texts)) for c in Counter(texts).values()) / math.log(len(texts))
    for (host, key), texts in of.items():
        where[key] = 0.9 * entropy(of["h", key]) if len(of.get(("h", key), ())) > 1 else None
    for (host, key), texts in of.items():
        w, prior = len(texts) - 1, 1.0 if where[key] is None else where[key]
        expected[host, key] = len(texts), (w * (where[key] or 0) + 4 * prior) / (w + 4)
    assert tree.keys() == expected.keys() and all(tree[k][0] == n and math.isclose(tree[k][1], x, abs_tol=1e-9) for k, (n, x) in expected.items())
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_hosts_lean_on_all_hosts(spark):
    """A host of one page has no statistics of its own; kinds that stand outside articles elsewhere go too."""
    page = "<body><div class='top'><p>Welcome to our site</p></div><div class='story'><p>{}</p></div></body>"
    framed = "<body><div class='promo'>{}</div><article><p>{}</p></article></body>"
    rows = [(i, f"http://h.com/{i}", page.format(prose(12))) for i in range(40)] + [(100, "http://one.com/", page.format("The story"))]
    rows += [(200 + i, f"http://f.com/{i}", framed.format(prose(5), prose(9))) for i in range(9)] + [(300, "http://two.com/", "<body><div class='promo'>Buy this</div><div><p>Told here</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[100] == "The story" and got[300] == "Told here" and not any("Welcome" in t for t in got.values())


def test_label_model_finds_accuracies_and_copies():
    """Votes of known accuracies, one voter being a copy of another; few labels, and none read from the others."""
    rng = np.random.default_rng(1)
    n, width = 6000, len(toxicity.VOTERS)
    y = rng.random(n) < 0.2
    fire = np.where(y[:, None], np.linspace(0.5, 0.9, width), np.linspace(0.02, 0.15, width))
    votes = (rng.random((n, width)) < fire).astype(float)
    votes[:, 1] = votes[:, 0]
    gold = np.where(rng.random(n) < 0.1, y, -1).astype(float)
    model = toxicity.LabelModel(votes, gold, np.ones(n))
    assert abs(model.prior - 0.2) < 0.03 and np.abs(model.fire[1] - np.linspace(0.5, 0.9, width))[2:].max() < 0.06
    assert model.weight[0] < 0.6 < model.weight[2:].mean() and ((model.posterior(votes) > 0.5) == y).mean() > 0.98


def test_toxicity_reads_no_held_out_label(spark):
    rows = [(i, f"{prose(12)} {'badword' if i % 4 == 0 else ''} x{i}", "clash", 5.0) for i in range(240)] + [(5, "twice", "", 1.0), (5, "twice", "", 1.0), (None, "none", "", 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double")
    labels = [(i, int(i % 4 == 0)) for i in range(240)]
    given = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels] + [(None, 1), (3, 0), (3, 0)], "doc_id long, toxic int")
    a, b = ({(r["doc_id"], r["held_out"]): r["score"] for r in toxicity.score_toxicity(d, given(flip)).collect()} for flip in (False, True))
    assert a == b and len(a) == 241 and a[0, a and zlib.crc32(b"0") % 3 == 1] > 0.5


def test_words_of_copies_share_a_weight(spark):
    """A text that was copied and labelled toxic 30 times does not make its words toxic; a word of 30 different texts does."""
    copied = " ".join(f"c{i}" for i in range(40))
    own = [" ".join(RNG.choice(WORDS) + str(RNG.randrange(400)) for _ in range(15)) for _ in range(330)]
    rows = [(i, copied) for i in range(30)] + [(100 + i, own[i] + " vilest") for i in range(30)] + [(200 + i, own[30 + i]) for i in range(300)] + [(900, copied), (901, "so vilest")]
    labels = [(i, 1) for i in [*range(30), *range(100, 130)]] + [(200 + i, 0) for i in range(300)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert got[901] > 0.5 > got[900]


def test_url_templates_against_sql(spark):
    """Deep and odd paths, ties, repeated rows: the same as the SQL, by the same rules."""
    import duckdb

    rng = random.Random(6)
    urls = [f"http{'s' * rng.randrange(2)}://{rng.choice(['a.example.net', 'b.example.com', 'c.org', 'D.example.org', 'spam.info'])}/{rng.choice(['en', 'de', 'fr', 'x/y'])}/" + "/".join(rng.choice(["news", "tag", f"slug-{rng.randrange(90)}", "0a1b2c3d4e5f6a"]) for _ in range(rng.randrange(6))) for _ in range(400)]
    rows = [*enumerate([*urls, *urls[:5], None, "", "no scheme", "http://h.net/" + "a/" * 300, "://", "http://x.org//fr//1?q=/z"])]
    d = spark.createDataFrame(rows, "page_id long, url string")
    con = duckdb.connect()
    con.register("pages", d.toPandas())
    got = sorted(map(tuple, url_filter.filter_urls(d).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == sorted(con.execute(url_filter.SQL).fetchall()) and len({v for *_, rule, v in got if rule is None}) == 2
    assert url_filter.filter_urls(d.where("false")).count() == 0


def test_mixing_of_small_sources(spark):
    sizes = [0, 1, 15, 65, 130, 700, 9000]
    d = spark.createDataFrame([(i, prose(n), f"s{i}", "x", 1) for i, n in enumerate(sizes)], "doc_id long, text string, source string, taken string, size int")
    got = {r["doc_id"]: r for r in mixing.mix_sources(d).taken().collect()}
    assert [got[i]["size"] for i in range(7)] == sizes and all(r["taken"] <= 2 * r["size"] for r in got.values())
    assert all(abs(got[i]["taken"] - got[i]["target"]) <= 64 for i in range(7)) and [got[i]["taken"] for i in range(5)] == [0, 2, 30, 130, 260]
    m = mixing.mix_sources(d, shard_words=500)
    filled = m.slots.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("blocks_drawn"))
    assert filled.exceptAll(m.counts.select("shard", "rank", "blocks_drawn")).count() == 0 and m.slots.select("shard").distinct().count() > 10


def test_chat_takes_odd_turns(spark):
    rows = [(1, None, "user", "N", 0), (1, -1, "user", "M", 0), (1, 1_700_000_000, "assistant", "late", 0), (1, 1_700_000_000, "assistant", "late", 0), (1, 2, None, None, 0)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = chat.fold_events(chat.turn_events(table)).orderBy("message").collect()
    assert [(r["role"], r["text"]) for r in got] == [("user", "M"), ("", ""), ("assistant", "late"), ("assistant", "late"), ("user", "N")]
    tie = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "old "), (1, 3, 1, "delta", None, "also old"), (1, 3, 1, "edit", None, "new"), (1, 4, 1, "delta", None, "!"), (1, 4, 1, "delta", None, "!")]
    assert [r["text"] for r in chat.fold_events(spark.createDataFrame(tie, chat.LOG)).collect()] == ["new!!"]


def test_similarity_counts_repeats(spark):
    rows = [([1, 2, 3], [2, 3, 4], 0.5), ([1, 1, 2], [1, 1, 1], 0.5), ([1, 1], [1, 2], 1 / 3)]
    got = spark.createDataFrame(rows, "a array<long>, b array<long>, s double").select(decontaminate.weighted_similarity(F.col("a"), F.col("b")).alias("x"), "s").collect()
    assert all(math.isclose(r["x"], r["s"]) for r in got)


def test_lm_score_against_brute_force(spark, tmp_path):
    """Scores are the words' lattice probabilities under the fitted pieces, frequent words and others alike."""
    texts = ["ab ba", "ab ab c", "", None, "ab ab c", "q" * 300]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    a, b = ({r["doc_id"]: r["score"] for r in lm_score.score_documents(d, rounds=0, frequent=n).collect()} for n in (1000, 1))
    pieces = lm_score.load_vocabulary(lm_score.VOCABULARY)
    value = dict(zip(pieces, lm_score.first_scores(len(pieces)), strict=True))

    def word(w):
        p = [1.0] + [0.0] * len(w)
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if w[i:j] in value:
                    p[j] += p[i] * math.exp(value[w[i:j]])
        return math.log10(p[-1])

    for i, t in enumerate(texts[:5]):
        assert math.isclose(a[i], value[lm_score.END] / math.log(10) + sum(word(MARK + w) for w in split_words(t)), rel_tol=1e-9)
    assert all(math.isclose(a[i], b[i], rel_tol=1e-9) for i in range(6))
    with pytest.raises(FileNotFoundError):
        lm_score.load_vocabulary("/nowhere")


def test_crowds_are_settled_exactly(spark):
    """A group whose centre is similar enough to few: chains, second clusters and single documents all get what brute force gives."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(260):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 4, 7, 8, 9])):
            w[at] = f"own{rng.randrange(10**9)}"
        texts.append(" ".join(w))
    texts += texts[:3] + [None, ""]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(split_words, texts)]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    expected = [root(i) for i in range(len(texts))]
    assert 20 < len(set(expected)) < 255
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(0, texts[0], 0), (None, texts[1], 0)]
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string, kept int"), shingle=3, percent=85).collect()
    assert len(got) == len(rows) and all(r["component_id"] == (None if r["doc_id"] is None else expected[r["doc_id"]]) for r in got)


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Each stage does its part: toxic documents, common lines, copies and leaks go, all else stays, and the mix meets its targets."""
    import corpus_pipeline

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 9)))
    own = lambda n: [word() for _ in range(n)]
    docs = {i: " ".join(own(40)) for i in range(150)}
    toxic = {i: " ".join([*own(15), "vilest", *own(15), "nastiest"]) for i in range(1000, 1060)}
    footer = {i: " ".join(own(40)) + "\nThe same FOOTER\n" for i in range(2000, 2012)}
    base = own(120)
    copies = {3000: " ".join(base), 3001: " ".join(base), 3002: " ".join([*base[:119], "changed"]), 3003: " ".join(base[:60] + own(60))}
    items = {i: own(30) for i in range(3)}
    leaks = {4000 + i: " ".join([*own(20), *w, *own(20)]) for i, w in items.items()}
    odd = {5000: None, 5001: "", 5002: " \n", 5003: "two words"}
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash") for d in (docs, toxic, footer, copies, leaks, odd) for i, t in d.items()] + [(None, "no id here", "en", None, 10, "clash")]
    tables = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string"),
        "labels": spark.createDataFrame([(i, 0, int(i in toxic)) for i in [*docs, *toxic]], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"),
    }
    for name, t in tables.items():
        t.write.parquet(f"file://{tmp_path}/{name}.parquet")
    got, kept = tables["documents"], {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, got, f"file://{tmp_path}")
        assert out.columns == got.columns
        got = spark.createDataFrame(out.collect(), got.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in got.collect()}
    everything = {r[0] for r in rows}
    assert kept["toxicity"].keys() == everything - set(toxic)
    assert kept["line_dedup"].keys() == kept["toxicity"].keys() and all(kept["line_dedup"][i] == t.split("\n")[0] + "\n" for i, t in footer.items())
    assert everything - set(toxic) - kept["minhash_near_dedup"].keys() == {3001, 3002}
    assert kept["minhash_near_dedup"].keys() - kept["decontamination"].keys() == set(leaks)
    mix = corpus_pipeline.STAGES[-1][1](spark, got, f"file://{tmp_path}").collect()
    assert {r["doc_id"]: r["size"] for r in mix} == {i: len(split_words(t)) for i, t in kept["decontamination"].items()}
    by = {}
    for r in mix:
        by[r["source_size"], r["target"]] = by.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert all(abs(taken - target) <= 64 for (_, target), taken in by.items())
