"""Operators on single rows: extraction, encoding, quality, toxicity, search."""

import random
import string
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulegrain.llm import bpe, exact_topk, html_extract, quality_rules, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string"

# --- extraction ---------------------------------------------------------------------------------------
PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1><p>One &amp; two</p>"
     "<p>three<b>four</b>\n\n five</p></article><footer>&copy; me</footer></body></html>", "Head One & two threefour five"),
    ("<body><header><a href='/'>Site</a></header><div id=wrap><div class='sidebar'>x y z</div><div class=content><h1>Title</h1>"
     "<p>Some long text with enough words to count as content.<div class='ad'>Buy</div><p>Second <b>bold</b>text goes on for a "
     "while.<ul><li>one<li>two</ul></div></div><section id=comments><p>I liked it so much that I wrote this long comment</p>"
     "</section><footer>c</footer>", "Title Some long text with enough words to count as content. Second boldtext goes on for a while. one two"),
    ("<article><header><h1>Kept</h1></header><p>Body text<br>next line</p><aside>no</aside><form>no<input></form>"
     "<script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --></article>", "Kept Body text next line"),
    ("<p>a</p>b", "a b"), ("only text", "only text"), ("", ""), (None, ""), ("<div></div>", ""), ("<p>&#x41;&nbsp;B &lt;i&gt;", "A B <i>"),
    ("<body><div class=cookie-notice><p>We use cookies and like to tell you so at length</p></div><main><p>Main words.</p></main>",
     "Main words."),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" + "long word " * 40_000, ("long word " * 40_000).strip()),
]


def test_main_text(spark):
    rows = [(i, f"u{i}", html, "x") for i, (html, _) in enumerate(PAGES)] + [(None, None, "<p>z", "y"), (0, "u0", PAGES[0][0], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, page_text string")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "page_text", "text", "n_chars"]
    got = out.collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id) == [
        (i, text, len(text)) for i, (_, text) in enumerate(PAGES) if i]
    assert [r.text for r in got if r.page_id is None] == ["z"] and sum(r.page_id == 0 for r in got) == 2
    assert html_extract.extract(df.limit(0)).collect() == []


def test_density_falls_with_links():
    links = "<body><div><p>" + "<a href=x>a link of words</a> " * 30 + "</p></div><div><p>" + "plain words here " * 30 + "</p></div>"
    assert html_extract.main_text(links) == ("plain words here " * 30).strip()


WRAPPERS = ["<div class='has-sidebar'>%s</div>", "<div id='page' class='no-sidebar'>%s</div>", "<div class='long-form'>%s</div>",
            "<div class='elementor-widget'>%s</div>", "<form id='aspnetForm'>%s</form>", "<div class='comments-open'>%s</div>",
            "<form id='aspnetForm'><div class='elementor-widget'>%s</div></form>"]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_a_wrapper_named_like_a_part_stays(wrapper):
    words = ["Plain words that a reader came for. " * 12, "More words of the same page. " * 10]
    content = "<h1>Title</h1>" + "".join(f"<p>{w}</p>" for w in words)
    menu = "<ul class='menu'><li><a href=x>Home</a><li><a href=y>About</a></ul>"
    parts = "<div class='sidebar'>Short remarks beside it</div><section id=comments><p>I liked it</p></section><footer>me</footer>"
    want = " ".join(["Title", *(w.strip() for w in words)])
    assert html_extract.main_text(f"<body>{wrapper % content}</body>") == want
    assert html_extract.main_text(f"<body>{wrapper % (menu + content + parts)}</body>") == want


@pytest.mark.parametrize("page", ["<main><div class='with-sidebar'><p>{t}</p></div></main>", "<main><div class='form-content'>{t}</div></main>",
                                  "<main><form><p>{t}</p></form></main>", "<article><h1>t</h1><div class='post-share-content'><p>{t}</p></div></article>"])
def test_a_wrapper_inside_declared_content_stays(page):
    text = "The text of the article goes on and on. " * 65
    assert html_extract.main_text(f"<body>{page.format(t=text)}</body>").endswith(text.strip())
    beside = f"<body><main><div class='sidebar'>{text}</div><article><p>Short but true.</p></article></main></body>"
    assert html_extract.main_text(beside) == "Short but true."


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "text of it" + "</div>" * 100_000, "<span>x" * 100_000, "<i><b>x</u>" * 50_000])
def test_deep_and_malformed_pages_take_linear_time(page):
    began = time.perf_counter()
    html_extract.main_text(page)
    assert time.perf_counter() - began < 20  # about three seconds; hours when it is quadratic


def plainly(tree):
    """The choice of `_best_below` by walking the subtree of every element."""
    order = html_extract._order(tree)
    best = tree
    for node in order:
        if not any(p.part for p in _path(node, tree)) and node.total > best.total:
            best = node
    while True:
        inner = max((c for c in best.children if not isinstance(c, str) and not c.part), key=lambda c: c.total, default=None)
        if inner is None or not inner.total or inner.total < html_extract.INNER_SHARE * best.total:
            return best
        best = inner


def _path(node, top):
    out = []
    while node is not top:
        out.append(node)
        node = node.parent
    return out


def test_best_subtree_against_a_walk():
    rng = random.Random(6)
    bits = ["<div>", "</div>", "<p>", "</p>", "<span>", "</span>", "text one two. ", "<a href=x>link</a>", "<ul><li>", "</ul>", "word " * 20]
    for _ in range(200):
        parser = html_extract._Tree()
        parser.feed("".join(rng.choice(bits) for _ in range(60)))
        order = html_extract._order(parser.root)
        html_extract._measure(order)
        for node in order:
            assert html_extract._best_below(node) is plainly(node)


def test_parts_beside_declared_content_go():
    talk = "<section id=comments>" + "<p>A long comment by somebody who was here. </p>" * 20 + "</section>"
    assert html_extract.main_text(f"<body><article><p>Body words.</p></article>{talk}</body>") == "Body words."


# --- encoding -------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def own():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


TEXTS = ["Hello world, it's 2024!", "", None, "a  b", "a   b", " a", "  a", "a ", "a  ", "a\n b", "a \n b", "a  \nb", "\n", "<|endoftext|> I'LL",
         "日本語 テスト 🙂🙂 é", "a\x1c b \x1f", "ab" * 150, "aaaa" * 40, " x  y　z", "word " * 30_000, "\x00\x01"]


def test_ids_as_the_library_gives_them(spark, own):
    path, pattern, library = own
    rng = random.Random(0)
    signs = string.ascii_letters + string.digits + "  \n\t.,!'éß中 \U0001f642"
    texts = TEXTS + ["".join(rng.choice(signs) for _ in range(rng.randrange(200))) for _ in range(150)] + [TEXTS[0]]
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(None, "x", "n")], DOCS + ", ids string").repartition(3)
    out = bpe.encode(df, path, pattern, keep=["doc_id"])
    got = {r.doc_id: r for r in out.collect()}
    for i, t in [*enumerate(texts), (None, "x")]:
        want = library.encode_ordinary(t or "")
        assert got[i].ids == want and got[i].n_tokens == len(want), t
        assert got[i].ids_sha256 == brute.sha(" ".join(map(str, want))) and got[i].decoded_sha256 == brute.sha(t or "")
    assert bpe.encode(df.limit(0), path, pattern, keep=["doc_id"]).count() == 0


def test_memory_of_pieces_is_bounded_and_changes_nothing(own, monkeypatch):
    path, pattern, library = own
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 40)
    monkeypatch.setattr(bpe, "KNOWN_SEGMENTS", 30)
    work = bpe._Texts(path, pattern)
    for k in range(5):
        texts = [f"some words number {k}{i} and unusual{i * k} ones" for i in range(20)]
        assert [ids for ids, _ in work.encode(texts)] == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]


def test_words_met_often_are_merged_once(own, monkeypatch):
    path, pattern, library = own
    monkeypatch.setattr(bpe, "KNOWN_PIECES", 200)
    monkeypatch.setattr(bpe, "KNOWN_SEGMENTS", 200)
    bpe.tables.cache_clear()
    work, merged = bpe._Texts(path, pattern), []
    monkeypatch.setattr(work.own, "merge", lambda pieces, merge=work.own.merge: merged.extend(pieces) or merge(pieces))
    often = [f" often{c}{d}" for c in "abcde" for d in "vwxyz"]
    for k in range(20):
        texts = ["".join(often) + "".join(f" rare{chr(97 + k)}{chr(97 + i)}" for i in range(20))]
        assert [ids for ids, _ in work.encode(texts)] == [" ".join(map(str, library.encode_ordinary(t))) for t in texts]
    assert all(merged.count(w.encode()) == 1 for w in often)
    bpe.tables.cache_clear()


def test_one_query_holds_many_long_pieces(own):
    path, _, library = own
    rng = random.Random(5)
    pieces = ["".join(rng.choice(string.ascii_lowercase) for _ in range(n)) for n in [*range(1, 60), *range(700, 1000)]]
    got = bpe.tables(path).merge([p.encode() for p in pieces])
    assert [np.frombuffer(ids, np.int32).tolist() for ids in got] == [library.encode_ordinary(p) for p in pieces]


def test_long_runs_take_little_memory(own):
    path, pattern, library = own
    rng = random.Random(4)
    letters = "".join(rng.choice(string.ascii_lowercase) for _ in range(100_000))
    runs = [letters, letters[:20_000], "a" * 100_000, "-" * 20_000, "-" * 100_000, "=-" * 10_000, "日本語テスト" * 3000,
            letters[:1000], letters[:1001], *[letters[k:k + 900] for k in range(0, 45_000, 900)]]
    want = [library.encode_ordinary(t) for t in runs]
    got = list(bpe._Texts(path, pattern).encode(runs))
    assert [ids for ids, _ in got] == [" ".join(map(str, w)) for w in want]
    assert [text.decode() for _, text in got] == runs


# --- search ---------------------------------------------------------------------------------------------
def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 7)
    monkeypatch.setattr(exact_topk, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 240)]  # ties
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4), (304, [1.0, 2.0]),
             (305, []), (320, []), (None, rows[0][1]), (340, [1e15, -1e15, 3e15, 1.0]), (341, [1e18] * 4)]
    df = spark.createDataFrame([(*r, "label") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    vectors = exact_topk.quantized(df, "vec_id", "embedding")
    usable = [(r.vec_id, r.cells) for r in vectors.collect()]
    assert {i for i, _ in usable} == {i for i, _ in rows if i not in (None, 300, 301, 302, 303)}
    queries = [(i, c) for i, c in usable if i % 20 == 0]
    got = sorted(tuple(r) for r in exact_topk.search(vectors, vectors.filter("vec_id % 20 = 0"), 9).collect())
    assert got == sorted(brute.top(usable, queries, 9))


def test_top_k_of_repeated_and_missing_rows(spark):
    rows = [(20, [1.0]), (20, [1.0]), (3, [2.0]), (3, [2.0])]
    vectors = exact_topk.quantized(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v")
    got = sorted(tuple(r) for r in exact_topk.search(vectors, vectors.filter("vec_id % 20 = 0"), 5).collect())
    assert got == [(20, 1, 3, 8192), (20, 2, 3, 8192)]
    none = vectors.limit(0)
    assert exact_topk.search(none, none, 5).collect() == [] and exact_topk.search(vectors, none, 5).collect() == []


# --- quality --------------------------------------------------------------------------------------------
def plain_counts(text):
    raw = text or ""
    w = raw.encode().split()
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(three) if three.count(t) > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in raw.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in raw), dup, len(covered)


def test_counts_against_plain_ones(spark):
    texts = [None, "", " \n ", "one", "a b c a b c", "a a a a a", "x | y # z\nx | y # z\n\nx | y # z", "Ünï çödé 日本 <&>" * 3,
             "l1 of it\nl1 of it \nl1 of it", "same " * 3000, "w" * 30_000, "a b c a b c"]
    rng = random.Random(3)
    texts += [" ".join(rng.choice(["a", "b", "c\n", "é"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], DOCS + ", c0 int")
    out = quality_rules.statistics(df)
    assert out.columns == ["doc_id", "text", "c0", "stats"]
    for r in out.collect():
        s = r.stats
        assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words) == plain_counts(texts[r.doc_id]), texts[r.doc_id]
    base = {r.doc_id: r.f for r in out.select("doc_id", quality_rules.base_failed(F.col("stats")).alias("f")).collect()}
    for i, t in enumerate(texts):
        n = plain_counts(t)
        assert base[i] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    assert quality_rules.statistics(df.limit(0)).collect() == []


def test_rules_cover_what_was_planted():
    rng = np.random.default_rng(0)
    table = {"symbols": rng.random(3000), "upper": rng.random(3000), "words": rng.integers(50, 900, 3000).astype(float)}
    bad = ((table["symbols"] > 0.9) & (table["words"] > 300)) | (table["upper"] > 0.95)
    rules = quality_rules.fit(table, bad, np.arange(3000) % 3 == 0)
    found = np.zeros(3000, bool)
    for rule in rules:
        found |= quality_rules._holds(rule, table)
    assert (found == bad).mean() > 0.99 and (found & ~bad).mean() < 0.003
    noise = rng.random(3000) < 0.1
    for rule in quality_rules.fit(table, noise, np.arange(3000) % 3 == 0):
        assert quality_rules._holds(rule, table).mean() < 0.02


def test_held_out_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    own = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))
    stats = quality_rules.statistics(docs.select("doc_id", "text")).drop("text")
    rules = quality_rules.learn(stats, labels.filter(own == 0))
    s = F.col("stats")
    seen = stats.join(labels.filter(own == 1), "doc_id").filter(~quality_rules.base_failed(s)).groupBy(
        "quality", quality_rules.verdict(s, rules).alias("kept")).count().collect()
    n = {(r.quality, r.kept): r["count"] for r in seen}
    assert n.get((1, False), 0) <= 0.01 * (n.get((1, False), 0) + n[1, True])
    assert n[0, False] >= 0.85 * (n[0, False] + n.get((0, True), 0))


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "word " * 60), (2, "other words " * 3), (None, None)], DOCS)
    stats = quality_rules.statistics(docs).drop("text")
    for labels in ([], [(1, 1)], [(1, None), (None, 0), (1, 7)]):
        assert quality_rules.learn(stats, spark.createDataFrame(labels, "doc_id long, quality int")) == []


# --- toxicity -------------------------------------------------------------------------------------------
def test_chain_on_planted_words(spark):
    rng = random.Random(5)
    clean = [f"c{i:03d}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(clean) for _ in range(rng.choice([20, 80]))]
        if i % 4 == 0:
            for _ in range(rng.choice([1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(["Vileness,", "rotten", "vilenesses"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, DOCS)
    chain = toxicity.learn(docs, spark.createDataFrame(labels[:400], "doc_id long, toxic int"))
    assert len(chain.links) == len(toxicity.CATEGORIES)
    # later links take the earlier probabilities
    assert [len(w) for w in chain.links] == [2 + len(chain.features) + k for k in range(3)]
    odd = docs.union(spark.createDataFrame([(None, None), (9000, ""), (9001, "rotten " + "c001 " * 40_000), (0, rows[0][1])], DOCS))
    got = toxicity.score(odd, chain).collect()
    assert len(got) == 604
    flags = {r.doc_id: r.toxic for r in got}
    held_out = [i for i in range(400, 600)]
    assert sum(flags[i] == (i % 4 == 0) for i in held_out) >= 198
    assert not flags[None] and not flags[9000] and flags[9001]


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], DOCS)
    for labels in ([], [(1, 0)], [(1, 1)], [(1, None), (None, 1), (1, 5)]):
        chain = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert chain is None and [r.toxic for r in toxicity.score(docs, chain).collect()] == [False]


def test_held_out_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    own = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2))
    chain = toxicity.learn(docs, labels.filter(own == 0))
    seen = toxicity.score(docs, chain).withColumnRenamed("toxic", "said").join(labels.filter(own == 1), "doc_id").groupBy("said", "toxic").count()
    n = {(r.said, r.toxic): r["count"] for r in seen.collect()}
    assert n.get((True, 0), 0) <= 0.02 * (n.get((True, 0), 0) + n[False, 0])
    assert n[True, 1] >= 0.85 * (n[True, 1] + n.get((False, 1), 0))
