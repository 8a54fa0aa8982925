"""Operators 6 and 7, and the pipeline."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerframe.llm import decontaminate, html_extract, quality, sharding
from ledgerframe.llm.textbatch import grams, span_hash

from . import brute
from .conftest import SF


@pytest.fixture(scope="session")
def bench(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_every_verbatim_item_is_found(docs, bench):
    items = {r.item_id: r.text for r in bench.collect()}
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items.items() if t in (d.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert want and got == want


def test_wand_returns_all_above_threshold():
    rng = random.Random(5)
    vocab = ["t%d" % i for i in range(120)]
    items = [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(120)], k=rng.randint(3, 60)))) for i in range(150)]
    df = {}
    for _, t in items:
        for h in set(decontaminate.token_hashes(t).view("int64").tolist()):
            df[h] = df.get(h, 0) + 1
    index = decontaminate.Index(items, df, len(items), 30.0)
    for _ in range(80):
        query = rng.choices(vocab, k=rng.randint(1, 90))
        t = index.term_of(decontaminate.token_hashes(" ".join(query)))
        terms = sorted(set(t[t >= 0].tolist()))
        score = {}
        for x in terms:
            for p in range(index.start[x], index.start[x + 1]):
                score[int(index.item[p])] = score.get(int(index.item[p]), 0) + float(index.impact[p])
        assert sorted(index.wand(terms)) == sorted(i for i, s in score.items() if s >= 1 - 1e-9)


def _leaks_by_hand(docs, items, passage=128, share=0.5, overlap=0.5, whole=0.6):
    """Operator 6 by scoring every passage against every item: {(doc_id, item_id)}."""
    k1, b, half, sure = 1.2, 0.75, passage // 2, passage // 2 + 1

    def cut(text):
        return re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").translate(brute.ASCII_LOWER))

    def grams(words, n):
        return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
    tokens = {i: cut(t) for i, t in items}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for words in tokens.values() for t in set(words))
    impact, least, parts = {}, {}, {}
    for i, text in items:
        words, tf = tokens[i], Counter(tokens[i])
        impact[i] = {t: math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(words) / mean))
                     for t, c in tf.items()}
        least[i] = min((sum(impact[i][t] for t in set(words[s:s + sure])) for s in range(max(1, len(words) - sure + 1))), default=0)
        said = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if cut(p)]
        said = [" ".join(said[:-1]), said[-1]] if len(said) > 1 else [text, text]
        parts[i] = [cut(p) for p in (*said, text)]
    found = set()
    for d, text in docs:
        words = cut(text)
        near = {}
        for h in range(-(-len(words) // half)):
            stop = h + 1 if h + 1 < -(-len(words) // half) else h
            terms = set(words[h * half:(stop + 1) * half])
            for i in impact:
                if least[i] and sum(v for t, v in impact[i].items() if t in terms) >= share * least[i] * (1 - 1e-9):
                    near.setdefault(i, []).append(h * half)
        for i, at in near.items():
            size = len(tokens[i])
            around = words[max(0, at[0] - size):at[-1] + passage + size]
            got = []
            for part in parts[i]:
                want = grams(part, min(5, len(part)))
                have = grams(around, min(5, size)) | (set().union(*(grams(around, k) for k in range(1, 6))) if len(want) == 1 else set())
                got.append(len(want & have) / len(want) if want else 0.0)
            if got[0] >= overlap and got[1] >= overlap or got[2] >= whole:
                found.add((d, i))
    return found


def test_leaks_against_every_passage_and_item(docs, bench):
    """End to end, with items cut short, reordered and changed."""
    items = [(r.item_id, r.text) for r in bench.collect()]
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (_, text) in enumerate(items):
        words = text.split()
        some = [w if rng.random() > k / len(items) / 4 else "other" for w in words]
        rows.append((10_000 + k, " ".join(["lead"] * rng.randint(0, 200) + some[:rng.randint(len(some) // 3, len(some))])))
    df = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    want = _leaks_by_hand(rows, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == want and 0 < sum(d >= 10_000 for d, _ in want) < len(items)


def test_index_of_many_short_items_is_small():
    rng = random.Random(6)
    vocab = ["t%d" % i for i in range(30_000)]
    items = [(i, " ".join(rng.choices(vocab, k=14))) for i in range(20_000)]
    df = Counter(h for _, t in items for h in set(decontaminate.token_hashes(t).view("int64").tolist()))
    index = decontaminate.Index(items, df, len(items), 14.0)
    assert sum(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes")) < 30_000_000


def test_leaks_inside_long_texts_and_odd_rows(spark, odd, bench):
    item = bench.orderBy("item_id").first()
    long = " ".join("filler%d" % (i % 991) for i in range(30_000))
    rows = [(1, long + " " + item.text + " " + long), (2, item.text.upper()), (3, None), (4, ""), (None, item.text),
            (5, item.text[:40]), (6, item.text), (6, item.text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id for r in decontaminate.find_leaks(df, bench).collect() if r.item_id == item.item_id), key=str)
    assert got == [1, 2, 6, 6, None]
    assert decontaminate.find_leaks(odd, bench).count() == 0
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_leaks_with_several_index_blocks(docs, bench, monkeypatch):
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect())
    build = decontaminate.build_indexes
    monkeypatch.setattr(decontaminate, "build_indexes", lambda b: build(b, 2_000))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()) == want


def test_no_items_no_documents(spark, docs, nothing, bench):
    none = spark.createDataFrame([], "item_id long, text string")
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "?! ..")], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0
    assert decontaminate.find_leaks(docs, odd_items).count() == 0
    assert decontaminate.find_leaks(nothing, bench).count() == 0


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(pages).collect()}
    for p in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(x for x in parts if x)
        assert got[p.page_id] == (want, len(want))


MARKUP = [
    ("<html><head><title>T</title></head><body><header>Top</header><nav>Menu</nav><article><header><h1>Head</h1></header>"
     "<p>One &amp; <b>two</b><br>three<p>four</p><div class='ad'>Buy</div><form>Mail <input></form></article>"
     "<aside>Side</aside><section id=comments><article class=comment><p>nice</p></article></section><footer>F</footer>",
     "Head\nOne & two three\nfour"),
    ("<main><div class=\"cookie-notice\">We use</div><table><tr><td>a</td><td> b&nbsp;c </td></tr></table></main>tail", "a\nb c"),
    ("<nav><ul><li>x<article><p>in</p></article>", "in"),
    ("<p>if a < b then<script>var s='</p>'</script> so<!-- no -->", "if a < b then so"),
    ("<div role=navigation>n</div><div>kept &am", "kept &am"),
    ("", ""), (None, ""),
    ("plain text only", "plain text only"),
    ("<article><p title=\"a > b\">t<a href=\"x>u</a> v</p></article>", "tu v"),
]


def test_markup_cases(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.org/a", h) for i, (h, _) in enumerate(MARKUP)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(pages).collect()}
    assert got == {i: want for i, (_, want) in enumerate(MARKUP)}


def test_open_lines_shared_with_the_nearest_page_go(spark):
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://x.org/news/1", page("Site name", "Story one", "Links")),
            (2, "http://x.org/news/2", page("Site name", "Story two", "Links")),
            (3, "http://x.org/shop/9", page("Shop name", "An item", "Links")),
            (4, "http://alone.org/", page("Site name", "Alone", "Links")), (5, None, None)]
    got = {r.page_id: r.text for r in html_extract.extract_pages(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Story one", 2: "Story two", 3: "Shop name\nAn item", 4: "Site name\nAlone\nLinks", 5: ""}


def _texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in html_extract.extract_pages(df).collect()}


def test_lines_beside_an_article_are_compared(spark):
    notice = "<div>Notice to all</div>"
    rows = [(1, "http://x.org/a/1", f"<nav>Home Shop</nav>{notice}<article><p>Teaser</p><p>Same</p></article><div>Body one</div>"),
            (2, "http://x.org/a/2", f"<div>Home Shop</div>{notice}<div>Body two</div>"),
            (3, "http://x.org/a/3", f"{notice}<article><p>Teaser</p><p>Same</p></article><div>Body three</div>"),
            (4, "http://x.org/a/4", f"{notice}<article><p>Teaser</p><p>Same</p></article>"),
            (5, "http://alone.org/", "<article>Teaser</article><div>A body longer than its teaser</div>")]
    assert _texts(spark, rows) == {1: "Teaser\nSame\nBody one", 2: "Body two", 3: "Teaser\nSame\nBody three",
                                   4: "Teaser\nSame", 5: "Teaser\nA body longer than its teaser"}


def _host(n):
    """Pages of one host, whose sections share lines that others do not have."""
    return [(i, f"http://big.org/s{i // 10:04d}/{i:05d}",
             f"<div>Site</div><div>Section {i // 10}</div><div>Story number {i} and what it says</div>") for i in range(n)]


def test_a_large_host_is_differenced_like_a_small_one(spark):
    want = {i: f"Story number {i} and what it says" for i in range(2_500)}
    assert _texts(spark, _host(2_500)) == want


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_ranges_change_no_result(spark, ranges):
    copies = [(100 + i, "http://big.org/z/1", "<p>Copy</p><p>of it</p>") for i in range(9)]
    df = spark.createDataFrame(_host(40) + copies, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract_pages(df, ranges).collect()}
    want = {i: f"Story number {i} and what it says" for i in range(40)}
    assert got == want | {100 + i: "Copy\nof it" for i in range(9)}


def test_copies_do_not_delete_a_body(spark):
    def page(i, *more):
        body = [f"Paragraph {j} of story {i}, which is long enough to be running text" for j in range(4)]
        return "".join(f"<div>{x}</div>" for x in ("Site", *body, "Links", *more)), "\n".join(body)
    one, two, three = page(1), page(2), page(3)
    rows = [(1, "http://x.org/a/1", one[0]), (2, "http://x.org/a/1", one[0]),
            *((10 + i, f"http://x.org/a/1/print{i}", page(1, f"Version {i}")[0]) for i in range(12)),
            (3, "http://x.org/b/2", two[0]), (4, "http://x.org/b/3", three[0]),
            (5, "http://y.org/1", one[0]), (6, "http://y.org/1", one[0]),
            (7, "http://z.org/1", one[0]), (8, "http://z.org/1/print", page(1, "Print")[0])]
    all_of = f"Site\n{one[1]}\nLinks"
    want = {1: one[1], 2: one[1], 3: two[1], 4: three[1], 5: all_of, 6: all_of, 7: all_of, 8: all_of + "\nPrint"}
    want |= {10 + i: f"{one[1]}\nVersion {i}" for i in range(12)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in (1, 9):
        assert {r.page_id: r.text for r in html_extract.extract_pages(df, ranges).collect()} == want


WRAPPERS = [
    ("<article class='post comments-open'><p>In</p></article>", "In"),
    ("<main class='site-main has-sidebar'><p>In</p></main>", "In"),
    ("<main class='sidebar'><p>In</p></main>", "In"),
    ("<div id='content' class='no-sidebar'><article><p>In</p></article></div>", "In"),
    ("<div class='sidebar'><article><p>In a wrapper</p></article></div><p>by</p>", "In a wrapper"),
    ("<div class='related-posts'><main><p>In</p></main></div>", "In"),
    ("<article class='comment'><p>In</p></article>", "In"),
    ("<article><p>In</p></article><div class='related-posts'><article><p>Out, and longer</p></article></div>", "In"),
    ("<article><p>In</p></article><div class='site-sidebar'>Out</div><article class='comment'>Out, and longer</article>", "In"),
    ("<p>In</p><section id='post-comments'><article class='comment'><p>Out, and longer than it</p></article></section>", "In"),
]


def test_no_class_word_takes_the_main_text(spark):
    rows = [(i, f"http://w{i}.org/a", f"<nav>Menu</nav>{h}<footer>Foot</footer>") for i, (h, _) in enumerate(WRAPPERS)]
    assert _texts(spark, rows) == {i: want for i, (_, want) in enumerate(WRAPPERS)}


@pytest.mark.parametrize("bits", [1 << 28, 20])
def test_common_subsequence(monkeypatch, bits):
    monkeypatch.setattr(html_extract, "LCS_BITS", bits)
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice([1, 5])) for _ in range(rng.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        flags = html_extract.shared_lines(a, b)
        rest = iter(b)
        assert sum(flags) == best[-1][-1] and all(x in rest for x, f in zip(a, flags, strict=True) if f)


def test_odd_pages_take_linear_time():
    """Equal lines without end, unclosed and unmatched tags, nested articles."""
    import time
    start = time.time()
    assert sum(html_extract.shared_lines([7] * 8000 + [1], [2] + [7] * 7000)) == 7000
    for page in ("<div>" * 20_000 + "</span>" * 20_000, "<nav>" + "<article>" * 20_000 + "x" + "</article>" * 20_000,
                 "<b><i>" * 10_000 + "</b></i>" * 10_000, "<p>" * 20_000 + "</section>" * 20_000):
        html_extract.page_lines(page)
    assert time.time() - start < 20  # seconds of a loaded machine; quadratic work takes minutes


def test_open_pages_at_host_size(spark):
    """What a section shares goes from all its pages, what a page alone has stays."""
    assert _texts(spark, _host(600)) == {i: f"Story number {i} and what it says" for i in range(600)}


def _hashes(ws):
    """The library's hashes of words and of pairs of words."""
    data = np.frombuffer(b" ".join(ws) or b" ", dtype=np.uint8)
    end = np.cumsum([len(w) + 1 for w in ws], dtype=np.int64) - 1
    one = span_hash(data, end - np.array([len(w) for w in ws], dtype=np.int64), end)
    return one.tolist(), grams(one, 2).tolist()


def _labels(spark, docs, sf):
    """(doc_id, good, fits the model): the split is by the hash of the id."""
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("odd"))
    return [(r.doc_id, r.quality == 1, r.odd == 0) for r in rows.collect()]


def _rows_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_quality_verdicts_against_plain_counting(spark, docs):
    rows = _rows_of(docs)
    want = brute.verdicts(rows, _labels(spark, docs, SF), _hashes)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r.kept for r in quality.quality_rules(docs, labels).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)


def test_whole_pipeline_against_plain_stages(spark, docs, bench):
    """run() from the documents to the shards: the rows that three stages keep,
    the mix's words by source, and every shard."""
    rows = _rows_of(docs)
    kept = brute.verdicts(rows, _labels(spark, docs, SF), _hashes)
    rows = [(d, t) for d, t in rows if kept[d]]
    least = {c for _, c in brute.near_copies(rows).values()}
    rows = [(d, t) for d, t in rows if d in least]
    leaks = {d for d, _ in _leaks_by_hand(rows, [(r.item_id, r.text) for r in bench.collect()])}
    left = {d: t for d, t in rows if d not in leaks}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} <= left.keys()
    taken, source = Counter(), {r.doc_id: r.source for r in docs.collect()}
    for r in out:
        taken[r.doc_id] += len(brute.words(r.text))
        assert Counter(brute.words(r.text)) <= Counter(brute.words(left[r.doc_id]))  # blocks of one epoch
    sizes, got = Counter(), Counter()
    for d, t in left.items():
        sizes[source[d]] += len(brute.words(t))
        got[source[d]] += taken[d]
        assert taken[d] <= 2 * len(brute.words(t))
    for s, target in brute.fair_targets(dict(sizes)).items():
        assert abs(got[s] - target) <= 0.05 * target + 2 * 128
    table = sharding.fill_table(sharding.shard_names())
    for r in out:
        h = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16)
        assert r.shard == table[h % sharding.TABLE_SIZE]


def test_pipeline_over_odd_rows(spark, odd, odd_rows, tmp_path):
    """Nulls everywhere, repeated and missing ids, clashing columns, very long
    texts, no labels; and an empty table."""
    prose = dict(odd_rows)[9]
    more = odd.where("doc_id IN (6, 9)").withColumn("doc_id", F.lit(None).cast("long"))
    other = odd.where("doc_id = 9").withColumn("text", F.lit(prose[::-1]))
    long = odd.where("doc_id = 9").withColumn("doc_id", F.lit(99)).withColumn("text", F.lit(" ".join("u%d" % i for i in range(100_000))))
    for name, table in (("odd", odd.unionByName(more).unionByName(more).unionByName(other).unionByName(long)), ("none", odd.limit(0))):
        sf = f"{tmp_path}/{name}"
        table.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == [*odd.columns, "shard"]
        got = [(r.doc_id, set(brute.words(r.text))) for r in out.collect()]
        if name == "none":
            assert not got
        else:
            # Two texts share id 9 and one of them has no id either; the null id
            # comes first, so it stands for its copies.
            assert {d for d, _ in got} >= {None, 9, 99}
            assert all(ws <= set(brute.words(prose[::-1])) for d, ws in got if d == 9)


def test_pipeline(spark, docs, bench):
    """Each stage against its plain version on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "decontaminated", "mix_sources", "shard"]
    now = docs
    stage = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "near_copies", "decontaminated"):
        out = stage[name](spark, now, SF).cache()
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in out.collect()}
        assert all(before[d] == t for d, t in after.items())
        if name == "quality_rules":
            assert all(not brute.base_metrics(t)[5] for t in after.values())
        elif name == "near_copies":
            assert set(after) == {c for _, c in brute.near_copies(list(before.items())).values()}
        else:
            items = [r.text for r in bench.collect()]
            assert set(after) == {d for d, t in before.items() if not any(i in t for i in items)}
        now = out
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard"]
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in now.collect()}
