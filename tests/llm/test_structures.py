"""Near duplicates, mixing, search, archives and pages against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.llm import html_main, minhash, mixing, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def components(rows):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check_groups(docs):
    want = components(docs.collect())
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_near_duplicates_of_documents(documents):
    check_groups(documents)


def test_near_duplicates_of_a_chain_and_a_star(spark):
    draw = random.Random(4)
    words = [f"w{draw.randint(0, 999)}" for _ in range(200)]
    rows, chain = [], list(words)
    for i in range(30):  # star: copies of one text, most pairs of copies are too far apart
        own = list(words)
        for _ in range(5):
            own[draw.randrange(200)] = f"x{i}"
        rows.append((i + 10, " ".join(own)))
    for i in range(12):  # chain: each a little further from the first
        chain[i * 12] = f"y{i}"
        chain[i * 12 + 5] = f"z{i}"
        rows.append((i + 100, " ".join(chain)))
    rows += [(5, " ".join(words).upper()), (500, "a b c d"), (501, "A b\tc  d"), (502, "a b c"), (503, "a b c e")]
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_near_duplicates_among_texts_that_share_a_passage(spark):
    """Buckets of texts just below the threshold, with a few pairs above it hidden among them."""
    draw = random.Random(6)
    passage, rows = [f"p{draw.randint(0, 9999)}" for _ in range(260)], []
    for i in range(150):
        own = [f"u{i}x{k}" for k in range(draw.choice([35, 40, 60]))]
        rows.append((i, " ".join(passage + own)))
        if i % 15 == 0:
            copy = passage + own
            copy[7] = copy[-20] = f"c{i}"
            rows.append((1000 + i, " ".join(copy)))
    check_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_sketches_lose_no_similar_pair():
    draw = np.random.default_rng(3)
    for n in (1, 3, 40, 500, 9000, 60_000):
        base = draw.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        for share in (0.0, 0.05, 0.1, 0.12, 0.5, 1.0):
            swap = int(share * n)
            other = np.concatenate([base[swap:], draw.integers(0, 1 << 63, swap).astype(np.uint64) * np.uint64(2)])
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            row = lambda s: np.frombuffer(minhash.sketch(s), np.uint8)[None, :]
            may = minhash.possible(row(a), row(b))[0]
            assert may or 100 * both < 80 * (len(a) + len(b) - both)
            if share == 1.0 and n in (40, 500):
                assert not may


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_shared_source_with_many_unlike_texts(spark, monkeypatch, ids):
    """Texts that share half of one source meet in the same buckets; the similar ones among them are all found."""
    monkeypatch.setattr(minhash, "LOOKUP_IDS", ids)
    rng = random.Random(5)
    source = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        text = list(source)
        for at in range(0, 120, rng.choice([9, 14, 20])):
            text[at] = f"x{i if i % 3 else rng.randrange(3)}_{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_groups(docs)
    assert 20 < docs.join(minhash.near_duplicates(docs).where("kept"), "doc_id").count() < 215


def test_rare_shingles_find_every_similar_pair(spark, documents):
    """Without buckets or links before, the search by rarity alone proposes every similar pair, and few others."""
    texts = documents.select("doc_id", "text").dropDuplicates(["text"])
    rows = {r.doc_id: shingles(r.text) for r in texts.collect()}
    placed = texts.where("text is not null").select(F.col("doc_id").alias("doc"), F.col("doc_id").alias("root"))
    found = {(r.u, r.v) for r in minhash.by_rarity(minhash.sets_of(placed, texts)).collect()}
    ids, similar = sorted(rows), set()
    for i, u in enumerate(ids):
        for v in ids[i + 1:]:
            a, b = rows[u], rows[v]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                similar.add((u, v))
    assert similar and similar <= found


def test_near_duplicates_odd_input(odd, none):
    rows = minhash.near_duplicates(odd).collect()
    found = defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert len(rows) == odd.count()
    assert found[1] == [(0, 1, True)] and found[3] == [(0, 3, True)] and found[None] == [(1, None, True)]
    assert found[4] == [(1, 4, True)] and found[5] == [(1, 4, False)] * 2 and found[8] == [(1, 8, True)]
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.first_of_groups(odd)
    assert kept.columns == odd.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10]


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in full}, **share}
        full |= over


@pytest.mark.parametrize("name", ["documents", "odd", "skewed"])
def test_mix(request, spark, name):
    if name == "skewed":
        draw = random.Random(2)
        docs = spark.createDataFrame([(i, "w " * draw.choice([1, 30, 500, 4000]), draw.choice(["a", "b", "b", "b", None, "é"])) for i in range(400)],
                                     "doc_id bigint, text string, source string")
    else:
        docs = request.getfixturevalue(name)
    rows = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs.collect())
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    wanted = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(wanted[r.source])
    if name != "odd":
        for s in sizes:
            assert abs(taken[s] - wanted[s]) <= 0.03 * wanted[s] + 4 * mixing.BLOCK
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(mixing.mix(docs).collect(), key=key) == sorted(rows, key=key)


def test_permutations_hit_every_block_once(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 1000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("s"), F.lit(1)).alias("p"))
        assert sorted(r.p for r in rows.collect()) == list(range(n))


def test_mixed_documents(odd, none, documents):
    out = mixing.mixed_documents(documents)
    assert out.columns == documents.columns
    assert max(Counter(r.doc_id for r in out.collect()).values()) <= 3
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def plain_top(vectors, queries, k=5):
    whole = lambda v: [int(np.floor(256 * float(x))) for x in v]
    ok = [(i, whole(v)) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i in queries:
            scores = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return Counter(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 4000)
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.round(draw.standard_normal(40) * scale, 2)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(5)] + [(50, rows[3][1]), (300, None), (301, []), (302, [1.0, None]), (303, [float("nan")] * 40),
             (None, [1.0] * 40), (350, [1.0, 2.0]), (351, [2.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    assert Counter(tuple(r) for r in got.collect()) == plain_top(rows, {0, 50, 100, 200, 300, 350})
    assert topk.top_k(vectors.where("false"), vectors.where("false")).count() == 0


def test_top_k_holds_products_of_few_queries():
    import tracemalloc
    draw = np.random.default_rng(4)
    vectors, ids = topk.integers(draw.standard_normal((6000, 32))), np.arange(6000)
    tracemalloc.start()
    found = list(topk.best(vectors[:600], ids[:600], vectors, ids))
    few = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    next(topk.best(vectors[:3000], ids[:3000], vectors, ids))
    assert tracemalloc.get_traced_memory()[1] < few + (8 << 20)
    tracemalloc.stop()
    products = vectors[:600] @ vectors.T
    np.fill_diagonal(products, -np.inf)
    for row, own in zip(found, products):
        order = np.lexsort((ids, -own))[:topk.K]
        assert row == [(int(own[o]), int(o)) for o in order]


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 200)
    rows = [(i, f"http://x/{i}", t) for i, t in enumerate([None, "", "a", "b\r\n\r\nc", "a", "é" * 5000, "a", "b"])] + [
        (9, None, "u"), (9, None, "u"), (None, "http://n\n1", "a"), (None, None, "only")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS sha", "1 AS response", "2 AS n")
    folder = f"file://{tmp_path}/bundles"
    index = warc.write(pages, folder)
    got = Counter(tuple(r) for r in warc.read(index, folder).collect())
    last = {}
    for i, _, t in rows:
        last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, t in rows:
        raw, best = (t or "").encode(), last[t or ""]
        first = i == best or (best == -1 and i is None)
        want[i, len(raw), warc.digest32(raw), "response" if first else "revisit", None if first else best] += 1
    assert got == want
    wanted = index.where("page_id in (3, 5, 6)")
    assert {r.page_id: r.payload_bytes for r in warc.fetch(wanted, folder).collect()} == {3: 6, 5: 10_000, 6: 1}
    assert warc.read(warc.write(pages.where("false"), folder), folder).count() == 0


def test_bundles_are_plain_zstandard(tmp_path):
    import io
    import zstandard
    path = tmp_path / "b.zst"
    bundle = warc.Bundle(open(path, "wb"))
    raw = [warc.record(i, None, hashlib.md5(bytes([i])).digest() * 9000, None, False) for i in range(9)]
    places = [bundle.add(r) for r in raw]
    bundle.close()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True).read()
    assert whole == b"".join(raw) and len({f for f, _ in places}) > 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, cheap, good.</div>%s
<aside>Side, bar.</aside><div id="comments"><p>Great, great, great article, thanks a lot, really, yes.</p></div><footer>&copy; F</footer></body></html>"""


@pytest.mark.parametrize("article,text", [
    ("<article><h1>Head</h1><p><b>One &amp; two.<br><p>Three,\n  four.</p></article>", "Head\nOne & two.\nThree, four."),
    ("<div class='content'><h2>Head</h2><p>%s</p><ul><li>a</li><li>b</ul><p>tail, end.</div>" % ("Long, long text. " * 9), "Head\n%s\na\nb\ntail, end." % ("Long, long text. " * 9).strip()),
    ("<main><p>x</p><form><p>f, f, f</p></form><p>y<script>1<2</script>z</p></main>", "x\nyz"),
    ("<article><p>Cut &lt;here&gt; and", "Cut <here> and"),
    ("", "")])
def test_pages(article, text):
    page = PAGE % article if not article.endswith("and") else PAGE.split("%s")[0] + article + " <a hre"
    if article:
        assert html_main.main_text(page) == text
    else:
        assert "Home" not in html_main.main_text(page)


@pytest.mark.parametrize("parts,text", [
    # One part holds nearly all points; short parts, lists, tables and paragraphs beside it belong to the page.
    ("<div class='post'><section><p>Short, start.</p></section><section>%s</section><div><p>Short end.</p></div></div>", "Short, start.\n%s\nShort end."),
    ("<div class='post'><p>Lead.</p><div>%s</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div>", "Lead.\n%s\na\nb\nc d"),
    ("<div><div><h2>Head</h2></div><div><div>%s</div></div></div><p>Last, <a href='x'>one</a>.</p>", "Head\n%s\nLast, one."),
    ("<div>Loose <a href='x'>word</a> text.<div>%s</div></div><div><a href='y'>More</a> <a href='z'>pages</a></div>", "Loose word text.\n%s")])
def test_pages_without_article_keep_their_parts(parts, text):
    long = ["Long, long, long text, indeed. " * 12] * 9
    assert html_main.main_text(PAGE % (parts % "".join(f"<p>{p}</p>" for p in long))) == text % "\n".join(p.strip() for p in long)


@pytest.mark.parametrize("page,text", [
    ("<div class='content has-sidebar'><p>%s</p></div>", "%s"),
    ("<div id='post-no-sidebar'><p>%s</p></div>", "%s"),
    ("<div class='layout with_social'><p>%s</p></div>", "%s"),
    ("<div class='sidebar-left page'><article><p>%s</p></article></div>", "%s"),
    ("<div class='widget'><main><p>%s</p></main></div>", "%s"),
    ("<div class='notice'><p>%s</p></div>", "%s"),
    ("<div class='comments-open'><h1>Head</h1><p>%s</p></div>", "Head\n%s"),
    ("<article><div class='entry-header'><h1>Head</h1></div><p>%s</p></article>", "Head\n%s"),
    ("<article><p>%s</p><div class='share'><p>Share this.</p></div></article>", "%s"),
    ("<div><p>%s</p></div><div class='sidebar'><p>About, us.</p></div><div class='comments'><article class='comment'><p>Me, too. "
     + "No, no. " * 300 + "</p></article></div>", "%s")])
def test_names_do_not_cut_off_the_article(page, text):
    long = ("Long, long text, indeed. " * 40).strip()
    assert html_main.main_text(PAGE % (page % long)) == text % long


def test_pages_odd_input(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<"), (4, "u", "plain"), (4, "u", "plain"), (5, "u", "<p>" + "<div>" * 3000 + "deep"), (6, "u", "<p>a</p>" * 20_000)]
    got = html_main.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert [(r.page_id, r.n_chars) for r in sorted(got, key=lambda r: r.page_id)] == [(1, 0), (2, 0), (3, 0), (4, 5), (4, 5), (5, 4), (6, 39_999)]
