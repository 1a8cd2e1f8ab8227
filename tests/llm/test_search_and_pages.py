"""SimHash, vector searches, quality, page text."""
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cartflow.llm import hnsw, html, quality, simhash, topk
from cartflow.llm import vectors as vectors_module
from cartflow.llm.components import components

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, distance=3):
    group = list(range(len(ids)))
    fps = np.array(fps, np.uint64)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= distance) + i + 1:
            group[root(int(j))] = root(i)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


def test_groups_are_those_of_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = simhash.near_duplicates(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == plain_components(list(fps), list(fps.values()))


def test_bit_sliced_links_with_hot_lists_and_chunks(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = set()
    for _ in range(1500):  # chains of near copies around few centres, and strangers
        f = int(centre[rng.integers(0, 4)])
        for _ in range(rng.integers(0, 9)):
            f ^= 1 << int(rng.integers(0, 64))
        fps.add(f)
    fps = sorted(fps | {0, 1, 2, (1 << 64) - 1} | set(map(int, rng.integers(0, 1 << 63, 300))))
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, rep long")
    want = plain_components(list(range(len(fps))), fps)
    for chunk in (16, 4096):
        got = {r.node: r.component for r in components(simhash.links(frame, 3, chunk)).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100} | {i: 100 for i in range(101, 160)}


def test_simhash_of_odd_rows(spark, odd_docs, no_docs):
    rows = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    assert rows == [(-1, None), (1, 1), (2, 2), (3, 2), (4, 4), (5, 1), (5, 1), (7, 2), (8, 8)]
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 4, 8]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.one_of_each(no_docs).count() == 0


def test_rows_without_ids_link_and_rows_of_one_id_stay_apart(spark):
    base = [f"word{i}" for i in range(400)]
    near = [" ".join([*base, *tail]) for tail in ([], ["x"], ["y", "z"])]
    fps = [simhash.fingerprint(t) for t in near]
    assert len(set(fps)) == 3 and all((fps[0] ^ f).bit_count() <= 12 for f in fps)
    frame = spark.createDataFrame([(None, near[0]), (None, near[1]), (5, "one text of its own"), (5, "quite another one with other words")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(frame, distance=12).collect()]
    assert sorted(d or 0 for d, _ in kept) == [0, 5, 5] and len({t for _, t in kept}) == 3


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    base[150:220] = base[0]  # one vector that many rows share
    rows = [(i, [float(x) for x in v], "clash") for i, v in enumerate(base)]
    rows += [(300, None, ""), (301, [], ""), (302, [0.0] * 16, ""), (303, [float("nan")] * 16, ""), (None, [1.0] * 16, ""), (305, [1.0, None] * 8, ""),
             (306, [1.0] * 4, ""), (307, [3e38] * 16, ""), (0, rows[0][1], "clash"), (20, rows[20][1], "clash")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), base


def test_exact_top_k_is_that_of_all_products(spark, monkeypatch):
    frame, base = vectors(spark)
    ints = {i: [int(np.floor(1024.0 * float(x))) for x in v] for i, v in enumerate(base)} | {302: [0] * 16, 307: [int(np.floor(1024.0 * float(np.float32(3e38))))] * 16}
    want = []
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(ints[q], v)))), i) for i, v in ints.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    for chunk, block, together in ((64, 4, 64), (64, 4, 2), (8192, 2048, 64)):
        monkeypatch.setattr(vectors_module, "TOGETHER", together)
        got = topk.exact_top_k(frame, F.col("vec_id") % 20 == 0, 10, chunk=chunk, block=block)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.exact_top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_of_one_id_with_other_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (1, [0.9, 0.1001]), (2, [0.6, 0.6]), (3, [0.3, 1.0]), (4, [0.2, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(frame, F.col("vec_id") == 0, 3).collect())
    assert got == [(1, 1, 921 * 1024), (2, 2, 614 * 1024), (3, 1, 512 * 1024)]
    near = sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in hnsw.nearest(frame, F.col("vec_id") == 0, 3).collect())
    assert near == [(1, 1, 1.0), (2, 2, 0.707107), (3, 3, 0.287348)]


def test_branch_and_bound_on_many_dimensions():
    rng = np.random.default_rng(4)
    x = topk.integers(rng.normal(size=(3000, 64)), 1024.0)
    columns = np.ascontiguousarray(x.T)
    rest = np.sqrt(np.cumsum((columns ** 2)[::-1], 0)[::-1][::topk.DIMENSIONS])
    for q in (0, 17):
        place, score = topk.top_of_chunk(columns, rest, np.arange(3000), x[q], q, 10)
        full = x @ x[q]
        full[q] = -np.inf
        assert place.tolist() == np.lexsort((np.arange(3000), -full))[:10].tolist() and (score == full[place]).all()


def cosine_top(ids, x, q, own, k):
    score = (x * q).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))
    return [int(ids[i]) for i in np.lexsort((ids, -np.round(score, 12))) if ids[i] != own][:k]


def test_neighbours_reach_the_recall_and_give_exact_scores(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = frame.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in hnsw.nearest(frame, F.col("vec_id") % 10 == 0, 5, shard=128, block=16).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, found in got.items():
        v = x[ids == q][0]
        assert sorted(found) == [1, 2, 3, 4, 5] and [s for _, s in sorted(found.values(), key=lambda y: -y[1])] == [found[i][1] for i in range(1, 6)]
        for i, s in found.values():
            w = x[ids == i][0]
            assert abs(s - v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)) < 1e-12
        hits += len({i for i, _ in found.values()} & set(cosine_top(ids, x, v, q, 5)))
    assert len(got) == 50 and hits / (5 * len(got)) >= 0.9


def test_neighbours_of_odd_rows_and_copies(spark):
    frame, _ = vectors(spark)
    got = {}
    for r in sorted(hnsw.nearest(frame, F.col("vec_id") % 20 == 0, 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [150, 151, 152, 153, 154] and got[160] == [0, 150, 151, 152, 153] and set(got) == {*range(0, 300, 20)}
    assert all(len(v) == 5 for v in got.values())
    assert hnsw.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_quality_on_held_out_ids(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels.where(quality.in_training()))
    rows = quality.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(~quality.in_training()).collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in rows]
    assert len(rows) > 50 and sum(right) / len(right) >= 0.95
    odd = quality.score(odd_docs, model, odd_docs.columns).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.score(no_docs, model, ["doc_id"]).count() == 0
    scored = quality.score(odd_docs.withColumn("score", F.lit("old")), model, [*odd_docs.columns, "score"])
    assert scored.columns == [*odd_docs.columns, "score"] and sorted(r.score for r in scored.collect()) == sorted(r.score for r in odd)
    assert quality.train(no_docs, labels) is None and {r.score for r in quality.score(odd_docs, None, ["doc_id"]).collect()} == {0.5}


def test_forward_backward_is_that_of_all_labellings():
    rng = np.random.default_rng(0)
    count = np.array([1, 4, 3])
    unary, move = rng.normal(size=8), rng.normal(size=(2, 2))
    got, pairs = quality.forward_backward(unary, move, count)
    want, both, at = np.zeros((8, 2)), np.zeros((2, 2)), 0
    for n in count:
        total, one, two = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for code in range(2 ** n):
            y = [code >> t & 1 for t in range(n)]
            p = np.exp(sum(unary[at + t] * y[t] for t in range(n)) + sum(move[y[t], y[t + 1]] for t in range(n - 1)))
            total += p
            for t in range(n):
                one[t, y[t]] += p
            for t in range(n - 1):
                two[y[t], y[t + 1]] += p
        want[at:at + n] = one / total
        both += two / total
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, both)


def test_page_text(spark):
    cases = {
        None: "", "": "", "text only": "text only", "<p>a<p>b": "a\nb", "a < b &amp; c &lt;": "a < b & c <",
        "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
        "<div class='x'><article><h1>T</h1><p>long text here that is long enough</p><div class='comments'><p>no</p></div></article><aside>x</aside></div>":
            "T\nlong text here that is long enough",
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><a href='/'>home</a></nav><div id='main'><h2>Head &eacute;</h2>"
        "<p>one  two\n three <b>bold</b>.</p><p>four <a href='x'>link</a> five</p><form><p>q</p></form></div><footer>f</footer></body></html>":
            "Head é\none two three bold.\nfour link five",
        "<body><div class='sidebar'><p>much much much text in the side bar</p></div><article>main<br>text<script>x</script></article><!-- c --></body>": "main text",
    }
    frame = spark.createDataFrame([(i, "u", h) for i, h in enumerate(cases)], "page_id long, url string, html string")
    rows = html.extract(frame, ["page_id", "url"]).collect()
    assert {r.page_id: r.text for r in rows} == dict(enumerate(cases.values())) and all(r.n_chars == len(r.text) for r in rows)
    assert len(html.main_text("<p>" * 20_000 + "x" + "<" * 20_000)) > 0
    assert html.extract(frame.limit(0), ["page_id"]).count() == 0


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    import html as standard
    import re
    for p in pages:
        inside = p.html[p.html.index("<article>") + 9:p.html.index("</article>")]
        blocks = [" ".join(standard.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert html.main_text(p.html) == "\n".join(b for b in blocks if b)


def test_marks_do_not_take_the_article_along():
    story = "<h1>Title</h1><p>long text of an article that goes on and on</p><p>and a second paragraph, as long as the first one was</p>"
    want = "Title\nlong text of an article that goes on and on\nand a second paragraph, as long as the first one was"
    side = "<div class='sidebar'><p>other <a href='/'>news of the day</a></p></div>"
    for box in ("content has-sidebar", "no-sidebar", "with-header", "comments-open", "widget"):
        for inner in (story, f"<article>{story}</article>"):
            assert html.main_text(f"<body><div class='{box}'>{inner}</div>{side}</body>") == want, (box, inner)
    assert html.main_text(f"<body><form action='x.aspx'><input name=a>{side}<div id='main'>{story}</div><select><option>o</select></form></body>") == want
    head = "<article><header><h1>Title</h1></header>" + story.partition("</h1>")[2] + "</article>"
    assert html.main_text(f"<body><header><p>My site</p></header><div class='menu'>{head}</div><footer>f</footer></body>") == want
    assert html.main_text(f"<body><div class='x ad'><p>buy</p></div><article>{story}<div id='comments'><p>no</p></div></article></body>") == want
    replies = "<section class='comments'><article class='comment'><p>a reader's long answer to this</p></article></section>"
    assert html.main_text(f"<body><main><h1>Title</h1><div class='widget'>{story.partition('</h1>')[2]}</div>{replies}</main></body>") == want
    assert html.main_text(f"<body><article>{story}</article>{replies}</body>") == want


@pytest.mark.parametrize("kind", ["random 64", "random 256", "clusters"])
def test_recall_of_a_whole_shard(kind):
    rng = np.random.default_rng(1)
    if kind == "clusters":
        x = rng.normal(size=(40, 64))[rng.integers(0, 40, 8192)] + 0.05 * rng.normal(size=(8192, 64))
    else:
        x = rng.normal(size=(8192, int(kind.split()[1])))
    x = hnsw.unit(x)
    graph, hits = hnsw.build(x), 0
    queries = rng.choice(len(x), 80, replace=False)
    for i in queries:
        sims = x @ x[i]
        sims[i] = -2
        got = [j for _, j in graph.search(x[i], max(hnsw.EF_SEARCH, 5 * x.shape[1] // 4)) if j != i][:5]
        hits += len(set(np.argsort(-sims)[:5]) & set(got))
    assert hits >= 0.9 * 5 * len(queries)


@pytest.mark.parametrize("page", ["<div>{}</x>", "<a ", "<a '", "<a \">\" ", "<!", "<b>{}<hr>", "<b>{}</i>", "<p><b>{}<div>", "<a<b", "<script>", "<div>", "<table>{}</b>"])
def test_malformed_pages_take_time_in_proportion(page):
    def seconds(n):
        first, _, then = page.partition("{}")
        source = "<body><i>" + first * n + then * n + "\">'"
        best = []
        for _ in range(2):
            start = time.perf_counter()
            html.main_text(source)
            best.append(time.perf_counter() - start)
        return min(best)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.3  # quadratic time would be 16 times as long


def test_ends_of_elements_and_tags():
    page = html.Page("<body><p>a<b>b<div>c</p></b><table><tr><td>x</b>y<tr><td>z</table></div>d<a title='1>2'>e</a><a \"f<i>g</i>")
    assert [t for t in page.tag[1:]] == ["body", "p", "b", "div", "table", "tr", "td", "tr", "td", "a", "i"]
    parents = [page.tag[p] for p in page.parent[1:]]
    assert parents == ["html", "body", "p", "body", "div", "table", "tr", "tr", "tr", "body", "body"]
    assert html.main_text("<body><p>a &amp; b</p><a title='x>y' href=\"z\">c</a> <p class='d\">e") == "a & b\nc <p class='d\">e"
